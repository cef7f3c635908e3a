"""SQL for every query that SQL can express, on the base tables and in the rank form: a second way to the same rows."""

from __future__ import annotations

import re

from tiermark.functions.special import zeta_slope_sql, zeta_sql
from tiermark.plans.bindings import EXCLUDED

BETA_1, BETA_2, WORKS_CAP = 2.963, 2.998, 15
_OUT = ", ".join(f"'{x}'" for x in EXCLUDED)


def _h(source: str, keys: str, value: str, h: str, n: str, where: str = "TRUE", more: str = "") -> str:
    """keys, h and member count in the rank form; groups without a qualifying member are left out."""
    return f"""SELECT {keys}, CAST(max(CASE WHEN {value} >= rk THEN rk END) AS BIGINT) AS {h}, count(*) AS {n} {more}
        FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {value} DESC NULLS LAST) AS rk FROM {source} WHERE {where})
        GROUP BY {keys} HAVING max(CASE WHEN {value} >= rk THEN rk END) > 0"""


def _modal(level: str, column: str, name: str) -> str:
    return f"""SELECT author_id, {column} AS {level}, lname AS {level}_name FROM (
        SELECT author_id, {column}, max({name}) AS lname, row_number() OVER (PARTITION BY author_id ORDER BY sum(weight) DESC, {column}) AS rn
        FROM topics WHERE {column} IS NOT NULL GROUP BY author_id, {column}) WHERE rn = 1"""


_CTES = {
    "li": "SELECT o_custkey AS author_id, l_orderkey, l_suppkey, l_partkey, l_quantity, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "papers": "SELECT author_id, l_orderkey AS work_id, CAST(floor(sum(l_quantity)) AS BIGINT) AS citations FROM li GROUP BY ALL",
    "h1": _h("papers", "author_id", "citations", "h_index", "works_count"),
    "aff": """SELECT author_id, l_suppkey AS institution_id, CASE WHEN author_id % 7 = 0 THEN lower(s_name) ELSE s_name END AS institution_name,
        CASE WHEN s_acctbal >= 0 THEN 'education' ELSE 'company' END AS type, max(year(l_shipdate)) AS latest_year
        FROM li JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
    "inst": """SELECT author_id, institution_id, institution_name, latest_year FROM (
        SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY latest_year DESC NULLS LAST, institution_id) AS rn FROM aff WHERE type = 'education') WHERE rn = 1""",
    "topics": """SELECT author_id, p_type AS field, p_brand AS subfield, CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'size' ELSE 'grade' END AS domain,
        CAST(l_partkey AS VARCHAR) AS topic, p_name, count(*) AS weight FROM li JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "m_field": _modal("field", "field", "field"),
    "m_subfield": _modal("subfield", "subfield", "subfield"),
    "m_domain": _modal("domain", "domain", "domain"),
    "m_topic": _modal("topic", "topic", "p_name"),
    "flat": """SELECT * FROM h1 JOIN inst USING (author_id) JOIN m_field USING (author_id) LEFT JOIN m_subfield USING (author_id)
        LEFT JOIN m_domain USING (author_id) LEFT JOIN m_topic USING (author_id)""",
    "canon": """SELECT institution_id, institution_name AS canonical FROM (
        SELECT institution_id, institution_name, row_number() OVER (PARTITION BY institution_id ORDER BY count(*) DESC, institution_name) AS rn FROM flat GROUP BY institution_id, institution_name) WHERE rn = 1""",
    "authors": """SELECT author_id, h_index, works_count, institution_id, canonical AS institution_name, field, field_name, subfield, subfield_name, domain, domain_name, topic, topic_name
        FROM flat JOIN canon USING (institution_id)""",
    "h2": _h("authors", "institution_id, institution_name", "h_index", "h2", "author_count"),
    "h2f": _h("authors", "institution_id, field, institution_name, field_name", "h_index", "h2", "author_count"),
    "h2s": _h("authors", "institution_id, subfield, institution_name, subfield_name", "h_index", "h2", "author_count", "subfield IS NOT NULL"),
    "cm": "SELECT s_suppkey AS id, n_name AS country_code FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 20 <> 0",
    "h2c": "SELECT * FROM h2 JOIN cm ON institution_id = id",
    "h2fc": "SELECT * FROM h2f JOIN cm ON institution_id = id",
    "h2sc": "SELECT * FROM h2s JOIN cm ON institution_id = id",
    "h3": _h("h2c", "country_code", "h2", "h3", "institution_count"),
    "h3f": _h("h2fc", "country_code, field, field_name", "h2", "h3", "institution_count"),
    "h3s": _h("h2sc", "country_code, subfield, subfield_name", "h2", "h3", "institution_count"),
    "leader": "SELECT institution_name AS lead_name FROM h2 ORDER BY h2 DESC, institution_name LIMIT 1",
    "lead_c": "SELECT country_code AS lead_code FROM h3 ORDER BY h3 DESC, country_code LIMIT 1",
    "fpos": "SELECT *, row_number() OVER (PARTITION BY field ORDER BY h2 DESC, institution_name, institution_id) AS field_rank FROM h2f",
    "brd": """SELECT institution_id, b.institution_name, top10_fields, top50_fields, top100_fields, total_fields, h2 AS overall_h2, author_count,
        row_number() OVER (ORDER BY h2 DESC, b.institution_name, institution_id) AS overall_rank FROM (
        SELECT institution_id, max(institution_name) AS institution_name, count(*) FILTER (WHERE field_rank <= 10) AS top10_fields, count(*) FILTER (WHERE field_rank <= 50) AS top50_fields,
        count(*) FILTER (WHERE field_rank <= 100) AS top100_fields, count(*) AS total_fields FROM fpos GROUP BY institution_id) b JOIN h2 USING (institution_id)""",
    "won": """SELECT field_name, country_code, h3, CASE t WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' ELSE 'bronze' END AS medal FROM (
        SELECT *, dense_rank() OVER (PARTITION BY field_name ORDER BY h3 DESC) AS t FROM h3f) WHERE t <= 3""",
    "works": "SELECT work_id AS id, citations AS cited_by_count, strftime(o_orderdate, '%Y-%m') AS month FROM papers JOIN orders ON work_id = o_orderkey",
    "months": "SELECT month, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT month FROM works)",
    "prof": """SELECT c_custkey AS author_id, c_name AS name, '0000-' || c_custkey AS orcid, h_index + c_custkey % 5 - 1 AS h_index_external, c_mktsegment || '; ' || c_name || '; third' AS affiliation_text
        FROM customer JOIN h1 ON c_custkey = author_id WHERE c_custkey % 3 <> 0""",
    "cfg": "SELECT institution_name AS institution FROM h2 ORDER BY h2 DESC, institution_name LIMIT 4",
    "line_all": _h("(SELECT DISTINCT institution, author_id, h_index FROM cfg JOIN authors ON institution = institution_name)", "institution", "h_index", "h2", "n"),
    "line_std": _h("(SELECT DISTINCT institution, author_id, h_index FROM cfg JOIN authors ON institution = institution_name AND field_name = 'STANDARD')", "institution", "h_index", "h2", "n"),
    "val": """SELECT 'Threshold' AS bucket, institution, '(overall)' AS field, author_id, h_index AS h_index_local, 'index equals h2, ' || h2 AS reason FROM (
            SELECT institution, author_id, h_index, h2, row_number() OVER (PARTITION BY institution ORDER BY author_id) AS rn FROM line_all JOIN authors ON institution = institution_name AND h_index = h2) WHERE rn <= 2
        UNION ALL SELECT 'Threshold in a field', institution, 'STANDARD', author_id, h_index, 'index equals h2, ' || h2 FROM (
            SELECT institution, author_id, h_index, h2, row_number() OVER (PARTITION BY institution ORDER BY author_id) AS rn FROM line_std JOIN authors ON institution = institution_name AND h_index = h2 AND field_name = 'STANDARD') WHERE rn <= 1
        UNION ALL SELECT 'Top', institution, '(overall)', author_id, h_index, 'leads its institution' FROM (
            SELECT institution, author_id, h_index, row_number() OVER (PARTITION BY institution ORDER BY h_index DESC, author_id) AS rn FROM cfg JOIN authors ON institution = institution_name) WHERE rn <= 3
        UNION ALL SELECT * FROM (SELECT 'Leaders of all', institution_name, '(overall)', author_id, h_index, 'leads all authors' FROM authors ORDER BY h_index DESC, author_id LIMIT 5)""",
    "smp": """SELECT 'citations' AS label, citations AS value FROM papers UNION ALL SELECT 'authors', h_index FROM h1 UNION ALL SELECT 'institutions', h2 FROM h2 UNION ALL SELECT 'authors_size', works_count FROM h1 WHERE works_count <= 15 UNION ALL SELECT 'institutions_size', author_count FROM h2""",
    "hist": "SELECT label, value AS x, count(*) AS c FROM smp WHERE value > 0 GROUP BY ALL",
    "tails": "SELECT a.label, a.x, sum(b.c) AS n, sum(b.c * ln(b.x)) AS s, count(*) AS d FROM hist a JOIN hist b ON a.label = b.label AND b.x >= a.x GROUP BY ALL",
    "best_fits": f"""SELECT label, alpha, xmin, CAST(n_tail AS BIGINT) AS n_tail, CAST(n_total AS BIGINT) AS n_total, d_ks, CASE WHEN v > 0 THEN r / (sqrt(n_tail) * sqrt(v)) ELSE 0 END AS r_exp FROM (
        SELECT b.label, alpha, xmin, n_tail, n_total, d_ks, sum(c * d) AS r, sum(c * d * d) / n_tail - pow(sum(c * d) / n_tail, 2) AS v FROM (
            SELECT f.*, x, c, -alpha * ln(x) - ln({zeta_sql('alpha', 'xmin')}) - (ln(1 - exp(-rate)) - rate * (x - xmin)) AS d FROM (
                SELECT *, ln(1 + 1 / (sx / n_tail - xmin)) AS rate FROM (
                    SELECT k.*, (SELECT sum(h.c * h.x) FROM hist h WHERE h.label = k.label AND h.x >= k.xmin) AS sx, (SELECT sum(h.c) FROM hist h WHERE h.label = k.label) AS n_total FROM (
                        SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(d_ks, 9), xmin) AS rn FROM (
                            SELECT c.label, xmin, max(n_tail) AS n_tail, max(alpha) AS alpha, max(abs(t.n / n_tail - {zeta_sql('alpha', 't.x')} / {zeta_sql('alpha', 'xmin')})) AS d_ks
                            FROM cand c JOIN tails t ON c.label = t.label AND t.x >= xmin GROUP BY c.label, xmin)) k WHERE rn = 1)) f JOIN hist h ON f.label = h.label AND h.x >= f.xmin) b
        WHERE n_total >= 50 GROUP BY b.label, alpha, xmin, n_tail, n_total, d_ks)""",
    "beta_fit": f"SELECT coalesce((SELECT round(alpha, 4) FROM best_fits WHERE label = 'authors'), {BETA_1}) AS beta",
    "cand": "SELECT label, x AS xmin, n AS n_tail, 1 + n / (s - n * ln(x - 0.5)) AS alpha FROM tails WHERE d > 1",
}


# the same over the works of every author, without the cap
_CTES["every_smp"] = _CTES["smp"].replace("FROM h1 WHERE works_count <= 15", "FROM h1")
for _name in ("hist", "tails", "cand", "best_fits"):
    _CTES[f"every_{_name}"] = re.sub(r"\b(FROM|JOIN) (smp|hist|tails|cand)\b", r"\1 every_\2", _CTES[_name])


def _ordered(need: set[str]) -> list[tuple[str, str]]:
    """The common tables in need, each behind those that it uses."""
    import re

    out: dict[str, str] = {}

    def place(name: str) -> None:
        for other in need - set(out) - {name}:
            if re.search(rf"\b(FROM|JOIN)\s+{other}\b", _CTES[name]):
                place(other)
        out.setdefault(name, _CTES[name])

    for name in sorted(need):
        place(name)
    return list(out.items())


def _with(body: str) -> str:
    """body after the common tables that it uses, directly or not."""
    import re

    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in _CTES:
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need.add(name)
                todo.append(_CTES[name])
    used = ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in _ordered(need))
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {used},\n{body.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {used}\n{body}" if used else body


def _ranks(level: str, source: str, column: str, value: str, h: str, n: str, key: str | None) -> str:
    part = f"PARTITION BY {key} " if key else ""
    return f"""SELECT '{level}' AS level, {key or "'(overall)'"} AS label, {h}, {n}, rk AS rank, total FROM (
        SELECT *, rank() OVER ({part}ORDER BY {h} DESC) AS rk, count(*) OVER ({part}) AS total FROM {source}) WHERE {column} = (SELECT {value})"""


def _eff(source: str, keys: str, h: str, n: str, beta: float | str, least: int, ties: str, scope: str, name: str) -> str:
    inner = f"SELECT *, row_number() OVER (ORDER BY {h} DESC, {ties}) AS {name} FROM {source}" + (f" WHERE {n} >= {least}" if scope == "filtered" else "")
    return f"""SELECT {keys}, {h}, {n}, round({h} / pow({n}, 1 / {beta}), 4) AS efficiency, {name}, row_number() OVER (ORDER BY {h} / pow({n}, 1 / {beta}) DESC, {ties}) AS efficiency_rank
        FROM ({inner}) WHERE {n} >= {least}"""


def _best(source: str, keys: str, h: str, n: str, beta: float, least: int, ties: str) -> str:
    return f"""SELECT field_name, {keys}, {h}, {n}, round(e, 4) AS efficiency, h_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY e DESC, {h} DESC, {ties}) AS rn FROM (
        SELECT *, {h} / pow({n}, 1 / {beta}) AS e, row_number() OVER (PARTITION BY field_name ORDER BY {h} DESC, {ties}) AS h_rank FROM {source} WHERE {n} >= {least})) WHERE rn = 1"""


def _gini(source: str, key: str, value: str) -> str:
    return f"""SELECT {key}, count(*) AS n, max({value}) AS max_value, round(avg({value}), 2) AS mean_value,
        round(2.0 * sum(i * {value}) / (count(*) * sum({value})) - (count(*) + 1) / count(*), 4) AS gini
        FROM (SELECT {key}, {value}, row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS i FROM {source} WHERE {value} IS NOT NULL) GROUP BY {key}"""


def _histogram(bins: int, log: bool) -> str:
    x = "log10(citations)" if log else "CAST(citations AS DOUBLE)"
    out = (lambda v: f"round(pow(10, {v}), 6)") if log else (lambda v: f"round({v}, 6)")
    return f"""SELECT bin, {out(f"a + (b - a) * bin / {bins}")} AS low, {out(f"a + (b - a) * (bin + 1) / {bins}")} AS high, count(*) AS n FROM (
        SELECT a, b, CAST(CASE WHEN b = a THEN 0 ELSE least({bins - 1}, floor((x - a) / (b - a) * {bins})) END AS BIGINT) AS bin
        FROM (SELECT {x} AS x FROM papers {"WHERE citations > 0" if log else ""}), (SELECT min({x}) AS a, max({x}) AS b FROM papers {"WHERE citations > 0" if log else ""})) GROUP BY bin, a, b"""


def _spread(n: int) -> str:
    """Months at n evenly spread places; halves to even."""
    steps = ", ".join(f"CAST(round_even({i} * (m - 1) / {n - 1}, 0) AS BIGINT)" for i in range(n))
    return f"SELECT month FROM months WHERE m <= {n} OR i IN ({steps})"


def _fields(medal: str) -> str:
    return f"coalesce(string_agg(field_name, '; ' ORDER BY field_name) FILTER (WHERE medal = '{medal}'), '') AS {medal}_fields"


def _document(level: str, h2: str, h3: str, label: str | None, limit: str) -> str:
    key = label or "'(overall)'"
    side = lambda source, name, h, alias: f"""(SELECT label, '[' || string_agg('{{"rank":' || rk || ',"name":"' || name || '","{h}":' || h || '}}', ',' ORDER BY rk) || ']' AS {alias} FROM (
        SELECT {key} AS label, {name} AS name, {h} AS h, row_number() OVER (PARTITION BY {key} ORDER BY {h} DESC, {name}) AS rk FROM {source}) {limit} GROUP BY label)"""  # noqa: E731
    return f"SELECT '{level}' AS level, label, institutions, countries FROM {side(h2, 'institution_name', 'h2', 'institutions')} a FULL OUTER JOIN {side(h3, 'country_code', 'h3', 'countries')} b USING (label)"


_Q = {
    "h1_by_author": "SELECT * FROM h1",
    "h2_by_institution": "SELECT * FROM h2",
    "h2_by_institution_field": "SELECT * FROM h2f",
    "h2_by_institution_subfield": "SELECT * FROM h2s",
    "h3_by_country": "SELECT * FROM h3",
    "h3_by_country_field": "SELECT * FROM h3f",
    "h3_by_country_subfield": "SELECT * FROM h3s",
    "h2_levels": """SELECT 'institution' AS level, institution_id, CAST(NULL AS VARCHAR) AS label, institution_name, CAST(NULL AS VARCHAR) AS label_name, h2, author_count FROM h2
        UNION ALL SELECT 'field', institution_id, field, institution_name, field_name, h2, author_count FROM h2f
        UNION ALL SELECT 'subfield', institution_id, subfield, institution_name, subfield_name, h2, author_count FROM h2s""",
    "h2_by_institution_incremental": "SELECT * FROM h2",
    "h2_by_institution_field_incremental": "SELECT * FROM h2f",
    "h2_excluding_fields": _h("authors", "institution_id, institution_name", "h_index", "h2", "author_count", f"field_name NOT IN ({_OUT})"),
    "h2_threshold": "SELECT institution_name, h2 FROM h2 WHERE institution_name = (SELECT lead_name FROM leader)",
    "staged_filter": """SELECT author_id AS id, h_index, works_count, n_affiliations, n_topics FROM h1
        JOIN (SELECT author_id, count(*) AS n_affiliations, count(*) FILTER (WHERE type = 'education') AS e FROM aff GROUP BY 1) USING (author_id)
        JOIN (SELECT author_id, count(*) AS n_topics, count(field) AS f FROM topics GROUP BY 1) USING (author_id) WHERE e > 0 AND f > 0""",
    "latest_affiliation": "SELECT inst.* FROM inst JOIN h1 USING (author_id)",
    "modal_labels": "SELECT * FROM h1 JOIN m_field USING (author_id) JOIN m_subfield USING (author_id) JOIN m_domain USING (author_id) JOIN m_topic USING (author_id)",
    "author_table": "SELECT * FROM authors",
    "canonical_names": "SELECT DISTINCT institution_id, institution_name FROM authors",
    "authors_by_field": "SELECT field_name, count(*) AS author_count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM authors GROUP BY 1",
    "country_map": "SELECT * FROM cm",
    "partition_spread_sample": f"SELECT month, count(*) AS n FROM works JOIN months USING (month) WHERE month IN ({_spread(10)}) GROUP BY 1",
    "citation_sample": f"SELECT id, cited_by_count FROM works WHERE cited_by_count > 0 AND month IN ({_spread(25)})",
    "citation_sample_first_files": f"SELECT id, cited_by_count FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY id) AS rn FROM works) WHERE rn <= 1000 AND cited_by_count > 0 AND month IN ({_spread(25)})",
    "outlier_cap": "SELECT count(*) FILTER (WHERE works_count <= 15) AS kept, count(*) FILTER (WHERE works_count > 15) AS removed, max(works_count) AS max_value FROM h1",
    "histogram_linear": _histogram(200, False),
    "histogram_log": _histogram(80, True),
    "efficiency_h2": _eff("h2", "institution_id, institution_name", "h2", "author_count", BETA_1, 10, "institution_name, institution_id", "filtered", "h2_rank"),
    "efficiency_h3": _eff("h3", "country_code", "h3", "institution_count", BETA_2, 3, "country_code", "all", "h3_rank"),
    "gini_by_field": _gini("h2f", "field_name", "h2"),
    "gini_by_source": _gini("documents", "source", "n_chars"),
    "field_leaders": f"""SELECT r.field_name, institution_name, h2, round(mean_h2, 1) AS mean_h2, round(h2 / mean_h2, 1) AS ratio, gini FROM (
        SELECT *, avg(h2) OVER (PARTITION BY field_name) AS mean_h2, row_number() OVER (PARTITION BY field_name ORDER BY h2 DESC, institution_name, institution_id) AS rn FROM h2f) r
        JOIN ({_gini("h2f", "field_name", "h2")}) g USING (field_name) WHERE rn = 1""",
    "breadth": "SELECT * FROM brd",
    "breadth_missing_fields": "SELECT institution_name, field_name, field_rank, h2 FROM fpos WHERE institution_name = (SELECT lead_name FROM leader) AND field_rank > 1",
    "strong_without_lead": "SELECT institution_id, institution_name, overall_rank, overall_h2, top10_fields, top50_fields, top100_fields FROM brd WHERE top10_fields = 0 AND overall_h2 >= 5",
    "specialization_institution": """SELECT o.institution_id, o.institution_name, overall_rank, o.h2 AS overall_h2, o.author_count AS overall_author_count, field_rank AS best_field_rank, field_name AS best_field_name,
        f.h2 AS best_field_h2, f.author_count AS best_field_author_count, overall_rank - field_rank AS specialization_index
        FROM (SELECT *, row_number() OVER (ORDER BY h2 DESC, institution_name, institution_id) AS overall_rank FROM h2) o
        JOIN (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY field_rank, h2 DESC, field_name) AS rn FROM fpos) f ON o.institution_id = f.institution_id AND rn = 1""",
    "specialization_country": """SELECT o.country_code, overall_rank, o.h3 AS overall_h3, o.institution_count, field_rank AS best_field_rank, field_name AS best_field_name, f.h3 AS best_field_h3, overall_rank - field_rank AS specialization_index
        FROM (SELECT *, row_number() OVER (ORDER BY h3 DESC, country_code) AS overall_rank FROM h3) o
        JOIN (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY field_rank, field_name) AS rn FROM (
            SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY h3 DESC, country_code) AS field_rank FROM h3f)) f ON o.country_code = f.country_code AND rn = 1""",
    "rank_change_excluding": f"""SELECT r.institution_id, r.institution_name, rest_h2, rest_author_count, rest_rank, overall_h2, overall_author_count, overall_rank, overall_rank - rest_rank AS rank_change FROM (
        SELECT *, row_number() OVER (ORDER BY rest_h2 DESC, institution_name, institution_id) AS rest_rank FROM ({_h("authors", "institution_id, institution_name", "h_index", "rest_h2", "rest_author_count", f"field_name NOT IN ({_OUT})")})) r
        JOIN (SELECT institution_id, h2 AS overall_h2, author_count AS overall_author_count, row_number() OVER (ORDER BY h2 DESC, institution_name, institution_id) AS overall_rank FROM h2) o USING (institution_id)""",
    "medals": "SELECT * FROM won",
    "medals_olympic": """SELECT field_name, country_code, h3, CASE t WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' ELSE 'bronze' END AS medal FROM (
        SELECT *, rank() OVER (PARTITION BY field_name ORDER BY h3 DESC) AS t FROM h3f) WHERE t <= 3""",
    "medal_table": f"SELECT country_code, count(*) FILTER (WHERE medal = 'gold') AS gold, count(*) FILTER (WHERE medal = 'silver') AS silver, count(*) FILTER (WHERE medal = 'bronze') AS bronze, {_fields('gold')}, {_fields('silver')}, {_fields('bronze')} FROM won GROUP BY 1",
    "tied_golds": "SELECT field_name, count(*) AS golds, string_agg(country_code, '; ' ORDER BY country_code) AS countries FROM won WHERE medal = 'gold' GROUP BY 1 HAVING count(*) > 1",
    "best_efficiency_institution_by_field": _best("h2f", "institution_id, institution_name", "h2", "author_count", BETA_1, 3, "institution_name, institution_id"),
    "best_efficiency_country_by_field": _best("h3f", "country_code", "h3", "institution_count", BETA_2, 2, "country_code"),
    "institution_ranks": " UNION ALL ".join([_ranks("overall", "h2", "institution_name", "lead_name FROM leader", "h2", "author_count", None), _ranks("field", "h2f", "institution_name", "lead_name FROM leader", "h2", "author_count", "field_name"), _ranks("subfield", "h2s", "institution_name", "lead_name FROM leader", "h2", "author_count", "subfield_name")]),
    "country_ranks": " UNION ALL ".join([_ranks("overall", "h3", "country_code", "lead_code FROM lead_c", "h3", "institution_count", None), _ranks("field", "h3f", "country_code", "lead_code FROM lead_c", "h3", "institution_count", "field_name"), _ranks("subfield", "h3s", "country_code", "lead_code FROM lead_c", "h3", "institution_count", "subfield_name")]),
    "tail_fit": f"""SELECT c.label, xmin, max(CAST(n_tail AS BIGINT)) AS n_tail, round(max(alpha), 6) AS alpha, round(max(abs(t.n / n_tail - {zeta_sql('alpha', 't.x')} / {zeta_sql('alpha', 'xmin')})), 6) AS ks
        FROM every_cand c JOIN every_tails t ON c.label = t.label AND t.x >= xmin GROUP BY ALL""",
    "tail_fit_best": "SELECT label, round(alpha, 6) AS alpha, xmin, n_tail, n_total, round(d_ks, 6) AS d_ks, round(r_exp, 4) AS r_exp FROM every_best_fits",
    # halving the interval in which the slope of the likelihood changes its sign; the error by a difference of slopes
    "tail_fit_exact": f"""WITH RECURSIVE f AS (SELECT label, xmin, n_tail, s / n AS m FROM best_fits JOIN (SELECT label AS l, x, n, s FROM tails) ON l = label AND x = xmin),
        it AS (SELECT *, CAST(1.0001 AS DOUBLE) AS a, CAST(60 AS DOUBLE) AS b, 0 AS k FROM f
            UNION ALL SELECT label, xmin, n_tail, m, CASE WHEN g < 0 THEN mid ELSE a END, CASE WHEN g < 0 THEN b ELSE mid END, k + 1 FROM (
                SELECT *, {zeta_slope_sql("mid", "xmin")} / {zeta_sql("mid", "xmin")} + m AS g FROM (SELECT *, (a + b) / 2 AS mid FROM it)) WHERE k < 50),
        done AS (SELECT label, xmin, n_tail, a AS alpha, a - 1e-4 AS lo, a + 1e-4 AS hi FROM it WHERE k = 50)
        SELECT label, xmin, n_tail, round(alpha, 6) AS alpha, round(1 / sqrt(n_tail * ({zeta_slope_sql("hi", "xmin")} / {zeta_sql("hi", "xmin")} - {zeta_slope_sql("lo", "xmin")} / {zeta_sql("lo", "xmin")}) / 2e-4), 6) AS alpha_se FROM done""",
    "tail_fit_summary": f"""SELECT round(alpha_0, 4) AS alpha_0, round(alpha_1, 4) AS alpha_1, round(alpha_2, 4) AS alpha_2, round(beta_1, 4) AS beta_1, round(beta_2, 4) AS beta_2, verdicts,
        round(beta_1 / alpha_1, 4) AS alpha_0_from_beta1, round(beta_2 / (alpha_1 * alpha_2), 4) AS alpha_0_from_beta2, round(beta_1 * alpha_2, 4) AS beta_2_predicted,
        round(100 * (beta_2 - beta_1 * alpha_2) / (beta_1 * alpha_2), 4) AS beta_2_deviation, CAST({WORKS_CAP} AS BIGINT) AS works_cap, (SELECT count(*) FROM h1 WHERE works_count > {WORKS_CAP}) AS works_cap_excluded FROM (
        SELECT max(alpha) FILTER (WHERE label = 'citations') AS alpha_0, max(alpha) FILTER (WHERE label = 'authors_size') AS alpha_1, max(alpha) FILTER (WHERE label = 'institutions_size') AS alpha_2,
            max(alpha) FILTER (WHERE label = 'authors') AS beta_1, max(alpha) FILTER (WHERE label = 'institutions') AS beta_2,
            coalesce(string_agg(label || ': ' || CASE WHEN abs(r_exp) <= 1.959963984540054 THEN 'neither' WHEN r_exp > 0 THEN 'power law' ELSE 'exponential' END || ' is favored', '; ' ORDER BY label || ': '), '') AS verdicts FROM best_fits)""",
    "efficiency_by_fitted_exponent": "SELECT *, (SELECT beta FROM beta_fit) AS beta FROM (" + _eff("h2", "institution_id, institution_name", "h2", "author_count", "(SELECT beta FROM beta_fit)", 10, "institution_name, institution_id", "filtered", "h2_rank") + ")",
    "subsample": "SELECT work_id, citations FROM papers ORDER BY md5('42:' || work_id), work_id LIMIT 5000",
    "fit_origin_h2": f"SELECT round(sum(x * h2) / sum(x * x), 6) AS slope, round(1 - (sum(h2 * h2) - sum(x * h2) / sum(x * x) * sum(x * h2)) / sum(h2 * h2), 6) AS r2, count(*) AS n FROM (SELECT h2, pow(author_count, 1 / {BETA_1}) AS x FROM h2 WHERE author_count >= 10)",
    "fit_origin_h3": f"SELECT round(sum(x * h3) / sum(x * x), 6) AS slope, round(1 - (sum(h3 * h3) - sum(x * h3) / sum(x * x) * sum(x * h3)) / sum(h3 * h3), 6) AS r2, count(*) AS n FROM (SELECT h3, pow(institution_count, 1 / {BETA_2}) AS x FROM h3 WHERE institution_count >= 2)",
    "fit_ols_h3": "SELECT nullif(round(regr_slope(h3, sqrt(institution_count)), 6), CAST('NaN' AS DOUBLE)) AS slope, round(regr_intercept(h3, sqrt(institution_count)), 6) AS intercept, round(regr_r2(h3, sqrt(institution_count)), 6) AS r2, count(*) AS n FROM h3",
    "choropleth_table": """SELECT n_name AS country_code, upper(n_name[1]) || lower(n_name[2:]) AS country_name, h3, institution_count, h3 IS NOT NULL AS has_data,
        round(CASE WHEN b > a THEN (ln(1 + h3) - a) / (b - a) WHEN h3 IS NOT NULL THEN 0.0 END, 6) AS normalized_log
        FROM nation LEFT JOIN (SELECT * FROM h3 WHERE institution_count >= 2) ON n_name = country_code, (SELECT min(ln(1 + h3)) AS a, max(ln(1 + h3)) AS b FROM h3 WHERE institution_count >= 2)""",
    "outlier_cutoffs": "SELECT CAST(cutoff AS BIGINT) AS cutoff, count(*) FILTER (WHERE works_count > cutoff) AS above, count(*) AS total, round(count(*) FILTER (WHERE works_count > cutoff) / count(*), 6) AS share FROM h1, (SELECT unnest([5, 10, 15, 20]) AS cutoff) GROUP BY 1",
    "validation_sample": "SELECT * FROM val",
    "validation_enriched": "SELECT bucket, institution, field, name, val.author_id, orcid, reason, affiliation_text, h_index_local, h_index_external FROM val LEFT JOIN prof USING (author_id)",
    "agreement": """SELECT source, count(*) AS n_covered, round(avg(d), 4) AS mean_difference, round(avg(abs(d)), 4) AS mean_abs_difference, arg_min(name, (-abs(d), name)) AS worst_case, CAST(max(abs(d)) AS DOUBLE) AS worst_abs_difference
        FROM (SELECT 'source ' || (author_id % 3) AS source, name, h_index_external - h_index AS d FROM h1 JOIN prof USING (author_id)) GROUP BY 1""",
    "price_percentiles": """SELECT q, round(v, 4) AS value FROM (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.9, 0.99])::DOUBLE AS q,
        unnest(quantile_cont(CAST(o_totalprice AS DOUBLE), [0.01, 0.25, 0.5, 0.75, 0.9, 0.99])) AS v FROM orders)""",
    "author_positions": "SELECT author_id, h_index, row_number() OVER (ORDER BY h_index DESC, author_id) AS place FROM authors",
    "topk_per_field": "SELECT field_name, rk AS rank, institution_name, h2 FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY h2 DESC, institution_name, institution_id) AS rk FROM h2f) WHERE rk <= 10",
    "topk_documents_per_lang": "SELECT doc_id, lang, n_chars, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rk FROM documents) WHERE rk <= 10",
    "rankings_document": " UNION ALL ".join([_document("overall", "h2", "h3", None, ""), _document("field", "h2f", "h3f", "field_name", "WHERE rk <= 100"), _document("subfield", "h2s", "h3s", "subfield_name", "WHERE rk <= 100")]),
    "label_slugs": r"SELECT DISTINCT p_name AS label, trim(regexp_replace(p_name || ', ' || p_type, '[^\w\-]', '_', 'g'), '_') AS slug FROM part",
    "country_codes_by_prefix": "SELECT country_code, count(DISTINCT id) AS institutions FROM cm WHERE starts_with(upper(country_code), 'NATION_1') GROUP BY 1",
    "incremental_ingest": """SELECT CASE WHEN author_id % 2 = 0 THEN DATE '2024-01-01' ELSE DATE '2024-01-02' END AS updated_date, count(*) AS n_rows, '' AS missing FROM h1
        WHERE author_id IN (SELECT author_id FROM aff WHERE type = 'education') AND author_id IN (SELECT author_id FROM topics) GROUP BY 1""",
    "split_sink": r"SELECT trim(regexp_replace(field_name, '[^\w\-]', '_', 'g'), '_') AS slug, count(*) AS n, CAST(sum(h2) AS BIGINT) AS h2_sum, CAST(sum(author_count) AS BIGINT) AS author_sum FROM h2f GROUP BY 1",
    "country_names": "SELECT country_code, coalesce(upper(n_name[1]) || lower(n_name[2:]), country_code) AS country_name, h3 FROM h3 LEFT JOIN nation ON n_name = country_code AND n_nationkey % 5 <> 0",
    "compaction": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS value_sum FROM events GROUP BY 1",
    "compaction_by_size": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS value_sum, true AS packed FROM events GROUP BY 1",
    "quality_report": """SELECT 'quantile' AS "check", 'p' || q AS item, CAST(round(v, 4) AS VARCHAR) AS value FROM (
            SELECT unnest([25, 50, 75, 90, 99]) AS q, unnest(quantile_cont(CAST(h2 AS DOUBLE), [0.25, 0.5, 0.75, 0.9, 0.99])) AS v FROM h2f)
        UNION ALL SELECT 'quantile', 'min', CAST(CAST(min(h2) AS DOUBLE) AS VARCHAR) FROM h2f UNION ALL SELECT 'quantile', 'max', CAST(CAST(max(h2) AS DOUBLE) AS VARCHAR) FROM h2f
        UNION ALL SELECT 'small groups', 'share', CAST(round(count(*) FILTER (WHERE author_count < 10) / count(*), 4) AS VARCHAR) FROM h2f
        UNION ALL SELECT 'maximum', 'verdict', CASE WHEN max(h2) > 200 THEN 'implausible: above 200' WHEN max(h2) < 5 THEN 'implausible: below 5' ELSE 'plausible' END FROM h2f
        UNION ALL SELECT 'subfields', 'distinct', CAST(CAST(count(DISTINCT subfield) AS DOUBLE) AS VARCHAR) FROM h2s
        UNION ALL SELECT * FROM (SELECT 'top', institution_name || ' / ' || field_name, CAST(CAST(h2 AS DOUBLE) AS VARCHAR) FROM h2f ORDER BY h2 DESC, institution_name, institution_id, field LIMIT 5)
        UNION ALL SELECT * FROM (SELECT 'top in subfield', institution_name || ' / ' || subfield_name, CAST(CAST(h2 AS DOUBLE) AS VARCHAR) FROM h2s ORDER BY h2 DESC, institution_name, institution_id, subfield LIMIT 5)
        UNION ALL SELECT 'spot check', institution_name || ' / ' || field_name, CAST(CAST(h2 AS DOUBLE) AS VARCHAR) FROM (
            SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY h2 DESC, field) AS rn FROM h2f WHERE institution_name ILIKE '%#00000001%' OR institution_name ILIKE '%#00000003%') WHERE rn <= 5""",
}
_COLUMNS = {"modal_labels": "author_id, field, field_name, subfield, subfield_name, domain, domain_name, topic, topic_name"}

ORACLE_SQL = {k: _with(v.replace("SELECT *", f"SELECT {_COLUMNS[k]}", 1) if k in _COLUMNS else v) for k, v in _Q.items()}
