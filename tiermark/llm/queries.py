"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermark.llm import filter_audit, fingerprints, lexical, licenses, line_dedup, mixing, pieces, simhash, suffix_dedup, token_files, topk, toxicity, warc
from tiermark.llm.common import ship, table


def tokenizer_path(name: str) -> str:
    from public_tokenizers import path

    return path(name)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Trained on the labelled rows of docs outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    return toxicity.fit_toxicity(docs, labels)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = toxicity.toxicity_score(docs, toxicity_model(spark, docs, sf_dir))
    scored = docs.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/language/hundred/id.txt; the first of a hundred is its directory's LICENSE, the second of
    each thousand that of its language's directory."""
    folder = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    low = F.concat_ws("/", folder, F.floor(F.col("doc_id") / 100).cast("string"))
    path = F.when(F.col("doc_id") % 1000 == 1, F.concat_ws("/", folder, F.concat(F.lit("LICENSE-"), F.col("doc_id")))).when(F.col("doc_id") % 100 == 0, F.concat_ws("/", low, F.lit("LICENSE")))
    return docs.select("doc_id", path.otherwise(F.concat(low, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(document_paths(table(spark, sf_dir, "documents")), keep=("doc_id",))
    return found.select("doc_id", "path", "license", "origin", "from_dir", F.round("similarity", 6).alias("similarity"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, plan = mixing.mix_sources(docs)
    sources = spark.createDataFrame([(k, plan.sizes[p[0]], float(plan.targets[p[0]])) for k, p in enumerate(plan.patterns)], "pattern int, source_size bigint, target double")
    return rows.join(sources, "pattern").select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pieces.piece_digests(tokenizer_path("piece_bpe_32k.model")).alias("p")).select("doc_id", "p.*")  # differing and whole_agrees tell of the check against the library


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_offsets(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = [op1_toxicity, op2_simhash, op3_warc, op4_licenses, op5_top_k, op6_mixing, op7_pieces, op8_line_dedup, op9_token_files, op10_fingerprints, op11_filter_audit, op12_lexical, op13_suffix_dedup, pipeline]
    return {f.__name__: _shipped(f) for f in found}


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        f AS (SELECT body, min(page_id) AS first_id FROM p GROUP BY body)
        SELECT page_id, CAST(strlen(p.body) AS BIGINT) AS payload_bytes, s.b32 AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p JOIN f USING (body) JOIN (
            SELECT body, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v AS INTEGER) + 1, 1), '' ORDER BY k) AS b32
            FROM (SELECT body, k, list_sum([CASE WHEN substr(bits, 5 * k + j + 1, 1) = '1' THEN 1 << (4 - j) ELSE 0 END FOR j IN [0, 1, 2, 3, 4]]) AS v
                  FROM (SELECT DISTINCT body, array_to_string([lpad(bin(instr('0123456789abcdef', substr(sha1(body), i, 1)) - 1), 4, '0') FOR i IN range(1, 41)], '') AS bits FROM p), range(32) AS r(k))
            GROUP BY body) s USING (body)""",
    "op8_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
        k AS (SELECT *, translate(trim(line, {_BLANKS}), {_UPPER}) AS key FROM l),
        c AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        d AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> owner AS dropped FROM k LEFT JOIN c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM d GROUP BY doc_id""",
    "op11_filter_audit": r"""
        WITH w AS (SELECT doc_id, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
        f AS (SELECT doc_id, coalesce(source, '') AS part,
                CASE WHEN len(l) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(l)) < 50 * len(l) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS failed FROM w),
        c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS bad FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL),
        one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM one a, one b, one c, one d, one e
              WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS early FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
        r AS (SELECT part, filter_order, step, own, n, good, bad, failed, contains(failed, own) AS fails, regexp_matches(failed, CASE WHEN early = '' THEN '[^A-Z]' ELSE '[' || early || ']' END) AS gone FROM c, s)
        SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS removed,
               CAST(coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE failed = own), 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
               CAST(sum(coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM r GROUP BY part, filter_order, step, own""",
    "op12_lexical": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents WHERE text IS NOT NULL),
        d AS (SELECT doc_id, len(l) AS n, l FROM t WHERE len(l) > 0),
        g AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
        tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(l) AS term FROM d) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term, big_n),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
        s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term), g GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
    "op5_top_k": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a * b FOR a, b IN list_zip(q.v, c.v)]) AS BIGINT) AS score FROM e q, e c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
}
ORACLE["op5_top_k"] = ORACLE["op5_top_k"].replace("list_sum([a * b FOR a, b IN list_zip(q.v, c.v)])", "list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[]))")


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
