"""Hand fixtures, properties, and every registered query against its SQL."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tiermark.operators import assign, hindex, metrics, rank, tailfit, validate
from tiermark.plans import registry
from tiermark.sources import snapshots


def h(spark, values, **kw):
    df = spark.createDataFrame([("g", v) for v in values], "k string, v bigint")
    return [(r["h"], r["n"]) for r in hindex.h_index(df, ["k"], "v", **kw).collect()]


@pytest.mark.parametrize("values, want", [([5, 4, 3, 2, 1], (3, 5)), ([4, 4, 4, 4], (4, 4)), ([100, 100], (2, 2)), ([1], (1, 1)), ([None, 3, 3, 3], (3, 4)), ([0, 1], (1, 2))])
def test_h(spark, values, want):
    assert h(spark, values) == [want]


def test_h_zero(spark):
    assert h(spark, [0, 0]) == [] and h(spark, [None]) == []
    assert h(spark, [0, 0], keep_zero=True) == [(0, 2)]
    assert h(spark, []) == []


def test_h_properties(spark):
    rng, groups = random.Random(4), {}
    for g in range(60):
        groups[g] = [rng.choice([None, *range(12), 40]) if g % 3 else rng.randrange(30) for _ in range(rng.randrange(1, 40))]
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(rows)

    def plain(vs):
        ranked = sorted((v for v in vs if v is not None), reverse=True)
        return max((i for i, v in enumerate(ranked, 1) if v >= i), default=0)

    for n in (3, 17):
        got = {r["k"]: (r["h"], r["n"]) for r in hindex.h_index(spark.createDataFrame(rows, "k int, v bigint").repartition(n), ["k"], "v", keep_zero=True).collect()}
        assert got == {g: (plain(vs), len(vs)) for g, vs in groups.items()}
    for g, (value, n) in got.items():
        assert value <= n and value <= max([v or 0 for v in groups[g]])
        assert plain(groups[g] + [50]) >= value


STAGED = "id string, h_index bigint, works_count bigint, affiliations array<struct<institution: struct<id: string, display_name: string, type: string>, years: array<int>>>, topics array<struct<id: string, display_name: string, count: bigint, subfield: struct<id: string, display_name: string>, field: struct<id: string, display_name: string>, domain: struct<id: string, display_name: string>>>, updated_date string"


def _aff(i, years, kind="education", name=None):
    return ((i, name or i, kind), years)


def _topic(i, count, field, subfield=None, domain="d"):
    label = lambda x: (x, x)
    return (i, i, count, label(subfield), label(field), label(domain))


@pytest.fixture(scope="module")
def staged(spark):
    rows = [
        ("a", 3, 9, [_aff("i2", [2001, 2003]), _aff("i1", [2003], name="A"), _aff("i0", [])], [_topic("t1", 3, "f1"), _topic("t2", 2, "f1"), _topic("t3", 5, "f2", "s9")], "2024-01-01"),
        ("b", 2, 9, [_aff("i1", [1999], "company")], [_topic("t1", 1, "f1")], "2024-01-01"),
        ("c", 2, 9, [_aff("i1", [1999], name="A")], [_topic("t1", 1, None)], "2024-01-01"),
        ("d", 0, 9, [_aff("i1", [1999])], [_topic("t1", 1, "f1")], "2024-01-01"),
        ("e", 4, 9, [_aff("i1", None, name="a"), _aff("i1", None, "company")], [_topic("t1", 4, "f1", "s1"), _topic("t9", 3, "f2", "s2"), _topic("t8", 3, "f2", "s3")], "2024-01-01"),
        ("f", 4, 9, [_aff("i1", [2000], name="A")], [_topic("t1", 1, "f1")], "2024-01-01"),
        ("f", 7, 11, [_aff("i1", [2000], name="A")], [_topic("t1", 1, "f1")], "2024-01-02"),
        ("g", 1, 1, None, None, "2024-01-01"),
    ]
    return spark.createDataFrame(rows, STAGED)


def test_author_table(staged):
    got = {r["author_id"]: r for r in assign.build_authors(staged, version="updated_date").collect()}
    assert set(got) == {"a", "e", "f"}
    assert got["a"]["institution_id"] == "i1" and got["a"]["field"] == "f1" and got["a"]["subfield"] == "s9"
    assert got["e"]["field"] == "f2" and got["e"]["subfield"] == "s1"
    assert got["f"]["subfield"] is None and got["f"]["h_index"] == 7
    assert {r["institution_name"] for r in got.values()} == {"A"}


def test_latest_affiliation_puts_missing_years_last(staged):
    got = {r["author_id"]: (r["institution_id"], r["latest_year"]) for r in assign.latest_affiliation(staged.where("updated_date = '2024-01-01'")).collect()}
    assert got["a"] == ("i1", 2003) and got["e"] == ("i1", None) and "b" not in got


def test_exclusion_drops_missing_labels(spark):
    df = spark.createDataFrame([("g", 5, None), ("g", 5, "bio"), ("g", 5, "other")], "k string, v bigint, label string")
    assert [tuple(r) for r in hindex.h_index_excluding(df, ["k"], "v", "label", ["bio"]).collect()] == [("g", 1, 1)]


def test_medals(spark):
    df = spark.createDataFrame([("f", c, v) for c, v in zip("ABCDE", (9, 9, 7, 5, 4))], "field_name string, country_code string, h3 bigint")
    assert {r["country_code"]: r["medal"] for r in metrics.medals(df).collect()} == {"A": "gold", "B": "gold", "C": "silver", "D": "bronze"}
    assert {r["country_code"]: r["medal"] for r in metrics.medals(df, "olympic").collect()} == {"A": "gold", "B": "gold", "C": "bronze"}
    assert [tuple(r) for r in metrics.tied_golds(metrics.medals(df)).collect()] == [("f", 2, "A; B")]
    won = spark.createDataFrame([("f1", "X", 1, "gold"), *[(f"f{k}", "Y", 1, m) for k in range(5) for m in ("silver", "bronze")]], "field_name string, country_code string, h3 bigint, medal string")
    assert [r["country_code"] for r in metrics.medal_table(won).orderBy(F.desc("gold"), F.desc("silver"), F.desc("bronze")).collect()] == ["X", "Y"]


@pytest.mark.parametrize("values, want", [([1, 1, 1, 1], 0.0), ([0, 0, 0, 4], 0.75), ([5], 0.0), ([0, 0], None)])
def test_gini(spark, values, want):
    df = spark.createDataFrame([("g", v) for v in values], "k string, v bigint")
    assert metrics.gini(df, ["k"], "v").first()["gini"] == want


def test_breadth_and_positions(spark):
    rows = [("me", "me", f"f{k}", f"f{k}", 1000 - place, 1) for k, place in enumerate((1, 10, 11, 50, 101))]
    for k, place in enumerate((1, 10, 11, 50, 101)):
        rows += [(f"o{k}-{j}", f"o{k}-{j}", f"f{k}", f"f{k}", 1000 - j, 1) for j in range(1, 120) if j != place]
    df = spark.createDataFrame(rows, "institution_id string, institution_name string, field string, field_name string, h2 bigint, author_count bigint")
    overall = hindex.h_index(df, ["institution_id"], "h2", ["institution_name"], "h2", "author_count")
    me = metrics.breadth(df, overall).where("institution_id = 'me'").first()
    assert (me["top10_fields"], me["top50_fields"], me["top100_fields"], me["total_fields"]) == (2, 4, 4, 5)
    places = rank.position(df.where("field = 'f0'"), "h2", ["institution_name"], "place", bucket=F.floor(F.col("h2") / 7)).collect()
    assert [r["institution_id"] for r in sorted(places, key=lambda r: r["place"])][:2] == ["me", "o0-2"] and sorted(r["place"] for r in places) == list(range(1, 120))


def test_efficiency_scopes(spark):
    df = spark.createDataFrame([("A", 9, 10), ("B", 8, 1), ("C", 8, 64)], "c string, h bigint, n bigint")
    rows = {s: {r["c"]: r for r in metrics.efficiency(df, ["c"], "h", "n", 3.0, 5, s, ["c"], "h_rank").collect()} for s in ("all", "filtered")}
    assert rows["all"]["C"]["efficiency"] == 2.0
    assert (rows["all"]["C"]["h_rank"], rows["filtered"]["C"]["h_rank"]) == (3, 2)
    with pytest.raises(ValueError):
        metrics.efficiency(df, ["c"], "h", "n", 3.0, 5, "none", ["c"], "h_rank")


def test_fits(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    assert tuple(metrics.fit_origin(df, "x", "y", 1.0).first()) == (2.0, 1.0, 3)
    line = spark.createDataFrame([(float(k * k), 3.0 * k + 1) for k in range(1, 6)], "x double, y double")
    assert tuple(metrics.fit_ols_sqrt(line, "x", "y").first()) == (3.0, 1.0, 1.0, 5)
    assert metrics.fit_origin(df.limit(0), "x", "y", 1.0).first()["n"] == 0


def test_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 5, 10, 10)], "v bigint")
    assert [(r["bin"], r["n"]) for r in metrics.histogram(df, "v", 2).orderBy("bin").collect()] == [(0, 2), (1, 3)]
    assert sum(r["n"] for r in metrics.histogram(df, "v", 3, log=True).collect()) == 4
    assert metrics.histogram(df.where("v = 10"), "v", 4).collect()[0]["n"] == 2


def test_look_ups(spark):
    df = spark.createDataFrame([("Alpha College", 3, 5), ("Beta_1", 2, 4), ("Beta 1 North", 2, 4)], "institution_name string, h2 bigint, author_count bigint")
    assert rank.resolve_one(df, "institution_name", "alpha") == "Alpha College"
    assert rank.resolve_one(df, "institution_name", "beta_1") == "Beta_1"
    for wanted in ("zzz", "Beta"):
        with pytest.raises(ValueError, match="candidates"):
            rank.resolve_one(df, "institution_name", wanted)
    codes = spark.createDataFrame([("NA", 1)], "country_code string, h3 bigint")
    assert rank.resolve_one(codes, "country_code", "na", exact=True) == "NA"
    with pytest.raises(ValueError, match="NA"):
        rank.resolve_one(codes, "country_code", "NX", exact=True)
    ranked = rank.rank_of(df.drop("author_count"), "h2").collect()
    assert sorted((r["institution_name"], r["rank"], r["total"]) for r in ranked) == [("Alpha College", 1, 3), ("Beta 1 North", 2, 3), ("Beta_1", 2, 3)]


def test_power_law_tail(spark):
    rng = random.Random(8)
    alpha, xmin, n = 2.5, 6, 40_000
    draws = [math.floor((xmin - 0.5) * (1 - rng.random()) ** (-1 / (alpha - 1)) + 0.5) for _ in range(n)]
    geometric = [int(math.log(1 - rng.random()) / math.log(0.8)) + 1 for _ in range(n)]
    df = spark.createDataFrame([("power", v) for v in draws] + [("few", 3)] * 10, "label string, v bigint")
    (fit,) = tailfit.fit_tail(df, ["label"], "v").collect()
    assert abs(fit["alpha"] - alpha) < 3 * (alpha - 1) / math.sqrt(fit["n_tail"]) + 0.02 and fit["r_exp"] > 0 and fit["p_exp"] < 0.01
    (other,) = tailfit.fit_tail(spark.createDataFrame([("g", v) for v in geometric], "label string, v bigint"), ["label"], "v", xmin=1).collect()
    assert other["r_exp"] < 0 and other["xmin"] == 1


def test_subsample(spark):
    df = spark.range(1000)
    one = sorted(r[0] for r in tailfit.subsample(df, "id", 100).collect())
    assert len(one) == 100 and one == sorted(r[0] for r in tailfit.subsample(df.repartition(7), "id", 100).collect())
    assert tailfit.subsample(df, "id", 5000).count() == 1000


def test_agreement(spark):
    df = spark.createDataFrame([("s", "x", 5, 7), ("s", "y", 5, 3), ("s", "z", 5, None)], "source string, name string, own bigint, other bigint")
    assert tuple(validate.agreement(df, "source", "name", "own", "other").first()) == ("s", 2, 0.0, 2.0, "x", 2.0)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    import glob
    import os

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.QUERIES[name](spark, sf)
    cell = lambda v: round(v, 9) if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else v
    got = [tuple(map(cell, r)) for r in df.select(*sorted(df.columns)).collect()]
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(cell(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["tail_fit_best", "tail_fit_summary", "efficiency_by_fitted_exponent"])
def test_queries_without_sql(spark, sf, name):
    if name.startswith("efficiency"):
        sf = "/root/testdata/sf0.01"  # the smallest tables have no institution of ten authors
    assert registry.QUERIES[name](spark, sf).count() >= 1


def test_spread_places():
    assert snapshots.spread_places(10, 4) == [0, 3, 6, 9]
    assert snapshots.spread_places(3, 5) == [0, 1, 2]
    assert snapshots.spread_places(7, 1) == [0]
