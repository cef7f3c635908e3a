"""Operators that a hot value or many distinct values must not slow down, against plain versions."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tiermark.functions.special import zeta_and_slopes, zeta_slope_sql, zeta_sql
from tiermark.operators import rank, tailfit, validate


def _tail(rng, alpha, xmin, n):
    """Draws of a discrete power law by inversion, by and large."""
    return [math.floor((xmin - 0.5) * (1 - rng.random()) ** (-1 / (alpha - 1)) + 0.5) for _ in range(n)]


def test_branch_and_bound_equals_the_full_scan(spark):
    rng, rows = random.Random(5), []
    for key in range(6):
        rows += [(str(key), v) for v in _tail(rng, 1.6 + 0.3 * key, 1 + 3 * key, 1500)] + [(str(key), rng.randint(1, 40)) for _ in range(200 * key)]
    rows += [("flat", v) for v in range(1, 200)] + [("two", 1), ("two", 2), ("one", 5), ("zero", 0)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(3)
    whole = {}
    for r in tailfit.tail_candidates(df, ["k"], "v").collect():
        whole[r["k"]] = min(whole.get(r["k"], (9.0, 0, 0)), (round(r["ks"], 9), r["xmin"], r["n_tail"]))
    best = tailfit.best_candidates(df, ["k"], "v").collect()
    assert {r["k"]: (round(r["ks"], 9), r["xmin"], r["n_tail"]) for r in best} == whole and "one" not in whole and "two" in whole
    counts = {k: len({v for key, v in rows if key == k and v > 0}) for k in whole}
    assert all(r["all_pairs"] == counts[r["k"]] * (counts[r["k"]] + 1) // 2 - 1 for r in best)


def test_most_pairs_are_not_worked_out(spark):
    """50,000 distinct values: 1.25 billion pairs in full."""
    heavy = spark.range(1, 50_001).select(F.lit("g").alias("k"), (F.lit(50.0) * F.pow(F.lit(50_001.0) / F.col("id"), F.lit(0.9))).cast("bigint").alias("v"))
    distinct = spark.range(1, 50_001).select(F.lit("g").alias("k"), (F.col("id") * 3).alias("v"))
    one = tailfit.best_candidates(heavy.unionByName(distinct), ["k"], "v").first()
    assert one["all_pairs"] > 1.2e9 and one["pairs"] < one["all_pairs"] / 20
    print(f"pairs worked out: {one['pairs']} of {one['all_pairs']}")


def test_zeta_slopes(spark):
    """Against differences of the plain sum, and the two ways against each other."""
    for s, q in ((1.5, 1.0), (2.5, 1.0), (3.5, 7.0), (2.0, 40.0)):
        row = spark.range(1).select(zeta_and_slopes(F.lit(s), F.lit(q)).alias("z"), F.expr(zeta_sql(f"{s}D", f"{q}D")).alias("a"), *[F.expr(zeta_slope_sql(f"{s + d:.6f}D", f"{q}D")).alias(n) for n, d in (("b", 0.0), ("b1", 1e-5), ("b0", -1e-5))]).first()
        z, z1, z2 = row["z"]
        unit, log = q**-s, math.log(q)  # derivatives of q^s zeta(s, q) to those of zeta(s, q)
        assert z * unit == pytest.approx(row["a"], rel=1e-12) and (z1 - log * z) * unit == pytest.approx(row["b"], rel=1e-11)
        assert (z2 - 2 * log * z1 + log * log * z) * unit == pytest.approx((row["b1"] - row["b0"]) / 2e-5, rel=1e-6)
    six = spark.range(1).select(zeta_and_slopes(F.lit(2.0), F.lit(1.0)).alias("z")).first()["z"]
    assert six["z"] == pytest.approx(math.pi**2 / 6, rel=1e-13) and six["z1"] == pytest.approx(-0.9375482543158438, rel=1e-12)


def test_exact_exponents(spark):
    """Draws of known exponents at xmin 1 lie within three standard errors, which the closed form does not reach."""
    rng, rows, alphas = random.Random(11), [], (1.5, 2.0, 2.5, 3.0, 3.5)
    for a in alphas:
        weights, top = [k**-a for k in range(1, 20_001)], 20_001
        rest = (top - 0.5) ** (1 - a) / (a - 1)
        for v in rng.choices(range(1, top + 1), [*weights, rest], k=8000):
            rows.append((str(a), v if v < top else math.floor((top - 0.5) * (1 - rng.random()) ** (-1 / (a - 1)) + 0.5)))
    rows += [("same", 4)] * 60
    df = spark.createDataFrame(rows, "k string, v bigint")
    fits = df.select("k", F.when(F.col("k") == "same", 4).otherwise(1).cast("bigint").alias("xmin")).distinct()
    got = {r["k"]: r for r in tailfit.exact_exponents(df, fits, ["k"], "v").collect()}
    closed = {r["k"]: r["alpha"] for r in tailfit.tail_candidates(df.where("k <> 'same'"), ["k"], "v", xmin=1).collect()}
    for a in alphas:
        assert abs(got[str(a)]["alpha"] - a) < 3 * got[str(a)]["alpha_se"] < 0.15 and got[str(a)]["n_tail"] == 8000
    assert abs(closed["3.5"] - 3.5) > 5 * got["3.5"]["alpha_se"]
    assert got["same"]["alpha"] is None and got["same"]["n_tail"] == 60


def test_verdicts(spark):
    rows = [("a", 3.0, 0.01), ("b", -3.0, 0.01), ("c", 0.5, 0.6), ("d", 1.9, 0.05), ("e", 0.0, 0.0)]
    got = dict(spark.createDataFrame(rows, "k string, r_exp double, p_exp double").select("k", tailfit.verdict()).collect())
    assert got == {"a": "power law is favored", "b": "exponential is favored", "c": "neither is favored", "d": "neither is favored", "e": "neither is favored"}


def test_summary(spark):
    fits = spark.createDataFrame([("citations", 2.5, 1.0, 0.5), ("authors_size", 3.0, 4.0, 0.001), ("institutions_size", 2.0, 0.0, 1.0), ("authors", 6.0, -4.0, 0.001), ("institutions", 9.0, 0.0, 1.0)], "label string, alpha double, r_exp double, p_exp double")
    one = tailfit.fit_summary(fits, spark.createDataFrame([(90, 10, 77)], "kept bigint, removed bigint, max_value bigint"), 50).first()
    assert (one["alpha_0"], one["alpha_1"], one["alpha_2"], one["beta_1"], one["beta_2"]) == (2.5, 3.0, 2.0, 6.0, 9.0)
    assert (one["alpha_0_from_beta1"], one["alpha_0_from_beta2"], one["beta_2_predicted"], one["beta_2_deviation"]) == (2.0, 1.5, 12.0, -25.0)
    assert (one["works_cap"], one["works_cap_excluded"]) == (50, 10) and "authors: exponential is favored" in one["verdicts"]


def test_positions_of_one_hot_value(spark):
    """One value in nine of ten rows; no range has more than its share of the rows."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("v")).unionByName(spark.createDataFrame([(-1, None), (-2, None)], "id bigint, v bigint"))
    out = rank.position_by_range(df.repartition(5), "v", ["id"], "place", parts=8)
    rows = out.collect()
    want = sorted(((i, i if i % 10 == 0 else 7) for i in range(20_000)), key=lambda r: (-r[1], r[0])) + [(-2, None), (-1, None)]
    assert [(r["id"], r["v"]) for r in sorted(rows, key=lambda r: r["place"])] == want and [r["place"] for r in sorted(rows, key=lambda r: r["place"])] == list(range(1, 20_003))
    shares = [r[0] for r in df.repartitionByRange(8, F.col("v").desc_nulls_last(), "id").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(shares) < 2 * len(rows) / 8
    assert rank.position_by_range(df.limit(0), "v", ["id"], "place").isEmpty()


@pytest.mark.parametrize("small", [5, 100_000])
def test_exact_percentiles(spark, small):
    rng, qs = random.Random(3), [0.0, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]
    sets = {"normal": [rng.gauss(0, 1) for _ in range(3000)], "ties": [float(rng.choice([1, 1, 1, 2, 9])) for _ in range(500)], "wide": [10 ** rng.uniform(-300, 300) for _ in range(400)], "one": [4.5], "same": [2.0] * 60}
    for values in sets.values():
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "x double")
        got = dict(validate.exact_percentiles(df, "x", qs, bins=16, small=small).collect())
        ordered = sorted(values)
        for q in qs:
            k = q * (len(values) - 1)
            low, high = ordered[math.floor(k)], ordered[math.ceil(k)]
            assert got[q] == low + (k - math.floor(k)) * (high - low)
    assert statistics.median(sets["normal"]) == dict(validate.exact_percentiles(spark.createDataFrame([(v,) for v in sets["normal"]], "x double"), "x", [0.5], small=small).collect())[0.5]
    assert [r["value"] for r in validate.exact_percentiles(spark.createDataFrame([], "x double"), "x", [0.5]).collect()] == [None]
