"""Power-law tail fits on a distributed histogram, after Clauset, Shalizi and Newman (2009)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.functions.special import erfc, scaled_zeta_sql, zeta_and_slopes
from tiermark.sources.files import stored


def tail_histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, x (above 0), c, and of the values from x on: n, sum of x, sum of ln x."""
    counts = df.where(F.col(value) > 0).groupBy(*keys, F.col(value).cast("bigint").alias("x")).agg(F.count("*").alias("c"))
    up = Window.partitionBy(*keys).orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("x").cast("double")
    return counts.select(*keys, "x", "c", F.sum("c").over(up).alias("n"), F.sum(F.col("c") * x).over(up).alias("sx"), F.sum(F.col("c") * F.ln(x)).over(up).alias("slog"))


def _candidates(hist: DataFrame, keys: list[str], xmin: int | None = None) -> DataFrame:
    """keys, xmin, alpha (closed form), n_tail, sum_tail and z_min (zeta at xmin, in the unit xmin^-alpha) of every distinct value with a greater one (or of xmin)."""
    top = hist.groupBy(*keys).agg(F.max("x").alias("top"))
    pick = (F.col("x") == xmin) if xmin is not None else (F.col("x") < F.col("top"))
    cand = hist.join(top, keys).where(pick).select(*keys, F.col("x").alias("xmin"), F.col("n").alias("n_tail"), F.col("slog").alias("s"), F.col("sx").alias("sum_tail"))
    return cand.withColumn("alpha", 1 + F.col("n_tail") / (F.col("s") - F.col("n_tail") * F.ln(F.col("xmin") - 0.5))).withColumn("z_min", F.expr(scaled_zeta_sql("alpha", "xmin", "xmin"))).drop("s")


def _greatest_gaps(cand: DataFrame, points: DataFrame, keys: list[str], few_points: bool, spread: int = 64) -> DataFrame:
    """cand with ks, the greatest gap between the empirical and the model's survival function at the points (x, n) from xmin on, and
    pairs, how many that were.  The pairs of a key are dealt over `spread` tasks: of candidates and points the fewer are copied."""
    dealt = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    share = lambda c: F.pmod(F.hash(c), F.lit(spread))
    points = points.select(*keys, "x", "n", (dealt if few_points else share("x")).alias("part"))
    pairs = cand.withColumn("part", share("xmin") if few_points else dealt).join(points, [*keys, "part"]).where("x >= xmin")
    gap = F.abs(F.col("n") / F.col("n_tail") - F.expr(scaled_zeta_sql("alpha", "x", "xmin")) / F.col("z_min"))
    found = pairs.groupBy(*keys, "xmin").agg(*[F.max(c).alias(c) for c in ("alpha", "n_tail", "sum_tail", "z_min")], F.max(gap).alias("ks"), F.count("*").alias("pairs"))
    return found


def tail_candidates(df: DataFrame, keys: list[str], value: str, xmin: int | None = None, spread: int = 64) -> DataFrame:
    """keys, xmin, alpha, n_tail, ks for every distinct value that leaves two distinct values in the tail (or for one xmin).

    alpha is the closed form for discrete data, 1 + n / sum ln(x / (xmin - 1/2)); ks the greatest difference between the
    empirical and the model's survival function at the distinct values.  Every distinct value is a candidate and is compared
    with every value of its tail; `best_candidates` finds the best without that."""
    hist = stored(tail_histogram(df, keys, value))
    return _greatest_gaps(_candidates(hist, keys, xmin), hist, keys, True, spread).drop("z_min", "pairs")


def _least(cand: DataFrame, keys: list[str], most: int = 1) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.round("ks", 9), "xmin")
    return cand.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")


def best_candidates(df: DataFrame, keys: list[str], value: str, ratios: tuple[float, ...] = (1.3, 1.03), spread: int = 64) -> DataFrame:
    """The row of tail_candidates with the least ks (to nine digits, then the least xmin) for each key, by branch and bound, with pairs
    (gaps worked out) and all_pairs (those of the full scan).

    The gap at a few check points of its tail bounds a candidate's ks from below.  Check points lie at ranks from the top that grow by
    a ratio, so every tail has some.  The candidates of the least bounds are worked out in full; what is bounded above the best
    of them can't win.  The rest meets denser check points, and what is left then every point.  The result is exact."""
    from_top = Window.partitionBy(*keys).orderBy(F.desc("x"))
    hist = stored(tail_histogram(df, keys, value).withColumn("r", F.row_number().over(from_top)))
    left, cost = stored(_candidates(hist, keys)), None

    def counted(rows: DataFrame) -> DataFrame:
        one = rows.groupBy(*keys).agg(F.sum("pairs").alias("pairs"))
        return one if cost is None else cost.unionByName(one)

    for ratio in ratios:
        step = lambda r, ratio=ratio: F.floor(F.ln(r.cast("double")) / F.lit(math.log(ratio)))
        checks = hist.where((F.col("r") == 1) | (step(F.col("r")) != step(F.greatest(F.col("r") - 1, F.lit(1)))))
        bounded = stored(_greatest_gaps(left.select(*keys, "xmin", "alpha", "n_tail", "sum_tail", "z_min"), checks, keys, True, spread))
        tried = stored(_greatest_gaps(_least(bounded, keys, 4).drop("ks", "pairs"), hist, keys, False, spread))
        cost = counted(bounded)
        cost = counted(tried)
        limit = tried.groupBy(*keys).agg(F.min(F.round("ks", 9)).alias("limit"))
        left = stored(bounded.join(limit, keys).where(F.round("ks", 9) <= F.col("limit")).drop("limit", "pairs"))
    whole = stored(_greatest_gaps(left.drop("ks"), hist, keys, False, spread))
    cost = counted(whole).groupBy(*keys).agg(F.sum("pairs").alias("pairs"))
    every = hist.groupBy(*keys).agg(F.sum(F.when(F.col("r") > 1, F.col("r")).otherwise(0)).alias("all_pairs"))
    return _least(whole, keys).drop("z_min", "pairs").join(cost, keys).join(every, keys)


def fit_tail(df: DataFrame, keys: list[str], value: str, xmin: int | None = None, least_points: int = 50) -> DataFrame:
    """One row a key: alpha, xmin, n_tail, n_total, ks, and against a geometric tail the normalized log-likelihood ratio r_exp
    (positive: the power law fits better) with p_exp.  Keys of fewer than least_points positive values have no fit."""
    best = _least(tail_candidates(df, keys, value, xmin), keys) if xmin is not None else best_candidates(df, keys, value).drop("pairs", "all_pairs")
    hist = stored(tail_histogram(df, keys, value))
    total = hist.groupBy(*keys).agg(F.sum("c").alias("n_total"), F.max("x").alias("max_x")).where(F.col("n_total") >= least_points)
    fit = best.join(total, keys)
    rate = F.ln(1 + 1 / (F.col("sum_tail") / F.col("n_tail") - F.col("xmin")))
    each = hist.select(*keys, "x", "c").join(fit, keys).where("x >= xmin")
    power = -F.col("alpha") * F.ln(F.col("x").cast("double") / F.col("xmin")) - F.ln(F.expr(scaled_zeta_sql("alpha", "xmin", "xmin")))
    geometric = F.ln(1 - F.exp(-rate)) - rate * (F.col("x") - F.col("xmin"))
    each = each.withColumn("d", power - geometric)
    sums = each.groupBy(*keys).agg(F.sum(F.col("c") * F.col("d")).alias("r"), F.sum(F.col("c") * F.col("d") * F.col("d")).alias("rr"))
    n = F.col("n_tail")
    spread = F.sqrt(F.col("rr") / n - F.pow(F.col("r") / n, F.lit(2.0)))
    score = F.when(spread > 0, F.col("r") / (F.sqrt(n.cast("double")) * spread)).otherwise(0.0)
    joined = fit.join(sums, keys).withColumn("r_exp", score)
    return joined.select(*keys, "alpha", "xmin", "n_tail", "n_total", F.col("ks").alias("d_ks"), "r_exp", erfc(F.abs("r_exp") / F.sqrt(F.lit(2.0))).alias("p_exp"))


def exact_exponents(df: DataFrame, fits: DataFrame, keys: list[str], value: str, steps: int = 12) -> DataFrame:
    """keys, xmin, n_tail, alpha, alpha_se: the maximum-likelihood exponent at the xmin of each row of fits, exact for discrete data.

    It solves -zeta'(alpha, xmin) / zeta(alpha, xmin) = mean of ln x by Newton steps from the closed form, which is biased for small
    xmin; the standard error is by the curvature at the solution.  Null where the tail has one distinct value (no finite solution)."""
    at = fits.select(*keys, "xmin")
    tails = tail_histogram(df, keys, value).withColumnRenamed("x", "xmin").join(at, [*keys, "xmin"])
    tails = tails.withColumn("q", F.col("xmin").cast("double")).withColumn("m", F.col("slog") / F.col("n") - F.ln("q"))  # of ln(x / xmin)
    start = 1 + 1 / (F.col("m") - F.ln((F.col("q") - 0.5) / F.col("q")))

    def newton(a: Column, _: Column) -> Column:
        z = zeta_and_slopes(a, F.col("q"))
        slope = z["z1"] / z["z"]
        new = a - (slope + F.col("m")) / (z["z2"] / z["z"] - slope * slope)
        return F.when(new > 1, new).otherwise((a + 1) / 2)

    solved = tails.where(F.col("m") > 1e-12).withColumn("alpha", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, newton)).withColumn("z", zeta_and_slopes(F.col("alpha"), F.col("q")))
    spread = F.col("z.z2") / F.col("z.z") - F.pow(F.col("z.z1") / F.col("z.z"), F.lit(2.0))
    found = solved.select(*keys, "xmin", "alpha", (1 / F.sqrt(F.col("n") * spread)).alias("alpha_se"))
    return tails.select(*keys, "xmin", F.col("n").alias("n_tail")).join(found, [*keys, "xmin"], "left")


def fit_summary(fits: DataFrame, cap_report: DataFrame, cap: int, label: str = "label") -> DataFrame:
    """One row from fits labelled citations (alpha_0), authors_size (alpha_1), institutions_size (alpha_2), authors (beta_1), institutions
    (beta_2): alpha_0 also as beta_1 / alpha_1 and as beta_2 / (alpha_1 alpha_2), beta_2 as predicted by beta_1 alpha_2 and its
    deviation from that in percent, a verdict on each tail, and the cap on works with how many authors it removed (from the
    report of apply_cap)."""
    at = lambda name: F.max(F.when(F.col(label) == name, F.col("alpha")))
    named = {"alpha_0": "citations", "alpha_1": "authors_size", "alpha_2": "institutions_size", "beta_1": "authors", "beta_2": "institutions"}
    wide = fits.agg(*[at(n).alias(c) for c, n in named.items()], F.concat_ws("; ", F.array_sort(F.collect_list(F.concat(F.col(label), F.lit(": "), verdict())))).alias("verdicts"))
    one, two, predicted = F.col("beta_1") / F.col("alpha_1"), F.col("beta_2") / (F.col("alpha_1") * F.col("alpha_2")), F.col("beta_1") * F.col("alpha_2")
    wide = wide.select("*", one.alias("alpha_0_from_beta1"), two.alias("alpha_0_from_beta2"), predicted.alias("beta_2_predicted"), (100 * (F.col("beta_2") - predicted) / predicted).alias("beta_2_deviation"))
    removed = cap_report.select(F.lit(cap).cast("bigint").alias("works_cap"), F.col("removed").alias("works_cap_excluded"))
    return wide.join(F.broadcast(removed))  # one row each


def verdict(level: float = 0.05) -> Column:
    """In words: which of the two tails the ratio favors, if its p is below level."""
    sure = F.col("p_exp") < level
    return F.when(sure & (F.col("r_exp") > 0), "power law is favored").when(sure & (F.col("r_exp") < 0), "exponential is favored").otherwise("neither is favored")


def subsample(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """Exactly min(most, rows) rows: those of the smallest seeded digest of the key (ties by key).

    Digests are counted by their first four digits; whole buckets below the cut are taken as they are, and only the bucket that
    the cut is in is put in order."""
    d, p, n = "_digest", "_bucket", "_place"
    rows = df.withColumn(d, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn(p, F.substring(d, 1, 4))
    counts = rows.groupBy(p).agg(F.count("*").alias("_c"))
    before = counts.select(p, "_c", (F.sum("_c").over(Window.orderBy(p)) - F.col("_c")).alias("_before")).where(F.col("_before") < most)
    near = rows.join(F.broadcast(before), p)  # 65,536 rows at most
    whole = near.where(F.col("_before") + F.col("_c") <= most)
    edge = near.where(F.col("_before") + F.col("_c") > most).withColumn(n, F.row_number().over(Window.partitionBy(p).orderBy(d, key)))
    return whole.select(*df.columns).unionByName(edge.where(F.col("_before") + F.col(n) <= most).select(*df.columns))
