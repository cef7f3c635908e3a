"""Metrics over the index tables: efficiency, concentration, breadth, specialization, medals, regressions, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.operators.hindex import h_index_excluding
from tiermark.operators.rank import position, rank_within


def count_by(df: DataFrame, label: str) -> DataFrame:
    """Rows by label with their share of all (of the labelled) rows."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("author_count"))
    return counts.withColumn("share", F.round(F.col("author_count") / F.sum("author_count").over(Window.partitionBy()), 6))


def apply_cap(df: DataFrame, column: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """Rows up to a cap, and one row with what it keeps and removes."""
    report = df.agg(F.count_if(F.col(column) <= cap).alias("kept"), F.count_if(F.col(column) > cap).alias("removed"), F.max(column).alias("max_value"))
    return df.where(F.col(column) <= cap), report


def outlier_cutoffs(df: DataFrame, column: str, cutoffs: list[int]) -> DataFrame:
    """Rows above each cutoff and their share, in one pass."""
    one = df.agg(F.count(column).alias("total"), *[F.count_if(F.col(column) > c).alias(f"c{c}") for c in cutoffs])
    rows = F.array(*[F.struct(F.lit(c).cast("bigint").alias("cutoff"), F.col(f"c{c}").alias("above")) for c in cutoffs])
    return one.select("total", F.inline(rows)).select("cutoff", "above", "total", F.round(F.col("above") / F.col("total"), 6).alias("share"))


def histogram(df: DataFrame, column: str, bins: int, log: bool = False) -> DataFrame:
    """bin (from 0), low, high, n: equal widths between minimum and maximum, of the value or of its decimal logarithm (values
    above 0 only); the last bin holds the maximum.  Empty bins have no row."""
    x = F.log10(F.col(column).cast("double")) if log else F.col(column).cast("double")
    each = df.where(F.col(column) > 0 if log else F.col(column).isNotNull()).select(x.alias("x"))
    ends = each.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    at = F.when(F.col("b") == F.col("a"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * bins)))
    counts = each.join(F.broadcast(ends)).withColumn("bin", at.cast("bigint")).groupBy("bin").agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))  # ends is one row
    edge = lambda k: F.col("a") + (F.col("b") - F.col("a")) * k / bins
    out = lambda v: F.round(F.pow(F.lit(10.0), v) if log else v, 6)
    return counts.select("bin", out(edge(F.col("bin"))).alias("low"), out(edge(F.col("bin") + 1)).alias("high"), "n")


def efficiency(df: DataFrame, keys: list[str], h: str, n: str, beta: float, min_n: int, rank_scope: str, ties: list[str], h_rank: str) -> DataFrame:
    """h over size^(1/beta) for groups of min_n members or more.  The rank by h is taken among those (rank_scope="filtered") or
    among all ("all"); the rank by efficiency, unrounded, among those."""
    if rank_scope not in ("filtered", "all"):
        raise ValueError("rank_scope is filtered or all")
    large = F.col(n) >= min_n
    ranked = position(df, h, ties, h_rank).where(large) if rank_scope == "all" else position(df.where(large), h, ties, h_rank)
    with_e = ranked.withColumn("_e", F.col(h) / F.pow(F.col(n).cast("double"), F.lit(1 / beta)))
    done = position(with_e, "_e", ties, "efficiency_rank", bucket=F.floor(F.col("_e") * 16))
    return done.select(*keys, h, n, F.round("_e", 4).alias("efficiency"), h_rank, "efficiency_rank")


def best_efficiency(df: DataFrame, group: str, keys: list[str], h: str, n: str, beta: float, min_n: int, ties: list[str]) -> DataFrame:
    """Of every group the member of the greatest efficiency (then greatest h, then ties) among those of min_n or more, with its rank by h."""
    large = rank_within(df.where(F.col(n) >= min_n), [group], [F.col(h).desc(), *map(F.col, ties)], "h_rank").withColumn("_e", F.col(h) / F.pow(F.col(n).cast("double"), F.lit(1 / beta)))
    best = rank_within(large, [group], [F.col("_e").desc(), F.col(h).desc(), *map(F.col, ties)], "_n").where("_n = 1")
    return best.select(group, *keys, h, n, F.round("_e", 4).alias("efficiency"), "h_rank")


def gini(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, members, greatest and mean value, Gini coefficient, from the histogram of values: c equal values after b smaller
    ones stand at b + 1 to b + c."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    block = F.col("_x") * (F.col("_c") * before + F.col("_c") * (F.col("_c") + 1) / 2)
    sums = counts.withColumn("_s", block).groupBy(*keys).agg(F.sum("_c").alias("n"), F.max("_x").alias("max_value"), F.sum("_s").alias("s"), F.sum(F.col("_x") * F.col("_c")).alias("t"))
    g = F.when(F.col("t") > 0, 2.0 * F.col("s") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n"))
    return sums.select(*keys, "n", "max_value", F.round(F.col("t") / F.col("n"), 2).alias("mean_value"), F.round(g, 4).alias("gini"))


def field_leaders(by_field: DataFrame) -> DataFrame:
    """The leading institution of each field and its h2 over the field's mean."""
    mean = by_field.groupBy("field_name").agg(F.avg("h2").alias("m"))
    lead = by_field.groupBy("field_name").agg(F.min_by(F.struct("institution_id", "institution_name", "h2"), F.struct((-F.col("h2")).alias("h"), "institution_name", "institution_id")).alias("b"))
    g = gini(by_field, ["field_name"], "h2").select("field_name", "gini")
    joined = lead.join(mean, "field_name").join(g, "field_name")
    return joined.select("field_name", F.col("b.institution_name").alias("institution_name"), F.col("b.h2").alias("h2"), F.round("m", 1).alias("mean_h2"), F.round(F.col("b.h2") / F.col("m"), 1).alias("ratio"), "gini")


def field_positions(by_field: DataFrame) -> DataFrame:
    """by_field with field_rank: by h2, then name, then id."""
    return rank_within(by_field, ["field"], [F.col("h2").desc(), F.col("institution_name"), F.col("institution_id")], "field_rank")


def breadth(by_field: DataFrame, overall: DataFrame, cuts: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """In how many fields an institution is among the first 10, 50, 100, and in how many at all, with its overall rank."""
    counted = field_positions(by_field).groupBy("institution_id").agg(F.max("institution_name").alias("institution_name"), *[F.count_if(F.col("field_rank") <= c).alias(f"top{c}_fields") for c in cuts], F.count("*").alias("total_fields"))
    joined = counted.join(overall.select("institution_id", F.col("h2").alias("overall_h2"), "author_count"), "institution_id")
    return position(joined, "overall_h2", ["institution_name", "institution_id"], "overall_rank")


def fields_outside(by_field: DataFrame, institution: Column, k: int = 10) -> DataFrame:
    """Fields in which an institution is behind the first k."""
    return field_positions(by_field).where(institution & (F.col("field_rank") > k)).select("institution_name", "field_name", "field_rank", "h2")


def strong_without_lead(breadth_table: DataFrame, least_h2: int = 20) -> DataFrame:
    return breadth_table.where((F.col("top10_fields") == 0) & (F.col("overall_h2") >= least_h2)).select("institution_id", "institution_name", "overall_rank", "overall_h2", "top10_fields", "top50_fields", "top100_fields")


def specialization_institution(overall: DataFrame, by_field: DataFrame) -> DataFrame:
    """Overall rank less the best rank within a field (ties of that rank: greatest h2, then field name)."""
    best = field_positions(by_field).groupBy("institution_id").agg(F.min_by(F.struct("field_name", "h2", "author_count", "field_rank"), F.struct("field_rank", (-F.col("h2")).alias("h"), "field_name")).alias("b"))
    ranked = position(overall, "h2", ["institution_name", "institution_id"], "overall_rank")
    return ranked.join(best, "institution_id").select(
        "institution_id", "institution_name", "overall_rank", F.col("h2").alias("overall_h2"), F.col("author_count").alias("overall_author_count"), F.col("b.field_rank").alias("best_field_rank"),
        F.col("b.field_name").alias("best_field_name"), F.col("b.h2").alias("best_field_h2"), F.col("b.author_count").alias("best_field_author_count"), (F.col("overall_rank") - F.col("b.field_rank")).alias("specialization_index"),
    )


def specialization_country(overall: DataFrame, by_field: DataFrame) -> DataFrame:
    """The same for countries: ranks by h3, then code; of equal best ranks the first field name."""
    within = rank_within(by_field, ["field_name"], [F.col("h3").desc(), F.col("country_code")], "field_rank")
    best = within.groupBy("country_code").agg(F.min_by(F.struct("field_name", "h3", "field_rank"), F.struct("field_rank", "field_name")).alias("b"))
    ranked = position(overall, "h3", ["country_code"], "overall_rank")
    return ranked.join(best, "country_code").select("country_code", "overall_rank", F.col("h3").alias("overall_h3"), "institution_count", F.col("b.field_rank").alias("best_field_rank"), F.col("b.field_name").alias("best_field_name"), F.col("b.h3").alias("best_field_h3"), (F.col("overall_rank") - F.col("b.field_rank")).alias("specialization_index"))


def rank_change_excluding(authors: DataFrame, overall: DataFrame, excluded: list[str]) -> DataFrame:
    """Ranks without some fields against ranks with all."""
    rest = h_index_excluding(authors, ["institution_id"], "h_index", "field_name", excluded, carry=["institution_name"], h_as="rest_h2", count_as="rest_author_count")
    ranked = position(rest, "rest_h2", ["institution_name", "institution_id"], "rest_rank")
    every = position(overall.select("institution_id", F.col("institution_name").alias("_name"), F.col("h2").alias("overall_h2"), F.col("author_count").alias("overall_author_count")), "overall_h2", ["_name", "institution_id"], "overall_rank").drop("_name")
    return ranked.join(every, "institution_id").withColumn("rank_change", F.col("overall_rank") - F.col("rest_rank"))


def medals(by_field: DataFrame, method: str = "dense") -> DataFrame:
    """The three highest tiers of each field: "dense" counts distinct values, "olympic" skips places after ties."""
    order = Window.partitionBy("field_name").orderBy(F.desc("h3"))
    tier = {"dense": F.dense_rank, "olympic": F.rank}[method]().over(order)
    names = F.array(F.lit("gold"), F.lit("silver"), F.lit("bronze"))
    return by_field.withColumn("_t", tier).where("_t <= 3").select("field_name", "country_code", "h3", F.element_at(names, F.col("_t")).alias("medal"))


def medal_table(won: DataFrame) -> DataFrame:
    """Gold, silver and bronze counts and the fields of each, by country."""
    fields = lambda m: F.concat_ws("; ", F.array_sort(F.collect_list(F.when(F.col("medal") == m, F.col("field_name")))))
    kinds = ("gold", "silver", "bronze")
    return won.groupBy("country_code").agg(*[F.count_if(F.col("medal") == m).alias(m) for m in kinds], *[fields(m).alias(f"{m}_fields") for m in kinds])


def tied_golds(won: DataFrame) -> DataFrame:
    """Fields with more than one gold."""
    gold = won.where("medal = 'gold'").groupBy("field_name").agg(F.count("*").alias("golds"), F.concat_ws("; ", F.array_sort(F.collect_list("country_code"))).alias("countries"))
    return gold.where("golds > 1")


def fit_origin(df: DataFrame, size: str, h: str, beta: float) -> DataFrame:
    """Least squares through the origin of h on size^(1/beta): slope, uncentered R2, n."""
    x, y = F.pow(F.col(size).cast("double"), F.lit(1 / beta)), F.col(h).cast("double")
    s = df.agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.count("*").alias("n"))
    slope = F.try_divide(F.col("xy"), F.col("xx"))
    return s.select(F.round(slope, 6).alias("slope"), F.round(1 - F.try_divide(F.col("yy") - slope * F.col("xy"), F.col("yy")), 6).alias("r2"), "n")


def fit_ols_sqrt(df: DataFrame, size: str, h: str) -> DataFrame:
    """Straight line of h on the square root of size."""
    x, y = F.sqrt(F.col(size).cast("double")), F.col(h).cast("double")
    return df.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.count("*").alias("n"))


def choropleth_table(countries: DataFrame, by_country: DataFrame) -> DataFrame:
    """Every country with its h3 if any, a flag, and log(1 + h3) scaled to 0..1 between the least and greatest."""
    joined = countries.join(by_country.select("country_code", "h3", "institution_count"), "country_code", "left")
    log = F.log1p(F.col("h3").cast("double"))
    ends = by_country.agg(F.min(F.log1p(F.col("h3").cast("double"))).alias("_a"), F.max(F.log1p(F.col("h3").cast("double"))).alias("_b"))  # one row
    share = F.when(F.col("_b") > F.col("_a"), (log - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(F.when(log.isNotNull(), 0.0))
    return joined.join(F.broadcast(ends)).select("country_code", "country_name", "h3", "institution_count", F.col("h3").isNotNull().alias("has_data"), F.round(share, 6).alias("normalized_log"))


def with_country_names(df: DataFrame, countries: DataFrame) -> DataFrame:
    """df with country_name from a dimension of codes and names; a code that it lacks is its own name."""
    names = countries.select("country_code", "country_name").where("country_name IS NOT NULL").dropDuplicates(["country_code"])
    return df.join(names, "country_code", "left").withColumn("country_name", F.coalesce("country_name", "country_code"))
