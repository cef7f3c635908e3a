"""Ranks, tiers, top lists and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.sources.files import stored


def position(df: DataFrame, value: str, ties: list[str], alias: str, bucket: Column | None = None) -> DataFrame:
    """df with the global row number by value descending, then ties.

    No task sees all rows: rows of one bucket (default: one value; else any column that never falls as the value grows) are
    numbered together, on top of the count of rows in higher buckets, which comes from the small histogram."""
    b = df.withColumn("_b", bucket if bucket is not None else F.col(value))
    higher = b.groupBy("_b").agg(F.count("*").alias("_c"))
    higher = higher.select("_b", (F.sum("_c").over(Window.orderBy(F.col("_b").desc_nulls_last())) - F.col("_c")).alias("_before"))
    inside = Window.partitionBy("_b").orderBy(F.col(value).desc_nulls_last(), *ties)
    return b.join(higher, b["_b"].eqNullSafe(higher["_b"])).drop(higher["_b"]).withColumn(alias, (F.col("_before") + F.row_number().over(inside)).cast("bigint")).drop("_b", "_before")


def position_by_range(df: DataFrame, value: str, ties: list[str], alias: str, parts: int | None = None) -> DataFrame:
    """The same, of rows in ranges of (value, ties): no task has more than its share however many rows have one value, as long as ties
    tell them apart.

    The rows are dealt out by ranges, sorted and stored with their places; the counts of the ranges, one row each, add up to
    what stands before each.  Rows that agree in value and ties are numbered in any order."""
    order = [F.col(value).desc_nulls_last(), *map(F.col, ties)]
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_m", 33)).withColumn("_in", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(alias, (F.col("_before") + F.col("_in") + 1).cast("bigint")).drop("_m", "_part", "_in", "_before")  # a row a range


def rank_of(df: DataFrame, value: str, keys: list[str] | None = None, rank_as: str = "rank", total_as: str = "total") -> DataFrame:
    """df with RANK() by value descending and the number of rows, overall or within keys, from the histogram of values."""
    keys = keys or []
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*keys).orderBy(F.col("_v").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn(rank_as, (F.sum("_c").over(order) - F.col("_c") + 1).cast("bigint")).withColumn(total_as, F.sum("_c").over(Window.partitionBy(*keys))).drop("_c")
    other = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], "_v", rank_as, total_as)
    on = df[value].eqNullSafe(other["_v"])
    for k in keys:
        on = on & df[k].eqNullSafe(other[f"_{k}"])
    return df.join(other, on).drop("_v", *[f"_{k}" for k in keys])


def rank_within(df: DataFrame, keys: list[str], order: list[Column], alias: str) -> DataFrame:
    """Row number within keys (a field holds as many rows as there are institutions)."""
    return df.withColumn(alias, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, alias: str = "rank") -> DataFrame:
    """The first k rows of every group; Spark limits each task's groups before the shuffle."""
    return df.withColumn(alias, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(alias) <= k).withColumn(alias, F.col(alias).cast("bigint"))


def resolve_one(df: DataFrame, column: str, wanted: str, exact: bool = False) -> str:
    """The only value that contains `wanted` (in any case), or equals it in upper case with exact; else an error with up to ten candidates."""
    if exact:
        hit = df.where(F.col(column) == wanted.upper()).select(column).distinct().limit(1).collect()
        near = df.where(F.col(column).startswith(wanted.upper()[:1])).select(column).distinct().orderBy(column).limit(10).collect() if not hit else []
    else:
        near = df.where(F.col(column).ilike("%" + wanted.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%")).select(column).distinct().orderBy(column).limit(11).collect()
        hit = [r for r in near if r[0].lower() == wanted.lower()] or near
    if len(hit) == 1:
        return hit[0][0]
    raise ValueError(f"{'several match' if hit else 'nothing matches'} {wanted!r}; candidates: {[r[0] for r in near][:10]}")


def institution_ranks(name: str, overall: DataFrame, by_field: DataFrame, by_subfield: DataFrame) -> DataFrame:
    """level, label, h2, author_count, rank, total of one institution, found by a part of its name: overall, by field, by subfield."""
    wanted = resolve_one(overall, "institution_name", name)
    return _ranks("institution_name", wanted, "h2", "author_count", overall, by_field, by_subfield)


def country_ranks(code: str, overall: DataFrame, by_field: DataFrame, by_subfield: DataFrame) -> DataFrame:
    """The same for a country code."""
    wanted = resolve_one(overall, "country_code", code, exact=True)
    return _ranks("country_code", wanted, "h3", "institution_count", overall, by_field, by_subfield)


def _ranks(column: str, wanted: str, h: str, n: str, overall: DataFrame, by_field: DataFrame, by_subfield: DataFrame) -> DataFrame:
    parts = []
    for level, df, key in (("overall", overall, None), ("field", by_field, "field_name"), ("subfield", by_subfield, "subfield_name")):
        ranked = rank_of(df, h, [key] if key else [])
        parts.append(ranked.where(F.col(column) == wanted).select(F.lit(level).alias("level"), (F.col(key) if key else F.lit("(overall)")).alias("label"), h, n, "rank", "total"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
