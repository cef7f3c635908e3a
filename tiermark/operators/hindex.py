"""The group h-index at every level of the hierarchy.

Written over a histogram: for integers, h is the greatest min(v, C(v)) over the distinct values v, where C(v) counts members
with a value of v or more.  The histogram combines before the shuffle, so a group of any size is at most as many rows as it has
distinct values when it reaches one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def h_index(df: DataFrame, keys: list[str], value: str, carry: list[str] | None = None, h_as: str = "h", count_as: str = "n", keep_zero: bool = False) -> DataFrame:
    """keys, carry, h, member count.  Nulls never qualify but are members; groups of h = 0 are left out unless keep_zero.
    carry columns depend on the keys (their maximum is taken)."""
    carry = carry or []
    held = [F.max(c).alias(c) for c in carry]
    counts = df.groupBy(*keys, F.floor(F.col(value)).cast("bigint").alias("_v")).agg(F.count("*").alias("_c"), *held)
    best = h_of_histogram(counts, keys, carry, h_as, count_as)
    return best if keep_zero else best.where(F.col(h_as) > 0)


def h_of_histogram(counts: DataFrame, keys: list[str], carry: list[str], h_as: str, count_as: str) -> DataFrame:
    """keys, carry, h, member count from rows of keys, _v (value) and _c (members with it)."""
    above = Window.partitionBy(*keys).orderBy(F.col("_v").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.least("_v", F.sum("_c").over(above))
    held = [F.max(c).alias(c) for c in carry]
    best = counts.withColumn("_h", F.when(F.col("_v") >= 1, reach)).groupBy(*keys).agg(*held, F.coalesce(F.max("_h"), F.lit(0)).cast("bigint").alias(h_as), F.sum("_c").alias(count_as))
    return best.select(*keys, *carry, h_as, count_as)


def h2_levels(authors: DataFrame) -> DataFrame:
    """h2 by institution, by institution and field, and by institution and subfield in one pass over the authors: level, institution_id,
    label (null overall), institution_name, label_name, h2, author_count.

    Grouping sets over the values: every author row becomes three, which are counted before the shuffle; the h-indexes of all
    levels come from one histogram.  Authors without a subfield are in no group of that level."""
    value = F.floor("h_index").cast("bigint")
    rows = authors.select("institution_id", "institution_name", "field", "field_name", "subfield", "subfield_name", value.alias("_v"))
    sets = [["institution_id", "_v"], ["institution_id", "_v", "field"], ["institution_id", "_v", "subfield"]]
    names = [F.max(c).alias(c) for c in ("institution_name", "field_name", "subfield_name")]
    counts = rows.groupingSets(sets, "institution_id", "_v", "field", "subfield").agg(F.grouping("field").alias("_f"), F.grouping("subfield").alias("_s"), F.count("*").alias("_c"), *names)
    level = F.when(F.col("_f") == 0, "field").when(F.col("_s") == 0, "subfield").otherwise("institution")
    at = lambda a, b: F.when(F.col("_f") == 0, F.col(a)).when(F.col("_s") == 0, F.col(b))
    each = counts.select(level.alias("level"), "institution_id", at("field", "subfield").alias("label"), "_v", "_c", "institution_name", at("field_name", "subfield_name").alias("label_name"))
    each = each.where("level = 'institution' OR label IS NOT NULL OR level = 'field'")
    return h_of_histogram(each, ["level", "institution_id", "label"], ["institution_name", "label_name"], "h2", "author_count").where("h2 > 0")


def h2_by_institution(authors: DataFrame) -> DataFrame:
    return h_index(authors, ["institution_id"], "h_index", ["institution_name"], "h2", "author_count")


def h2_by_institution_field(authors: DataFrame) -> DataFrame:
    return h_index(authors, ["institution_id", "field"], "h_index", ["institution_name", "field_name"], "h2", "author_count")


def h2_by_institution_subfield(authors: DataFrame) -> DataFrame:
    return h_index(authors.where("subfield IS NOT NULL"), ["institution_id", "subfield"], "h_index", ["institution_name", "subfield_name"], "h2", "author_count")


def h3(h2: DataFrame, country_map: DataFrame, keys: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """h over institutions' h2 by country (and keys).  Institutions without a country are left out.  Both sides are index
    tables; which join it is, Spark decides by their sizes."""
    placed = h2.join(country_map.select(F.col("id").alias("institution_id"), "country_code"), "institution_id")
    return h_index(placed, ["country_code", *(keys or [])], "h2", carry, "h3", "institution_count")


def h_index_excluding(df: DataFrame, keys: list[str], value: str, column: str, excluded: list[str], **names) -> DataFrame:
    """h of what is left without some labels; rows without a label go too, as NOT IN has it."""
    return h_index(df.where(~F.col(column).isin(*excluded)), keys, value, **names)


def h_threshold(authors: DataFrame, institution: Column, field: Column | None = None) -> DataFrame:
    """One row, h2: over the distinct authors that meet a condition on institution (and field)."""
    some = authors.where(institution if field is None else institution & field).select("author_id", "h_index").distinct()
    return h_index(some.withColumn("_all", F.lit(0)), ["_all"], "h_index").select(F.col("h").alias("h2"))
