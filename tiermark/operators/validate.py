"""Validation samples, agreement with other sources, and the quality report."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.operators.hindex import h_index
from tiermark.operators.rank import top_k


def validation_sample(authors: DataFrame, config: DataFrame, global_top: int = 5) -> DataFrame:
    """bucket, institution, field, author_id, h_index_local, reason.

    config rows: kind ("threshold" or "top"), bucket, institution (name), field (name or null), n.  Threshold rows give n
    authors exactly at the h2 of that institution (and field), top rows the n authors of greatest index; the globally
    greatest come on top.  All rows of the config are served by one job; order is by author_id wherever the index ties.
    """
    people = authors.select("author_id", "h_index", "institution_name", "field_name").distinct()
    asked = config.withColumn("_id", F.xxhash64("kind", "bucket", "institution", F.coalesce("field", F.lit("")))).join(people, (F.col("institution") == F.col("institution_name")) & (F.col("field").isNull() | (F.col("field") == F.col("field_name"))))
    asked = asked.select("_id", "kind", "bucket", "institution", "field", "n", "author_id", "h_index").distinct()
    line = h_index(asked.where("kind = 'threshold'"), ["_id"], "h_index", h_as="h2", count_as="_n").select("_id", "h2")
    at_line = asked.where("kind = 'threshold'").join(line, "_id").where("h_index = h2").withColumn("reason", F.concat(F.lit("index equals h2, "), F.col("h2").cast("string"))).drop("h2")
    best = asked.where("kind = 'top'").withColumn("reason", F.lit("leads its institution"))
    picked = at_line.unionByName(best).withColumn("_r", F.row_number().over(Window.partitionBy("_id").orderBy(F.desc("h_index"), "author_id"))).where("_r <= n")
    part = picked.select("bucket", "institution", F.coalesce("field", F.lit("(overall)")).alias("field"), "author_id", F.col("h_index").alias("h_index_local"), "reason")
    first = people.select("author_id", "h_index", "institution_name").distinct().orderBy(F.desc("h_index"), "author_id").limit(global_top)
    top = first.select(F.lit("Leaders of all").alias("bucket"), F.col("institution_name").alias("institution"), F.lit("(overall)").alias("field"), "author_id", F.col("h_index").alias("h_index_local"), F.lit("leads all authors").alias("reason"))
    return part.unionByName(top)


def enrich(sample: DataFrame, profiles: DataFrame) -> DataFrame:
    """The sample with name, orcid, external index and the first three affiliations of a profile table; missing ones stay null."""
    text = F.concat_ws("; ", F.slice(F.filter("affiliations", lambda a: a.isNotNull()), 1, 3))
    some = profiles.select("author_id", "name", "orcid", "h_index_external", text.alias("affiliation_text"))
    return sample.join(some, "author_id", "left").select("bucket", "institution", "field", "name", "author_id", "orcid", "reason", "affiliation_text", "h_index_local", "h_index_external")


def agreement(pairs: DataFrame, source: str, name: str, own: str, other: str) -> DataFrame:
    """By source: covered, mean and mean absolute difference (other less own), and the worst case (ties to the smaller name)."""
    d = F.col(other) - F.col(own)
    good = pairs.where(F.col(other).isNotNull() & F.col(own).isNotNull()).select(source, F.col(name).alias("_n"), d.cast("double").alias("_d"))
    return good.groupBy(source).agg(F.count("*").alias("n_covered"), F.round(F.avg("_d"), 4).alias("mean_difference"), F.round(F.avg(F.abs("_d")), 4).alias("mean_abs_difference"), F.min_by("_n", F.struct((-F.abs("_d")).alias("d"), "_n")).alias("worst_case"), F.max(F.abs("_d")).alias("worst_abs_difference"))


def exact_percentiles(df: DataFrame, column: str, qs: list[float], bins: int = 1024, small: int = 100_000) -> DataFrame:
    """q and value: exact percentiles (linear between neighbours, as `percentile` has them) without gathering the distinct values.

    Each wanted place is narrowed down by counting passes: the range that holds it is cut into bins of equal width, and the bin with the
    place becomes the next range, by its least and greatest value.  What has small rows or fewer left is sorted.  All places
    are served by each pass.  Nulls, NaN and infinite values are left out; without others every value is null."""
    spark, big = df.sparkSession, float("inf")
    x = df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < big))
    n, lo, hi = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    places = sorted({k for q in qs for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}) if n else []
    at = {k: (lo, hi, 0, n) for k in places}  # least and greatest value, rows before, rows

    def wanted(ranges: list[tuple]) -> DataFrame:
        held = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b, _, _) in enumerate(ranges)])
        return x.withColumn("r", F.explode(F.filter(held, lambda r: (F.col("x") >= r["a"]) & (F.col("x") <= r["b"])))).select("x", "r.*")

    while ranges := sorted({v for v in at.values() if v[0] < v[1] and v[3] > small}):
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * bins))
        rows = wanted(ranges).groupBy("k", bin_.alias("bin")).agg(F.min("x"), F.max("x"), F.count("*")).orderBy("k", "bin").collect()  # bins rows a range at most
        for place, old in at.items():
            if old in ranges:
                before = old[2]
                for _, _, a, b, c in (r for r in rows if r[0] == ranges.index(old)):
                    if before + c > place:
                        at[place] = (a, b, before, c)
                        break
                    before += c
    found = {place: v[0] for place, v in at.items() if v[0] == v[1]}
    if ranges := sorted({v for v in at.values() if v[0] < v[1]}):
        sums = F.sum("c").over(Window.partitionBy("k").orderBy("x"))
        upto = wanted(ranges).groupBy("k", "x").agg(F.count("*").alias("c")).withColumn("upto", sums)  # small rows a range
        held = F.array(*[F.struct(F.lit(ranges.index(v)).alias("j"), F.lit(place).cast("bigint").alias("place"), F.lit(place - v[2]).alias("p")) for place, v in at.items() if v[0] < v[1]])
        hit = upto.withColumn("w", F.explode(F.filter(held, lambda w: (w["j"] == F.col("k")) & (w["p"] < F.col("upto")) & (w["p"] >= F.col("upto") - F.col("c")))))
        found |= {r["place"]: r["x"] for r in hit.select("w.place", "x").collect()}  # two rows a percentile at most

    def value(q: float) -> float | None:
        if not n:
            return None
        place = q * (n - 1)
        low, high = found[math.floor(place)], found[math.ceil(place)]
        return low + (place - math.floor(place)) * (high - low)

    return spark.createDataFrame([(q, value(q)) for q in qs], "q double, value double")


def quality_report(by_field: DataFrame, by_subfield: DataFrame, spot: str | list[str], top: int = 5) -> DataFrame:
    """Tidy rows (check, item, value): quantiles, share of small groups, plausibility of the maximum, distinct subfields, the
    top groups by field and by subfield, and the best fields of institutions that match a spot-check name (or one of several)."""
    one = by_field.agg(F.percentile("h2", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.99)))).alias("p"), F.min("h2").alias("lo"), F.max("h2").alias("hi"), F.count("*").alias("n"), F.count_if(F.col("author_count") < 10).alias("small"))
    text = lambda c: F.round(c, 4).cast("double").cast("string")
    cell = lambda check, item, value: F.struct(F.lit(check).alias("check"), item.alias("item"), value.alias("value"))
    mark = F.when(F.col("hi") > 200, "implausible: above 200").when(F.col("hi") < 5, "implausible: below 5").otherwise("plausible")
    quantiles = [cell("quantile", F.lit(f"p{q}"), text(F.get("p", F.lit(k)))) for k, q in enumerate((25, 50, 75, 90, 99))]
    rows = F.array(*quantiles, cell("quantile", F.lit("min"), text(F.col("lo"))), cell("quantile", F.lit("max"), text(F.col("hi"))), cell("small groups", F.lit("share"), text(F.col("small") / F.col("n"))), cell("maximum", F.lit("verdict"), mark))
    parts = [one.select(F.inline(rows))]
    parts.append(by_subfield.agg(F.count_distinct("subfield").alias("n")).select(F.lit("subfields").alias("check"), F.lit("distinct").alias("item"), text(F.col("n")).alias("value")))
    name = F.concat_ws(" / ", "institution_name", "field_name")
    best = by_field.orderBy(F.desc("h2"), "institution_name", "institution_id", "field").limit(top)
    parts.append(best.select(F.lit("top").alias("check"), name.alias("item"), text(F.col("h2")).alias("value")))
    leading = by_subfield.orderBy(F.desc("h2"), "institution_name", "institution_id", "subfield").limit(top)
    parts.append(leading.select(F.lit("top in subfield").alias("check"), F.concat_ws(" / ", "institution_name", "subfield_name").alias("item"), text(F.col("h2")).alias("value")))
    names = [spot] if isinstance(spot, str) else spot
    hit = top_k(by_field.where(reduce(operator.or_, [F.col("institution_name").ilike(f"%{s}%") for s in names], F.lit(False))), ["institution_id"], [F.desc("h2"), F.col("field")], 5)
    parts.append(hit.select(F.lit("spot check").alias("check"), name.alias("item"), text(F.col("h2")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def topk_per_field(by_field: DataFrame, k: int = 100) -> DataFrame:
    return top_k(by_field, ["field"], [F.desc("h2"), F.col("institution_name"), F.col("institution_id")], k).select("field_name", "rank", "institution_name", "h2")
