"""One institution and one label of each level for every entity, out of nested arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.sources.files import stored

LEVELS = ["field", "subfield", "domain", "topic"]


def staged_filter(snapshot: DataFrame) -> DataFrame:
    """Entities with a positive index, an affiliation of type education, and a topic whose field is known."""
    educated = F.exists("affiliations", lambda a: a["institution"]["type"] == "education")
    labelled = F.exists("topics", lambda t: t["field"]["id"].isNotNull())
    return snapshot.where((F.col("h_index") > 0) & educated & labelled)


def latest_version(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key, of the greatest version (of equal ones that of the smallest hash over all columns)."""
    order = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.xxhash64(*df.columns))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def latest_by(df: DataFrame, entity: str, order: list[Column]) -> DataFrame:
    """The first row of each entity in an order; the order should end in a unique key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).where("_n = 1").drop("_n")


def _latest(kind: str) -> Column:
    """Of a row's affiliations of a kind the one of the greatest year (none last), then of the smallest id and name."""
    kept = F.filter("affiliations", lambda a: (a["institution"]["type"] == kind) & a["institution"]["id"].isNotNull())
    entry = lambda a: F.struct(F.array_max(a["years"]).isNull().alias("none"), (-F.array_max(a["years"])).alias("ago"), a["institution"]["id"].alias("id"), a["institution"]["display_name"].isNull().alias("unnamed"), a["institution"]["display_name"].alias("name"))
    return F.array_min(F.transform(kept, entry))


def latest_affiliation(staged: DataFrame, kind: str = "education") -> DataFrame:
    """author_id, institution_id, institution_name, latest_year: by greatest year (none last), then smallest id in its own order.
    An entity has all its affiliations in its row, so nothing is exploded or shuffled."""
    best = staged.select(F.col("id").alias("author_id"), _latest(kind).alias("a")).where("a IS NOT NULL")
    return best.select("author_id", F.col("a.id").alias("institution_id"), F.col("a.name").alias("institution_name"), (-F.col("a.ago")).alias("latest_year"))


def _modal(level: str) -> Column:
    """Of a row's topics the label of one level with the greatest summed weight, ties to the smaller id: the topics in the order of
    their ids, so that one pass adds up each label."""
    label = (lambda t: t) if level == "topic" else (lambda t: t[level])
    entry = lambda t: F.struct(label(t)["id"].cast("string").alias("id"), label(t)["display_name"].cast("string").alias("name"), F.coalesce(t["count"].cast("bigint"), F.lit(0).cast("bigint")).alias("w"))
    labels = F.sort_array(F.filter(F.transform("topics", entry), lambda e: e["id"].isNotNull()))
    none = lambda kind: F.lit(None).cast(f"struct<{kind}>")
    total = lambda e: F.struct((-e["w"]).alias("less"), e["id"].alias("id"), e["name"].alias("name"))
    ended = lambda s: F.when(s["run"].isNotNull(), total(s["run"]))

    def more(s: Column, e: Column) -> Column:
        # names rise within an id, so that of the last entry is the greatest
        same = s["run"]["id"] == e["id"]
        grown = F.struct(e["id"].alias("id"), e["name"].alias("name"), (s["run"]["w"] + e["w"]).alias("w"))
        return F.when(same, F.struct(grown.alias("run"), s["best"].alias("best"))).otherwise(F.struct(e.alias("run"), F.least(s["best"], ended(s)).alias("best")))

    best = F.aggregate(labels, F.struct(none("id: string, name: string, w: bigint").alias("run"), none("less: bigint, id: string, name: string").alias("best")), more, lambda s: F.array(s["best"], ended(s)))
    return F.array_min(best)


def modal_labels_in_row(staged: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    """author_id and for every level the label of the greatest summed weight: modal_labels of the topics of each row, without exploding
    or shuffling them.  Authors with no label at all are left out."""
    best = staged.select(F.col("id").alias("author_id"), *[_modal(v).alias(v) for v in levels])
    best = best.where(F.coalesce(*[F.col(f"{v}.id") for v in levels]).isNotNull())
    return best.select("author_id", *[c for v in levels for c in (F.col(f"{v}.id").alias(v), F.col(f"{v}.name").alias(f"{v}_name"))])


def modal_labels(rows: DataFrame, entity: str, levels: list[str], weight: str) -> DataFrame:
    """For every level the label of the greatest summed weight, ties to the smaller id; null where an entity has none.

    rows have for each level its id (named as the level) and name (level_name).  All levels are stacked, so the exploded rows are
    grouped once, by (entity, level, id)."""
    stack = F.array(*[F.struct(F.lit(v).alias("level"), F.col(v).cast("string").alias("id"), F.col(f"{v}_name").alias("name")) for v in levels])
    each = rows.select(entity, F.col(weight).alias("_w"), F.inline(stack)).where("id IS NOT NULL")
    totals = each.groupBy(entity, "level", "id").agg(F.sum("_w").alias("total"), F.max("name").alias("name"))
    best = totals.groupBy(entity, "level").agg(F.min_by(F.struct("id", "name"), F.struct((-F.col("total")).alias("t"), F.col("id"))).alias("b"))
    pick = lambda v: F.max(F.when(F.col("level") == v, F.col("b")))
    wide = best.groupBy(entity).agg(*[pick(v).alias(v) for v in levels])
    return wide.select(entity, *[c for v in levels for c in (F.col(f"{v}.id").alias(v), F.col(f"{v}.name").alias(f"{v}_name"))])


def topic_rows(staged: DataFrame) -> DataFrame:
    """Topics one by one with the ids and names of the four levels and the weight."""
    t = staged.select(F.col("id").alias("author_id"), F.explode("topics").alias("t"))
    part = lambda v: (F.col(f"t.{v}.id").alias(v), F.col(f"t.{v}.display_name").alias(f"{v}_name"))
    return t.select("author_id", *part("field"), *part("subfield"), *part("domain"), F.col("t.id").alias("topic"), F.col("t.display_name").alias("topic_name"), F.col("t.count").alias("weight"))


def canonical_name(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with the most frequent name of each key (ties to the smaller name) on all its rows."""
    counts = df.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.count("*").alias("_c"))
    best = counts.groupBy(key).agg(F.min_by(name, F.struct((-F.col("_c")).alias("c"), F.col(name))).alias("_name"))
    return df.join(best, key, "left").withColumn(name, F.coalesce("_name", name)).drop("_name")


def flat_authors(snapshot: DataFrame, version: str | None = None) -> DataFrame:
    """Snapshot rows to one flat row an author: institution, modal field, subfield, domain and topic, each label worked out once.  Authors
    without a field are left out; with `version` an id that occurs again counts once, in its latest form."""
    staged = staged_filter(latest_version(snapshot, "id", version) if version else snapshot)
    # one array with one entry: a generator is not evaluated again where its columns are filtered
    entry = F.array(F.struct(_latest("education").alias("i"), *[_modal(v).alias(v) for v in LEVELS]))
    flat = staged.select(F.col("id").alias("author_id"), "h_index", "works_count", F.inline(entry)).where("i IS NOT NULL AND field IS NOT NULL")
    labels = [c for v in LEVELS for c in (F.col(f"{v}.id").alias(v), F.col(f"{v}.name").alias(f"{v}_name"))]
    return flat.select("author_id", "h_index", "works_count", F.col("i.id").alias("institution_id"), F.col("i.name").alias("institution_name"), *labels)


def build_authors(snapshot: DataFrame, version: str | None = None) -> DataFrame:
    """flat_authors with the most frequent name of each institution on all its rows.  The flat rows are written once, so the nested work
    is not done again to count the names."""
    flat = stored(flat_authors(snapshot, version))
    return canonical_name(flat, "institution_id", "institution_name").select(*flat.columns)
