r"""Line dedup over levelled sorted runs of line hashes, with DataFrame operations only.

A line's key is the line without [\x20\x09-\x0D] at both ends, A-Z lower-cased; two independent 64-bit hashes stand for it.
Batches of documents come in descending order of their ids.  Each batch is counted by key and anti-joined with the runs: a
key that no run has is owned by the batch's largest id.  The batch adds its own counts and owners as a new run of level 0; as
soon as a level has `fan_out` runs they are merged into one of the next level.  Runs are tables bucketed and sorted by hash, so a
batch meets them without shuffling them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermark.llm.common import ascii_lower, ascii_strip, scratch_dir, stored, temporary, text_or_empty


class LineRuns:
    """The runs: rows h1, h2, n (documents), owner (null where an earlier run owns the key)."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_out: int = 2):
        self.spark, self.fan_out = spark, fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.names: list[str] = []

    def _run(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        self.names.append(name)
        sorted_ = rows.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2")
        sorted_.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", scratch_dir(self.spark, name)).saveAsTable(name)
        return self.spark.table(name)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        union = runs[0]
        for r in runs[1:]:
            union = union.unionByName(r)
        return union.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("owner").alias("owner"))

    def add(self, lines: DataFrame) -> None:
        """A batch of rows h1, h2, id, first; its ids are below all earlier ones, or null."""
        counted = stored(lines.groupBy("h1", "h2").agg(F.sum(F.col("first").cast("bigint")).alias("n"), F.max("id").alias("owner")), "batch")
        fresh = counted
        for run in (r for level in self.levels for r in level):
            fresh = fresh.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        counts = counted.select("h1", "h2", "n", F.lit(None).cast(counted.schema["owner"].dataType).alias("owner"))
        owners = fresh.select("h1", "h2", F.lit(0).cast("bigint").alias("n"), "owner")
        new, level = self._run(self._merged([counts, owners])), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fan_out:
                return
            new, self.levels[level], level = self._run(self._merged(self.levels[level])), [], level + 1

    def all(self) -> DataFrame:
        return self._merged([r for level in self.levels for r in level])

    def close(self) -> None:
        """Take the runs out of the catalog."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names.clear()


def _lines(text: str) -> Column:
    return F.split(text_or_empty(text), "\n", -1)


def line_hashes(docs: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """A row for every line whose key has `least_chars` code points or more: id, th (hash of the text), h1, h2, at, first (the
    first line with this key in its text)."""
    keys = F.transform(_lines(text), lambda x: ascii_lower(ascii_strip(x)))
    entry = F.transform(keys, lambda x, i: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), i.alias("at"), (F.char_length(x) >= least_chars).alias("long")))
    each = docs.select(F.col(key).alias("id"), F.xxhash64(text_or_empty(text)).alias("th"), F.array_sort(F.filter(entry, lambda e: e["long"])).alias("s"))
    first = lambda e, i: (i == 0) | (F.get(F.col("s"), i - 1)["h1"] != e["h1"]) | (F.get(F.col("s"), i - 1)["h2"] != e["h2"])
    flagged = F.transform("s", lambda e, i: F.struct(e["h1"].alias("h1"), e["h2"].alias("h2"), e["at"].alias("at"), first(e, i).alias("first")))
    return each.select("id", "th", F.inline(flagged))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 40, least_docs: int = 5, batches: int = 4, fan_out: int = 2) -> DataFrame:
    """The lines to drop: id, th, at (place in the text from 0), of keys that `least_docs` documents hold, except in the largest id."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx(F.col(key), [k / batches for k in range(batches - 1, 0, -1)], 1000)).first()[0] or []
    batch = F.lit(len(cuts))
    for k in range(len(cuts) - 1, -1, -1):
        batch = F.when(F.col("id") > cuts[k], k).otherwise(batch)
    hashed = line_hashes(docs, key, text, least_chars).withColumn("batch", batch)
    path = scratch_dir(spark, "lines")
    hashed.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(hashed.schema).parquet(path)
    runs = LineRuns(spark, fan_out=fan_out)
    try:
        for k in range(len(cuts) + 1):
            runs.add(lines.where(F.col("batch") == k))
        found = stored(runs.all().where(F.col("n") >= least_docs).select("h1", "h2", "owner"), "repeated")
    finally:
        runs.close()
    return lines.join(found, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("owner"))).select("id", "th", "at")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", kept: str = "kept_text", counts: tuple[str, str] = ("__n_lines", "__n_dropped"), **settings) -> DataFrame:
    """docs with every column, and kept (the lines that stay, joined by \\n) and counts (all lines, dropped ones), in place of columns
    so named.

    A null or empty text is one empty line.  Each row counts as a document; rows that repeat an id with the same text get the
    same lines dropped; a row with a null id counts and never owns a key while another id holds it.
    """
    i, t, d, th, ls = temporary("i", "t", "d", "th", "ls")
    drop = repeated_lines(docs, key, text, **settings).groupBy("id", "th").agg(F.collect_set("at").alias(d)).select(F.col("id").alias(i), F.col("th").alias(t), d)
    hashed = docs.withColumn(th, F.xxhash64(text_or_empty(text)))
    joined = hashed.join(drop, F.col(key).eqNullSafe(F.col(i)) & (F.col(th) == F.col(t)), "left").withColumn(ls, _lines(text))
    stay = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(d))
    rest = F.array_join(F.transform(stay, lambda k: F.get(F.col(ls), k)), "\n")
    new = {kept: F.when(F.col(d).isNull(), text_or_empty(text)).otherwise(rest), counts[0]: F.size(ls).cast("bigint"), counts[1]: F.coalesce(F.size(d), F.lit(0)).cast("bigint")}
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[v.alias(n) for n, v in new.items()])
