"""h-indexes that follow an ingest: stored histograms that new authors add to and replaced versions of authors subtract from.

Two append-only tables, each with a folder for every batch: `contributions` has the flat row of every author version that came, and
`histogram` the changes of counts, (level, institution_id, label, value) to a signed number.  A batch counts once its commit record is
there, written last, so a run that stops leaves nothing that is read; the same batch number may be written again.  Changes are sums,
so they merge in any order, and `fold` adds up those of many batches into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermark.operators.hindex import h_of_histogram
from tiermark.sources.files import Store

#: Level names, and the columns of the label and its name.
_LEVELS = {"institution": (None, None), "field": ("field", "field_name"), "subfield": ("subfield", "subfield_name")}
_FLAT = ["author_id", "h_index", "institution_id", "institution_name", "field", "field_name", "subfield", "subfield_name"]
_KEYS = ["level", "institution_id", "label", "value"]


def histogram_rows(flat: DataFrame, sign: int) -> DataFrame:
    """level, institution_id, label, value, name, n: what flat author rows add to (or take from) the counts, in one pass.

    Beside the three levels, whose value is h, level "name" counts how often an institution has a name (the label)."""
    value = F.floor("h_index").cast("bigint")
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    parts = [F.struct(F.lit(level).alias("level"), text(label).alias("label"), value.alias("value"), text(name).alias("name")) for level, (label, name) in _LEVELS.items()]
    parts.append(F.struct(F.lit("name").alias("level"), text("institution_name").alias("label"), F.lit(None).cast("bigint").alias("value"), F.lit(None).cast("string").alias("name")))
    each = flat.select("institution_id", F.inline(F.array(*parts))).where("level <> 'subfield' OR label IS NOT NULL").where("level <> 'name' OR label IS NOT NULL")
    return each.groupBy(*_KEYS).agg(F.max("name").alias("name"), (sign * F.count("*")).alias("n"))


class HistogramStore:
    """The two tables below a folder.  Author ids are unique within a batch; the batch of the greatest number has an author's
    latest version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, path)

    def batches(self) -> list[int]:
        """Numbers of the batches that count: committed and not folded into another."""
        names = [n for n in self.store.files(f"{self.path}/commits")]
        return sorted(int(n) for n in names)

    def _read(self, table: str, batches: list[int]) -> DataFrame | None:
        paths = [f"{self.path}/{table}/batch={b}" for b in batches]
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*paths) if paths else None

    def add(self, flat: DataFrame, batch: int) -> None:
        """Take in the flat rows (see author_table) of new and replaced authors as a batch of a number above all before it.

        An author that earlier batches have is taken out of the counts in its latest version before: of the contributions only rows
        with these ids are looked for, and of the authors that stay nothing is read but their ids."""
        done = self.batches()
        if batch in done:
            return
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        at = f"{self.path}/contributions/batch={batch}"
        flat.select(*_FLAT).write.mode("overwrite").parquet(at)
        new = self.spark.read.parquet(at)
        change = histogram_rows(new, 1)
        earlier = self._read("contributions", done)
        if earlier is not None:
            old = earlier.join(new.select("author_id"), "author_id", "left_semi")
            last = old.groupBy("author_id").agg(F.max_by(F.struct(*[c for c in _FLAT if c != "author_id"]), "batch").alias("v")).select("author_id", "v.*")
            change = change.unionByName(histogram_rows(last, -1)).groupBy(*_KEYS).agg(F.max("name").alias("name"), F.sum("n").alias("n")).where("n <> 0")
        change.write.mode("overwrite").parquet(f"{self.path}/histogram/batch={batch}")
        self.store.write_record(f"{self.path}/commits/{batch}", {"batch": batch})

    def fold(self) -> None:
        """Add up the changes of all batches in the last one's folder, so later reads open one folder.  The record of the fold is written
        when its sums are, so a stop leaves either the old folders in use or the new one."""
        done, folds = self.batches(), self.store.files(f"{self.path}/folds")
        if len(done) < 2 or str(done[-1]) in folds:
            return
        self.histogram().write.mode("overwrite").parquet(f"{self.path}/histogram/batch={done[-1]}-folded")
        self.store.write_record(f"{self.path}/folds/{done[-1]}", {"folded": done})

    def histogram(self) -> DataFrame:
        """level, institution_id, label, value, name, n: the counts as they stand."""
        done, folds = self.batches(), sorted(int(n) for n in self.store.files(f"{self.path}/folds"))
        last = folds[-1] if folds else None
        names = [*([f"{last}-folded"] if folds else []), *(b for b in done if last is None or b > last)]
        if not names:
            return self.spark.createDataFrame([], "level string, institution_id bigint, label string, value bigint, name string, n bigint")
        # each folder for itself: folder names are not all numbers
        parts = [self.spark.read.parquet(f"{self.path}/histogram/batch={b}").select(*_KEYS, "name", "n") for b in names]
        return reduce(DataFrame.unionByName, parts).groupBy(*_KEYS).agg(F.max("name").alias("name"), F.sum("n").alias("n")).where("n <> 0")

    def h2(self, level: str = "institution") -> DataFrame:
        """The same rows as the h2 tables of all authors in their latest versions: institution_id, (field or subfield and its name),
        institution_name, h2, author_count."""
        counts = self.histogram()
        names = counts.where("level = 'name'").groupBy("institution_id").agg(F.min_by("label", F.struct((-F.col("n")).alias("c"), F.col("label"))).alias("institution_name"))
        label, name = _LEVELS[level]
        some = counts.where(F.col("level") == level)
        keys = ["institution_id", *([label] if label else [])]
        if label:
            some = some.withColumnsRenamed({"label": label, "name": name})
        h = h_of_histogram(some.withColumnRenamed("n", "_c").withColumnRenamed("value", "_v"), keys, [name] if label else [], "h2", "author_count").where("h2 > 0")
        return h.join(names, "institution_id", "left").select(*keys, "institution_name", *([name] if label else []), "h2", "author_count")
