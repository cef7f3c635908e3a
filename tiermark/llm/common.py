"""What several operators share: the scratch folder that all executors see, stored intermediate tables, blob files."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import tiermark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.sources.files import Store

#: The end-of-file byte of every blob file, see write_blobs.
_END = "\0"
_BLANKS = " \t\n\x0b\x0c\r"
#: The folder of every stored table, see forget.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.  Where that is unset a temporary folder is taken,
    in local mode alone: on a cluster executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries formed and run inside go with the end of each, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the scratch folder and read back: the lineage ends, lost executors cost nothing, a later
    join sees plain exchanges on both sides (which adaptive execution may split where a key is hot)."""
    path = scratch_dir(df.sparkSession, tag)
    with brief_shuffles(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete the files of stored tables that neither a later step nor a returned frame reads."""
    for t in tables:
        if path := _FOLDERS.pop(t, None):
            Store(t.sparkSession, path).delete(path)


def write_blobs(blobs: DataFrame, column: str, path: str) -> None:
    """Write each value of a binary column as a file of its own, byte for byte, through Spark's writer and its commit protocol.

    Spark's text writer ends every row with the line separator; here that is one zero byte, so a blob must end in a zero
    byte, which is cut off first.  Formats with another ending append one.
    """
    body = F.expr(f"substring(`{column}`, 1, octet_length(`{column}`) - 1)").cast("string")
    blobs.select(body.alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", 1).text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Columns path and content, one row a file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").where("length(content) > 1")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else.  Texts of ASCII alone take the quick way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def ascii_strip(c: Column) -> Column:
    r"""Without [\x20\x09-\x0D] at both ends."""
    return F.btrim(c, F.lit(_BLANKS))


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, for callers whose workers don't find it by themselves; and where
    Arrow batches have Spark's default of 10,000 rows, which may be whole long texts, make them 1,000."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    sc, name = spark.sparkContext, "tiermark.zip"
    if not any(f.endswith("/" + name) for f in sc.listFiles):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        top = os.path.dirname(os.path.dirname(os.path.abspath(tiermark.__file__)))
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "tiermark"), "zip", top, "tiermark"))


def temporary(*names: str) -> list[str]:
    """Column names that no table has."""
    tail = uuid.uuid4().hex
    return [f"{n}_{tail}" for n in names]


def _components(edges: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root (the smallest node reachable) of the edges u, v of one task."""
    up: dict = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in edges:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(u), top(v)
            up[max(a, b)] = min(a, b)
        kind = batch.schema.types[0]
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(x) for x in list(up)], kind)], names=["node", "root"])


def connected(links: DataFrame, few: int = 100_000) -> DataFrame:
    """Columns node and root (the smallest node reachable) for every node of links (a, b), stored, by alternating large and small
    stars; every step is a grouped minimum and a join, its result is a written table, and the end is told by a checksum.
    Where no more than `few` distinct links are given or left, they are not worth steps of their own: one task joins them up."""
    edges, last = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        with brief_shuffles(edges.sparkSession):
            n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if 0 < n <= few:
            u = edges.schema["u"].dataType.simpleString()
            roots = stored(edges.coalesce(1).mapInArrow(_components, f"node {u}, root {u}"), "roots")
            forget(edges)
            return roots
        if not n or (n, total) == last:
            ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")))
            roots = stored(ends.groupBy("node").agg(F.min("root").alias("root")), "roots")
            forget(edges)
            return roots
        last = (n, total)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")  # repeats go with the last step
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        before, edges = edges, stored(down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(before)


def joined_further(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """node and root, stored, of the components that links (a, b) form on top of those in roots (None: of none).  Only the links
    between roots go through `connected`, so what is joined already isn't worked on again."""
    if roots is None:
        return connected(links)
    if links.isEmpty():
        return roots
    for end in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    links = stored(links, "between-roots")
    more = connected(links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    new = [links.where(f"root_{end} IS NULL").select(F.col(end).alias("node")) for end in ("a", "b")]
    nodes = roots.select("node", "root").unionByName(new[0].union(new[1]).distinct().select("node", F.col("node").alias("root")))
    new_roots = more.select(F.col("node").alias("root"), F.col("root").alias("to"))
    further = stored(nodes.join(new_roots, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    forget(links, more)
    return further


def keep_first(docs: DataFrame, key: str, text: str, kept: DataFrame) -> DataFrame:
    """Rows of docs, all columns, whose key and text hash are in kept (id, th, no repeats), once each (of repeats the one of the
    smallest hash over all columns), and all rows with a null key."""
    k, h, th, n = temporary("k", "h", "th", "n")
    hashed = docs.where(F.col(key).isNotNull()).withColumn(th, F.xxhash64(text_or_empty(text)))
    found = hashed.join(kept.select(F.col("id").alias(k), F.col("th").alias(h)), (F.col(key) == F.col(k)) & (F.col(th) == F.col(h)), "left_semi")
    first = Window.partitionBy(key, th).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    one = found.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(n, th)
    return one.unionByName(docs.where(F.col(key).isNull()))
