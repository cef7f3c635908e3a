"""Partitioned snapshots in, staged and derived tables out."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tiermark.functions.text import slug
from tiermark.operators.assign import staged_filter
from tiermark.sources.files import Store
from tiermark.sources.manifest import Manifest

_LABEL = T.StructType([T.StructField("id", T.StringType()), T.StructField("display_name", T.StringType())])


def author_schema(institution_id: T.DataType | None = None) -> T.StructType:
    """Only the leaves that are used: arrays of structs are not pruned by the optimizer, so the narrow schema does it."""
    institution = T.StructType([T.StructField("id", institution_id or T.StringType()), T.StructField("display_name", T.StringType()), T.StructField("type", T.StringType())])
    affiliation = T.StructType([T.StructField("institution", institution), T.StructField("years", T.ArrayType(T.IntegerType()))])
    topic = T.StructType([T.StructField("id", T.StringType()), T.StructField("display_name", T.StringType()), T.StructField("count", T.LongType()), *(T.StructField(v, _LABEL) for v in ("subfield", "field", "domain"))])
    return T.StructType([T.StructField("id", T.StringType()), T.StructField("summary_stats", T.StructType([T.StructField("h_index", T.LongType())])), T.StructField("works_count", T.LongType()), T.StructField("affiliations", T.ArrayType(affiliation)), T.StructField("topics", T.ArrayType(topic))])


#: Columns that a staged partition must have.
STAGED = ["id", "h_index", "works_count", "affiliations", "topics"]


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A partitioned Parquet snapshot; updated_date=... folders become a column.  An explicit schema reads its leaves alone."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField("updated_date", T.DateType())]))
    return reader.parquet(path)


def stage_authors(spark: SparkSession, src: str, dst: str, dates: list | None = None, schema: T.StructType | None = None) -> None:
    """Filtered authors in the staged form, by updated_date.  With dates only those partitions are read and replaced."""
    raw = read_snapshot(spark, src, schema or author_schema())
    if dates is not None:
        raw = raw.where(F.col("updated_date").isin(dates))
    staged = staged_filter(raw.select("id", F.col("summary_stats.h_index").alias("h_index"), "works_count", "affiliations", "topics", "updated_date"))
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("updated_date").option("compression", "zstd").parquet(dst)


def _dates(spark: SparkSession, path: str) -> list[datetime.date]:
    """The dates that a snapshot has folders for."""
    names = Store(spark, path).folders(path)
    return sorted(datetime.date.fromisoformat(n.removeprefix("updated_date=")) for n in names if n.startswith("updated_date="))


def table_files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of the Parquet files below a folder, as Spark lists them; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path", "length")


def _footers(required: list[str]):
    """A function for mapInArrow: path, rows and which of the required columns are missing, by the footers of files."""

    def read(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            rows, missing = [], []
            for path in batch.column("path").to_pylist():
                at, name = fs.FileSystem.from_uri(path)
                with at.open_input_file(name) as f:
                    footer = pq.ParquetFile(f).metadata
                rows.append(footer.num_rows)
                missing.append(sorted(set(required) - set(footer.schema.to_arrow_schema().names)))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(rows, pa.int64()), pa.array(missing, pa.list_(pa.string()))], ["path", "n", "missing"])

    return read


def _values(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """The same by reading: a column without any value in a file with rows counts as missing there."""
    seen = spark.read.option("mergeSchema", True).parquet(path)
    found = [F.when((F.count("*") > 0) & (F.count(c) == 0), F.lit(c)) if c in seen.columns else F.lit(c) for c in required]
    kept = lambda a: F.array_sort(F.filter(a, lambda x: x.isNotNull()))
    return seen.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"), kept(F.array(*found)).alias("missing"))


def _footers_open_to_python(path: str) -> bool:
    """Whether Python tasks can open files of this path's file system themselves."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    except Exception:  # of many kinds: unknown scheme, no client library
        return False
    return True


def audit_partitions(spark: SparkSession, path: str, required: list[str] = STAGED) -> DataFrame:
    """updated_date, n_rows, missing: which of the required columns one of a partition's files lacks.

    One job for any number of files: Spark's list of files is dealt out, tasks read the footers (schema and number of rows, no data),
    and the findings are grouped by partition.  In a file system that only Spark can open, the files are read in one job."""
    if not _dates(spark, path):
        return spark.createDataFrame([], "updated_date date, n_rows bigint, missing string")
    if _footers_open_to_python(path):
        files = table_files(spark, path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
        each = files.mapInArrow(_footers(required), "path string, n bigint, missing array<string>")
    else:
        each = _values(spark, path, required)
    date = F.regexp_extract("path", "/updated_date=([^/]+)/", 1).cast("date")
    return each.groupBy(date.alias("updated_date")).agg(F.sum("n").alias("n_rows"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("missing")))), ",").alias("missing"))


def ingest_new_partitions(spark: SparkSession, src: str, dst: str, required: list[str] = STAGED, schema: T.StructType | None = None, manifest: Manifest | None = None) -> list:
    """Stage the partitions that are not staged yet or lack a required column; which ones that were.

    In two phases (see manifest): a run that stops, wherever, is ended or undone by the next, and every date is there once.  A date is
    done when a finished record names it, as the filter may leave no row of one and so no folder, or when its folder was there before;
    an outdated folder is replaced, not deleted first."""
    manifest = manifest or Manifest(spark, dst)
    manifest.recover()
    finished = {datetime.date.fromisoformat(d) for r in manifest.finished() for d in r.get("dates", [])}
    audited = {r["updated_date"]: r["missing"] for r in audit_partitions(spark, dst, required).collect()}  # a row a date
    todo = [d for d in _dates(spark, src) if audited.get(d) or d not in finished | set(audited)]
    if todo:
        folders = [f"updated_date={d}" for d in todo]
        manifest.change({"dates": [str(d) for d in todo]}, lambda path: stage_authors(spark, src, path, todo, schema), lambda _: {f: list(manifest.store.files(f"{dst}/{f}")) for f in folders})
    return todo


def compact(spark: SparkSession, src: str, dst: str, files: int, rows_per_file: int = 0, block_bytes: int = 128 << 20) -> None:
    """Many files to few, ZSTD, in row groups of block_bytes."""
    out = spark.read.parquet(src).repartition(files).write.mode("overwrite").option("compression", "zstd")
    out.option("maxRecordsPerFile", rows_per_file).option("parquet.block.size", block_bytes).parquet(dst)


def pack(sizes: dict[str, int], target: int) -> list[list[str]]:
    """First fit decreasing: names in bins of at most target (a larger one alone in its bin), largest first."""
    bins: list[tuple[list[str], int]] = []
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        k = next((k for k, (_, full) in enumerate(bins) if full + size <= target), None)
        if k is None:
            bins.append(([name], size))
        else:
            bins[k] = ([*bins[k][0], name], bins[k][1] + size)
    return [names for names, _ in bins]


def compact_small_files(spark: SparkSession, table: str, column: str, target: int = 512 << 20, small: float = 0.6, manifest: Manifest | None = None) -> int:
    """Rewrite the small files (below small x target bytes) of each partition of a table into files of about target bytes; how many
    files were rewritten.

    Lengths from the listing are packed, partition by partition; every bin is read and written by one task; large files, and small ones
    with no company, are not touched, partitions stay.  The files are exchanged in two phases (see manifest)."""
    manifest = manifest or Manifest(spark, table)
    manifest.recover()
    store, bins = manifest.store, []
    for partition in store.folders(manifest.table):
        sizes = {n: size for n, size in store.files(f"{manifest.table}/{partition}").items() if size < small * target}
        bins += [(partition, names) for names in pack(sizes, target) if len(names) > 1]
    if not bins:
        return 0
    listed = [(f"{partition}/{name}", k) for k, (partition, names) in enumerate(bins) for name in names]
    replaced = {p: [n for q, names in bins if q == p for n in names] for p, _ in bins}

    def write(path: str) -> None:
        rows = spark.read.option("basePath", manifest.table).parquet(*[f"{manifest.table}/{f}" for f, _ in listed])
        of = spark.createDataFrame(listed, "_file string, _bin int")
        named = rows.withColumn("_file", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1))
        dealt = named.join(F.broadcast(of), "_file").drop("_file")  # a row a file of the list
        dealt.repartitionByRange(len(bins), "_bin").drop("_bin").write.partitionBy(column).option("compression", "zstd").parquet(path)

    manifest.change({"compacted": len(listed)}, write, lambda _: replaced)
    return len(listed)


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> dict:
    """The only row of a report, for a later step."""
    rows = spark.read.schema(schema).json(path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"a report has one row, {path} has {'none' if not rows else 'more'}")
    return rows[0].asDict()


def spread_places(n_items: int, n: int) -> list[int]:
    """n places out of n_items, evenly spread, both ends included (halves to even)."""
    if n >= n_items:
        return list(range(n_items))
    if n == 1:
        return [0]
    return sorted({round(i * (n_items - 1) / (n - 1)) for i in range(n)})


def sample_partitions(df: DataFrame, column: str, n: int) -> DataFrame:
    """The rows of n partitions, evenly spread over the sorted distinct values of a partition column."""
    values = df.select(column).distinct().where(F.col(column).isNotNull())
    order = Window.orderBy(column)  # over partition values, not rows
    numbered = values.select(column, (F.row_number().over(order) - 1).alias("_i"), F.count("*").over(Window.partitionBy()).alias("_m"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_m") - 1) / max(1, n - 1)).cast("bigint"))
    chosen = numbered.where((F.col("_m") <= n) | F.array_contains(steps, F.col("_i").cast("bigint"))).select(column)
    return df.join(F.broadcast(chosen), column, "left_semi")  # n rows at most


def first_file_paths(spark: SparkSession, table: str, column: str, n: int) -> list[str]:
    """The first file, by name, of each of n partitions that are evenly spread over the sorted ones: found by listing alone."""
    store, table = Store(spark, table), table.rstrip("/")
    folders = [f for f in store.folders(table) if f.startswith(f"{column}=")]
    chosen = [folders[k] for k in spread_places(len(folders), n)]
    first = [(f, next((n for n in store.files(f"{table}/{f}") if n.endswith(".parquet")), None)) for f in chosen]
    return [f"{table}/{f}/{name}" for f, name in first if name]


def citation_sample(works: DataFrame, column: str, n: int) -> DataFrame:
    """id and cited_by_count above 0 of n spread partitions."""
    return sample_partitions(works, column, n).where("cited_by_count > 0").select("id", "cited_by_count")


def citation_sample_of_files(spark: SparkSession, table: str, column: str, n: int, schema: str = "id string, cited_by_count bigint") -> DataFrame:
    """The same of the first file of each of n spread partitions of a table on disk; no other file is opened."""
    paths = first_file_paths(spark, table, column, n)
    rows = spark.read.schema(schema).option("basePath", table).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.where("cited_by_count > 0").select("id", "cited_by_count")


def country_map(institutions: DataFrame) -> DataFrame:
    """id, country_code of institutions with a country."""
    return institutions.where("country_code IS NOT NULL").select("id", "country_code")


def read_table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header by an explicit schema: "NA" stays a code, an empty field is null."""
    return spark.read.schema(schema).csv(path, header=True)


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_split(df: DataFrame, label: str, order: list, path: str) -> None:
    """One folder a label (named by its slug; the label stays a column), rows in order, in one job."""
    out = df.withColumn("slug", slug(F.col(label)))
    out.repartition("slug").sortWithinPartitions("slug", *order).write.mode("overwrite").partitionBy("slug").option("header", True).csv(path)


def rankings_document(h2: DataFrame, h3: DataFrame, h2_field: DataFrame, h3_field: DataFrame, h2_subfield: DataFrame, h3_subfield: DataFrame, k: int = 100) -> DataFrame:
    """level, label, institutions (array of rank, name, h2) and countries (rank, name, h3): complete lists overall, the
    first k for every field and subfield; a label on one side only has null on the other."""

    def lists(df: DataFrame, level: str, label: str | None, name: str, h: str, alias: str) -> DataFrame:
        named = df.select((F.col(label) if label else F.lit("(overall)")).alias("label"), F.col(name).alias("name"), F.col(h).alias(h))
        if label:
            named = named.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc(h), "name"))).where(F.col("rank") <= k).drop("rank")
        key = F.struct((-F.col(h)).alias("_h"), "name", h)
        grouped = named.groupBy("label").agg(F.array_sort(F.collect_list(key)).alias("l"))
        return grouped.select(F.lit(level).alias("level"), "label", F.transform("l", lambda x, i: F.struct((i + 1).cast("bigint").alias("rank"), x["name"].alias("name"), x[h].alias(h))).alias(alias))

    out = None
    for level, label_2, label_3, a, b in (("overall", None, None, h2, h3), ("field", "field_name", "field_name", h2_field, h3_field), ("subfield", "subfield_name", "subfield_name", h2_subfield, h3_subfield)):
        both = lists(a, level, label_2, "institution_name", "h2", "institutions").join(lists(b, level, label_3, "country_code", "h3", "countries"), ["level", "label"], "full_outer")
        out = both if out is None else out.unionByName(both)
    return out


def write_rankings(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").json(path)
