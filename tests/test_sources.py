"""Reading, staging, resuming, splitting and exporting on disk."""

import contextlib
import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiermark.functions.text import last_segment, partition_date, slug, unslug
from tiermark.plans import bindings
from tiermark.sources import snapshots
from tiermark.sources.manifest import Manifest
from tiermark.streaming.ingest import stage_new_files

SCHEMA = snapshots.author_schema(T.LongType())


def _raw(spark, sf, path, day="CASE WHEN id % 2 = 0 THEN '2024-01-01' ELSE '2024-01-02' END"):
    wide = bindings.snapshot(spark, sf).withColumn("updated_date", F.expr(day).cast("date"))
    wide = wide.select(F.col("id").cast("string").alias("id"), F.struct("h_index", F.lit(9.9).alias("mean")).alias("summary_stats"), "works_count", "affiliations", "topics", F.lit("never read").alias("extra"), "updated_date")
    wide.write.partitionBy("updated_date").mode("append").parquet(path)


def test_staging_resumes_and_repairs(spark, sf, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    _raw(spark, sf, src)
    assert len(snapshots.ingest_new_partitions(spark, src, dst, schema=SCHEMA)) == 2
    assert snapshots.ingest_new_partitions(spark, src, dst, schema=SCHEMA) == []
    before = {r["updated_date"]: r["n_rows"] for r in snapshots.audit_partitions(spark, dst).collect()}
    day = min(before)
    spark.range(3).select(F.col("id").cast("string")).write.mode("overwrite").parquet(f"{dst}/updated_date={day}")
    assert {str(r["updated_date"]): r["missing"] for r in snapshots.audit_partitions(spark, dst).collect()}[str(day)] == "affiliations,h_index,topics,works_count"
    assert snapshots.ingest_new_partitions(spark, src, dst, schema=SCHEMA) == [day]
    assert {r["updated_date"]: r["n_rows"] for r in snapshots.audit_partitions(spark, dst).collect()} == before


def test_only_needed_leaves_are_read(spark, sf, tmp_path):
    src = str(tmp_path / "src")
    _raw(spark, sf, src)
    plan = snapshots.read_snapshot(spark, src, SCHEMA).where("summary_stats.h_index > 0 AND updated_date = '2024-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "extra" not in plan and "mean" not in plan
    assert "PartitionFilters: [isnotnull(updated_date" in plan and "summary_stats.h_index" in plan.split("PushedFilters")[1]


def test_stream_takes_each_file_once(spark, sf, tmp_path):
    src, dst, mark = (str(tmp_path / x) for x in ("src", "dst", "mark"))
    _raw(spark, sf, src)
    stage_new_files(spark, src, dst, mark, SCHEMA)
    n = spark.read.parquet(dst).count()
    stage_new_files(spark, src, dst, mark, SCHEMA)
    assert spark.read.parquet(dst).count() == n > 0
    _raw(spark, sf, src, "'2024-01-03'")
    stage_new_files(spark, src, dst, mark, SCHEMA)
    assert spark.read.parquet(dst).count() == 2 * n


def test_compaction_split_and_csv(spark, sf, tmp_path):
    many, few = str(tmp_path / "many"), str(tmp_path / "few")
    spark.range(1000).repartition(20).write.parquet(many)
    snapshots.compact(spark, many, few, 2)
    assert spark.read.parquet(few).count() == 1000 and len(list((tmp_path / "few").glob("*.zstd.parquet"))) == 2
    df = spark.createDataFrame([("Business, Management and Accounting", "NA", 3), ("Law", None, 2), ("Law", "US", 5)], "field_name string, code string, h bigint")
    snapshots.write_split(df, "field_name", [F.desc("h")], str(tmp_path / "split"))
    assert sorted(p.name for p in (tmp_path / "split").glob("slug=*")) == ["slug=Business__Management_and_Accounting", "slug=Law"]
    law = [line for p in (tmp_path / "split" / "slug=Law").glob("*.csv") for line in p.read_text().splitlines()[1:]]
    assert [line.split(",")[-1] for line in law] == ["5", "2"]
    snapshots.write_table_csv(df, str(tmp_path / "csv"))
    back = snapshots.read_table_csv(spark, str(tmp_path / "csv"), "field_name string, code string, h bigint")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_country_map_keeps_na(spark):
    df = spark.createDataFrame([("i1", "NA"), ("i2", None)], "id string, country_code string")
    assert [tuple(r) for r in snapshots.country_map(df).collect()] == [("i1", "NA")]


def test_samples(spark, tmp_path):
    path = str(tmp_path / "works")
    spark.range(1000).select("id", (F.col("id") % 3).alias("cited_by_count"), (F.col("id") % 10).alias("day")).repartition(4).write.partitionBy("day").parquet(path)
    works = spark.read.parquet(path)
    some = snapshots.sample_partitions(works, "day", 4)
    assert sorted(r[0] for r in some.select("day").distinct().collect()) == [0, 3, 6, 9]
    got = snapshots.citation_sample(works, "day", 4)
    assert got.columns == ["id", "cited_by_count"] and got.where("cited_by_count = 0").isEmpty()
    assert snapshots.sample_partitions(works, "day", 99).count() == 1000


def test_first_files_are_found_by_listing(spark, tmp_path):
    """The plan opens the first file of each chosen partition and no other; partitions without a file are passed over."""
    path = str(tmp_path / "works")
    spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("cited_by_count"), (F.col("id") % 10).alias("day")).repartition(4).write.partitionBy("day").parquet(path)
    got = snapshots.citation_sample_of_files(spark, path, "day", 4)
    files = got.inputFiles()
    assert len(files) == 4 and sorted(f.split("/day=")[1][0] for f in files) == ["0", "3", "6", "9"]
    for f in files:
        folder = tmp_path / "works" / f"day={f.split('/day=')[1][0]}"
        assert f.rsplit("/", 1)[1] == min(x.name for x in folder.glob("*.parquet"))
    assert got.columns == ["id", "cited_by_count"] and 0 < got.count() < 400 and got.where("cited_by_count = 0").isEmpty()
    (tmp_path / "works" / "day=a-none").mkdir()
    assert len(snapshots.first_file_paths(spark, path, "day", 99)) == 10
    assert snapshots.citation_sample_of_files(spark, str(tmp_path / "nothing"), "day", 4).isEmpty()


class _Stop(Exception):
    pass


class _Stopping(Manifest):
    """Stops before or after its n-th change to the file system."""

    def __init__(self, spark, table, left, before):
        super().__init__(spark, table)
        self.left, self.before = left, before
        for name in ("write_record", "move", "delete"):
            setattr(self.store, name, self._counted(getattr(self.store, name)))

    def _counted(self, f):
        def run(*a):
            self.left -= 1
            if self.left <= 0 and self.before:
                raise _Stop
            f(*a)
            if self.left <= 0:
                raise _Stop

        return run


def _staged_rows(spark, dst):
    return sorted((str(r["updated_date"]), r["id"]) for r in spark.read.parquet(dst).select("updated_date", "id").collect())


def test_ingest_may_stop_anywhere(spark, sf, tmp_path):
    """Stopped before or after any single change, the next run ends with every date once, and outdated dates renewed."""
    src, good = str(tmp_path / "src"), str(tmp_path / "good")
    _raw(spark, sf, src)
    snapshots.ingest_new_partitions(spark, src, good, schema=SCHEMA)
    want, stops = _staged_rows(spark, good), 0
    for n in range(1, 40):
        dst, before = str(tmp_path / f"dst{n}"), n % 2 == 0
        snapshots.stage_authors(spark, src, dst, [datetime.date(2024, 1, 1)], SCHEMA)
        spark.range(3).select(F.col("id").cast("string")).write.mode("overwrite").parquet(f"{dst}/updated_date=2024-01-01")  # outdated
        try:
            snapshots.ingest_new_partitions(spark, src, dst, schema=SCHEMA, manifest=_Stopping(spark, dst, n, before))
        except _Stop:
            stops += 1
            if n % 4 == 1:  # and once more, while the first stop is being mended
                with contextlib.suppress(_Stop):
                    snapshots.ingest_new_partitions(spark, src, dst, schema=SCHEMA, manifest=_Stopping(spark, dst, 2, before))
            snapshots.ingest_new_partitions(spark, src, dst, schema=SCHEMA)
            assert _staged_rows(spark, dst) == want, n
        else:
            assert _staged_rows(spark, dst) == want
            break
    assert stops >= 8


def test_stop_while_the_staging_job_runs(spark, sf, tmp_path, monkeypatch):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    _raw(spark, sf, src)
    whole = snapshots.stage_authors

    def half(spark, src, path, dates, schema):
        whole(spark, src, path, dates[:1], schema)
        raise _Stop

    monkeypatch.setattr(snapshots, "stage_authors", half)
    with pytest.raises(_Stop):
        snapshots.ingest_new_partitions(spark, src, dst, schema=SCHEMA)
    monkeypatch.setattr(snapshots, "stage_authors", whole)
    assert len(snapshots.ingest_new_partitions(spark, src, dst, schema=SCHEMA)) == 2
    assert not list((tmp_path / "dst.staging").glob("*")) and len(list((tmp_path / "dst.manifest").glob("*.intent"))) == 1


def test_audit_is_one_job(spark, sf, tmp_path):
    """However many files there are; and reading says the same as the footers."""
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    _raw(spark, sf, src)
    snapshots.ingest_new_partitions(spark, src, dst, schema=SCHEMA)
    for k in range(12):
        spark.range(5).select(F.col("id").cast("string"), F.lit(1).cast("bigint").alias("h_index")).coalesce(1).write.mode("append").parquet(f"{dst}/updated_date=2024-01-0{1 + k % 2}")
    group, tracker = "audit", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, "")
    rows = {str(r["updated_date"]): (r["n_rows"], r["missing"]) for r in snapshots.audit_partitions(spark, dst).collect()}
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    counts = {str(r["updated_date"]): r["count"] for r in spark.read.schema("updated_date date").parquet(dst).groupBy("updated_date").count().collect()}
    assert rows == {d: (n, "affiliations,topics,works_count") for d, n in counts.items()} and jobs <= 2  # the shuffle's map side may count as a job of its own
    read = snapshots._values(spark, dst, snapshots.STAGED).collect()
    assert len(read) >= 14 and {tuple(r["missing"]) for r in read} == {(), ("affiliations", "topics", "works_count")}


def test_packing():
    assert snapshots.pack({"a": 5, "b": 4, "c": 3, "d": 2, "e": 9}, 9) == [["e"], ["a", "b"], ["c", "d"]]
    assert snapshots.pack({}, 9) == [] and snapshots.pack({"a": 20, "b": 1}, 9) == [["a"], ["b"]]


def test_small_files_are_packed(spark, tmp_path):
    """Sizes near the target, large files and partitions untouched, same rows, also when stopped on the way."""
    path = str(tmp_path / "t")
    wide = spark.range(60000).select("id", (F.col("id") % 2).alias("day"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    wide.repartition(40).write.partitionBy("day").parquet(path)
    spark.range(60000).select("id", F.sha2((-F.col("id")).cast("string"), 256).alias("x")).coalesce(1).write.mode("append").parquet(f"{path}/day=1")
    large = max((tmp_path / "t" / "day=1").glob("*.parquet"), key=lambda p: p.stat().st_size)
    rows, stamp = sorted(map(tuple, spark.read.parquet(path).collect())), large.stat().st_mtime_ns
    small = sum(p.stat().st_size for p in (tmp_path / "t" / "day=0").glob("*.parquet"))
    target = small // 3
    with pytest.raises(_Stop):
        snapshots.compact_small_files(spark, path, "day", target, manifest=_Stopping(spark, path, 20, True))
    snapshots.compact_small_files(spark, path, "day", target)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == rows
    assert large.exists() and large.stat().st_mtime_ns == stamp
    for day in (0, 1):
        sizes = sorted(p.stat().st_size for p in (tmp_path / "t" / f"day={day}").glob("*.parquet") if p != large)
        assert len(sizes) <= 5 and sum(0.8 * target <= s <= 1.2 * target for s in sizes) >= len(sizes) - 1, (sizes, target)
    assert snapshots.compact_small_files(spark, str(tmp_path / "none"), "day", target) == 0


def test_rankings_document(spark, sf, tmp_path):
    i = bindings.Index(spark, sf)
    doc = snapshots.rankings_document(i.h2, i.h3, i.h2_field, i.h3_field, i.h2_subfield, i.h3_subfield, k=3)
    snapshots.write_rankings(doc, str(tmp_path / "doc"))
    rows = [json.loads(line) for p in (tmp_path / "doc").glob("*.json") for line in p.read_text().splitlines()]
    assert {r["level"] for r in rows} == {"overall", "field", "subfield"}
    for r in rows:
        for side, h in (("institutions", "h2"), ("countries", "h3")):
            values = [x[h] for x in r.get(side, [])]
            assert values == sorted(values, reverse=True) and [x["rank"] for x in r.get(side, [])] == list(range(1, len(values) + 1))
            assert r["level"] == "overall" or len(values) <= 3


def test_text_functions(spark):
    df = spark.createDataFrame([("Business, Management and Accounting", "https://x/y/A12", "s/updated_date=2024-05-06/f.parquet"), ("Ärzte-Kammer!", "A", "none")], "a string, b string, c string")
    rows = df.select(slug(F.col("a")), unslug(slug(F.col("a"))), last_segment(F.col("b")), partition_date(F.col("c")).cast("string")).collect()
    assert tuple(rows[0]) == ("Business__Management_and_Accounting", "Business, Management and Accounting", "A12", "2024-05-06")
    assert tuple(rows[1]) == ("Ärzte-Kammer", "Ärzte-Kammer", "A", None)


def test_a_date_without_a_row_is_finished_too(spark, tmp_path):
    """No author of the date passes the filter, so it has no staged folder; the second run leaves it alone all the same."""
    from pyspark.sql import functions as F

    src, dst = str(tmp_path / "raw"), str(tmp_path / "staged")
    row = spark.createDataFrame([("a1", 0)], "id string, h bigint").select("id", F.struct(F.col("h").alias("h_index")).alias("summary_stats"), F.lit(3).cast("bigint").alias("works_count"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in snapshots.author_schema().fields if f.name in ("affiliations", "topics")], F.lit("2024-03-01").cast("date").alias("updated_date"))
    row.write.partitionBy("updated_date").parquet(src)
    assert len(snapshots.ingest_new_partitions(spark, src, dst)) == 1
    assert snapshots.ingest_new_partitions(spark, src, dst) == []
    assert snapshots.audit_partitions(spark, dst).count() == 0
