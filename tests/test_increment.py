"""Histograms that follow an ingest, one pass for all levels, and the plans of the author table."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tiermark.operators import assign, hindex, increment
from tiermark.plans import bindings

FLAT = "author_id bigint, h_index bigint, institution_id bigint, institution_name string, field string, field_name string, subfield string, subfield_name string"


def _author(r, i):
    k, f, s = r.randrange(4), r.choice("fg"), r.choice(["s", "t", None])
    return (i, r.randrange(1, 9), k, r.choice([f"I{k}", f"i{k}", None]), f, f.upper(), s, s and s.upper())


def _rebuilt(spark, rows):
    df = assign.canonical_name(spark.createDataFrame(rows, FLAT), "institution_id", "institution_name")
    return [sorted(map(tuple, t.collect()), key=str) for t in (hindex.h2_by_institution(df), hindex.h2_by_institution_field(df).select("institution_id", "field", "institution_name", "field_name", "h2", "author_count"), hindex.h2_by_institution_subfield(df).select("institution_id", "subfield", "institution_name", "subfield_name", "h2", "author_count"))]


def _stored(store):
    return [sorted(map(tuple, store.h2(level).collect()), key=str) for level in ("institution", "field", "subfield")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_inserts_and_replacements_equal_a_rebuild(spark, tmp_path, seed):
    r, now = random.Random(seed), {}
    store = increment.HistogramStore(spark, str(tmp_path / "store"))
    assert _stored(store) == [[], [], []]
    for batch in range(1, 6):
        rows = [_author(r, i) for i in r.sample(range(60), r.randint(1, 30))]
        now |= {row[0]: row for row in rows}
        store.add(spark.createDataFrame(rows, FLAT), batch)
        if r.random() < 0.5:
            store.fold()
        if batch in (2, 5):
            assert _stored(store) == _rebuilt(spark, list(now.values()))
    assert store.histogram().where("n < 0").isEmpty()


def test_a_batch_counts_when_it_is_committed_and_once(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    rows, more = [_author(r, i) for i in range(20)], [_author(r, i) for i in range(10, 30)]
    store = increment.HistogramStore(spark, str(tmp_path / "store"))
    store.add(spark.createDataFrame(rows, FLAT), 1)
    first, commit = _stored(store), store.store.write_record

    def stop(*a):
        raise OSError

    store.store.write_record = stop
    with pytest.raises(OSError):
        store.add(spark.createDataFrame(more, FLAT), 2)
    with pytest.raises(OSError):
        store.store.write_record = stop
        store.batches = lambda: [1, 1]
        store.fold()
    del store.batches
    assert _stored(store) == first
    store.store.write_record = commit
    for _ in range(2):
        store.add(spark.createDataFrame(more, FLAT), 2)
        store.fold()
    want = _rebuilt(spark, list(({row[0]: row for row in rows} | {row[0]: row for row in more}).values()))
    assert _stored(store) == want
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame(more, FLAT), 0)


def test_what_stays_is_not_read(spark, tmp_path):
    """The search for replaced versions reads ids of the contributions; the counts of the authors that stay come from no author row."""
    store = increment.HistogramStore(spark, str(tmp_path / "store"))
    for b in (1, 2):
        store.add(spark.createDataFrame([_author(random.Random(b), i) for i in range(5)], FLAT), b)
    plan = store.h2()._jdf.queryExecution().optimizedPlan().toString()
    assert "author_id" not in plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_levels_in_one_scan(spark, sf):
    authors = bindings.authors(spark, sf)
    plan = _plan(hindex.h2_levels(authors))
    assert len(re.findall(r"FileScan parquet", plan)) == 1 and plan.count("Expand") == 1
    rows = {(x["level"], x["institution_id"], x["label"]): (x["h2"], x["author_count"]) for x in hindex.h2_levels(authors).collect()}
    one = {("institution", x["institution_id"], None): (x["h2"], x["author_count"]) for x in hindex.h2_by_institution(authors).collect()}
    two = {("field", x["institution_id"], x["field"]): (x["h2"], x["author_count"]) for x in hindex.h2_by_institution_field(authors).collect()}
    three = {("subfield", x["institution_id"], x["subfield"]): (x["h2"], x["author_count"]) for x in hindex.h2_by_institution_subfield(authors).collect()}
    assert rows == one | two | three


def test_levels_with_nulls(spark):
    df = spark.createDataFrame([(1, 5, 1, "I", None, None, None, None), (2, 3, 1, "I", "f", "F", None, None), (3, None, None, None, "f", "F", "s", "S"), (4, 2, None, None, "f", "F", "s", "S")], FLAT)
    got = {(x["level"], x["institution_id"], x["label"], x["h2"], x["author_count"]) for x in hindex.h2_levels(df).collect()}
    assert got == {("institution", 1, None, 2, 2), ("institution", None, None, 1, 2), ("field", 1, None, 1, 1), ("field", 1, "f", 1, 1), ("field", None, "f", 1, 2), ("subfield", None, "s", 1, 2)}


def test_no_exchange_under_the_aggregate(spark, sf):
    """The author table is bucketed by institution, so its rows are counted where they lie."""
    for df in (hindex.h2_by_institution(bindings.authors(spark, sf)), hindex.h2_by_institution_field(bindings.authors(spark, sf))):
        assert "Exchange" not in _plan(df) and "InMemoryTableScan" not in _plan(df)


def test_nested_work_is_done_once(spark, sf):
    """Every label is worked out once a row, and the snapshot is read once."""
    src = bindings.snapshot(spark, sf).select("id", "h_index", "works_count", "affiliations", "topics")
    plan = assign.flat_authors(src)._jdf.queryExecution().optimizedPlan().toString()
    nested = [line for line in plan.splitlines() if "array_min" in line]
    assert sum(line.count("array_min(") for line in nested) == 5 and len(nested) == 1
    scans = len(re.findall("Relation ", _optimized(src)))
    assert len(re.findall("Relation ", plan)) == scans and len(re.findall("Relation ", _optimized(assign.build_authors(src)))) == 2  # the flat rows, and again for the names


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_flat_rows_are_as_before(spark, sf):
    flat = assign.flat_authors(bindings.snapshot(spark, sf))
    apart = assign.latest_affiliation(bindings.snapshot(spark, sf)).join(assign.modal_labels_in_row(bindings.snapshot(spark, sf)), "author_id")
    columns = ["author_id", "institution_id", "institution_name", "field", "subfield", "domain", "topic", "topic_name"]
    pick = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert pick(flat) == pick(apart.where(F.col("field").isNotNull()))
