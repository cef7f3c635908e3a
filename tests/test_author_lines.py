"""The modal label in one pass over sorted topics, and line items that meet orders once."""

from pyspark.sql import functions as F

from tiermark.operators import assign
from tiermark.plans import bindings, registry


def test_modal_labels_of_odd_topics(spark):
    """Repeats apart from each other, ties, null ids, names and counts, negative counts, several names, no topics; with one sort a label."""
    kind = "struct<id: string, display_name: string>"
    topic = lambda i, name, n: (i, name, n, (i, name), (i, name), (i, name))
    rows = [
        (1, [topic("b", "B", 2), topic("a", "A", 3), topic("b", "Bb", 2)]),
        (2, [topic("b", "B", 2), topic("a", None, 1), topic("a", "A", 1), topic(None, "N", 9)]),
        (3, [topic("a", None, None), topic("c", "C", -1)]),
        (4, [topic("a", "A", 5), topic("a", "A", -5), topic("b", "B", 1)]),
        (5, [topic(None, "N", 9)]),
        (6, []),
        (7, None),
    ]
    df = spark.createDataFrame(rows, f"id bigint, topics array<struct<id: string, display_name: string, count: bigint, field: {kind}, subfield: {kind}, domain: {kind}>>")
    found = assign.modal_labels_in_row(df)
    for level in assign.LEVELS:
        got = {r["author_id"]: (r[level], r[f"{level}_name"]) for r in found.collect()}
        assert got == {1: ("b", "Bb"), 2: ("a", "A"), 3: ("a", None), 4: ("b", "B")}
    exploded = assign.modal_labels(assign.topic_rows(df).withColumn("weight", F.coalesce("weight", F.lit(0))), "author_id", ["topic"], "weight")
    assert {(r["author_id"], r["topic"]) for r in exploded.collect()} == {(1, "b"), (2, "a"), (3, "a"), (4, "b")}


def test_line_items_meet_orders_once(spark, sf):
    """Works, affiliations and topics of authors, and the samples of the fits, come from line items kept by author."""
    bindings.forget()
    plan = bindings.snapshot(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_quantity" in plan and "o_orderdate" not in plan and "lineitem.parquet" not in "".join(bindings.snapshot(spark, sf).inputFiles())
    assert bindings.lines(spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    from tiermark.plans.queries import _samples

    assert not any("lineitem.parquet" in f or "lines_" in f for f in _samples(spark, sf).inputFiles())
    assert registry.QUERIES["h1_by_author"](spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").join(spark.read.parquet(f"{sf}/lineitem.parquet"), F.expr("o_orderkey = l_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.floor(F.sum("l_quantity")).alias("c")).where("c > 0").select("o_custkey").distinct().count()
