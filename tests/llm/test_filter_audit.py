"""The audit of filter orders, and the document-term matrix under it, against plain versions."""

import itertools
import random
from collections import Counter, defaultdict

from tests.llm.brute import audit
from tiermark.llm import filter_audit, queries


def test_op11(spark, sf):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {tuple(r) for r in queries.op11_filter_audit(spark, sf).collect()}
    assert got == audit(docs, labels) and len(got) == 600 * len({s for _, _, s in docs})


def test_odd_rows(spark):
    r = random.Random(3)
    texts = ["", None, "a b c", "A B C D", "x y", "# one", "word " * 300, " ".join(f"w{k}" for k in range(250)), "SHOUT " * 260, "\x85  " * 3, "long" * 50000, " \t\x0b "]
    docs = [(i, r.choice(texts), r.choice(["s", "t", None, ""])) for i in [*range(60), None, None, 7, 7, 8]]
    labels = [(i, r.randint(0, 1), r.choice([0, 1, None])) for i in [*range(0, 60, 2), None, 8, 8]]
    df = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "doc_id bigint, text string, source string, id int, failed string, digest string").repartition(4)
    lf = spark.createDataFrame([(*x, "z") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    best = defaultdict(lambda: (0, 0))
    for i, q, t in labels:
        if i is not None:
            best[i] = (max(best[i][0], q or 0), max(best[i][1], t or 0))
    got = {tuple(row) for row in filter_audit.filter_audit(df, lf).collect()}
    assert got == audit(docs, best)
    assert filter_audit.filter_audit(df.where("false"), lf).isEmpty()
    assert {row["good_lost"] for row in filter_audit.filter_audit(df, lf.where("false")).collect()} == {0}


def test_matrix_is_the_counts(spark):
    """Every entry of the shards, by its number in the dictionary, is the count of that word in that document."""
    texts = {k: " ".join(random.Random(k).choices(["a", "b", "c", "dd", "é"], k=k % 13)) for k in range(50)}
    df = spark.createDataFrame(list(texts.items()), "i bigint, text string").repartition(3)
    terms, shards = filter_audit.document_terms(df, ["i"], shard_bytes=100)
    numbers = {r["number"]: r["term"] for r in terms.collect()}
    assert sorted(numbers) == list(range(5))
    got, rows = {}, shards.collect()
    assert len(rows) > 3
    for s in rows:
        for k, i in enumerate(s["i"]):
            at = range(s["indptr"][k], s["indptr"][k + 1])
            got[i] = Counter({numbers[s["indices"][x]]: s["counts"][x] for x in at})
    assert got == {i: Counter(t.split()) for i, t in texts.items()}


def test_orders_agree_with_one_walk(spark):
    """One order by hand: what is kept after the last step is the same in all of them."""
    rows = [(k, "w " * (k % 3 * 150), "s") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = filter_audit.filter_audit(df, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).where("step = 5").collect()
    assert len(out) == 120 == len({r["filter_order"] for r in out}) and len({r["kept"] for r in out}) == 1
    assert {r["filter_order"] for r in out} == {"".join(p) for p in itertools.permutations("ABCDE")}
