"""Reversed lexical search against a plain version."""

import random

import pytest

from tests.llm.brute import lexical_ranks
from tiermark.llm import lexical, queries


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_op12(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = sorted(lexical_ranks(docs, items), key=str)
    assert _got(queries.op12_lexical(spark, sf).select("item_id", "rank", "doc_id", "score")) == want and want


@pytest.mark.parametrize("block_bytes", [8 << 20, 40])
def test_ties_nulls_and_blocks(spark, block_bytes):
    """With one block of items, and with many of a few items each."""
    r = random.Random(5)
    words = ["red", "Green", "blue", "é", "x1", "the", "ÉTÉ", "a"]
    docs = [(i, r.choice([None, "", "...", " ".join(r.choices(words, k=r.randint(1, 40)))])) for i in [*range(200), None, None, 3, 3, 4]]
    docs += [(1000 + k, "the same text, the very same") for k in range(30)] + [(5000, "the " * 60000)]
    items = [(k, " ".join(r.choices(words, k=r.randint(0, 9)))) for k in range(12)] + [(50, None), (51, ""), (52, "absent"), (53, "same the the"), (None, "red blue"), (53, "zz")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, score int, rank int").repartition(5)
    it = spark.createDataFrame([(*x, 3) for x in items], "item_id bigint, text string, doc_id int")
    kept = {}
    for i, t in items:
        if t is not None:
            kept[i] = min(kept.get(i, t), t)
    want = sorted(lexical_ranks(docs, list(kept.items())), key=str)
    assert _got(lexical.search(df, it, block_bytes=block_bytes)) == want
    assert lexical.search(df.where("false"), it).isEmpty() and lexical.search(df, it.where("false")).isEmpty()


def test_pieces_of_a_batch_add_up():
    """Scores in pieces of bounded size are those of the whole."""
    import numpy as np

    index = lexical.ItemIndex([(k, f"a b{k % 3} c{k}") for k in range(9)])
    n, ptr, codes, counts = np.array([5, 1, 0, 9]), np.array([0, 3, 4, 4, 7]), np.array([0, 1, 2, 0, 0, 4, 5]), np.array([2, 1, 3, 1, 4, 4, 1])
    weights = np.arange(1, len(index.numbers) + 1)
    whole = next(lexical._scores(index, weights, 4, 15, n, ptr, codes, counts))[1]
    parts = [s for _, s in lexical._scores(index, weights, 4, 15, n, ptr, codes, counts, most=10)]
    assert len(parts) == 4 and np.array_equal(np.concatenate(parts), whole) and whole.any()
