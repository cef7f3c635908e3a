"""Removal of repeated passages, and the suffix arrays under it, against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm import brute
from tiermark.llm import queries, suffix_dedup
from tiermark.llm.suffix_groups import suffix_orders


def test_suffix_orders_of_random_strings():
    r = random.Random(1)
    for _ in range(150):
        lanes = [[r.randint(1, r.choice([1, 2, 3, 5])) for _ in range(r.randint(0, 30))] + [0] for _ in range(r.randint(1, 8))]
        got = suffix_orders(np.concatenate([np.array(x) for x in lanes]), np.array([len(x) for x in lanes]))
        want, base = [], 0
        for x in lanes:
            want += [base + i for i in sorted(range(len(x)), key=lambda i: x[i:])]
            base += len(x)
        assert got.tolist() == want
    assert len(suffix_orders(np.zeros(0, int), np.zeros(0, int))) == 0


def test_suffix_orders_of_periodic_strings():
    for text in (b"a" * 300, b"ab" * 200, b"banana" * 50, bytes(range(1, 200)), bytes(range(200, 1, -1)), b"aabaaabaaaab" * 20):
        symbols = np.append(np.frombuffer(text, np.uint8).astype(int) + 1, 0)
        assert suffix_orders(symbols, np.array([len(symbols)])).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())


def _rows(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in df.collect()), key=str)


def test_op13(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in brute.repeats(docs)}
    assert {tuple(r) for r in queries.op13_suffix_dedup(spark, sf).collect()} == want
    assert any(gone for _, _, gone, _, _ in want)


def _passages(n, seed):
    """Documents of passages that others share, whole, cut or changed in a place, between words of their own."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    pool = [" ".join(word() for _ in range(r.randint(4, 40))) for _ in range(8)] + ["x" * 200, "ab" * 90, "né " * 40]
    docs = []
    for k in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(pool)
            a = r.randint(0, len(p) // 3)
            p = p[a : len(p) - r.randint(0, len(p) // 3)]
            if r.random() < 0.3 and p:
                at = r.randrange(len(p))
                p = p[:at] + "?" + p[at + 1 :]
            parts += [p, " ".join(word() for _ in range(r.randint(0, 5)))]
        docs.append((k, " ".join(parts)))
    return docs


def test_many_strings_of_a_hash_are_parted_again():
    """A lane of many strings, one window among many others, and many of one window alone."""
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n)).encode()
    core = word(50)
    for lane in ({word(r.randint(0, 20)) + core + word(r.randint(0, 20)): [(k, 0, k, [0])] for k in range(200)}, {word(8) + core: [(k, 0, k, [0])] for k in range(90)}, {core[:20] + word(1) * 40 + core: [(k % 7, 0, k, [0])] for k in range(60)}):
        got = set()
        suffix_dedup._settle([lane], 50, lambda holder, first, windows, got=got: got.update((holder[2], s + x) for s, n in zip(first, windows) for x in range(n)))
        windows = {}
        for s, [(key, _, _, _)] in lane.items():
            for x in range(len(s) - 49):
                windows[s[x : x + 50]] = min(key, windows.get(s[x : x + 50], key))
        assert got == {(d, x) for s, [(key, _, d, _)] in lane.items() for x in range(len(s) - 49) if windows[s[x : x + 50]] < key}


@pytest.mark.parametrize("crowd", [100_000, 8])
def test_shared_passages(spark, crowd):
    """Also where a hash is dealt out by its windows, and with many batches and ranges."""
    docs = _passages(60, crowd)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert _rows(suffix_dedup.remove_repeats(df, batch_rows=7, ranges=5, crowd=crowd)) == sorted(brute.repeats(docs), key=str)


def test_odd_rows(spark):
    same = "the very same passage of well over fifty bytes, again and again, in every row that has one"
    docs = [(5, same), (5, same), (3, same + "!"), (None, same), (None, same), (9, None), (8, ""), (7, "short"), (-4, "né" * 40), (2, "xné" * 3 + "né" * 40), (11, "é" * 5000), (12, "é" * 4000)]
    df = spark.createDataFrame([(i, t, "mine", 1, 2) for i, t in docs], "doc_id bigint, text string, kept string, place int, batch int")
    assert _rows(suffix_dedup.remove_repeats(df)) == sorted(brute.repeats(docs), key=str)
    assert _rows(suffix_dedup.remove_repeats(df.where("false"))) == []
    with pytest.raises(TypeError):
        suffix_dedup.remove_repeats(df.withColumnRenamed("doc_id", "i").withColumnRenamed("text", "doc_id").withColumnRenamed("kept", "text"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("suffix_docs_")]
