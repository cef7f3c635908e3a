"""The near-dedup stage of the pipeline against all pairs by Jaccard similarity."""

import random
import time
import uuid
from collections import Counter

import numpy as np
import pytest

from tiermark.llm import common, jaccard, simhash


def _shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def _components(docs):
    sets = {i: _shingles(t) for i, t in docs.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * len(x & y) >= 4 * len(x | y):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {i: find(i) for i in ids}


def _family(n=160):
    """Random texts, chains of edits, short texts, one passage in many texts, a family of near copies."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    docs, passage, base = [None, "", " ", "a b", "A  b", "a b c d e", "a b c d f"], [word() for _ in range(30)], [word() for _ in range(70)]
    for k in range(n):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = word()
        docs += [" ".join(copy), " ".join(passage + [word() for _ in range(rng.randrange(3, 40))])]
        if k % 4 == 0:
            chain = [word() for _ in range(rng.randrange(8, 90))]
            for _ in range(4):
                docs.append(" ".join(chain))
                chain = chain[rng.randrange(3) :] + [word() for _ in range(rng.randrange(6))]
    rng.shuffle(docs)
    return dict(enumerate(docs))


@pytest.mark.parametrize("settings", [{}, {"rounds": 1, "common_docs": 3, "bucket_rows": 2}, {"common_docs": 10_000, "bucket_rows": 8}])
def test_components_are_those_of_all_pairs(spark, settings):
    docs = _family()
    want = _components(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    got = jaccard.jaccard_components(df, **settings).collect()
    assert {r["id"]: r["component_id"] for r in got} == want
    assert len(got) == len(docs) and 1 < len(set(want.values())) < len(docs)


def test_near_dedup_stage_keeps_one_of_each_group(spark, sf):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["near-dedup"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = _components({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(want.values()))


def test_no_base_among_the_copies(spark):
    """A family whose members are further from each other than from the text that all come from, which is not among them."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    docs = {}
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3])):
            copy[at] = f"own{i}x{at}"
        docs[i] = " ".join(copy)
    got = jaccard.jaccard_components(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4)).collect()
    assert {r["id"]: r["component_id"] for r in got} == _components(docs)


def test_bitmaps_bound_the_difference():
    rng = random.Random(2)
    for n in (0, 3, 100, 2000):
        a = {rng.getrandbits(62) for _ in range(n)}
        b = set(rng.sample(sorted(a), n // 2)) | {rng.getrandbits(62) for _ in range(n // 3)}
        x, y = (jaccard.bitmap(np.array(sorted(s), dtype=np.int64)) for s in (a, b))
        assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(a ^ b)


@pytest.mark.parametrize("similarity", [None, (4, 5)])
def test_null_and_repeated_keys(spark, similarity):
    rows = [(None, "a b c"), (None, "a b c"), (3, "a b c"), (5, "A b c"), (3, "a b c"), (7, None), (3, "something else"), (3, "a b  c"), (9, "something  else")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], " ".join((r["text"] or "").split())) for r in simhash.drop_near_duplicates(df, similarity=similarity).collect())
    assert got == Counter({(None, "a b c"): 2, (3, "a b c"): 1, (7, ""): 1, (3, "something else"): 1})
    assert simhash.drop_near_duplicates(df.limit(0), similarity=similarity).count() == 0


def test_intermediate_tables_and_shuffles_go(spark, tmp_path, monkeypatch):
    """What is left on disk are the narrow tables that the result is read from."""
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    monkeypatch.setattr(common, "scratch_dir", lambda _, tag: f"file://{tmp_path}/{tag}-{uuid.uuid4().hex}")

    def shuffles():
        files = manager.getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, there = spark.conf.get(setting, None), shuffles()
    got = jaccard.jaccard_components(spark.createDataFrame(list(_family(40).items()), "doc_id bigint, text string").repartition(3))
    assert Counter(p.name.rpartition("-")[0] for p in tmp_path.iterdir()) == {"names": 1, "classes": 1, "fingerprints": 1, "blocks": 1}
    for _ in range(50):  # Spark deletes them in the background
        if not (more := shuffles() - there):
            break
        time.sleep(0.2)
    assert not more
    assert spark.conf.get(setting, None) == before
    assert {r["id"]: r["component_id"] for r in got.collect()} == _components(_family(40))
