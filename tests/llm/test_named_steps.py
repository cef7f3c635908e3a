"""Steps that a result alone does not show: the fingerprints of the near-dedup stage, and where toxicity is trained."""

import random

from pyspark.sql import functions as F

from tiermark.llm import jaccard, simhash, toxicity


def test_near_dedup_stage_links_by_fingerprints(spark, sf, monkeypatch):
    import corpus_pipeline

    rng = random.Random(2)
    long = [f"w{rng.randrange(900)}" for _ in range(2000)]
    texts = [" ".join(long), " ".join([*long[:-1], "other"]), "a text of its own that is far from all the others"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen = []
    whole = jaccard.fingerprint_pairs

    def watched(rows, *args):
        seen.append({(r["fp"]) for r in rows.collect()})
        return whole(rows, *args)

    monkeypatch.setattr(jaccard, "fingerprint_pairs", watched)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, sf).collect()) == [0, 2]
    assert seen == [{simhash.simhash(t, 5) for t in texts}]
    rows = spark.createDataFrame([(jaccard.node_of(jaccard.shingles(t)), simhash.simhash(t, 5)) for t in texts], "node bigint, fp bigint")
    nodes = [r["node"] for r in rows.collect()]
    assert [{r["node_a"], r["node_b"]} for r in whole(rows).collect()] == [set(nodes[:2])]


def test_toxicity_is_trained_in_a_task(spark, monkeypatch):
    """The driver never sees the texts, and the model is that of training on them in the order of the keys' hashes."""
    rows = [(k, "calm lake in the morning" if k % 3 else "you vile rotten fool", int(k % 3 == 0)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    order = [tuple(r) for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "toxic").collect()]
    want = toxicity.train([t for t, _ in order], [y for _, y in order])
    monkeypatch.setattr(toxicity, "_apart", None)  # here only: workers have the module as it is
    got = toxicity.fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert (got.weight == want.weight).all() and (got.bias, got.scale) == (want.bias, want.scale)
