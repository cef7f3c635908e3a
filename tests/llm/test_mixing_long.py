"""A very long document among short ones, repeated keys and many sources must not keep the mix from its targets."""

from collections import Counter, defaultdict

import pytest

from tiermark.llm import mixing


@pytest.mark.parametrize("seed", range(4))
def test_one_very_long_document(spark, seed):
    short, long = 500, 100_000
    rows = [(k, "a " * short, "x") for k in range(200)] + [(999, "b " * long, "x"), (1000, "c " * 50_000, "y"), (1001, "c " * 10, "y"), (1002, "c " * 10, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got, plan = mixing.mix_sources(docs, weights=(1, 1), seed=seed)
    got = got.collect()
    taken = {k: sum(r["size"] * r["copies"] for r in got if r["pattern"] == k) for k in (0, 1)}
    assert abs(taken[0] - plan.targets["x"]) <= short
    for k, s in enumerate("xy"):  # nothing of the rest still fits
        fewest = min(r["copies"] for r in got if r["pattern"] == k)
        assert all(taken[k] + r["size"] > round(plan.targets[s]) for r in got if r["pattern"] == k and r["copies"] == fewest)


def _balance(df):
    """Words by source that the mixed rows hold, against the plan."""
    got, plan = mixing.mix_sources(df)
    held = defaultdict(int)
    for r in got.collect():
        held[plan.patterns[r["pattern"]][0]] += r["size"] * r["copies"]
    return held, plan


def test_rows_that_repeat_a_key(spark):
    """Three rows a key: equal ones, others with another source, others with another text; every row comes as often as its unit."""
    rows = []
    for k in range(300):
        words = " ".join(f"w{k % 89}" for _ in range(3 + k % 40))
        rows += [(k, words, f"s{k % 5}"), (k, words, f"s{k % 5}" if k % 2 else f"s{(k + 1) % 5}"), (k, words + " more" if k % 3 else words, f"s{k % 5}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    held, plan = _balance(df)
    mixed = Counter(tuple(r) for r in mixing.mixed_documents(df).collect())
    given = Counter(rows)
    times = {}
    for row, n in mixed.items():
        assert row in given and n % given[row] == 0 and n // given[row] <= 3
        times[row] = n // given[row]
    words = defaultdict(int)
    for (_, t, s), n in mixed.items():
        words[s] += n * len(t.split())
    assert words == {s: n for s, n in held.items() if n}
    for s, want in plan.targets.items():
        assert abs(words[s] - want) <= 60


def test_five_thousand_sources(spark):
    rows = [(k, " ".join(["w"] * (1 + k % 7)), f"s{k % 5000:04d}") for k in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(8)
    held, plan = _balance(df)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    assert plan.sizes == sizes and sum(plan.targets.values()) == pytest.approx(sum(sizes.values()))
    off = [abs(held[s] - plan.targets[s]) for s in sizes]
    assert max(off) <= 7 and sum(off) / len(off) < 2


def test_sources_apart_need_no_network():
    """A source that shares nothing gets what the network of all would give it."""
    shared = {("a",): 50, ("a", "b"): 100, ("b",): 10}
    apart = {("c",): 90, ("d",): 7, (None,): 33}
    plan = mixing.plan_mix(shared | apart)
    for k, p in enumerate(plan.patterns):
        if p in apart:
            assert plan.flow[k, p[0]] == round(plan.targets[p[0]])
