"""Components that grow by further links are those of all links together."""

import random

from tiermark.llm import common
from tiermark.llm.common import connected, joined_further

PARTS = [[(1, 2), (4, 3), (3, 5), (3, 5)], [], [(5, 9), (7, 8), (6, 6)], [(2, 9), (1, 4), (8, 7)]]


def test_joined_further(spark):
    frame = lambda links: spark.createDataFrame(links, "a bigint, b bigint")
    roots = None
    for k, part in enumerate(PARTS):
        roots = joined_further(roots, frame(part))
        at_once = connected(frame([x for p in PARTS[: k + 1] for x in p])).collect()
        got = {r["node"]: r["root"] for r in roots.collect()}
        assert roots.count() == len(got)
        assert {n: r for n, r in got.items() if n != 6} == {r["node"]: r["root"] for r in at_once}
        assert got.get(6, 6) == 6  # linked with itself alone


def test_few_links_take_no_steps(spark, monkeypatch):
    """One task joins up few links: no table for each step, and the roots are those of the steps."""
    written, scratch = [], common.scratch_dir
    monkeypatch.setattr(common, "scratch_dir", lambda session, tag: written.append(tag) or scratch(session, tag))
    rng = random.Random(3)
    ids = [rng.getrandbits(63) - (1 << 62) for _ in range(40)]
    links = [*zip(ids[:20], ids[1:21]), *[(rng.choice(ids[21:30]), rng.choice(ids[21:30])) for _ in range(8)], (ids[31], ids[31]), (ids[33], ids[32])]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(3)
    found = [(r["node"], r["root"]) for r in connected(df).collect()]
    assert written == ["edges", "roots"]
    assert sorted(found) == sorted((r["node"], r["root"]) for r in connected(df, few=0).collect())
    assert written.count("edges") > 3
    assert len(found) == len(dict(found)) and {r for n, r in found if n in ids[:21]} == {min(ids[:21])}
    assert not connected(df.limit(0)).collect()
