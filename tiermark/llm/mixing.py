"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document may be a member of several sources.  Documents are counted by membership pattern (which sources, how many words);
the few patterns, not the documents, make the network: every pattern offers its words once at no cost, a second time at cost
1, a third at cost 2 (convex, so repetition comes last and evenly), its sources take them, and each source may take as much
as its quota.  The flow says how many words each pattern gives each source; documents are then selected by seeded hashes.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.llm.common import stored, temporary, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> dict[str | None, float]:
    """Shares of the total by repeating weights (sources by code point, null last), none above `most` times its size: the
    excess is shared out again by weight among the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_, left = {}, list(names), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in over}
        left, open_ = left - sum(out[s] for s in names if s in over), [s for s in open_ if s not in over]
    return out


def min_cost_flow(arcs: list[tuple[int, int, int, int]], start: int, end: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a maximum flow of the least cost: shortest augmenting paths with potentials."""
    to, left, cost, at = [], [], [], {}
    for u, v, c, w in arcs:
        for a, b, c2, w2 in ((u, v, c, w), (v, u, 0, -w)):
            at.setdefault(a, []).append(len(to))
            to.append(b)
            left.append(c2)
            cost.append(w2)
    potential: dict[int, int] = {}
    while True:
        far, via, queue = {start: 0}, {}, [(0, start)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for e in at.get(u, ()):
                if left[e]:
                    n = d + cost[e] + potential.get(u, 0) - potential.get(to[e], 0)
                    if n < far.get(to[e], n + 1):
                        far[to[e]], via[to[e]] = n, e
                        heapq.heappush(queue, (n, to[e]))
        if end not in far:
            return [left[2 * k + 1] for k in range(len(arcs))]
        for u, d in far.items():
            potential[u] = potential.get(u, 0) + d
        for u in at:
            if u not in far:
                potential[u] = potential.get(u, 0) + far[end]
        path, u = [], end
        while u != start:
            path.append(via[u])
            u = to[via[u] ^ 1]
        flow = min(left[e] for e in path)
        for e in path:
            left[e] -= flow
            left[e ^ 1] += flow


def closest(sizes: list[int], goal: int) -> list[int]:
    """Places of the sizes whose sum is nearest to goal (of two sums as near the lower), by sets of reachable sums up to twice the goal."""
    mask, layers = (1 << (2 * goal + 1)) - 1, [1]
    for n in sizes:
        layers.append(layers[-1] | layers[-1] << n & mask)
    low = (layers[-1] & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = layers[-1] >> (goal + 1)
    high = goal + (above & -above).bit_length() if above else None
    at, out = high if high is not None and high - goal < goal - low else low, []
    for k in range(len(sizes) - 1, -1, -1):
        if not layers[k] >> at & 1:
            out.append(k)
            at -= sizes[k]
    return out


@dataclass
class Mix:
    """sizes, targets: by source.  flow: words by (pattern, source), patterns by their place in `patterns`."""

    patterns: list[tuple]
    pattern_sizes: list[int]
    sizes: dict
    targets: dict
    flow: dict[tuple[int, str | None], int]


def plan_mix(patterns: dict[tuple, int], weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> Mix:
    """patterns: words by membership (a tuple of sources).  A source's size counts every document that is a member.

    The network holds the sources that share documents with others.  A source with documents of its own alone takes its target
    from them, the first time at no cost: what the network would give it."""
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    want, keys = targets(sizes, weights, most), list(patterns)
    sharing = {s: k for k, s in enumerate(dict.fromkeys(s for p in keys if len(p) > 1 for s in p))}
    arcs, given, flow = [], [], {}
    for k, p in enumerate(keys):
        if not sharing.keys() & set(p):
            flow |= {(k, s): min(round(want[s]), most * patterns[p]) for s in p}
            continue
        arcs += [(0, 2 + k, patterns[p], times) for times in range(most)]
        for s in p:
            given.append((len(arcs), k, s))
            arcs.append((2 + k, 2 + len(keys) + sharing[s], most * patterns[p], 0))
    arcs += [(2 + len(keys) + i, 1, round(want[s]), 0) for s, i in sharing.items()]
    found = min_cost_flow(arcs, 0, 1)
    return Mix(keys, list(patterns.values()), sizes, want, flow | {(k, s): found[a] for a, k, s in given})


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", members: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 11) -> tuple[DataFrame, Mix]:
    """One row a row of docs: id, th (hash of the text), mh (hash of its sources), pattern (its place), size in words, copies
    (how often the mix takes the document, 0 to `most`); and the plan.

    members: an array of the sources that a row belongs to (default: its `source` alone; null is a source of its own).  Words
    beyond whole passes are taken by seeded hash up to the quota; a document that would overshoot it is passed over, until what is
    missing is about three documents.  These are chosen for the sum that comes nearest, and then no document is left that still fits.
    Where more than the smallest document is missing then, the selection is made again with the next larger one taken first.
    Rows that repeat an id, text and sources share their fate; with other sources they are other documents.  Empty texts have
    size 0 and go along with the whole passes.  The driver holds a row a pattern, never a row a document.
    """
    spark = docs.sparkSession
    member = members if members is not None else F.array(F.col("source").cast("string"))
    base = docs.select(F.col(key).alias("id"), F.xxhash64(text_or_empty(text)).alias("th"), F.coalesce(F.array_sort(F.array_distinct(member)), F.array().cast("array<string>")).alias("pattern_of"), word_count(text).alias("size"))
    rows = stored(base.withColumn("h", F.xxhash64(F.lit(seed), "id", "th")).withColumn("mh", _members_hash(F.col("pattern_of"))), "sizes")
    counted = rows.groupBy("pattern_of").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    found = {tuple(r["pattern_of"] or ()): r for r in sorted(counted, key=lambda r: tuple((s is None, s or "") for s in r["pattern_of"] or ()))}
    plan = plan_mix({p: r["words"] for p, r in found.items()}, weights, most)
    out = []
    for k, p in enumerate(plan.patterns):
        total, n = sum(plan.flow.get((k, s), 0) for s in p), plan.pattern_sizes[k]
        out.append((list(p), k, total // n if n else 0, total % n if n else 0))
    quota = spark.createDataFrame(out, "p_of array<string>, pattern int, passes int, more bigint")
    bits = max(4, min(20, (sum(r["n"] for r in counted) // 1000).bit_length()))
    placed = rows.join(quota, F.to_json("pattern_of", {"ignoreNullFields": "false"}) == F.to_json("p_of", {"ignoreNullFields": "false"})).drop("p_of", "pattern_of")
    # rows that repeat an id and text are one unit
    placed = stored(placed.withColumn("unit", F.sum("size").over(Window.partitionBy("pattern", "h"))), "placed")
    goals = {k: more for _, k, _, more in out if more}
    gaps, rules, added = _select(spark, placed, bits, goals, {})
    short = {k: g for k, g in gaps.items() if g > 0}
    if short:  # all that fits is taken, so a larger unit must come first where more than the smallest unit is missing
        rest = _left(spark, placed, {k: (goals[k], rules[k]) for k in short}, added).where("unit <= bound").groupBy("pattern").agg(F.min(F.struct("unit", "h")).alias("next"))
        least = {r["pattern"]: r["least"] for r in placed.where("size > 0").groupBy("pattern").agg(F.min("unit").alias("least")).collect()}
        first = {r["pattern"]: r["next"] for r in rest.collect() if short[r["pattern"]] >= least[r["pattern"]]}
        other = _select(spark, placed, bits, {k: goals[k] - u["unit"] for k, u in first.items()}, {k: [u["h"]] for k, u in first.items()}) if first else ({}, {}, {})
        for k in other[0]:
            if abs(other[0][k]) < gaps[k]:
                gaps[k], rules[k], added[k] = (x.get(k, []) for x in other)
    more = spark.createDataFrame([(k, rules[k], added.get(k, [])) for k in rules], f"r_pattern int, {_RULES}, added array<bigint>")
    joined = placed.join(more, F.col("pattern") == F.col("r_pattern"), "left")
    extra = F.coalesce((F.col("size") > 0) & (_by_rules() | F.array_contains("added", F.col("h"))), F.lit(False))
    copies = F.least(F.lit(most), F.col("passes") + extra.cast("int"))
    return joined.select("id", "th", "mh", "pattern", "size", copies.alias("copies")), plan


_RULES = "rules array<struct<bound: bigint, cut: bigint>>"


def _by_rules() -> Column:
    """Whether a unit is taken by one of the rules: no larger than the bound and no later in the order of hashes than the cut."""
    return F.exists("rules", lambda r: (F.col("unit") <= r["bound"]) & (F.col("h") <= r["cut"]))


def _left(spark, placed: DataFrame, bounds: dict[int, tuple], added: dict[int, list[int]]) -> DataFrame:
    """Rows of the patterns in bounds (a bound and rules each) that have words and are not taken yet; column bound."""
    table = spark.createDataFrame([(k, b, r, added.get(k, [])) for k, (b, r) in bounds.items()], f"r_pattern int, bound bigint, {_RULES}, added array<bigint>")
    joined = placed.join(table, F.col("pattern") == F.col("r_pattern")).where("size > 0")
    return joined.where(~_by_rules() & ~F.array_contains("added", F.col("h"))).select("pattern", "h", "size", "unit", "bound")


def _select(spark, placed: DataFrame, bits: int, goals: dict[int, int], taken: dict[int, list[int]]) -> tuple[dict, dict, dict]:
    """By pattern: what is missing (below zero: too much) of the goal, rules, and hashes of single units; those of `taken` are among them."""
    gaps, rules, added = dict(goals), {k: [] for k in goals}, dict(taken)
    _fill(spark, placed, bits, gaps, rules, 3, added)
    left = _left(spark, placed, {k: (g, rules[k]) for k, g in gaps.items() if g > 0}, added).where(F.col("unit") <= 2 * F.col("bound")).groupBy("pattern", "h").agg(F.first("unit").alias("unit"), F.first("bound").alias("bound"))
    by_class, by_size = Window.partitionBy("pattern", F.floor(F.log2("unit"))).orderBy("h"), Window.partitionBy("pattern").orderBy(F.abs(F.col("unit") - F.col("bound")), "h")
    spare: dict[int, set] = {}
    for order in (by_class, by_size):
        for r in left.withColumn("n", F.row_number().over(order)).where("n <= 3").collect():  # three rows a pattern and size class, three a pattern
            spare.setdefault(r["pattern"], set()).add((r["h"], r["unit"]))
    for k, found in spare.items():
        units = sorted(found)
        picked = closest([n for _, n in units], gaps[k])
        added[k] = added.get(k, []) + [units[i][0] for i in picked]
        gaps[k] -= sum(units[i][1] for i in picked)
    _fill(spark, placed, bits, gaps, rules, 0, added)
    return gaps, rules, added


def _fill(spark, placed: DataFrame, bits: int, gaps: dict[int, int], rules: dict[int, list], reserve: int, added: dict) -> None:
    """Take units by hash until no unit left fits, and lower the gaps; what overshoots is passed over.  In each round the units
    that fit the bound are summed in the order of hashes, and those up to the bound are taken: the first fits, so the rounds end.  The bound is the gap
    less `reserve` units of mean size (half the gap at most), which are left for a choice by size."""
    open_ = {k for k, g in gaps.items() if g > 0}
    while open_:
        fits = _left(spark, placed, {k: (gaps[k], rules[k]) for k in open_}, added).where("unit <= bound")
        seen = {r["pattern"]: r for r in fits.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("unit").alias("least")).collect()}
        bound = {k: gaps[k] - min(gaps[k] // 2, reserve * r["words"] // r["n"]) for k, r in seen.items()}
        bound = {k: b for k, b in bound.items() if seen[k]["least"] <= b}
        open_ = set(bound)
        if not open_:
            return
        fits = _left(spark, placed, {k: (b, rules[k]) for k, b in bound.items()}, added).where("unit <= bound").withColumn("bin", F.shiftright("h", 64 - bits))
        # words before a unit in the order of hashes: sums by bin, then within the bin
        bins = fits.groupBy("pattern", "bin").agg(F.sum("size").alias("words"))
        before = bins.withColumn("before", F.sum("words").over(Window.partitionBy("pattern").orderBy("bin")) - F.col("words")).select("pattern", "bin", "before")
        inside = Window.partitionBy("pattern", "bin").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        summed = fits.join(before, ["pattern", "bin"]).where("before < bound").withColumn("end", F.col("before") + F.sum("size").over(inside)).where("end <= bound")
        for r in summed.groupBy("pattern").agg(F.max("h").alias("cut"), F.max("end").alias("words")).collect():
            rules[r["pattern"]].append((bound[r["pattern"]], r["cut"]))
            gaps[r["pattern"]] -= r["words"]


def _members_hash(sources: Column) -> Column:
    """Of the sources in order, where null is unlike any name."""
    return F.xxhash64(F.transform(sources, lambda s: F.struct(s.isNull(), F.coalesce(s, F.lit("")))))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", members: Column | None = None, **settings) -> DataFrame:
    """docs with every column, each row as often as the mix takes it; nulls, repeats and empty texts as in mix_sources."""
    member = members if members is not None else F.array(F.col("source").cast("string"))
    taken, _ = mix_sources(docs, key, text, members, **settings)
    i, t, m, c, th, mh, at = temporary("i", "t", "m", "c", "th", "mh", "at")
    taken = taken.where("copies > 0").select(F.col("id").alias(i), F.col("th").alias(t), F.col("mh").alias(m), F.col("copies").alias(c)).distinct()
    sources = F.coalesce(F.array_sort(F.array_distinct(member)), F.array().cast("array<string>"))
    hashed = docs.withColumns({th: F.xxhash64(text_or_empty(text)), mh: _members_hash(sources)})
    joined = hashed.join(taken, F.col(key).eqNullSafe(F.col(i)) & (F.col(th) == F.col(t)) & (F.col(mh) == F.col(m)))
    return joined.withColumn(at, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*[F.col(f"`{x}`") for x in docs.columns])
