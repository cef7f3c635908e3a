"""Near copies by the Jaccard similarity of word shingles, exactly: SimHash first, then prefix filters, bitmap filters, leaders.

Documents whose SimHash fingerprints are within a few bits of each other are verified by their whole sets and joined; what is
similar enough but further apart in 64 bits, an exact search adds on top of these components.

Two sets of similarity t or more share one of the first |S| - ceil(t |S|) + 1 shingles of each, in whatever order all sets
have in common.  Here common shingles come last, the others by their hash; which are common is read from a first count and has
no influence on the result.  Sets that share such a shingle meet in its bucket.

A large family of near copies is not compared pair by pair: in each bucket sets of about a size are compared with a centre, the one
with the fewest shingles of its own, and in further rounds what is not linked to a large bucket's main component with a centre of
that and with one of the others.  Only pairs of different components are left after that.  These are met in a join whose condition bounds their
overlap by sizes, by the place of the shared shingle, and by bitmaps: sets that differ in d shingles have parity bitmaps that
differ in at most d bits.  What passes all bounds is verified by whole sets.  Every step only leaves out pairs that can't be
links or that are joined already, so no component is lost.  Shingles and sets are told apart by 64-bit hashes.

Hashes of the shingles take about as much disk as the texts.  So every stored table is deleted as soon as no step is left that
reads it, and the result is read from two narrow ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermark.llm import simhash
from tiermark.llm.common import brief_shuffles, forget, joined_further, stored, text_or_empty

_LONGS = 16  # of a bitmap


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles, words as in simhash.  Fewer words than a shingle has: one of them all; none: empty."""
    return np.unique(simhash.shingle_digests(text, words).view(np.int64))


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63)


def prefix(s: np.ndarray, least: tuple[int, int], common: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles in the order common to all sets, as many as the similarity asks for; and how many of all are not common."""
    rare = len(s)
    if len(common) and len(s):
        hot = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        s, rare = np.concatenate((s[~hot], s[hot])), int((~hot).sum())
    return s[: len(s) + 1 + -least[0] * len(s) // least[1]] if len(s) else s, rare


def bitmap(s: np.ndarray) -> np.ndarray:
    """For every slot of a bitmap whether an odd number of shingles falls in it."""
    return np.packbits(np.bincount(s & (64 * _LONGS - 1), minlength=64 * _LONGS).astype(np.uint8) & 1).view(np.int64)


def _keys(text: str, words: int, least: tuple[int, int]) -> Column:
    @F.arrow_udf("array<bigint>")
    def keys(texts: pa.Array) -> pa.Array:
        none = np.zeros(0, dtype=np.int64)
        return pa.array([prefix(shingles(t.as_py(), words), least, none)[0] for t in texts], pa.list_(pa.int64()))

    return keys(F.col(text))


def _summary(text: str, words: int, least: tuple[int, int], common: np.ndarray) -> Column:
    """node (hash of the set), fp (fingerprint), size, rare (shingles that are not common), bits, keys (the prefix)."""

    @F.arrow_udf("struct<node: bigint, fp: bigint, size: int, rare: int, bits: array<bigint>, keys: array<bigint>>")
    def summary(texts: pa.Array) -> pa.Array:
        found, fps = [], []
        for t in texts:
            digests = simhash.shingle_digests(t.as_py(), words)
            found.append(np.unique(digests.view(np.int64)))
            fps.append(simhash.fingerprint_of(digests))
        longs, first = pa.list_(pa.int64()), [prefix(s, least, common) for s in found]
        columns = [pa.array([node_of(s) for s in found], pa.int64()), pa.array(fps, pa.int64()), pa.array([len(s) for s in found], pa.int32()), pa.array([n for _, n in first], pa.int32()), pa.array([bitmap(s) for s in found], longs), pa.array([k for k, _ in first], longs)]
        return pa.StructArray.from_arrays(columns, names=["node", "fp", "size", "rare", "bits", "keys"])

    return summary(F.col(text))


def _sets(text: str, words: int) -> Column:
    @F.arrow_udf("struct<node: bigint, hashes: array<bigint>>")
    def whole(texts: pa.Array) -> pa.Array:
        found = [shingles(t.as_py(), words) for t in texts]
        return pa.StructArray.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "hashes"])

    return whole(F.col(text))


def fingerprint_pairs(rows: DataFrame, max_bits: int = 2, blocks: int = 5) -> DataFrame:
    """Pairs (node_a, node_b) of nodes, of rows with node and fp, whose fingerprints are within max_bits: one pair for every link
    between fingerprints, and each node with the least one of its fingerprint."""
    each = rows.select("fp", "node").distinct()
    least = stored(each.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    same = each.join(least.withColumnRenamed("node", "node_a"), "fp").where("node <> node_a").select("node_a", F.col("node").alias("node_b"))
    links = simhash.hamming_links(least.select("fp"), max_bits, blocks)
    for s in ("a", "b"):
        links = links.join(least.select(F.col("fp").alias(s), F.col("node").alias(f"node_{s}")), s)
    return links.select("node_a", "node_b").where("node_a <> node_b").unionByName(same)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: tuple[int, int] = (4, 5), common_docs: int = 50, most_common: int = 200_000, bucket_rows: int = 32, rounds: int = 2, broadcast_ids: int = 200_000, max_bits: int = 2, blocks: int = 5) -> DataFrame:
    """One row a row of docs with a key: id (the key), th (xxhash64 of the text), and of the component that pairs of similarity
    least[0] / least[1] or more form: component_id, the smallest key, and component_th, the smallest text hash under it.

    Null and empty texts, and others without words, are copies of each other.  common_docs, most_common, bucket_rows,
    rounds, broadcast_ids, max_bits and blocks change the cost, not the result.
    """
    p, q, spark = *least, docs.sparkSession
    given = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("body"))
    with brief_shuffles(spark):
        often = given.select(F.explode(_keys("body", words, least)).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > common_docs)
        often = often.orderBy(F.desc("n"), "token").limit(most_common).select("token").collect()  # most_common values at most
    common = np.sort(np.array([r["token"] for r in often], dtype=np.int64))
    rows = stored(given.select("id", F.xxhash64(text_or_empty("body")).alias("th"), _summary("body", words, least, common).alias("s")).select("id", "th", "s.*"), "shingles")
    named = stored(rows.select("id", "th", "node", "fp"), "names")
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct("id", "th")).alias("least"), F.min("size").alias("size"), F.min("rare").alias("rare"), F.min("bits").alias("bits")), "nodes")
    reps = nodes.select(F.col("least.id").alias("id"), F.col("least.th").alias("th"))
    one = stored(rows.select("id", "th", "node", "keys").join(reps, ["id", "th"], "left_semi").select("node", "keys"), "keys")
    forget(rows)
    lone = one.select("node", F.posexplode("keys").alias("pos", "token"))
    counts = stored(lone.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "counts")  # rows that repeat id and text count too: no harm
    entries = lone.join(counts, "token").join(nodes.select("node", "size", "rare"), "node").distinct()
    entries = stored(entries.withColumn("dense", F.col("n") > bucket_rows).drop("n"), "prefixes")
    forget(one, counts)
    small, dense = entries.where("NOT dense").drop("dense"), entries.where("dense").drop("dense")
    bits = nodes.select("node", "bits")

    fits = f"{q} * least(size_a, size_b) >= {p} * greatest(size_a, size_b)"
    placed_fits = f"least(size_a - pos_a, size_b - pos_b) * {p + q} >= {p} * (size_a + size_b)"
    apart = " + ".join(f"bit_count(bits_a[{k}] ^ bits_b[{k}])" for k in range(_LONGS))
    bits_fit = f"({apart}) * {p + q} <= {q - p} * (size_a + size_b)"
    side = lambda df, s: df.select("token", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "token"])

    def verified(pairs: DataFrame, by_bits: bool) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar enough; sets are formed anew for the nodes in question alone."""
        pairs = pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
        if by_bits:
            for s in ("a", "b"):
                pairs = pairs.join(nodes.select(F.col("node").alias(s), F.col("bits").alias(f"bits_{s}"), F.col("size").alias(f"size_{s}")), s)
            pairs = pairs.where(bits_fit)
        pairs = stored(pairs.select("a", "b"), "pairs")
        if pairs.isEmpty():
            return pairs
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        ids = stored(asked.join(nodes, "node").select(F.col("least.id").alias("id"), F.col("least.th").alias("th")), "asked")
        with brief_shuffles(spark):
            few = ids.count() <= broadcast_ids  # else the texts are shuffled to them
        texts = given.withColumn("th", F.xxhash64(text_or_empty("body"))).join(F.broadcast(ids) if few else ids, ["id", "th"], "left_semi")
        sets = stored(texts.select(_sets("body", words).alias("s")).select("s.*").dropDuplicates(["node"]), "whole-sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
        same = F.size(F.array_intersect("x", "y"))
        links = stored(both.where(q * same >= p * (F.size("x") + F.size("y") - same)).select("a", "b"), "links")
        forget(pairs, ids, sets)
        return links

    def further(roots: DataFrame | None, links: DataFrame) -> DataFrame:
        more = joined_further(roots, links)
        forget(links, *([roots] if roots is not None and more is not roots else []))
        return more

    def rooted(entries: DataFrame, roots: DataFrame) -> DataFrame:
        """Entries with the root of their component."""
        return entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def in_class(entries: DataFrame, turn: int) -> DataFrame:
        """Entries with a class of about a size; the classes move by a part each turn."""
        return entries.withColumn("class", F.floor(F.ln(F.greatest("size", F.lit(1))) / float(np.log(q / p)) + turn / rounds).cast("int"))

    centres = []

    # after the fingerprints every set with the centre of its class in each bucket
    def led(entries: DataFrame) -> DataFrame:
        centre = in_class(entries, 0).groupBy("token", "class").agg(F.min(F.struct("rare", "node", "size", "pos")).alias("l"), F.count("*").alias("k")).where("k > 1")
        centre = stored(centre.select("token", "class", *[F.col(f"l.{c}").alias(f"{c}_b") for c in ("node", "size", "pos")]), "centres")
        centres.append(centre)
        return side(in_class(entries, 0), "a").withColumnRenamed("class_a", "class").join(centre, ["token", "class"]).where("node_a <> node_b").where(fits).where(placed_fits).select("node_a", "node_b")

    roots = further(None, verified(fingerprint_pairs(named, max_bits, blocks), True))
    roots = further(roots, verified(led(small).unionByName(led(dense)), True))
    forget(*centres)
    # in large buckets, turn by turn, what is not in the main component of its class with the centres of that and of the others
    for turn in range(1, rounds + 1):
        placed = stored(in_class(rooted(dense, roots), turn), "placed")
        centre = F.min(F.struct("rare", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "size", "pos", "root"))
        parts = stored(placed.groupBy("token", "class", "root").agg(F.count("*").alias("k"), centre.alias("l")), "parts")
        main = stored(parts.groupBy("token", "class").agg(F.count("*").alias("parts"), F.max(F.struct("k", "root", "l")).alias("m")).where("parts > 1").select("token", "class", F.col("m.root").alias("main"), F.col("m.l").alias("l1")), "main")
        if main.isEmpty():  # each class of each bucket is one component
            forget(placed, parts, main)
            continue
        other = parts.join(main, ["token", "class"]).where("root <> main").groupBy("token", "class").agg(F.min("l").alias("l2"))
        both = main.join(other, ["token", "class"]).select("token", "class", F.explode(F.array("l1", "l2")).alias("l"))
        leaders = stored(both.select("token", "class", *[F.col(f"l.{c}").alias(f"{c}_b") for c in ("node", "size", "pos", "root")]), "leaders")
        rest = stored(placed.join(main.select("token", "class", "main"), ["token", "class"]).where("root <> main").drop("main"), "rest")
        pairs = side(rest, "a").withColumnRenamed("class_a", "class").join(leaders, ["token", "class"]).where("root_a <> root_b").where(fits).where(placed_fits)
        roots = further(roots, verified(pairs.select("node_a", "node_b"), True))
        forget(placed, parts, main, leaders, rest)
    # then every pair of different components that is left: of large buckets, one of them not in the main component
    placed = stored(rooted(dense, roots).join(bits, "node"), "placed")
    main = stored(placed.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("k", "root")).alias("main")).where("parts > 1").select("token", "main"), "main")
    if not main.isEmpty():
        open_ = stored(placed.join(main, "token").withColumn("in_main", F.col("root") == F.col("main")).drop("main"), "open")
        left = stored(open_.where("NOT in_main"), "left")
        pairs = side(left, "a").join(side(open_, "b"), "token").where("root_a <> root_b AND (in_main_b OR node_a < node_b)").where(fits).where(placed_fits).where(bits_fit)
        roots = further(roots, verified(pairs.select("node_a", "node_b"), False))
        forget(open_, left)
    forget(placed, main)
    placed = stored(rooted(small, roots), "placed")
    forget(entries)
    several = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    open_ = stored(placed.join(several, "token", "left_semi"), "open")
    forget(placed)
    pairs = side(open_, "a").join(side(open_, "b"), "token").where("node_a < node_b AND root_a <> root_b").where(fits).where(placed_fits)
    roots = further(roots, verified(pairs.select("node_a", "node_b"), True))
    forget(open_)
    each = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = each.groupBy("root").agg(F.min("least").alias("first"))
    classes = stored(each.select("node", "root").join(ids, "root").select("node", F.col("first.id").alias("component_id"), F.col("first.th").alias("component_th")), "classes")
    forget(nodes, roots)
    return named.select("id", "th", "node").join(classes, "node").select("id", "th", "component_id", "component_th")
