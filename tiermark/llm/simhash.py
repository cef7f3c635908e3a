"""SimHash near-duplicates: pigeonhole blocks, verified by Hamming distance, and connected components.

Fingerprints first lose their exact copies (one node a fingerprint).  With `max_bits` differing bits allowed and the 64 bits
cut in `blocks` blocks, a close pair agrees in at least blocks - max_bits of them, so every choice of that many blocks is a
join key.  Buckets of up to `bucket_rows` nodes are joined with themselves and verified.  The nodes of larger buckets (a
dense family of near copies) are linked without forming the pairs: nodes that share a key of their radius-1 balls are within two
bits of each other, and two nodes within two bits always share one; a star inside every key loses no link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.llm.common import connected, forget, keep_first, stored, temporary, text_or_empty

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def shingle_digests(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of every shingle, repeats included.  Fewer words than a shingle has: one shingle of them all; none: empty."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())], dtype=np.uint64)


def fingerprint_of(digests: np.ndarray) -> int:
    """A bit is 1 if set in over half of the digests; of none the fingerprint is zero.  As a signed 64-bit integer."""
    n = len(digests)
    if not n:
        return 0
    by_byte = np.bincount((digests.view(np.uint8).reshape(n, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    ones = (by_byte @ _BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def simhash(text: str | None, words: int = 3) -> int:
    """The fingerprint of a text as a signed 64-bit integer."""
    return fingerprint_of(shingle_digests(text, words))


def simhash_column(text: str = "text", words: int = 3) -> Column:
    r"""Fingerprints of whole texts: A-Z lower-cased, words [^\x20\x09-\x0D]+, shingles of `words` words, XXH64 with seed 42."""

    @F.arrow_udf("bigint")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t.as_py(), words) for t in texts], pa.int64())

    return fingerprint(F.col(text))


def _masks(blocks: int, same: int) -> list[int]:
    """For every choice of `same` blocks, the bits of these blocks, signed."""
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(blocks)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in (sum(c) for c in combinations(block, same))]


def hamming_links(nodes: DataFrame, max_bits: int = 2, blocks: int = 5, bucket_rows: int = 32) -> DataFrame:
    """Links (a, b), a < b, between distinct values of nodes.fp that join everything within `max_bits` (0 to 2) bits:
    all pairs of small buckets, and stars over shared neighbours for the nodes of larger ones."""
    if not 0 <= max_bits <= 2 or blocks <= max_bits:
        raise ValueError("max_bits must be 0, 1 or 2, and below blocks")
    none = nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if not max_bits:
        return none
    keys = nodes.select("fp", F.inline(F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key")) for k, m in enumerate(_masks(blocks, blocks - max_bits))])))
    sizes = keys.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keys.join(sizes, ["part", "key"]), "blocks")
    small = shared.where(F.col("n") <= bucket_rows).select("part", "key", "fp")
    pairs = small.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), ["part", "key"])
    pairs = pairs.where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    dense = shared.where(F.col("n") > bucket_rows).select("fp").distinct()
    bit = [F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k).cast("bigint") for k in range(64)]
    if max_bits == 2:  # the ball: the node and its 64 neighbours
        ball = F.array(*[F.struct(F.lit(0).alias("way"), F.col("fp").alias("near"))], *[F.struct(F.lit(0).alias("way"), F.col("fp").bitwiseXOR(b).alias("near")) for b in bit])
    else:  # the node without one bit: what agrees in it differs in that bit alone
        ball = F.array(*[F.struct(F.lit(k).alias("way"), F.col("fp").bitwiseAND(F.bitwise_not(b)).alias("near")) for k, b in enumerate(bit)])
    around = dense.select("fp", F.inline(ball))
    center = F.min("fp").over(Window.partitionBy("way", "near"))  # at most 65 rows a key
    stars = around.select(center.alias("a"), F.col("fp").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def _classes(docs: DataFrame, key: str, text: str, words: int, max_bits: int, blocks: int, bucket_rows: int) -> DataFrame:
    """id, th (hash of the text), fp, component_id and component_th (the smallest key, and the smallest text hash under it)."""
    rows = stored(docs.select(F.col(key).alias("id"), F.xxhash64(text_or_empty(text)).alias("th"), simhash_column(text, words).alias("fp")), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    nodes = stored(rows.groupBy("fp").agg(first.alias("least")), "nodes")
    links = hamming_links(nodes.select("fp"), max_bits, blocks, bucket_rows)
    roots = connected(links)
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = joined.groupBy("root").agg(F.min("least").alias("first"))
    lone = joined.select("fp", "root").join(named, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.th").alias("component_th"))
    classes = stored(lone, "classes")
    forget(nodes, roots)
    return rows.join(classes, "fp")  # both sides of the join are plain: a fingerprint may have a third of the rows


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 2, blocks: int = 5, bucket_rows: int = 32) -> DataFrame:
    """One row a row of docs: the key, its fingerprint (16 lower-case hex digits) and component_id, the smallest key reachable.

    Null and empty texts have fingerprint zero and are linked like any other.  A null key never names a component unless no
    row of it has a key; repeated rows are repeated in the result.
    """
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return _classes(docs, key, text, words, max_bits, blocks, bucket_rows).select(F.col("id").alias(key), hexed.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, similarity: tuple[int, int] | None = None, max_bits: int = 2, blocks: int = 5, bucket_rows: int = 32) -> DataFrame:
    """The rows of docs, all columns, of which each component keeps one: that of its smallest key.

    With `similarity`, a fraction, documents are linked where their sets of shingles have that Jaccard similarity or more: fingerprints
    within max_bits are verified by it, and what 64 bits can't tell (0.8 from 0.7, see the README) an exact search
    adds.  Rows with a null key all stay: no
    decision can name them.  Rows of one key with different texts are documents of their own; of rows that repeat key and
    text one stays.
    """
    if similarity:
        from tiermark.llm.jaccard import jaccard_components

        found = jaccard_components(docs, key, text, words, similarity, max_bits=max_bits, blocks=blocks)
    else:
        found = _classes(docs.where(F.col(key).isNotNull()), key, text, words, max_bits, blocks, bucket_rows)
    kept = found.where((F.col("id") == F.col("component_id")) & (F.col("th") == F.col("component_th")))
    return keep_first(docs, key, text, kept.select("id", "th").distinct())
