r"""What each of five text filters removes in every order, from a sparse document-term matrix.

Words (maximal runs of other than [\x20\x09-\x0D], case-sensitive) get numbers from one dictionary of the whole corpus.  The matrix
comes as CSR shards: first a shard is written with a vocabulary of its own, then the vocabularies meet the dictionary (a row for
each word of a shard, not for each word of a document), and the shards take over its numbers.  Sums and counts of a matrix row are
a document's words and distinct words; they decide filters A and B, the others come from the text itself.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tiermark.llm.common import scratch_dir, stored, temporary, text_or_empty

FILTERS = "ABCDE"
_UPPER, _LATER, _ODD = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(128, 192)), b"#$%&*|"  # later: bytes that don't begin a character


def _without(body: bytes, some: bytes) -> int:
    return len(body.translate(None, some))


#: What filters C, D and E go by.
TRAITS = {
    "c": (pa.bool_(), lambda b: 100 * (len(b) - _without(b, _UPPER)) > 2 * _without(b, _LATER)),
    "d": (pa.bool_(), lambda b: _without(b, _ODD) < len(b)),
    "digest": (pa.binary(), lambda b: hashlib.sha256(b).digest()),
}


class _Shard:
    """A shard in the making: rows of the matrix with numbers of a vocabulary of its own."""

    def __init__(self, traits: dict):
        self.size, self.ptr, self.indices, self.counts = 0, [0], array("i"), array("i")
        self.vocabulary: defaultdict = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__  # a new word gets the next number
        self.rows, self.traits = [], {t: [] for t in traits}

    def add(self, body: bytes, traits: dict) -> None:
        words = Counter(body.split())
        self.indices.extend(map(self.vocabulary.__getitem__, words))
        self.counts.extend(words.values())
        self.ptr.append(len(self.indices))
        self.size += len(body)
        for t, (_, of) in traits.items():
            self.traits[t].append(of(body))

    def row(self, shard: int, columns: list[str], traits: dict, ranges: int) -> pa.RecordBatch:
        """The vocabulary in the order of its ranges (of checksums), numbered anew in that order, in a list a range."""
        words = list(self.vocabulary)
        at = np.fromiter((zlib.crc32(w) % ranges for w in words), np.int64, len(words))
        order = np.argsort(at, kind="stable")
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words))
        found, begin = np.unique(at[order], return_index=True)
        terms = pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)), pa.int32()), pa.array([words[k] for k in order], pa.binary()).cast(pa.string()))
        lists = {c: pa.concat_arrays([b[k] for b in self.rows]) for k, c in enumerate(columns)} | {t: pa.array(self.traits[t], kind) for t, (kind, _) in traits.items()}
        lists["indptr"] = pa.array(self.ptr, pa.int32())
        lists["vocabulary"] = pa.StructArray.from_arrays([pa.array(found), pa.array(begin, pa.int32()), terms], ["range", "first", "terms"])
        wrapped = {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for c, v in lists.items()}
        entries = {"indices": place[np.frombuffer(self.indices, np.int32)].tobytes(), "counts": self.counts.tobytes()}
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64())} | wrapped | {n: pa.array([b], pa.binary()) for n, b in entries.items()})


def _local_shards(columns: list[str], traits: dict, shard_bytes: int, ranges: int):
    """A function for mapInArrow: rows of columns and `text` to shards with vocabularies of their own."""

    def shards(batches):
        number, s = TaskContext.get().partitionId() << 33, _Shard(traits)
        for batch in batches:
            kept, begun = [batch.column(batch.schema.get_field_index(c)) for c in columns], 0
            for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                s.add(text, traits)
                if s.size >= shard_bytes:
                    s.rows.append([c.slice(begun, k + 1 - begun) for c in kept])
                    yield s.row(number, columns, traits, ranges)
                    s, number, begun = _Shard(traits), number + 1, k + 1
            if begun < batch.num_rows:
                s.rows.append([c.slice(begun) for c in kept])
        if s.rows:
            yield s.row(number, columns, traits, ranges)

    return shards


def _numbered(_, table):
    """For applyInArrow by range: each word's number within the range, and every word once (in the row that has it first)."""
    terms = table.column("terms").combine_chunks()
    coded = terms.flatten().dictionary_encode()  # numbered in the order they come in
    numbers, ptr = coded.indices.to_numpy(), terms.offsets.to_numpy() - terms.offsets[0].as_py()
    upto = np.append(0, np.maximum.accumulate(numbers) + 1)[ptr] if len(numbers) else ptr
    inside, new = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), coded.indices), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), coded.dictionary)
    return pa.table([table.column("range"), table.column("shard"), table.column("first"), inside, new], names=["range", "shard", "first", "inside", "terms"])


def _encoded(names: list[str]):
    """For cogroup by shard: the shard with the dictionary's numbers in place of its own."""

    def encoded(_, shards, numbers):
        if not len(shards):
            return shards.select(names)
        own, counts = (np.frombuffer(shards.column(c)[0].as_buffer(), np.int32) for c in ("indices", "counts"))
        to = np.zeros(sum(map(len, numbers.column("inside"))), np.int64)
        for first, inside, base in zip(numbers.column("first").to_pylist(), numbers.column("inside"), numbers.column("base").to_pylist()):
            to[first : first + len(inside)] = inside.values.to_numpy().astype(np.int64) + base
        for c, v in (("indices", to[own]), ("counts", counts)):
            shards = shards.set_column(shards.schema.get_field_index(c), c, pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)))
        return shards.select(names)

    return encoded


def document_terms(docs: DataFrame, columns: list[str], text: str = "text", traits: dict | None = None, shard_bytes: int = 4 << 20, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The dictionary (term, number from 0 without gaps) and the CSR shards of docs, both stored: shard, each of columns and traits as
    an array with an entry a document, indptr, indices (numbers of the dictionary), counts.

    traits: name to (Arrow type, function of a text's bytes).  A null text has no words; without rows there are no shards.  Words are
    numbered by ranges of their checksums, each on top of the words in the ranges before it, so no task has all of them; a word is
    in a shard's vocabulary once, so none is frequent there.  The shards' entries are never shuffled."""
    from pyspark.sql.pandas.types import from_arrow_type

    spark, traits, name = docs.sparkSession, traits or {}, f"term_shards_{uuid.uuid4().hex}"
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*columns, text_or_empty(text).alias("text"))
    kinds = [T.StructField(c, T.ArrayType(k)) for c, k in [*((c, rows.schema[c].dataType) for c in columns), *((t, from_arrow_type(k)) for t, (k, _) in traits.items())]]
    several = lambda n, t: T.StructField(n, T.ArrayType(t))
    schema = T.StructType([T.StructField("shard", T.LongType()), *kinds, several("indptr", T.IntegerType()), several("vocabulary", T.StructType.fromDDL("range bigint, first int, terms array<string>")), T.StructField("indices", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    written = rows.mapInArrow(_local_shards(columns, traits, shard_bytes, ranges or 4 * partitions), schema).write.bucketBy(partitions, "shard")
    try:
        written.option("path", scratch_dir(spark, name)).option("compression", "zstd").saveAsTable(name)
        local = spark.table(name)
        words = local.select("shard", F.inline("vocabulary"))
        numbered = stored(words.groupBy("range").applyInArrow(_numbered, "range bigint, shard bigint, first int, inside array<int>, terms array<string>"), "numbered")
        counts = numbered.groupBy("range").agg(F.sum(F.size("terms")).alias("c"))
        base = F.broadcast(counts.select("range", (F.sum("c").over(Window.orderBy("range")) - F.col("c")).alias("base")))  # a row a range
        kept = T.StructType([*schema.fields[:-3], several("indices", T.LongType()), several("counts", T.IntegerType())])
        numbers = numbered.select("range", "shard", "first", "inside").join(base, "range")
        shards = stored(local.drop("vocabulary").groupBy("shard").cogroup(numbers.groupBy("shard")).applyInArrow(_encoded(kept.names), kept), "shards")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return _dictionary(numbered, base), shards


def _dictionary(numbered: DataFrame, base: DataFrame) -> DataFrame:
    """term and number: a row's new words have the next numbers of its range in their order, from the first on that no row before has."""
    new = numbered.where(F.size("terms") > 0).withColumn("next", F.array_max("inside") - F.size("terms") + 1)
    return new.join(base, "range").select(F.posexplode("terms").alias("at", "term"), "base", "next").select("term", (F.col("base") + F.col("next") + F.col("at")).cast("bigint").alias("number"))


def row_sums(shards: DataFrame, columns: list[str]) -> DataFrame:
    """columns, n_words and n_distinct of every document: the sum and the number of the entries of its matrix row."""

    def sums(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k].values for c in ("indptr", *columns)}
                ptr = one["indptr"].to_numpy()
                counts = batch.column("counts")[k].values.to_numpy() if ptr[-1] else np.zeros(0, np.int64)
                upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[ptr]
                yield pa.RecordBatch.from_pydict({c: one[c] for c in columns} | {"n_words": pa.array(np.diff(upto)), "n_distinct": pa.array(np.diff(ptr).astype(np.int64))})

    kinds = [T.StructField(c, shards.schema[c].dataType.elementType) for c in columns]
    schema = T.StructType([*kinds, T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.LongType())])
    return shards.select("indptr", "counts", *columns).mapInArrow(sums, schema)


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """id, part and failed (bit k: fails filter k of FILTERS) of every row.

    A: under 200 words; B: distinct words under half of the words; C: over 2 % of the code points are A-Z; D: holds one of
    #$%&*|; E: the text is that of a row with a smaller id.  A null text is an empty one (fails A alone, and E where an empty text has a
    smaller id); a null part is ""; a null id is larger than every id; rows that repeat an id are rows of their own and not smaller."""
    read = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty(text).alias("text"))
    rows = stored(row_sums(document_terms(read, ["id", "part"], traits=TRAITS)[1], ["id", "part", *TRAITS]), "document-rows")
    first = stored(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"), "first-holders")
    seen = rows.join(first, "digest", "left")
    tests = [F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"), F.col("c"), F.col("d"), F.coalesce(F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("first") < F.col("id"))), F.lit(False))]
    mask = F.lit(0)
    for k, t in enumerate(tests):
        mask = mask + F.when(t, 1 << k).otherwise(0)
    return seen.select("id", "part", mask.alias("failed"))


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row for every part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley
    (see `failures` for the filters and for nulls).

    labels: key, quality, toxic; of rows that repeat an id the greatest values count, null ids match nothing.  Counts are taken by
    part and set of failed filters first, 32 at most for a part, and all orders are worked out from those.  No rows, no parts."""
    (i,) = temporary("i")
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(i)).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    judged = failures(docs, key, text, part).join(marks, F.col("id") == F.col(i), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    cells = judged.groupBy("part", "failed").agg(F.count("*").alias("n"), total("good"), total("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(FILTERS)])
    steps = parts.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    before, own = F.lit(0), F.lit(0)
    for k, f in enumerate(FILTERS):
        at = F.instr("filter_order", f)
        before, own = before + F.when(at < F.col("step"), 1 << k).otherwise(0), own + F.when(at == F.col("step"), 1 << k).otherwise(0)
    steps = steps.withColumn("before", before).withColumn("own", own)

    def summed(condition, value):
        return F.aggregate("cells", F.lit(0).cast("bigint"), lambda s, c: s + F.when(condition(c["failed"]), value(c)).otherwise(0))

    fails, earlier = (lambda m: m.bitwiseAND(F.col("own")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    share = lambda c: (c["n"] * 120 / F.bit_count(c["failed"])).cast("bigint")  # noqa: E731  of the 120 orders those where this filter comes first
    n = lambda c: c["n"]
    return steps.select(
        "part", "filter_order", "step",
        summed(lambda m: ~fails(m) & ~earlier(m), n).alias("kept"), summed(lambda m: fails(m) & ~earlier(m), n).alias("removed"), summed(lambda m: fails(m) & earlier(m), n).alias("redundant"),
        summed(lambda m: m == F.col("own"), n).alias("unique_fails"), summed(lambda m: fails(m) & ~earlier(m), lambda c: c["good"]).alias("good_lost"), summed(lambda m: fails(m) & ~earlier(m), lambda c: c["toxic"]).alias("toxic_lost"),
        summed(fails, share).alias("shapley"),
    )
