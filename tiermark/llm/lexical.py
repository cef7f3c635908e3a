r"""The best documents for every item of a query set, by reversed search.

The items' terms make an inverted index, which goes to all executors; the documents' term counts are streamed through it, and every
task keeps a bounded heap for each item; the heaps are merged.  Items come in blocks, so that an index has a bounded size however
many items there are; a block is a pass over the documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tiermark.llm.common import stored, text_or_empty

#: ASCII letters and digits are term characters (A-Z lower-cased), and so is every byte of a longer character; others part terms.
_TERMS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
_LAST = 1 << 63  # in place of a null id: behind every id


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TERMS).split()


class ItemIndex:
    """Terms of a block of items: their numbers, and for each term the items that hold it and how often."""

    def __init__(self, items: list[tuple]):
        self.ids, self.numbers, held = [i for i, _ in items], {}, []
        for k, (_, text) in enumerate(items):
            for term, n in Counter(terms(text)).items():
                held.append((self.numbers.setdefault(term, len(self.numbers)), k, n))
        term, item, times = np.array(sorted(held), np.int64).reshape(-1, 3).T
        self.item, self.times = item.astype(np.int32), times.copy()
        self.start = np.searchsorted(term, np.arange(len(self.numbers) + 1))


def item_blocks(items: DataFrame, item: str, text: str, block_bytes: int):
    """Items (id, text) by block of about block_bytes of text; of rows that repeat an id the smallest text counts, null texts don't."""
    rows = stored(items.where(F.col(text).isNotNull()).groupBy(F.col(item).alias("id")).agg(F.min(F.col(text).cast("string")).alias("text")), "items")
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for k in range(blocks):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).toLocalIterator()]


def _counted(index):
    """A function for mapInArrow: id, n (all terms), codes and counts of the terms that the index has."""

    def count(batches):
        number = index.value.numbers.get
        for batch in batches:
            n, ptr, codes, counts = [], [0], [], []
            for text in batch.column("text").to_pylist():
                found = terms(text)
                n.append(len(found))
                for term, c in Counter(found).items():
                    code = number(term)
                    if code is not None:
                        codes.append(code)
                        counts.append(c)
                ptr.append(len(codes))
            lists = [pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(v, t)) for v, t in ((codes, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), *lists], ["id", "n", "codes", "counts"])

    return count


def _scores(index: ItemIndex, weights: np.ndarray, documents: int, terms_: int, n: np.ndarray, ptr: np.ndarray, codes: np.ndarray, counts: np.ndarray, most: int = 2_000_000):
    """First document and score matrix (documents x items) of pieces of a batch, each of a bounded size."""
    m = np.array([25 + 75 * int(x) * documents // terms_ for x in n], np.int64)
    value = weights[codes] * (1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(m, np.diff(ptr))))
    width = index.start[codes + 1] - index.start[codes]
    upto, items, begin = np.concatenate([[0], np.cumsum(width)])[ptr], len(index.ids), 0
    while begin < len(n):
        end = min(len(n), begin + max(1, most // items), max(begin + 1, int(np.searchsorted(upto, upto[begin] + most, "right")) - 1))
        a, b = ptr[begin], ptr[end]
        w = width[a:b]
        place = np.repeat(index.start[codes[a:b]] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        row = np.repeat(np.repeat(np.arange(end - begin), np.diff(ptr[begin : end + 1])), w)
        out = np.zeros((end - begin) * items, np.int64)
        np.add.at(out, row * items + index.item[place], np.repeat(value[a:b], w) * index.times[place])
        yield begin, out.reshape(end - begin, items)
        begin = end


def _heaped(index, weights, documents: int, terms_: int, k: int, kinds: tuple):
    """A function for mapInArrow: the k best of each item among a task's documents."""

    def best(batches):
        ix, w = index.value, np.array(weights.value, np.int64)
        heaps, least = [[] for _ in ix.ids], np.ones(len(ix.ids), np.int64)
        for batch in batches:
            ids, codes, counts = batch.column("id").to_pylist(), batch.column("codes"), batch.column("counts")
            ptr = codes.offsets.to_numpy() - codes.offsets[0].as_py()
            for begin, score in _scores(ix, w, documents, terms_, batch.column("n").to_numpy(), ptr, codes.flatten().to_numpy(), counts.flatten().to_numpy()):
                floor = least
                if len(score) > k:
                    floor = np.maximum(least, np.partition(score, len(score) - k, axis=0)[len(score) - k])
                for d, item in zip(*np.nonzero(score >= floor)):
                    i = ids[begin + d]
                    entry, heap = (int(score[d, item]), -(_LAST if i is None else i)), heaps[item]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                    if len(heap) == k:
                        least[item] = max(1, heap[0][0])
        found = [(ix.ids[item], -d if -d != _LAST else None, s) for item, heap in enumerate(heaps) for s, d in heap]
        if found:
            task = pa.array([TaskContext.get().partitionId()] * len(found), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(zip(*found), (*kinds, pa.int64()))), task], ["item", "id", "score", "task"])

    return best


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """item, rank (int, from 1), key and score (long) of the k best documents of every item, best first, ties by key.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), N the documents with a term, df those with this one; a document
    of n terms has m = 25 + 75 n N div L, L all terms; the score sums weight * (10^9 tf div (1000 tf + 8 m)) over the item's terms.
    Keys are integers.  A null text has no terms; a null key comes last in ties; rows that repeat a key are documents of their own;
    an item without a scoring document, or with a null text, has no rows; empty tables give none."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, rows, out = docs.sparkSession, docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text")), None
    if not isinstance(rows.schema["id"].dataType, T.IntegralType):
        raise TypeError("documents are told apart by an integer key")
    kinds = (items.schema[item].dataType, rows.schema["id"].dataType)
    found = T.StructType([T.StructField("item", kinds[0]), T.StructField("id", kinds[1]), T.StructField("score", T.LongType()), T.StructField("task", T.IntegerType())])
    for block in item_blocks(items, item, item_text, block_bytes):
        block = ItemIndex(block)
        index = spark.sparkContext.broadcast(block)
        counted = T.StructType([T.StructField("id", kinds[1]), T.StructField("n", T.LongType()), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])
        matched = stored(rows.mapInArrow(_counted(index), counted), "term-counts")
        n_docs, n_terms = matched.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        holders = dict(matched.select(F.explode("codes").alias("code")).groupBy("code").count().collect())  # a row a term of the block
        weights = spark.sparkContext.broadcast([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders.get(c, 0) + 1))) for c in range(len(block.numbers))])
        heaps = matched.where(F.size("codes") > 0).mapInArrow(_heaped(index, weights, n_docs, n_terms, k, tuple(map(to_arrow_type, kinds))), found)
        out = heaps if out is None else out.unionByName(heaps)
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    some = out.withColumn("rank", F.row_number().over(Window.partitionBy("item", F.col("task") % 64).orderBy(*order))).where(F.col("rank") <= k)  # many tasks' heaps, in two steps
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("id").alias(key), "score")
