"""Exact document fingerprints: canonical form, a wide xxhash of it, and comparison of the bytes inside equal buckets.

The canonical form is NFKC, case folding, NFKC again, and every run of white space as one space.  Equal digests are one
fingerprint only if the canonical texts agree byte for byte; should two texts ever share a digest, an ordinal tells them apart.
Which rows need that comparison is known from a bit map of a fixed size over the digests that occur twice.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.llm.common import stored

_MAP_BITS = 1 << 24


def canonical(text: str | None) -> str:
    """Null is empty."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return " ".join(nfkc(nfkc(text).casefold()).split())


def digest(form: str, hex_digits: int = 32) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))[:hex_digits]


def digest_column(text: str = "text", hex_digits: int = 32) -> Column:
    @F.arrow_udf("string")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([digest(canonical(t.as_py()), hex_digits) for t in texts], pa.string())

    return fingerprint(F.col(text))


def _slot(column: str = "fingerprint") -> Column:
    return F.pmod(F.xxhash64(column), F.lit(_MAP_BITS))


def clashes(docs: DataFrame, digests: DataFrame, key: str, text: str, hex_digits: int = 32) -> DataFrame:
    """Rows id, fingerprint, ordinal of the digests that stand for more than one canonical text (as a rule none).

    digests has a row a document with column fingerprint.  A bit map (2 MB, whatever the input) of the digests that occur
    twice picks the rows whose canonical text is compared; rows it picks by chance do no harm.
    """
    spark = docs.sparkSession
    twice = digests.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select(_slot().alias("slot"))
    maps = twice.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    parts = spark.sparkContext.broadcast({r["part"]: bytes(r["bits"]) for r in maps.collect()})

    @F.arrow_udf("string")
    def wanted(texts: pa.Array, found: pa.Array, slots: pa.Array) -> pa.Array:
        maps = parts.value
        out = []
        for t, part, bit in zip(texts, found.to_pylist(), slots.to_pylist()):
            bits = maps.get(part)
            out.append(canonical(t.as_py()) if bits and bits[bit >> 3] >> (bit & 7) & 1 else None)
        return pa.array(out, pa.string())

    hashed = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), digest_column(text, hex_digits).alias("fingerprint"))
    slots = hashed.withColumn("slot", _slot())
    forms = slots.select("id", "fingerprint", wanted(F.col("t"), F.bitmap_bucket_number("slot"), F.bitmap_bit_position("slot")).alias("form")).where("form IS NOT NULL")
    same = forms.groupBy("fingerprint", "form").agg(F.count("*").alias("n"))  # compares the bytes, combined before the shuffle
    several = stored(same.groupBy("fingerprint").agg(F.count("*").alias("forms")).where("forms > 1").select("fingerprint"), "clashes")
    if several.isEmpty():
        return several.select(F.lit(None).cast(docs.schema[key].dataType).alias("id"), "fingerprint", F.lit(0).alias("ordinal"))
    rank = F.dense_rank().over(Window.partitionBy("fingerprint").orderBy("form")) - 1
    return forms.join(several, "fingerprint", "left_semi").select("id", "fingerprint", rank.alias("ordinal")).distinct()


def exact_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", hex_digits: int = 32) -> DataFrame:
    """One row a row of docs: key, fingerprint.  Equal canonical texts, and only those, have equal fingerprints."""
    rows = stored(docs.select(F.col(key).alias("id"), digest_column(text, hex_digits).alias("fingerprint")), "digests")
    return _told_apart(rows, docs, key, text, hex_digits).withColumnRenamed("id", key)


def _told_apart(rows: DataFrame, docs: DataFrame, key: str, text: str, hex_digits: int) -> DataFrame:
    found = clashes(docs, rows, key, text, hex_digits).select(F.col("id").alias("c_id"), F.col("fingerprint").alias("c_fp"), "ordinal").where("ordinal > 0")
    if found.isEmpty():
        return rows
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("fingerprint") == F.col("c_fp")), "left")
    mark = F.when(F.col("ordinal").isNull(), F.col("fingerprint")).otherwise(F.concat_ws("-", "fingerprint", "ordinal"))
    return joined.withColumn("fingerprint", mark).select(*rows.columns)


_PAIR = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, seq bigint, edge string, first_text string"


def _pair(text: str, after: str, hex_digits: int) -> tuple:
    """What compares a text with its edited form (the end replaced by the start of the next text) and with the next text."""
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    form, edited_form, after_form = canonical(text), canonical(edited), canonical(after)
    return len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(form, hex_digits), digest(edited_form, hex_digits), float(form == edited_form), float(form == after_form)


def next_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", hex_digits: int = 32) -> DataFrame:
    """Fingerprints of every text and of its edited text, see `_pair`, in ascending order of key (nulls first, ties by text;
    after the last row comes the first).

    One range shuffle; a task pairs neighbours as it reads its sorted range.  The last row of a range needs the first of the next
    range that has rows: those edge rows, two a partition, come with their texts and are paired in a second, small step.
    """
    kind = docs.schema[key].dataType.simpleString()
    ordered = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).repartitionByRange("id").sortWithinPartitions("id", "t")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, first = TaskContext.get().partitionId(), 0, None, None
        schema = None
        for batch in batches:
            schema = pa.schema([batch.schema.field("id"), *_ARROW])
            ids, texts = batch.column("id"), batch.column("t")
            out, out_ids = [], []
            for i in range(batch.num_rows):
                one = (ids[i], texts[i].as_py())
                if held is None:
                    first = one[1]
                else:
                    out.append((*_pair(held[1], one[1], hex_digits), part, n, None, first if n == 0 else None))
                    out_ids.append(held[0])
                    n += 1
                held = one
                if len(out) >= 1000:
                    yield _batch(out_ids, out, schema)
                    out, out_ids = [], []
            if out:
                yield _batch(out_ids, out, schema)
        if held is not None:
            yield _batch([held[0]], [(None, None, None, None, None, None, part, n, held[1], first if n == 0 else None)], schema)

    rows = stored(ordered.mapInArrow(paired, f"id {kind}, {_PAIR}"), "edits")
    firsts = rows.where("first_text IS NOT NULL").select("part", "first_text")  # one row a partition
    order = Window.orderBy("part")  # over partition numbers, not over rows
    after = firsts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next_part"))
    ends = rows.where("edge IS NOT NULL").join(after, "part").join(firsts.select(F.col("part").alias("next_part"), F.col("first_text").alias("next_text")), "next_part")

    @F.arrow_udf("struct<n_chars: bigint, edited_sha256: string, fingerprint: string, edited_fingerprint: string, near_edited: double, near_next: double>")
    def pair(texts: pa.Array, after: pa.Array) -> pa.Array:
        cells = [_pair(a.as_py(), b.as_py(), hex_digits) for a, b in zip(texts, after)]
        return pa.StructArray.from_arrays([pa.array([c[k] for c in cells], f.type) for k, f in enumerate(_ARROW[:6])], fields=_ARROW[:6])

    names = ["id", *(f.name for f in _ARROW[:6])]
    closed = ends.select("id", pair("edge", "next_text").alias("p")).select("id", "p.*")
    return rows.where("edge IS NULL").select(*names).unionByName(closed.select(*names))


_ARROW = [pa.field(n, t) for n, t in (("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("seq", pa.int64()), ("edge", pa.string()), ("first_text", pa.string()))]


def _batch(ids: list, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([x.as_py() for x in ids], schema.field("id").type)]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW))], schema=schema)


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", hex_digits: int = 32) -> DataFrame:
    """next_edits with the fingerprints told apart where digests clash.  likeness is 1.0 for equal canonical bytes, else 0.0:
    an exact fingerprint has no degrees.  An empty table gives an empty result, a lone row is its own next row."""
    rows = stored(next_edits(docs, key, text, hex_digits), "pairs")
    return _told_apart(rows, docs, key, text, hex_digits).withColumnRenamed("id", key)
