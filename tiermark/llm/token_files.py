"""Token ids in binary files: one concatenated id array a file, and its document boundaries in Elias-Fano form.

File: magic "TMTOK1\\0\\0", then as little-endian uint64 shard, chunk, width (bytes an id), n_docs, n_ids, low_bits, then these
arrays, each padded to 8 bytes: document ids (int64), null flags (bits), low bits (packed), high bits (unary, bits), select
samples (uint32: place of every 256th one), token ids (uint16 or uint32).  The end of document k is select(k) - k in the high
part, joined with its low bits: 2 + low_bits bits a document instead of a table of 64-bit offsets.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.llm.common import read_blobs, scratch_dir, stored, write_blobs

MAGIC = b"TMTOK1\0\0"
_STEP = 256


class EliasFano:
    """A non-decreasing sequence of n values up to `top`."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones[::_STEP].astype(np.uint32))

    def select(self, k: int) -> int:
        """Place of the k-th one (from 0): from the nearest sample on, by counts of whole bytes."""
        place = int(self.samples[k // _STEP])
        rest = k % _STEP
        byte = place >> 3
        first = int(self.high[byte]) >> (place & 7) << (place & 7)  # ones before the sample don't count
        while (n := first.bit_count()) <= rest:
            rest -= n
            byte += 1
            first = int(self.high[byte])
        for _ in range(rest):
            first &= first - 1
        return 8 * byte + (first & -first).bit_length() - 1

    def __getitem__(self, k: int) -> int:
        low, at = 0, k * self.low_bits
        for j in range(self.low_bits):
            low |= (int(self.low[(at + j) >> 3]) >> ((at + j) & 7) & 1) << j
        return (self.select(k) - k) << self.low_bits | low

    def all(self) -> np.ndarray:
        """Every value at once."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        low = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits).astype(np.int64)
        return (high << self.low_bits) + low @ (1 << np.arange(self.low_bits, dtype=np.int64))


def _padded(a: np.ndarray) -> bytes:
    raw = a.tobytes()
    return len(raw).to_bytes(8, "little") + raw + b"\0" * (-len(raw) % 8)


def pack_file(shard: int, chunk: int, doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """ids: little-endian, `width` bytes each."""
    ends = np.cumsum(np.array(lengths, dtype=np.int64))
    ef = EliasFano.encode(ends, int(ends[-1]) if len(ends) else 0)
    head = np.array([shard, chunk, width, len(doc_ids), len(ids) // width, ef.low_bits], dtype="<u8").tobytes()
    arrays = (np.array([d or 0 for d in doc_ids], dtype="<i8"), np.packbits([d is None for d in doc_ids], bitorder="little"), ef.low, ef.high, ef.samples, np.frombuffer(ids, dtype=np.uint8))
    return MAGIC + head + b"".join(map(_padded, arrays)) + b"\0" * 8


class TokenFile:
    """Reader of one file's bytes: any document's ids without reading the others' offsets."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.shard, self.chunk, width, self.n_docs, self.n_ids, low_bits = (int(x) for x in np.frombuffer(data, dtype="<u8", count=6, offset=8))
        at, parts = 56, []
        for _ in range(6):
            n = int.from_bytes(data[at : at + 8], "little")
            parts.append(np.frombuffer(data, dtype=np.uint8, count=n, offset=at + 8))
            at += 8 + n + -n % 8
        null = np.unpackbits(parts[1], count=self.n_docs, bitorder="little")
        self.doc_ids = [None if z else int(d) for d, z in zip(parts[0].view("<i8"), null)]
        self.ends = EliasFano(self.n_docs, low_bits, parts[2], parts[3], parts[4].view("<u4"))
        self.ids = parts[5].view("<u2" if width == 2 else "<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.ends[k - 1] if k else 0 : self.ends[k]]


class WordCache(dict):
    """Ids of a whole text by way of its words, with a bounded cache of words already encoded.

    The tokenizer drops white space and never joins what it separates, so a text may be cut at blanks, tabs and line ends;
    nor does it join a letter and a full stop or comma, so a blank may go between.  Texts of Latin-1 characters may be
    lower-cased first.  Words of such letters alone need no normalizer and no cutting: the library's model reads their bytes
    in its alphabet.  Everything else goes through the library's whole path; texts with a special token are encoded whole.
    `cuts` says whether probes confirm all that for the tokenizer at hand; if not, every text is encoded whole.
    """

    _LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
    _OTHER_STOP = re.compile(f"[.,](?<![{_LETTERS}][.,])")  # one that follows no letter
    _STOP = re.compile(f"(?<=[{_LETTERS}])(?=[.,])")
    _LATIN = re.compile(f"[{_LETTERS}]+")

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.code = f"<u{self.width}", "H" if self.width == 2 else "I"  # as little-endian machines have them
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(s) for s in specials), re.I) if specials else None
        # the byte alphabet: printable bytes are themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        probe = ["Ab. c,d\n\te", "über, Ärger.\n", "x.. ,y a.b", "ÿÞorn ªº µ ß"]
        self.cuts = True
        self.cuts = all(self._whole(p) == self.encode(p) for p in probe)
        self.clear()

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _words(self, text: str) -> list[str]:
        if text.isascii() or max(text) < "\u0100":
            text = text.lower()
        if self._OTHER_STOP.search(text):
            text = self._STOP.sub(" ", text)
        else:
            text = text.replace(".", " .").replace(",", " ,")
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def __missing__(self, word: str) -> bytes:
        if self._LATIN.fullmatch(word):
            shown = word.lower() if word.isascii() else word.lower().encode().decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        found = self[word] = array(self.code, ids).tobytes()
        return found

    def encode(self, text: str) -> bytes:
        if not self.cuts or self.special and self.special.search(text):
            return self._whole(text)
        if len(self) > self.most:
            self.clear()
        return b"".join(map(self.__getitem__, self._words(text)))


_CACHES: dict[str, WordCache] = {}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, file_bytes: int = 4 << 20) -> None:
    """Every whole text, with end_id at its end, in ascending order of key (nulls first, ties by text) over the files: shards are
    the ranges of one range shuffle, chunks the files of a shard, of about file_bytes each."""
    ordered = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).repartitionByRange("id").sortWithinPartitions("id", "t")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _CACHES.get(tokenizer) or _CACHES.setdefault(tokenizer, WordCache(tokenizer))
        shard, chunk, end = TaskContext.get().partitionId(), 0, np.array([end_id], dtype=cache.kind).tobytes()
        ids, lengths, held, size = [], [], [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack_file(shard, chunk, ids, lengths, b"".join(held), cache.width)], pa.binary())], names=["blob"])

        for batch in batches:
            for d, t in zip(batch.column("id"), batch.column("t")):
                tokens = cache.encode(t.as_py())
                ids.append(d.as_py())
                lengths.append(len(tokens) // cache.width + 1)
                held += (tokens, end)
                size += len(tokens) + len(end)
                if size >= file_bytes:
                    yield file()
                    ids, lengths, held, size, chunk = [], [], [], 0, chunk + 1
        if ids:
            yield file()

    write_blobs(ordered.mapInArrow(packed, "blob binary"), "blob", path)


_ROW = "shard int, chunk int, place int, id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row a document: where it is (shard, chunk, place), its id, start within the file, length, and crc32 of its ids as uint32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                f = TokenFile(data.as_py())
                ends = f.ends.all()
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                wide = memoryview(f.ids.astype("<u4").tobytes())
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = f.n_docs
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, f.shard, np.int32)), pa.array(np.full(n, f.chunk, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(f.doc_ids, pa.int64()), pa.array(starts), pa.array((ends - starts).astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["shard", "chunk", "place", "id", "local_start", "n_tokens", "ids_crc32"],
                )

    return read_blobs(spark, path).mapInArrow(read, _ROW)


def token_offsets(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Texts to token files and back: key, start (ids of all documents before it in the order of the files), n_tokens, ids_crc32.

    A null text is empty and has the end id alone; repeated rows are documents of their own; an empty table gives no row.
    """
    spark = docs.sparkSession
    path = scratch_dir(spark, "tokens")
    write_token_files(docs, path, tokenizer, key, text, end_id)
    rows = stored(read_token_files(spark, path), "rows")
    files = rows.groupBy("shard", "chunk").agg(F.sum("n_tokens").alias("ids"))
    shards = files.groupBy("shard").agg(F.sum("ids").alias("of_shard"))
    shards = shards.select("shard", (F.sum("of_shard").over(Window.orderBy("shard")) - F.col("of_shard")).alias("shard_start"))  # over shards, not rows
    starts = files.join(shards, "shard").select("shard", "chunk", (F.col("shard_start") + F.sum("ids").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("ids")).alias("file_start"))
    return rows.join(starts, ["shard", "chunk"]).select(F.col("id").alias(key), (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
