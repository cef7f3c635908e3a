"""SentencePiece encoding and decoding for merge-type vocabularies, checked against the library in every Arrow batch.

The encoder merges adjacent symbols by an agenda ordered by score (then by place), exactly as merge-type vocabularies are
meant to be read.  No merge can cross two neighbouring characters that no piece has side by side, so a text falls into
segments that are encoded alone, once for each worker's cache.  The agendas of all short segments that a batch brings anew are
worked off side by side in numpy; long segments have a heap each.  Every new segment is held against the library, as is one
whole text of each batch; where the two differ the library's ids are used and the rows say so.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "▁"
#: Segments of up to so many characters are merged side by side; the rounds are as many as the longest of them has merges.
_SHORT = 48
_NONE = np.int64(1) << 40


class PieceEncoder:
    """The agenda encoder over the pieces of a sentencepiece model of type BPE with byte fallback."""

    def __init__(self, path: str, most: int = 350_000):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        special = lambda i: lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)
        self.ids = {lib.id_to_piece(i): i for i in range(size) if not special(i)}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        side_by_side = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(b[1] == SPACE and b[0] != SPACE for b in side_by_side):
            raise ValueError("a piece holds a space after another character: texts can't be cut at spaces")
        # full stops and commas are cut off after letters, and line ends everywhere, where no piece has the two side by side
        letters = "".join(c for c in map(chr, [*range(65, 91), *range(97, 123), *range(192, 688)]) if c.isalpha() and not {c + ".", c + ","} & side_by_side)
        self.lines = not any("\n" in b for b in side_by_side) and "\n" not in self.ids
        body = f"[^{SPACE}\n]" if self.lines else f"[^{SPACE}]"
        more = f"{body[:-1]}.,]+|(?<![{letters}])[.,]" if letters else f"{body}+"
        self.segments = re.compile(f"{SPACE}*{body}(?:{more})*|{SPACE}+" + "|\n" * self.lines)
        self._pairs(size)
        digits = [str(i).encode() + b" " for i in range(size)]
        wide = max(map(len, digits))
        self.shown = np.frombuffer(b"".join(d.ljust(wide, b"\0") for d in digits), dtype=np.uint8).reshape(size, wide)
        self.shown_length = np.array([len(d) for d in digits], dtype=np.int64)
        # the cache: segment to slot; a slot is a stretch of the pool
        self.most, self.slots = most, {}
        self.start, self.length, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _pairs(self, size: int) -> None:
        """Tables for the side-by-side agendas: the symbol of a character, and of two symbols that together are a piece
        that piece and its place in the order of scores (equal scores share a place)."""
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        place = {s: k for k, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        found = sorted((self.ids[p[:k]] * size + self.ids[p[k:]], place[self.scores[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.pair_key, self.pair_place, self.pair_piece = (np.array(c, dtype=np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        # a piece one of whose halves can only be a character outside the vocabulary is left to the heap
        self.size = size

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_place[at], _NONE), self.pair_piece[at]

    def merge(self, segment: str) -> list[int]:
        """The agenda: pairs of neighbours that together are a piece, best score first, leftmost first among equals."""
        scores, symbols, n = self.scores, list(segment), len(segment)
        agenda = [(-scores[p], i, i + 1, p) for i in range(n - 1) if (p := segment[i : i + 2]) in scores]
        if agenda:
            heapq.heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                _, i, j, piece = heapq.heappop(agenda)
                if not symbols[i] or not symbols[j] or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(piece):
                    continue  # one of the two has been merged since
                symbols[i], symbols[j] = piece, ""
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (p := piece + symbols[k]) in scores:
                        heapq.heappush(agenda, (-scores[p], i, k, p))
                h = before[i]
                if h >= 0 and (p := symbols[h] + piece) in scores:
                    heapq.heappush(agenda, (-scores[p], h, i, p))
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                out += (i,) if i is not None else [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")] if self.bytes else (self.unknown,)
        return out

    def merge_all(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many segments, one after the other, and how many each has, some 2^21 characters at a time (so places fit in 22 bits)."""
        size = np.cumsum(np.minimum(np.fromiter(map(len, segments), np.int64, len(segments)), _SHORT))
        cut = [0, *(np.flatnonzero(np.diff(size >> 21)) + 1).tolist(), len(segments)]
        ids, n = zip(*(self._merged(segments[a:b]) for a, b in zip(cut, cut[1:])))
        return np.concatenate(ids), np.concatenate(n)

    def _merged(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of under 2^22 characters of short segments.

        In every round each segment takes the best pair of its agenda (the leftmost of equals) until none is left.  Segments that
        are long, or have a character that is no piece, go by `merge`."""
        n_chars = np.fromiter(map(len, segments), np.int64, len(segments))
        code = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbol, owner = self.symbol[code].astype(np.int64), np.repeat(np.arange(len(segments)), n_chars)
        alone = n_chars > _SHORT
        alone[owner[symbol < 0]] = True
        done = [(k, self.merge(segments[k])) for k in np.flatnonzero(alone).tolist()]
        parts = [(np.repeat([k for k, _ in done], [len(i) for _, i in done]).astype(np.int64), np.fromiter(chain.from_iterable(i for _, i in done), np.int64))]
        together = ~alone[owner]
        symbol, owner = symbol[together], owner[together]
        place, piece = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int64)

        def refresh(at: np.ndarray) -> None:
            """The agenda entries of the symbols at these places with their right neighbours."""
            at = at[(at >= 0) & (at < len(symbol))]
            place[at] = _NONE
            at = at[at < len(symbol) - 1]
            at = at[owner[at] == owner[at + 1]]
            place[at], piece[at] = self._look_up(symbol[at], symbol[at + 1])

        refresh(np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(place * (1 << 22) + np.arange(len(symbol)), first)  # the place in the order, then in the text
            open_ = best < _NONE * (1 << 22)
            ended = np.repeat(~open_, np.diff(first, append=len(symbol)))
            parts.append((owner[ended], symbol[ended]))
            at = best[open_] & ((1 << 22) - 1)
            symbol[at] = piece[at]
            stays = ~ended
            stays[at + 1] = False
            now = np.cumsum(stays) - 1
            at = now[at]
            symbol, owner, place, piece = symbol[stays], owner[stays], place[stays], piece[stays]
            refresh(np.concatenate((at - 1, at)))
        owner, ids = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(segments))

    def _by_library(self, segments: list[str]) -> list[list[int]]:
        """What the library makes of segments: those that begin with a space lend it to the prefix that it adds; before others a
        line end stands."""
        spaced = [s[0] == SPACE for s in segments]
        ids = self.library.encode([s[1:] if b else "\n" + s for s, b in zip(segments, spaced)], num_threads=1)
        head = len(self.library.encode("\n"))
        # a lone space: the library gives nothing for an empty text
        return [i[0 if b else head :] if s != SPACE else self.merge(s) for i, s, b in zip(ids, segments, spaced)]

    def checked(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """merge_all, and how many segments differ from the library's result, which is then taken.  Where line ends cut, the library
        reads all segments as the lines of one text; one by one it reads them only if that differs."""
        ids, n = self.merge_all(segments)
        if self.lines and all(s != "\n" for s in segments):
            line_end = np.array(self.library.encode("\n")[-1:], dtype=np.int32)
            want = np.insert(ids, np.cumsum(n) - n, line_end)
            got = self.library.encode("\n" + "\n".join(segments))
            if np.array_equal(np.array(got[len(self.library.encode("\n")) - 1 :], dtype=np.int32), want):
                return ids, n, 0
        own = np.split(ids, np.cumsum(n)[:-1])
        lib = [np.array(x, dtype=np.int32) for x in self._by_library(segments)]
        differ = sum(not np.array_equal(a, b) for a, b in zip(own, lib))
        return np.concatenate(lib), np.fromiter(map(len, lib), np.int64, len(lib)), differ

    def split(self, text: str) -> list[str]:
        """Segments of a text in the library's form: a space in front, spaces as U+2581."""
        return self.segments.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _split_in_parts(self, text: str, part: int = 200_000) -> Iterator[list[str]]:
        """The same for a very long text, some segments at a time."""
        found = (m.group() for m in self.segments.finditer(SPACE + text.replace(" ", SPACE)))
        while some := list(islice(found, part)):
            yield some

    def _forget(self) -> None:
        """Of the cache keep what has been used again, and of that at most half of what it may hold."""
        n = len(self.slots)
        kept = np.flatnonzero(self.uses[:n] > 1)
        if len(kept) > self.most // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: self.most // 2]])
        new = np.full(n, -1, np.int64)
        new[kept] = np.arange(len(kept))
        self.slots = {s: k for s, k in zip(self.slots, new.tolist()) if k >= 0}
        length = self.length[kept]
        self.pool = self.pool[_stretches(self.start[kept], length)]
        self.start, self.length, self.uses = np.cumsum(length) - length, length, self.uses[kept] // 2 + 1

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of segments, one after the other, how many each has, and how many new ones differed from the library."""
        slot, differ = np.fromiter(map(self.slots.get, segments, repeat(-1)), np.int64, len(segments)), 0
        missing = np.flatnonzero(slot < 0)
        new = list(dict.fromkeys(map(segments.__getitem__, missing.tolist())))
        if new and len(self.slots) + len(new) > self.most:
            self._forget()
            new = list(set(segments) - self.slots.keys())
            missing = np.arange(len(segments))
        if new:
            ids, n, differ = self.checked(new)
            at = len(self.slots)
            self.slots.update(zip(new, range(at, at + len(new))))
            self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(n) - n))
            self.length, self.uses = np.concatenate((self.length, n)), np.concatenate((self.uses, np.zeros(len(new), np.int64)))
            self.pool = np.concatenate((self.pool, ids))
            slot[missing] = np.fromiter((self.slots[segments[k]] for k in missing.tolist()), np.int64, len(missing))
        self.uses += np.bincount(slot, minlength=len(self.uses))
        length = self.length[slot]
        return self.pool[_stretches(self.start[slot], length)], length, differ

    def encode_texts(self, texts: list[str]) -> tuple[list[np.ndarray], int]:
        """Ids of whole texts, with the end id."""
        end, differ = np.array([self.end], np.int32), 0
        if len(texts) == 1 and len(texts[0]) > 1 << 20:
            parts = []
            for some in self._split_in_parts(texts[0]):
                ids, _, bad = self.encode(some)
                parts.append(ids)
                differ += bad
            return [np.concatenate([*parts, end])], differ
        split = [self.split(t) for t in texts]
        ids, n, differ = self.encode(list(chain.from_iterable(split)))
        edge = np.concatenate(([0], np.cumsum(n)))[np.cumsum([0, *map(len, split)])]
        return [np.concatenate((ids[a:b], end)) for a, b in zip(edge[:-1], edge[1:])], differ

    def decimal(self, ids: np.ndarray) -> bytes:
        """Ids in decimal digits, one space between two."""
        return self.shown[ids][np.arange(self.shown.shape[1]) < self.shown_length[ids][:, None]].tobytes()[:-1]


def _stretches(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start[k] to start[k] + length[k] - 1 for every k, one after the other."""
    return np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, PieceEncoder(path))


def _batches(texts: pa.Array, rows: int = 200, chars: int = 1 << 19) -> Iterator[list[str]]:
    """Up to `rows` texts of up to `chars` characters together; a longer text is a batch of its own."""
    held, size = [], 0
    for t in texts:
        one = t.as_py() or ""
        if held and (len(held) >= rows or size + len(one) > chars):
            yield held
            held, size = [], 0
        held.append(one)
        size += len(one)
    if held:
        yield held


def encoded_texts(enc: PieceEncoder, texts: list[str]) -> Iterator[tuple[np.ndarray, int, bool | None]]:
    """For each text of a batch its ids, the number of segments of the batch where agenda and library differed, and for the text
    with the smallest checksum whether the library agrees on it as a whole (else null); if not, its ids are the library's."""
    found, differ = enc.encode_texts(texts)
    probe = min(range(len(texts)), key=lambda k: hashlib.sha256(texts[k].encode("utf-8", "surrogatepass")).digest()) if len(texts) > 1 else 0
    for k, ids in enumerate(found):
        if k != probe:
            yield ids, differ, None
            continue
        lib = np.array(enc.library.encode(texts[k], add_eos=True), dtype=np.int32)
        agrees = np.array_equal(lib, ids)
        yield ids if agrees else lib, differ, agrees


def piece_digests(path: str, text: str = "text") -> Column:
    """A struct for the whole text: n_tokens (with the end id), ids_sha256, decoded_sha256 (of the library's decoding of these
    ids), differing (segments of its batch where the agenda and the library differ: 0 is expected), and whole_agrees: for one
    text of each batch whether the library's ids of the whole text are the same (null for the others).

    A null text is empty; it has the end id alone.  Repeated rows get the same digests, an empty table gives no row, and a very
    long text is read some segments at a time.
    """

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string, differing: int, whole_agrees: boolean>")
    def digests(texts: pa.Array) -> pa.Array:
        enc, rows = _encoder(path), []
        for some in _batches(texts):
            got = list(encoded_texts(enc, some))
            for (i, differ, agrees), d in zip(got, enc.library.decode([i.tolist() for i, _, _ in got], num_threads=1)):
                rows.append((len(i), hashlib.sha256(enc.decimal(i)).hexdigest(), hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest(), differ, agrees))
        kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("differing", pa.int32()), ("whole_agrees", pa.bool_())]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return digests(F.col(text))


def piece_ids(path: str, text: str = "text") -> Column:
    """The ids themselves, with the end id: array<int>."""

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        enc = _encoder(path)
        return pa.array([i for some in _batches(texts) for i, _, _ in encoded_texts(enc, some)], pa.list_(pa.int32()))

    return encoded(F.col(text))
