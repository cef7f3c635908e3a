"""Removal of passages that a document with a smaller key holds too, byte for byte, by suffix arrays.

Every window of `length` bytes belongs to the least hash of the 16-byte grams in it, so equal windows of any two documents belong to
the same hash.  Runs of neighbouring windows with one hash are cut out as a string; hashes that only one document has are left
behind.  The strings of a hash meet in one task, which sorts the suffixes of all of them (suffix_groups) and reads off which windows are
equal and whose key is the smallest.  What is found goes back to the documents as intervals.

Documents are stored once, in a table bucketed by batch; after that only hashes, strings and intervals are shuffled.
"""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiermark.llm.common import scratch_dir, stored, text_or_empty
from tiermark.llm.suffix_groups import suffix_orders

_GRAM = 16
_NULL = (1 << 63) - 1  # in place of a null key: larger than every other
_PIECE = 1 << 18  # bytes of documents whose windows are hashed together
_RUN = 64  # windows of a string at most
_LANE = 16  # strings that are sorted together; more are dealt out once more, by other hashes


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    return x[: len(data)]


def _runs(texts: list[bytes], length: int, seed: int = 0):
    """hash, document, start, windows of the runs of windows with one hash in texts; another seed, other hashes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    if n < length:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    words = _words(np.frombuffer(b"".join(texts), np.uint8))
    low = _hash((words[:-8] + np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93) + _hash(words[8:]))
    span = length - _GRAM + 1  # grams in a window
    step, at = 1, low
    while 2 * step <= span:
        at, step = np.minimum(at[:-step], at[step:]), 2 * step
    if span > step:
        at = np.minimum(at[: step - span], at[span - step :])
    at = at[: n - length + 1]
    begins, windows = np.cumsum(sizes) - sizes, np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(texts)), windows)
    place = np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(len(doc))
    if not len(doc):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    value = at[place]
    new = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])))
    count = np.diff(np.append(new, len(doc)))
    parts = -(-count // _RUN)
    which = np.repeat(np.arange(len(new)), parts)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = new[which] + inside * _RUN
    return value[first], doc[first], place[first] - begins[doc[first]], np.minimum(count[which] - inside * _RUN, _RUN)


def _pieces(texts: list[bytes]):
    """Index of the first text and texts, about _PIECE bytes at a time."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= _PIECE:
            yield begin, texts[begin : k + 1]
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def _bodies(table) -> tuple[list[bytes], list[int]]:
    """Texts and keys of a batch in the order of their places."""
    table = table.sort_by("place")
    return [t.encode() for t in table.column("text").to_pylist()], [_NULL if k is None else k for k in table.column("key").to_pylist()]


def _lists(rows: dict[int, dict[str, list]], tag: str, kinds: dict) -> pa.Table:
    """A row for each number in rows, its lists in array columns."""
    tags = list(rows)
    columns = {tag: pa.array(tags, pa.int64())}
    for name, kind in kinds.items():
        columns[name] = pa.array([rows[k][name] for k in tags], pa.list_(kind))
    return pa.table(columns)


_SEEN = {"hash": pa.int64(), "docs": pa.int32()}
_SHARED = {"hash": pa.int64(), "docs": pa.int32()}
_STRINGS = {"hash": pa.int64(), "doc": pa.int32(), "key": pa.int64(), "bytes": pa.int32(), "starts": pa.int32(), "start": pa.int32(), "sure_doc": pa.int32(), "sure_start": pa.int32(), "sure_windows": pa.int32()}
_MARKS = {"doc": pa.int32(), "start": pa.int32(), "windows": pa.int32()}
_SQL = {pa.int64(): "bigint", pa.int32(): "int"}


def _schema(kinds: dict, *tags: str) -> str:
    return ", ".join([*(f"{t} bigint" for t in tags), *(f"{n} array<{_SQL[k]}>" for n, k in kinds.items())])


def _by_range(hashes: np.ndarray, ranges: int):
    """range and members of each range that hashes fall into."""
    at = (hashes % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    cut = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1])) if len(order) else []
    for a, b in zip(cut, [*cut[1:], len(order)]):
        yield int(at[order[a]]), order[a:b]


@contextlib.contextmanager
def _uncollected():
    """With Python's collector of cycles off: there are none, and it would walk the growing lists again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _seen(length: int, ranges: int):
    """For applyInArrow: the hashes of a batch, with the number of documents that have each, by range."""

    def seen(key, table):
        texts, _ = _bodies(table)
        found = [(h, d + k) for k, some in _pieces(texts) for h, d, _, _ in [_runs(some, length)]]
        hashes, docs = (np.concatenate([f[j] for f in found]) for j in (0, 1)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.lexsort((docs, hashes))
        hashes, docs = hashes[order], docs[order]
        once = np.append(True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])) if len(hashes) else np.zeros(0, bool)
        hashes, count = np.unique(hashes[once], return_counts=True)
        rows = {r: {"hash": hashes[m].view(np.int64), "docs": count[m]} for r, m in _by_range(hashes, ranges)}
        return _lists(rows, "range", _SEEN).append_column("batch", pa.array([key[0].as_py()] * len(rows), pa.int64())).select(["range", "batch", *_SEEN])

    return seen


def _shared(_, table):
    """For applyInArrow by range: the hashes that two documents have, for each batch that has them, with the number of documents."""
    batches = np.repeat(table.column("batch").to_numpy(), pc.list_value_length(table.column("hash")).to_numpy())
    hashes, docs = (np.concatenate([c.flatten().to_numpy() for c in table.column(n).chunks]) for n in ("hash", "docs"))
    _, which = np.unique(hashes, return_inverse=True)
    total = np.bincount(which, weights=docs)[which]
    rows = {}
    keep = np.flatnonzero(total > 1)
    keep = keep[np.argsort(batches[keep], kind="stable")]
    cut = np.flatnonzero(np.append(True, batches[keep][1:] != batches[keep][:-1])) if len(keep) else []
    for a, b in zip(cut, [*cut[1:], len(keep)]):
        m = keep[a:b]
        rows[int(batches[m[0]])] = {"hash": hashes[m], "docs": np.minimum(total[m], 2**31 - 1).astype(np.int32)}
    return _lists(rows, "batch", _SHARED)


def _taken(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parts of values from first on, sizes long, one after another."""
    return values[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def _strings(length: int, ranges: int, most: int):
    """For cogroup: the strings of a batch whose hash is shared, by range.  Of documents with the same string only that of the smallest
    key sends it; the windows of the others are sure to go."""

    def strings(key, table, shared):
        texts, keys = _bodies(table)
        data, begins, keys = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.array(keys, np.int64)
        wanted = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in shared.column("hash").chunks)]).view(np.uint64)
        docs = np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in shared.column("docs").chunks)])
        order = np.argsort(wanted)
        wanted, docs = wanted[order], docs[order]
        found = [[np.zeros(0, np.uint64)], *([np.zeros(0, np.int64)] for _ in range(4))]
        for k, some in _pieces(texts) if len(wanted) else ():
            hashes, doc, start, windows = _runs(some, length)
            at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            kept = np.flatnonzero(wanted[at] == hashes)
            for column, v in zip(found, (hashes[kept], doc[kept] + k, start[kept], windows[kept], docs[at[kept]])):
                column.append(v)
        lane, doc, start, windows, crowd = (np.concatenate(c) for c in found)
        order = np.argsort(lane, kind="stable")
        lane, doc, start, windows, crowd = (v[order] for v in (lane, doc, start, windows, crowd))
        change = np.append(True, lane[1:] != lane[:-1]) if len(lane) else np.zeros(0, bool)
        alone = change & np.append(change[1:], True) & (crowd < most) if len(lane) else change
        out = [[v[alone]] for v in (lane, doc, begins[doc] + start, windows + length - 1, np.ones(len(lane), np.int64))]
        starts, sure = [start[alone]], [[], [], [], []]
        held: dict = {}
        for h, d, s, w, c in zip(*(v[~alone].tolist() for v in (lane, doc, start, windows, crowd))):
            held.setdefault((h, c, texts[d][s : s + w + length - 1]), {}).setdefault(d, []).append(s)
        rest: list = [[], [], [], [], []]
        for (h, c, string), by_doc in held.items():
            least = min(keys[d] for d in by_doc)
            for d, at in by_doc.items():
                if keys[d] > least:
                    for column, v in zip(sure, ([h] * len(at), [d] * len(at), at, [len(string) - length + 1] * len(at))):
                        column += v
                elif c < most:  # rows that repeat a key all send it
                    for column, v in zip(rest, (h, d, int(begins[d]) + at[0], len(string), len(at))):
                        column.append(v)
                    starts.append(at)
                else:
                    for x in range(len(string) - length + 1):
                        share = (h + xxhash.xxh3_64_intdigest(string[x : x + length]) % max(2, c // 8) * 0x9E3779B97F4A7C15) % (1 << 64)
                        for column, v in zip(rest, (share, d, int(begins[d]) + at[0] + x, length, len(at))):
                            column.append(v)
                        starts.append([s + x for s in at])
        lane, doc, at, size, n = (np.concatenate([v[0], np.array(r, v[0].dtype)]) for v, r in zip(out, rest))
        starts = np.concatenate([np.asarray(v, np.int64) for v in starts])
        sure_range = np.array(sure[0], np.uint64) % np.uint64(ranges)
        target = lane % np.uint64(ranges)
        likeness = _words(data)[at] if len(at) else at
        order = np.lexsort((likeness, target))  # likely neighbours, so the text is packed well
        lane, doc, at, size, n, target, first = (v[order] for v in (lane, doc, at, size, n, target, np.cumsum(n) - n))
        starts, text, sure_order = _taken(starts, first, n), _taken(data, at, size), np.argsort(sure_range, kind="stable")
        sent = np.union1d(target, sure_range)

        def cut(by, values=None):  # offsets of each range in what is ordered by range
            upto = np.append(np.searchsorted(by, sent), len(by))
            return upto if values is None else np.append(0, np.cumsum(values))[upto]

        lists = lambda offsets, v, t: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, t))
        own, of_text = cut(target), cut(target, size)
        packed = [pa.compress(text[x:y].tobytes(), codec="zstd", asbytes=True) for x, y in zip(of_text, of_text[1:])]
        columns = [pa.array(sent.astype(np.int64)), pa.array([key[0].as_py()] * len(sent), pa.int64()), pa.array(packed, pa.binary())]
        values = {"hash": lane.view(np.int64), "doc": doc, "key": keys[doc], "bytes": size, "starts": n}
        columns += [lists(own, v, _STRINGS[c]) for c, v in values.items()] + [lists(cut(target, n), starts, pa.int32())]
        columns += [lists(cut(sure_range[sure_order]), np.array(v, np.int64)[sure_order], pa.int32()) for v in sure[1:]]
        return pa.table(columns, names=["range", "batch", "text", *_STRINGS])

    def run(key, table, shared):
        with _uncollected():
            return strings(key, table, shared)

    return run


def repeated_windows(lanes: list[list[tuple[bytes, int]]], length: int) -> list[list[np.ndarray]]:
    """For every string of every lane (strings with their keys) the windows, by their starts, that a string of a smaller key in the
    same lane has: by the suffix array of the lane's strings, in which equal windows stand together."""
    data, owner, lane_size, first_window = [], [], [], []
    for lane in lanes:
        size = 0
        for string, key in lane:
            data.append(string)
            size += len(string) + 1
            owner.append(key)
        lane_size.append(size)
    sizes = np.array([len(s) for s in data], np.int64)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    raw = np.frombuffer(b"\0".join(data) + b"\0", np.uint8)
    symbols = raw.astype(np.uint16) + np.uint16(2)
    symbols[begins + sizes] = 1
    ends = np.cumsum(lane_size)
    symbols[ends - 1] = 0
    order = suffix_orders(symbols, np.array(lane_size))
    string_of = np.repeat(np.arange(len(sizes)), sizes + 1)
    lane_of = np.repeat(np.arange(len(lanes)), lane_size)
    whole = np.arange(len(raw)) - begins[string_of] <= sizes[string_of] - length
    windows = order[whole[order]]
    words = _words(raw)
    a, b = windows[:-1], windows[1:]
    same = lane_of[a] == lane_of[b]
    for step in [*range(0, length - 7, 8), length - 8]:
        same[same] = words[a[same] + step] == words[b[same] + step]
    new = np.flatnonzero(np.append(True, ~same))
    keys = np.array(owner, np.int64)[string_of[windows]]
    least = np.repeat(np.minimum.reduceat(keys, new), np.diff(np.append(new, len(windows))))
    hit = np.sort(windows[keys > least])
    cut = np.searchsorted(hit, np.append(begins, len(raw)))
    found, k = [], 0
    for lane in lanes:
        found.append([hit[cut[k + x] : cut[k + x + 1]] - begins[k + x] for x in range(len(lane))])
        k += len(lane)
    return found


def _marks(length: int, most: int = 4 << 20):
    """For applyInArrow by range: the windows that go, by batch."""

    def marks(_, table):
        lanes: dict = defaultdict(dict)
        rows: dict = defaultdict(lambda: {n: [] for n in _MARKS})
        flat = {n: table.column(n).combine_chunks() for n in _STRINGS}
        ends = {n: (c.offsets.to_numpy() - c.offsets[0].as_py()).tolist() for n, c in flat.items()}
        values = {n: c.flatten().to_numpy().tolist() for n, c in flat.items()}
        for k, (batch, text) in enumerate(zip(table.column("batch").to_pylist(), table.column("text").to_pylist())):
            hashes, docs, keys, lengths, counts, starts, *sure = (values[n][ends[n][k] : ends[n][k + 1]] for n in _STRINGS)
            row, at, place = rows[batch], 0, 0
            text = pa.decompress(text, sum(lengths), codec="zstd", asbytes=True)
            for name, v in zip(_MARKS, sure):
                row[name] += v
            for h, d, key, size, n in zip(hashes, docs, keys, lengths, counts):
                lanes[h].setdefault(text[place : place + size], []).append((key, batch, d, starts[at : at + n]))
                at, place = at + n, place + size

        def mark(holder, first, windows):
            _, batch, d, starts = holder
            row = rows[batch]
            for s in starts:
                row["doc"] += [d] * len(first)
                row["start"] += [s + x for x in first]
                row["windows"] += windows

        todo, size = [], 0
        for lane in lanes.values():
            todo.append(lane)
            size += len(lane) * 2 * length
            if size >= most:
                _settle(todo, length, mark)
                todo, size = [], 0
        _settle(todo, length, mark)
        return _lists({b: r for b, r in rows.items() if r["doc"]}, "batch", _MARKS)

    def run(key, table):
        with _uncollected():
            return marks(key, table)

    return run


def _compared(strings: list[tuple[bytes, int, int, int]], length: int, hit, seed: int = 1) -> list[list[tuple[bytes, int, int, int]]]:
    """The strings of a lane (string, key, number, offset) as lists to be sorted together: many are cut into runs of windows again, by
    another hash, and the runs of a hash make a list, so equal windows meet again.  Many that four hashes don't part (one window
    among hardly any others) are compared window by window, and hit(number, place) is told of those that go."""
    if len(strings) <= _LANE:
        return [strings]
    parts: dict = defaultdict(list)
    if seed > 4:
        for string, key, number, offset in strings:
            for x in range(len(string) - length + 1):
                parts[string[x : x + length]].append((key, number, offset + x))
        for same in parts.values():
            least = min(same)[0]
            for key, number, place in same:
                if key > least:
                    hit(number, place)
        return []
    for h, k, start, windows in zip(*(x.tolist() for x in _runs([s[0] for s in strings], length, seed))):
        string, key, number, offset = strings[k]
        parts[h].append((string[start : start + windows + length - 1], key, number, offset + start))
    return [p for part in parts.values() if len(part) > 1 for p in _compared(part, length, hit, seed + 1)]


def _settle(lanes: list[dict], length: int, mark) -> None:
    """Tell mark of all windows to remove in lanes (string to its holders); a lane of one string has no other to compare with."""
    found: list = [[[] for _ in lane] for lane in lanes]
    parts = []
    for of_lane, lane in zip(found, lanes):
        if len(lane) > 1:
            listed = [(s, holders[0][0] if len(holders) == 1 else min(h[0] for h in holders), n, 0) for n, (s, holders) in enumerate(lane.items())]
            parts += [(of_lane, part) for part in _compared(listed, length, lambda n, place, of_lane=of_lane: of_lane[n].append([place]))]
    parts.sort(key=lambda p: sum(len(s[0]) for s in p[1]))
    hits = repeated_windows([[(s, key) for s, key, _, _ in part] for _, part in parts], length) if parts else []
    for (of_lane, part), at in zip(parts, hits):
        for (_, _, n, offset), windows in zip(part, at):
            if len(windows):
                of_lane[n].append((windows + offset).tolist())
    for lane, of_lane in zip(lanes, found):
        for (string, holders), at in zip(lane.items(), of_lane):
            if len(holders) == 1 and not at:
                continue
            least, all_of_it = min(h[0] for h in holders), len(string) - length + 1
            at = np.unique(np.concatenate(at)).tolist() if len(at) > 1 else list(at[0]) if at else at
            if at and at[-1] - at[0] == len(at) - 1:
                first, windows = [at[0]], [len(at)]
            else:
                cut = [k for k, x in enumerate(at) if not k or x != at[k - 1] + 1]
                first, windows = [at[k] for k in cut], [b - a for a, b in zip(cut, [*cut[1:], len(at)])]
            for holder in holders:
                if holder[0] > least:
                    mark(holder, [0], [all_of_it])
                elif first:
                    mark(holder, first, windows)


def _removed(length: int, kind):
    """For cogroup: a batch's documents without the marked windows."""

    def removed(key, table, marks):
        texts, keys = _bodies(table)
        cuts: list = [[] for _ in texts]
        for doc, start, windows in zip(*(np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in marks.column(n).chunks)]).tolist() for n in _MARKS)):
            cuts[doc].append((start, start + windows + length - 1))
        out: dict = {n: [] for n in ("key", "n_bytes", "n_removed", "spans", "kept")}
        for text, k, cut in zip(texts, keys, cuts):
            spans: list = []
            for a, b in sorted(cut):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            for name, value in (("key", None if k == _NULL else k), ("n_bytes", len(text)), ("n_removed", sum(b - a for a, b in spans)), ("spans", [{"start": a, "stop": b} for a, b in spans]), ("kept", b"".join([*kept, text[at:]]))):
                out[name].append(value)
        kinds = {"key": kind, "n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), "kept": pa.binary()}
        return pa.table({n: pa.array(v, kinds[n]) for n, v in out.items()})

    return removed


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, batch_rows: int = 512, ranges: int | None = None, crowd: int = 100_000) -> DataFrame:
    """key, n_bytes, n_removed, spans (start, stop of the maximal removed runs) and kept (the bytes that stay) of every row.

    A byte goes if a string of `length` bytes over it also starts in a row with a smaller key; strings are judged on the input, and
    don't cross rows.  Keys are integers; a null key is larger than all others; rows that repeat a key take nothing from each other.
    The strings of a hash that `crowd` documents have are dealt out further, by their windows, so what one task holds of a
    hash is bounded.  A null text is empty; texts shorter than length lose nothing; an empty table gives none.  kept may end within a character."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = docs.sparkSession, docs.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError("documents are told apart by an integer key")
    if length < _GRAM:
        raise ValueError(f"length is {_GRAM} or more")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges, name = ranges or buckets, f"suffix_docs_{uuid.uuid4().hex}"
    number = F.monotonically_increasing_id()
    rows = docs.select(F.col(key).cast("bigint").alias("key"), text_or_empty(text).alias("text")).withColumn("place", number)
    rows = rows.withColumn("batch", F.floor(F.col("place") / batch_rows).cast("bigint"))
    try:
        rows.write.bucketBy(buckets, "batch").option("path", scratch_dir(spark, name)).option("compression", "zstd").saveAsTable(name)
        held = spark.table(name).groupBy("batch")
        seen = held.applyInArrow(_seen(length, ranges), _schema(_SEEN, "range", "batch"))
        shared = stored(seen.groupBy("range").applyInArrow(_shared, _schema(_SHARED, "batch")), "shared-hashes")
        strings = held.cogroup(shared.groupBy("batch")).applyInArrow(_strings(length, ranges, crowd), f"range bigint, batch bigint, text binary, {_schema(_STRINGS)}")
        marks = stored(strings.groupBy("range").applyInArrow(_marks(length), _schema(_MARKS, "batch")), "marks")
        out = held.cogroup(marks.groupBy("batch")).applyInArrow(_removed(length, to_arrow_type(kind)), f"key {kind.simpleString()}, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary")
        return stored(out.withColumnRenamed("key", key), "without-repeats")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
