"""Exact top-k by inner product with pivot tables.

Every vector's distances to many pivots are computed once.  Together they give the greatest lower bound of a distance that they can:
the distances fix a vector's place in the space that the pivots span (the apex of a simplex over them) and its altitude above it,
and two vectors are no nearer than two apexes with their altitudes on one side.  So |q - x|^2 has a lower and the inner product
(|q|^2 + |x|^2 - |q - x|^2) / 2 an upper bound, c_q . c_x + h_q h_x.

Vectors are kept in cells (by nearest pivot), cut into blocks of bounded size.  A query first searches one block of its own cell; the
k-th score found there rules out cells whose bound is lower; in the blocks that are left every query evaluates its candidates in
the order of their bounds until the next bound is below its k-th score.  Bounds carry a slack for rounding, scores are whole
numbers (floats while these hold them, else Python's), so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.llm.common import stored

#: Of the longest vector: what rounding may do to a place or an altitude.
_SHARE = 2e-6
_FOUND = "query_id bigint, vec_id bigint, score bigint, beyond string"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _beyond(score: int) -> str:
    """What orders scores that no long holds behind the nearest long: greater strings for greater scores, "" for the others (":" for
    the least long, which is above all scores below it)."""
    if score > _MOST:
        return f"{len(str(score)):06d}{score}"
    if score < _LEAST:
        digits = str(-score)
        return f"{999_999 - len(digits):06d}{''.join(str(9 - int(d)) for d in digits)}"
    return ":" if score == _LEAST else ""


def scaled(embedding: str = "embedding", scale: int = 64) -> Column:
    """scale * x of each component as double; null for a null vector and for null, NaN or infinite components (also if only
    scale * x is infinite, above 2^1017)."""
    x = F.transform(F.col(embedding), lambda v: F.lit(float(scale)) * v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce(good, F.lit(False)), x)


def _packed(values: str) -> Column:
    """The floors of the components as little-endian 32-bit integers after a byte 0, or doubles after a byte 1 where they are
    larger; zeros at the end, which change no product, go, so equal vectors are equal bytes."""

    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors:
            a = np.trim_zeros(np.floor(np.asarray(v.values if len(v) else [], dtype=np.float64)), "b") + 0.0  # no negative zeros
            out.append(b"\0" + a.astype("<i4").tobytes() if not len(a) or np.abs(a).max() < 1 << 31 else b"\1" + a.astype("<f8").tobytes())
        return pa.array(out, pa.binary())

    return pack(F.col(values))


def _matrix(blobs: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(blobs), dims))
    for k, b in enumerate(blobs):
        v = np.frombuffer(b, dtype="<f8" if b[0] else "<i4", offset=1)
        out[k, : len(v)] = v
    return out


def _dims(blob: bytes) -> int:
    return (len(blob) - 1) // (8 if blob[0] else 4)


class PivotTable:
    """Pivots (rows of a sample, each the farthest from the space of those before it) and the places that distances to them give."""

    def __init__(self, sample: np.ndarray, n_pivots: int, least: float = 0.02):
        longest = max(np.sqrt((sample * sample).sum(axis=1)).max(initial=0), 1e-300)
        self.unit = float(longest) if np.isfinite(longest) else float(np.abs(sample).max())  # keeps squares in range
        rest, chosen = sample / self.unit, []
        base = np.zeros((0, sample.shape[1]))
        for _ in range(min(n_pivots, *sample.shape)):
            far = (rest * rest).sum(axis=1)
            k = int(far.argmax())
            if chosen and far[k] < least**2:
                break
            if not far[k]:
                break
            chosen.append(k)
            axis = rest[k] / np.sqrt(far[k])
            base = np.vstack((base, axis))
            rest = rest - np.outer(rest @ axis, axis)
        self.pivots = sample[chosen] / self.unit
        self.to_place = np.linalg.inv(self.pivots @ base.T) if chosen else np.zeros((0, 0))  # products with the pivots to coordinates
        self.square = (self.pivots * self.pivots).sum(axis=1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        x = x / self.unit
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + self.square - 2 * x @ self.pivots.T, 0))

    def places(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Coordinates and, last, the altitude, in units of `unit`; rounding may only raise the altitude."""
        norm = ((x / self.unit) ** 2).sum(axis=1)
        c = (norm[:, None] + self.square - d * d) / 2 @ self.to_place.T
        high = np.sqrt(np.maximum(norm - (c * c).sum(axis=1), 0)) + _SHARE * np.sqrt(norm)
        return np.concatenate((c, high[:, None]), axis=1).astype(np.float32)


def search_block(q: np.ndarray, q_ids: np.ndarray, cq: np.ndarray, x: np.ndarray, x_ids: np.ndarray, cx: np.ndarray, k: int, floor: np.ndarray, unit: float = 1.0, first: int = 64) -> tuple[np.ndarray, np.ndarray, list[int], int]:
    """Places of queries, ids and scores of the best k of a block for each query that score floor or more, and how many
    candidates were evaluated.  cq, cx: places in units of `unit`.

    A query's candidates come in the order of their bounds, `first` of them, then twice as many, and so on; its search ends as soon
    as the next bound is below its k-th score or the floor.
    """
    norm_q, norm_x = (q * q).sum(axis=1), (x * x).sum(axis=1)
    longest = float(max(norm_q.max(initial=0), norm_x.max(initial=0)))
    kind = np.float32 if longest < 1 << 24 else np.float64 if longest < 1 << 53 else object  # products are whole numbers up to longest
    if kind is object:
        q, x = (np.array([[int(v) for v in row] for row in a.tolist()], dtype=object).reshape(a.shape) for a in (q, x))
    else:
        q, x = q.astype(kind), x.astype(kind)
    n, evaluated, out = len(x), 0, []
    for start in range(0, len(q), 64):
        some = slice(start, start + 64)
        with np.errstate(over="ignore", invalid="ignore"):
            bound = (cq[some].astype(np.float64) @ cx.T.astype(np.float64)) * unit * unit
            bound += 4 * _SHARE * np.sqrt(norm_q[some])[:, None] * np.sqrt(norm_x)
        bound[np.isnan(bound)] = np.inf
        bound[q_ids[some, None] == x_ids] = -np.inf
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        m = len(bound)
        best, best_ids, known = np.full((m, k), -np.inf, dtype=object if kind is object else np.float64), np.full((m, k), np.iinfo(np.int64).max), floor[some].astype(np.float64)
        active, at, width = np.arange(m), 0, first
        while len(active) and at < n:
            take = order[active, at : at + width]
            if kind is object:
                scores = (x[take] * q[some][active][:, None, :]).sum(axis=2)
            else:
                scores = np.einsum("mfd,md->mf", x[take], q[some][active]).astype(np.float64)
            scores = np.where(bound[active, at : at + width] == -np.inf, -np.inf, scores)
            evaluated += take.size
            both, ids = np.concatenate((best[active], scores), axis=1), np.concatenate((best_ids[active], x_ids[take]), axis=1)
            by_id = np.argsort(ids, axis=1, kind="stable")
            both, ids = np.take_along_axis(both, by_id, axis=1), np.take_along_axis(ids, by_id, axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :k]
            best[active], best_ids[active] = np.take_along_axis(both, top, axis=1), np.take_along_axis(ids, top, axis=1)
            at, width = at + width, 2 * width
            if at < n:  # the next bound, with what conversion to float may have taken from the k-th score
                kth = np.maximum(known[active], best[active, k - 1].astype(np.float64))
                active = active[bound[active, at] >= kth - 1e-12 * np.abs(np.where(np.isfinite(kth), kth, 0))]
        i, j = np.nonzero((best > -np.inf) & (best >= known[:, None] - 1e-12 * np.abs(np.where(np.isfinite(known), known, 0))[:, None]))
        out.append((i + start, best_ids[i, j], best[i, j].tolist()))
    i, ids = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in (0, 1))
    return i, ids, [int(v) for o in out for v in o[2]], evaluated


def _searched(pairs: DataFrame, k: int, unit: float) -> DataFrame:
    """pairs: a block (x_ids, xs, dxs) and a group of queries (q_ids, qs, dqs, floors) a row."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()  # noqa: E731, B023
                qs, xs = get("qs"), get("xs")
                dims = max(1, *map(_dims, qs), *map(_dims, xs))
                dx, dq = (np.frombuffer(b"".join(get(c)), dtype=np.float32).reshape(n, -1) for c, n in (("dxs", len(xs)), ("dqs", len(qs))))
                q_ids, floors = np.array(get("q_ids"), dtype=np.int64), np.array(get("floors"), dtype=np.float64)
                i, ids, scores, _ = search_block(_matrix(qs, dims), q_ids, dq, _matrix(xs, dims), np.array(get("x_ids"), dtype=np.int64), dx, k, floors, unit)
                near = [min(max(v, _LEAST), _MOST) for v in scores]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (q_ids[i], ids, near)), pa.array(map(_beyond, scores), pa.string())], names=["query_id", "vec_id", "score", "beyond"])

    return pairs.mapInArrow(search, _FOUND)


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", embedding: str = "embedding", scale: int = 64, n_pivots: int = 56, sample_rows: int = 2048, block_rows: int = 2048, group_queries: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `queries` holds its k highest products with other rows, ties to the
    smaller id.

    Rows with a null id, and vectors null or with a null or non-finite component, take no part; a repeated id counts once
    (its smallest vector); shorter vectors are filled with zeros.  The pivots come from at most sample_rows rows (of the
    smallest hash); all rows are indexed.  Any finite component is welcome; a score that no long holds is shown as the nearest
    long, but ranked by its true value.
    """
    base = vectors.select(F.col(key).cast("bigint").alias("id"), queries.alias("is_query"), scaled(embedding, scale).alias("values")).where("id IS NOT NULL AND values IS NOT NULL")
    packed = stored(base.select("id", F.coalesce("is_query", F.lit(False)).alias("is_query"), _packed("values").alias("v")).groupBy("id").agg(F.max("is_query").alias("is_query"), F.min("v").alias("v")), "vectors")
    spark = vectors.sparkSession
    sample = [bytes(r["v"]) for r in packed.orderBy(F.xxhash64("id")).limit(sample_rows).select("v").collect()]
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not sample:
        return empty
    dims = max(1, packed.agg(F.max(F.floor((F.length("v") - 1) / F.when(F.substring("v", 1, 1) == F.lit(b"\1"), 8).otherwise(4)))).first()[0])
    pivots = PivotTable(_matrix(sample, dims), n_pivots)
    n_p = len(pivots.pivots) + 1

    @F.arrow_udf("struct<d: binary, cell: int>")
    def pivot_row(v: pa.Array) -> pa.Array:
        x = _matrix(v.to_pylist(), dims)
        d = pivots.distances(x)
        places = pivots.places(x, d)
        return pa.StructArray.from_arrays([pa.array([r.tobytes() for r in places], pa.binary()), pa.array((d.argmin(axis=1) if n_p > 1 else np.zeros(len(x))).astype(np.int32))], names=["d", "cell"])

    table = stored(packed.withColumn("p", pivot_row("v")).select("id", "is_query", "v", "p.*"), "pivots")
    # of equal vectors only the k + 1 smallest ids can be among a query's k (its own is left out)
    few = table.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("copy") <= k + 1)
    few = stored(few.select("id", "v", "d", "cell"), "candidates")
    cells = [(r["cell"], -(-r["n"] // block_rows)) for r in few.groupBy("cell").agg(F.count("*").alias("n")).collect()]  # n_pivots rows
    blocks_of = F.create_map(*[F.lit(x) for c, n in cells for x in (c, n)])
    sub = F.pmod(F.xxhash64("id"), F.element_at(blocks_of, F.col("cell"))).cast("int")
    blocks = few.withColumn("sub", sub).groupBy("cell", "sub").agg(F.collect_list(F.struct("id", "v", "d")).alias("r"))  # about block_rows each
    blocks = stored(blocks.select("cell", "sub", F.col("r.id").alias("x_ids"), F.col("r.v").alias("xs"), F.col("r.d").alias("dxs")), "blocks")

    @F.arrow_udf("struct<low: binary, high: binary>")
    def ranges(rows: pa.Array) -> pa.Array:
        got = [np.frombuffer(b"".join(r), dtype=np.float32).reshape(-1, n_p) for r in rows.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g.min(axis=0).tobytes() for g in got], pa.binary()), pa.array([g.max(axis=0).tobytes() for g in got], pa.binary())], names=["low", "high"])

    per_block = blocks.select("cell", ranges("dxs").alias("g")).select("cell", "g.*")
    low, high = {}, {}
    folded = per_block.mapInArrow(_fold_ranges(n_p), "cell int, low binary, high binary")  # at most n_pivots rows a task
    for r in folded.groupBy("cell").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high")).collect():
        low[r["cell"]] = np.min([np.frombuffer(b, dtype=np.float32) for b in r["low"]], axis=0)
        high[r["cell"]] = np.max([np.frombuffer(b, dtype=np.float32) for b in r["high"]], axis=0)
    names = sorted(low)
    lows, highs, subs = np.array([low[c] for c in names]).astype(np.float64), np.array([high[c] for c in names]).astype(np.float64), dict(cells)
    unit = pivots.unit
    asked = table.where("is_query").withColumn("home", F.pmod(F.xxhash64("id"), F.element_at(blocks_of, F.col("cell"))).cast("int"))
    group = lambda q, floors: q.groupBy("cell", "sub", "g").agg(F.collect_list(F.struct("id", "v", "d", floors.alias("f"))).alias("r")).select("cell", "sub", F.col("r.id").alias("q_ids"), F.col("r.v").alias("qs"), F.col("r.d").alias("dqs"), F.col("r.f").alias("floors"))
    total = max(1, table.where("is_query").count())
    salt = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(-(-total // group_queries)))  # a group has about group_queries at most
    home = group(asked.select("id", "v", "d", "cell", F.col("home").alias("sub"), salt.alias("g")), F.lit(float("-inf")))
    near = _searched(blocks.join(home, ["cell", "sub"]), k, unit)
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))).where(F.col("n") == k)
    known = F.when(F.col("score") > _LEAST, F.col("score").cast("double")).otherwise(F.lit(float("-inf")))
    floor = stored(ranked.select(F.col("query_id").alias("id"), known.alias("f")), "floors")

    @F.arrow_udf("array<int>")
    def cells_left(d: pa.Array, f: pa.Array) -> pa.Array:
        """Cells whose box of places may hold a score of f or more."""
        out = []
        for one, least in zip(d.to_pylist(), f.to_pylist()):
            q = np.frombuffer(one, dtype=np.float32).astype(np.float64)
            upper = np.maximum(lows * q, highs * q).sum(axis=1) + 4 * _SHARE * np.sqrt((q * q).sum() * (np.maximum(abs(lows), abs(highs)) ** 2).sum(axis=1))
            with np.errstate(over="ignore", invalid="ignore"):
                out.append([names[j] for j in np.flatnonzero(~(upper * unit * unit < least - 1e-12 * abs(least)))])
        return pa.array(out, pa.list_(pa.int32()))

    visits = asked.join(floor, "id", "left").withColumn("f", F.coalesce("f", F.lit(float("-inf")))).select("id", "v", "d", "f", F.explode(cells_left("d", F.col("f"))).alias("cell"))
    all_subs = F.create_map(*[F.lit(x) for c in names for x in (c, subs[c])])
    visits = visits.withColumn("sub", F.explode(F.sequence(F.lit(0), F.element_at(all_subs, F.col("cell")) - 1)))
    found = _searched(blocks.join(group(visits.withColumn("g", salt), F.col("f")), ["cell", "sub"]), k, unit)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _fold_ranges(n_p: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, a, b in zip(*(batch.column(k).to_pylist() for k in range(3))):
                x, y = np.frombuffer(a, dtype=np.float32), np.frombuffer(b, dtype=np.float32)
                low[c], high[c] = np.minimum(low.get(c, x), x), np.maximum(high.get(c, y), y)
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array([v.tobytes() for v in low.values()], pa.binary()), pa.array([v.tobytes() for v in high.values()], pa.binary())], names=["cell", "low", "high"])

    return fold
