"""Nearest neighbours by a block matrix join with int8 tiles and exact rescoring.

Vectors are packed into blocks that also hold an int8 form with scales and error norms, of the vector times a power of two
that brings its largest component to 0.5 to 1: so bounds are finite whatever a vector's magnitude. Every query block meets
every data block; a tile's int8 product and its error bounds leave few pairs that can be among the nearest, and those are
computed again from the original vectors in double precision. Products so large or small that doubles may overflow or lose
digits are all computed again. Heaps merge the tiles' results. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of one block's original vectors, and the rows of a tile that are held in memory at once.
BLOCK_BYTES, TILE_ROWS = 1 << 20, 256
#: Query vectors up to this many bytes are broadcast. More are dealt to parts of about that size, and so are all vectors:
#: every pair of parts is one task's.
PART_BYTES = 64 << 20
#: Products of powers of two beyond these are computed again, as their sums might overflow or underflow.
SAFE = (-900, 900)

_BLOCK = "dim int, ids binary, vectors binary, codes binary, scales binary, lost binary, norms binary, powers binary, floor binary"
_BLOCK_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]


def _pack(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"), batch.column(1)
            sizes = np.diff(np.asarray(lists.offsets))
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype), np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                step = max(64, BLOCK_BYTES // (dim * flat.itemsize))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    yield _block(dim, ids[part], flat[starts[part][:, None] + np.arange(dim)])

    return run


def _block(dim: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    exact = vectors.astype("f8")
    power = np.frexp(np.abs(exact).max(1))[1]
    half = power // 2  # a power of two alone may be too large for a double
    exact = np.ldexp(np.ldexp(exact, -half[:, None]), (half - power)[:, None])
    scales = np.abs(exact).max(1) / 127
    codes = np.clip(np.rint(exact / scales[:, None]), -127, 127).astype("i1")
    lost = np.linalg.norm(exact - codes * scales[:, None], axis=1)
    floor = np.full(len(ids), -np.inf)
    values = [dim, *(x.tobytes() for x in (ids, vectors, codes, scales, lost, np.linalg.norm(exact, axis=1), power.astype("f8"), floor))]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if k == 0 else pa.binary()) for k, v in enumerate(values)], names=_BLOCK_NAMES)


class _Block:
    def __init__(self, values: tuple, dtype: str):
        self.dim = values[0]
        self.ids = np.frombuffer(values[1], "<i8")
        self.vectors = np.frombuffer(values[2], dtype).reshape(len(self.ids), self.dim)
        self.codes = np.frombuffer(values[3], "i1").reshape(len(self.ids), self.dim)
        self.scales, self.lost, self.norms, self.powers, self.floor = (np.frombuffer(v, "f8") for v in values[4:9])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added in the order of the components, in double precision."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(a.shape[1]):
            total += a[:, d].astype("f8") * b[:, d].astype("f8")
    return total


def _order(ids: np.ndarray, scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """By row, then the largest score first (no number counts as larger than all, as Spark orders it), then the smaller id."""
    no_number = np.isnan(scores)
    return np.lexsort((ids, np.where(no_number, 0, -scores), ~no_number, rows))


def _tile(q: _Block, d: _Block, k: int, floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query's rows, ids, scores), rows ascending: all that can be among a query's k nearest, given that no score below its
    floor can; k of a query at most, nearest first."""
    codes = d.codes.astype("f4")
    top = d.powers.max()
    unit = np.ldexp(1.0, np.maximum(d.powers - top, -1070).astype(int))  # values are compared in units of 2 ** (query's power + top)
    for at in range(0, len(q.ids), TILE_ROWS):
        rows = slice(at, at + TILE_ROWS)
        about = np.zeros((len(q.ids[rows]), len(d.ids)))
        for c in range(0, d.dim, 1024):  # sums of so many int8 products are exact in single precision
            about += q.codes[rows, c : c + 1024].astype("f4") @ codes[:, c : c + 1024].T
        about *= q.scales[rows, None]
        about *= d.scales * unit
        bound = (q.norms[rows] + q.lost[rows])[:, None] * (d.lost * unit) + q.lost[rows, None] * (d.norms * unit)
        bound += 1e-9 * q.norms[rows, None] * (d.norms * unit) + 1e-300  # rounding of what is above
        own = q.ids[rows, None] == d.ids[None, :]
        power = q.powers[rows, None] + d.powers
        unsafe = (power < SAFE[0]) | (power > SAFE[1])
        least = np.where(own | unsafe, -np.inf, about - bound)
        with np.errstate(over="ignore"):
            half = (q.powers[rows] + top).astype(int) // 2
            floor = np.ldexp(np.ldexp(floors[rows], -half), half - (q.powers[rows] + top).astype(int))
        if least.shape[1] >= k:
            floor = np.maximum(floor, np.partition(least, -k, axis=1)[:, -k])
        i, j = np.nonzero(((about + bound >= floor[:, None]) | unsafe) & ~own)
        scores = _dot(q.vectors[rows][i], d.vectors[j])
        yield _nearest(i + at, d.ids[j], scores, k)


def _nearest(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row, rows ascending."""
    order = _order(ids, scores, rows)
    rows, ids, scores = rows[order], ids[order], scores[order]
    begin = np.flatnonzero(np.append(True, np.diff(rows) != 0)[: len(rows)])
    kept = np.arange(len(rows)) - np.repeat(begin, np.diff(begin, append=len(rows))) < k
    return rows[kept], ids[kept], scores[kept]


class _Best:
    """What one task has found for the queries of a block so far, and the floors that follow from it."""

    def __init__(self, q: _Block):
        self.ids, self.floors = q.ids, q.floor.copy()
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def meet(self, q: _Block, d: _Block, k: int) -> None:
        new = [self.found, *_tile(q, d, k, self.floors)]
        self.found = _nearest(*(np.concatenate(x) for x in zip(*new, strict=True)), k)
        rows, _, scores = self.found
        full = np.flatnonzero(np.bincount(rows, minlength=len(self.ids)) == k)
        worst = scores[np.searchsorted(rows, full, "right") - 1]
        self.floors[full] = np.fmax(self.floors[full], worst)  # a worst score that is no number says nothing

    def lists(self) -> pa.RecordBatch:
        rows, ids, scores = self.found
        begin = np.flatnonzero(np.append(True, np.diff(rows) != 0)[: len(rows)])
        cuts = pa.array(np.append(begin, len(rows)).astype(np.int32))
        columns = [pa.array(self.ids[rows[begin]]), pa.ListArray.from_arrays(cuts, pa.array(ids)), pa.ListArray.from_arrays(cuts, pa.array(scores))]
        return pa.RecordBatch.from_arrays(columns, schema=_FOUND_SCHEMA)


def _raise_floor(seeds: list[tuple], dtype: str, k: int):
    """Query blocks with the k-th best score among the seed vectors: no result can be below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in common.rows_of(batch, *_BLOCK_NAMES):
                q = _Block(values, dtype)
                best = _Best(q)
                for seed in seeds:
                    if seed[0] == q.dim:
                        best.meet(q, _Block(seed, dtype), k)
                yield pa.RecordBatch.from_arrays([pa.array([v], batch.schema.field(n).type) for n, v in zip(_BLOCK_NAMES, (*values[:8], best.floors.tobytes()), strict=True)], names=_BLOCK_NAMES)

    return run


_FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def _tiles(dtype: str, k: int):
    """Rows are pairs of a query block and a data block; each query that this task has met gives one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, _Best] = {}
        for batch in batches:
            for values in common.rows_of(batch, *(f"q_{n}" for n in _BLOCK_NAMES), *_BLOCK_NAMES):
                n = len(_BLOCK_NAMES)
                q, d = _Block(values[:n], dtype), _Block(values[n:], dtype)
                name = values[1] + q.dim.to_bytes(4, "little")  # a query's id is in one block of its size only
                if name not in met:
                    met[name] = _Best(q)
                met[name].meet(q, d, k)
        for best in met.values():
            yield best.lists()

    return run


_NEAR_SCHEMA = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _merge(k: int):
    """Rows come sorted by query: one heap at a time, of k entries at most, the worst on top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heap = None, []
        out: list[list] = [[], [], [], []]

        def close() -> None:
            for rank, (_, less, score) in enumerate(sorted(heap, reverse=True), 1):
                for column, value in zip(out, (current, rank, -less, score), strict=True):
                    column.append(value)
            heap.clear()

        for batch in batches:
            for query, ids, scores in common.rows_of(batch, "query_id", "ids", "scores"):
                if query != current:
                    close()
                    current = query
                for i, s in zip(ids, scores, strict=True):
                    entry = ((s != s, 0.0 if s != s else s), -i, s)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry[:2] > heap[0][:2]:
                        heapq.heapreplace(heap, entry)
            if len(out[0]) > 10_000:
                yield common.emit(_NEAR_SCHEMA, out)
                out[:] = [[], [], [], []]
        close()
        yield common.emit(_NEAR_SCHEMA, out)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the largest inner product for every query.

    Queries are the rows of vectors that is_query picks; candidates all rows with another id and the same number of
    components. Ties go to the smaller id. Rows whose id or vector is null, empty, zero, or holds a null or non-finite
    component take no part. Equal rows are candidates each for itself; a repeated query is one query. No rows, no result.
    Scores are sums of doubles in the order of the components: they may overflow to an infinity, or to no number where
    infinities of both signs meet, which counts as the largest.
    """
    spark = vectors.sparkSession
    common.arrow_batches(spark)
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v"), is_query.alias("q")).where("i is not null and v is not null").where(good)
    data = common.materialize(rows.select("i", "v").mapInArrow(_pack(kind), _BLOCK), "vectors")
    asked = rows.where("q").dropDuplicates(["i"]).select("i", "v").mapInArrow(_pack(kind), _BLOCK)
    seeds = [tuple(r) for r in data.limit(4).collect()]
    seeds = [(s[0], *(bytes(x) for x in s[1:])) for s in seeds]
    queries = common.materialize(asked.mapInArrow(_raise_floor(seeds, kind, k), _BLOCK), "queries")
    parts = [max(1, -(-(t.agg(F.sum(F.length("vectors")) * 2).first()[0] or 0) // PART_BYTES)) for t in (queries, data)]
    queries = queries.toDF(*(f"q_{n}" for n in _BLOCK_NAMES))
    if parts[0] == 1:
        tiles = data.join(F.broadcast(queries), data.dim == queries.q_dim)
    else:
        queries = queries.withColumn("x", F.pmod(F.xxhash64("q_ids"), F.lit(parts[0]))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(parts[1] - 1)).cast("array<long>")))
        placed = data.withColumn("y", F.pmod(F.xxhash64("ids"), F.lit(parts[1]))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(parts[0] - 1)).cast("array<long>")))
        tiles = placed.join(queries, (placed.x == queries.x) & (placed.y == queries.y) & (placed.dim == queries.q_dim)).drop("x", "y")
    found = tiles.mapInArrow(_tiles(kind, k), "query_id long, ids array<long>, scores array<double>")
    merged = found.repartition("query_id").sortWithinPartitions("query_id")
    return merged.mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
