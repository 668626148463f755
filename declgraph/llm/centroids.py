"""Centroid clustering with block-norm screening.

Components become integers. Every vector carries, for each of its segments, the sum and the sum of squares: in the plane of a
segment's mean and of its norm around that mean, the distance of two vectors is never larger than in full (Cauchy-Schwarz). So
the compressed vectors bound every distance from below, and only centroids whose bound does not exceed the distance of the
best-bounded one are met in full, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Components of one segment.
SEGMENT = 8
#: Integers below this number have distances and sums that 64 bits hold; vectors with others are met in Python's integers.
_SMALL = 1 << 27
#: Sums move as digits of so many bits, with the sign of the sum.
_DIGIT = 40


def _is_small(x: np.ndarray) -> np.ndarray:
    return (np.abs(x) < _SMALL).all(axis=-1)


def _wide(grid: np.ndarray, scale: int) -> np.ndarray:
    """Python's integers scale * grid, which are whole."""
    flat = [int(g) * scale if abs(g) >= 1 << 53 else int(g * scale) for g in grid.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(grid.shape)


_PREPARED = "vec_id long, grid array<double>, sums array<long>, squares array<long>"


def _prepare(dimension: int, scale: int):
    """Vectors on the grid of 1 / scale, floored, with the sums of their segments (null for large numbers)."""
    cuts = np.arange(0, dimension, SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            large = np.abs(x) >= 1 << 53  # whole, and scale times it may not be finite
            grid = np.where(large, x, np.floor(np.where(large, 0, x) * scale) / scale)
            small = ~large.any(axis=1) & _is_small(grid * np.where(large, 0, scale))
            whole = np.where(small[:, None], grid * scale, 0).astype(np.int64)
            sums, squares = np.add.reduceat(whole, cuts, axis=1), np.add.reduceat(whole * whole, cuts, axis=1)
            lists = [pa.array(list(grid), pa.list_(pa.float64()))]
            lists += [pa.array([row if ok else None for row, ok in zip(part, small, strict=True)], pa.list_(pa.int64())) for part in (sums, squares)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["vec_id", "grid", "sums", "squares"])

    return run


class Centroids:
    """Centroids of Python's integers, and what screening needs of those that are small."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.wide = np.empty((len(rows), len(rows[0])), object)
        self.wide[:] = rows
        self.small = all(abs(x) < _SMALL for r in rows for x in r)
        if self.small:
            self.whole = np.array(rows, np.int64)
            cuts = np.arange(0, self.whole.shape[1], SEGMENT)
            self.widths = np.diff(np.append(cuts, self.whole.shape[1]))
            self.flat = self.compressed(np.add.reduceat(self.whole, cuts, axis=1), np.add.reduceat(self.whole**2, cuts, axis=1))

    def compressed(self, sums: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """For each segment its sum over the root of its width, and the norm of what its mean leaves."""
        around = np.sqrt(np.maximum(squares - sums.astype(float) ** 2 / self.widths, 0))
        return np.concatenate([sums / np.sqrt(self.widths), around], axis=1)

    def bounds(self, sums: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """Lower bounds of all squared distances; the slack is far above what the arithmetic of doubles loses."""
        a, b = self.compressed(sums, squares), self.flat
        na, nb = squares.sum(axis=1).astype(float), (b * b).sum(axis=1)
        return na[:, None] + nb - 2 * (a @ b.T) - 1e-6 * (na[:, None] + nb + 1)

    def nearest(self, whole: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance, how many centroids were met in full) of small vectors."""
        n, k = len(whole), len(self.rows)
        bound = self.bounds(sums, squares)
        every = np.arange(n)
        first = bound.argmin(axis=1)
        least = ((whole - self.whole[first]) ** 2).sum(axis=1)
        met = bound <= least[:, None]
        met[every, first] = False
        row, other = np.nonzero(met)
        exact = ((whole[row] - self.whole[other]) ** 2).sum(axis=1)
        table = np.full((n, k), np.iinfo(np.int64).max)
        table[every, first], table[row, other] = least, exact
        best = table.argmin(axis=1)  # the first of equal ones
        return best, table[every, best], met.sum(axis=1) + 1

    def nearest_wide(self, row: np.ndarray) -> tuple[int, int]:
        distances = ((self.wide - row) ** 2).sum(axis=1).tolist()
        best = min(range(len(distances)), key=lambda i: (distances[i], i))
        return best, distances[best]


def _assigned(batch: pa.RecordBatch, centroids: Centroids, scale: int):
    """(cluster, distance as Python or numpy integers, met, grid, which rows are small)."""
    dimension = len(centroids.rows[0])
    grid = batch.column("grid").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    small = np.asarray(batch.column("sums").is_valid()) & centroids.small
    cluster, met = np.zeros(len(grid), np.int64), np.full(len(grid), len(centroids.rows), np.int64)
    distance: list = [0] * len(grid)
    at = np.flatnonzero(small)
    if len(at):
        mask = pa.array(small)
        sums, squares = (batch.column(c).filter(mask).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1) for c in ("sums", "squares"))
        cluster[at], near, met[at] = centroids.nearest((grid[at] * scale).astype(np.int64), sums, squares)
        for i, d in zip(at.tolist(), near.tolist(), strict=True):
            distance[i] = d
    for i in np.flatnonzero(~small).tolist():
        cluster[i], distance[i] = centroids.nearest_wide(_wide(grid[i], scale))
    return cluster, distance, met, grid, small


def _digits(total: int) -> Iterator[tuple[int, int]]:
    sign, rest, place = (-1 if total < 0 else 1), abs(total), 0
    while rest or not place:
        yield place, sign * (rest & ((1 << _DIGIT) - 1))
        rest, place = rest >> _DIGIT, place + 1


_SUMS = pa.schema([("cluster", pa.int32()), ("part", pa.int32()), ("place", pa.int32()), ("value", pa.int64())])


def _collect(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    rows = [(c, p, place, v) for (c, p), total in totals.items() for place, v in _digits(total)]
    return common.emit(_SUMS, list(zip(*rows, strict=True)) if rows else [[], [], [], []])


def _added(frame: DataFrame) -> dict[tuple[int, int], int]:
    """Totals by (cluster, part): as many rows as centroids have components, whatever the table's size."""
    found: dict[tuple[int, int], int] = {}
    for r in frame.groupBy("cluster", "part", "place").agg(F.sum("value").alias("value")).collect():
        found[r.cluster, r.part] = found.get((r.cluster, r.part), 0) + (r.value << _DIGIT * r.place)
    return found


def _round(centroids, scale: int):
    """Componentwise sums of each cluster's vectors in this task, and at -1 how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        k, dimension = len(c.rows), len(c.rows[0])
        sums, counts = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            cluster, _, _, grid, small = _assigned(batch, c, scale)
            counts += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster[small]).tolist():
                sums[j] += (grid[small & (cluster == j)] * scale).astype(np.int64).sum(axis=0)
            if np.abs(sums).max(initial=0) >= 1 << 60:
                _fold(totals, sums)
            for i in np.flatnonzero(~small).tolist():
                for p, v in enumerate(_wide(grid[i], scale).tolist()):
                    totals[int(cluster[i]), p] = totals.get((int(cluster[i]), p), 0) + v
        _fold(totals, sums)
        for j in np.flatnonzero(counts).tolist():
            totals[j, -1] = int(counts[j])
        yield _collect({key: v for key, v in totals.items() if counts[key[0]]})

    return run


def _fold(totals: dict[tuple[int, int], int], sums: np.ndarray) -> None:
    for j, p in zip(*np.nonzero(sums), strict=True):
        totals[int(j), int(p)] = totals.get((int(j), int(p)), 0) + int(sums[j, p])
    sums[:] = 0


_ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.string()), ("met", pa.int32())])


def _last(centroids, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, met, _, _ = _assigned(batch, centroids.value, scale)
            yield common.emit(_ASSIGNED, [batch.column("vec_id").to_pylist(), cluster, [str(d) for d in distance], met])

    return run


def _inertia(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[tuple[int, int], int] = {}
    for batch in batches:
        for cluster, distance in common.rows_of(batch, "cluster", "distance"):
            totals[cluster, 0] = totals.get((cluster, 0), 0) + int(distance)
    yield _collect(totals)


def _long(value: int) -> int | None:
    return value if value < 1 << 63 else None


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, met_exactly of every vector that takes part.

    Vectors with exactly `dimension` components, none null or not finite, take part, with floor(scale * x) for components; a
    null id does, too, and equal rows do so each for itself. Centroids start as the k vectors with the smallest sha256 of
    `seed:id` (of one id's rows the smaller vector; those without id last), fewer if there are fewer; two may be equal: the
    smaller number gets the vectors. Every round assigns each vector to the nearest centroid and moves each centroid that has
    vectors to floor(sum / count); then vectors are assigned once more. All arithmetic is exact for any finite component; a
    distance or sum of distances beyond 64 bits is null. met_exactly says for how many centroids the last assignment needed
    the full distance. No vectors, no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    common.arrow_batches(spark, rows=8192)
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.size("v") == dimension).where(good)
    with common.written() as done:
        table = common.materialize(rows.mapInArrow(common.tidy(_prepare(dimension, scale)), _PREPARED), "grid")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = table.select("grid", name.alias("name")).orderBy(F.asc_nulls_last("name"), "grid").limit(k).collect()
    current = [_wide(np.array(r.grid), scale).tolist() for r in starts]
    if current:
        for _ in range(rounds):
            shared = spark.sparkContext.broadcast(Centroids(current))
            found = _added(table.mapInArrow(common.tidy(_round(shared, scale)), "cluster int, part int, place int, value long"))
            shared.unpersist()
            current = [[found.get((j, p), 0) // found[j, -1] for p in range(dimension)] if (j, -1) in found else row for j, row in enumerate(current)]
    shared = spark.sparkContext.broadcast(Centroids(current or [[0] * dimension]))
    last = common.materialize(table.mapInArrow(common.tidy(_last(shared, scale)), "vec_id long, cluster int, distance string, met int"), "assigned")
    common.remove(spark, done)
    sums = {c: total for (c, _), total in _added(last.mapInArrow(common.tidy(_inertia), "cluster int, part int, place int, value long")).items()}
    digest = lambda row: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()
    told = [(j, _long(sums.get(j, 0)), _long(sum(sums.values())), digest(row)) for j, row in enumerate(current)]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return last.join(F.broadcast(about), "cluster").select("vec_id", "cluster", F.expr("try_cast(distance AS long)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256", F.col("met").alias("met_exactly"))
