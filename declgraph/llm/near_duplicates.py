"""MinHash near-duplicates with a multi-index Hamming join.

A signature is 64 symbols of 16 bits (b-bit minhashes). It is split into 16 chunks of four symbols; two signatures that
differ in at most 31 symbols have, by the pigeonhole principle, a chunk that differs in at most one. Leaving out each
symbol of each chunk enumerates that one error, so such pairs share one of 64 keys for certain. Pairs within the distance
are then confirmed on their full shingle sets. Copies with equal sets are put together before, and near copies by a star
around the centre of their group; only what no star has linked is compared in tiles.

At a similarity of 0.75 a symbol differs with probability 1/4, and more than 31 of 64 with about one in 100,000.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 5
SYMBOLS, CHUNK = 64, 4
#: Symbols that may differ: one less than two for each chunk, so that a chunk with at most one is certain.
DISTANCE = 2 * (SYMBOLS // CHUNK) - 1
#: Documents that are compared in one go, by signatures and in full; larger groups are split into pairs of parts. And
#: documents that one task meets with a centre.
TILE, FULL_TILE, STAR = 2048, 256, 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.RandomState(20240229)
_MULTIPLY = _RNG.randint(0, 2**63 - 1, SYMBOLS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.randint(0, 2**63 - 1, SYMBOLS, np.int64).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct word shingles; of a shorter text the whole sequence; none without words."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    value = np.full(len(parts) - n + 1, n, np.uint64)
    for k in range(n):
        value = _mixed(value * _BASE + each[k : len(parts) - n + 1 + k])
    return np.unique(value)


def signature(hashes: np.ndarray) -> bytes:
    least = np.full(SYMBOLS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096] * _MULTIPLY[:, None] + _ADD[:, None]).min(1))
    return (_mixed(least) >> np.uint64(48)).astype("<u2").tobytes()


_SIGNED_SCHEMA = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("signature", pa.binary())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            hashes = shingles(text.as_py())
            for column, value in zip(out, (i, len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), signature(hashes)), strict=True):
                column.append(value)
        yield common.emit(_SIGNED_SCHEMA, out)


def _key_matrix(symbols: np.ndarray) -> np.ndarray:
    """All keys of each signature: one for each chunk and symbol left out, in the order of left-out place, then chunk."""
    parts = symbols.reshape(len(symbols), SYMBOLS // CHUNK, CHUNK).astype(np.uint64)
    columns = []
    for left_out in range(CHUNK):
        value = (np.arange(parts.shape[1], dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(left_out))[None, :].repeat(len(parts), 0)
        for k in range(CHUNK):
            if k != left_out:
                value = _mixed(value * _BASE + parts[:, :, k])
        columns.append(value)
    return np.concatenate(columns, axis=1).view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if len(ids):
            keys = _key_matrix(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(ids), -1))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, keys.shape[1]))], names=["key", "id"])


class _Tile:
    """Signatures of one tile; near(i) gives the members of other components within the distance of i for which this key is
    the first that the two share, so that of all tiles only one takes a pair."""

    def __init__(self, held: list[tuple], key: tuple):
        self.ids = np.array([h[0] for h in held])
        self.symbols = np.frombuffer(b"".join(h[1] for h in held), "<u2").reshape(len(held), -1)
        self.part = np.array([h[2] for h in held])
        self.component = np.array([h[3] for h in held])
        self.key, self.mixed = key[0], key[1] != key[2]
        self.keys = _key_matrix(self.symbols)

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        differ = self.symbols != self.symbols[i]
        far = differ.sum(1)
        ok = (far <= DISTANCE) & (self.component != self.component[i])
        if self.mixed:
            ok &= self.part != self.part[i]
        found = np.flatnonzero(ok)
        chunks = differ[found].reshape(len(found), SYMBOLS // CHUNK, CHUNK)
        errors = chunks.sum(2)
        chunk = (errors <= 1).argmax(1)
        place = np.arange(len(found))
        left_out = np.where(errors[place, chunk] == 1, chunks[place, chunk].argmax(1), 0)
        first = self.keys[i, left_out * errors.shape[1] + chunk] == self.key
        return found[first], far[found[first]]


_PAIR_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("close", pa.int32())])


class _Groups:
    """Union-find over the members of one tile; members of one component start together."""

    def __init__(self, component: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(c, i) for i, c in enumerate(component)]

    def of(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.of(i), self.of(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _open(rows: DataFrame, group: str) -> DataFrame:
    """The rows (group, id, component) of groups with several components, with big (whether the row is in the group's largest
    component) and the group's numbers of rows in it (n_big) and in all others (n_rest)."""
    of_component = rows.groupBy(group, "component").agg(F.count("*").alias("m"))
    of_group = of_component.groupBy(group).agg(F.max(F.struct("m", "component")).alias("most"), F.sum("m").alias("n"), F.count("*").alias("components")).where("components > 1")
    of_group = common.side(common.materialize(of_group.select(group, F.col("most.component").alias("largest"), F.col("most.m").alias("n_big"), (F.col("n") - F.col("most.m")).alias("n_rest")), "open-groups"))
    return rows.join(of_group, group).withColumn("big", F.col("component") == F.col("largest")).drop("largest")


def _tiles(rows: DataFrame, group: str, size: int) -> DataFrame:
    """rows of _open, each once for every pair of parts that it is in: part, and the parts x <= y. A group of up to `size`
    rows is one part. Of others the largest component and the rest have parts of their own, and parts of the largest
    component never meet one another: they are linked already. So copies grow with the rows that are not."""
    whole = F.col("n_big") + F.col("n_rest") <= size
    rest = F.when(whole, 1).otherwise(F.ceil(F.col("n_rest") / size)).cast("int")
    big = F.when(whole, 0).otherwise(F.ceil(F.col("n_big") / size)).cast("int")
    apart = F.col("big") & ~whole
    dealt = F.xxhash64("id")
    part = F.when(apart, rest + F.pmod(dealt, F.greatest(big, F.lit(1)))).otherwise(F.pmod(dealt, rest)).cast("int")
    others = F.sequence(F.lit(0), F.when(apart, rest).otherwise(rest + big) - 1)
    placed = rows.withColumn("part", part).withColumn("met", F.explode(others))
    placed = placed.withColumn("x", F.least("part", "met")).withColumn("y", F.greatest("part", "met"))
    return placed.drop("met", "n_big", "n_rest").withColumnRenamed(group, "key")


def _by_tile(batches: Iterator[pa.RecordBatch], columns: list[str], find: Callable) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, x and y; find gets the rows of one tile and gives pairs of ids."""
    current, held, found = None, [], set()
    for batch in batches:
        for row in common.rows_of(batch, "key", "x", "y", *columns):
            if row[:3] != current:
                if len(held) > 1:
                    found.update(find(held, current))
                current, held = row[:3], []
            held.append(row[3:])
        if len(found) > 100_000:
            yield common.emit(_PAIR_SCHEMA, list(zip(*sorted(found), strict=True)))
            found = set()
    if len(held) > 1:
        found.update(find(held, current))
    if found:
        yield common.emit(_PAIR_SCHEMA, list(zip(*sorted(found), strict=True)))


def _pair(a: int, b: int, close: int = 0) -> tuple[int, int, int]:
    return min(a, b), max(a, b), close


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is within the distance, of two kinds. Not close: pairs of components, as many as bring a tile's components
    together, one fewer than these at most. Close: for each document outside the largest component the nearest one."""

    def find(held: list[tuple], key: tuple) -> Iterator[tuple[int, int, int]]:
        tile, groups = _Tile(held, key), _Groups([h[3] for h in held])
        for i in [k for k, h in enumerate(held) if not h[4]]:
            near, far = tile.near(i)
            if not len(near):
                continue
            for j in near[np.unique(tile.component[near], return_index=True)[1]].tolist():
                if groups.join(i, j):
                    yield _pair(held[i][3], held[j][3])
            yield _pair(held[i][0], int(tile.ids[near[far == far.min()]].min()), 1)

    yield from _by_tile(batches, ["id", "signature", "part", "component", "big"], find)


def _exact(percent: int):
    """Pairs that meet the similarity and bring components of a tile together, from products of its 0/1 matrix."""

    def find(held: list[tuple], _: tuple) -> Iterator[tuple[int, int, int]]:
        component = np.array([h[2] for h in held])
        if (component == component[0]).all():
            return
        sets = [np.frombuffer(h[1], np.uint64) for h in held]
        sizes = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), sizes)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, column = row[times[column] > 1], column[times[column] > 1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        column = np.cumsum(np.diff(column, prepend=column[:1]) > 0) if len(column) else column
        shared = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            lo, hi = np.searchsorted(column, (at, at + 2048))
            part = np.zeros((len(sets), 2048), np.float32)
            part[row[lo:hi], column[lo:hi] - at] = 1
            shared += part @ part.T
        counts = shared.astype(np.int64)
        linked = 100 * counts >= percent * (sizes[:, None] + sizes[None, :] - counts)
        groups = _Groups(component.tolist())
        for i, j in zip(*np.nonzero(np.triu(linked & (component[:, None] != component), 1)), strict=True):
            if groups.join(int(i), int(j)):
                yield _pair(held[i][0], held[j][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_tile(batches, ["id", "hashes", "component"], find)

    return run


def _hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["id", "hashes"])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures are within the distance."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), "<u2").reshape(batch.num_rows, -1) for n in ("x", "y"))
            yield batch.select(["u", "v"]).filter(pa.array((x != y).sum(1) <= DISTANCE))


def _confirm(percent: int):
    """Rows come sorted by v and part: the sets of v first (u is null), then those of the documents that are met with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hubs = None, []
        for batch in batches:
            kept = []
            for v, part, u, hashes in common.rows_of(batch, "v", "part", "u", "hashes"):
                if (v, part) != current:
                    current, hubs = (v, part), []
                found = np.frombuffer(hashes, np.uint64)
                if u is None:
                    hubs.append(found)
                    continue
                for hub in hubs:
                    at = np.searchsorted(hub, found)
                    shared = int((hub[np.minimum(at, len(hub) - 1)] == found).sum())
                    if 100 * shared >= percent * (len(hub) + len(found) - shared):
                        kept.append(_pair(u, v, 1))
            yield common.emit(_PAIR_SCHEMA, list(zip(*kept, strict=True)) if kept else [[], [], []])

    return run


def _links(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets meet the similarity. A document v that many are met with is dealt to several tasks, its
    set once to each; the sets of the others move once."""
    met = pairs.groupBy("v").agg(F.count("*").alias("n"))
    dealt = pairs.join(common.side(met), "v").select("u", "v", F.pmod(F.xxhash64("u"), F.ceil(F.col("n") / STAR)).cast("int").alias("part"))
    dealt = common.materialize(dealt, "stars")
    members = dealt.join(full.select(F.col("id").alias("u"), "hashes"), "u").select("v", "part", "u", "hashes")
    hubs = dealt.select("v", "part").distinct().join(full.select(F.col("id").alias("v"), "hashes"), "v").select("v", "part", F.lit(None).cast("long").alias("u"), "hashes")
    rows = members.unionAll(hubs).repartition("v", "part").sortWithinPartitions("v", "part", F.col("u").asc_nulls_first())
    return rows.mapInArrow(common.tidy(_confirm(percent)), "a long, b long, close int").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def link(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest id that links lead to) and kept (whether
    that is its own). Links: 100 * shared shingles >= percent * all shingles of the two.

    Null and empty texts have no shingles and no links; a null id has links to rows with an equal set only. Rows that share
    an id count as one document. Equal rows are each returned, kept alike. Other columns are not read.

    Texts never move but for those of documents in a near pair. Equal sets meet in a combining aggregate. The first round
    meets the documents of a key with one of them only, the one whose own keys have the most documents: the centre of a
    group of near copies. What it links needs no more comparison. The second round compares, in tiles of bounded size, the
    documents of a key across components; in either round a group never gives all its pairs.
    """
    common.arrow_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    with common.written() as tables:
        signed = common.materialize(texts.mapInArrow(common.tidy(_sign), "id long, n long, print binary, signature binary"), "signatures")
        sets = signed.where("n > 0").groupBy("print").agg(F.min("id").alias("id"), F.first("signature").alias("signature"))
        sets = common.materialize(sets, "sets")
        groups = components(_all_links(texts, sets.where("id is not null").select("id", "signature"), percent))
        of_set = sets.select("print", "id").join(groups, sets.id == groups.node, "left").select("print", F.coalesce("component", "id").alias("component"))
        rows = signed.where("n > 0").select("id", "n", "print").join(of_set, "print").select("id", "n", "component")
        rows = rows.unionAll(signed.where("n = 0").select("id", "n", F.col("id").alias("component")))
        out = rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
    common.release(out, tables)
    return out


def _all_links(texts: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that give the components of all links between the documents of named (id, signature)."""
    keys = named.mapInArrow(common.tidy(_keys), "key long, id long")
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = common.materialize(keys.join(counts, "key"), "keys")

    def sets_of(ids: DataFrame, but: DataFrame | None = None) -> DataFrame:
        ids = ids if but is None else ids.join(but.select("id").distinct(), "id", "left_anti")
        found = texts.join(common.side(common.materialize(ids, "wanted")), "id", "left_semi").mapInArrow(common.tidy(_hash_sets), "id long, hashes binary")
        return common.materialize(found.dropDuplicates(["id", "hashes"]), "hash-sets")

    # first round: each document of a key with the key's centre
    centrality = shared.groupBy("id").agg(F.sum("n").alias("score"))
    centres = shared.join(centrality, "id").groupBy("key").agg(F.max(F.struct("score", "id")).alias("centre")).select("key", F.col("centre.id").alias("v"))
    star = common.materialize(shared.join(common.side(common.materialize(centres, "centres")), "key").where("id <> v").select(F.col("id").alias("u"), "v").distinct(), "star")
    met = star.join(named.select(F.col("id").alias("u"), F.col("signature").alias("x")), "u").join(named.select(F.col("id").alias("v"), F.col("signature").alias("y")), "v")
    near = common.materialize(met.mapInArrow(common.tidy(_within), "u long, v long"), "near")
    full = sets_of(near.select(F.col("u").alias("id")).unionAll(near.select(F.col("v").alias("id"))).distinct())
    links = common.materialize(_links(near, full, percent), "links")

    def compare(rows: DataFrame, columns: list[str], how: Callable) -> DataFrame:
        dealt = rows.select("key", "x", "y", *columns).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
        return dealt.mapInArrow(common.tidy(how), "a long, b long, close int").distinct()

    # second round: components that still share a key, and what pairs within the distance connect
    linked = common.side(common.materialize(components(links), "components"))
    labelled = shared.join(linked, shared.id == linked.node, "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    labelled = common.materialize(_open(common.materialize(labelled, "labelled"), "key"), "open")
    pairs = compare(_tiles(labelled, "key", TILE).join(named, "id"), ["id", "signature", "part", "component", "big"], _candidates)
    pairs = common.materialize(pairs, "pairs")
    if not pairs.limit(1).count():
        return links
    wide = components(pairs.where("close = 0").select(F.col("a").alias("u"), F.col("b").alias("v")))
    wide = common.side(common.materialize(wide.select(F.col("node").alias("component"), F.col("component").alias("wide")), "wide"))
    members = common.materialize(labelled.select("id", "component").distinct().join(wide, "component").select("id", "wide"), "members")
    full = full.unionAll(sets_of(members.select("id"), full))
    nearest = pairs.where("close = 1").select(F.col("a").alias("u"), F.col("b").alias("v")).join(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti")
    links = links.unionAll(common.materialize(_links(nearest, full, percent), "links"))
    # components of a connected group that are still apart are compared in full
    linked = common.side(common.materialize(components(links), "components"))
    several = members.join(linked, members.id == linked.node, "left").select("id", "wide", F.coalesce("component", "id").alias("component"))
    dealt = _tiles(_open(common.materialize(several, "several"), "wide"), "wide", FULL_TILE).join(full, "id")
    return links.unionAll(common.materialize(compare(dealt, ["id", "hashes", "component"], _exact(percent)).select(F.col("a").alias("u"), F.col("b").alias("v")), "links"))
