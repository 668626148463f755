"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Pieces are dealt evenly to blocks of bounded size; each block is a packing problem of its own, evolved on several islands.
A chromosome is a list of whole bins. Crossover injects well-filled bins of one parent into the other, removes the bins
that hold their documents again, and best-fits the displaced documents. After an epoch each island's best chromosome
migrates to the next island. A block whose best chromosome needs no more bins than its sum of lengths is done: where best
fit alone reaches that bound, as it does for most blocks of many short documents, there is nothing left to evolve.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

BLOCK_PIECES, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 3, 2, 6, 4
#: Sequences with this fraction of the capacity left, or more, are packed once more with those of other blocks.
LEFT = 8

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(tokenizer: str, end_id: int, capacity: int, chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()
        enc = encoder(tokenizer, chunks)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for at, ids, cuts in enc.encode(batch.column(1)):
                raw = memoryview(np.insert(ids, cuts[1:], end_id).astype("<u4")).cast("B")
                upto = (cuts + np.arange(len(cuts))).tolist()
                for row, (a, b) in enumerate(zip(upto, upto[1:], strict=False), at):
                    for piece, start in enumerate(range(a, b, capacity)):
                        end = min(b, start + capacity)
                        for column, value in zip(out, (doc_ids[row], piece, start - a, end - start, zlib.crc32(raw[4 * start : 4 * end])), strict=True):
                            column.append(value)
            yield common.emit(_PIECE_SCHEMA, out)

    return run


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", chunks: int = 600_000) -> DataFrame:
    """The pieces of every document: its ids and end_id, cut only where it is longer than capacity. Null texts are empty.
    A worker remembers the ids of so many chunks of text (about 200 bytes each)."""
    common.arrow_batches(docs.sparkSession, 2000 if chunks >= 400_000 else 500)
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(common.tidy(_cut(tokenizer, end_id, capacity, chunks)), _PIECES)


class Packing:
    """Bins of item numbers with their free space; best fit finds the fullest bin with room by a bit mask of spaces."""

    def __init__(self, lengths: list[int], capacity: int, bins: list[list[int]]):
        self.lengths, self.capacity, self.bins = lengths, capacity, bins
        self.space = [capacity - sum(lengths[i] for i in b) for b in bins]

    def fit(self, items: list[int]) -> Packing:
        where: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for b, s in enumerate(self.space):
            where[s].append(b)
            mask |= 1 << s
        lengths, bins, space = self.lengths, self.bins, self.space
        for i in items:
            size = lengths[i]
            fits = mask >> size
            if fits:
                s = size + (fits & -fits).bit_length() - 1
                b = where[s].pop()
                if not where[s]:
                    mask ^= 1 << s
                bins[b].append(i)
            else:
                b, s = len(bins), self.capacity
                bins.append([i])
                space.append(s)
            s -= size
            space[b] = s
            where[s].append(b)
            mask |= 1 << s
        return self

    def worth(self) -> tuple[int, int]:
        """Fewer bins first, then fuller ones (free space in few bins)."""
        return len(self.bins), -sum(s * s for s in self.space)

    def genome(self) -> bytes:
        out = np.zeros(len(self.lengths), "<u4")
        for b, items in enumerate(self.bins):
            out[items] = b
        return out.tobytes()

    @classmethod
    def of(cls, lengths: list[int], capacity: int, genome: bytes) -> Packing:
        bins: dict[int, list[int]] = {}
        for i, b in enumerate(np.frombuffer(genome, "<u4").tolist()):
            bins.setdefault(b, []).append(i)
        return cls(lengths, capacity, [bins[b] for b in sorted(bins)])


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """Well-filled bins of b in a: whole bins go in, bins of a that share a document go out, the rest of those is fitted."""
    order = sorted(range(len(b.bins)), key=b.space.__getitem__)
    full = order[: max(1, len(order) // 2)]
    take = [b.bins[k][:] for k in rng.sample(full, max(1, len(full) // 2))]
    inside = {i for t in take for i in t}
    keep, displaced = [], []
    for items in a.bins:
        if inside.isdisjoint(items):
            keep.append(items[:])
        else:
            displaced += [i for i in items if i not in inside]
    return Packing(a.lengths, a.capacity, take + keep).fit(_longest_first(displaced, a.lengths))


def mutate(a: Packing, rng: random.Random) -> Packing:
    """The emptiest bins and some others are emptied and fitted again."""
    order = sorted(range(len(a.bins)), key=a.space.__getitem__)
    out = set(order[-max(1, len(order) // 50) :]) | set(rng.sample(order, max(1, len(order) // 20)))
    displaced = [i for k in out for i in a.bins[k]]
    return Packing(a.lengths, a.capacity, [x[:] for k, x in enumerate(a.bins) if k not in out]).fit(_longest_first(displaced, a.lengths))


def _longest_first(items: list[int], lengths: list[int]) -> list[int]:
    return sorted(items, key=lambda i: -lengths[i])


def evolve(lengths: list[int], capacity: int, genomes: list[bytes], rng: random.Random, generations: int, size: int) -> list[Packing]:
    """The best chromosomes of an island after some generations, best first."""
    least = -(-sum(lengths) // capacity)
    found = {g: Packing.of(lengths, capacity, g) for g in genomes}
    people = sorted(found.values(), key=Packing.worth)
    if not lengths or len(people[0].bins) == least:
        return people[:1]
    while len(people) < size:  # best fit in a disturbed order
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * rng.uniform(0.8, 1.0))
        people.append(Packing(lengths, capacity, []).fit(order))
    for _ in range(generations):
        people.sort(key=Packing.worth)
        if len(people[0].bins) == least:
            break
        first, second = people[0], rng.choice(people[1:])
        people += [crossover(first, second, rng), crossover(second, first, rng), mutate(first, rng)]
        people = sorted(people, key=Packing.worth)[:size]
    return sorted(people, key=Packing.worth)


_ORDER = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
_STATE = "block long, island int, lengths binary, genome binary"
_STATE_SCHEMA = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("genome", pa.binary())])
_PLACED = f"{_PIECES}, sequence_id long, `offset` long, left long"
_PLACED_SCHEMA = pa.schema([*_PIECE_SCHEMA, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("left", pa.int64())])


def _lengths(table: pa.Table, capacity: int) -> tuple[pa.Table, np.ndarray, int]:
    """The pieces in the order that item numbers mean, their lengths, and how many fill a sequence alone."""
    table = table.take(pc.sort_indices(table, _ORDER))
    lengths = table.column("length").to_numpy()
    return table, lengths, int((lengths == capacity).sum())


def pack(pieces: DataFrame, capacity: int, block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """pieces (as pieces_of gives them) with sequence_id and offset: each piece once, no sequence over capacity, no gaps.

    pieces is read more than once and should be a table. Equal pieces are packed each for itself; with none the result is
    empty. Each group is one block (or one island of it), whose size does not grow with the input; blocks are dealt by row
    number, so no document or length gathers in one. What blocks leave half empty is packed once more together, whole
    sequences to a block, so that never costs a sequence.
    """
    blocks = max(1, -(-pieces.count() // block_pieces))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    once = _pack_blocks(dealt.withColumn("bin", F.lit(None).cast("long")), capacity, islands, epochs)
    if blocks == 1:
        return once.drop("left")
    once = common.materialize(once, "packed")
    left = once.where(F.col("left") >= max(1, capacity // LEFT)).drop("left", "offset")
    more = max(1, -(-left.count() // block_pieces))
    again = left.withColumnRenamed("sequence_id", "bin").withColumn("block", F.pmod(F.xxhash64("bin"), F.lit(more)) + blocks)
    return once.where(F.col("left") < max(1, capacity // LEFT)).drop("left").unionAll(_pack_blocks(again, capacity, islands, epochs).drop("left"))


def _pack_blocks(dealt: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """Pack every block by itself; where pieces have a bin already, that packing takes part in the evolution."""

    def begin(key: tuple, table: pa.Table) -> pa.Table:
        table, lengths, full = _lengths(table, capacity)
        rest = lengths[full:].tolist()
        genomes = [Packing(rest, capacity, []).fit(list(range(len(rest)))).genome()]
        if not table.column("bin").null_count:
            genomes.append(np.unique(table.column("bin").to_numpy()[full:], return_inverse=True)[1].astype("<u4").tobytes())
        rows = [(k, g) for k in range(islands) for g in genomes]
        data = np.array(rest, "<u4").tobytes()
        return pa.table([[key[0].as_py()] * len(rows), [k for k, _ in rows], [data] * len(rows), [g for _, g in rows]], schema=_STATE_SCHEMA)

    def island(epoch: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            block, here = key[0].as_py(), key[1].as_py()
            lengths = np.frombuffer(table.column("lengths")[0].as_py(), "<u4").tolist()
            rng = random.Random(f"{block} {here} {epoch}")
            best = evolve(lengths, capacity, sorted(set(table.column("genome").to_pylist())), rng, GENERATIONS, POPULATION)
            genomes = [p.genome() for p in best]
            rows = [(here, g) for g in genomes] + [((here + 1) % islands, genomes[0])]
            data = table.column("lengths")[0].as_py()
            return pa.table([[block] * len(rows), [r[0] for r in rows], [data] * len(rows), [r[1] for r in rows]], schema=_STATE_SCHEMA)

        return run

    def place(key: tuple, table: pa.Table, genomes: pa.Table) -> pa.Table:
        table, lengths, full = _lengths(table, capacity)
        rest = lengths[full:].tolist()
        best = min((Packing.of(rest, capacity, g) for g in sorted(set(genomes.column("genome").to_pylist()))), key=Packing.worth)
        bins = [[i] for i in range(full)] + [[full + i for i in b] for b in best.bins]
        sequence, offset, left = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for b, items in enumerate(bins):
            sequence[items] = (key[0].as_py() << 24) + b
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
            left[items] = capacity - lengths[items].sum()
        return pa.table([*(table.column(f.name) for f in _PIECE_SCHEMA), sequence, offset, left], schema=_PLACED_SCHEMA)

    state = dealt.groupBy("block").applyInArrow(begin, _STATE)
    for epoch in range(epochs):
        state = state.groupBy("block", "island").applyInArrow(island(epoch), _STATE)
    return dealt.groupBy("block").cogroup(state.select("block", "genome").groupBy("block")).applyInArrow(place, _PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunks: int = 600_000) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null ids are kept."""
    with common.written() as tables:
        out = pack(common.materialize(pieces_of(docs, tokenizer, end_id, capacity, id_col, text_col, chunks), "pieces"), capacity)
    common.release(out, tables)
    return out
