"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words. For windows of one length a block is two words (one, for windows of
one word): the shift table tells how far no window can end, a shift of zero leads to the windows with that last block, and
those with the right first word are compared in full.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import common

WINDOW = 10
#: Benchmark text bytes in one search table; more items make more tables, each applied in a pass of its own.
TABLE_BYTES = 16 << 20
#: The word class as bytes of UTF-8: digits, letters, and all that is not ASCII. A-Z become a-z, all else a space.
_WORDS = bytes((b | 32) if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; none for null."""
    return (text or b"").translate(_WORDS).split()


class _OneLength:
    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.ends: dict[tuple, dict[bytes, list[tuple[list[bytes], list]]]] = {}

    def add(self, window: tuple[bytes, ...], items: list) -> None:
        for j in range(self.block - 1, self.length):
            key = window[j - self.block + 1 : j + 1]
            self.shift[key] = min(self.shift.get(key, self.most), self.length - 1 - j)
        self.ends.setdefault(window[-self.block :], defaultdict(list))[window[0]].append((list(window), items))

    def search(self, words: list[bytes], marks: bytearray, items: set) -> None:
        length, most, shift, n = self.length, self.most, self.shift.get, len(words)
        i = length - 1
        while i < n:
            key = (words[i - 1], words[i]) if self.block == 2 else (words[i],)
            if step := shift(key, most):
                i += step
                continue
            begin = i - length + 1
            for window, found in self.ends[key].get(words[begin], ()):
                if words[begin : i + 1] == window:
                    marks[begin : i + 1] = b"\1" * length
                    items.update(found)
            i += 1


class WuManber:
    """Search tables of (item id, text) pairs: windows of `window` words, or the whole of a shorter item."""

    def __init__(self, items: Iterable[tuple[object, bytes | None]], window: int = WINDOW):
        windows: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                windows[tuple(words[i : i + window])].update(() if item is None else (item,))
        self.lengths: dict[int, _OneLength] = {}
        for w, ids in sorted(windows.items()):
            self.lengths.setdefault(len(w), _OneLength(len(w))).add(w, sorted(ids))

    def search(self, words: list[bytes]) -> tuple[bytearray, set]:
        """A mark for each word that lies in an occurrence, and the ids of the items that occur."""
        marks, items = bytearray(len(words)), set()
        for table in self.lengths.values():
            table.search(words, marks, items)
        return marks, items


def _spans(marks: bytearray) -> tuple[list[int], list[int]]:
    starts, ends, at = [], [], marks.find(1)
    while at >= 0:
        end = marks.find(0, at)
        end = len(marks) if end < 0 else end
        starts.append(at)
        ends.append(end)
        at = marks.find(1, end)
    return starts, ends


_FOUND = "n_words long, starts array<int>, ends array<int>, items array<{item}>"
_FOUND_FIELDS = [("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]


def _scan(tables, text_at: int, before: bool, item: str = "long"):
    """Searches the text in column text_at; columns of an earlier pass (the last four) are added to."""

    fields = [*_FOUND_FIELDS, ("items", pa.list_(pa.int64() if item == "long" else pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: WuManber = tables.value
        for batch in batches:
            kept = batch.columns[: len(batch.columns) - 4] if before else batch.columns
            old = [batch.column(len(kept) + k).to_pylist() for k in range(4)] if before else None
            out: list[list] = [[], [], [], []]
            for row, text in enumerate(batch.column(text_at).to_pylist()):
                words = words_of(text)
                marks, items = table.search(words)
                if old:
                    items.update(old[3][row])
                    for a, b in zip(old[1][row], old[2][row], strict=True):
                        marks[a:b] = b"\1" * (b - a)
                for column, value in zip(out, (len(words), *_spans(marks), sorted(items)), strict=True):
                    column.append(value)
            names = batch.schema.names[: len(kept)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True))], names=[*names, *(n for n, _ in fields)])

    return run


def _tables(spark: SparkSession, benchmark: DataFrame, item: Column, text_col: str, window: int, table_bytes: int) -> Iterator:
    """Broadcast tables; the driver holds one at a time, of table_bytes of text at most (or one longer item)."""
    held, size = [], 0
    rows = benchmark.select(item, F.col(text_col).cast("binary"))
    for item, text in rows.toLocalIterator():
        held.append((item, bytes(text) if text is not None else None))
        size += len(text or b"")
        if size >= table_bytes:
            yield spark.sparkContext.broadcast(WuManber(held, window))
            held, size = [], 0
    if held or size:
        yield spark.sparkContext.broadcast(WuManber(held, window))


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The columns `keep` of docs (all by default; they may be null or repeat) with n_words, starts and ends (word spans
    that lie in occurrences, end exclusive) and items (ids of the items that occur, ascending: numbers, or texts if they are).

    Null and empty texts have no words. Items without words match nothing; items with a null id are hits without a name.
    An empty benchmark hits nothing. No shuffle: each table is broadcast (bounded by table_bytes) and rows stream by; with
    more tables, every pass is written before the next.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    keep = docs.columns if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text_col).cast("binary").alias("words_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    kind = "long" if isinstance(benchmark.schema[item_col].dataType, IntegralType) else "string"
    found, first = _FOUND.format(item=kind), True
    for table in _tables(spark, benchmark, F.col(item_col).cast(kind), item_text, window, table_bytes):
        rows = rows if first else common.materialize(rows, "wu-manber")
        rows = rows.mapInArrow(common.tidy(_scan(table, len(names), not first, kind)), f"{schema}, {found}")
        first = False
    if first:
        rows = rows.mapInArrow(common.tidy(_scan(spark.sparkContext.broadcast(WuManber([], window)), len(names), False, kind)), f"{schema}, {found}")
    return rows.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "n_words", "starts", "ends", "items")
