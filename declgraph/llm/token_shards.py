"""Token-id output: shards of concatenated ids whose document boundaries are Elias-Fano encoded.

A shard block is one binary value: a header, the Elias-Fano parts, the document ids and the ids. Spark's own writer
stores blocks (so a lost or repeated task leaves no half file), in ascending order of shard and block.
"""

from __future__ import annotations

import gc
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

_MAGIC = b"EFTS"
_HEAD = struct.Struct("<4sHHQQQQQ")  # magic, version, id width, documents, tokens, low bits, low words, high words
#: One position in this many is kept as a hint for select.
_EVERY = 256


class EliasFano:
    """A non-decreasing sequence of n numbers up to u in about n * (2 + log2(u / n)) bits.

    The low bits of each number are packed; number i sets bit (high part + i) of the high bits. select(i) starts from a
    kept hint and counts set bits by words, so no table of 64-bit offsets is needed.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, hints: np.ndarray):
        self.n, self.width, self.low, self.high, self.hints = n, width, low, high, hints

    @classmethod
    def build(cls, values: np.ndarray, upto: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        width = max(0, int(upto // n).bit_length() - 1) if n else 0
        low = np.zeros((n * width + 63) // 64, np.uint64)
        if width:
            bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
            packed = np.packbits(bits, bitorder="little")
            low.view(np.uint8)[: len(packed)] = packed
        ones = (values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(int(ones[-1]) // 64 + 1 if n else 0, np.uint64)
        np.bitwise_or.at(high, (ones >> np.uint64(6)).astype(np.int64), np.uint64(1) << (ones & np.uint64(63)))
        return cls(n, width, low, high, ones[::_EVERY].astype(np.uint64))

    def select(self, i: int) -> int:
        """The number at i, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.hints[i // _EVERY])
        left, word = i % _EVERY, at // 64
        bits = int(self.high[word]) >> (at % 64) << (at % 64)
        while (here := bits.bit_count()) <= left:
            left -= here
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        part = word * 64 + (bits & -bits).bit_length() - 1 - i
        return part << self.width | self._low(i)

    def _low(self, i: int) -> int:
        if not self.width:
            return 0
        word, shift = divmod(i * self.width, 64)
        got = int(self.low[word]) >> shift
        if shift + self.width > 64:
            got |= int(self.low[word + 1]) << (64 - shift)
        return got & ((1 << self.width) - 1)

    def decode(self) -> np.ndarray:
        """All numbers."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.width
        if self.width and self.n:
            bits = np.unpackbits(self.low.view(np.uint8), bitorder="little")[: self.n * self.width].reshape(self.n, self.width)
            out = out | (bits.astype(np.int64) << np.arange(self.width)).sum(1)
        return out


def pack_block(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> bytes:
    ef = EliasFano.build(ends, len(ids))
    known = np.array([x is not None for x in doc_ids], np.uint8)
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    head = _HEAD.pack(_MAGIC, 1, ids.dtype.itemsize, len(doc_ids), len(ids), ef.width, len(ef.low), len(ef.high))
    return b"".join([head, ef.low.astype("<u8").tobytes(), ef.high.astype("<u8").tobytes(), ef.hints.astype("<u8").tobytes(), keys.tobytes(), known.tobytes(), ids.tobytes()])


class Block:
    """A block as read: span(i) gives one document's ids by select; ends() all boundaries."""

    def __init__(self, data: bytes):
        magic, version, size, self.n, self.tokens, width, low, high = _HEAD.unpack_from(data)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a shard block of this version")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        parts = take("<u8", low), take("<u8", high), take("<u8", -(-self.n // _EVERY))
        self.boundaries = EliasFano(self.n, width, *parts)
        self.doc_ids, known = take("<i8", self.n), take("u1", self.n)
        self.known = known.astype(bool)
        self.ids = take(f"<u{size}", self.tokens)

    def ends(self) -> np.ndarray:
        return self.boundaries.decode()

    def span(self, i: int) -> np.ndarray:
        return self.ids[self.boundaries.select(i - 1) if i else 0 : self.boundaries.select(i)]


_BLOCKS = "shard int, block int, base long, n_docs long, n_tokens long, data binary"
_BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])


def _blocks(tokenizer: str, end_id: int, block_tokens: int, block_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing below makes cycles, and large lists of words would be walked again and again
        enc = encoder(tokenizer)
        shard, number, base = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, base, total
            ids = np.concatenate(held)
            out = common.emit(_BLOCK_SCHEMA, [[shard], [number], [base], [len(keys)], [len(ids)], [pack_block(keys, ids, np.cumsum(sizes))]])
            number, base, total = number + 1, base + len(ids), 0
            keys.clear(), held.clear(), sizes.clear()
            return out

        try:
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for at, ids, cuts in enc.encode(batch.column(1)):
                    ended = np.insert(ids, cuts[1:], end_id)
                    upto = cuts + np.arange(len(cuts))
                    i, n = 0, len(cuts) - 1
                    while i < n:  # the texts that still fit in the block; one at least
                        j = min(n, i + block_docs - len(keys), max(int(np.searchsorted(upto, upto[i] + block_tokens - total, "right")) - 1, i + (not keys)))
                        if j > i:
                            keys += doc_ids[at + i : at + j]
                            held.append(ended[upto[i] : upto[j]])
                            sizes += np.diff(upto[i : j + 1]).tolist()
                            total += int(upto[j] - upto[i])
                        if j < n:
                            yield flush()
                        i = j
            if keys:
                yield flush()
        finally:
            gc.enable()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 20, block_docs: int = 1 << 14) -> None:
    """Encode texts in ascending order of id (null ids first, equal ids by a hash of the text) and write shard blocks to path.

    Null texts are empty; every document gets end_id. One range shuffle of ids and texts; a block holds block_tokens ids
    and block_docs documents at most, or one longer document.
    """
    common.arrow_batches(docs.sparkSession, 3600)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("by", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "by").sortWithinPartitions("id", "by", "text").drop("by")  # so rows of one id can be split
    rows.mapInArrow(_blocks(tokenizer, end_id, block_tokens, block_docs), _BLOCKS).write.option("compression", "lz4_raw").parquet(path)


_SPAN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, data in common.rows_of(batch, "base", "data"):
            block = Block(data)
            ends = block.ends()
            begins = np.concatenate([[0], ends[:-1]])
            raw = memoryview(block.ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield common.emit(_SPAN_SCHEMA, [pa.array(block.doc_ids, mask=~block.known), base + begins, ends - begins, crc])


def read_spans(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files.

    What lies before a shard comes from one row for each shard: a task wrote it, so there are as many as write tasks.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = 0
    starts = []
    for row in sorted(sizes.collect()):
        starts.append((row.shard, before))
        before += row.n
    offsets = spark.createDataFrame(starts, "shard int, before long")
    rows = blocks.join(F.broadcast(offsets), "shard").select((F.col("base") + F.col("before")).alias("base"), "data")
    return rows.mapInArrow(_spans, "doc_id long, start long, n_tokens long, ids_crc32 long")
