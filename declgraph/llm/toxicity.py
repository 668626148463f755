"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Document counts of every n-gram in either class cover all labelled training rows; the weights on top of the log-count
ratios are fitted by logistic regression on a bounded sample of them (PER_CLASS rows of each class).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: n-grams of so many bytes, hashed to 2 ** BITS features.
ORDERS, BITS = (3, 4, 5, 6), 20
#: Rows of each class in the sample that the weights are fitted on, those with the smallest hash of their id.
PER_CLASS = 2000
#: A feature takes part if its log-count ratio, of either sign, is so many standard errors from zero: nearer ones are counts
#: that chance explains, and a sample of PER_CLASS rows would fit weights to them.
LEAST_Z = 4.0
#: Labels up to this number of rows (16 bytes each) are broadcast to the texts; more are joined by shuffle.
MOST_BROADCAST = 2_000_000
#: Tasks whose counts (256 KB each) are added up together, and rounds of that: enough for FAN_IN ** ROUNDS tasks.
FAN_IN, ROUNDS = 64, 3
_CHUNK = 1 << 14
#: Features that one step of the fit holds as numbers at a time.
_FIT_BLOCK = 1 << 19
_SLICE = 1 << 16
_LETTERS = bytes((b | 32) if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _numbers(raw: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the feature numbers of the n-grams at every place of raw."""
    value = np.zeros(len(raw), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        value = value[: len(raw) - n + 1] * np.uint32(0x01000193) + raw[n - 1 :] + np.uint32(n == 1)
        if n in ORDERS:
            mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x9E3779B1)
            yield mixed >> np.uint32(32 - BITS)


_GAP = b"\0" * (max(ORDERS) - 1)


def _bytes(texts: list[bytes | None]) -> np.ndarray:
    """Texts in lower case (A-Z) with signs as spaces, and zero bytes around them: no n-gram holds bytes of two texts."""
    return np.frombuffer(_GAP + b"".join((t or b"").translate(_LETTERS) + _GAP for t in texts), np.uint8)


class Distinct:
    """The distinct features of one text, without a sort: the last place that writes a feature's cell stands for it."""

    def __init__(self) -> None:
        self.cell = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: bytes | None) -> np.ndarray:
        numbers = np.concatenate(list(_numbers(_bytes([text]))))
        places = np.arange(len(numbers), dtype=np.int32)
        self.cell[numbers] = places
        return numbers[self.cell[numbers] == places]


def wanted_features(texts: list[bytes | None], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, feature numbers): the distinct features of each text that wanted keeps, some texts at a time."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < _SLICE or end == at):
            size += len(texts[end] or b"") + len(_GAP)
            end += 1
        starts = np.cumsum([0] + [len(t or b"") + len(_GAP) for t in texts[at:end]])
        keys = []
        for number in _numbers(_bytes(texts[at:end])):
            place = np.flatnonzero(wanted[number])
            row = np.minimum(np.searchsorted(starts, place, "right") - 1, end - at - 1)
            keys.append(row << BITS | number[place])
        pairs = np.unique(np.concatenate(keys))
        yield at + (pairs >> BITS), pairs & ((1 << BITS) - 1)
        at = end


_COUNTS = "part int, task int, data binary"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class with each feature, as packed parts of the two arrays."""
    counts, rows, distinct = np.zeros((2, 1 << BITS), np.uint32), [0, 0], Distinct()
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows[toxic] += 1
            counts[toxic][distinct(text.as_py())] += 1
    if sum(rows):
        parts = [(k, counts[:, k * _CHUNK : (k + 1) * _CHUNK].astype("<u8").tobytes()) for k in range((1 << BITS) // _CHUNK)]
        parts.append((-1, np.array(rows, "<u8").tobytes()))
        task = [TaskContext.get().partitionId()] * len(parts)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array(task, pa.int32()), pa.array([d for _, d in parts], pa.binary())], names=["part", "task", "data"])


def _sums(table: pa.Table) -> pa.Table:
    """One row for the rows of a part, at most FAN_IN."""
    total = sum(np.frombuffer(data, "<u8") for data in table.column("data").to_pylist())
    return pa.table([table.column("part")[:1], table.column("task")[:1], pa.array([total.astype("<u8").tobytes()], pa.binary())], names=["part", "task", "data"])


def _added(rows: DataFrame) -> DataFrame:
    """The counts of all tasks, in rounds: no group holds more than FAN_IN rows, however many tasks there are."""
    counts = rows.mapInArrow(common.tidy(_count), _COUNTS)
    for _ in range(ROUNDS):
        counts = counts.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("part", "task").applyInArrow(_sums, _COUNTS)
    return counts


@dataclass
class Model:
    """score = sigmoid(bias + sum of weights of the distinct features)."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        wanted = self.weights != 0
        for row, number in wanted_features(texts, wanted):
            out += np.bincount(row, self.weights[number], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit_weights(rows: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, prior: float, steps: int = 300, penalty: float = 1e-3) -> Model:
    """Logistic regression on features scaled by their log-count ratio. The intercept is no weight: it is the share of toxic
    rows, in the sample while weights are fitted and of all labels (prior) afterwards. So a text without any feature, however
    short, has the share of toxic labels as its score, and features of either sign have to speak for a class. Rows are taken a
    block at a time, and let go of once they are in one."""
    seen = np.zeros(1 << BITS, bool)
    for r in rows:
        seen[r] = True
    used = np.flatnonzero(seen)
    number = np.cumsum(seen, dtype=np.int32) - 1
    blocks, at = [], 0  # (first row, features of its rows one after the other, how many each row has)
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (size < _FIT_BLOCK or end == at):
            size += len(rows[end])
            end += 1
        blocks.append((at, number[np.concatenate(rows[at:end])], np.array([len(r) for r in rows[at:end]])))
        rows[at:end] = [None] * (end - at)
        at = end
    scale, share = ratio[used], toxic.mean()
    w, b = np.full(len(used), 0.1), np.log(share / (1 - share))
    m, v = np.zeros(len(used)), np.zeros(len(used))
    for step in range(1, steps + 1):
        g, sw = penalty * w, scale * w
        for first, where, counts in blocks:
            z = b + np.bincount(np.repeat(np.arange(len(counts), dtype=np.int32), counts), sw[where], minlength=len(counts))
            error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic[first : first + len(counts)]
            g += np.bincount(where, np.repeat(error, counts), minlength=len(used)) * scale / len(toxic)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = scale * w
    return Model(weights, float(np.log(prior / (1 - prior))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on every row of docs with a label 0 or 1. Null ids and labels teach nothing; of several labels of a document
    the largest counts; null texts are empty. With less than two classes the model is the share of toxic rows alone."""
    common.arrow_batches(docs.sparkSession)
    told = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    side = F.broadcast(told) if told.count() <= MOST_BROADCAST else told
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).join(side, "id")
    packed = _added(rows.select("toxic", "text"))
    parts: dict[int, np.ndarray] = {}
    for r in packed.toLocalIterator():  # bounded by the number of features
        parts[r.part] = parts.get(r.part, 0) + np.frombuffer(bytes(r.data), "<u8").astype(np.float32 if r.part >= 0 else float)
    n = parts.pop(-1, np.zeros(2))
    if not n.all():
        share = (n[1] + 1) / (n.sum() + 2)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    negative, positive = np.concatenate([parts.pop(k).reshape(2, -1) for k in sorted(parts)], axis=1) + np.float32(0.5)
    ratio = np.log(positive / positive.sum(dtype=float)) - np.log(negative / negative.sum(dtype=float))
    strong = np.abs(ratio) / np.sqrt(1 / positive + 1 / negative) >= LEAST_Z
    kept = rows.sparkSession.sparkContext.broadcast(strong)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = Distinct()
        for batch in batches:
            each = [distinct(t.as_py()) for t in batch.column(2)]
            found = [n[kept.value[n]].astype("<i4").tobytes() for n in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "toxic", "numbers"])

    picked = [told.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS) for c in (0, 1)]
    ids = F.broadcast(picked[0].unionAll(picked[1]).select("id"))  # bounded by PER_CLASS
    found = rows.join(ids, "id", "left_semi").select("id", "toxic", "text").mapInArrow(common.tidy(chosen), "id long, toxic int, numbers binary")
    sample = found.dropDuplicates(["id"]).toArrow()
    toxic = sample.column("toxic").to_numpy().astype(float)
    if not 0 < toxic.sum() < len(toxic):
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(n[1] / n[0])))
    features = [np.frombuffer(x.as_py(), "<i4") for x in sample.column("numbers")]
    del sample
    model = fit_weights(features, toxic, ratio, n[1] / n.sum())
    common.give_back()
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with score (0 to 1). One row for each row; null and empty texts score as such; no shuffle."""
    common.arrow_batches(docs.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text_col).cast("binary").alias("score_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*names, "score"])

    scored = rows.mapInArrow(common.tidy(run), f"{schema}, score double" if schema else "score double")
    return scored.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "score")
