"""Quality rules: counts of a text that fail it outright, and a calibrated classifier for the rest.

The classifier is a logistic regression on hashed n-grams, of words (one and two, A-Z in lower case) and of characters (two to
four bytes of UTF-8, as they stand). Both kinds are shares of their text, so a score is the mean weight of its words and of its
characters, whatever its length, and needs no sort. Weights are fitted on a bounded sample of labelled rows (PER_CLASS of each
class) until the gradient is small; rows that the fit has not seen then turn scores into probabilities (a logistic curve with the
shares of all labels), and fixed thresholds decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, spans
from .words import mixed

#: Hashed features: half of them for words, half for characters.
BITS = 18
WORD_ORDERS, CHAR_ORDERS = (1, 2), (2, 3, 4)
#: Labelled rows of each class that weights are fitted on, those with the smallest hash of their id; every CALIBRATE-th of them
#: is kept for the calibration instead.
PER_CLASS, CALIBRATE = 2000, 5
#: A share is multiplied by this, so that a penalty of PENALTY times the squared weights is a mild one.
GAIN, PENALTY = 30.0, 1e-4
#: The fit ends when the largest component of its gradient is below this.
TOLERANCE, MOST_STEPS = 1e-4, 200
#: A text is kept from this probability of good quality on; a text of less than LEAST_WORDS words, or with more than
#: MOST_REPEATED percent of its words in repeated windows, fails whatever its probability.
KEEP, LEAST_WORDS, MOST_REPEATED = 0.5, 50, 50
#: Labels up to this number of rows (16 bytes each) are broadcast to the texts; more are joined by shuffle.
MOST_BROADCAST = 2_000_000
_SLICE = 1 << 19
_LOWER = np.array([b | 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_HALF = 1 << (BITS - 1)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i] : first[i + 1]]."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return upto[first[1:]] - upto[first[:-1]]


class Texts:
    """Words of a batch of texts: those of text i are first[i] to first[i + 1]."""

    def __init__(self, texts: pa.Array):
        self.raw, self.cuts = spans.text_bytes(texts)
        self.starts, self.ends = spans.runs(~_SPACE[self.raw], self.cuts)
        self.first = np.searchsorted(self.starts, self.cuts)
        self.n_words = np.diff(self.first)

    def measures(self) -> list[np.ndarray]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
        begins = (self.raw & 0xC0) != 0x80  # of a code point
        chars = _sums(begins & ~_SPACE[self.raw], self.cuts)
        symbols = _sums(_SYMBOL[self.raw], self.cuts)
        return [self.n_words, chars, symbols, self._repeated_lines(), self._repeated_words()]

    def _repeated_lines(self) -> np.ndarray:
        out = np.zeros(len(self.n_words), np.int64)
        data = self.raw.tobytes()
        for i, (a, b) in enumerate(zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True)):
            lines = [x for x in data[a:b].split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
            out[i] = len(lines) - len(set(lines))
        return out

    def _repeated_words(self) -> np.ndarray:
        """Words in windows of three that their text holds twice or more."""
        words = spans.hashes(self.raw, self.starts, self.ends)
        row = np.repeat(np.arange(len(self.n_words)), self.n_words)
        n = max(len(words) - 2, 0)
        inside = np.flatnonzero(row[:n] == row[2 : n + 2]) if n else np.zeros(0, np.int64)
        key = mixed(mixed(mixed(words[inside]) ^ words[inside + 1]) ^ words[inside + 2])
        key = mixed(key + row[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # of this text
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[inside[again] + k] = True
        return _sums(covered, self.first)

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, feature) of every occurrence, some at a time: words in the first half of the features, characters in the other."""
        words = spans.hashes(_LOWER[self.raw], self.starts, self.ends)
        row = np.repeat(np.arange(len(self.n_words)), self.n_words)
        for order in WORD_ORDERS:
            n = max(len(words) - order + 1, 0)
            value = words[:n]
            for k in range(1, order):
                value = mixed(value) ^ words[k : n + k]
            good = row[:n] == row[order - 1 :]
            yield row[:n][good], (mixed(value[good]) >> np.uint64(64 - BITS + 1)).astype(np.int64)
        for a in range(0, len(self.raw), _SLICE):
            part = self.raw[a : a + _SLICE + max(CHAR_ORDERS) - 1]
            at = np.arange(a, a + len(part))
            text = np.searchsorted(self.cuts, at, "right") - 1
            value = np.zeros(len(part), np.uint32)
            for n in range(1, max(CHAR_ORDERS) + 1):
                value = value[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(n)
                if n in CHAR_ORDERS:
                    size = min(len(value), _SLICE)
                    good = text[:size] == text[n - 1 : n - 1 + size]
                    number = ((value[:size] ^ (value[:size] >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS + 1)
                    yield text[:size][good], number[good].astype(np.int64) + _HALF

    def n_features(self) -> tuple[np.ndarray, np.ndarray]:
        """How many occurrences of word and of character features each text has, at least one."""
        size = np.diff(self.cuts)
        of = lambda n, orders: np.maximum(sum(np.maximum(n - k + 1, 0) for k in orders), 1)
        return of(self.n_words, WORD_ORDERS), of(size, CHAR_ORDERS)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Mean weight of a text's words plus that of its characters, times GAIN."""
        sums = np.zeros((2, len(self.n_words)))
        for text, number in self.features():
            if len(text):
                sums[int(number[0] >= _HALF)] += np.bincount(text, weights[number], minlength=len(self.n_words))
        words, chars = self.n_features()
        return GAIN * (sums[0] / words + sums[1] / chars)

    def counted(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its distinct features and their shares."""
        found = list(self.features())
        key = np.concatenate([text << BITS | number for text, number in found] or [np.zeros(0, np.int64)])
        pairs, n = np.unique(key, return_counts=True)
        text, number = pairs >> BITS, pairs & ((1 << BITS) - 1)
        total = np.stack(self.n_features())
        share = n / total[(number >= _HALF).astype(int), text]
        cut = np.searchsorted(text, np.arange(len(self.n_words) + 1))
        return [(number[a:b].astype("<i4"), share[a:b].astype("<f4")) for a, b in zip(cut[:-1], cut[1:], strict=True)]


@dataclass
class Model:
    """probability = sigmoid(slope * score + intercept)."""

    weights: np.ndarray
    slope: float
    intercept: float

    def probabilities(self, texts: Texts) -> np.ndarray:
        return _sigmoid(self.slope * texts.scores(self.weights) + self.intercept)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def minimise(f, x: np.ndarray, tolerance: float = TOLERANCE, steps: int = MOST_STEPS, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent on f, which gives value and gradient, until the gradient is small."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(g).max(initial=0) < tolerance:
            break
        d, back = g.copy(), []
        for s, y, rho in reversed(past):
            back.append(rho * (s @ d))
            d -= back[-1] * y
        if past:
            s, y, _ = past[-1]
            d *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(past, reversed(back), strict=True):
            d += s * (a - rho * (y @ d))
        slope, step = -(g @ d), 1.0
        if slope >= 0:
            d, slope, past = g.copy(), -(g @ g), []
        if not past:
            step = 1 / max(1.0, float(np.abs(g).sum()))
        while True:
            new = x - step * d
            v, h = f(new)
            if v <= value + 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        s, y = new - x, h - g
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        x, value, g = new, v, h
    return x


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights of all features, intercept): both classes weigh the same, whatever their numbers."""
    counts = np.array([len(n) for n, _ in rows])
    numbers = np.concatenate([n for n, _ in rows])
    shares = np.concatenate([s for _, s in rows]) * np.float32(GAIN)
    used, where = np.unique(numbers, return_inverse=True)
    where = where.astype(np.int32)
    del numbers
    first = np.concatenate([[0], np.cumsum(counts)])
    weight = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum())

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = _sums(x[:-1][where] * shares, first) + x[-1]
        value = weight @ np.logaddexp(0, np.where(good, -z, z)) + PENALTY / 2 * (x[:-1] @ x[:-1])
        error = weight * (_sigmoid(z) - good)
        g = np.append(np.bincount(where, np.repeat(error, counts) * shares, minlength=len(used)), error.sum())
        g[:-1] += PENALTY * x[:-1]
        return float(value), g

    x = minimise(loss, np.zeros(len(used) + 1))
    weights = np.zeros(1 << BITS)
    weights[used] = x[:-1]
    return weights, float(x[-1])


def calibrate(score: np.ndarray, good: np.ndarray, share: float) -> tuple[float, float]:
    """(slope, intercept) of a logistic curve over scores, with smoothed targets; classes weigh as in all labels."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(good, share / n1, (1 - share) / n0)
    spread = max(float(score.std()), 1e-9)
    x = score / spread

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = p[0] * x + p[1]
        value = weight @ (target * np.logaddexp(0, -z) + (1 - target) * np.logaddexp(0, z))
        error = weight * (_sigmoid(z) - target)
        return float(value), np.array([error @ x, error.sum()])

    slope, intercept = minimise(loss, np.zeros(2), tolerance=1e-7)
    return slope / spread, intercept


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Train on a sample of the rows of docs with a label 0 or 1. Null ids and labels teach nothing; of several labels of a
    document the least counts; null texts are empty. Without both classes, or with less than CALIBRATE rows of one, every text
    gets the share of good labels (one half without any)."""
    spark = docs.sparkSession
    common.arrow_batches(spark, rows=500, megabytes=8)
    told = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("good")).where("id is not null and good in (0, 1)").groupBy("id").agg(F.min("good").alias("good"))
    side = F.broadcast(told) if told.count() <= MOST_BROADCAST else told
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).join(side, "id")
    n = {r.good: r.n for r in told.join(rows.select("id").distinct(), "id", "left_semi").groupBy("good").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    alone = Model(np.zeros(1 << BITS), 0.0, float(np.log((n1 + 1) / (n0 + 1))))
    if min(n0, n1) < CALIBRATE:
        return alone
    present = told.join(rows.select("id").distinct(), "id", "left_semi")
    picked = [present.where(F.col("good") == c).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS) for c in (0, 1)]
    ids = F.broadcast(picked[0].unionAll(picked[1]).select("id"))  # bounded by PER_CLASS

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Texts(batch.column(2)).counted()
            lists = [pa.array([x.tobytes() for x in column], pa.binary()) for column in zip(*found, strict=True)] if found else [pa.array([], pa.binary())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["id", "good", "numbers", "shares"])

    sample = rows.join(ids, "id", "left_semi").select("id", "good", "text").mapInArrow(common.tidy(chosen), "id long, good int, numbers binary, shares binary").dropDuplicates(["id"])
    table = sample.select("*", F.xxhash64("id").alias("order")).toArrow().sort_by([("good", "ascending"), ("order", "ascending"), ("id", "ascending")])
    good = table.column("good").to_numpy() == 1
    rank = np.concatenate([np.arange((~good).sum()), np.arange(good.sum())])
    kept = rank % CALIBRATE == 0
    features = [(np.frombuffer(a, "<i4"), np.frombuffer(b, "<f4")) for a, b in zip(table.column("numbers").to_pylist(), table.column("shares").to_pylist(), strict=True)]
    del table
    weights, _ = fit_weights([f for f, k in zip(features, kept, strict=True) if not k], good[~kept])
    score = np.array([GAIN * (weights[a] @ b) for (a, b), k in zip(features, kept, strict=True) if k])
    model = Model(weights.astype(np.float32), *calibrate(score, good[kept], n1 / (n0 + n1)))
    del features
    common.give_back()
    return model


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, score
    (the probability of good quality) and kept. One row for each row, no shuffle.

    Null and empty texts have no words: they fail. Lines and words are compared as they stand; a word is what stands between
    ASCII white space. What stands in other columns of docs, whatever their names, is not read.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark, rows=500, megabytes=8)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text_col).cast("binary").alias("judged_text"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column(len(names)))
            found = [pa.array(m, pa.int64()) for m in texts.measures()] + [pa.array(shared.value.probabilities(texts), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*names, *MEASURES, "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"{m} long" for m in MEASURES] + ["score double"]
    judged = rows.mapInArrow(common.tidy(run), ", ".join(fields))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return judged.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), *MEASURES, failed.alias("base_failed"), "score", (~failed & (F.col("score") >= KEEP)).alias("kept"))
