"""Quality classifier: a support vector machine over Naive Bayes features.

A text is the set of its n-grams: of words, and of word shapes (case, digits,
marks, and whether a word repeats the one before); words over LONG bytes, as in
scripts without spaces, count as pieces. Each indicator is scaled by
the log ratio of its share in either class, and a linear hinge-loss model is
fitted to them by dual coordinate descent. A logistic curve, fitted to texts
that the model has not seen, turns margins into scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import ROW_ID, bounded_batches, with_row_ids
from .words import Coder, combined, texts_of

#: Hashed n-grams; labelled rows that the fit may use; share of them, in 5ths, that fits the curve.
BUCKETS, SAMPLE_ROWS, CURVE_FIFTHS = 1 << 18, 8_000, 1

THRESHOLD = 0.7

#: Bytes over which a word is cut into pieces, and a piece: up to 16 characters, so LONG bytes at most.
LONG, _PIECE = 64, re.compile(rb"(?:[^\x80-\xbf][\x80-\xbf]*|[\x80-\xbf]){1,16}")


class _Shapes(Coder):
    """Word to the code of its shape."""

    def __missing__(self, word: bytes) -> int:
        code = super().__missing__(shape(word))
        if len(word) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[word] = code
        return code


def shape(word: bytes) -> bytes:
    """Case, digits and marks of a word: runs of a class become one sign, runs of a mark at most three."""
    out: list[str] = []
    for c in word[:LONG].decode("utf-8", "ignore"):
        sign = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isnumeric() else c
        if not (out and out[-1] == sign and (sign in "Aa9" or out[-3:] == [sign] * 3)):
            out.append(sign)
    return "".join(out).encode()


class Features:
    """The distinct hashed n-grams of texts."""

    def __init__(self, buckets: int = BUCKETS):
        self.mask, self.words, self.shapes = np.uint64(buckets - 1), Coder(seed=1), _Shapes(seed=2)

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        if len(text) > LONG and max(map(len, words), default=0) > LONG:
            words = [piece for w in words for piece in (_PIECE.findall(w) if len(w) > LONG else (w,))]
        codes, shapes = self.words.codes(words), self.shapes.codes(words)
        if len(words) > 1:
            shapes[1:][codes[1:] == codes[:-1]] = 1
        pairs = combined(shapes[:-1], shapes[1:])
        grams = [codes, combined(codes[:-1], codes[1:]), shapes, pairs, combined(pairs[:-1], shapes[2:])]
        salted = [(g >> np.uint64(20)) + np.uint64(k) for k, g in enumerate(grams)]
        return np.unique(np.concatenate(salted) & self.mask).astype(np.int32)


def packed(found: np.ndarray, buckets: int) -> bytes:
    """Distinct buckets as numbers or as bits, whichever is shorter: never over ``buckets`` / 8 bytes."""
    if 4 * len(found) < buckets // 8:
        return found.tobytes()
    bits = np.zeros(buckets, bool)
    bits[found] = True
    return np.packbits(bits).tobytes()


def unpacked(data: bytes, buckets: int) -> np.ndarray:
    if len(data) < buckets // 8:
        return np.frombuffer(data, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))).astype(np.int32)


@dataclass
class Model:
    """``weights`` include the log-count ratios; margins go through a logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum()) / max(1, len(found)) ** 0.5 + self.bias

    def score(self, found: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray, buckets: int) -> np.ndarray:
    """log of (share of the n-gram among good texts) / (among the others), each count increased by 1."""
    counts = [np.ones(buckets), np.ones(buckets)]
    for found, y in zip(rows, good, strict=True):
        counts[int(y)][found] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], good: np.ndarray, ratios: np.ndarray, cost: float = 1.0, rounds: int = 30, tolerance: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model; the classes' costs balance their sizes."""
    y = np.where(good, 1.0, -1.0)
    costs = np.where(good, cost * len(y) / (2 * max(1, good.sum())), cost * len(y) / (2 * max(1, (~good).sum())))
    values = [(ratios[x] / max(1, len(x)) ** 0.5) for x in rows]
    norms = np.array([v @ v + 1 for v in values])
    alpha, weights, bias = np.zeros(len(y)), np.zeros(len(ratios)), 0.0
    order, random = np.arange(len(y)), np.random.default_rng(0)
    for _ in range(rounds):
        random.shuffle(order)
        worst = 0.0
        for i in order:
            gradient = y[i] * (weights[rows[i]] @ values[i] + bias) - 1
            now = min(max(alpha[i] - gradient / norms[i], 0.0), costs[i])
            step = now - alpha[i]
            if step:
                weights[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
                alpha[i] = now
                worst = max(worst, abs(step) * norms[i])
        if worst < tolerance:
            break
    return weights, bias


def logistic_curve(margins: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the curve that fits the margins best, with smoothed targets, by Newton steps."""
    up, down = good.sum(), (~good).sum()
    target = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    at = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones(len(margins))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        gradient = x @ (p - target) + 1e-3 * at
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), gradient)
        at = at - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def fitted(rows: list[np.ndarray], good: np.ndarray, fifth: np.ndarray, buckets: int = BUCKETS) -> Model:
    """The model of labelled rows; without both classes, one that gives their smoothed share to every text."""
    if good.all() or not good.any():
        share = (good.sum() + 1) / (len(good) + 2)
        return Model(np.zeros(buckets), 0.0, 0.0, float(np.log(share / (1 - share))))
    curve = fifth < CURVE_FIFTHS
    if len(set(good[~curve])) < 2 or len(set(good[curve])) < 2:
        curve = np.zeros(len(good), bool)
    inner = [x for x, c in zip(rows, curve, strict=True) if not c]
    ratios = log_count_ratios(inner, good[~curve], buckets)
    weights, bias = dual_coordinate_descent(inner, good[~curve], ratios)
    model = Model(weights * ratios, bias, 1.0, 0.0)
    use = curve if curve.any() else ~curve
    margins = np.array([model.margin(x) for x, c in zip(rows, use, strict=True) if c])
    model.slope, model.shift = logistic_curve(margins, good[use])
    return model


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows that are not held out: those with the least hashes of doc_id.

    ``labels`` has doc_id and quality (0 or 1); ids with contradicting labels or
    none are left out. What reaches the driver is at most ``buckets`` / 8 bytes a row.
    """
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    one = one.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    chosen = one.where("quality = most").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", "quality")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for batch in batches:
            made = [packed(features.of(text), buckets) for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(made, pa.binary())], names=["doc_id", "quality", "features"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.join(F.broadcast(chosen), "doc_id")  # sample_rows ids at most
    found = known.mapInArrow(featured, "doc_id long, quality int, features binary")
    found = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("features").alias("features")).orderBy("doc_id")
    table = found.select("doc_id", "quality", "features").toArrow()
    rows = [unpacked(x.as_py(), buckets) for x in table.column("features")]
    good = table.column("quality").to_numpy().astype(bool) if len(rows) else np.zeros(0, bool)
    fifth = np.arange(len(rows)) * 2654435761 % 5
    return fitted(rows, good, fifth, buckets)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, ``ROW_ID``.

    Texts that are null or empty have no n-gram and get the score of the bias.
    A null doc_id is never held out. Only the text is looked at.
    """
    bounded_batches(docs.sparkSession)
    rows = with_row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    model.weights = model.weights.astype(np.float32)
    buckets = len(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes a bucket

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for batch in batches:
            made = [shared.value.score(features.of(text)) for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.float64()), *[batch.column(c) for c in ROW_ID]], names=["doc_id", "score", *ROW_ID])

    found = rows.mapInArrow(scored, f"doc_id long, score double, {ROW_ID[0]} long, {ROW_ID[1]} long")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *ROW_ID)
