"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A text becomes the set of its n-grams: words, word pairs, runs of repeated
words, and 4-grams of byte classes (letter case, digits, symbols, spaces).
Each indicator is scaled by the log-count ratio of the two classes; a linear
model with hinge loss is fitted by dual coordinate descent and its margin is
turned into a probability by a logistic fit on rows kept out of the descent.

Only the fit is bounded (``max_rows`` labelled rows, drawn by a hash of the
id); every text is scored whole.

Defined cases: a null text counts as empty; an empty text has one indicator
of its own. Repeated label rows of a document count once, the highest label
holding. Labels other than 0 and 1, null ids and null labels are not used.
Without labels of both classes the score is the share of ones among the
labels (1.0 where there are none). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import counted, free, ship, tidy

WORD_BITS = 22
WORD_DIM = 1 << WORD_BITS
CLASS_DIM = 1 << 16
EXTRA_DIM = 16
DIM = WORD_DIM + CLASS_DIM + EXTRA_DIM
EMPTY_ID = WORD_DIM + CLASS_DIM


def _byte_classes() -> np.ndarray:
    of = np.full(256, 12, np.uint8)
    for code, chars in enumerate(
        (b" \t\x0b\x0c\r", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b".,;:", b"|", b"$%#*&", b"@^~=+<>\\/_", b"'\"()[]{}-`")
    ):
        of[list(chars)] = code
    of[0x80:0xC0] = 11
    of[0xC0:] = 13
    return of


BYTE_CLASS = _byte_classes()
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
PLACE_CODE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
PAIR_CODE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes that are no white space)."""
    solid = classes > 1
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    within = raw[solid]
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = (np.arange(len(within)) - np.repeat(first, sizes)) & 63
    return _mixed(np.add.reduceat(BYTE_CODE[within] * PLACE_CODE[place], first))


def indicators(text: str | None) -> np.ndarray:
    """Sorted ids, without repeats, of the n-grams of a text."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    classes = BYTE_CLASS[raw]
    words = word_hashes(raw, classes)
    if not len(words):
        return np.array([EMPTY_ID], np.int64)
    wide = np.concatenate(([1], classes, [1, 1, 1])).astype(np.uint16)
    grams = (wide[:-3] << 12) | (wide[1:-2] << 8) | (wide[2:-1] << 4) | wide[3:]
    seen = np.zeros(CLASS_DIM, bool)
    seen[grams] = True
    pairs = _mixed(words[:-1] * PAIR_CODE + words[1:])
    shift = np.uint64(64 - WORD_BITS)
    hashed = np.unique(np.concatenate((words >> shift, pairs >> shift))).astype(np.int64)
    again, extra = words[1:] == words[:-1], []
    for run in (1, 2, 3, 4):
        if len(again) and again.any():
            extra.append(EMPTY_ID + run)
            again = again[1:] & again[:-1]
    return np.concatenate((hashed, WORD_DIM + np.flatnonzero(seen), np.array(extra, np.int64)))


@dataclass
class QualityModel:
    """weights: of each indicator (log-count ratio times coefficient); bias, slope, shift: margin and logistic map; constant: a fixed score where nothing was fitted."""

    weights: np.ndarray | None
    bias: float
    slope: float
    shift: float
    constant: float

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.constant
        ids = indicators(text)
        size = float(np.sqrt(max(1, len(ids))))
        z = self.slope * (float(self.weights[ids].sum()) / size + self.bias) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def descend(at: np.ndarray, ids: np.ndarray, values: np.ndarray, use: np.ndarray, y: np.ndarray, dim: int, c: float, epochs: int, seed: int) -> np.ndarray:
    """Dual coordinate descent for the linear hinge loss over the rows in ``use``; the last weight is the bias.

    Row i holds the indicators at[i] to at[i + 1] of ``ids`` and ``values``.
    """
    w, alpha = np.zeros(dim + 1), np.zeros(len(y))
    norm = np.add.reduceat(np.append(np.square(values, dtype=np.float64), 0), at[:-1]) * (np.diff(at) > 0) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(use):
            own, v = ids[at[i] : at[i + 1]], values[at[i] : at[i + 1]]
            grad = y[i] * (float(w[own] @ v) + w[dim]) - 1
            new = min(max(alpha[i] - grad / norm[i], 0.0), c)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[own] += (step * y[i]) * v
                w[dim] += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3 * c:
            break
    return w


def logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic map, by damped Newton steps on smoothed targets."""
    ones, zeros = label.sum(), len(label) - label.sum()
    goal = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        d, h = p - goal, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(d * margin).sum() + 1e-3 * a, d.sum()])
        m = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def fit_rows(ids: list[np.ndarray], label: np.ndarray, *, c: float = 1.0, epochs: int = 30, min_docs: int = 5, seed: int = 7) -> QualityModel:
    """Fit on sets of indicator ids; every fifth row is kept for the logistic map."""
    if not len(label) or label.min() == label.max():
        return QualityModel(None, 0.0, 1.0, 0.0, float(label.mean()) if len(label) else 1.0)
    fold = np.arange(len(label)) % 5 == 4
    if len(set(label[fold])) < 2 or len(set(label[~fold])) < 2:
        fold = np.zeros(len(label), bool)
    # Numbers of 32 bits in a few flat arrays: the driver holds all rows of the fit at once.
    counts = np.zeros((2, DIM), np.int32)
    for x, k, out in zip(ids, label, fold):
        if not out:
            counts[k][x] += 1
    kept = counts.sum(0) >= min(min_docs, max(1, len(label) // 20))
    ones, zeros = (label[~fold] == 1).sum(), (label[~fold] == 0).sum()
    ratio = (np.log((counts[1][kept] + 1) / (ones + 2)) - np.log((counts[0][kept] + 1) / (zeros + 2))).astype(np.float32)
    del counts
    dense = np.full(DIM, -1, np.int32)
    dense[kept] = np.arange(len(ratio), dtype=np.int32)
    known = [dense[x[kept[x]]] for x in ids]
    at = np.concatenate(([0], np.cumsum([len(x) for x in known])))
    scale = np.repeat(np.array([1 / np.sqrt(max(1, len(x))) for x in ids], np.float32), np.diff(at))
    flat = np.concatenate(known)
    values = ratio[flat] * scale
    del known, dense, scale
    y = np.where(label == 1, 1.0, -1.0)
    w = descend(at, flat, values, np.flatnonzero(~fold), y, len(ratio), c, epochs, seed)
    weights = np.zeros(DIM, np.float32)
    weights[kept] = ratio * w[:-1]
    held = np.flatnonzero(fold) if fold.any() else np.arange(len(label))
    margin = np.array([float(w[flat[at[i] : at[i + 1]]] @ values[at[i] : at[i + 1]]) + w[-1] for i in held])
    a, b = logistic(margin, label[held])
    return QualityModel(weights, float(w[-1]), a, b, 0.0)


def fold_of(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % parts


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 8000, folds: int = 5, held: int = 0, seed: int = 7) -> QualityModel:
    """Fit on at most about ``max_rows`` labelled rows outside the held-out fold.

    ``max_rows`` bounds what reaches the driver and what is broadcast; the
    rows are drawn by a hash of the id, alike on every run.
    """
    known = (
        labels.select(F.col("doc_id").alias("d"), F.col("quality").cast("int").alias("q"))
        .filter(F.col("d").isNotNull() & F.col("q").isin(0, 1) & (fold_of("d", folds) != held))
        .groupBy("d")
        .agg(F.max("q").alias("q"))
    )
    total = counted(known)
    cut = int((1 << 30) * min(1.0, max_rows / max(1, total)))
    drawn = known.filter(F.pmod(F.xxhash64(F.lit(seed), "d"), F.lit(1 << 30)) < cut)
    texts = docs.select(F.col("doc_id").alias("d"), F.col("text").alias("t"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [indicators(t).astype(np.int32).tobytes() for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("q"), pa.array(found, pa.binary())], ["d", "q", "x"])

    with tidy(docs.sparkSession):
        got = texts.join(F.broadcast(drawn), "d").select("d", "q", "t").mapInArrow(gather, "d long, q int, x binary").toArrow()
    rows = sorted(zip(got.column("d").to_pylist(), got.column("q").to_pylist(), got.column("x").to_pylist()), key=lambda r: (r[0], r[2]))
    del got
    pa.default_memory_pool().release_unused()
    ids = [np.frombuffer(x, np.int32) for _, _, x in rows]
    return fit_rows(ids, np.array([q for _, q, _ in rows], np.int64), seed=seed)


def added(docs: DataFrame) -> tuple[str, str]:
    """The columns that ``score`` adds; an input column of such a name stays, the new one gets an underscore more."""
    return free("quality_score", docs.columns), free("quality_predicted", docs.columns)


def score(docs: DataFrame, model: QualityModel, *, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with ``quality_score`` and ``quality_predicted`` (see ``added``)."""
    held = docs.sparkSession.sparkContext.broadcast(astuple(model))  # of fixed size: DIM weights

    @F.arrow_udf("double")
    def scored(t: pa.Array) -> pa.Array:
        m = QualityModel(*held.value)
        return pa.array([m.score(x) for x in t.to_pylist()], pa.float64())

    points, predicted = added(docs)
    return docs.withColumn(points, scored(F.col("text"))).withColumn(predicted, (F.col(points) >= threshold).cast("int"))


ship(__name__)
