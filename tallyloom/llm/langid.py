"""Language identification by character language models.

One interpolated Kneser-Ney model a language over letters (lower case) and
single spaces. The models lie side by side in one sorted array of 64-bit
n-gram hashes for each order, with a column of log probabilities a language;
a second sorted array for each order holds the back-off weights of contexts.
A text gets the language of the lowest cross-entropy a character. A best
cross-entropy above the limit, calibrated on texts kept out of the counts,
marks the text as rejected (like no learned language).

Only the fit is bounded (about ``max_docs`` texts a language, drawn by a hash
of the id); whole texts are scored.

Defined cases: null texts and texts without a letter are ``und`` with score
0 and not rejected; without any learned language all texts are ``und``. Ties
go to the language first in code point order. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, ship, stored, tidy

SPACE = 32
UNKNOWN = "und"
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)], bool)


def _is_letter(cp: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which code points are letters by Unicode category; ``low`` holds the answer below U+10000."""
    out = low[np.minimum(cp, 0xFFFF)]
    high = np.flatnonzero(cp >= 0x10000)
    if len(high):
        kinds, at = np.unique(cp[high], return_inverse=True)
        out[high] = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)[at]
    return out


def symbols(text: str, is_letter: np.ndarray) -> tuple[np.ndarray, int]:
    """Code points of the lower-cased letters, runs of others as one space, a space at both ends; and the number of letters."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter(cp, is_letter)
    cp = np.where(letter, cp, SPACE).astype(np.uint64)
    cp = np.concatenate(([SPACE], cp, [SPACE])).astype(np.uint64)
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != SPACE) | (cp[:-1] != SPACE)
    return cp[keep], int(letter.sum())


def gram_hashes(cp: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1 to ``order``, the hash of the n-gram that ends at each position from n - 1 on."""
    out = []
    for n in range(1, order + 1):
        if len(cp) < n:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.full(len(cp) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ cp[i : len(cp) - n + 1 + i]) * MIX_A
            h ^= h >> np.uint64(29)
        out.append((h * MIX_B) ^ (h >> np.uint64(31)))
    return out


def starts_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """First place of each leading ``bits`` of the sorted keys."""
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)


def places(keys: np.ndarray, starts: np.ndarray, deepest: int, bits: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the hashes stand in the sorted keys, and which of them do."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = starts[h >> np.uint64(64 - bits)]
    last = len(keys) - 1
    for _ in range(deepest):
        at = at + ((keys[np.minimum(at, last)] < h) & (at <= last))
    at = np.minimum(at, last)
    return at, keys[at] == h


@dataclass
class LanguageModels:
    """keys, logs: of each order the sorted n-gram hashes and log probabilities (a column a language); contexts, backs: the same for back-off weights; floor: log of an even share of the alphabet, one unknown symbol included; limits: of each language the highest cross-entropy that is not rejected."""

    langs: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backs: list[np.ndarray]
    floor: float
    limits: np.ndarray


class Scorer:
    def __init__(self, models: LanguageModels, bits: int = 18):
        self.m, self.bits, self.is_letter = models, bits, _letters()
        self.index = [self._index(k) for k in models.keys]
        self.back_index = [self._index(k) for k in models.contexts]

    def _index(self, keys: np.ndarray) -> tuple[np.ndarray, int]:
        starts = starts_of(keys, self.bits)
        sizes = np.diff(np.append(starts, len(keys)))
        return starts, int(sizes.max(initial=0))

    def _logs(self, grams: list[np.ndarray], n: int, where: np.ndarray) -> np.ndarray:
        """Log probabilities at end positions ``where`` (indices into the symbols) with contexts of n - 1 symbols."""
        m = self.m
        if n == 0:
            return np.full((len(where), len(m.langs)), m.floor)
        h = grams[n - 1][where - (n - 1)]
        at, hit = places(m.keys[n - 1], *self.index[n - 1], self.bits, h)
        out = m.logs[n - 1][at] if len(m.keys[n - 1]) else np.zeros((len(where), len(m.langs)), np.float32)
        if not hit.all():
            miss = np.flatnonzero(~hit)
            rest = self._logs(grams, n - 1, where[miss])
            if n > 1:
                c = grams[n - 2][where[miss] - (n - 1)]
                at, known = places(m.contexts[n - 1], *self.back_index[n - 1], self.bits, c)
                if len(m.contexts[n - 1]):
                    rest = rest + np.where(known[:, None], m.backs[n - 1][at], 0)
            elif len(m.backs[0]):
                rest = rest + m.backs[0][0]
            out[miss] = rest
        return out

    def entropy(self, text: str | None) -> tuple[np.ndarray, int] | None:
        """Cross-entropy a symbol under each language and the number of symbols; None without a letter."""
        if not text or not self.m.langs:
            return None
        cp, letters = symbols(text, self.is_letter)
        if not letters:
            return None
        order, total = len(self.m.keys), np.zeros(len(self.m.langs))
        step = 1 << 16  # very long texts go through in parts that overlap by the context
        for low in range(1, len(cp), step):
            begin = max(0, low - order + 1)
            part = cp[begin : low + step]
            grams = gram_hashes(part, order)
            ends = np.arange(low - begin, len(part))
            early = ends < order - 1
            for e in ends[early]:
                total += self._logs(grams, int(e) + 1, np.array([e]))[0]
            if (~early).any():
                total += self._logs(grams, order, ends[~early]).sum(0, dtype=np.float64)
        return -total / (len(cp) - 1), len(cp) - 1

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """Language, posterior from 0 to 1, cross-entropy and whether it is rejected."""
        found = self.entropy(text)
        if found is None:
            return UNKNOWN, 0.0, None, False
        each, n = found
        best = int(np.argmin(each))
        odds = np.exp(np.clip((each[best] - each) * min(n, 30), -700, 0))
        return self.m.langs[best], float(1 / odds.sum()), float(each[best]), bool(each[best] > self.m.limits[best])


Counts = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _look(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the hashes stand in sorted keys, and which of them do."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def weights_of(counts: Counts, n: int) -> np.ndarray:
    """Of the n-grams of a language: occurrences in the highest order, below it how many symbols come before (1 where none does)."""
    if n == len(counts):
        return counts[n - 1][3]
    before, kinds = np.unique(counts[n][2], return_counts=True)
    at, hit = _look(before, counts[n - 1][0])
    return np.where(hit, kinds[at] if len(kinds) else 1, 1)


def discount(weights: np.ndarray) -> float:
    """n1 / (n1 + 2 n2) over all n-grams of an order; 1/2 where no n-gram has a weight of 1."""
    once, twice = int((weights == 1).sum()), int((weights == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def kneser_ney(counts: dict[str, Counts], order: int) -> LanguageModels:
    """Interpolated models of one discount an order, from all counts: of each language and order the sorted n-gram hashes with context hash, hash without the first symbol, and count."""
    langs = sorted(counts)
    alphabet = len(np.unique(np.concatenate([counts[x][0][0] for x in langs]))) if langs else 0
    floor = float(np.log(1 / (alphabet + 1)))
    keys, logs, contexts, backs = [], [], [], []
    for n in range(1, order + 1):
        own = [counts[x][n - 1] for x in langs]
        grams, first = np.unique(np.concatenate([g[0] for g in own]), return_index=True)
        ctx, rest = (np.concatenate([g[k] for g in own])[first] for k in (1, 2))
        held = np.unique(np.concatenate([g[1] for g in own]))
        table, weights = np.empty((len(grams), len(langs))), np.zeros((len(held), len(langs)))
        lower = np.full((len(grams), len(langs)), floor)
        if n > 1:
            at, hit = _look(keys[-1], rest)
            lower[hit] = logs[-1][at[hit]]
        for j, g in enumerate(own):
            weight = weights_of(counts[langs[j]], n)
            off = discount(weight)
            at = np.searchsorted(held, g[1])
            total = np.bincount(at, weight, minlength=len(held))
            kinds = np.bincount(at, minlength=len(held))
            lam = np.where(total > 0, off * kinds / np.maximum(total, 1), 1.0)
            seen = np.zeros(len(grams))
            seen[np.searchsorted(grams, g[0])] = np.maximum(weight - off, 0) / total[at]
            table[:, j] = np.log(seen + lam[np.searchsorted(held, ctx)] * np.exp(lower[:, j]))
            weights[:, j] = np.log(lam)
        keys.append(grams)
        logs.append(table)
        contexts.append(held)  # in the first order only the empty context
        backs.append(weights.astype(np.float32))
    return LanguageModels(langs, keys, [t.astype(np.float32) for t in logs], contexts, backs, floor, np.full(len(langs), np.inf))


def count_grams(texts: list[str | None], order: int, is_letter: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order the distinct n-gram hashes with context hash, hash without the first symbol, and count."""
    found: list[list[np.ndarray]] = [[] for _ in range(order)]
    for t in texts:
        if not t:
            continue
        cp, letters = symbols(t, is_letter)
        if not letters:
            continue
        g = gram_hashes(cp, order)
        for n in range(1, order + 1):
            if len(g[n - 1]):
                skip = 1 if n == 1 else 0  # the opening space is a context only
                whole = g[n - 1][skip:]
                ctx = g[n - 2][: len(whole)] if n > 1 else np.zeros(len(whole), np.uint64)
                rest = g[n - 2][1 : 1 + len(whole)] if n > 1 else np.zeros(len(whole), np.uint64)
                found[n - 1].append(np.stack((whole, ctx, rest)))
    out = []
    for parts in found:
        if not parts:
            out.append((np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int64),))
            continue
        rows = np.concatenate(parts, axis=1)
        h, first, count = np.unique(rows[0], return_index=True, return_counts=True)
        out.append((h, rows[1][first], rows[2][first], count))
    return out


def fit(docs: DataFrame, *, order: int = 4, max_docs: int = 1500, parts: int = 4, held: int = 2, reject: float = 0.999, seed: int = 5) -> LanguageModels:
    """Fit on about ``max_docs`` texts a language outside the held-out fold; every tenth of them calibrates the rejection.

    ``max_docs`` bounds the texts that are counted; all their n-grams are kept.
    A language of under ten texts has none to calibrate on and rejects nothing.
    """
    from .quality import fold_of

    known = docs.select(F.col("doc_id").alias("d"), F.col("lang").alias("l"), F.col("text").alias("t")).filter(F.col("l").isNotNull() & F.col("t").isNotNull() & (F.coalesce(fold_of("d", parts), F.lit(-1)) != held))
    with tidy(docs.sparkSession):
        sizes = {r[0]: r[1] for r in known.groupBy("l").count().collect()}
    if not sizes:
        return LanguageModels([], [], [], [], [], 0.0, np.zeros(0))
    chosen = F.pmod(F.xxhash64(F.lit(seed), "d"), F.lit(1 << 30))
    limit = F.coalesce(*(F.when(F.col("l") == x, F.lit(int((1 << 30) * min(1.0, max_docs / n)))) for x, n in sizes.items()), F.lit(0))
    drawn = known.filter(chosen < limit).withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64(F.lit(seed + 1), "d"), F.xxhash64("t"))))
    sample = stored(drawn.withColumn("tune", F.col("r") % 10 == 0).drop("r"), "language_sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = _letters()
        for b in batches:
            by: dict[str, list] = {}
            for lang, text in zip(b.column("l").to_pylist(), b.column("t").to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for n, (h, ctx, rest, c) in enumerate(count_grams(texts, order, is_letter), 1):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(np.full(len(h), n)), *(pa.array(x.view(np.int64)) for x in (h, ctx, rest)), pa.array(c)], ["l", "n", "h", "ctx", "rest", "c"])

    parts_ = max(1, min(64, sum(min(n, max_docs) for n in sizes.values()) // 100))
    grams = sample.filter(~F.col("tune")).select("l", "t").repartition(parts_).mapInArrow(count, "l string, n long, h long, ctx long, rest long, c long")
    with tidy(docs.sparkSession):
        got = grams.groupBy("l", "n", "h", "ctx", "rest").agg(F.sum("c").alias("c")).toArrow()
    langs, n = np.array(got.column("l").to_pylist(), object), got.column("n").to_numpy()
    h, ctx, rest = (got.column(k).to_numpy().view(np.uint64) for k in ("h", "ctx", "rest"))
    c = got.column("c").to_numpy()
    counts: dict[str, Counts] = {}
    for x in sorted(set(langs.tolist())):
        counts[x] = []
        for k in range(1, order + 1):
            own = np.flatnonzero((langs == x) & (n == k))
            own = own[np.argsort(h[own])]
            counts[x].append((h[own], ctx[own], rest[own], c[own]))
    models = kneser_ney(counts, order)
    if not models.langs:
        discard(sample)
        return models
    sent = docs.sparkSession.sparkContext.broadcast(astuple(models))

    def tuned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(LanguageModels(*sent.value))
        for b in batches:
            rows = [(x, float(e[0][scorer.m.langs.index(x)])) for x, e in ((x, scorer.entropy(t)) for x, t in zip(b.column("l").to_pylist(), b.column("t").to_pylist())) if e and x in scorer.m.langs and e[1] >= 20]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["l", "e"])

    with tidy(docs.sparkSession):
        limits = {r[0]: r[1] * 1.1 for r in sample.filter("tune").select("l", "t").mapInArrow(tuned, "l string, e double").groupBy("l").agg(F.percentile("e", F.lit(reject))).collect()}
    discard(sample)
    models.limits = np.array([limits.get(x, np.inf) for x in models.langs])
    return models


def predict(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """doc_id with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``."""
    sent = docs.sparkSession.sparkContext.broadcast(astuple(models))  # bounded by the fit

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(LanguageModels(*sent.value))
        for b in batches:
            rows = [scorer.predict(t) for t in b.column("text").to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(scored, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


ship(__name__)
