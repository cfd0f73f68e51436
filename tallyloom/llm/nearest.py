"""Nearest neighbours by a block matrix join, and exact top-k over binary codes.

Block matrix join: vectors are quantised once, to int8 with a scale each, and
travel in that form. The product of two tiles gives all distances between
quantised vectors, and the norms of what was rounded off bound the error
(triangle inequality). (The product of int8 values runs in 32-bit floats, which
hold it exactly up to 1,040 components, then in 64-bit ones: numpy has no
faster integer product.) What the bounds of a task can't rule out is kept; what
the bounds of all tasks can't rule out is fetched by id, computed in double
precision and ranked.

Multi-index hashing: a block of codes is indexed once by the values of m segments
of about log2(codes) bits. Segment radii grow one segment at a time, until the
kth verified distance, or that known from earlier blocks, is covered: with radius
r in the first a segments and r - 1 in the others, all codes up to distance
m * r + a - 1 have been met.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part; vectors meet those of their own dimension. Rows that
repeat an id count once, by the nearest of them. A repeated query id asks with
its smallest vector (code). Ties go to the smaller id; fewer candidates than k
give all of them. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import blocks, sweep
from .shared import discard, ship, small, stored

#: Numbers in a tile of distances.
TILE = 1 << 20


def sound(vector: str) -> Column:
    """True for vectors that take part."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _rows(vectors: DataFrame) -> DataFrame:
    """(id, body of doubles, kind: the dimension) of vectors (id, v)."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.array(v, "<f8") for v in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array([len(v) for v in raw], pa.int32())], ["id", "body", "kind"])

    return vectors.select("id", "v").mapInArrow(body, "id long, body binary, kind int")


FIELDS = ["values", "scale", "norm", "rest"]


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, norm of scale * values, and norm of the rest, of each row."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt((back * back).sum(1)), np.sqrt(((x - back) ** 2).sum(1))


def _make(kind: int, bodies: bytes) -> list[bytes]:
    with np.errstate(all="ignore"):
        return [a.tobytes() for a in quantised(np.frombuffer(bodies, "<f8").reshape(-1, kind))]


def _arrays(block: dict) -> tuple[np.ndarray, ...]:
    rest = (np.frombuffer(block[f], "<f8") for f in FIELDS[1:])
    return np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["values"], np.int8).reshape(-1, block["kind"]), *rest


def bounds(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of each row of y (below) from each row of x (beside)."""
    _, qx, sx, nx, ex = x
    _, qy, sy, ny, ey = y
    exact = np.float32 if qx.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (qy.astype(exact) @ qx.astype(exact).T).astype(np.float64)
    with np.errstate(all="ignore"):
        near = np.sqrt(np.maximum(ny[:, None] ** 2 + nx[None, :] ** 2 - 2 * sy[:, None] * sx[None, :] * product, 0))
        err = ey[:, None] + ex[None, :] + 1e-7 * (ny[:, None] + nx[None, :])
        known = np.isfinite(near + err)
        return np.where(known, near - err, 0.0), np.where(known, near + err, np.inf)


class Kept:
    """What can still be among the k nearest of n queries, an id once."""

    def __init__(self, k: int, n: int):
        self.k, self.kth = k, np.full(n, np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.most = 0, 4 * k * n + (1 << 20)

    def add(self, q: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.parts.append((q, ids, low, high))
        self.size += len(q)
        if self.size > self.most:
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        q, ids, low, high = (np.concatenate(c) for c in zip(*self.parts))
        by = np.lexsort((ids, q))
        q, ids, low, high = q[by], ids[by], low[by], high[by]
        new = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]))) if len(q) else np.zeros(0, np.int64)
        if len(new):
            q, ids, low, high = q[new], ids[new], np.minimum.reduceat(low, new), np.minimum.reduceat(high, new)
        by = np.lexsort((high, q))
        q, ids, low, high = q[by], ids[by], low[by], high[by]
        last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1)
        self.kth[q[last]] = np.minimum(self.kth[q[last]], high[last])
        keep = low <= self.kth[q]
        self.parts = [(q[keep], ids[keep], low[keep], high[keep])]
        self.size = int(keep.sum())
        return self.parts[0]


BOUNDED = "query_id long, vec_id long, low double, high double"


def _search(k: int):
    def search(candidates: Iterator[dict], asked: list[dict]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[tuple[np.ndarray, ...], Kept]] = {}
        for kind in {a["kind"] for a in asked}:
            y = tuple(np.concatenate(c) for c in zip(*(_arrays(a) for a in asked if a["kind"] == kind)))
            held[kind] = y, Kept(k, len(y[0]))
        for block in candidates:
            if block["kind"] not in held:
                continue
            (y, kept), x = held[block["kind"]], _arrays(block)
            alone = len(np.unique(x[0])) == len(x[0])
            rows = max(1, TILE // len(x[0]))
            for at in range(0, len(y[0]), rows):
                part = tuple(c[at : at + rows] for c in y)
                low, high = bounds(x, part)
                own = part[0][:, None] == x[0][None, :]
                low[own], high[own] = np.inf, np.inf
                limit = kept.kth[at : at + rows]
                if alone and high.shape[1] >= k:  # k other ids lie within the kth greatest distance
                    limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
                    kept.kth[at : at + rows] = limit
                i, j = np.nonzero((low <= limit[:, None]) & ~own)
                kept.add(i + at, x[0][j], low[i, j], high[i, j])
        for y, kept in held.values():
            q, ids, low, high = kept.prune()
            for at in range(0, len(q), 500_000):
                cut = slice(at, at + 500_000)
                yield pa.RecordBatch.from_arrays([pa.array(y[0][q[cut]]), pa.array(ids[cut]), pa.array(low[cut]), pa.array(high[cut])], ["query_id", "vec_id", "low", "high"])

    return search


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, block_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by Euclidean distance of each row whose id ``every`` divides."""
    part = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & sound("v"))
    asked = stored(part.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), "asked")
    q = blocks(_rows(asked), "query_blocks", FIELDS, _make, block_rows=block_rows)
    c = blocks(_rows(part), "candidate_blocks", FIELDS, _make, block_rows=block_rows)
    found = sweep(c, q, _search(k), BOUNDED)
    each = found.groupBy("query_id", "vec_id").agg(F.min("low").alias("low"), F.min("high").alias("high"))
    order = Window.partitionBy("query_id").orderBy("high", "vec_id")
    kth = F.min(F.when(F.col("n") == k, F.col("high"))).over(Window.partitionBy("query_id"))
    may = stored(each.withColumn("n", F.row_number().over(order)).withColumn("kth", kth).filter(F.col("kth").isNull() | (F.col("low") <= F.col("kth"))).select("query_id", "vec_id"), "may")
    discard(q, c)
    # The vectors of what is left, in double precision.
    wanted = small(may.select(F.col("vec_id").alias("id")).distinct())
    held = part.join(wanted, "id", "left_semi").select(F.col("id").alias("vec_id"), F.col("v").cast("array<double>").alias("x"))
    pairs = may.join(asked.select(F.col("id").alias("query_id"), F.col("v").cast("array<double>").alias("y")), "query_id").join(held, "vec_id").filter(F.size("x") == F.size("y"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec_id"), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

    return ranked(pairs.select("query_id", "vec_id", "x", "y").mapInArrow(score, FOUND), k)


FOUND = "query_id long, vec_id long, score double"


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k first by score and id of each query; an id counts once."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sign_codes(vectors: DataFrame) -> DataFrame:
    """(id, code, kind) of vectors (id, v): bit i of the code, from its first byte on, is set where component i is above zero; kind: the number of bits."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").to_pylist()
            codes = [np.packbits(np.array(x, float) > 0, bitorder="little").tobytes() for x in v]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(codes, pa.binary()), pa.array(list(map(len, v)), pa.int32())], ["id", "code", "kind"])

    return vectors.select("id", "v").mapInArrow(made, "id long, code binary, kind int")


def _bits(codes: bytes, kind: int) -> np.ndarray:
    """A row of ``kind`` zeros and ones a code."""
    return np.unpackbits(np.frombuffer(codes, np.uint8).reshape(-1, -(-kind // 8)), axis=1, count=kind, bitorder="little")


def _words(bits: np.ndarray) -> np.ndarray:
    whole = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    whole[:, : bits.shape[1]] = bits
    return np.packbits(whole, axis=1, bitorder="little").view(np.uint64)


class MultiIndex:
    """Segment tables over a block of codes, given as rows of bits."""

    def __init__(self, bits: np.ndarray, ids: np.ndarray):
        self.words, self.ids = _words(bits), ids
        wide = max(1, min(16, round(np.log2(max(2, len(bits))))))
        self.m = -(-bits.shape[1] // wide)
        edges = np.linspace(0, bits.shape[1], self.m + 1).round().astype(int)
        self.segments = []
        for low, high in zip(edges[:-1], edges[1:]):
            values = self.value(bits, low, high)
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange((1 << (high - low)) + 1))
            self.segments.append((int(low), int(high), order, starts))

    @staticmethod
    def value(bits: np.ndarray, low: int, high: int) -> np.ndarray:
        return bits[:, low:high].astype(np.int64) @ (1 << np.arange(high - low, dtype=np.int64))

    def search(self, bits: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, code row, distance) of the k first codes by distance and id, exactly; codes farther than a query's ``limit`` may lack."""
        best = (np.zeros(0, np.int64),) * 3
        limit = np.full(len(bits), np.inf) if limit is None else limit
        q, active = _words(bits), np.arange(len(bits))
        for r in range(max(high - low for low, high, *_ in self.segments) + 1):
            for a, (low, high, order, starts) in enumerate(self.segments):
                if r <= high - low:
                    flips = np.array([sum(1 << b for b in c) for c in combinations(range(high - low), r)], np.int64)
                    best = self._met(best, q, active, self.value(bits[active], low, high), flips, order, starts, k)
                count = np.bincount(best[0], minlength=len(q))
                worst = np.zeros(len(q))
                np.maximum.at(worst, best[0], best[2])
                open_ = np.where(count >= k, worst, np.where(count >= len(self.ids), -1, np.inf))
                active = np.flatnonzero(np.minimum(open_, limit) > self.m * r + a)
                if not len(active):
                    return best
        return best

    def _met(self, best, q, active, value, flips, order, starts, k):
        rows = max(1, TILE // max(1, len(flips)))
        for low in range(0, len(active), rows):
            own, keys = active[low : low + rows], (value[low : low + rows, None] ^ flips[None, :]).ravel()
            begin, size = starts[keys], starts[keys + 1] - starts[keys]
            asks = np.repeat(np.repeat(own, len(flips)), size)
            at = order[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(asks))] if len(asks) else np.zeros(0, np.int64)
            dist = np.bitwise_count(self.words[at] ^ q[asks]).sum(1, dtype=np.int64)
            best = first_k(*(np.concatenate(x) for x in zip(best, (asks, at, dist))), self.ids, k)
        return best


def first_k(i: np.ndarray, c: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each i by distance, then id; a code met again counts once."""
    by = np.lexsort((c, ids[c], d, i))
    i, c, d = i[by], c[by], d[by]
    new = np.ones(len(i), bool)  # a code met in several segments stands in a row
    new[1:] = (i[1:] != i[:-1]) | (c[1:] != c[:-1])
    i, c, d = i[new], c[new], d[new]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], c[place < k], d[place < k]


def _make_codes(kind: int, bodies: bytes) -> list[bytes]:
    each = np.frombuffer(bodies, np.uint8).reshape(-1, 8 + -(-kind // 8))
    return [each[:, :8].tobytes(), each[:, 8:].tobytes()]


def _code_search(k: int):
    def search(candidates: Iterator[dict], asked: list[dict]) -> Iterator[pa.RecordBatch]:
        held, none = {}, np.zeros(0, np.int64)
        for kind in {a["kind"] for a in asked}:
            own = [a for a in asked if a["kind"] == kind]
            ids = np.concatenate([np.frombuffer(a["ids"], "<i8") for a in own])
            held[kind] = [ids, np.concatenate([_bits(a["codes"], kind) for a in own]), np.full(len(ids), np.inf), (none, none, none, none)]
        for block in candidates:
            if block["kind"] not in held:
                continue
            state, entry, first = held[block["kind"]], np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["firsts"], ">i8").astype(np.int64)
            i, c, d = MultiIndex(_bits(block["codes"], block["kind"]), first).search(state[1], k, state[2])
            i, f, e, d = (np.concatenate(x) for x in zip(state[3], (i, first[c], entry[c], d)))
            by = np.lexsort((e, f, d, i))
            i, f, e, d = i[by], f[by], e[by], d[by]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            last = place == k - 1
            state[2][i[last]] = d[last]
            state[3] = tuple(x[place < k] for x in (i, f, e, d))
        for ids, _, _, (i, _, e, d) in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(e), pa.array(d.astype(np.float64))], ["query_id", "vec_id", "score"])

    return search


def nearest_codes(codes: DataFrame, *, every: int = 50, k: int = 10, block_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score (bits that differ): exact top k of (id, code binary, kind) for each id that ``every`` divides.

    Copies of a code stand as one entry with their k + 1 smallest ids, which
    is all that k results can show. Where rows repeat an id with other codes, as
    many times the entries are kept as one id has codes at most.
    """
    part = stored(codes.filter("id IS NOT NULL AND code IS NOT NULL").select("id", "code", "kind").distinct(), "codes")
    most = part.groupBy("id").count().agg(F.max("count")).first()[0] or 1
    wide = (k + 1) * most
    order = Window.partitionBy("code", "kind").orderBy("id")
    first = part.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    entries = stored(first.groupBy("code", "kind").agg(F.sort_array(F.collect_list("id")).alias("members")).withColumn("id", F.monotonically_increasing_id()), "entries")
    asked = part.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("kind", "code")).alias("c")).select("id", "c.code", "c.kind")
    # Ties between entries go by their smallest member, which travels with the code.
    rows = lambda d, first: d.select("id", F.concat(F.unhex(F.lpad(F.hex(first), F.lit(16), F.lit("0"))), "code").alias("body"), "kind")
    c = blocks(rows(entries, F.get("members", F.lit(0))), "candidate_blocks", ["firsts", "codes"], _make_codes, block_rows=block_rows)
    q = blocks(rows(asked, F.col("id")), "query_blocks", ["firsts", "codes"], _make_codes, block_rows=block_rows)
    found = sweep(c, q, _code_search(wide), FOUND)
    members = entries.select(F.col("id").alias("vec_id"), "members")
    whole = found.join(members, "vec_id").select("query_id", F.explode("members").alias("vec_id"), "score").filter("vec_id != query_id")
    return ranked(whole, k)


ship(__name__)
