"""SimHash near-duplicates over vantage-point trees.

Fingerprints are taken from word shingles and made distinct. A vantage-point
tree over a bounded sample of them shards all by Hamming distance: a
fingerprint lives in one shard and visits every other shard that its ball of
``radius`` bits reaches by the triangle bound (only shards before its own, as
one of the two ways of a pair will do). In each shard a second tree prunes the
same way and finds the exact pairs; a shard hands on its groups as stars, never
all pairs. Stars are joined to components.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other. Rows with a null id get a
component but give it no name. Repeated rows are copies. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import stars
from .shared import counted, ship, stored


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit majority of the hashes of the word shingles, repeats included."""
    import xxhash

    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for low in range(0, len(h), 1 << 15):
        ones += np.add.reduce(np.unpackbits(h[low : low + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words, seed) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(made, "doc_id long, fp long")


def vantage(points: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 12) -> tuple[np.uint64, int] | None:
    """A vantage point and a distance that part the points, neither side under a quarter if possible, with the least mass near the border."""
    best = None
    probe = points if len(points) <= 4096 else rng.choice(points, 4096, replace=False)
    for v in rng.choice(points, min(tries, len(points)), replace=False):
        at = np.bincount(np.bitwise_count(probe ^ v), minlength=65)
        inside = np.cumsum(at)
        for mu in range(64):
            share = inside[mu] / len(probe)
            if 0 < share < 1:
                near = (inside[min(64, mu + radius)] - (inside[mu - radius] if mu >= radius else 0)) / len(probe)
                rank = (not 0.25 <= share <= 0.75, near + abs(share - 0.5) / 4)
                if best is None or rank < best[0]:
                    best = (rank, v, mu)
    return best and (best[1], best[2])


def build_tree(sample: np.ndarray, leaves: int, radius: int, seed: int = 3) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, distance, inside child, outside child); children below zero are leaves, -1 - leaf."""
    rng, nodes, made = np.random.default_rng(seed), [], [0]

    def grow(points: np.ndarray, want: int) -> int:
        found = vantage(points, radius, rng) if want > 1 and len(points) > 32 else None
        if found is None:
            made[0] += 1
            return -made[0]
        v, mu = found
        inside = np.bitwise_count(points ^ v) <= mu
        k = len(nodes)
        nodes.append(None)
        left = max(1, min(want - 1, round(want * float(inside.mean()))))
        nodes[k] = (int(v), mu, grow(points[inside], left), grow(points[~inside], want - left))
        return k

    grow(np.unique(sample), leaves)
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf reached: its number, the indices of the points that live there, and of those that visit."""
    if not nodes:
        return [(0, np.arange(len(points)), np.zeros(0, np.int64))]
    out = []

    def go(k: int, at: np.ndarray, lives: np.ndarray) -> None:
        if not len(at):
            return
        if k < 0:
            out.append((-1 - k, at[lives], at[~lives]))
            return
        v, mu, inside, outside = nodes[k]
        d = np.bitwise_count(points[at] ^ np.uint64(v)).astype(np.int64)
        near, far = d - radius <= mu, d + radius > mu
        go(inside, at[near], (lives & (d <= mu))[near])
        go(outside, at[far], (lives & (d > mu))[far])

    go(0, np.arange(len(points)), np.ones(len(points), bool))
    return out


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n nodes and edges a-b, the smallest node of each one's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def shard_stars(fp: np.ndarray, lives: np.ndarray, radius: int, *, leaf: int = 64, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) that join what is within ``radius`` bits of a point that lives here."""
    rng, n = np.random.default_rng(seed), len(fp)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = [0]

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            found.append((a, b))
            held[0] += len(a)
        if held[0] > 2_000_000:  # many pairs become one star a group
            root = local_roots(n, np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
            tied = np.flatnonzero(root != np.arange(n))
            found[:] = [(tied, root[tied])]
            held[0] = len(tied)

    def brute(home: np.ndarray, ask: np.ndarray) -> None:
        for h in range(0, len(home), 1024):
            block = home[h : h + 1024]
            rows = max(1, (1 << 20) // len(block))
            for low in range(0, len(ask), rows):
                q = ask[low : low + rows]
                i, j = np.nonzero(np.bitwise_count(fp[q][:, None] ^ fp[block][None, :]) <= radius)
                other = q[i] != block[j]
                keep(q[i][other], block[j][other])

    todo = [(np.flatnonzero(lives), np.arange(n))]
    while todo:
        home, ask = todo.pop()
        if not len(home) or not len(ask):
            continue
        part = vantage(fp[home], radius, rng, 4) if len(home) > leaf else None
        if part is None:
            brute(home, ask)
            continue
        v, mu = part
        dh, dq = np.bitwise_count(fp[home] ^ v), np.bitwise_count(fp[ask] ^ v).astype(np.int64)
        todo.append((home[dh <= mu], ask[dq - radius <= mu]))
        todo.append((home[dh > mu], ask[dq + radius > mu]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = local_roots(n, np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
    tied = np.flatnonzero(root != np.arange(n))
    return tied, root[tied]


def link(fps: DataFrame, *, radius: int = 2, shard_rows: int = 32_768, sample_rows: int = 1 << 20, seed: int = 3) -> DataFrame:
    """Stars (u, v) over the distinct fingerprints in ``fps`` (column fp), v the smallest of a component.

    The driver gets 64 fingerprints a shard, ``sample_rows`` at most, to build
    the tree of shards; they only decide where shards end. Beyond
    ``sample_rows`` / 64 shards (half a billion fingerprints) shards grow; a
    shard holds 9 bytes a fingerprint and is searched by a tree of its own.
    """
    spark = fps.sparkSession
    total = counted(fps)
    leaves = max(1, min(-(-total // shard_rows), sample_rows // 64))
    cut = int((1 << 30) * min(1.0, 64 * leaves / max(1, total)))
    sample = fps.filter(F.pmod(F.xxhash64(F.lit(seed), "fp"), F.lit(1 << 30)) < cut)
    nodes = build_tree(sample.toArrow().column("fp").to_numpy().view(np.uint64), leaves, radius) if leaves > 1 else []
    held = spark.sparkContext.broadcast(nodes)  # under sample_rows / 64 entries

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column("fp").to_numpy().view(np.uint64)
            reached = route(points, held.value, radius)
            home = np.zeros(len(points), np.int64)
            for leaf, lives, _ in reached:
                home[lives] = leaf
            for leaf, lives, visits in reached:
                visits = visits[home[visits] > leaf]
                both = np.concatenate((lives, visits))
                if len(both):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(both), leaf)), pa.array(points[both].view(np.int64)), pa.array(np.arange(len(both)) < len(lives))], ["shard", "fp", "lives"]
                    )

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy().view(np.uint64)
        a, b = shard_stars(fp, rows["lives"].to_numpy(bool), radius)
        return pd.DataFrame({"u": fp[a].view(np.int64), "v": fp[b].view(np.int64)})

    shards = fps.select("fp").mapInArrow(routed, "shard long, fp long, lives boolean")
    return stars(shards.groupBy("shard").applyInPandas(joined, "u long, v long"))


def classes(docs: DataFrame, *, words: int = 3, radius: int = 2, **options) -> DataFrame:
    """doc_id, ``fp`` and ``component_id``, the smallest id among the documents linked with this one, itself included."""
    made = stored(fingerprints(docs, words=words), "fingerprints")
    named = stored(made.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    tied = link(named.select("fp"), radius=radius, **options)
    rooted = named.join(tied, F.col("fp") == F.col("u"), "left").select("fp", "least_id", F.coalesce("v", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = rooted.join(least, "root").select(F.col("fp").alias("k"), "component_id")
    return made.join(by_fp, F.col("fp") == F.col("k")).drop("k")


ship(__name__)
