"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A length in (C/(m+1), C/m] belongs to class m, of which m pieces fill one
sequence of capacity C. Documents may be cut, so a remainder is cut down to
the class tops C/m until a tail of at most ``tail`` tokens is left, which is a
class of its own. Every class then holds pieces of one length only, each of
its sequences takes the same number of pieces, and a piece's sequence and
offset follow from its index in the class. Workers number their pieces by
themselves; one small table of counts by worker and class gives each worker
its first index, so no token moves to be packed. The sequences left part full, one
a class at most, are merged first-fit.

Defined cases: a null text counts as empty; each document ends with
``end_id``, so an empty one is a piece of one token. Rows with a repeated or
null id are packed like any other. Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BATCH_BYTES, chunks, released, ship, stored

#: The letters and numbers among the first 256 code points, as the vocabulary's split pattern sees them.
LATIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_SPACES = "\t-\r \x85\xa0"
#: Code points that all Unicode versions of the last years put into the same categories.
SETTLED = "\x00-\u052f\u2000-\u2064\u20a0-\u20bd\u3040-\u3096\u30a0-\u30ff\u4e00-\u9fa5"

#: A table of counts of at most so many rows (three numbers each) is broadcast.
BROADCAST_ROWS = 1_000_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, worker long, place long"


def byte_letters() -> dict[int, int]:
    """The code point by which a byte-level vocabulary writes each byte: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in prints else next(rest) for b in range(256)}


def split_encoder(whole):
    """What gives the ids of one split: the tokenizer's model, where nothing but a change of bytes to letters stands before it, else the tokenizer."""
    from tokenizers import models, pre_tokenizers

    before = whole.pre_tokenizer
    if whole.normalizer is None and isinstance(before, pre_tokenizers.ByteLevel) and not before.add_prefix_space and isinstance(whole.model, models.BPE):
        letters, merged = byte_letters(), whole.model.tokenize
        return lambda split: [t.id for t in merged(split.encode("utf-8").decode("latin-1").translate(letters))]
    return lambda split: whole.encode(split, add_special_tokens=False).ids


class Known(dict):
    """Ids by split, as they are packed: short, joined at once. At most ``keep`` splits stay.

    A class of its own outside ``Tokens``: one made for each object would hold the tokenizer in a cycle, and a
    worker would keep those of its last tasks.
    """

    def __init__(self, encoded, keep: int):
        self.encoded, self.keep = encoded, keep

    def __missing__(self, split: str) -> bytes:
        found = self.encoded(split)
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(self) < self.keep:
            self[split] = ids
        return ids


class Tokens:
    """Ids that the tokenizer of a file gives a text.

    ``pattern`` is how the tokenizer cuts a text into splits. Where that runs here,
    ids of a split are looked up in a bounded table and come from the
    tokenizer's model where they are not there. Texts with an added token, or with a code
    point that Unicode versions may see differently, go to the tokenizer whole.
    """

    def __init__(self, path: str, pattern: str, keep: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        added = [t.content for t in whole.get_added_tokens_decoder().values()]
        encoded = split_encoder(whole)

        def one(text: str) -> list[int]:
            return whole.encode(text, add_special_tokens=False).ids

        self.one, self.known = one, Known(encoded, keep)
        unsettled = re.compile(f"[^{SETTLED}]").search
        self.apart = lambda text: any(a in text for a in added) or (not text.isascii() and unsettled(text) is not None)
        self.any_split = regex.compile(pattern).findall
        s, n, w = LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACES
        self.latin_split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{s}]+| ?[{n}]+| ?[^{w}{s}{n}]+|[{w}]+(?![^{w}])|[{w}]+").findall
        self.beyond_latin = re.compile(r"[^\x00-\xff]").search

    def __call__(self, text: str) -> np.ndarray:
        if self.apart(text):
            return np.array(self.one(text), np.uint32)
        splits = self.any_split(text) if not text.isascii() and self.beyond_latin(text) else self.latin_split(text)
        return np.frombuffer(b"".join(map(self.known.__getitem__, splits)), "<u4")


def lengths_of(count: int, capacity: int, tail: int) -> list[int]:
    """Lengths of the pieces that a document of ``count`` tokens is cut into."""
    whole, left = divmod(count, capacity)
    cut = [capacity] * whole
    while left > tail:
        top = capacity // -(-capacity // left)
        if top * -(-capacity // left) > capacity or top > left:
            top = left
        cut.append(top)
        left -= top
    return cut + [left] * (left > 0)


def cut(docs: DataFrame, tokenizer_path: str, pattern: str, *, capacity: int = 2048, tail: int = 128, end_id: int = 1, keep: int = 400_000) -> DataFrame:
    """Tokenise and cut: a row for each piece, its ids as little-endian unsigned 32-bit numbers.

    ``worker`` and ``place`` (index of the piece among those of its length
    that this worker made) are only fixed once the rows are stored.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        released()  # the worker may hold what tasks of earlier stages freed
        worker = TaskContext.get().partitionId()
        tokens, made = Tokens(tokenizer_path, pattern, keep), {}
        columns: list[list] = [[] for _ in range(6)]
        size = 0

        def batch() -> pa.RecordBatch:
            ids, start, length, total, raw, place = columns
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(raw, pa.binary()), pa.array([worker] * len(ids), pa.int64()), pa.array(place, pa.int64())],
                ["doc_id", "start", "length", "doc_tokens", "ids", "worker", "place"],
            )
            for c in columns:
                c.clear()
            return out

        for b in chunks(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.append(tokens(text or ""), np.uint32(end_id)).astype("<u4")
                at = 0
                for n in lengths_of(len(ids), capacity, tail):
                    place = made.get(n, 0)
                    made[n] = place + 1
                    for c, v in zip(columns, (doc_id, at, n, len(ids), ids[at : at + n].tobytes(), place)):
                        c.append(v)
                    at += n
                size += 4 * len(ids)
                if size > BATCH_BYTES:
                    yield batch()
                    size = 0
        if columns[0]:
            yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(pieces, PIECES)


def shared_ends(totals: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Of each length: pieces in full sequences, and where its part-full sequence lies.

    Part-full sequences, one a length at most, go first-fit by falling size
    into common ones.
    """
    parts = sorted(((n % (capacity // x)) * x, x) for x, n in totals.items())[::-1]
    fill: list[int] = []
    out = []
    for size, x in parts:
        k = next((i for i, f in enumerate(fill) if f + size <= capacity), len(fill))
        if k == len(fill):
            fill.append(0)
        each = capacity // x
        out.append((x, totals[x] // each * each, k * (capacity + 1), fill[k]))
        fill[k] += size
    return out


def assign(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces; ``worker`` and ``place`` go.

    The driver gets one count a length, ``capacity`` at most.
    """
    counts = pieces.groupBy("worker", "length").agg(F.count(F.lit(1)).alias("made"))
    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("worker", "length", F.coalesce(F.sum("made").over(before), F.lit(0)).alias("first"))
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("made")).collect()}
    ends = pieces.sparkSession.createDataFrame(shared_ends(totals, capacity), "length long, full long, end_id long, end_at long")
    if first.count() <= BROADCAST_ROWS:  # else pieces are shuffled with their ids
        first = F.broadcast(first)
    each = F.floor(F.lit(capacity) / F.col("length"))
    index = F.col("first") + F.col("place")
    own, within = index < F.col("full"), (index % each) * F.col("length")
    return (
        pieces.join(first, ["worker", "length"])
        .join(F.broadcast(ends), "length")
        .withColumn("sequence_id", F.when(own, F.floor(index / each) * (capacity + 1) + F.col("length")).otherwise(F.col("end_id")).cast("long"))
        .withColumn("offset", F.when(own, within).otherwise(F.col("end_at") + within).cast("long"))
        .drop("worker", "place", "first", "full", "end_id", "end_at")
    )


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, **options) -> DataFrame:
    """Pieces with their ids, sequence and offset."""
    capacity = options.get("capacity", 2048)
    return assign(stored(cut(docs, tokenizer_path, pattern, **options), "pieces"), capacity=capacity)


ship(__name__)
