"""Mixing of sources to target weights.

The words of each source are laid end to end (documents by a hash of their
id) and cut into blocks of ``block_words``. Targets share all words by weight;
a target stops at ``most`` times its source and the excess is shared again.
A source's target is filled by whole passes over its blocks and one part pass,
each pass in an order of its own, given by a keyed permutation of the block
indices. Output shards draw how many slots they take of each source: the
multinomial draw given the totals, made by halving the range of shards again
and again with a seed for every half, so any worker finds the counts of its
shard alone. Slots then meet the documents' fragments by source and block.

Positions come from two-level sums: no source is summed by one task.

Defined cases: null text has size 0 and is never taken; a null source is a
source of its own, last in the order; rows with repeated or null ids stand
for themselves, alike rows in any order. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks, counted, free, released, ship, stored, tidy

WORDS = r"[^\x20\x09-\x0D]+"


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row a source of ``sizes`` (source, size): ``source_size``, ``target`` and ``sid``, its place in code point order."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    w = each.withColumn("sid", place).withColumn("weight", weight).withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("weight"))
    # Of the sources by rising ratio, the first ones stop at their limit; the rest share what is left by weight.
    order = Window.orderBy("ratio", "sid")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0))
    shared = w.withColumn("share", left / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("ratio") >= F.col("share"), F.struct("ratio", "sid", "share"))).over(Window.partitionBy())["share"]
    return shared.withColumn("target", F.least((F.lit(most) * F.col("source_size")).cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select("source", "sid", "source_size", "target")


def positioned(sizes: DataFrame, *, rows_each: int = 50_000) -> DataFrame:
    """Add ``at``, the words of the source before the row, to rows of (source, doc_id, size)."""
    parts = max(16, -(-counted(sizes) // rows_each))
    hashed = sizes.withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(parts)))  # the size deals rows of one id, or of none, over many parts
    sums = hashed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "part").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = hashed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return within.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).withColumn("at", F.col("base") + F.col("inside")).drop("s", "p", "part", "base", "inside")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..size-1 at ``index``: a four-round Feistel network, walked until it falls in range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            f = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo &= out >= size.astype(np.uint64)
    return out.astype(np.int64)


#: Slots that one draw can count at most; a larger mix is drawn in so many even parts more.
DRAWN = 500_000_000


def drawn(totals: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First slot and number of slots of each source in one shard.

    The shards lie in even parts, of at most ``DRAWN`` slots each. A part is
    halved down to the shard asked for. How the slots of a range divide is a
    draw without replacement, seeded by the range, so all shards agree.
    """
    parts = min(shards, max(1, -(-int(totals.sum()) // DRAWN)))
    part = (shard * parts + parts - 1) // shards  # the last one that begins at or before the shard
    low, high = part * shards // parts, (part + 1) * shards // parts
    share = lambda at: np.array([int(c) * at // shards for c in totals], np.int64)
    first = share(low)
    count = share(high) - first
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = rng.multivariate_hypergeometric(count, (mid - low) * int(count.sum()) // (high - low), method="marginals")
        if shard < mid:
            high, count = mid, left
        else:
            low, first, count = mid, first + left, count - left
    return first, count


SLOTS = "shard long, slot long, sid long, turn long, block long, words long"


def slots(targets: DataFrame, *, most: int = 3, block_words: int = 256, shard_slots: int = 4096, seed: int = 11) -> DataFrame:
    """The mix: rows of shard, slot, source (``sid``), pass (``turn``), block and how many of its words are taken.

    The driver gets one row a source (names of sources, not documents).
    """
    spark = targets.sparkSession
    with tidy(spark):
        rows = sorted((r["sid"], r["source_size"], r["target"]) for r in targets.filter("source_size > 0").collect())
    sid = np.array([r[0] for r in rows], np.int64)
    size = np.array([r[1] for r in rows], np.int64)
    blocks = -(-size // block_words)
    goal = np.minimum(np.array([round(r[2]) for r in rows], np.int64), most * size) if rows else size
    passes = goal // np.maximum(size, 1)
    part = goal - passes * size
    total = passes * blocks + -(-part // block_words)
    shards = max(1, -(-int(total.sum()) // shard_slots)) if rows else 0
    held = spark.sparkContext.broadcast((sid, size, blocks, passes, part, total))  # one entry a source

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, size, blocks, passes, part, total = held.value
        for b in batches:
            for shard in b.column(0).to_pylist():
                first, count = drawn(total, shards, shard, seed)
                own = np.repeat(np.arange(len(sid)), count)
                within = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                n = first[own] + within
                turn, i = n // blocks[own], n % blocks[own]
                key = (sid[own].astype(np.uint64) * np.uint64(0x94D049BB133111EB)) ^ (turn.astype(np.uint64) << np.uint64(40)) ^ np.uint64(seed)
                block = permuted(i, blocks[own], key)
                length = np.minimum(block_words, size[own] - block * block_words)
                words = np.where(turn < passes[own], length, np.minimum(length, part[own] - i * block_words))
                order = np.random.Generator(np.random.PCG64([seed, shard])).permutation(len(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard)), pa.array(np.arange(len(own))), *(pa.array(x[order]) for x in (sid[own], turn, block, words))], ["shard", "slot", "sid", "turn", "block", "words"])

    parts = max(1, min(shards, spark.sparkContext.defaultParallelism * 4))
    return spark.range(0, shards, 1, parts).mapInArrow(fill, SLOTS)


def fragments(placed: DataFrame, *, block_words: int = 256) -> DataFrame:
    """A row for each block that a document's words lie in: (key columns), ``block``, ``start`` (in the document), ``length``, ``block_at`` (in the block)."""
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    each = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("at"), F.col("block") * block_words)
    high = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    return each.withColumns({"start": (low - F.col("at")).cast("long"), "length": (high - low).cast("long"), "block_at": (low - F.col("block") * block_words).cast("long")})


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = 256, seed: int = 11, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Documents with size, source_size, target and place; and the slots of the mix.

    A slot takes the first ``words`` words of its block. ``keep``: columns that the documents carry along.
    """
    sizes = stored(docs.select("source", *keep, F.col("doc_id").cast("long").alias("doc_id"), words_in("text").alias("size")), "sizes")
    targets = stored(source_targets(sizes, weights=weights, most=most), "targets")
    named = targets.select(F.col("source").alias("s"), "sid", "source_size", "target")
    placed = positioned(sizes).join(F.broadcast(named) if counted(targets) <= 100_000 else named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return placed, slots(targets, most=most, block_words=block_words, seed=seed)


def cut_pieces(text: str, takes: list[dict]) -> list[str]:
    """Texts of what the mix takes: runs of words of one pass that follow each other, white space between them kept."""
    runs: list[list[int]] = []
    last = None
    for turn, start, words in sorted((t["turn"], t["start"], t["words"]) for t in takes):
        if last == (turn, start):
            runs[-1][1] = start + words
        else:
            runs.append([start, start + words])
        last = (turn, start + words)
    spans = [m.span() for m in re.finditer(WORDS, text)]
    return [text[spans[a][0] : spans[b - 1][1]] for a, b in runs]


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of the columns of ``docs``: one for each run of a document's words that a pass takes.

    Each document's text moves once, to meet the list of its takes.
    """
    columns = docs.columns
    block_words = options.get("block_words", 256)
    row, also, list_ = (free(c, columns) for c in ("_row", "_also", "_takes"))  # 128 bits that name a row by its content
    keyed = docs.withColumns({row: F.xxhash64(*columns), also: F.xxhash64(F.lit(1), *columns)})
    placed, mixed = mix(keyed, keep=(row, also), **options)
    cut = fragments(placed.select(row, also, "sid", "at", "size"), block_words=block_words)
    words = F.least(F.col("length"), F.col("words") - F.col("block_at"))
    met = cut.join(mixed.select("sid", "block", "turn", "words").hint("merge"), ["sid", "block"]).withColumn("words", words).filter("words > 0")
    # Alike rows share a key, so their takes are told apart by place.
    takes = met.groupBy(row, also, "at").agg(F.collect_list(F.struct("turn", "start", "words")).alias(list_)).drop("at")
    once = keyed.dropDuplicates([row, also])
    joined = once.join(takes, [row, also]).select(*columns, list_)
    sized = "n_chars" in columns

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for part in chunks(batches):
            texts = [cut_pieces(t, k) for t, k in zip(part.column("text").to_pylist(), part.column(list_).to_pylist())]
            rows = part.drop_columns([list_]).take(pa.array([i for i, x in enumerate(texts) for _ in x], pa.int64()))
            flat = pa.array([x for xs in texts for x in xs], pa.string())
            rows = rows.set_column(rows.schema.get_field_index("text"), "text", flat)
            if sized:
                n = pa.compute.utf8_length(flat).cast(rows.schema.field("n_chars").type)
                rows = rows.set_column(rows.schema.get_field_index("n_chars"), "n_chars", n)
            yield rows

    return joined.mapInArrow(out, docs.schema)


def totals(placed: DataFrame, mixed: DataFrame, *, block_words: int = 256) -> DataFrame:
    """One row a document row: doc_id, size, source_size, target and ``taken``, the words that the mix takes of it."""
    used = mixed.groupBy("sid", "block").agg(F.collect_list("words").alias("takes"))
    cut = fragments(placed.select("sid", "at", "size"), block_words=block_words)
    got = (
        cut.join(used.hint("merge"), ["sid", "block"])  # a slot table looks small to the planner, as it is made from a range
        .withColumn("got", F.aggregate("takes", F.lit(0).cast("long"), lambda a, w: a + F.greatest(F.lit(0).cast("long"), F.least(F.col("length"), w - F.col("block_at")))))
        .groupBy(F.col("sid").alias("g_sid"), F.col("at").alias("g_at"))
        .agg(F.sum("got").alias("taken"))
    )
    joined = placed.join(got, (F.col("sid") == F.col("g_sid")) & (F.col("at") == F.col("g_at")) & (F.col("size") > 0), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


ship(__name__)
