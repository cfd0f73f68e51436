"""Line dedup by an exact set-similarity join.

Native: DataFrame functions only. A line is the set of its tokens (runs without
white space); two lines match if their sets have a Jaccard similarity of 0.8 or
more; a line goes if it matches an earlier line (by document id, then line
number), be that one kept or not. Every line with a token takes part.

Tokens are keys of 64 bits in an order by rarity: counts over all documents in
65,536 classes of a hash's upper bits, the rarest class first, then its other 48
bits. The prefix of a set (its n - ceil(0.8 n) + 1 rarest tokens) must
meet the prefix of any match. Sets that share a prefix token are filtered by
length, by the places of their first common token and by a parity bitmap of 64
or 128 bits that bounds the difference from below; what is left is verified on
the whole sets. Lines of one set stand as its first. Sets of up to 3 tokens
reach 0.8 with their own copies only and stay out of the join.

A group of many like lines would join with itself in all pairs. So a first
round compares each set only with the first and a few previous ones that it meets
at one of two places (pairs of tokens on the way from rare to frequent), and
what it finds to be gone asks no more in the second round, which joins all others
with everything.

Defined cases: null and empty texts have no lines to remove; documents with a
null id are kept as they are and remove nothing. Different texts under one id
are documents of their own, in the order of a hash of the text; rows that repeat
id and text are one document and lose the same lines. Extra columns stay, under
whatever name; an input column ``lines_gone`` stays too, the count then stands
under the next free name (``lines_gone_``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, free, small, stored, tidy

CLASS_BITS = 16
CLASSES = 1 << CLASS_BITS
REST = 64 - CLASS_BITS
#: Sets of so many tokens and more have a bitmap of 128 bits, smaller ones of 64.
WIDE = 72
#: Spark's setting of the partition size up to which a join may hash a side, and that size. A hash table can't spill.
HASHED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
HASHED_BYTES = "64m"
#: The smallest set that can match another one: 4 of 5 tokens.
JOINED = 4
SPACES = r"[\x20\x09-\x0D]+"
#: Pairs of places in the order by rarity, as shares of the size, whose tokens bring like sets together in the first round.
MEETINGS = ((0.3, 0.5), (0.6, 0.8))
#: How far back the first round looks, beside the first set met.
BEFORE = (1, 2, 4)
#: Where a line stands, in the order of the documents.
PLACE = ("doc_id", "text_hash", "line_no")


def spaced(text: Column) -> Column:
    """Whether there is white space other than spaces and line ends."""
    found = F.lit(False)
    for space in "\t\x0b\x0c\r":  # four looks at the bytes cost less than one of a regular expression
        found = found | text.contains(space)
    return found


def pieces(line: Column, odd: Column | None = None) -> Column:
    """A line between its white space; some may be empty. The regular expression cuts only where there is more than spaces.

    ``odd``: false where the whole text is known not to be ``spaced``.
    """
    mixed = spaced(line) if odd is None else odd & spaced(line)
    return F.when(mixed, F.split(line, SPACES)).otherwise(F.split(line, " "))


def tokens(line: Column) -> Column:
    """The runs of a line without white space."""
    return F.array_remove(pieces(line), "")


def token_hashes(line: Column, odd: Column | None = None) -> Column:
    """The distinct hashes of a line's tokens, one hash a token. Empty pieces go by their hash."""
    return F.array_remove(F.array_distinct(F.transform(pieces(line, odd), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))


def class_of(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, REST)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no and the distinct token hashes of each line, of documents (doc_id, text). What is of the text is made before the lines, or each of them would carry it."""
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), spaced(F.col("text")).alias("odd"), F.split("text", "\n").alias("parts"))
    return texts.select("doc_id", "text_hash", "odd", F.posexplode("parts").alias("line_no", "line")).select(*PLACE, token_hashes(F.col("line"), F.col("odd")).alias("hashes"))


def rarity(hashed: DataFrame) -> Column:
    """A constant array for ``keys_of``: by class, what turns it into its place in the order of counts of lines with its tokens. The driver gets one count a class."""
    with tidy(hashed.sparkSession):
        counts = dict(hashed.select(F.explode("hashes").alias("h")).groupBy(class_of(F.col("h")).alias("c")).count().collect())
    turns = [0] * CLASSES
    for at, c in enumerate(sorted(range(CLASSES), key=lambda c: (counts.get(c, 0), c))):
        turns[c] = signed((c ^ at ^ CLASSES // 2) << REST)
    return F.split(F.lit(",".join(map(str, turns))), ",").cast("array<long>")  # folded to one constant


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keys_of(hashes: Column, turns: Column) -> Column:
    """Sorted token keys of 64 bits: the hash, its class turned into the class's place. No other step is made for each token."""
    key = lambda h: h.bitwiseXOR(F.coalesce(turns[class_of(h)], F.lit(0).cast("long")))  # noqa: E731  # known not to be null: plain arrays sort faster
    return F.sort_array(F.transform(hashes, key))


def token_set(line: Column, places: Column) -> Column:
    """Sorted distinct token keys of a line, of the places of the classes."""
    placed = lambda h: F.call_function("shiftleft", F.get(places, class_of(h).cast("int")).cast("long"), F.lit(REST)).bitwiseOR(h.bitwiseAND(F.lit((1 << REST) - 1)))
    return F.sort_array(F.transform(token_hashes(line), placed))


WORDS = ("w0", "w1")


def bitmaps(keys: Column, n: Column) -> list[Column]:
    """The parity bitmap of a set: w0, the parity of its tokens in 64 bits; w1, that of every other token (wide sets only)."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))
    none = F.lit(0).cast("long")
    all_ = F.aggregate(keys, none, lambda a, k: a.bitwiseXOR(bit(k)))
    half = F.aggregate(keys, none, lambda a, k: F.when(k.bitwiseAND(F.lit(64)) == 0, a).otherwise(a.bitwiseXOR(bit(k))))
    return [all_.alias("w0"), F.when(n >= WIDE, half).otherwise(none).alias("w1")]


def may_match(n: Column, m: Column, p: Column, q: Column, x: list[Column], y: list[Column]) -> Column:
    """Place, length and bitmap filters for sets of n and m tokens whose first common tokens are those at p and q (from 0).

    Two sets match if the tokens of one of them only are (n + m) / 9 at most, or
    the common ones 4 (n + m) / 9 at least; with p = q = 0 that bounds the lengths.
    """
    both = n + m
    ones = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    even = lambda w: w[0].bitwiseXOR(w[1])
    differ = F.when((n >= WIDE) & (m >= WIDE), ones(even(x), even(y)) + ones(x[1], y[1])).otherwise(ones(x[0], y[0]))
    return (9 * (p + q) <= both) & (9 * F.least(n - p, m - q) >= 4 * both) & (9 * differ <= both)


def place(name: str = "") -> Column:
    return F.struct(*(F.col(f"{name}{c}").alias(c) for c in PLACE))


def verified(docs: DataFrame, set_of: Callable[[Column], Column], pairs: DataFrame) -> DataFrame:
    """The later places of the pairs (xdoc_id, xline_no, ydoc_id, yline_no) of which x matches y, an earlier line, by the sets that ``set_of`` makes of lines. Stored.

    Places come without the hash of the text, to be short. Where an id has
    several texts, all of them are compared, and the order is settled here.
    """
    pairs = stored(pairs.distinct(), "pairs")
    at = ("doc_id", "line_no")
    places = pairs.select(*(F.col(f"x{c}").alias(c) for c in at)).unionByName(pairs.select(*(F.col(f"y{c}").alias(c) for c in at)))
    wanted = stored(places.groupBy("doc_id").agg(F.collect_set("line_no").alias("lines")), "wanted")
    # One look for each document, not for each line; only lines that are asked for are made rows.
    met = docs.join(small(wanted), "doc_id").select("doc_id", F.xxhash64("text").alias("text_hash"), "lines", F.array(F.split("text", "\n")).alias("held"))
    chosen = F.get(F.transform("held", lambda parts: F.transform("lines", lambda i: F.struct(i.alias("line_no"), F.get(parts, i).alias("line")))), F.lit(0))
    rows = met.select("doc_id", "text_hash", F.explode(chosen).alias("c")).select("doc_id", "text_hash", "c.line_no", "c.line").filter("line IS NOT NULL")
    sets = stored(rows.select(*PLACE, set_of(F.col("line")).alias("keys")), "sets")
    side = lambda c: sets.select(*(F.col(x).alias(f"{c}{x}") for x in (*PLACE, "keys")))
    both = pairs.join(side("x"), ["xdoc_id", "xline_no"]).join(side("y"), ["ydoc_id", "yline_no"])
    common = F.size(F.array_intersect("xkeys", "ykeys"))
    match = (place("y") < place("x")) & (9 * common >= 4 * (F.size("xkeys") + F.size("ykeys")))
    found = stored(both.filter(match).select(*(F.col(f"x{c}").alias(c) for c in PLACE)).distinct(), "gone")
    discard(pairs, wanted, sets)
    return found


def line_sets(hashed: DataFrame, turns: Column) -> DataFrame:
    """Stored, a row a line: place, set id, size (0 without a token), bitmap and prefix of its set.

    No filter stands on the sets before they are stored: it would be pushed
    below and have them made twice.
    """
    keyed = hashed.select(*PLACE, keys_of(F.col("hashes"), turns).alias("keys"), F.size("hashes").alias("n"))
    prefix = (F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1).cast("int")
    at = lambda share: F.get("keys", F.floor(F.col("n") * share).cast("int"))
    meet = F.array(*(F.xxhash64(at(a), at(b)) for a, b in MEETINGS))
    return stored(keyed.select(*PLACE, F.xxhash64("keys").alias("set_id"), "n", *bitmaps(F.col("keys"), F.col("n")), F.slice("keys", 1, prefix).alias("head"), meet.alias("meet")), "lines")


def posting(n: Column, p: Column, settled: Column) -> Column:
    """Size, place and whether the set is gone as one number, never null: rows of the join are sorted twice, each column counts."""
    lower = F.call_function("shiftleft", p.cast("long"), F.lit(1)).bitwiseOR(settled.cast("long"))
    return F.coalesce(F.call_function("shiftleft", n.cast("long"), F.lit(32)).bitwiseOR(lower), F.lit(0).cast("long"))


def size_of(posted: Column) -> Column:
    return F.shiftrightunsigned(posted, 32)


def place_of(posted: Column) -> Column:
    return F.shiftrightunsigned(posted.bitwiseAND(F.lit((1 << 32) - 1)), 1)


def settled_of(posted: Column) -> Column:
    return posted.bitwiseAND(F.lit(1))


def may_be_earlier() -> Column:
    """y at an earlier place than x, or at the same one in another text of the id."""
    return (F.col("ydoc_id") < F.col("xdoc_id")) | ((F.col("ydoc_id") == F.col("xdoc_id")) & (F.col("yline_no") <= F.col("xline_no")))


def settled_early(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """First round: first places of sets that match the first or one of a few previous sets met at one of two places (positions say nothing there)."""
    mine = ("doc_id", "line_no", "n", *WORDS)
    near = sets.select("first.doc_id", "first.line_no", "n", *WORDS, F.explode(F.array_distinct("meet")).alias("k"))
    order = Window.partitionBy("k").orderBy(*mine)
    me = F.struct(*mine)
    held = [f"before{k}" for k in BEFORE]
    asked = near.withColumns({"start": F.first(me).over(order)} | {c: F.lag(me, k).over(order) for c, k in zip(held, BEFORE)})
    # Most sets are the first at their key and meet none: they go before anything is made of them.
    asked = asked.filter(F.greatest(*(F.col(c).isNotNull() for c in held))).withColumn("o", F.explode(F.array("start", *held))).drop("start", *held).filter(F.col("o").isNotNull() & (F.col("o") != me))
    none = F.lit(0)
    ok = may_match(F.col("n"), F.col("o.n"), none, none, [F.col(w) for w in WORDS], [F.col(f"o.{w}") for w in WORDS])
    return verified(docs, token_hashes, asked.filter(ok).select(F.col("doc_id").alias("xdoc_id"), F.col("line_no").alias("xline_no"), F.col("o.doc_id").alias("ydoc_id"), F.col("o.line_no").alias("yline_no")))


@contextmanager
def hash_joins(spark: SparkSession) -> Iterator[None]:
    """Joins in here hash one side in place of sorting both where all partitions turn out to be small; others are sorted, which can spill.

    For sides of distinct keys: the second round's join takes more CPU that way.
    """
    before = spark.conf.get(HASHED, "0")
    spark.conf.set(HASHED, HASHED_BYTES)
    try:
        yield
    finally:
        spark.conf.set(HASHED, before)


def gone_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables: all lines (place, n, set_id and more), and of each set with a token its first place and whether it goes."""
    # Texts are cut into tokens once, for the counts and the sets. Rows of the cache are plain memory; an executor that is lost makes its part again.
    hashed = hashed_lines(docs).persist(StorageLevel.DISK_ONLY)
    try:
        made = line_sets(hashed, rarity(hashed))
    finally:
        hashed.unpersist(blocking=True)
    lines = made.filter("n > 0")
    sets = stored(lines.groupBy("set_id").agg(F.min(place()).alias("first"), *(F.first(c).alias(c) for c in ("n", "meet", *WORDS))), "firsts")
    joined = F.col("n") >= JOINED
    gone = settled_early(docs, sets.filter(joined))
    # Second round: what is not gone asks all sets that share a prefix token. A posting holds n, p and whether its set is gone in one number.
    with hash_joins(docs.sparkSession):
        copies = stored(lines.select(*PLACE, "set_id").join(sets.select("set_id", "first"), "set_id").filter(place() != F.col("first")).select(*PLACE), "copies")
    once = lines.filter(joined).join(small(copies), list(PLACE), "left_anti")
    flagged = once.join(small(gone.withColumn("settled", F.lit(1))), list(PLACE), "left").withColumn("settled", F.coalesce("settled", F.lit(0)))
    # Only where an id has several texts does a posting need the hash of its text; where none has, no column is carried.
    again = sets.groupBy("first.doc_id").agg((F.min("first.text_hash") != F.max("first.text_hash")).alias("again")).filter("again")
    repeated = stored(again, "repeated")
    if repeated.isEmpty():
        flagged = flagged.withColumn("text", F.lit(0).cast("long"))
    else:
        flagged = flagged.join(small(repeated), "doc_id", "left").withColumn("text", F.when(F.col("again"), F.col("text_hash")).otherwise(F.lit(0)))
    posted = flagged.select("doc_id", "line_no", "text", "n", "settled", *WORDS, F.posexplode("head").alias("p", "k")).select("k", "doc_id", "line_no", "text", posting(F.col("n"), F.col("p"), F.col("settled")).alias("np"), *WORDS)

    def side(c: str) -> DataFrame:
        return posted.select(*(F.col(x).alias(f"{c}{x}") for x in posted.columns))

    of = lambda c: [F.col(f"{c}{w}") for w in WORDS]
    n, p = lambda c: size_of(F.col(f"{c}np")), lambda c: place_of(F.col(f"{c}np"))
    # Both sides read one exchange. That x is not gone is said with a column of y, as a filter on x alone would move below the exchange and make another one; nor may np be null, for the same reason.
    asks = settled_of(F.col("xnp")) * F.lit(1 << 31) < n("y")
    meet = (F.col("xk") == F.col("yk")) & may_be_earlier() & asks & may_match(n("x"), n("y"), p("x"), p("y"), of("x"), of("y"))
    other = (F.col("xdoc_id") != F.col("ydoc_id")) | (F.col("xline_no") != F.col("yline_no")) | (F.col("xtext") != F.col("ytext"))
    met = side("x").join(side("y"), meet & other)
    late = verified(docs, token_hashes, met.select("xdoc_id", "xline_no", "ydoc_id", "yline_no"))
    every = gone.unionByName(late).distinct().select(place().alias("first"), F.lit(True).alias("goes"))
    with hash_joins(docs.sparkSession):
        verdicts = stored(sets.select("set_id", "first").join(every, "first", "left").withColumn("goes", F.coalesce("goes", F.lit(False))), "verdicts")
    discard(sets, copies, gone, late, repeated)
    return made, verdicts


def without(text: Column, gone: Column) -> Column:
    """The text without its lines at the places in ``gone``, in time that grows with the number of lines."""
    left = lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone), lambda i: F.get(parts, i))
    return F.get(F.transform(F.array(F.split(text, "\n")), lambda parts: F.array_join(left(parts), "\n")), F.lit(0))


def counts_name(docs: DataFrame) -> str:
    """The column that ``dedup`` adds."""
    return free("lines_gone", docs.columns)


def dedup(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, ``text`` without the lines that go, and ``lines_gone``, how many they are."""
    lines, verdicts = gone_sets(docs.select("doc_id", "text"))
    gone = lines.filter("n > 0").select(*PLACE, "set_id").join(verdicts, "set_id").filter(F.col("goes") | (place() > F.col("first"))).select(*PLACE)
    i, h, g = (free(c, docs.columns) for c in ("_id", "_hash", "_gone"))
    with hash_joins(docs.sparkSession):
        by_doc = stored(gone.groupBy("doc_id", "text_hash").agg(F.collect_list("line_no").alias(g)).withColumnsRenamed({"doc_id": i, "text_hash": h}), "gone_lines")
    discard(lines, verdicts)
    joined = docs.join(small(by_doc), (F.col("doc_id") == F.col(i)) & (F.xxhash64("text") == F.col(h)), "left")
    count = counts_name(docs)
    out = joined.withColumn(count, F.when(F.col(g).isNull(), 0).otherwise(F.size(g))).withColumn("text", F.when(F.col(g).isNull(), F.col("text")).otherwise(without(F.col("text"), F.col(g))))
    return out.select(*docs.columns, count)
