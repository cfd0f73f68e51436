"""Documents and text: census, quotes, redaction, names, search, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.columns import count_if, top
from ..registry import named

# Fixed keyword groups of the census.
KEYWORDS = {"license": "license", "copyright": "copyright", "rights": "rights reserved", "public": "public"}


@named(f"""SELECT doc_id, length(text) AS chars, CASE WHEN length(text) < 10000 THEN 'tiny' WHEN length(text) < 50000 THEN 'small' WHEN length(text) < 200000 THEN 'medium' ELSE 'large' END AS size_bucket, len(string_split(text, chr(10))) AS sections,
    {', '.join(f"len(regexp_extract_all(lower(text), '{v}')) AS {k}_count" for k, v in KEYWORDS.items())} FROM documents""")
def census(t) -> DataFrame:
    low = F.lower("text")
    return t.documents.select("doc_id", F.char_length("text").alias("chars"), X.size_bucket(F.char_length("text")).alias("size_bucket"), F.size(F.split("text", "\n")).alias("sections"), *(F.regexp_count(low, F.lit(v)).alias(f"{k}_count") for k, v in KEYWORDS.items()))


@named("""SELECT lang, CASE WHEN length(text) < 10000 THEN 'tiny' WHEN length(text) < 50000 THEN 'small' ELSE 'medium+' END AS bucket, count(*) AS n, cast(sum(length(text)) AS bigint) AS chars FROM documents GROUP BY 1, 2""")
def census_summary(t) -> DataFrame:
    n = F.char_length("text")
    return t.documents.groupBy("lang", F.when(n < 10_000, "tiny").when(n < 50_000, "small").otherwise("medium+").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("chars"))


@named("""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents) x WHERE word NOT IN ('that', 'this', 'with', 'from') GROUP BY 1 ORDER BY n DESC, word LIMIT 60""")
def word_frequency(t) -> DataFrame:
    stop = t.documents.sparkSession.createDataFrame([(w,) for w in ("that", "this", "with", "from")], "word string")
    words = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("word"))
    return words.join(F.broadcast(stop), "word", "left_anti").groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(60)


@named("""SELECT lang, avg(CASE WHEN length(trim(text)) > 1000 THEN 1.0 ELSE 0 END) AS substantive, avg(len(string_split(text, ' '))) AS mean_words, count(*) AS docs FROM documents GROUP BY 1""")
def inventory_quality(t) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.avg((F.char_length(F.trim("text")) > 1000).cast("double")).alias("substantive"), F.avg(F.size(F.split("text", " "))).alias("mean_words"), F.count(F.lit(1)).alias("docs"))


@named("""SELECT page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host, CASE WHEN contains(url, 'page=') THEN 'agenda' WHEN contains(url, '#') THEN 'addendum' WHEN regexp_matches(url, '/[a-z]{2}/[0-9]+') THEN 'minutes' ELSE 'unknown' END AS kind FROM pages""")
def document_type(t) -> DataFrame:
    u = F.col("url")
    kind = F.when(u.contains("page="), "agenda").when(u.contains("#"), "addendum").when(u.rlike("/[a-z]{2}/[0-9]+"), "minutes").otherwise("unknown")
    return t.pages.select("page_id", F.lower(F.regexp_extract(u, "^https?://([^/]+)", 1)).alias("host"), kind.alias("kind"))


def quote_candidates(t) -> DataFrame:
    """Quotes of five words or more and the documents that hold their second to fourth word in a row.

    A verbatim quote of that length shares these words whole with its document;
    the join is on them, so no document is compared with all quotes.
    """
    tri = lambda c: F.slice(F.split(X.spaces_collapsed(c), " "), 2, 3)
    q = t.benchmark.select("item_id", F.col("text").alias("quote")).withColumn("key", F.array_join(tri(F.col("quote")), " "))
    words = t.documents.select("doc_id", "text", F.split(X.spaces_collapsed(F.col("text")), " ").alias("w"))
    grams = words.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 2)), lambda i: F.array_join(F.slice("w", i, 3), " ")))).alias("key"))
    hits = grams.join(F.broadcast(q.select("item_id", "key")) if q.count() <= 100_000 else q.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    return hits.join(t.documents.select("doc_id", "text"), "doc_id").join(q.select("item_id", "quote"), "item_id")


_NORM = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_BARE = "regexp_replace({0}, '[^a-zA-Z0-9]', '', 'g')"


@named(f"""SELECT item_id, doc_id, CASE WHEN contains(d.text, b.text) THEN 'exact' ELSE 'normalised' END AS tier FROM benchmark b JOIN documents d ON contains({_NORM.format('d.text')}, {_NORM.format('b.text')})""")
def quote_tiers(t) -> DataFrame:
    norm = X.spaces_collapsed
    c = quote_candidates(t).withColumn("tier", F.when(F.contains("text", "quote"), "exact").when(F.contains(norm(F.col("text")), norm(F.col("quote"))), "normalised"))
    return c.filter("tier IS NOT NULL").select("item_id", "doc_id", "tier")


@named("""SELECT item_id, doc_id, instr(d.text, b.text) - 1 AS char_offset, length(b.text) AS char_length FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def quote_offsets(t) -> DataFrame:
    return quote_candidates(t).withColumn("char_offset", F.instr("text", F.col("quote")) - 1).filter("char_offset >= 0").select("item_id", "doc_id", "char_offset", F.char_length("quote").alias("char_length"))


@named("""WITH h AS (SELECT doc_id, length(d.text) AS n, instr(d.text, b.text) - 1 AS a, instr(d.text, b.text) - 1 + length(b.text) AS z FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    m AS (SELECT *, max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h) SELECT doc_id, sum(greatest(z - greatest(a, coalesce(before, 0)), 0)) / min(n) AS coverage FROM m GROUP BY 1""")
def quote_coverage(t) -> DataFrame:
    """Union length of the quotes' spans over the document's length: each span counts from where those before it end."""
    from pyspark.sql import Window

    h = quote_candidates(t).withColumn("a", F.instr("text", F.col("quote")) - 1).filter("a >= 0").select("doc_id", F.char_length("text").alias("n"), "a", (F.col("a") + F.char_length("quote")).alias("z"))
    before = F.max("z").over(Window.partitionBy("doc_id").orderBy("a", "z").rowsBetween(Window.unboundedPreceding, -1))
    return h.withColumn("b", F.coalesce(before, F.lit(0))).groupBy("doc_id").agg((F.sum(F.greatest(F.col("z") - F.greatest("a", "b"), F.lit(0))) / F.min("n")).alias("coverage"))


@named("""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[a-z]+')) AS emails, len(regexp_extract_all(text, '\\b[0-9]{1,3}(?:\\.[0-9]{1,3}){3}\\b')) AS addresses FROM documents WHERE regexp_matches(text, '@|[0-9]\\.[0-9]')""")
def private_patterns(t) -> DataFrame:
    d = t.documents.filter(F.col("text").rlike(r"@|[0-9]\.[0-9]"))
    return d.select("doc_id", F.regexp_count("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]+")).alias("emails"), F.regexp_count("text", F.lit(r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b")).alias("addresses"))


@named("""SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[a-z]+', '[redacted]', 'g')) AS digest FROM documents""")
def redaction(t) -> DataFrame:
    return t.documents.select("doc_id", F.md5(F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]+", "[redacted]")).alias("digest"))


@named("""SELECT event_type, cast(json_extract_string(props, '$.k') AS int) % 10 AS k, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def json_props(t) -> DataFrame:
    return t.events.groupBy("event_type", (F.from_json("props", "k int")["k"] % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@named("""WITH r AS (SELECT doc_id, lang, CASE WHEN n_chars < 1000 THEN 'a' WHEN n_chars < 3000 THEN 'b' ELSE 'c' END AS cell, row_number() OVER (PARTITION BY lang, CASE WHEN n_chars < 1000 THEN 'a' WHEN n_chars < 3000 THEN 'b' ELSE 'c' END ORDER BY md5(cast(doc_id AS string)), doc_id) AS rn FROM documents) SELECT doc_id, lang, cell FROM r WHERE rn <= 3""")
def stratified_pick(t) -> DataFrame:
    cell = F.when(F.col("n_chars") < 1000, "a").when(F.col("n_chars") < 3000, "b").otherwise("c")
    d = t.documents.select("doc_id", "lang", cell.alias("cell"))
    return top(d, ["lang", "cell"], [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], 3).select("doc_id", "lang", "cell")


@named("""SELECT l.quality, l.toxic, count(*) AS n, avg(n_chars) AS mean_chars FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2""")
def audit_labels(t) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars"))


@named("""SELECT 'motion' AS kind, id, lower(title) AS body FROM motions WHERE contains(lower(title), 'urgent') UNION ALL SELECT 'tender', id, lower(awarded_to) FROM tenders WHERE contains(lower(awarded_to), '00007') UNION ALL SELECT 'other', id, lower(description) FROM other_items WHERE contains(lower(description), 'legal')""")
def lookup_search(t) -> DataFrame:
    part = lambda df, kind, c, word: df.select(F.lit(kind).alias("kind"), "id", F.lower(c).alias("body")).filter(F.col("body").contains(word))
    return part(t.motions, "motion", "title", "urgent").unionByName(part(t.tenders, "tender", "awarded_to", "00007")).unionByName(part(t.other_items, "other", "description", "legal"))


@named("""SELECT id, regexp_replace(regexp_replace(lower(given_name || '-' || family_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, substr(sha256(slug), 1, 8) AS short FROM councillors""")
def person_slugs(t) -> DataFrame:
    return t.councillors.select("id", X.slug(F.col("given_name"), F.col("family_name")).alias("slug"), F.substring(F.sha2("slug", 256), 1, 8).alias("short"))


@named("""SELECT doc_id, len(string_split(text, chr(10))) AS parts, CASE WHEN length(text) > 30000 THEN substr(text, 1, 20000) || chr(10) || '...' || chr(10) || right(text, 10000) ELSE text END = text AS whole FROM documents""")
def document_window(t) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.split("text", "\n")).alias("parts"), (X.meeting_window(F.col("text")) == F.col("text")).alias("whole"))


@named("""SELECT length(text) // 4000 + 1 AS chunks, count(*) AS docs, cast(sum(ceil(length(text) / 4)) AS bigint) AS tokens FROM documents GROUP BY 1""")
def extraction_estimate(t) -> DataFrame:
    n = F.char_length("text")
    return t.documents.groupBy((F.floor(n / 4000) + 1).cast("long").alias("chunks")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.ceil(n / 4)).cast("long").alias("tokens"))
