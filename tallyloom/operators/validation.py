"""An extraction held against its documents: tiers of quotes, paraphrase, coverage, keyword gaps, completeness, status.

Quotes meet their own document by its id; spans are places in the text with
white space collapsed. No text is compared with quotes of other documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.columns import count_if
from ..registry import named

# Words that should stand in a quote, the shortest quote that is looked for without its spaces.
GAP_WORDS = {"MOVED": r"\bMOVED\b", "DEVELOPMENT APPLICATION": "DEVELOPMENT APPLICATION", "DECLARATION OF INTEREST": "DECLARATION OF INTEREST", "DEPUTATION": r"\bDEPUTATION\b", "PETITION": r"\bPETITION\b"}
AGENDA_GAP_WORDS = {"OFFICER RECOMMENDATION": "OFFICER RECOMMENDATION", "RECOMMENDED THAT": "RECOMMENDED THAT", "DEVELOPMENT APPLICATION": "DEVELOPMENT APPLICATION", "DEPUTATION": r"\bDEPUTATION\b", "PETITION": r"\bPETITION\b"}
SHORTEST_BARE = 15
#: Plans after the minutes repeat this word on every page: hits so far behind the last quote don't count.
APPENDIX_WORD, APPENDIX_SLACK = "DEVELOPMENT APPLICATION", 50_000
#: Words of the driver's invented prose for the registered query, which has none of the above.
PROSE_WORDS = {"the": " the ", "und": " und ", "DEVELOPMENT APPLICATION": " de "}


def without_headers(text: Column) -> Column:
    """The text without lines that hold the path of a shared drive, which page headers repeat."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.contains("H:\\") & ~line.contains("H:/")), "\n")


def tiers(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quotes (doc_id, quote_id, quote) with ``tier`` (full, stripped, paraphrase), ``a`` and ``z``, the span in the collapsed text.

    A stripped match has the same letters and digits in a row; its span runs
    from the first to the last of them.
    """
    norm = X.spaces_collapsed
    held = texts.select("doc_id", norm(without_headers(F.col("text"))).alias("norm")).withColumn("bare", X.letters_only(F.col("norm")))
    asked = quotes.select("doc_id", "quote_id", norm(F.col("quote")).alias("nq")).withColumn("bq", X.letters_only(F.col("nq")))
    met = asked.join(held, "doc_id").withColumn("at", F.instr("norm", F.col("nq"))).withColumn("bare_at", F.instr("bare", F.col("bq")))
    tier = F.when(F.col("at") > 0, "full").when((F.char_length("bq") >= SHORTEST_BARE) & (F.col("bare_at") > 0), "stripped").otherwise("paraphrase")
    met = met.withColumn("tier", tier)
    # Places of letters and digits are made only where a stripped match needs them.
    places = F.when(F.col("tier") == "stripped", F.filter(F.transform(F.split("norm", ""), lambda c, i: F.when(c.rlike("[a-zA-Z0-9]"), i)), lambda i: i.isNotNull()))
    met = met.withColumn("places", places)
    first, last = F.get("places", F.col("bare_at") - 1), F.get("places", F.col("bare_at") + F.char_length("bq") - 2)
    a = F.when(F.col("tier") == "full", F.col("at") - 1).when(F.col("tier") == "stripped", first)
    z = F.when(F.col("tier") == "full", F.col("at") - 1 + F.char_length("nq")).when(F.col("tier") == "stripped", last + 1)
    return met.select("doc_id", "quote_id", "tier", a.cast("int").alias("a"), z.cast("int").alias("z"))


def coverage(found: DataFrame) -> DataFrame:
    """(doc_id, covered): characters in the union of the spans; each counts from where those before it end."""
    before = F.max("z").over(Window.partitionBy("doc_id").orderBy("a", "z").rowsBetween(Window.unboundedPreceding, -1))
    spans = found.filter("a IS NOT NULL").withColumn("b", F.coalesce(before, F.lit(0)))
    return spans.groupBy("doc_id").agg(F.sum(F.greatest(F.col("z") - F.greatest("a", "b"), F.lit(0))).alias("covered"), F.max("z").alias("last"))


def hits(text: Column, pattern: str) -> Column:
    """Places (from 0) where the pattern matches."""
    gaps = F.transform(F.split(text, pattern), lambda p: F.char_length(p))
    lengths = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda m: F.char_length(m))
    ends = F.zip_with(gaps, lengths, lambda g, n: F.struct(g.alias("g"), n.alias("n")))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))
    walked = F.aggregate(F.filter(ends, lambda e: e["n"].isNotNull()), empty, lambda acc, e: F.struct((acc["end"] + e["g"] + e["n"]).alias("end"), F.concat(acc["at"], F.array(acc["end"] + e["g"])).alias("at")))
    return walked["at"]


def keyword_gaps(found: DataFrame, texts: DataFrame, words: dict[str, str]) -> DataFrame:
    """(doc_id, total_hits, uncovered_hits) of keywords that no quote's span holds."""
    norm = texts.select("doc_id", X.spaces_collapsed(without_headers(F.col("text"))).alias("norm"))
    named_ = lambda w: lambda at: F.struct(F.lit(w).alias("word"), at.alias("at"))
    each = F.concat(*(F.transform(hits(F.col("norm"), p), named_(w)) for w, p in words.items()))
    spans = found.filter("a IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct("a", "z")).alias("spans"), F.max("z").alias("last"))
    places = norm.select("doc_id", F.explode(each).alias("hit")).join(spans, "doc_id", "left")
    near = (F.col("hit.word") != APPENDIX_WORD) | (F.col("hit.at") <= F.coalesce("last", F.lit(0)) + APPENDIX_SLACK)
    held = F.coalesce(F.exists("spans", lambda s: (s["a"] <= F.col("hit.at")) & (F.col("hit.at") < s["z"])), F.lit(False))
    return places.filter(near).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_hits"), count_if(~held).alias("uncovered_hits"))


def status(para: Column, cover: Column, gap: Column, quotes: Column, complete: Column, agenda: Column) -> Column:
    """PASS, REVIEW or FAIL; agendas, of which quotes hold little, aren't judged by coverage."""
    return (
        F.when((quotes == 0) | (complete < 0.5), "FAIL")
        .when(~agenda & (para >= 0.8) & (cover < 0.02), "FAIL")
        .when(~agenda & (cover < 0.03), "REVIEW")
        .when((para >= 0.5) | (gap >= 0.4) | (complete < 0.8), "REVIEW")
        .otherwise("PASS")
    )


def agreement(counted: Column, extracted: Column) -> Column:
    """struct(ratio, flag) of an inventory's count and what was extracted: flagged beyond 0.4 to 2.5, or where only one side has any."""
    c, e = F.coalesce(counted, F.lit(0)), F.coalesce(extracted, F.lit(0))
    ratio = F.when((c == 0) & (e == 0), F.lit(1.0)).when(c == 0, F.lit(float("inf"))).otherwise(F.round(e / F.when(c != 0, c), 3))
    return F.struct(ratio.alias("ratio"), ((ratio < 0.4) | (ratio > 2.5)).alias("flag"))


_TIERS = f"""WITH h AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS norm, regexp_replace(text, '[^a-zA-Z0-9]', '', 'g') AS bare FROM documents WHERE text IS NOT NULL),
    q AS (SELECT doc_id, quote_id, trim(regexp_replace(quote, '\\s+', ' ', 'g')) AS nq, regexp_replace(quote, '[^a-zA-Z0-9]', '', 'g') AS bq FROM quotes WHERE quote IS NOT NULL),
    m AS (SELECT *, instr(norm, nq) AS pos, instr(bare, bq) AS bat FROM q JOIN h USING (doc_id)),
    t AS (SELECT *, CASE WHEN pos > 0 THEN 'full' WHEN length(bq) >= {SHORTEST_BARE} AND bat > 0 THEN 'stripped' ELSE 'paraphrase' END AS tier FROM m),
    p AS (SELECT *, CASE WHEN tier = 'stripped' THEN list_filter(range(length(norm)), lambda i: regexp_matches(norm[i + 1], '[a-zA-Z0-9]')) END AS places FROM t),
    s AS (SELECT doc_id, quote_id, tier, CASE tier WHEN 'full' THEN pos - 1 WHEN 'stripped' THEN places[bat] END AS a, CASE tier WHEN 'full' THEN pos - 1 + length(nq) WHEN 'stripped' THEN places[bat + length(bq) - 1] + 1 END AS z FROM p)"""


@named(f"{_TIERS} SELECT doc_id, quote_id, tier, cast(a AS int) AS a, cast(z AS int) AS z FROM s")
def evidence_tiers(t) -> DataFrame:
    return tiers(t.quotes.filter("quote IS NOT NULL"), t.documents.filter("text IS NOT NULL"))


@named(f"""{_TIERS}, v AS (SELECT *, coalesce(max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s WHERE a IS NOT NULL)
    SELECT tier, count(*) AS quotes, count(DISTINCT doc_id) AS documents FROM s GROUP BY 1""")
def evidence_tier_counts(t) -> DataFrame:
    return evidence_tiers(t).groupBy("tier").agg(F.count(F.lit(1)).alias("quotes"), F.count_distinct("doc_id").alias("documents"))


def _hit_sql(word: str, pattern: str) -> str:
    """Places of a pattern, from the lengths of what stands between its matches."""
    gaps, found = f"regexp_split_to_array(norm, '{pattern}')", f"regexp_extract_all(norm, '{pattern}')"
    return f"SELECT doc_id, '{word}' AS word, unnest(list_transform(range(len({found})), lambda i: coalesce(list_sum(list_transform({gaps}[:i + 1], lambda g: length(g))), 0) + coalesce(list_sum(list_transform({found}[:i], lambda g: length(g))), 0))) AS pos FROM h"


_GAPS = f"""k AS ({' UNION ALL '.join(_hit_sql(w, p) for w, p in PROSE_WORDS.items())}), l AS (SELECT doc_id, max(z) AS last FROM s WHERE a IS NOT NULL GROUP BY 1),
    g AS (SELECT k.doc_id, count(*) AS total_hits, count(CASE WHEN NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = k.doc_id AND s.a <= k.pos AND k.pos < s.z) THEN 1 END) AS uncovered_hits
        FROM k LEFT JOIN l ON l.doc_id = k.doc_id WHERE word <> '{APPENDIX_WORD}' OR k.pos <= coalesce(last, 0) + {APPENDIX_SLACK} GROUP BY 1)"""


@named(f"{_TIERS}, {_GAPS} SELECT doc_id, total_hits, uncovered_hits FROM g")
def evidence_gaps(t) -> DataFrame:
    return keyword_gaps(evidence_tiers(t), t.documents.filter("text IS NOT NULL"), PROSE_WORDS)


@named(f"""{_TIERS}, {_GAPS}, v AS (SELECT *, coalesce(max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s WHERE a IS NOT NULL),
    c AS (SELECT doc_id, sum(greatest(z - greatest(a, b), 0)) AS covered FROM v GROUP BY 1), n AS (SELECT doc_id, count(*) AS entities, count(quote) AS quoted FROM quotes GROUP BY 1), y AS (SELECT doc_id, count(*) AS quotes, count(CASE WHEN tier = 'paraphrase' THEN 1 END) / count(*) AS para FROM s GROUP BY 1),
    x AS (SELECT h.doc_id, coalesce(quotes, 0) AS quotes, coalesce(para, 0) AS para, CASE WHEN length(norm) = 0 THEN 0 ELSE coalesce(covered, 0) / length(norm) END AS cover, coalesce(round(uncovered_hits / total_hits, 4), 0) AS gap, coalesce(round(quoted / entities, 4), 1) AS complete, h.doc_id % 9 = 0 AS agenda
        FROM h LEFT JOIN y USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN n USING (doc_id))
    SELECT doc_id, quotes, para, cover, gap, complete, CASE WHEN quotes = 0 OR complete < 0.5 THEN 'FAIL' WHEN NOT agenda AND para >= 0.8 AND cover < 0.02 THEN 'FAIL' WHEN NOT agenda AND cover < 0.03 THEN 'REVIEW' WHEN para >= 0.5 OR gap >= 0.4 OR complete < 0.8 THEN 'REVIEW' ELSE 'PASS' END AS status FROM x""")
def validation_status(t) -> DataFrame:
    """All measures of each document and its status. An entity is a row of ``quotes``; one without a quote is not quoted."""
    docs = t.documents.filter("text IS NOT NULL")
    found = evidence_tiers(t)
    counts = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("quotes"), (count_if(F.col("tier") == "paraphrase") / F.count(F.lit(1))).alias("para"))
    whole = t.quotes.groupBy("doc_id").agg((F.round(F.count("quote") / F.count(F.lit(1)), 4)).alias("complete"))
    x = docs.select("doc_id", F.char_length(X.spaces_collapsed(without_headers(F.col("text")))).alias("n"))
    for part in (counts, coverage(found).drop("last"), keyword_gaps(found, docs, PROSE_WORDS), whole):
        x = x.join(part, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    x = x.select("doc_id", F.coalesce("quotes", F.lit(0)).alias("quotes"), zero(F.col("para")).alias("para"), F.when(F.col("n") == 0, 0.0).otherwise(zero(F.col("covered") / F.col("n"))).alias("cover"), zero(F.round(F.col("uncovered_hits") / F.col("total_hits"), 4)).alias("gap"), F.coalesce("complete", F.lit(1.0)).alias("complete"))
    return x.withColumn("status", status(*(F.col(c) for c in ("para", "cover", "gap", "quotes", "complete")), F.col("doc_id") % 9 == 0))
