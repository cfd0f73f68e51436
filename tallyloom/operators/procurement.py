"""Tender awards: concentration, incumbency, thresholds, calendar, confidentiality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, ratio
from ..functions.text import firm_key, is_placeholder, reference_key
from ..registry import named

_KEY = "lower(trim(awarded_to))"
for _ending in (" pty ltd", " pty. ltd.", " pty ltd.", " ltd", " pty", " p/l"):
    _KEY = f"replace({_KEY}, '{_ending}', '')"
_KEY = f"regexp_replace({_KEY}, '[.,\\s]', '', 'g')"
_PLACE = "regexp_matches(lower(trim(awarded_to)), '^(respondent|tenderer|contractor|supplier|bidder|proponent|applicant|submitter|company|party|entity)\\b[\\s\\-#:.]*\\d*$')"
_REF = "regexp_replace(lower(reference_number), '[^a-z0-9]', '', 'g')"


def awards(t) -> DataFrame:
    """Tenders with firm key and placeholder flag."""
    return t.tenders.withColumn("firm", firm_key(F.col("awarded_to"))).withColumn("ref", reference_key(F.col("reference_number"))).withColumn("hidden", is_placeholder(F.col("awarded_to")))


def awards_once(t) -> DataFrame:
    """One row for each firm, reference and amount, of the smallest id; rows without a key all stay."""
    w = Window.partitionBy("firm", "ref", "amount").orderBy("id")
    return awards(t).withColumn("rn", F.when((F.col("firm") == "") | (F.col("ref") == ""), 1).otherwise(F.row_number().over(w))).filter("rn = 1").drop("rn")


_ONCE = f"""SELECT * FROM (SELECT *, {_KEY} AS firm, {_REF} AS ref, {_PLACE} AS hidden, row_number() OVER (PARTITION BY {_KEY}, {_REF}, amount ORDER BY id) AS rn FROM tenders) x WHERE rn = 1"""


@named(f"SELECT id, {_KEY} AS firm, {_REF} AS ref, {_PLACE} AS hidden, amount IS NOT NULL AS value_recorded FROM tenders")
def firm_normalise(t) -> DataFrame:
    return awards(t).select("id", "firm", "ref", "hidden", F.col("amount").isNotNull().alias("value_recorded"))


@named(f"""WITH a AS ({_ONCE}), f AS (SELECT firm, sum(amount) AS total, count(*) AS n FROM a WHERE NOT hidden GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, firm) AS rn FROM f WHERE total IS NOT NULL)
    SELECT (SELECT count(*) FROM a) AS total_awards, (SELECT round(sum(amount), 2) FROM a) AS total_amount, (SELECT count(*) FROM a WHERE hidden) AS redacted_awards, (SELECT count(*) FROM f) AS distinct_named,
    round(sum(CASE WHEN rn <= 10 THEN total END), 2) AS top10_amount, round(sum(CASE WHEN rn <= 10 THEN total END) / sum(total), 9) AS top10_share FROM r""")
def tender_concentration(t) -> DataFrame:
    a = awards_once(t)
    whole = a.agg(F.count(F.lit(1)).alias("total_awards"), F.round(F.sum("amount"), 2).alias("total_amount"), count_if(F.col("hidden")).alias("redacted_awards"))
    f = a.filter("NOT hidden").groupBy("firm").agg(F.sum("amount").alias("total"))
    best = f.orderBy(F.desc_nulls_last("total"), "firm").limit(10).agg(F.sum("total").alias("best"))
    firms = f.agg(F.count(F.lit(1)).alias("distinct_named"), F.sum("total").alias("all"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(whole).join(one(firms), "one").join(one(best), "one").select("total_awards", "total_amount", "redacted_awards", "distinct_named", F.round("best", 2).alias("top10_amount"), F.round(ratio(F.col("best"), F.col("all")), 9).alias("top10_share"))


@named(f"""WITH a AS ({_ONCE}) SELECT firm, count(*) AS n_awards, round(sum(amount), 2) AS total_amount FROM a WHERE NOT hidden GROUP BY 1 ORDER BY sum(amount) DESC NULLS LAST, firm LIMIT 15""")
def top_firms(t) -> DataFrame:
    f = awards_once(t).filter("NOT hidden").groupBy("firm").agg(F.count(F.lit(1)).alias("n_awards"), F.sum("amount").alias("s"))
    return f.orderBy(F.desc_nulls_last("s"), "firm").limit(15).select("firm", "n_awards", F.round("s", 2).alias("total_amount"))


@named(f"""SELECT {_KEY} AS firm, arg_max(awarded_to, (length(awarded_to), -id)) AS display_name, count(DISTINCT awarded_to) AS spellings FROM tenders GROUP BY 1 HAVING count(DISTINCT awarded_to) > 1""")
def supplier_spellings(t) -> DataFrame:
    """The longest spelling of a firm stands for it; of equals the one of the smallest id."""
    return awards(t).groupBy("firm").agg(F.max_by("awarded_to", F.struct(F.char_length("awarded_to"), -F.col("id"))).alias("display_name"), F.count_distinct("awarded_to").alias("spellings")).filter("spellings > 1")


@named(f"""SELECT round(sum(share * share), 12) AS hhi, count(*) AS firms FROM (SELECT sum(amount) / sum(sum(amount)) OVER () AS share FROM tenders WHERE amount IS NOT NULL GROUP BY {_KEY}) x""")
def herfindahl(t) -> DataFrame:
    f = awards(t).filter("amount IS NOT NULL").groupBy("firm").agg(F.sum("amount").alias("s"))
    return f.agg(F.round(F.sum(F.col("s") * F.col("s")) / (F.sum("s") * F.sum("s")), 12).alias("hhi"), F.count(F.lit(1)).alias("firms"))


@named("""SELECT CASE WHEN amount < 200000 THEN 'under' WHEN amount < 250000 THEN 'just below' WHEN amount < 300000 THEN 'just above' ELSE 'over' END AS bin, count(*) AS n FROM tenders WHERE amount IS NOT NULL AND year >= 1996 GROUP BY 1""")
def threshold_bins(t) -> DataFrame:
    a = F.col("amount")
    bin_ = F.when(a < 200_000, "under").when(a < 250_000, "just below").when(a < 300_000, "just above").otherwise("over")
    return t.tenders.filter("amount IS NOT NULL AND year >= 1996").groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@named(f"""WITH f AS (SELECT {_KEY} AS firm, count(DISTINCT year) AS years, sum(amount) AS total FROM tenders WHERE NOT {_PLACE} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC NULLS LAST, firm) AS dollars FROM f)
    SELECT firm, years, dollars <= 10 AS top10, years >= 4 AS repeat_winner FROM r WHERE years >= 4 OR dollars <= 10""")
def incumbency(t) -> DataFrame:
    f = awards(t).filter("NOT hidden").groupBy("firm").agg(F.count_distinct("year").alias("years"), F.sum("amount").alias("total"))
    best = f.orderBy(F.desc_nulls_last("total"), "firm").limit(10).select("firm", F.lit(True).alias("best"))
    return f.join(F.broadcast(best), "firm", "left").select("firm", "years", F.coalesce("best", F.lit(False)).alias("top10"), (F.col("years") >= 4).alias("repeat_winner")).filter("top10 OR repeat_winner")


@named("""SELECT round(sum(CASE WHEN (month - 7 + 12) % 12 >= 10 THEN amount ELSE 0 END) / sum(amount), 12) AS dollar_share, count(CASE WHEN (month - 7 + 12) % 12 >= 10 THEN 1 END) / count(*) AS count_share FROM tenders WHERE amount IS NOT NULL""")
def eoy_share(t) -> DataFrame:
    late = (F.col("month") - 7 + 12) % 12 >= 10
    a = t.tenders.filter("amount IS NOT NULL")
    return a.agg(F.round(F.sum(F.when(late, F.col("amount")).otherwise(0)) / F.sum("amount"), 12).alias("dollar_share"), (count_if(late) / F.count(F.lit(1))).alias("count_share"))


@named("""SELECT is_confidential, count(*) AS n, median(amount) AS median_amount FROM tenders WHERE amount IS NOT NULL GROUP BY 1""")
def confidential_median(t) -> DataFrame:
    return t.tenders.filter("amount IS NOT NULL").groupBy("is_confidential").agg(F.count(F.lit(1)).alias("n"), F.percentile("amount", F.lit(0.5)).alias("median_amount"))


@named("""WITH w AS (SELECT DISTINCT id, regexp_extract(upper(awarded_to), '([0-9]+)', 1) AS digits FROM tenders), p AS (SELECT id, regexp_extract(slug, '([0-9]+)', 1) AS digits FROM councillors)
    SELECT p.id AS councillor_id, count(*) AS collisions FROM w JOIN p USING (digits) WHERE digits <> '' GROUP BY 1""")
def decider_supplier_collisions(t) -> DataFrame:
    """Winners that share a name token with a voter: an equi join on tokens, not a regex against all names."""
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1)
    w = t.tenders.select("id", number("awarded_to").alias("digits")).filter("digits <> ''").distinct().select("digits")
    p = t.councillors.select(F.col("id").alias("councillor_id"), number("slug").alias("digits"))
    return w.join(p, "digits").groupBy("councillor_id").agg(F.count(F.lit(1)).alias("collisions"))


@named("""WITH s AS (SELECT family_name, count(*) AS hits FROM councillors GROUP BY 1), n AS (SELECT count(*) AS people FROM councillors), a AS (SELECT count(*) AS awards FROM tenders) SELECT family_name, hits / people * awards AS expected FROM s, n, a""")
def surname_chance_baseline(t) -> DataFrame:
    s = t.councillors.groupBy("family_name").agg(F.count(F.lit(1)).alias("hits"))
    one = t.councillors.agg(F.count(F.lit(1)).alias("people")).withColumn("k", F.lit(1)).join(t.tenders.agg(F.count(F.lit(1)).alias("awards")).withColumn("k", F.lit(1)), "k")
    return s.withColumn("k", F.lit(1)).join(F.broadcast(one), "k").select("family_name", (F.col("hits") / F.col("people") * F.col("awards")).alias("expected"))


@named("""WITH w AS (SELECT DISTINCT id, regexp_extract(awarded_to, '([0-9]+)', 1) AS digits FROM tenders), c AS (SELECT count(*) AS collisions FROM w JOIN councillors p ON regexp_extract(p.slug, '([0-9]+)', 1) = digits WHERE digits <> ''),
    s AS (SELECT family_name, count(*) AS hits FROM councillors GROUP BY 1) SELECT collisions, (SELECT sum(hits) FROM s) / (SELECT count(*) FROM councillors) * (SELECT count(*) FROM tenders) AS expected FROM c""")
def collisions_against_chance(t) -> DataFrame:
    """Name matches of winners and voters, and how many chance alone would give over all surnames."""
    found = decider_supplier_collisions(t).agg(F.coalesce(F.sum("collisions"), F.lit(0)).alias("collisions"), F.lit(1).alias("k"))
    chance = surname_chance_baseline(t).agg(F.sum("expected").alias("expected"), F.lit(1).alias("k"))
    return found.join(chance, "k").select("collisions", "expected")
