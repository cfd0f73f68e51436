"""Capped lists behind the aggregates: the newest or largest rows of each group, ties by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import top
from ..registry import named
from .conflicts import linked, _LINKED
from .people import cast_votes
from .procurement import awards, _KEY, _PLACE


def _sql(source: str, group: str, order: str, cap: int, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM ({source}) x) y WHERE rn <= {cap}"


_CLOSED = "SELECT 'tender' AS source, year, meeting_id, id FROM tenders WHERE is_confidential UNION ALL SELECT 'budget', year, meeting_id, id FROM budget_items WHERE is_confidential UNION ALL SELECT 'other', year, meeting_id, id FROM other_items WHERE is_confidential"


@named(_sql(_CLOSED, "source, year", "meeting_id DESC, id DESC", 30, "source, year, id"))
def evidence_transparency(t) -> DataFrame:
    part = lambda df, n: df.filter("is_confidential").select(F.lit(n).alias("source"), "year", "meeting_id", "id")
    rows = part(t.tenders, "tender").unionByName(part(t.budget_items, "budget")).unionByName(part(t.other_items, "other"))
    return top(rows, ["source", "year"], [F.desc("meeting_id"), F.desc("id")], 30).select("source", "year", "id")


@named(_sql("SELECT 'deputation' AS source, cast(floor(meeting_id / 10000) AS int) AS year, meeting_id, id FROM deputations UNION ALL SELECT 'petition', cast(floor(meeting_id / 10000) AS int), meeting_id, id FROM petitions", "source, year", "meeting_id DESC, id DESC", 10, "source, year, id"))
def evidence_participation(t) -> DataFrame:
    part = lambda df, n: df.select(F.lit(n).alias("source"), F.floor(F.col("meeting_id") / 10000).cast("int").alias("year"), "meeting_id", "id")
    return top(part(t.deputations, "deputation").unionByName(part(t.petitions, "petition")), ["source", "year"], [F.desc("meeting_id"), F.desc("id")], 10).select("source", "year", "id")


_BIN = "CASE WHEN amount < 200000 THEN 'under' WHEN amount < 250000 THEN 'below' WHEN amount < 300000 THEN 'above' ELSE 'over' END"


@named(_sql(f"SELECT id, amount, {_BIN} AS bin FROM tenders WHERE amount IS NOT NULL", "bin", "amount DESC, id", 30, "bin, id, amount"))
def evidence_threshold(t) -> DataFrame:
    a = F.col("amount")
    rows = t.tenders.filter("amount IS NOT NULL").select("id", "amount", F.when(a < 200_000, "under").when(a < 250_000, "below").when(a < 300_000, "above").otherwise("over").alias("bin"))
    return top(rows, ["bin"], [F.desc("amount"), F.col("id")], 30).select("bin", "id", "amount")


@named(_sql("SELECT id, month, amount FROM tenders WHERE amount IS NOT NULL", "month", "amount DESC, id", 30, "month, id"))
def evidence_eoy(t) -> DataFrame:
    return top(t.tenders.filter("amount IS NOT NULL").select("id", "month", "amount"), ["month"], [F.desc("amount"), F.col("id")], 30).select("month", "id")


@named(_sql("SELECT id, amount, is_confidential FROM tenders WHERE amount IS NOT NULL", "is_confidential", "amount DESC, id", 30, "is_confidential, id"))
def evidence_confidential_tenders(t) -> DataFrame:
    return top(t.tenders.filter("amount IS NOT NULL").select("id", "amount", "is_confidential"), ["is_confidential"], [F.desc("amount"), F.col("id")], 30).select("is_confidential", "id")


@named(_sql("SELECT id, year, meeting_date FROM motions WHERE outcome = 'carried' AND votes_against >= 1", "year", "meeting_date DESC, id DESC", 30, "year, id"))
def evidence_unanimity(t) -> DataFrame:
    return top(t.motions.filter("outcome = 'carried' AND votes_against >= 1").select("id", "year", "meeting_date"), ["year"], [F.desc("meeting_date"), F.desc("id")], 30).select("year", "id")


@named(_sql("SELECT a.id, status, count(s.application_id) AS n FROM applications a LEFT JOIN submissions s ON s.application_id = a.id AND s.position = 'object' WHERE status IN ('approved', 'refused') GROUP BY 1, 2", "CASE WHEN n = 0 THEN 0 WHEN n = 1 THEN 1 WHEN n <= 4 THEN 2 ELSE 3 END", "n DESC, id", 30, "id, n"))
def evidence_objections(t) -> DataFrame:
    n = t.submissions.filter("position = 'object'").groupBy(F.col("application_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    a = t.applications.filter("status IN ('approved', 'refused')").select("id").join(n, "id", "left").fillna(0, ["n"])
    a = a.withColumn("g", F.when(F.col("n") == 0, 0).when(F.col("n") == 1, 1).when(F.col("n") <= 4, 2).otherwise(3))
    return top(a, ["g"], [F.desc("n"), F.col("id")], 30).select("id", "n")


@named(_sql("SELECT id, estimated_value, CASE WHEN times = 1 THEN '1' WHEN times <= 3 THEN '2-3' WHEN times <= 6 THEN '4-6' ELSE '7+' END AS g FROM (SELECT *, count(*) OVER (PARTITION BY applicant_name) AS times FROM applications) z", "g", "estimated_value DESC, id", 30, "g, id"))
def evidence_repeat_applicant(t) -> DataFrame:
    times = t.applications.groupBy("applicant_name").agg(F.count(F.lit(1)).alias("times"))
    g = F.when(F.col("times") == 1, "1").when(F.col("times") <= 3, "2-3").when(F.col("times") <= 6, "4-6").otherwise("7+")
    return top(t.applications.join(times, "applicant_name").select("id", "estimated_value", g.alias("g")), ["g"], [F.desc("estimated_value"), F.col("id")], 30).select("g", "id")


@named(f"""WITH f AS (SELECT {_KEY} AS firm, count(DISTINCT year) AS years FROM tenders WHERE NOT {_PLACE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) """ + _sql(f"SELECT t.id, f.firm, amount FROM tenders t JOIN f ON f.firm = {_KEY}", "firm", "amount DESC NULLS LAST, id", 5, "firm, id"))
def evidence_incumbency(t) -> DataFrame:
    f = awards(t).filter("NOT hidden").groupBy("firm").agg(F.count_distinct("year").alias("years")).orderBy(F.desc("years"), "firm").limit(10).select("firm")
    return top(awards(t).join(F.broadcast(f), "firm", "left_semi"), ["firm"], [F.desc_nulls_last("amount"), F.col("id")], 5).select("firm", "id")


@named(f"SELECT councillor_id, vote_id FROM ({_sql(f'SELECT l.* FROM ({_LINKED}) l WHERE declaration_id IS NOT NULL', 'councillor_id', 'meeting_id DESC, vote_id DESC', 10, '*')}) z")
def evidence_recusal(t) -> DataFrame:
    return top(linked(t).filter("declaration_id IS NOT NULL"), ["councillor_id"], [F.desc("meeting_id"), F.desc("vote_id")], 10).select("councillor_id", "vote_id")


@named(_sql("SELECT v.id, v.declared_interest, m.meeting_date FROM votes v JOIN motions m ON m.id = v.motion_id WHERE choice = 'absent'", "declared_interest", "meeting_date DESC, id DESC", 30, "declared_interest, id"))
def evidence_attendance(t) -> DataFrame:
    m = t.motions.select(F.col("id").alias("motion_id"), "meeting_date")
    return top(t.votes.filter("choice = 'absent'").join(m, "motion_id"), ["declared_interest"], [F.desc("meeting_date"), F.desc("id")], 30).select("declared_interest", "id")


@named(_sql("SELECT m.id, d.meeting_id IS NOT NULL AS heard, meeting_date FROM motions m LEFT JOIN (SELECT DISTINCT meeting_id FROM deputations) d ON d.meeting_id = m.meeting_id WHERE outcome = 'carried' AND votes_against >= 1", "heard", "meeting_date DESC, id DESC", 30, "heard, id"))
def evidence_deputation(t) -> DataFrame:
    d = t.deputations.select("meeting_id").distinct().withColumn("h", F.lit(True))
    m = t.motions.filter("outcome = 'carried' AND votes_against >= 1").join(d, "meeting_id", "left").withColumn("heard", F.coalesce("h", F.lit(False)))
    return top(m, ["heard"], [F.desc("meeting_date"), F.desc("id")], 30).select("heard", "id")


@named(_sql("SELECT v.id, m.moved_by_id AS mover, m.meeting_date FROM votes v JOIN motions m ON m.id = v.motion_id WHERE choice = 'against' AND outcome = 'carried' AND moved_by_id % 10 = 0", "mover", "meeting_date DESC, id DESC", 30, "mover, id"))
def evidence_chair(t) -> DataFrame:
    m = t.motions.filter("outcome = 'carried' AND moved_by_id % 10 = 0").select(F.col("id").alias("motion_id"), F.col("moved_by_id").alias("mover"), "meeting_date")
    return top(t.votes.filter("choice = 'against'").join(m, "motion_id"), ["mover"], [F.desc("meeting_date"), F.desc("id")], 30).select("mover", "id")


@named("SELECT 'vote' AS entity_table, count(*) AS n, count(DISTINCT m.meeting_id) AS meetings FROM votes v JOIN motions m ON m.id = v.motion_id UNION ALL SELECT 'tender', count(*), count(DISTINCT meeting_id) FROM tenders UNION ALL SELECT 'declaration', count(*), count(DISTINCT meeting_id) FROM declarations")
def resolve_entities(t) -> DataFrame:
    """Any entity to its meeting: a union of key maps, one join."""
    m = t.motions.select(F.col("id").alias("motion_id"), "meeting_id")
    keys = t.votes.join(m, "motion_id").select(F.lit("vote").alias("entity_table"), "meeting_id")
    for df, name in ((t.tenders, "tender"), (t.declarations, "declaration")):
        keys = keys.unionByName(df.select(F.lit(name).alias("entity_table"), "meeting_id"))
    return keys.groupBy("entity_table").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("meeting_id").alias("meetings"))
