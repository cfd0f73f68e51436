"""Checks of the record against itself: tallies, contradictions, cross-document counts, profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if, ratio
from ..registry import named
from .people import cast_votes


@named("""WITH c AS (SELECT motion_id, count(CASE WHEN choice = 'for' THEN 1 END) AS n_for, count(CASE WHEN choice = 'against' THEN 1 END) AS n_against FROM votes GROUP BY 1),
    j AS (SELECT year, (votes_for IS NULL OR votes_for = n_for) AND (votes_against IS NULL OR votes_against = n_against) AS matched FROM motions m JOIN c ON c.motion_id = m.id WHERE votes_for IS NOT NULL OR votes_against IS NOT NULL)
    SELECT year, count(*) AS checked, count(CASE WHEN matched THEN 1 END) AS matched, CASE WHEN count(*) >= 5 THEN count(CASE WHEN matched THEN 1 END) / count(*) END AS match_rate FROM j GROUP BY 1""")
def tally_reconcile(t) -> DataFrame:
    """A stated count of null says nothing; motions without votes are left out."""
    c = t.votes.groupBy(F.col("motion_id").alias("id")).agg(count_if(F.col("choice") == "for").alias("n_for"), count_if(F.col("choice") == "against").alias("n_against"))
    same = lambda a, b: F.col(a).isNull() | (F.col(a) == F.col(b))
    j = t.motions.filter("votes_for IS NOT NULL OR votes_against IS NOT NULL").join(c, "id").withColumn("ok", same("votes_for", "n_for") & same("votes_against", "n_against"))
    y = j.groupBy("year").agg(F.count(F.lit(1)).alias("checked"), count_if(F.col("ok")).alias("matched"))
    return y.withColumn("match_rate", F.when(F.col("checked") >= 5, F.col("matched") / F.col("checked")))


@named("""SELECT d.id AS declaration_id, d.meeting_id FROM declarations d WHERE item_reference IS NOT NULL AND NOT EXISTS (SELECT 1 FROM motions m WHERE m.meeting_id = d.meeting_id AND trim(m.item_number) = trim(d.item_reference))""")
def orphan_anti(t) -> DataFrame:
    m = t.motions.select("meeting_id", F.trim("item_number").alias("item"))
    return t.declarations.filter("item_reference IS NOT NULL").withColumn("item", F.trim("item_reference")).join(m, ["meeting_id", "item"], "left_anti").select(F.col("id").alias("declaration_id"), "meeting_id")


@named("""SELECT v.id AS vote_id, m.meeting_id FROM votes v JOIN motions m ON m.id = v.motion_id JOIN attendance a ON a.meeting_id = m.meeting_id AND a.councillor_id = v.councillor_id WHERE a.status = 'apology' AND v.choice <> 'absent'""")
def absent_and_voted(t) -> DataFrame:
    away = t.attendance.filter("status = 'apology'").select("meeting_id", "councillor_id")
    m = t.motions.select(F.col("id").alias("motion_id"), "meeting_id")
    return t.votes.filter("choice <> 'absent'").join(m, "motion_id").join(away, ["meeting_id", "councillor_id"], "left_semi").select(F.col("id").alias("vote_id"), "meeting_id")


_OUT = """SELECT v.id AS vote_id, v.councillor_id, m.meeting_id FROM votes v JOIN motions m ON m.id = v.motion_id WHERE v.councillor_id IN (SELECT councillor_id FROM terms)
    AND NOT EXISTS (SELECT 1 FROM terms t WHERE t.councillor_id = v.councillor_id AND (term_start IS NULL OR term_start <= m.meeting_date) AND (term_end IS NULL OR m.meeting_date <= term_end))"""


@named(_OUT.replace("v.id AS vote_id, v.councillor_id, m.meeting_id", "v.councillor_id, count(*) AS n") + " GROUP BY 1")
def out_of_term(t) -> DataFrame:
    """Votes outside every known term, by person; the person is the join key, the dates a residual."""
    held = t.terms.select(F.col("councillor_id").alias("who"), "term_start", "term_end")
    v = cast_votes(t).select("councillor_id", "meeting_date").join(held.select(F.col("who").alias("councillor_id")).distinct(), "councillor_id", "left_semi")
    inside = (F.col("councillor_id") == F.col("who")) & (F.col("term_start").isNull() | (F.col("term_start") <= F.col("meeting_date"))) & (F.col("term_end").isNull() | (F.col("meeting_date") <= F.col("term_end")))
    return v.join(held, inside, "left_anti").groupBy("councillor_id").agg(F.count(F.lit(1)).alias("n"))


@named("""WITH u AS (SELECT id, meeting_id, moved_by_id AS who, 'mover' AS part FROM motions WHERE moved_by_id IS NOT NULL UNION ALL SELECT id, meeting_id, seconded_by_id, 'seconder' FROM motions WHERE seconded_by_id IS NOT NULL)
    SELECT id AS motion_id, who, part FROM u WHERE meeting_id IN (SELECT meeting_id FROM attendance) AND NOT EXISTS (SELECT 1 FROM attendance a WHERE a.meeting_id = u.meeting_id AND a.councillor_id = u.who AND a.status = 'present')""")
def mover_absent(t) -> DataFrame:
    u = t.motions.select("id", "meeting_id", F.expr("stack(2, moved_by_id, 'mover', seconded_by_id, 'seconder') AS (who, part)")).filter("who IS NOT NULL")
    a = t.attendance
    here = a.filter("status = 'present'").select("meeting_id", F.col("councillor_id").alias("who"))
    return u.join(a.select("meeting_id").distinct(), "meeting_id", "left_semi").join(here, ["meeting_id", "who"], "left_anti").select(F.col("id").alias("motion_id"), "who", "part")


@named("""WITH n AS (SELECT m.meeting_id, count(DISTINCT councillor_id) AS voters FROM votes v JOIN motions m ON m.id = v.motion_id GROUP BY 1)
    SELECT m.id AS motion_id, coalesce(votes_for, 0) + coalesce(votes_against, 0) AS stated, voters FROM motions m JOIN n USING (meeting_id) WHERE coalesce(votes_for, 0) + coalesce(votes_against, 0) > voters""")
def tally_exceeds(t) -> DataFrame:
    n = cast_votes(t).groupBy("meeting_id").agg(F.count_distinct("councillor_id").alias("voters"))
    stated = F.coalesce("votes_for", F.lit(0)) + F.coalesce("votes_against", F.lit(0))
    return t.motions.join(n, "meeting_id").select(F.col("id").alias("motion_id"), stated.alias("stated"), "voters").filter("stated > voters")


@named(f"""SELECT 'absent_and_voted' AS class, count(*) AS n FROM votes v JOIN motions m ON m.id = v.motion_id JOIN attendance a ON a.meeting_id = m.meeting_id AND a.councillor_id = v.councillor_id WHERE a.status = 'apology' AND v.choice <> 'absent'
    UNION ALL SELECT 'orphan_declaration', count(*) FROM declarations d WHERE item_reference IS NOT NULL AND NOT EXISTS (SELECT 1 FROM motions m WHERE m.meeting_id = d.meeting_id AND trim(m.item_number) = trim(d.item_reference))
    UNION ALL SELECT 'out_of_term', count(*) FROM ({_OUT}) o""")
def contradiction_sweep(t) -> DataFrame:
    n = lambda df, name, k: df.agg(k.cast("long").alias("n")).select(F.lit(name).alias("class"), F.coalesce("n", F.lit(0)).alias("n"))
    one = F.count(F.lit(1))
    return n(absent_and_voted(t), "absent_and_voted", one).unionByName(n(orphan_anti(t), "orphan_declaration", one)).unionByName(n(out_of_term(t), "out_of_term", F.sum("n")))


@named("""WITH p AS (SELECT meeting_id, count(*) AS present FROM attendance WHERE status = 'present' GROUP BY 1), v AS (SELECT m.meeting_id, count(DISTINCT councillor_id) AS voters FROM votes v JOIN motions m ON m.id = v.motion_id WHERE choice <> 'absent' GROUP BY 1)
    SELECT count(*) AS checked, count(CASE WHEN voters <= present THEN 1 END) AS reconciled, count(CASE WHEN voters <= present THEN 1 END) / count(*) AS rate FROM v JOIN p USING (meeting_id)""")
def attendance_vs_votes(t) -> DataFrame:
    p = t.attendance.filter("status = 'present'").groupBy("meeting_id").agg(F.count(F.lit(1)).alias("present"))
    v = cast_votes(t).filter("choice <> 'absent'").groupBy("meeting_id").agg(F.count_distinct("councillor_id").alias("voters"))
    ok = F.col("voters") <= F.col("present")
    return v.join(p, "meeting_id").agg(F.count(F.lit(1)).alias("checked"), count_if(ok).alias("reconciled"), (count_if(ok) / F.count(F.lit(1))).alias("rate"))


@named("""SELECT count(DISTINCT councillor_id) AS voters, count(DISTINCT CASE WHEN councillor_id IN (SELECT councillor_id FROM terms) THEN councillor_id END) AS with_terms FROM votes""")
def term_coverage(t) -> DataFrame:
    v = t.votes.select("councillor_id").distinct()
    k = t.terms.select("councillor_id").distinct().withColumn("k", F.lit(True))
    return v.join(k, "councillor_id", "left").agg(F.count(F.lit(1)).alias("voters"), count_if(F.col("k")).alias("with_terms"))


@named("""SELECT document_type, count(*) AS n, cast(min(meeting_date) AS string) AS first, cast(max(meeting_date) AS string) AS last FROM meetings GROUP BY 1""")
def corpus_span(t) -> DataFrame:
    return t.meetings.groupBy("document_type").agg(F.count(F.lit(1)).alias("n"), F.min("meeting_date").cast("string").alias("first"), F.max("meeting_date").cast("string").alias("last"))


@named("""WITH s AS (SELECT unnest(generate_series(min(meeting_date)::TIMESTAMP, TIMESTAMP '2002-12-01', INTERVAL 1 MONTH)) AS m FROM meetings), h AS (SELECT DISTINCT year(meeting_date) * 100 + month(meeting_date) AS ym FROM meetings)
    SELECT year(m) * 100 + month(m) AS ym FROM s WHERE year(m) * 100 + month(m) NOT IN (SELECT ym FROM h)""")
def missing_months(t) -> DataFrame:
    ym = lambda c: F.year(c) * 100 + F.month(c)
    spine = t.meetings.agg(F.min("meeting_date").alias("a")).select(F.explode(F.sequence("a", F.lit("2002-12-01").cast("date"), F.expr("interval 1 month"))).alias("m")).select(ym("m").alias("ym"))
    return spine.join(t.meetings.select(ym("meeting_date").alias("ym")).distinct(), "ym", "left_anti")


@named("""SELECT (SELECT avg(CASE WHEN votes_for IS NULL THEN 1.0 ELSE 0 END) FROM motions) AS stated_for_null, (SELECT avg(CASE WHEN amount IS NULL THEN 1.0 ELSE 0 END) FROM tenders) AS tender_amount_null, (SELECT avg(CASE WHEN is_confidential THEN 1.0 ELSE 0 END) FROM tenders) AS tender_confidential,
    (SELECT avg(CASE WHEN declared_interest THEN 1.0 ELSE 0 END) FROM votes) AS declared, (SELECT count(DISTINCT submitter) / count(*) FROM submissions) AS distinct_submitters""")
def null_rates(t) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    parts = [
        t.motions.agg(share(F.col("votes_for").isNull()).alias("stated_for_null")),
        t.tenders.agg(share(F.col("amount").isNull()).alias("tender_amount_null"), share(F.col("is_confidential")).alias("tender_confidential")),
        t.votes.agg(share(F.col("declared_interest")).alias("declared")),
        t.submissions.agg((F.count_distinct("submitter") / F.count(F.lit(1))).alias("distinct_submitters")),
    ]
    out = parts[0].withColumn("k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("k", F.lit(1)), "k")
    return out.drop("k")


TABLES = ("councillors", "meetings", "motions", "votes", "applications", "submissions", "tenders", "declarations", "deputations", "petitions", "questions", "budget_items", "appointments", "other_items")


@named(" UNION ALL ".join(f"SELECT '{n}' AS entity, count(*) AS n FROM {n}" for n in TABLES))
def entity_counts(t) -> DataFrame:
    out = None
    for n in TABLES:
        one = getattr(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("entity"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@named("SELECT lower(trim(family_name)) AS family, count(*) AS n FROM councillors GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(t) -> DataFrame:
    return t.councillors.groupBy(F.lower(F.trim("family_name")).alias("family")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@named("""SELECT (SELECT count(*) FROM councillors) AS councillors, count(CASE WHEN has_term THEN 1 END) AS with_terms, count(CASE WHEN has_vote THEN 1 END) AS with_votes, count(CASE WHEN NOT has_term AND NOT has_vote THEN 1 END) AS with_neither
    FROM (SELECT id IN (SELECT councillor_id FROM terms) AS has_term, id IN (SELECT councillor_id FROM votes) AS has_vote FROM councillors) x""")
def identity_resolution(t) -> DataFrame:
    flag = lambda df, n: df.select(F.col("councillor_id").alias("id")).distinct().withColumn(n, F.lit(True))
    c = t.councillors.select("id").join(flag(t.terms, "a"), "id", "left").join(flag(t.votes, "b"), "id", "left")
    return c.agg(F.count(F.lit(1)).alias("councillors"), F.count("a").alias("with_terms"), F.count("b").alias("with_votes"), count_if(F.col("a").isNull() & F.col("b").isNull()).alias("with_neither"))


@named("SELECT DISTINCT meeting_type FROM meetings EXCEPT SELECT unnest(['ordinary', 'special', 'committee'])")
def unmapped_types(t) -> DataFrame:
    known = t.meetings.sparkSession.createDataFrame([("ordinary",), ("special",), ("committee",)], "meeting_type string")
    return t.meetings.select("meeting_type").distinct().join(F.broadcast(known), "meeting_type", "left_anti")


@named("""WITH y AS (SELECT year(meeting_date) AS y, month(meeting_date) AS m FROM meetings GROUP BY 1, 2), s AS (SELECT DISTINCT y.y, g.m FROM y, (SELECT unnest(range(2, 13)) AS m) g), a AS (SELECT s.* FROM s ANTI JOIN y ON s.y = y.y AND s.m = y.m),
    i AS (SELECT y, m, m - row_number() OVER (PARTITION BY y ORDER BY m) AS g FROM a) SELECT y AS year, max(n) AS longest_gap FROM (SELECT y, g, count(*) AS n FROM i GROUP BY 1, 2) x GROUP BY 1""")
def longest_month_gap(t) -> DataFrame:
    """Longest run of absent months from February to December in each year: a spine, an anti join, gaps and islands."""
    from pyspark.sql import Window

    y = t.meetings.select(F.year("meeting_date").alias("year"), F.month("meeting_date").alias("m")).distinct()
    spine = y.select("year").distinct().select("year", F.explode(F.sequence(F.lit(2), F.lit(12))).alias("m"))
    absent = spine.join(y, ["year", "m"], "left_anti").withColumn("g", F.col("m") - F.row_number().over(Window.partitionBy("year").orderBy("m")))
    return absent.groupBy("year", "g").agg(F.count(F.lit(1)).alias("n")).groupBy("year").agg(F.max("n").alias("longest_gap"))
