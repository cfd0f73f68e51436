"""Meeting scope in one grouped pass: values, baselines, novelty, exceptions, the period digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if
from ..functions.stats import midrank_percentile
from ..registry import named

MIN_MEETINGS = 8
# Defaults of this library: what makes a value of a test an exception.
THRESHOLDS = {"contested": ("any_occurrence", 1.0), "absence": ("percentile", 0.95), "dissent": ("ratio", 2.0), "closed": ("absolute", 0.75)}

_VALUES = """SELECT 'contested' AS test_id, meeting_id, cast(count(CASE WHEN outcome = 'carried' AND votes_against >= 2 THEN 1 END) AS double) AS value FROM motions GROUP BY 2
    UNION ALL SELECT 'absence', m.meeting_id, count(CASE WHEN choice = 'absent' THEN 1 END) / cast(count(*) AS double) FROM votes v JOIN motions m ON m.id = v.motion_id GROUP BY 2
    UNION ALL SELECT 'dissent', m.meeting_id, count(CASE WHEN choice = 'against' THEN 1 END) / cast(count(*) AS double) FROM votes v JOIN motions m ON m.id = v.motion_id GROUP BY 2
    UNION ALL SELECT 'closed', meeting_id, count(CASE WHEN is_confidential THEN 1 END) / cast(count(*) AS double) FROM other_items GROUP BY 2"""
_BODY = "CASE g.meeting_type WHEN 'ordinary' THEN 'council' WHEN 'special' THEN 'council' WHEN 'committee' THEN 'committee' ELSE 'unknown' END"
_WITH = f"SELECT x.test_id, x.meeting_id, x.value, {_BODY} AS body, cast(g.meeting_date AS string) AS meeting_date FROM ({_VALUES}) x JOIN meetings g ON g.id = x.meeting_id WHERE g.document_type = 'minutes'"


def values(t) -> DataFrame:
    """A row for each test and minutes meeting: value and body class (unmapped types are ``unknown``)."""
    m = t.motions.select(F.col("id").alias("motion_id"), "meeting_id")
    v = t.votes.select("motion_id", "choice").join(m, "motion_id").groupBy("meeting_id").agg(F.count(F.lit(1)).cast("double").alias("n"), count_if(F.col("choice") == "absent").alias("a"), count_if(F.col("choice") == "against").alias("d"))
    c = t.motions.groupBy("meeting_id").agg(count_if((F.col("outcome") == "carried") & (F.col("votes_against") >= 2)).cast("double").alias("value")).select(F.lit("contested").alias("test_id"), "meeting_id", "value")
    rates = v.select("meeting_id", F.expr("stack(2, 'absence', a / n, 'dissent', d / n) AS (test_id, value)")).select("test_id", "meeting_id", "value")
    closed = t.other_items.groupBy("meeting_id").agg((count_if(F.col("is_confidential")) / F.count(F.lit(1)).cast("double")).alias("value")).select(F.lit("closed").alias("test_id"), "meeting_id", "value")
    kind = F.when(F.col("meeting_type").isin("ordinary", "special"), "council").when(F.col("meeting_type") == "committee", "committee").otherwise("unknown")
    g = t.meetings.filter("document_type = 'minutes'").select(F.col("id").alias("meeting_id"), kind.alias("body"), F.col("meeting_date").cast("string").alias("meeting_date"))
    return c.unionByName(rates).unionByName(closed).join(g, "meeting_id").select("test_id", "meeting_id", "value", "body", "meeting_date")


@named(_WITH)
def meeting_values(t) -> DataFrame:
    return values(t)


_BASE = f"SELECT test_id, body, count(*) AS n_meetings, median(value) AS median_value FROM ({_WITH}) w GROUP BY 1, 2"


@named(_BASE)
def baseline_median(t) -> DataFrame:
    return values(t).groupBy("test_id", "body").agg(F.count(F.lit(1)).alias("n_meetings"), F.percentile("value", F.lit(0.5)).alias("median_value"))


_RANKED = f"""SELECT w.*, b.n_meetings, b.median_value, 2 * abs((u.below + 0.5e0 * u.equal) / b.n_meetings - 0.5e0) AS novelty FROM ({_WITH}) w JOIN ({_BASE}) b USING (test_id, body)
    JOIN (SELECT test_id, body, value, equal, coalesce(sum(equal) OVER (PARTITION BY test_id, body ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT test_id, body, value, count(*) AS equal FROM ({_WITH}) w GROUP BY 1, 2, 3) e) u USING (test_id, body, value)"""


def ranked(t) -> DataFrame:
    """Values with their two-sided midrank percentile within test and body.

    Ranks come from the counts of equal values: the window runs over distinct
    values, not over meetings.
    """
    v = values(t)
    base = v.groupBy("test_id", "body").agg(F.count(F.lit(1)).alias("n_meetings"), F.percentile("value", F.lit(0.5)).alias("median_value"))
    equal = v.groupBy("test_id", "body", "value").agg(F.count(F.lit(1)).alias("equal"))
    w = Window.partitionBy("test_id", "body").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = equal.withColumn("below", F.coalesce(F.sum("equal").over(w), F.lit(0)))
    out = v.join(base, ["test_id", "body"]).join(below, ["test_id", "body", "value"])
    return out.withColumn("novelty", midrank_percentile(F.col("below"), F.col("equal"), F.col("n_meetings"))).drop("below", "equal")


@named(f"SELECT test_id, meeting_id, novelty FROM ({_RANKED}) r")
def midrank_percentiles(t) -> DataFrame:
    return ranked(t).select("test_id", "meeting_id", "novelty")


_FIRES = f"""CASE test_id WHEN 'contested' THEN value >= 1 WHEN 'absence' THEN n_meetings >= {MIN_MEETINGS} AND novelty >= 0.95 WHEN 'dissent' THEN n_meetings >= {MIN_MEETINGS} AND CASE WHEN median_value = 0 THEN value > 0 ELSE value / median_value >= 2 END ELSE value >= 0.75 END"""


def fires() -> Column:
    """Whether a value is an exception under its test's threshold; percentile and ratio need a baseline of enough meetings."""
    thick = F.col("n_meetings") >= MIN_MEETINGS
    rules = {
        "any_occurrence": lambda x: F.col("value") >= x,
        "percentile": lambda x: thick & (F.col("novelty") >= x),
        "ratio": lambda x: thick & F.when(F.col("median_value") == 0, F.col("value") > 0).otherwise(F.col("value") / F.col("median_value") >= x),
        "absolute": lambda x: F.col("value") >= x,
    }
    out = F.lit(False)
    for test, (kind, x) in THRESHOLDS.items():
        out = F.when(F.col("test_id") == test, rules[kind](x)).otherwise(out)
    return out


@named(f"SELECT test_id, meeting_id, body, value FROM ({_RANKED}) r WHERE {_FIRES}")
def watch_feed(t) -> DataFrame:
    """Exceptions of all meetings at once: no loop over meetings."""
    return ranked(t).filter(fires()).select("test_id", "meeting_id", "body", "value")


@named(f"SELECT test_id, meeting_id, novelty AS salience FROM ({_RANKED}) r WHERE meeting_date BETWEEN '1998-03-02' AND '1998-03-31' AND n_meetings >= {MIN_MEETINGS} AND novelty >= 0.7 ORDER BY novelty DESC, test_id, meeting_id LIMIT 4")
def digest_topk(t) -> DataFrame:
    """The four most salient values of a month, from 0.7 on; a thin baseline has no novelty."""
    r = ranked(t).filter(F.col("meeting_date").between("1998-03-02", "1998-03-31") & (F.col("n_meetings") >= MIN_MEETINGS) & (F.col("novelty") >= 0.7))
    return r.orderBy(F.desc("novelty"), "test_id", "meeting_id").limit(4).select("test_id", "meeting_id", F.col("novelty").alias("salience"))


@named("""SELECT max(g.id) AS meeting_id FROM meetings g WHERE document_type = 'minutes' AND meeting_date <= DATE '1999-12-31' AND id IN (SELECT meeting_id FROM motions)""")
def latest_meeting_as_of(t) -> DataFrame:
    g = t.meetings.filter("document_type = 'minutes'").filter(F.col("meeting_date") <= "1999-12-31")
    return g.join(t.motions.select(F.col("meeting_id").alias("id")), "id", "left_semi").agg(F.max("id").alias("meeting_id"))


@named("""SELECT meeting_id, count(*) AS items, count(CASE WHEN is_confidential THEN 1 END) AS closed, string_agg(DISTINCT description, '; ' ORDER BY description) AS kinds FROM other_items GROUP BY 1""")
def meeting_inventory(t) -> DataFrame:
    return t.other_items.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("items"), count_if(F.col("is_confidential")).alias("closed"), F.concat_ws("; ", F.sort_array(F.collect_set("description"))).alias("kinds"))
