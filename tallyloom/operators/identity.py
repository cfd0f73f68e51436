"""One person under several records: names brought into one form, a target for each record, and what speaks for or against the merge.

Each record meets the target of its name only, never all records of the name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import councillor_name
from ..registry import named

#: Days by which spans of votes and terms may miss each other: their dates are taken from votes.
SLACK = 183

_NAMES = """SELECT id, CASE WHEN lower(g) IN ('null', 'name', 'unknown', 'none', 'n/a') OR f <> '' AND lower(g) = lower(f) THEN '' ELSE g END AS given, f AS family
    FROM (SELECT id, CASE WHEN swapped THEN '' ELSE regexp_replace(g0, '^(Cr|Mayor|Deputy Mayor|Councillor) ', '') END AS g, CASE WHEN swapped THEN g0 ELSE f0 END AS f FROM (SELECT id, trim(given_name) AS g0, trim(family_name) AS f0, lower(rtrim(trim(family_name), '.')) IN ('cr', 'councillor', 'mayor', 'deputy', 'deputy mayor') AS swapped FROM roster) x) y"""


@named(_NAMES)
def roster_names(t) -> DataFrame:
    n = councillor_name(F.col("given_name"), F.col("family_name"))
    return t.roster.select("id", n.alias("n")).select("id", "n.given", "n.family")


_VOTED = "SELECT v.councillor_id AS id, count(*) AS votes, min(m.meeting_date) AS first_vote, max(m.meeting_date) AS last_vote FROM votes v JOIN motions m ON m.id = v.motion_id GROUP BY 1"
_TARGETS = f"""n AS ({_NAMES}), w AS ({_VOTED}), r AS (SELECT n.*, coalesce(votes, 0) AS votes, first_vote, last_vote, row_number() OVER (PARTITION BY lower(given), lower(family) ORDER BY coalesce(votes, 0) DESC, n.id) AS rn FROM n LEFT JOIN w ON w.id = n.id),
    t AS (SELECT a.id, b.id AS target_id, a.votes, a.first_vote AS a0, a.last_vote AS a1, b.first_vote AS b0, b.last_vote AS b1 FROM r a JOIN r b ON lower(a.given) = lower(b.given) AND lower(a.family) = lower(b.family) AND b.rn = 1 AND a.rn > 1)"""


def targets(t) -> DataFrame:
    """(id, target_id, votes, a0, a1, b0, b1): the record of the most votes is the target of its name; vote spans of both."""
    voted = t.votes.join(t.motions.select(F.col("id").alias("motion_id"), "meeting_date"), "motion_id").groupBy(F.col("councillor_id").alias("id")).agg(F.count(F.lit(1)).alias("votes"), F.min("meeting_date").alias("a0"), F.max("meeting_date").alias("a1"))
    r = roster_names(t).join(voted, "id", "left").withColumn("votes", F.coalesce("votes", F.lit(0))).withColumns({"g": F.lower("given"), "f": F.lower("family")})
    best = r.groupBy("g", "f").agg(F.min(F.struct((-F.col("votes")).alias("v"), "id", F.col("a0").alias("b0"), F.col("a1").alias("b1"))).alias("best"))
    return r.join(best, ["g", "f"]).filter("id <> best.id").select("id", F.col("best.id").alias("target_id"), "votes", "a0", "a1", "best.b0", "best.b1")


@named(f"""WITH {_TARGETS} SELECT id, target_id, votes, coalesce(a0 - INTERVAL {SLACK} DAY <= b1 AND a1 + INTERVAL {SLACK} DAY >= b0, false) AS spans_overlap,
    (SELECT count(*) FROM (SELECT DISTINCT motion_id FROM votes WHERE councillor_id = t.id) x JOIN (SELECT DISTINCT motion_id, councillor_id FROM votes) y ON x.motion_id = y.motion_id AND y.councillor_id = t.target_id) AS shared_motions FROM t""")
def name_merge_targets(t) -> DataFrame:
    """A person votes once on a motion: records that share one are two persons, whatever their names."""
    found = targets(t)
    cast = t.votes.select("motion_id", "councillor_id").distinct()
    mine = cast.join(F.broadcast(found.select("id", "target_id")), F.col("councillor_id") == F.col("id")).select("id", "target_id", "motion_id")
    both = mine.join(cast.select("motion_id", F.col("councillor_id").alias("target_id")), ["motion_id", "target_id"]).groupBy("id").agg(F.count(F.lit(1)).alias("shared_motions"))
    overlap = (F.date_sub("a0", SLACK) <= F.col("b1")) & (F.date_add("a1", SLACK) >= F.col("b0"))
    return found.join(both, "id", "left").select("id", "target_id", "votes", F.coalesce(overlap, F.lit(False)).alias("spans_overlap"), F.coalesce("shared_motions", F.lit(0)).alias("shared_motions"))


@named(f"""WITH {_TARGETS} SELECT t.id, t.target_id, CASE WHEN count(s.councillor_id) = 0 OR min(a0) IS NULL THEN 'no_terms' WHEN count(CASE WHEN a0 <= coalesce(s.term_end, DATE '9999-01-01') + INTERVAL {SLACK} DAY AND a1 >= s.term_start - INTERVAL {SLACK} DAY THEN 1 END) > 0 THEN 'confirmed' ELSE 'conflict' END AS term_check
    FROM t LEFT JOIN terms s ON s.councillor_id = t.target_id GROUP BY 1, 2""")
def term_check(t) -> DataFrame:
    """Whether a record's votes lie in a term of its target, open ends reaching on."""
    s = t.terms.select(F.col("councillor_id").alias("target_id"), "term_start", "term_end")
    inside = (F.col("a0") <= F.date_add(F.coalesce("term_end", F.lit("9999-01-01").cast("date")), SLACK)) & (F.col("a1") >= F.date_sub("term_start", SLACK))
    g = targets(t).join(s, "target_id", "left").groupBy("id", "target_id").agg(F.count("term_start").alias("terms"), F.min("a0").alias("a0"), F.max(F.coalesce(inside, F.lit(False))).alias("inside"))
    return g.select("id", "target_id", F.when((F.col("terms") == 0) | F.col("a0").isNull(), "no_terms").when(F.col("inside"), "confirmed").otherwise("conflict").alias("term_check"))
