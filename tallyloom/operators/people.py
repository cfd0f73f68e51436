"""Who votes how: activity, dissent, alignment, power, tenure, attendance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, first_rows, ratio, tags_of, top
from ..registry import named

AS_OF = "2001-08-01"  # the flag "active" takes a date, never the clock


def term() -> Column:
    """First year of the four-year term of ``year``."""
    return (F.floor((F.col("year") - 1995) / 4) * 4 + 1995).cast("int")


def cast_votes(t) -> DataFrame:
    """Votes with their motion's year, date, outcome and tags."""
    m = t.motions.select(F.col("id").alias("motion_id"), "meeting_id", "meeting_date", "year", "outcome", "tags", "votes_against", "moved_by_id")
    return t.votes.select("motion_id", "councillor_id", "choice", "declared_interest").join(m, "motion_id")


def in_years(df: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Rows of the years from low to high, both inclusive; 0 and None are no bound."""
    if low:
        df = df.filter(F.col("year") >= low)
    return df.filter(F.col("year") <= high) if high else df


@named("SELECT councillor_id, count(*) AS n_votes FROM votes GROUP BY 1 HAVING count(*) >= 20")
def list_persons(t) -> DataFrame:
    return t.votes.groupBy("councillor_id").agg(F.count(F.lit(1)).alias("n_votes")).filter("n_votes >= 20")


@named("SELECT id, meeting_type, document_type FROM meetings WHERE meeting_date BETWEEN DATE '1996-03-01' AND DATE '1996-09-30'")
def meetings_in_range(t) -> DataFrame:
    return t.meetings.filter(F.col("meeting_date").between("1996-03-01", "1996-09-30")).select("id", "meeting_type", "document_type")


@named("SELECT id, year, title FROM motions WHERE tags ILIKE '%plan%' AND year BETWEEN 1996 AND 1998")
def motions_by_tag(t) -> DataFrame:
    return in_years(t.motions, 1996, 1998).filter(F.lower("tags").contains("plan")).select("id", "year", "title")


@named("SELECT id, year, votes_against FROM motions WHERE outcome = 'carried' AND votes_against >= 2")
def contested_motions(t) -> DataFrame:
    return t.motions.filter("outcome = 'carried' AND votes_against >= 2").select("id", "year", "votes_against")


@named("""SELECT councillor_id, cast(min(meeting_date) AS string) AS first_vote, cast(max(meeting_date) AS string) AS last_vote, count(*) AS total_votes,
    count(CASE WHEN choice = 'against' AND outcome = 'carried' THEN 1 END) / count(*) AS dissent_rate, max(meeting_date) >= DATE '2001-08-01' - INTERVAL 548 DAY AS is_active
    FROM votes v JOIN motions m ON m.id = v.motion_id GROUP BY councillor_id HAVING count(*) >= 10""")
def activity_ranges(t) -> DataFrame:
    v = cast_votes(t).groupBy("councillor_id").agg(
        F.min("meeting_date").alias("a"), F.max("meeting_date").alias("b"), F.count(F.lit(1)).alias("total_votes"), count_if((F.col("choice") == "against") & (F.col("outcome") == "carried")).alias("d")
    )
    return v.filter("total_votes >= 10").select("councillor_id", F.col("a").cast("string").alias("first_vote"), F.col("b").cast("string").alias("last_vote"), "total_votes", (F.col("d") / F.col("total_votes")).alias("dissent_rate"), (F.col("b") >= F.date_sub(F.lit(AS_OF).cast("date"), 548)).alias("is_active"))


@named("""WITH c AS (SELECT year, count(*) AS total_carried, count(CASE WHEN votes_against >= 1 THEN 1 END) AS contested FROM motions WHERE outcome = 'carried' GROUP BY year),
    r AS (SELECT year, id, row_number() OVER (PARTITION BY year ORDER BY votes_against DESC, id) AS rn FROM motions WHERE outcome = 'carried' AND votes_against >= 1)
    SELECT c.*, contested / total_carried AS contestation_rate, string_agg(cast(r.id AS string), ',' ORDER BY rn) AS most_contested FROM c LEFT JOIN r ON r.year = c.year AND rn <= 3 GROUP BY ALL""")
def contestation_by_year(t) -> DataFrame:
    carried = t.motions.filter("outcome = 'carried'")
    by = carried.groupBy("year").agg(F.count(F.lit(1)).alias("total_carried"), count_if(F.col("votes_against") >= 1).alias("contested"))
    best = top(carried.filter("votes_against >= 1").select("year", "id", "votes_against"), ["year"], [F.desc("votes_against"), F.col("id")], 3)
    names = best.groupBy("year").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"].cast("string"))).alias("most_contested"))
    return by.join(names, "year", "left").withColumn("contestation_rate", ratio(F.col("contested"), F.col("total_carried")))


@named("""SELECT trim(tag) AS tag, count(*) AS total_carried, count(CASE WHEN votes_against >= 1 THEN 1 END) AS contested, count(CASE WHEN votes_against >= 1 THEN 1 END) / count(*) AS contestation_rate
    FROM (SELECT *, unnest(string_split(tags, ',')) AS tag FROM motions WHERE outcome = 'carried') x GROUP BY 1 HAVING count(*) >= 20""")
def contestation_by_tag(t) -> DataFrame:
    by = tags_of(t.motions.filter("outcome = 'carried'")).groupBy("tag").agg(F.count(F.lit(1)).alias("total_carried"), count_if(F.col("votes_against") >= 1).alias("contested"))
    return by.filter("total_carried >= 20").withColumn("contestation_rate", ratio(F.col("contested"), F.col("total_carried")))


@named("""WITH e AS (SELECT year, trim(tag) AS tag FROM (SELECT year, unnest(string_split(tags, ',')) AS tag FROM motions) x), k AS (SELECT tag FROM e GROUP BY 1 ORDER BY count(*) DESC, tag LIMIT 4)
    SELECT year, coalesce(k.tag, 'other') AS topic, count(*) AS n FROM e LEFT JOIN k USING (tag) GROUP BY 1, 2""")
def topic_distribution(t) -> DataFrame:
    e = tags_of(t.motions).select("year", "tag")
    k = e.groupBy("tag").count().orderBy(F.desc("count"), "tag").limit(4).select("tag", F.col("tag").alias("topic"))
    return e.join(F.broadcast(k), "tag", "left").groupBy("year", F.coalesce("topic", F.lit("other")).alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@named("""SELECT moved_by_id AS mover_id, seconded_by_id AS seconder_id, a.slug AS mover_name, b.slug AS seconder_name, count(*) AS n FROM motions m JOIN councillors a ON a.id = moved_by_id JOIN councillors b ON b.id = seconded_by_id
    GROUP BY ALL HAVING count(*) >= 5""")
def co_mover_pairs(t) -> DataFrame:
    pairs = t.motions.filter("moved_by_id IS NOT NULL AND seconded_by_id IS NOT NULL").groupBy(F.col("moved_by_id").alias("mover_id"), F.col("seconded_by_id").alias("seconder_id")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    names = t.councillors.select("id", "slug")
    return pairs.join(names.select(F.col("id").alias("mover_id"), F.col("slug").alias("mover_name")), "mover_id").join(names.select(F.col("id").alias("seconder_id"), F.col("slug").alias("seconder_name")), "seconder_id")


def vote_pairs(votes: DataFrame) -> DataFrame:
    """Pairs of people on one motion, the smaller id first: a self join on the motion; chambers are small, motions many."""
    a = votes.select("motion_id", F.col("councillor_id").alias("a"), F.col("choice").alias("choice_a"))
    b = votes.select(F.col("motion_id").alias("m"), F.col("councillor_id").alias("b"), F.col("choice").alias("choice_b"))
    return a.join(b, (F.col("motion_id") == F.col("m")) & (F.col("a") < F.col("b")))


@named("""SELECT a.councillor_id AS a, b.councillor_id AS b, count(*) AS shared, count(CASE WHEN a.choice = b.choice THEN 1 END) AS agreements, count(CASE WHEN a.choice = b.choice THEN 1 END) / count(*) AS agreement_rate
    FROM votes a JOIN votes b ON a.motion_id = b.motion_id AND a.councillor_id < b.councillor_id WHERE a.choice <> 'absent' AND b.choice <> 'absent' GROUP BY 1, 2""")
def alignment_matrix(t) -> DataFrame:
    p = vote_pairs(t.votes.filter("choice <> 'absent'")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), count_if(F.col("choice_a") == F.col("choice_b")).alias("agreements"))
    return p.withColumn("agreement_rate", ratio(F.col("agreements"), F.col("shared")))


@named("""WITH p AS (SELECT a.councillor_id AS a, b.councillor_id AS b, count(*) AS shared, count(CASE WHEN a.choice = b.choice THEN 1 END) / count(*) AS rate
    FROM votes a JOIN votes b ON a.motion_id = b.motion_id AND a.councillor_id < b.councillor_id WHERE a.choice <> 'absent' AND b.choice <> 'absent' GROUP BY 1, 2)
    SELECT a, b, shared, rate, CASE WHEN rate >= 0.85 THEN 'ally' ELSE 'opponent' END AS kind FROM p WHERE shared >= 3 AND (rate >= 0.85 OR rate <= 0.40)""")
def relationship_edges(t) -> DataFrame:
    p = alignment_matrix(t).filter("shared >= 3").select("a", "b", "shared", F.col("agreement_rate").alias("rate"))
    return p.filter("rate >= 0.85").withColumn("kind", F.lit("ally")).unionByName(p.filter("rate <= 0.40").withColumn("kind", F.lit("opponent")))


@named("""SELECT a.councillor_id AS id_a, b.councillor_id AS id_b, count(*) AS shared_dissent FROM votes a JOIN votes b ON a.motion_id = b.motion_id AND a.councillor_id < b.councillor_id JOIN motions m ON m.id = a.motion_id
    WHERE a.choice = 'against' AND b.choice = 'against' AND outcome = 'carried' GROUP BY 1, 2 HAVING count(*) >= 2""")
def dissent_pairs(t) -> DataFrame:
    v = cast_votes(t).filter("choice = 'against' AND outcome = 'carried'")
    return vote_pairs(v).groupBy(F.col("a").alias("id_a"), F.col("b").alias("id_b")).agg(F.count(F.lit(1)).alias("shared_dissent")).filter("shared_dissent >= 2")


@named("""WITH v AS (SELECT councillor_id, choice, tags FROM votes JOIN motions m ON m.id = motion_id WHERE outcome = 'carried'),
    p AS (SELECT councillor_id, count(*) AS total, count(CASE WHEN choice = 'against' THEN 1 END) AS against_count FROM v GROUP BY 1 HAVING count(*) >= 50),
    g AS (SELECT councillor_id, trim(tag) AS tag, count(*) AS n FROM (SELECT councillor_id, unnest(string_split(tags, ',')) AS tag FROM v WHERE choice = 'against') x GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY councillor_id ORDER BY n DESC, tag) AS rn FROM g)
    SELECT p.councillor_id, total AS total_votes_on_carried, against_count, against_count / total AS dissent_rate, coalesce(string_agg(tag, ',' ORDER BY rn), '') AS top_dissent_tags FROM p LEFT JOIN r ON r.councillor_id = p.councillor_id AND rn <= 3 GROUP BY ALL""")
def dissent_profiles(t) -> DataFrame:
    v = cast_votes(t).filter("outcome = 'carried'")
    p = v.groupBy("councillor_id").agg(F.count(F.lit(1)).alias("total_votes_on_carried"), count_if(F.col("choice") == "against").alias("against_count")).filter("total_votes_on_carried >= 50")
    g = tags_of(v.filter("choice = 'against'")).groupBy("councillor_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    best = top(g, ["councillor_id"], [F.desc("n"), F.col("tag")], 3).groupBy("councillor_id").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("rn", "tag"))), lambda x: x["tag"])).alias("top_dissent_tags"))
    return p.join(best, "councillor_id", "left").select("councillor_id", "total_votes_on_carried", "against_count", ratio(F.col("against_count"), F.col("total_votes_on_carried")).alias("dissent_rate"), F.coalesce("top_dissent_tags", F.lit("")).alias("top_dissent_tags"))


def won() -> Column:
    return (F.col("choice") == "for") & (F.col("outcome") == "carried") | (F.col("choice") == "against") & (F.col("outcome") == "lost")


def decided_votes(t) -> DataFrame:
    """For and against votes on contested motions that were carried or lost, with ``won``."""
    return cast_votes(t).filter("choice IN ('for', 'against') AND outcome IN ('carried', 'lost') AND votes_against >= 1").withColumn("won", won())


_DECIDED = """SELECT councillor_id, year, choice, outcome, (choice = 'for' AND outcome = 'carried') OR (choice = 'against' AND outcome = 'lost') AS won
    FROM votes JOIN motions m ON m.id = motion_id WHERE choice IN ('for', 'against') AND outcome IN ('carried', 'lost') AND votes_against >= 1"""


@named(f"""WITH d AS ({_DECIDED}) SELECT councillor_id, count(*) AS n, count(CASE WHEN won THEN 1 END) / count(*) AS win_rate, count(CASE WHEN choice = 'against' THEN 1 END) / count(*) AS dissent_rate,
    CASE WHEN count(CASE WHEN choice = 'against' THEN 1 END) >= 15 THEN count(CASE WHEN choice = 'against' AND won THEN 1 END) / count(CASE WHEN choice = 'against' THEN 1 END) END AS dissent_effectiveness FROM d GROUP BY 1 HAVING count(*) >= 30""")
def voting_power(t) -> DataFrame:
    against = F.col("choice") == "against"
    p = decided_votes(t).groupBy("councillor_id").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("won")).alias("w"), count_if(against).alias("d"), count_if(against & F.col("won")).alias("dw")).filter("n >= 30")
    return p.select("councillor_id", "n", (F.col("w") / F.col("n")).alias("win_rate"), (F.col("d") / F.col("n")).alias("dissent_rate"), F.when(F.col("d") >= 15, F.col("dw") / F.col("d")).alias("dissent_effectiveness"))


@named(f"""WITH d AS (SELECT *, cast(floor((year - 1995) / 4) * 4 + 1995 AS int) AS term FROM ({_DECIDED}) x), p AS (SELECT councillor_id, term, count(*) AS n, count(CASE WHEN won THEN 1 END) / count(*) AS win_rate FROM d GROUP BY 1, 2 HAVING count(*) >= 10),
    k AS (SELECT councillor_id FROM p GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(n) DESC, councillor_id LIMIT 6) SELECT p.* FROM p JOIN k USING (councillor_id)""")
def power_over_terms(t) -> DataFrame:
    p = decided_votes(t).withColumn("term", term()).groupBy("councillor_id", "term").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("won")).alias("w")).filter("n >= 10").select("councillor_id", "term", "n", (F.col("w") / F.col("n")).alias("win_rate"))
    k = p.groupBy("councillor_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("all")).filter("terms >= 2").orderBy(F.desc("all"), "councillor_id").limit(6).select("councillor_id")
    return p.join(F.broadcast(k), "councillor_id", "left_semi")


@named(f"""WITH d AS (SELECT *, cast(floor((year - 1995) / 4) * 4 + 1995 AS int) AS term FROM ({_DECIDED}) x), p AS (SELECT councillor_id, term, count(*) AS n, count(CASE WHEN won THEN 1 END) / count(*) AS win_rate FROM d GROUP BY 1, 2 HAVING count(*) >= 10),
    k AS (SELECT councillor_id FROM p GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(n) DESC, councillor_id LIMIT 6) SELECT councillor_id, sum(n)::BIGINT AS n, max(win_rate) - min(win_rate) AS swing FROM p JOIN k USING (councillor_id) GROUP BY 1""")
def power_swings(t) -> DataFrame:
    """How far each long-serving person's win rate moves between terms."""
    return power_over_terms(t).groupBy("councillor_id").agg(F.sum("n").alias("n"), (F.max("win_rate") - F.min("win_rate")).alias("swing"))


@named(f"""WITH d AS ({_DECIDED}) SELECT count(*) AS n_votes, count(CASE WHEN outcome = 'carried' THEN 1 END) / count(*) AS base_carry_rate, count(CASE WHEN outcome = 'lost' THEN 1 END) / count(*) AS base_fail_rate FROM d""")
def base_rates(t) -> DataFrame:
    return decided_votes(t).agg(F.count(F.lit(1)).alias("n_votes"), (count_if(F.col("outcome") == "carried") / F.count(F.lit(1))).alias("base_carry_rate"), (count_if(F.col("outcome") == "lost") / F.count(F.lit(1))).alias("base_fail_rate"))


@named("""WITH r AS (SELECT councillor_id, motion_id, cast(meeting_date AS string) AS date, choice, outcome, row_number() OVER (PARTITION BY councillor_id ORDER BY meeting_date DESC, motion_id DESC) AS rn
    FROM votes JOIN motions m ON m.id = motion_id WHERE choice IN ('for', 'against') AND outcome IN ('carried', 'lost') AND votes_against >= 1) SELECT * FROM r WHERE rn <= 50""")
def newest_contested_votes(t) -> DataFrame:
    v = decided_votes(t).select("councillor_id", "motion_id", "meeting_date", "choice", "outcome")
    return top(v, ["councillor_id"], [F.desc("meeting_date"), F.desc("motion_id")], 50).select("councillor_id", "motion_id", F.col("meeting_date").cast("string").alias("date"), "choice", "outcome", "rn")


@named("""SELECT councillor_id, count(CASE WHEN choice = 'for' THEN 1 END) AS n_for, count(CASE WHEN choice = 'against' THEN 1 END) AS n_against, count(CASE WHEN choice = 'absent' THEN 1 END) AS n_absent, count(CASE WHEN declared_interest THEN 1 END) AS n_declared,
    count(CASE WHEN choice = 'against' AND outcome = 'carried' THEN 1 END) AS n_dissent FROM votes JOIN motions m ON m.id = motion_id WHERE councillor_id = 7 GROUP BY 1""")
def person_summary(t) -> DataFrame:
    c = F.col("choice")
    return cast_votes(t).filter("councillor_id = 7").groupBy("councillor_id").agg(
        count_if(c == "for").alias("n_for"), count_if(c == "against").alias("n_against"), count_if(c == "absent").alias("n_absent"), count_if(F.col("declared_interest")).alias("n_declared"), count_if((c == "against") & (F.col("outcome") == "carried")).alias("n_dissent")
    )


@named("""WITH v AS (SELECT councillor_id, motion_id, meeting_date, year(meeting_date) + month(meeting_date) / 12 AS t FROM votes JOIN motions m ON m.id = motion_id), b AS (SELECT councillor_id, count(*) AS n_votes, max(t) - min(t) AS years FROM v GROUP BY 1 HAVING count(*) >= 20),
    f AS (SELECT councillor_id, motion_id AS first_motion, row_number() OVER (PARTITION BY councillor_id ORDER BY meeting_date, motion_id) AS a, row_number() OVER (PARTITION BY councillor_id ORDER BY meeting_date DESC, motion_id DESC) AS z FROM v)
    SELECT councillor_id, n_votes, years, max(CASE WHEN a = 1 THEN first_motion END) AS first_motion_id, max(CASE WHEN z = 1 THEN first_motion END) AS last_motion_id, CASE WHEN years < 4 THEN '0-4' WHEN years < 8 THEN '4-8' ELSE '8+' END AS bucket FROM b JOIN f USING (councillor_id) GROUP BY ALL""")
def tenure_bookends(t) -> DataFrame:
    v = cast_votes(t).select("councillor_id", "motion_id", "meeting_date", (F.year("meeting_date") + F.month("meeting_date") / 12).alias("at"))
    key = F.struct("meeting_date", "motion_id")
    b = v.groupBy("councillor_id").agg(F.count(F.lit(1)).alias("n_votes"), (F.max("at") - F.min("at")).alias("years"), F.min(key)["motion_id"].alias("first_motion_id"), F.max(key)["motion_id"].alias("last_motion_id")).filter("n_votes >= 20")
    return b.withColumn("bucket", F.when(F.col("years") < 4, "0-4").when(F.col("years") < 8, "4-8").otherwise("8+"))


@named("""WITH v AS (SELECT councillor_id, year(meeting_date) + month(meeting_date) / 12 AS t FROM votes JOIN motions m ON m.id = motion_id), b AS (SELECT councillor_id, max(t) - min(t) AS years FROM v GROUP BY 1 HAVING count(*) >= 20)
    SELECT median(years) AS median_years, max(years) AS longest, count(*) AS n_councillors, count(CASE WHEN years >= 6 THEN 1 END) AS n_long FROM b""")
def tenure_summary(t) -> DataFrame:
    return tenure_bookends(t).agg(F.percentile("years", F.lit(0.5)).alias("median_years"), F.max("years").alias("longest"), F.count(F.lit(1)).alias("n_councillors"), count_if(F.col("years") >= 6).alias("n_long"))


@named("""SELECT EXISTS (SELECT 1 FROM terms t WHERE t.councillor_id = moved_by_id AND role = 'Mayor' AND term_start <= meeting_date AND (term_end IS NULL OR meeting_date <= term_end)) AS mayor, count(*) AS moved, count(CASE WHEN outcome = 'carried' THEN 1 END) AS carried,
    count(CASE WHEN outcome = 'carried' AND votes_against >= 1 THEN 1 END) / nullif(count(CASE WHEN outcome = 'carried' THEN 1 END), 0) AS contest_rate FROM motions WHERE moved_by_id IS NOT NULL GROUP BY 1""")
def mayoral_interval(t) -> DataFrame:
    held = t.terms.filter("role = 'Mayor'").select(F.col("councillor_id").alias("who"), "term_start", "term_end")
    inside = (F.col("moved_by_id") == F.col("who")) & (F.col("term_start").isNull() | (F.col("term_start") <= F.col("meeting_date"))) & (F.col("term_end").isNull() | (F.col("meeting_date") <= F.col("term_end")))
    moved = t.motions.filter("moved_by_id IS NOT NULL").select("id", "moved_by_id", "meeting_date", "outcome", "votes_against")
    by_mayor = moved.join(held, inside, "left_semi").select("id", F.lit(True).alias("m"))
    carried = F.col("outcome") == "carried"
    out = moved.join(by_mayor, "id", "left").groupBy(F.coalesce("m", F.lit(False)).alias("mayor")).agg(F.count(F.lit(1)).alias("moved"), count_if(carried).alias("carried"), count_if(carried & (F.col("votes_against") >= 1)).alias("c"))
    return out.select("mayor", "moved", "carried", ratio(F.col("c"), F.col("carried")).alias("contest_rate"))


@named("""WITH y AS (SELECT DISTINCT councillor_id, year FROM votes JOIN motions m ON m.id = motion_id), g AS (SELECT *, CASE WHEN year - lag(year) OVER (PARTITION BY councillor_id ORDER BY year) > 2 THEN 1 ELSE 0 END AS gap FROM y),
    i AS (SELECT *, sum(gap) OVER (PARTITION BY councillor_id ORDER BY year) AS island FROM g) SELECT councillor_id, cast(island AS bigint) AS period, min(year) AS year_from, max(year) AS year_to FROM i GROUP BY 1, 2""")
def terms_islands(t) -> DataFrame:
    w = Window.partitionBy("councillor_id").orderBy("year")
    y = cast_votes(t).select("councillor_id", "year").distinct()
    g = y.withColumn("gap", F.coalesce((F.col("year") - F.lag("year").over(w) > 2).cast("int"), F.lit(0)))
    return g.withColumn("period", F.sum("gap").over(w)).groupBy("councillor_id", "period").agg(F.min("year").alias("year_from"), F.max("year").alias("year_to"))


@named("""WITH c AS (SELECT councillor_id, choice, meeting_date, min(meeting_date) OVER (PARTITION BY councillor_id) AS first FROM votes JOIN motions m ON m.id = motion_id WHERE outcome = 'carried')
    SELECT date_diff('day', first, meeting_date) <= 365 AS first_year, count(*) AS n, count(CASE WHEN choice = 'against' THEN 1 END) AS against, count(CASE WHEN choice = 'against' THEN 1 END) / count(*) AS rate FROM c GROUP BY 1""")
def freshman_effect(t) -> DataFrame:
    w = Window.partitionBy("councillor_id")
    v = cast_votes(t).filter("outcome = 'carried'").withColumn("first", F.min("meeting_date").over(w))
    return v.groupBy((F.datediff("meeting_date", "first") <= 365).alias("first_year")).agg(F.count(F.lit(1)).alias("n"), count_if(F.col("choice") == "against").alias("against")).withColumn("rate", F.col("against") / F.col("n"))


@named("""SELECT year % 2 = 1 AND month(meeting_date) BETWEEN 4 AND 10 AS in_window, count(*) AS n, count(CASE WHEN choice = 'against' THEN 1 END) / count(*) AS rate FROM votes JOIN motions m ON m.id = motion_id WHERE outcome = 'carried' GROUP BY 1""")
def election_cycle(t) -> DataFrame:
    window = (F.col("year") % 2 == 1) & F.month("meeting_date").between(4, 10)
    v = cast_votes(t).filter("outcome = 'carried'").groupBy(window.alias("in_window")).agg(F.count(F.lit(1)).alias("n"), count_if(F.col("choice") == "against").alias("a"))
    return v.select("in_window", "n", (F.col("a") / F.col("n")).alias("rate"))


@named("""SELECT CASE WHEN choice <> 'absent' THEN 'voted' WHEN declared_interest THEN 'recusal' WHEN a.status = 'apology' THEN 'non_attendance' ELSE 'unknown' END AS kind, count(*) AS n
    FROM votes v JOIN motions m ON m.id = v.motion_id LEFT JOIN attendance a ON a.meeting_id = m.meeting_id AND a.councillor_id = v.councillor_id GROUP BY 1""")
def attendance_split(t) -> DataFrame:
    v = cast_votes(t).join(t.attendance, ["meeting_id", "councillor_id"], "left")
    kind = F.when(F.col("choice") != "absent", "voted").when(F.col("declared_interest"), "recusal").when(F.col("status") == "apology", "non_attendance").otherwise("unknown")
    return v.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@named("""SELECT coalesce(q.year, p.year, d.year) AS year, coalesce(nq, 0) AS public_questions, coalesce(nd, 0) AS deputations, coalesce(np, 0) AS petitions, coalesce(nq, 0) + coalesce(nd, 0) + coalesce(np, 0) AS total
    FROM (SELECT year, count(*) AS nq FROM questions GROUP BY 1) q FULL JOIN (SELECT cast(floor(meeting_id / 10000) AS int) AS year, count(*) AS nd FROM deputations GROUP BY 1) d ON d.year = q.year
    FULL JOIN (SELECT cast(floor(meeting_id / 10000) AS int) AS year, count(*) AS np FROM petitions GROUP BY 1) p ON p.year = coalesce(q.year, d.year)""")
def engagement_by_year(t) -> DataFrame:
    q = t.questions.groupBy(F.col("year").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("public_questions"))
    of = lambda df, name: df.groupBy(F.floor(F.col("meeting_id") / 10000).cast("int").alias("year")).agg(F.count(F.lit(1)).alias(name))
    out = q.join(of(t.deputations, "deputations"), "year", "full").join(of(t.petitions, "petitions"), "year", "full").fillna(0)
    return out.withColumn("total", F.col("public_questions") + F.col("deputations") + F.col("petitions"))


@named("""SELECT d.meeting_id IS NOT NULL AS with_deputation, count(*) AS n, count(CASE WHEN votes_against >= 1 THEN 1 END) / count(*) AS contest_rate FROM motions m LEFT JOIN (SELECT DISTINCT meeting_id FROM deputations) d ON d.meeting_id = m.meeting_id
    WHERE outcome = 'carried' GROUP BY 1""")
def deputation_semi(t) -> DataFrame:
    heard = t.deputations.select("meeting_id").distinct().withColumn("heard", F.lit(True))
    m = t.motions.filter("outcome = 'carried'").join(heard, "meeting_id", "left")
    out = m.groupBy(F.coalesce("heard", F.lit(False)).alias("with_deputation")).agg(F.count(F.lit(1)).alias("n"), count_if(F.col("votes_against") >= 1).alias("c"))
    return out.select("with_deputation", "n", (F.col("c") / F.col("n")).alias("contest_rate"))


@named("""SELECT year, count(*) AS carried, count(CASE WHEN votes_against >= 1 THEN 1 END) / count(*) AS contested_share FROM motions m JOIN meetings g ON g.id = m.meeting_id WHERE outcome = 'carried' AND document_type = 'minutes' GROUP BY 1 HAVING count(*) >= 30""")
def unanimity_trend(t) -> DataFrame:
    minutes = t.meetings.filter("document_type = 'minutes'").select(F.col("id").alias("meeting_id"))
    m = t.motions.filter("outcome = 'carried'").join(minutes, "meeting_id", "left_semi")
    return m.groupBy("year").agg(F.count(F.lit(1)).alias("carried"), count_if(F.col("votes_against") >= 1).alias("c")).filter("carried >= 30").select("year", "carried", (F.col("c") / F.col("carried")).alias("contested_share"))


@named("""SELECT councillor_id, count(DISTINCT motion_id) AS n_motions, (SELECT count(*) FROM motions WHERE moved_by_id = councillor_id) AS n_moved FROM votes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""")
def record_councillors(t) -> DataFrame:
    v = t.votes.groupBy("councillor_id").agg(F.count_distinct("motion_id").alias("n_motions")).orderBy(F.desc("n_motions"), "councillor_id").limit(25)
    moved = t.motions.groupBy(F.col("moved_by_id").alias("councillor_id")).agg(F.count(F.lit(1)).alias("n_moved"))
    return v.join(moved, "councillor_id", "left").fillna(0, ["n_moved"])


@named("""SELECT moved_by_id AS councillor_id, arg_max(seconded_by_id, (n, -seconded_by_id)) AS modal_seconder, max(n) AS times FROM (SELECT moved_by_id, seconded_by_id, count(*) AS n FROM motions WHERE moved_by_id IS NOT NULL AND seconded_by_id IS NOT NULL GROUP BY 1, 2) x GROUP BY 1""")
def modal_seconder(t) -> DataFrame:
    n = t.motions.filter("moved_by_id IS NOT NULL AND seconded_by_id IS NOT NULL").groupBy("moved_by_id", "seconded_by_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.col("moved_by_id").alias("councillor_id")).agg(F.max_by("seconded_by_id", F.struct("n", -F.col("seconded_by_id"))).alias("modal_seconder"), F.max("n").alias("times"))
