"""Declared interests, recusal, delegate windows, transparency and question responses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, ratio
from ..functions.text import LEFT_ROOM, NIL_HEADING, ON_NOTICE
from ..registry import named
from .people import cast_votes

# Era bounds are a default of this library: the years of the inquiry, both inclusive.
INQUIRY = (1997, 1998)


def era() -> Column:
    return F.when(F.col("year") < INQUIRY[0], "pre").when(F.col("year") <= INQUIRY[1], "inquiry").otherwise("post")


_ERA = "CASE WHEN year < 1997 THEN 'pre' WHEN year <= 1998 THEN 'inquiry' ELSE 'post' END"

_LINKED = """SELECT v.id AS vote_id, v.motion_id, v.councillor_id, v.choice, m.meeting_id, m.year, d.id AS declaration_id, d.interest_type, d.description, v.choice = 'absent' OR coalesce(regexp_matches(d.description, '(?i)\\bleft the (meeting|room)\\b'), false) AS recused
    FROM votes v JOIN motions m ON m.id = v.motion_id LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY councillor_id, meeting_id, item_reference ORDER BY id DESC) AS rn FROM declarations WHERE item_reference IS NOT NULL) x WHERE rn = 1) d
    ON d.councillor_id = v.councillor_id AND d.meeting_id = m.meeting_id AND d.item_reference = m.item_number WHERE v.declared_interest"""


def linked(t) -> DataFrame:
    """Declared votes with their declaration: the one of the largest id by person, meeting and item; a vote never multiplies."""
    w = Window.partitionBy("councillor_id", "meeting_id", "item_reference").orderBy(F.desc("id"))
    last = t.declarations.filter("item_reference IS NOT NULL").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("councillor_id", "meeting_id", F.col("item_reference").alias("item_number"), F.col("id").alias("declaration_id"), "interest_type", "description")
    m = t.motions.select(F.col("id").alias("motion_id"), "meeting_id", "year", "item_number")
    v = t.votes.filter("declared_interest").select(F.col("id").alias("vote_id"), "motion_id", "councillor_id", "choice").join(m, "motion_id")
    return v.join(last, ["councillor_id", "meeting_id", "item_number"], "left").withColumn("recused", (F.col("choice") == "absent") | F.coalesce(F.col("description").rlike(LEFT_ROOM), F.lit(False)))


@named(f"SELECT vote_id, motion_id, councillor_id, declaration_id, interest_type, recused FROM ({_LINKED}) l")
def linked_declared_votes(t) -> DataFrame:
    return linked(t).select("vote_id", "motion_id", "councillor_id", "declaration_id", "interest_type", "recused")


@named(f"""WITH l AS ({_LINKED}) SELECT (SELECT count(*) FROM l) AS declared_total, (SELECT count(*) FROM l WHERE recused) AS declared_recused, (SELECT count(CASE WHEN choice = 'against' THEN 1 END) / count(*) FROM l) AS declared_against,
    count(*) AS baseline_total, count(CASE WHEN choice = 'absent' THEN 1 END) / count(*) AS baseline_absent, count(CASE WHEN choice = 'against' THEN 1 END) / count(*) AS baseline_against FROM votes WHERE NOT declared_interest""")
def conflict_recusal(t) -> DataFrame:
    c = F.col("choice")
    d = linked(t).agg(F.count(F.lit(1)).alias("declared_total"), count_if(F.col("recused")).alias("declared_recused"), (count_if(c == "against") / F.count(F.lit(1))).alias("declared_against"))
    b = t.votes.filter("NOT declared_interest").agg(F.count(F.lit(1)).alias("baseline_total"), (count_if(c == "absent") / F.count(F.lit(1))).alias("baseline_absent"), (count_if(c == "against") / F.count(F.lit(1))).alias("baseline_against"))
    return d.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")


@named(f"""WITH l AS ({_LINKED}) SELECT councillor_id, count(*) AS declared_votes, count(CASE WHEN recused THEN 1 END) AS recused, count(CASE WHEN recused THEN 1 END) / count(*) AS recusal_rate, count(CASE WHEN interest_type IN ('financial', 'proximity') THEN 1 END) AS must_leave_declared
    FROM l GROUP BY 1 HAVING count(*) >= 8""")
def recusal_profiles(t) -> DataFrame:
    must = F.col("interest_type").isin("financial", "proximity")
    p = linked(t).groupBy("councillor_id").agg(F.count(F.lit(1)).alias("declared_votes"), count_if(F.col("recused")).alias("recused"), count_if(must).alias("must_leave_declared")).filter("declared_votes >= 8")
    return p.withColumn("recusal_rate", F.col("recused") / F.col("declared_votes"))


@named(f"""WITH l AS ({_LINKED}) SELECT coalesce(interest_type, 'none') AS interest_type, {_ERA} AS era, count(*) AS declared, count(CASE WHEN recused THEN 1 END) / count(*) AS recusal_rate, count(CASE WHEN contains(coalesce(description, ''), '5.69') THEN 1 END) AS ministerial FROM l GROUP BY 1, 2""")
def recusal_trend(t) -> DataFrame:
    return linked(t).groupBy(F.coalesce("interest_type", F.lit("none")).alias("interest_type"), era().alias("era")).agg(F.count(F.lit(1)).alias("declared"), (count_if(F.col("recused")) / F.count(F.lit(1))).alias("recusal_rate"), count_if(F.coalesce("description", F.lit("")).contains("5.69")).alias("ministerial"))


@named(f"""WITH l AS ({_LINKED}) SELECT year, count(*) AS declared, CASE WHEN count(CASE WHEN interest_type IN ('financial', 'proximity') THEN 1 END) >= 4 THEN count(CASE WHEN interest_type IN ('financial', 'proximity') AND recused THEN 1 END) / count(CASE WHEN interest_type IN ('financial', 'proximity') THEN 1 END) END AS must_leave_rate FROM l GROUP BY 1""")
def recusal_by_year(t) -> DataFrame:
    must = F.col("interest_type").isin("financial", "proximity")
    y = linked(t).groupBy("year").agg(F.count(F.lit(1)).alias("declared"), count_if(must).alias("n"), count_if(must & F.col("recused")).alias("k"))
    return y.select("year", "declared", F.when(F.col("n") >= 4, F.col("k") / F.col("n")).alias("must_leave_rate"))


@named("""SELECT councillor_id, count(*) AS total, count(CASE WHEN interest_type = 'financial' THEN 1 END) AS financial, count(CASE WHEN interest_type = 'impartiality' THEN 1 END) AS impartiality, count(CASE WHEN interest_type = 'proximity' THEN 1 END) AS proximity,
    count(CASE WHEN interest_type = 'other' THEN 1 END) AS other FROM declarations WHERE councillor_id IN (SELECT councillor_id FROM terms UNION SELECT councillor_id FROM votes) GROUP BY 1""")
def interest_summary(t) -> DataFrame:
    known = t.terms.select("councillor_id").unionByName(t.votes.select("councillor_id")).distinct()
    d = t.declarations.join(known, "councillor_id", "left_semi").groupBy("councillor_id")
    kinds = ("financial", "impartiality", "proximity", "other")
    return d.agg(F.count(F.lit(1)).alias("total"), *(count_if(F.col("interest_type") == k).alias(k) for k in kinds))


@named("""WITH w AS (SELECT councillor_id, body_name, meeting_date AS start, coalesce(lead(meeting_date) OVER (PARTITION BY councillor_id ORDER BY meeting_date, id), meeting_date + INTERVAL 1460 DAY) AS stop FROM appointments),
    k AS (SELECT v.id, v.councillor_id, v.declared_interest, m.meeting_date FROM votes v JOIN motions m ON m.id = v.motion_id WHERE contains(m.tags, 'planning')),
    a AS (SELECT DISTINCT k.id FROM k JOIN w ON w.councillor_id = k.councillor_id AND k.meeting_date >= w.start AND k.meeting_date < w.stop)
    SELECT a.id IS NOT NULL AS affiliated, count(*) AS votes, count(CASE WHEN declared_interest THEN 1 END) / count(*) AS declared_rate FROM k LEFT JOIN a ON a.id = k.id GROUP BY 1""")
def delegate_windows(t) -> DataFrame:
    """Half-open windows from an appointment to the person's next one, or four years; the join has the person as key, the range is a residual."""
    w = Window.partitionBy("councillor_id").orderBy("meeting_date", "id")
    held = t.appointments.select(F.col("councillor_id").alias("who"), F.col("meeting_date").alias("start"), F.coalesce(F.lead("meeting_date").over(w), F.date_add("meeting_date", 1460)).alias("stop"))
    m = t.motions.filter(F.col("tags").contains("planning")).select(F.col("id").alias("motion_id"), "meeting_date")
    k = t.votes.select("id", "motion_id", "councillor_id", "declared_interest").join(m, "motion_id")
    inside = (F.col("councillor_id") == F.col("who")) & (F.col("meeting_date") >= F.col("start")) & (F.col("meeting_date") < F.col("stop"))
    a = k.join(held, inside, "left_semi").select("id", F.lit(True).alias("a"))
    return k.join(a, "id", "left").groupBy(F.coalesce("a", F.lit(False)).alias("affiliated")).agg(F.count(F.lit(1)).alias("votes"), (count_if(F.col("declared_interest")) / F.count(F.lit(1))).alias("declared_rate"))


@named("""WITH p AS (SELECT v.councillor_id, count(*) AS n, count(CASE WHEN (choice = 'for' AND outcome = 'carried') OR (choice = 'against' AND outcome = 'lost') THEN 1 END) AS won FROM votes v JOIN motions m ON m.id = v.motion_id JOIN meetings g ON g.id = m.meeting_id
    WHERE choice <> 'absent' AND outcome IN ('carried', 'lost') AND document_type = 'minutes' GROUP BY 1 HAVING count(*) >= 20), b AS (SELECT DISTINCT councillor_id FROM appointments WHERE body_name = 'Body 1')
    SELECT b.councillor_id IS NOT NULL AS appointee, count(*) AS people, cast(sum(n) AS bigint) AS votes, sum(won) / sum(n) AS win_rate FROM p LEFT JOIN b USING (councillor_id) GROUP BY 1""")
def oversight_capture(t) -> DataFrame:
    minutes = t.meetings.filter("document_type = 'minutes'").select(F.col("id").alias("meeting_id"))
    c, o = F.col("choice"), F.col("outcome")
    v = cast_votes(t).join(minutes, "meeting_id", "left_semi").filter("choice <> 'absent' AND outcome IN ('carried', 'lost')")
    p = v.groupBy("councillor_id").agg(F.count(F.lit(1)).alias("n"), count_if((c == "for") & (o == "carried") | (c == "against") & (o == "lost")).alias("won")).filter("n >= 20")
    b = t.appointments.filter("body_name = 'Body 1'").select("councillor_id").distinct().withColumn("b", F.lit(True))
    return p.join(b, "councillor_id", "left").groupBy(F.coalesce("b", F.lit(False)).alias("appointee")).agg(F.count(F.lit(1)).alias("people"), F.sum("n").alias("votes"), (F.sum("won") / F.sum("n")).alias("win_rate"))


_ITEMS = """SELECT year, 'budget' AS category, is_confidential FROM budget_items UNION ALL SELECT year, 'tender', is_confidential FROM tenders UNION ALL SELECT year, 'other', is_confidential FROM other_items WHERE NOT regexp_matches(trim(description), '(?i)^confidential reports?(\\s+section)?\\s*-\\s*nil\\b')"""


def items(t) -> DataFrame:
    """Items of all kinds with year, category and whether they are closed; nil headings don't count."""
    of = lambda df, name: df.select("year", F.lit(name).alias("category"), "is_confidential")
    return of(t.budget_items, "budget").unionByName(of(t.tenders, "tender")).unionByName(of(t.other_items.filter(~F.trim("description").rlike(NIL_HEADING)), "other"))


@named(f"""SELECT year, category, count(*) AS total, count(CASE WHEN is_confidential THEN 1 END) AS confidential, count(CASE WHEN is_confidential THEN 1 END) / count(*) AS share FROM ({_ITEMS}) i GROUP BY 1, 2""")
def transparency_union(t) -> DataFrame:
    return items(t).groupBy("year", "category").agg(F.count(F.lit(1)).alias("total"), count_if(F.col("is_confidential")).alias("confidential")).withColumn("share", F.col("confidential") / F.col("total"))


@named(f"""WITH y AS (SELECT year, count(*) AS n, count(CASE WHEN is_confidential THEN 1 END) AS c FROM ({_ITEMS}) i GROUP BY 1) SELECT (SELECT sum(c) / sum(n) FROM y WHERE year < 1997) AS pre_share, arg_max(year, (c / n, -year)) AS peak_year, max(c / n) AS peak_share FROM y WHERE n >= 50""")
def transparency_peak(t) -> DataFrame:
    y = items(t).groupBy("year").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("is_confidential")).alias("c"))
    share, pre = F.col("c") / F.col("n"), F.col("year") < INQUIRY[0]
    big = F.col("n") >= 50
    return y.agg((F.sum(F.when(pre, F.col("c"))) / F.sum(F.when(pre, F.col("n")))).alias("pre_share"), F.max_by(F.when(big, F.col("year")), F.when(big, F.struct(share, -F.col("year")))).alias("peak_year"), F.max(F.when(big, share)).alias("peak_share"))


THEMES = {"property": r"(?i)\b(land|lease|property)\b", "legal": r"(?i)\blegal\b", "staff": r"(?i)\b(staff|employ\w*)\b", "contract": r"(?i)\b(tender|contract)\b", "development": r"(?i)\bdevelopment\b", "general": r"(?i)\bgeneral\b"}


@named(f"""WITH o AS (SELECT * FROM other_items), b AS (SELECT count(CASE WHEN is_confidential THEN 1 END) / count(*) AS base FROM o), e AS ({' UNION ALL '.join(f"SELECT '{k}' AS theme, is_confidential FROM o WHERE regexp_matches(description, '{v}')" for k, v in THEMES.items())})
    SELECT theme, count(*) AS n, count(CASE WHEN is_confidential THEN 1 END) / count(*) / min(base) AS lift FROM e, b GROUP BY 1""")
def topic_lift(t) -> DataFrame:
    """Closed rate of each theme over the rate of all; an item may have several themes."""
    base = t.other_items.agg((count_if(F.col("is_confidential")) / F.count(F.lit(1))).alias("base")).withColumn("k", F.lit(1))
    themes = F.array_compact(F.array(*(F.when(F.col("description").rlike(p), F.lit(n)) for n, p in THEMES.items())))
    e = t.other_items.withColumn("theme", F.explode(themes)).groupBy("theme").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("is_confidential")).alias("c"))
    return e.withColumn("k", F.lit(1)).join(F.broadcast(base), "k").select("theme", "n", (F.col("c") / F.col("n") / F.col("base")).alias("lift"))


_ANSWER = "CASE WHEN response IS NULL OR trim(response) = '' THEN 'blank' WHEN regexp_matches(response, '(?i)taken on notice|on notice|no response|not answered|deferred|will be provided|to be provided|provided later|will respond|responded to in writing|respond(?:ed)?\\s+in\\s+writing|provide[d]?.{0,20}writing|answer(?:ed)?.{0,20}writing') THEN 'on_notice' ELSE 'answered' END"


def answer() -> Column:
    return F.when(F.col("response").isNull() | (F.trim("response") == ""), "blank").when(F.col("response").rlike(ON_NOTICE), "on_notice").otherwise("answered")


@named(f"""SELECT {_ERA} AS era, {_ANSWER} AS status, count(*) AS n FROM questions GROUP BY 1, 2""")
def question_responsiveness(t) -> DataFrame:
    return t.questions.groupBy(era().alias("era"), answer().alias("status")).agg(F.count(F.lit(1)).alias("n"))


@named(f"""SELECT year, count(*) AS n, CASE WHEN count(CASE WHEN {_ANSWER} <> 'blank' THEN 1 END) >= 15 THEN count(CASE WHEN {_ANSWER} = 'on_notice' THEN 1 END) / count(CASE WHEN {_ANSWER} <> 'blank' THEN 1 END) END AS on_notice_rate FROM questions GROUP BY 1""")
def questions_by_year(t) -> DataFrame:
    y = t.questions.groupBy(F.col("year")).agg(F.count(F.lit(1)).alias("n"), count_if(answer() != "blank").alias("b"), count_if(answer() == "on_notice").alias("o"))
    return y.select("year", "n", F.when(F.col("b") >= 15, F.col("o") / F.col("b")).alias("on_notice_rate"))


@named("""SELECT count(*) AS tender_motions, (SELECT count(*) FROM votes v JOIN motions m ON m.id = v.motion_id WHERE m.tags ILIKE '%tender%') AS votes_on_tender_motions, (SELECT count(CASE WHEN declared_interest THEN 1 END) / count(*) FROM votes v JOIN motions m ON m.id = v.motion_id WHERE m.tags ILIKE '%tender%') AS declared_rate,
    (SELECT count(CASE WHEN declared_interest THEN 1 END) / count(*) FROM votes) AS base_rate FROM motions WHERE tags ILIKE '%tender%'""")
def decider_supplier_rates(t) -> DataFrame:
    on_tender = F.col("tags").ilike("%tender%")
    v = cast_votes(t).agg(F.count_distinct(F.when(on_tender, F.col("motion_id"))).alias("voted"), count_if(on_tender).alias("votes_on_tender_motions"), count_if(on_tender & F.col("declared_interest")).alias("d"), count_if(F.col("declared_interest")).alias("all_d"), F.count(F.lit(1)).alias("n"))
    m = t.motions.agg(count_if(on_tender).alias("tender_motions"))
    return v.withColumn("k", F.lit(1)).join(m.withColumn("k", F.lit(1)), "k").select("tender_motions", "votes_on_tender_motions", (F.col("d") / F.col("votes_on_tender_motions")).alias("declared_rate"), (F.col("all_d") / F.col("n")).alias("base_rate"))


@named("""WITH n AS (SELECT *, trim(item_number) AS number FROM items WHERE trim(item_number) <> ''), l AS (SELECT meeting_id, number, side, max(id) AS id FROM n GROUP BY ALL)
    SELECT a.meeting_id, a.number AS item_number, a.id AS agenda_motion_id, b.id AS minutes_motion_id, m.outcome IN ('lost', 'deferred') AS diverged
    FROM l a JOIN l b ON a.meeting_id = b.meeting_id AND a.number = b.number AND a.side = 'agenda' AND b.side = 'minutes' JOIN motions m ON m.id = b.id""")
def officer_divergence_exact(t) -> DataFrame:
    """Agenda and minutes items of one date matched by trimmed number; the last of a number on its side wins. Items without a number are left to the fuzzy pass."""
    numbered = t.items.select("meeting_id", F.trim("item_number").alias("item_number"), "id", "side", "outcome").filter("item_number != ''")
    last = lambda side, **columns: numbered.filter(F.col("side") == side).groupBy("meeting_id", "item_number").agg(F.max(F.struct("id", "outcome")).alias("x")).select("meeting_id", "item_number", *(F.col(f"x.{c}").alias(n) for n, c in columns.items()))
    both = last("agenda", agenda_motion_id="id").join(last("minutes", minutes_motion_id="id", outcome="outcome"), ["meeting_id", "item_number"])
    return both.select("meeting_id", "item_number", "agenda_motion_id", "minutes_motion_id", F.col("outcome").isin("lost", "deferred").alias("diverged"))


@named()
def officer_divergence_fuzzy(t) -> DataFrame:
    """Agenda items without a number match in the minutes of their date, by the best title likeness there (at least 0.5, first of equals).

    The likeness is that of difflib, which SQL does not have; it is taken once for each two titles that meet on a date.
    """
    items = t.items.select("meeting_id", "id", "side", F.trim("item_number").alias("number"), F.concat("title", F.lit(" "), "tags").alias("title"))
    minutes = items.filter("side = 'minutes'")
    numbers = minutes.filter("number != ''").select("meeting_id", "number").distinct()
    a = items.filter("side = 'agenda'").join(numbers, ["meeting_id", "number"], "left_anti").select("meeting_id", F.col("id").alias("agenda_id"), F.col("title").alias("agenda_title"))
    b = minutes.groupBy("meeting_id", F.col("title").alias("minutes_title")).agg(F.min("id").alias("minutes_id"))

    @F.pandas_udf("double")
    def like(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p.lower(), q.lower()).ratio() for p, q in zip(x, y)])

    like = like.asNondeterministic()  # else its filter is pushed below the distinct and it runs on every pair
    met = a.select("meeting_id", "agenda_title").distinct().join(b, "meeting_id")
    alike = met.select("agenda_title", "minutes_title").distinct().withColumn("confidence", like("agenda_title", "minutes_title")).filter("confidence >= 0.5")
    best = met.join(alike, ["agenda_title", "minutes_title"]).groupBy("meeting_id", "agenda_title").agg(F.min(F.struct((-F.col("confidence")).alias("away"), "minutes_id")).alias("best"))
    return a.join(best, ["meeting_id", "agenda_title"]).select("meeting_id", "agenda_id", F.col("best.minutes_id").alias("minutes_id"), (-F.col("best.away")).alias("confidence"))
