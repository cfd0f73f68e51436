"""Rules over claims: populations, linter, invariants, tiers, findings, reply packets.

Claims are rows; a rule is a Column of status (pass, fail, not_applicable,
unverifiable), so any number of claims is linted in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if
from ..registry import ORACLE_SQL, named
from .battery import _WALD_SQL, _WILSON_SQL, difference_claims, share_claims

CLAIM = """id string, grade string, value double, ci_low double, ci_high double, null_value double, power double, grain string, clustering_unit string, definition string, denominator_n long, replayed_n long,
    names_individuals boolean, individuals array<struct<name:string,n:long,ci_low:double,ci_high:double>>, source_spans array<string>, same_event boolean, reference_definition string, comparison_type string, frameworks array<string>,
    family_size long, correction string, survives_correction boolean, headline string, body string, objection string, response string, caveats array<string>, precision double, fiscal boolean, fiscal_start long, series long, categories long"""

# Fixed values of this library's rules.
MIN_POWER, MIN_PRECISION, MIN_N = 0.8, 0.9, 20
INSTRUMENTS = ("local government act", "tender regulations")
NUMBER = r"\d+(?:\.\d+)?%?"
FLAT = r"(?i)\b(flat|no difference|no effect)\b"
CAUSAL = r"(?i)\b(caus(?:ed?|es|ing)|led to|because of|drove|drives)\b"


def ruled(applies: Column, ok: Column, known: Column | None = None) -> Column:
    """not_applicable, unverifiable (where ``known`` is false), pass or fail."""
    out = F.when(~F.coalesce(applies, F.lit(False)), "not_applicable")
    if known is not None:
        out = out.when(~F.coalesce(known, F.lit(False)), "unverifiable")
    return out.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")


def rules() -> dict[str, Column]:
    c = F.col
    always = F.lit(True)
    has_ci = c("ci_low").isNotNull() & c("ci_high").isNotNull()
    null = F.coalesce("null_value", F.lit(0.0))
    story = F.concat_ws(" ", "headline", "body", "objection", "response")
    half = F.abs(c("ci_high") - c("ci_low")) / 2
    digits = F.when(half == 0, 3).when(half >= 0.05, 0).when(half >= 0.005, 1).otherwise(2)
    numbers = F.regexp_extract_all(story, F.lit(f"({NUMBER})"), F.lit(1))
    too_fine = F.exists(numbers, lambda x: x.contains(".") & (F.length(F.substring_index(F.rtrim(F.replace(x, F.lit("%"), F.lit(""))), ".", -1)) > digits))
    dims = F.transform(F.split("grain", "[ ,x]+"), F.lower)
    finer = F.arrays_overlap(dims, F.array(*map(F.lit, ("councillor", "firm", "person")))) & (F.size(dims) >= 2)
    empty = lambda x: F.coalesce(F.trim(c(x)) == "", F.lit(True))
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    persons = F.forall("individuals", lambda p: (p["n"] >= MIN_N) & p["ci_low"].isNotNull() & p["ci_high"].isNotNull())
    stated = F.array(c("value"), c("ci_low"), c("ci_high"), c("denominator_n").cast("double"), c("family_size").cast("double"))
    close = lambda x, y: (F.abs(x - y) < 0.006 * F.greatest(F.lit(1.0), F.abs(y))) | (F.abs(x - 100 * y) < 0.6)
    figure = lambda x: F.replace(x, F.lit("%"), F.lit("")).cast("double")
    sourced = F.forall(F.regexp_extract_all("headline", F.lit(f"({NUMBER})"), F.lit(1)), lambda x: F.exists(stated, lambda y: y.isNotNull() & close(figure(x), y)))
    rates = lambda x: F.regexp_extract_all(x, F.lit(r"(?i)\bof (?:the )?([\d,]+)\b"), F.lit(1))
    return {
        "L01": ruled(c("grade") == "critical", has_ci & ~((c("ci_low") <= null) & (null <= c("ci_high")))),
        "L02": ruled(c("grade") == "supportive", c("power") >= MIN_POWER),
        "L03": ruled(always, ~too_fine, has_ci),
        "L04": ruled(finer, c("clustering_unit").isNotNull()),
        "L05": ruled(c("names_individuals"), persons & (size("source_spans") > 0) & ~empty("response")),
        "L06": ruled(always, F.size(F.collect_set("denominator_n").over(Window.partitionBy("definition"))) <= 1),
        "L07": ruled(~c("same_event"), ~empty("reference_definition") & (size("caveats") > 0)),
        "L08": ruled(always, c("replayed_n") == c("denominator_n"), c("replayed_n").isNotNull()),
        "L09": ruled(size("frameworks") > 0, F.forall("frameworks", lambda f: f.isin(*INSTRUMENTS))),
        "L10": ruled(c("family_size") > 1, (c("correction") != "none") & c("survives_correction").isNotNull()),
        "L11": ruled(~empty("headline"), sourced),
        "L12": ruled((F.size(rates(c("headline"))) > 0) & (F.size(rates(c("body"))) > 0), F.arrays_overlap(rates(c("headline")), rates(c("body")))),
        "L13": ruled(story.rlike(FLAT), (c("ci_low") <= null) & (null <= c("ci_high")), has_ci),
        "L14": ruled(story.rlike(CAUSAL), c("comparison_type") == "within_subject"),
        "L15": ruled(c("precision").isNotNull(), c("precision") >= MIN_PRECISION),
        "L16": ruled(c("fiscal"), c("fiscal_start").isNotNull()),
        "L17": ruled(c("names_individuals"), F.forall("individuals", lambda p: F.trim(p["name"]).rlike(r"^\S+ \S+"))),
        "L18": ruled(c("categories").isNotNull(), c("series") == c("categories"), c("series").isNotNull()),
    }


def lint(claims: DataFrame) -> DataFrame:
    """(id, rule, status) of every rule on every claim."""
    found = rules()
    wide = claims.select("id", *(col.alias(name) for name, col in found.items()))
    return wide.unpivot("id", list(found), "rule", "status")


def shared_denominators(claims: DataFrame) -> DataFrame:
    """Definitions whose claims differ in their number of rows."""
    return claims.groupBy("definition").agg(F.count_distinct("denominator_n").alias("sizes")).filter("sizes > 1")


def invariants(claims: DataFrame, *, min_n: int = MIN_N) -> DataFrame:
    """(id, check): institutional claims carry no names, others have n above ``min_n``, individual ones resolved entities."""
    institutional = F.col("unit") == "institutional"
    checks = {
        "name-free-schema": institutional & (F.size("named_entities") > 0),
        "min-n": ~institutional & (F.coalesce("n", F.lit(0)) <= min_n),
        "entity-resolution": (F.col("unit") == "individual") & (F.col("entity_resolution") != "clean"),
    }
    broken = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in checks.items())))
    return claims.filter("data_ok").select("id", F.explode(broken).alias("check"))


def names_in_text(claims: DataFrame, roster: DataFrame) -> DataFrame:
    """(id, given, family) where a claim's text holds a full roster name: words are exploded and met by equality, then checked in place."""
    usable = roster.filter((F.length(F.trim("given")) >= 2) & (F.length(F.trim("family")) >= 2) & ~F.lower("family").isin("the", "and", "of", "mayor", "council"))
    words = claims.select("id", "text", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}'-]+"))).alias("word"))
    met = words.join(usable, F.col("word") == F.lower("family"))
    return met.filter(F.contains(F.lower("text"), F.lower(F.concat_ws(" ", "given", "family")))).select("id", "given", "family").distinct()


def tiers(claims: DataFrame, *, min_n: int = MIN_N) -> DataFrame:
    """Public where a claim breaks no invariant and is institutional, else restricted."""
    broken = invariants(claims, min_n=min_n).select("id").distinct().withColumn("broken", F.lit(True))
    return claims.join(broken, "id", "left").select("id", F.when((F.col("unit") == "institutional") & F.col("broken").isNull() & F.col("data_ok"), "public").otherwise("restricted").alias("tier"))


def merge_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings by id: the newer state, and all rounds that saw it."""
    both = old.withColumn("late", F.lit(0)).unionByName(new.withColumn("late", F.lit(1)))
    return both.groupBy("id").agg(F.max_by("state", "late").alias("state"), F.max_by("severity", "late").alias("severity"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rounds")))).alias("rounds"))


def blocking_open(findings: DataFrame) -> DataFrame:
    return findings.filter("severity = 'blocking' AND state = 'open'")


def reply_packets(claims: DataFrame, sent: DataFrame) -> DataFrame:
    """One packet a person: the claims that name them and were not sent before."""
    named_ = claims.select("id", F.explode("named_entities").alias("person"))
    return named_.join(sent.select("id", "person"), ["id", "person"], "left_anti").groupBy("person").agg(F.sort_array(F.collect_set("id")).alias("claims"), F.substring(F.sha2("person", 256), 1, 8).alias("token"))


def drifted(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose hash is not that of the manifest, or that are in one only."""
    return manifest.alias("m").join(files.alias("f"), "name", "full").filter(~F.col("m.sha").eqNullSafe(F.col("f.sha"))).select("name")


_CLAIMS_SQL = f"SELECT claim_id, value, ci_low, ci_high FROM ({_WILSON_SQL}) a UNION ALL SELECT claim_id, value, ci_low, ci_high FROM ({_WALD_SQL}) b"


@named(f"""SELECT claim_id, value, ci_low <= 0 AND 0 <= ci_high AS contains_zero, CASE WHEN ci_high - ci_low >= 0.1 THEN 0 WHEN ci_high - ci_low >= 0.01 THEN 1 ELSE 2 END AS digits FROM ({_CLAIMS_SQL}) c""")
def claim_precision(t) -> DataFrame:
    """Of all claims: whether the interval holds zero, and how many decimals its width bears."""
    cols = ["claim_id", "value", "ci_low", "ci_high"]
    c = share_claims(t).select(cols).unionByName(difference_claims(t).select(cols))
    width = F.col("ci_high") - F.col("ci_low")
    return c.select("claim_id", "value", ((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)).alias("contains_zero"), F.when(width >= 0.1, 0).when(width >= 0.01, 1).otherwise(2).alias("digits"))


def replay(df: DataFrame, steps: list[tuple[str, str]]) -> tuple[DataFrame, str]:
    """A population: a chain of named filters over a gold table, and its text."""
    for _, condition in steps:
        df = df.filter(condition)
    return df, " -> ".join(name for name, _ in steps)


_STEPS = [("minutes", "document_type = 'minutes'"), ("carried", "outcome = 'carried'"), ("contested", "votes_against >= 1")]


@named("""SELECT 'minutes -> carried -> contested' AS chain, count(*) AS n FROM motions m JOIN meetings g ON g.id = m.meeting_id WHERE document_type = 'minutes' AND outcome = 'carried' AND votes_against >= 1""")
def replay_population(t) -> DataFrame:
    g = t.meetings.select(F.col("id").alias("meeting_id"), "document_type")
    df, text = replay(t.motions.join(g, "meeting_id"), _STEPS)
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(text).alias("chain"), "n")


@named("""SELECT v.id AS vote_id, v.motion_id, m.meeting_id, v.councillor_id, CASE WHEN choice <> 'absent' THEN choice WHEN declared_interest THEN 'absent: recusal' WHEN a.status = 'apology' THEN 'absent: non_attendance' ELSE 'absent: unknown' END AS position
    FROM votes v JOIN motions m ON m.id = v.motion_id LEFT JOIN attendance a ON a.meeting_id = m.meeting_id AND a.councillor_id = v.councillor_id""")
def vote_fact(t) -> DataFrame:
    m = t.motions.select(F.col("id").alias("motion_id"), "meeting_id")
    kind = F.when(F.col("choice") != "absent", F.col("choice")).when(F.col("declared_interest"), "absent: recusal").when(F.col("status") == "apology", "absent: non_attendance").otherwise("absent: unknown")
    return t.votes.join(m, "motion_id").join(t.attendance, ["meeting_id", "councillor_id"], "left").select(F.col("id").alias("vote_id"), "motion_id", "meeting_id", "councillor_id", kind.alias("position"))


@named("SELECT id AS declaration_id, meeting_id, councillor_id, interest_type, item_reference FROM declarations")
def declaration_fact(t) -> DataFrame:
    return t.declarations.select(F.col("id").alias("declaration_id"), "meeting_id", "councillor_id", "interest_type", "item_reference")


@named("SELECT id AS question_id, meeting_id, CASE WHEN trim(coalesce(response, '')) <> '' THEN 'answered' ELSE 'unknown' END AS status FROM questions")
def question_fact(t) -> DataFrame:
    return t.questions.select(F.col("id").alias("question_id"), "meeting_id", F.when(F.trim(F.coalesce("response", F.lit(""))) != "", "answered").otherwise("unknown").alias("status"))


@named("SELECT id AS appointment_id, meeting_id, councillor_id, body_name, role FROM appointments")
def membership_fact(t) -> DataFrame:
    return t.appointments.select(F.col("id").alias("appointment_id"), "meeting_id", "councillor_id", "body_name", "role")


@named("SELECT id AS motion_id, meeting_id, item_number, moved_by_id AS mover_id, seconded_by_id AS seconder_id, outcome FROM motions")
def motion_fact(t) -> DataFrame:
    return t.motions.select(F.col("id").alias("motion_id"), "meeting_id", "item_number", F.col("moved_by_id").alias("mover_id"), F.col("seconded_by_id").alias("seconder_id"), "outcome")


@named("SELECT id AS tender_id, meeting_id, reference_number, amount, amount IS NOT NULL AS value_recorded, is_confidential AS confidential FROM tenders")
def tender_fact(t) -> DataFrame:
    return t.tenders.select(F.col("id").alias("tender_id"), "meeting_id", "reference_number", "amount", F.col("amount").isNotNull().alias("value_recorded"), F.col("is_confidential").alias("confidential"))
