"""The test battery, its claims and the rating.

A test is a named query, an aggregate over its rows and a rule that grades the
value. Aggregates and rules are in the dialect that Spark and the oracle share,
so a test is a row of a table, not a function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry
from ..functions.stats import Z95, wald_difference, wilson
from ..operators import conflicts, people, planning, procurement, sponsorship  # noqa: F401
from ..registry import ORACLE_SQL, named


def pick(value: str, where: str) -> str:
    return f"max(CASE WHEN {where} THEN {value} END)"


def grade(good: str, bad: str | None = None) -> str:
    rest = f"WHEN {bad} THEN 'critical' ELSE 'neutral'" if bad else "ELSE 'critical'"
    return f"CASE WHEN value IS NULL THEN 'not_computable' WHEN {good} THEN 'supportive' {rest} END"


ON_NOTICE_RATE = "sum(CASE WHEN era = '{0}' AND status = 'on_notice' THEN n ELSE 0 END) / sum(CASE WHEN era = '{0}' AND status <> 'blank' THEN n END)"
#: The grade of tests that describe and don't judge.
DESCRIBED = "CASE WHEN value IS NULL THEN 'not_computable' ELSE 'neutral' END"

#: (test, query, value, number of rows behind it, grade)
TESTS: list[tuple[str, str, str, str, str]] = [
    ("threshold_gaming", "threshold_bins", f"coalesce({pick('n', 'bin = ' + repr('just below'))} / {pick('n', 'bin = ' + repr('just above'))}, 0)", "sum(n)", grade("value <= 1.6")),
    ("procurement_incumbency", "incumbency", "avg(CASE WHEN top10 AND repeat_winner THEN 1e0 ELSE 0 END)", "count(*)", grade("value = 0")),
    ("tender_concentration", "tender_concentration", "max(top10_share)", "sum(total_awards)", DESCRIBED),
    ("decider_supplier_conflict", "collisions_against_chance", "max(collisions - expected)", "max(collisions)", "CASE WHEN value IS NULL THEN 'not_computable' WHEN value <= 0 THEN 'supportive' ELSE 'neutral' END"),
    ("recusal_overall", "conflict_recusal", "max(declared_recused / declared_total)", "sum(declared_total)", grade("value >= 0.5")),
    ("recusal_trend", "recusal_by_year", f"{pick('must_leave_rate', 'year = 2000')} - {pick('must_leave_rate', 'year = 1995')}", "sum(declared)", grade("value > 0.05", "value < -0.05")),
    ("delegate_body_conflict", "delegate_windows", f"{pick('declared_rate', 'affiliated')} - {pick('declared_rate', 'NOT affiliated')}", "sum(votes)", grade("value >= 0", "value < -0.05")),
    ("big_dollar_leniency", "value_quartiles", "max(approval_rate) - min(approval_rate)", "sum(n)", grade("value <= 0.12")),
    ("repeat_applicant", "applicant_frequency", "max(approval_rate) - min(approval_rate)", "sum(n)", grade("value <= 0.05", "value > 0.14")),
    ("objection_dose", "objection_dose", f"{pick('refusal_rate', 'bucket = ' + repr('5+'))} - {pick('refusal_rate', 'bucket = ' + repr('0'))}", "sum(n)", grade("value >= 0.1", "value < 0")),
    ("officer_divergence", "officer_divergence_exact", "avg(CASE WHEN diverged THEN 0e0 ELSE 1 END)", "count(*)", grade("value < 0.85")),
    ("voting_power", "power_swings", "max(swing)", "sum(n)", "CASE WHEN value IS NULL THEN 'not_computable' WHEN value > 0.15 THEN 'neutral' ELSE 'critical' END"),
    ("oversight_body_capture", "oversight_capture", f"abs({pick('win_rate', 'appointee')} - {pick('win_rate', 'NOT appointee')})", "sum(votes)", grade("value <= 0.1")),
    ("unanimity_trend", "unanimity_trend", "max(contested_share) - min(contested_share)", "sum(carried)", grade("value <= 0.1", "value > 0.3")),
    ("mayoral", "mayoral_interval", f"{pick('contest_rate', 'mayor')} - {pick('contest_rate', 'NOT mayor')}", "sum(moved)", grade("value >= -0.05")),
    ("sponsorship", "sponsorship_lift", "avg(CASE WHEN lift >= 1.8 THEN 1e0 ELSE 0 END)", "count(*)", DESCRIBED),
    ("tenure", "tenure_summary", "max(median_years)", "sum(n_councillors)", DESCRIBED),
    ("freshman", "freshman_effect", f"{pick('rate', 'first_year')} - {pick('rate', 'NOT first_year')}", "sum(n)", grade("abs(value) <= 0.05")),
    ("election_cycle", "election_cycle", f"{pick('rate', 'in_window')} - {pick('rate', 'NOT in_window')}", "sum(n)", grade("abs(value) <= 0.05")),
    ("attendance", "attendance_split", "sum(CASE WHEN kind IN ('non_attendance', 'unknown') THEN n ELSE 0 END) / sum(n)", "sum(n)", grade("value <= 0.1")),
    ("transparency", "transparency_peak", "max(peak_share - pre_share)", "count(*)", grade("value <= 0.1")),
    ("confidential_tender_size", "confidential_median", f"{pick('median_amount', 'is_confidential')} / {pick('median_amount', 'NOT is_confidential')}", "sum(n)", grade("value <= 1.2")),
    ("confidential_topics", "topic_lift", f"{pick('lift', 'theme = ' + repr('development'))} - min(lift)", "sum(n)", grade("value <= 0")),
    ("eoy_spending", "eoy_share", "max(dollar_share)", "count(*)", grade("value < 2 * 17 / 100.0")),
    ("engagement", "engagement_by_year", "avg(total)", "sum(total)", grade("value >= 10")),
    ("deputation_dissent", "deputation_semi", f"{pick('contest_rate', 'with_deputation')} - {pick('contest_rate', 'NOT with_deputation')}", "sum(n)", grade("value >= 0")),
    ("question_responsiveness", "question_responsiveness", f"{ON_NOTICE_RATE.format('post')} - {ON_NOTICE_RATE.format('pre')}", "sum(n)", grade("value < -0.05", "value > 0.05")),
]
#: Tests that the record can't answer.
OPEN = ("single_source", "reserve_trajectory")

_TEST_SQL = " UNION ALL ".join(
    f"SELECT '{test}' AS test_id, value, n, {rule} AS valence FROM (SELECT cast({value} AS double) AS value, cast({n} AS bigint) AS n FROM ({ORACLE_SQL[query]}) q) v" for test, query, value, n, rule in TESTS
) + "".join(f" UNION ALL SELECT '{test}', NULL, 0, 'not_computable'" for test in OPEN)


def frames(t, names: set[str]) -> dict[str, DataFrame]:
    """The named queries on the same civic tables."""
    from ..operators import evidence, records, verification

    modules = (conflicts, people, planning, procurement, sponsorship, evidence, records, verification)
    return {n: next(getattr(m, n) for m in modules if hasattr(m, n))(t) for n in names}


@named(_TEST_SQL)
def battery(t) -> DataFrame:
    found = frames(t, {q for _, q, *_ in TESTS})
    out = None
    for test, query, value, n, rule in TESTS:
        one = found[query].selectExpr(f"cast({value} AS double) AS value", f"cast({n} AS bigint) AS n").selectExpr(f"'{test}' AS test_id", "value", "n", f"{rule} AS valence")
        out = one if out is None else out.unionByName(one)
    for test in OPEN:
        out = out.unionByName(out.sparkSession.createDataFrame([(test, None, 0, "not_computable")], "test_id string, value double, n long, valence string"))
    return out


#: What a test is about; two critical tests of one subject keep a record out of the best band.
SUBJECTS = {
    "procurement": ("threshold_gaming", "procurement_incumbency", "tender_concentration", "decider_supplier_conflict", "single_source", "eoy_spending", "reserve_trajectory"),
    "conflict": ("recusal_overall", "recusal_trend", "delegate_body_conflict", "oversight_body_capture"),
    "planning": ("big_dollar_leniency", "repeat_applicant", "objection_dose", "officer_divergence"),
    "governance": ("voting_power", "unanimity_trend", "mayoral", "sponsorship", "tenure", "freshman", "election_cycle", "attendance"),
    "openness": ("transparency", "confidential_tender_size", "confidential_topics", "engagement", "deputation_dissent", "question_responsiveness"),
}
_MOST = "greatest(" + ", ".join("count(CASE WHEN valence = 'critical' AND test_id IN (" + ", ".join(f"'{x}'" for x in names) + ") THEN 1 END)" for names in SUBJECTS.values()) + ")"
_SUMMARY = "count(CASE WHEN valence = 'supportive' THEN 1 END) AS supportive, count(CASE WHEN valence = 'neutral' THEN 1 END) AS neutral, count(CASE WHEN valence = 'critical' THEN 1 END) AS critical, count(CASE WHEN valence = 'not_computable' THEN 1 END) AS not_computable, count(CASE WHEN valence IN ('supportive', 'critical') THEN 1 END) AS decisive"
#: A band needs six tenths of the tests computable and eight decisive ones.
_BAND = "CASE WHEN decisive < 8 OR (supportive + neutral + critical) < 0.6 * (supportive + neutral + critical + not_computable) THEN 'insufficient' WHEN critical / decisive <= 0.2 AND most_of_a_subject < 2 THEN 'green' WHEN critical / decisive <= 0.45 THEN 'yellow' ELSE 'red' END"


@named(f"SELECT *, {_BAND} AS band FROM (SELECT {_SUMMARY}, {_MOST} AS most_of_a_subject FROM ({_TEST_SQL}) b) s")
def rating_band(t) -> DataFrame:
    """Counts by grade and the band of the critical share among decisive tests; too few computable or decisive tests give no band."""
    return battery(t).selectExpr(*_parts(), f"{_MOST} AS most_of_a_subject").selectExpr("*", f"{_BAND} AS band")


def _parts() -> list[str]:
    return ["count" + x if i else x for i, x in enumerate(_SUMMARY.split(", count"))]


#: Shares: (claim, query, hits, rows)
SHARES: list[tuple[str, str, str, str]] = [
    ("officer_divergence", "officer_divergence_exact", "count(CASE WHEN NOT diverged THEN 1 END)", "count(*)"),
    ("threshold_gaming", "threshold_bins", "sum(CASE WHEN bin = 'just below' THEN n END)", "sum(CASE WHEN bin IN ('just below', 'just above') THEN n END)"),
    ("unanimity_trend", "contestation_by_year", "sum(contested)", "sum(total_carried)"),
    ("attendance", "attendance_split", "sum(CASE WHEN kind IN ('non_attendance', 'unknown') THEN n ELSE 0 END)", "sum(n)"),
    ("recusal_overall", "conflict_recusal", "sum(declared_recused)", "sum(declared_total)"),
    ("tender_concentration", "tender_concentration", "sum(redacted_awards)", "sum(total_awards)"),
    ("decider_supplier_conflict", "decider_supplier_rates", "sum(declared_rate * votes_on_tender_motions)", "sum(votes_on_tender_motions)"),
    ("tally_match", "tally_reconcile", "sum(matched)", "sum(checked)"),
    ("term_coverage", "term_coverage", "sum(with_terms)", "sum(voters)"),
    ("attendance_vs_votes", "attendance_vs_votes", "sum(reconciled)", "sum(checked)"),
]
#: Differences: (claim, query, hits and rows of the first group, of the second)
GAPS: list[tuple[str, str, str, str, str, str]] = [
    ("freshman", "freshman_effect", "sum(CASE WHEN NOT first_year THEN against END)", "sum(CASE WHEN NOT first_year THEN n END)", "sum(CASE WHEN first_year THEN against END)", "sum(CASE WHEN first_year THEN n END)"),
    ("objection_dose", "objection_dose", "sum(CASE WHEN bucket = '0' THEN refused END)", "sum(CASE WHEN bucket = '0' THEN n END)", "sum(CASE WHEN bucket = '5+' THEN refused END)", "sum(CASE WHEN bucket = '5+' THEN n END)"),
    ("election_cycle", "election_cycle", "sum(CASE WHEN NOT in_window THEN round(rate * n) END)", "sum(CASE WHEN NOT in_window THEN n END)", "sum(CASE WHEN in_window THEN round(rate * n) END)", "sum(CASE WHEN in_window THEN n END)"),
    ("deputation_dissent", "deputation_semi", "sum(CASE WHEN NOT with_deputation THEN round(contest_rate * n) END)", "sum(CASE WHEN NOT with_deputation THEN n END)", "sum(CASE WHEN with_deputation THEN round(contest_rate * n) END)", "sum(CASE WHEN with_deputation THEN n END)"),
    ("mayoral", "mayoral_interval", "sum(CASE WHEN NOT mayor THEN round(contest_rate * moved) END)", "sum(CASE WHEN NOT mayor THEN moved END)", "sum(CASE WHEN mayor THEN round(contest_rate * moved) END)", "sum(CASE WHEN mayor THEN moved END)"),
    ("big_dollar_leniency", "value_quartiles", "sum(CASE WHEN quartile = 1 THEN round(approval_rate * n) END)", "sum(CASE WHEN quartile = 1 THEN n END)", "sum(CASE WHEN quartile = 4 THEN round(approval_rate * n) END)", "sum(CASE WHEN quartile = 4 THEN n END)"),
    ("repeat_applicant", "applicant_frequency", "sum(CASE WHEN frequency = '4-6' THEN round(approval_rate * n) END)", "sum(CASE WHEN frequency = '4-6' THEN n END)", "sum(CASE WHEN frequency = '7+' THEN round(approval_rate * n) END)", "sum(CASE WHEN frequency = '7+' THEN n END)"),
    ("oversight_body_capture", "oversight_capture", "sum(CASE WHEN NOT appointee THEN round(win_rate * votes) END)", "sum(CASE WHEN NOT appointee THEN votes END)", "sum(CASE WHEN appointee THEN round(win_rate * votes) END)", "sum(CASE WHEN appointee THEN votes END)"),
    ("delegate_body_conflict", "delegate_windows", "sum(CASE WHEN NOT affiliated THEN round(declared_rate * votes) END)", "sum(CASE WHEN NOT affiliated THEN votes END)", "sum(CASE WHEN affiliated THEN round(declared_rate * votes) END)", "sum(CASE WHEN affiliated THEN votes END)"),
    ("transparency", "transparency_union", "sum(CASE WHEN year < 1997 THEN confidential END)", "sum(CASE WHEN year < 1997 THEN total END)", "sum(CASE WHEN year >= 1997 THEN confidential END)", "sum(CASE WHEN year >= 1997 THEN total END)"),
    ("question_responsiveness", "question_responsiveness", "sum(CASE WHEN era = 'pre' AND status = 'on_notice' THEN n ELSE 0 END)", "sum(CASE WHEN era = 'pre' THEN n END)", "sum(CASE WHEN era = 'post' AND status = 'on_notice' THEN n ELSE 0 END)", "sum(CASE WHEN era = 'post' THEN n END)"),
]

_WILSON_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS claim_id, cast(k AS bigint) AS k, cast(n AS bigint) AS n, k / n AS value, (k / n + {Z95 * Z95} / (2 * n)) / (1 + {Z95 * Z95} / n) - {Z95} * sqrt(k / n * (1 - k / n) / n + {Z95 * Z95} / (4 * n * n)) / (1 + {Z95 * Z95} / n) AS ci_low,
    (k / n + {Z95 * Z95} / (2 * n)) / (1 + {Z95 * Z95} / n) + {Z95} * sqrt(k / n * (1 - k / n) / n + {Z95 * Z95} / (4 * n * n)) / (1 + {Z95 * Z95} / n) AS ci_high FROM (SELECT cast({k} AS double) AS k, cast({n} AS double) AS n FROM ({ORACLE_SQL[q]}) q) x"""
    for c, q, k, n in SHARES
    if q in ORACLE_SQL
)


def _of(t, specs: list[tuple]) -> list[tuple[str, DataFrame]]:
    found = frames(t, {s[1] for s in specs})
    return [(s[0], found[s[1]].selectExpr(*(f"cast({e} AS double) AS x{i}" for i, e in enumerate(s[2:])))) for s in specs]


@named(_WILSON_SQL)
def share_claims(t) -> DataFrame:
    """Shares with Wilson intervals."""
    out = None
    for claim, df in _of(t, [s for s in SHARES if s[1] in ORACLE_SQL]):
        p, low, high = wilson(F.col("x0"), F.col("x1"))
        one = df.select(F.lit(claim).alias("claim_id"), F.col("x0").cast("long").alias("k"), F.col("x1").cast("long").alias("n"), p.alias("value"), low.alias("ci_low"), high.alias("ci_high"))
        out = one if out is None else out.unionByName(one)
    return out


_WALD_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS claim_id, k2 / n2 - k1 / n1 AS value, k2 / n2 - k1 / n1 - {Z95} * sqrt(k1 / n1 * (1 - k1 / n1) / n1 + k2 / n2 * (1 - k2 / n2) / n2) AS ci_low, k2 / n2 - k1 / n1 + {Z95} * sqrt(k1 / n1 * (1 - k1 / n1) / n1 + k2 / n2 * (1 - k2 / n2) / n2) AS ci_high, cast(n1 + n2 AS bigint) AS n
    FROM (SELECT cast({a} AS double) AS k1, cast({b} AS double) AS n1, cast({d} AS double) AS k2, cast({e} AS double) AS n2 FROM ({ORACLE_SQL[q]}) q) x"""
    for c, q, a, b, d, e in GAPS
)


@named(_WALD_SQL)
def difference_claims(t) -> DataFrame:
    """Differences of two shares with Wald intervals."""
    out = None
    for claim, df in _of(t, GAPS):
        p, low, high = wald_difference(*(F.col(f"x{i}") for i in range(4)))
        one = df.select(F.lit(claim).alias("claim_id"), p.alias("value"), low.alias("ci_low"), high.alias("ci_high"), (F.col("x1") + F.col("x3")).cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@named(f"""SELECT regr_slope(total, year) AS slope, regr_sxx(total, year) AS sxx, regr_syy(total, year) AS syy, count(*) AS n FROM ({ORACLE_SQL['engagement_by_year']}) q""")
def ols_trend(t) -> DataFrame:
    """Slope of yearly totals with the sums that its t interval needs."""
    return people.engagement_by_year(t).agg(F.regr_slope("total", "year").alias("slope"), F.regr_sxx("total", "year").alias("sxx"), F.regr_syy("total", "year").alias("syy"), F.count(F.lit(1)).alias("n"))


@named(f"""SELECT avg(p) AS value, stddev_samp(p) AS sd, count(*) AS clusters FROM (SELECT councillor_id, avg(CASE WHEN recused THEN 1.0 ELSE 0 END) AS p FROM ({conflicts._LINKED}) l GROUP BY 1) x""")
def clustered_mean(t) -> DataFrame:
    each = conflicts.linked(t).groupBy("councillor_id").agg(F.avg(F.col("recused").cast("double")).alias("p"))
    return each.agg(F.avg("p").alias("value"), F.stddev_samp("p").alias("sd"), F.count(F.lit(1)).alias("clusters"))


@named()
def clustered_interval(t) -> DataFrame:
    """Recusal by person with a t interval over persons."""
    from ..functions.stats import clustered_share

    return clustered_share(conflicts.linked(t), "councillor_id", F.col("recused"))


@named()
def tender_size_tests(t) -> DataFrame:
    """Median difference of closed and open awards with its bootstrap interval, and the rank-sum test, by year.

    Each group is one year's awards: a bounded group by the calendar.
    """
    import numpy as np
    import pandas as pd

    from ..functions import stats

    schema = "year int, difference double, ci_low double, ci_high double, u double, p double"

    def year(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (rows.loc[rows.is_confidential == c, "amount"].to_numpy(float) for c in (False, True))
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=["year", "difference", "ci_low", "ci_high", "u", "p"])
        d = stats.bootstrap_median_difference(a, b, resamples=999)
        return pd.DataFrame([(int(rows.year.iloc[0]), *d, *stats.mann_whitney(a, b))], columns=["year", "difference", "ci_low", "ci_high", "u", "p"])

    return t.tenders.filter("amount IS NOT NULL").select(F.col("year").cast("int").alias("year"), "amount", "is_confidential").groupBy("year").applyInPandas(year, schema)
