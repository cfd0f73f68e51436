from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import stats, text


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(col).first()[0]


def test_wilson(spark):
    p, low, high = stats.wilson(F.lit(8.0), F.lit(10.0))
    assert spark.range(1).select(p, low, high).first()[:] == pytest.approx((0.8, 0.49016, 0.94331), abs=1e-4)
    assert spark.range(1).select(stats.wilson(F.lit(0.0), F.lit(0.0))[1]).first()[0] is None


def test_tails():
    assert stats.t_tail(2.0, 10) == pytest.approx(0.07338, abs=1e-5)
    assert stats.t_quantile(10) == pytest.approx(2.22814, abs=1e-4)
    assert stats.clopper_pearson(8, 10) == pytest.approx((0.44390, 0.97479), abs=1e-4)
    assert stats.clopper_pearson(0, 10)[0] == 0.0 and stats.clopper_pearson(10, 10)[1] == 1.0
    x, p, df = stats.chi_square([[10, 20], [20, 10]])
    assert (x, df) == (pytest.approx(5.4), 1) and p == pytest.approx(0.02014, abs=1e-4)
    assert stats.hypergeometric_tail(50, 5, 10, 4) == pytest.approx(0.004, abs=2e-4)
    u, p = stats.mann_whitney(np.array([1.0, 2, 3, 4]), np.array([5.0, 6, 7, 8]))
    assert u == 0 and p == pytest.approx(0.0304, abs=1e-3)


def test_resampling_is_seeded():
    a, b = np.arange(20.0), np.arange(20.0) + 5
    assert stats.bootstrap_median(a, 500) == stats.bootstrap_median(a, 500)
    d, low, high = stats.bootstrap_median_difference(a, b, 500)
    assert low <= d <= high and d == 5
    assert stats.permutation_difference(a, b, 199)[1] < 0.2


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 200), st.data())
def test_clopper_pearson_holds_the_share(n, data):
    k = data.draw(st.integers(0, n))
    low, high = stats.clopper_pearson(k, n)
    assert low - 1e-9 <= k / n <= high + 1e-9


def test_text(spark):
    assert one(spark, text.firm_key(F.col("x")), x="Acme Works Pty Ltd.") == "acmeworks"
    assert one(spark, text.reference_key(F.col("x")), x="RFT-12/Ä 3") == "rft12ä3"
    assert one(spark, text.is_placeholder(F.col("x")), x="Respondent 4")
    assert one(spark, text.street_name(F.col("x")), x="12A High Street, Northtown") == "High Street"
    assert one(spark, text.suburb(F.col("x")), x="12A High Street, Northtown") == "Northtown"
    assert one(spark, text.outcome(F.col("x")), x=" Carried 5/4") == "carried"
    assert one(spark, text.amount(F.col("x")), x="$1,234.50") == 1234.5
    assert "Smith" not in one(spark, text.redacted(F.col("x")), x="Mr John Smith spoke")
    assert one(spark, text.slug(F.col("a"), F.col("b")), a="Ann", b="O'Neil") == "ann-o-neil"


def test_firms_and_placeholders(spark):
    keys = {"Empty Bins Co": "emptybinsco", "Unlimited Foods": "unlimitedfoods", "R J Vincent P/L": "rjvincent", "Acme Pty. Ltd.": "acme", " RJ Vincent Pty Ltd": "rjvincent"}
    df = spark.createDataFrame([(k,) for k in keys], "x string")
    assert {r[0]: r[1] for r in df.select("x", text.firm_key(F.col("x"))).collect()} == keys
    hidden = {"Supplier 2": True, "Respondent": True, "Party A": False, "Tenderer-3": True, "contractor #4": True, "Partyline Works": False, "Entity: 12": True}
    df = spark.createDataFrame([(k,) for k in hidden] + [(None,)], "x string")
    assert {r[0]: r[1] for r in df.select("x", text.is_placeholder(F.col("x"))).collect()} == hidden | {None: False}


def test_private_names(spark):
    held = text.WITHHELD
    want = {
        "OWNER: Jane Roe ZONING: R20": f"{held} ZONING: R20",
        "Applicants: A Co\nnext line": f"{held}\nnext line",
        "Mrs Mary Ann Lee asked": f"{held} asked",
        "Landowner: X": held,
        "Dr and nurse": "Dr and nurse",
    }
    df = spark.createDataFrame([(k,) for k in want], "x string")
    got = {r[0]: (r[1], r[2]) for r in df.select("x", text.redacted(F.col("x")), text.has_private_name(F.col("x"))).collect()}
    assert got == {k: (v, k != v) for k, v in want.items()}


def test_normalised_words(spark):
    from tallyloom.functions import normalise as n

    x = F.col("x")
    cases = [
        (n.position, {" Objection": "object", "in favour": "support", "comment": "neutral", "maybe": None}),
        (n.status, {"Granted": "approved", "not approved": "refused", "appealed": "appealed", "?": None}),
        (n.interest_type, {"Financial Interest": "financial", "kinship": "other"}),
        (n.integer, {" 1,204 ": 1204, "many": None}),
        (n.vote_count, {" 7": 7, "7/2": None}),
        (n.tags, {"a, b,,c ": ["a", "b", "c"]}),
        (n.person, {"Cr John Q Smith": ("John Q", "Smith"), "Deputy Mayor Barlow": ("", "Barlow"), "Cr. ": ("", ""), "Cr.": ("", "Cr.")}),
        (n.vote, {"Motion 1 - Cr Ann Lee - Against": ("Ann", "Lee", "against"), "Cr Lee - FOR": (None, "Lee", "for"), "Cr Lee": None, "a - b": None}),
        (n.unaddressable, {"Intersection of A and B": "intersection", "road reserve 4": "road_reserve", "Activity Centre": "no_street_number", "4 High St": None, "Park (Lot 5 on Deposited Plan 27017)": "no_street_number"}),
        (n.suburb, {"4 High St, Old Town, North ": "North", "4 High St": None, "x,": None}),
        (n.sites, {"1 A St (Lots 2 & 3; 4); 5 B St & 6 C St": ["1 A St (Lots 2 & 3; 4)", "5 B St", "6 C St"]}),
        (
            n.address,
            {
                "Lot 82 (No. 25) Brighton Street, West": "25 Brighton Street, West",
                "Lot 395 Brighton Street": "Brighton Street",
                "Lot 4 (Nos 346-350) Cambridge Street": "346 Cambridge Street",
                "Lot 37 (No. 77A and 77B) Lake Drive": "77A Lake Drive",
                "No 15 (Lot 301) Bernard Street": "15 Bernard Street",
                "20 Norbury Crescent (Lot 5 on Deposited Plan 27017)": "20 Norbury Crescent",
            },
        ),
    ]
    for f, want in cases:
        df = spark.createDataFrame([(k,) for k in want], "x string")
        got = {r[0]: tuple(r[1]) if hasattr(r[1], "asDict") else r[1] for r in df.select("x", f(x)).collect()}
        assert got == want, f.__name__


def test_names_and_dates(spark):
    from tallyloom.functions import normalise as n

    names = {("Cr Gavin", "Foley"): ("Gavin", "Foley"), ("Barlow", "Cr"): ("", "Barlow"), ("null", "Lee"): ("", "Lee"), ("Lee", "lee"): ("", "lee"), ("Le", "Page"): ("", "Le Page"), ("Deputy Mayor Ann", "Day"): ("Ann", "Day"), (None, None): ("", "")}
    df = spark.createDataFrame(list(names), "g string, f string")
    assert {(r.g, r.f): tuple(r.c) for r in df.select("g", "f", n.councillor_name(F.col("g"), F.col("f")).alias("c")).collect()} == names
    dates = {"Held on 7 March 2021 at": "2021-03-07", "31 Feb 2020": None, "no date": None, "1 sep 1999, 2 oct 1999": "1999-09-01", "x" * 3000 + " 1 May 2001": None}
    df = spark.createDataFrame([(k,) for k in dates], "x string")
    assert {r[0]: r[1] and str(r[1]) for r in df.select("x", n.meeting_date(F.col("x"))).collect()} == dates
