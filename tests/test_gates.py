from __future__ import annotations

import pytest

from tallyloom.plans import gates
from tallyloom.streaming import windows

BASE = dict(
    id="c", grade="neutral", value=0.4, ci_low=0.35, ci_high=0.45, null_value=0.0, power=0.9, grain="meeting", clustering_unit=None, definition="d", denominator_n=100, replayed_n=100, names_individuals=False, individuals=[], source_spans=["s"], same_event=True,
    reference_definition="", comparison_type="between", frameworks=[], family_size=1, correction="none", survives_correction=None, headline="40% of 100", body="of 100 motions", objection="", response="r", caveats=[], precision=None, fiscal=False, fiscal_start=None, series=None, categories=None,
)


def status(spark, rule, **change):
    rows = [tuple((BASE | change)[f.split()[0].strip()] for f in COLUMNS)]
    return {r.rule: r.status for r in gates.lint(spark.createDataFrame(rows, gates.CLAIM)).collect()}[rule]


COLUMNS = list(BASE)


@pytest.mark.parametrize(
    "rule, change, want",
    [
        ("L01", {"grade": "critical"}, "pass"), ("L01", {"grade": "critical", "ci_low": -0.1}, "fail"), ("L01", {}, "not_applicable"),
        ("L02", {"grade": "supportive", "power": 0.5}, "fail"), ("L03", {"headline": "40.25% of 100"}, "fail"), ("L03", {}, "pass"), ("L03", {"ci_low": None}, "unverifiable"),
        ("L04", {"grain": "meeting, councillor"}, "fail"), ("L05", {"names_individuals": True, "individuals": [("A B", 3, 0.1, 0.2)]}, "fail"),
        ("L07", {"same_event": False}, "fail"), ("L07", {"same_event": False, "reference_definition": "x", "caveats": ["y"]}, "pass"),
        ("L08", {"replayed_n": 99}, "fail"), ("L08", {"replayed_n": None}, "unverifiable"), ("L09", {"frameworks": ["elsewhere"]}, "fail"),
        ("L10", {"family_size": 5}, "fail"), ("L11", {"headline": "77% of 100"}, "fail"), ("L11", {}, "pass"), ("L12", {"body": "of 90 motions"}, "fail"),
        ("L13", {"headline": "no difference"}, "fail"), ("L14", {"body": "which caused it"}, "fail"), ("L15", {"precision": 0.5}, "fail"), ("L16", {"fiscal": True}, "fail"),
        ("L17", {"names_individuals": True, "individuals": [("Solo", 30, 0.1, 0.2)]}, "fail"), ("L18", {"categories": 3, "series": 2}, "fail"),
    ],
)
def test_rules(spark, rule, change, want):
    assert status(spark, rule, **change) == want


def test_shared_denominators(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "definition string, denominator_n long")
    assert [r.definition for r in gates.shared_denominators(df).collect()] == ["a"]


def test_invariants_and_tiers(spark):
    rows = [("a", "institutional", [], 5, "clean", True), ("b", "institutional", ["X Y"], 5, "clean", True), ("c", "individual", ["X Y"], 5, "open", True), ("d", "individual", [], 1, "open", False)]
    df = spark.createDataFrame(rows, "id string, unit string, named_entities array<string>, n long, entity_resolution string, data_ok boolean")
    assert {(r.id, r.check) for r in gates.invariants(df).collect()} == {("b", "name-free-schema"), ("c", "min-n"), ("c", "entity-resolution")}
    assert {r.id: r.tier for r in gates.tiers(df).collect()} == {"a": "public", "b": "restricted", "c": "restricted", "d": "restricted"}


def test_names_packets_findings(spark):
    claims = spark.createDataFrame([("a", "as Jo Blow said", ["Jo Blow"]), ("b", "the blow fell", [])], "id string, text string, named_entities array<string>")
    roster = spark.createDataFrame([("Jo", "Blow"), ("x", "The")], "given string, family string")
    assert [r.id for r in gates.names_in_text(claims, roster).collect()] == ["a"]
    sent = spark.createDataFrame([("z", "Jo Blow")], "id string, person string")
    assert gates.reply_packets(claims, sent).first().claims == ["a"]
    old = spark.createDataFrame([("f", "open", "blocking", [1])], "id string, state string, severity string, rounds array<int>")
    new = spark.createDataFrame([("f", "fixed", "blocking", [2])], old.schema)
    assert gates.merge_findings(old, new).first().rounds == [1, 2]
    assert gates.blocking_open(old).count() == 1
    m = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, sha string")
    assert {r.name for r in gates.drifted(m, m.filter("name = 'a'")).collect()} == {"b"}


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(src).repartition(3).write.parquet(str(tmp_path / "in"))
    q = windows.stream(spark, str(tmp_path / "in"), "closed_windows")
    q.awaitTermination(120)
    got = {(r.window_start, r.event_type): r.n for r in spark.table("closed_windows").collect()}
    want = {(r.window_start, r.event_type): r.n for r in windows.windowed(spark.read.parquet(src)).collect()}
    assert got and all(want[k] == n for k, n in got.items())
