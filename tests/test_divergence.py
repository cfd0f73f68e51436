"""The fuzzy pass over all motions, against a plain loop."""

from __future__ import annotations

from collections import defaultdict
from difflib import SequenceMatcher
from types import SimpleNamespace

import tallyloom.registry  # noqa: F401  (loads the operators in their order)
from tallyloom.operators.conflicts import officer_divergence_fuzzy
from tallyloom.sources.civic import civic

COLUMNS = ["meeting_id", "id", "side", "item_number", "title", "tags"]


def loop(rows):
    dates, out = defaultdict(lambda: ([], [])), set()
    for m, i, side, number, title, tags in rows:
        dates[m][side == "minutes"].append((i, (number or "").strip(), f"{title} {tags}".lower()))
    for m, (agenda, minutes) in dates.items():
        numbers = {n for _, n, _ in minutes if n}
        for i, n, text in agenda:
            if n not in numbers:
                found = max(((SequenceMatcher(None, text, o).ratio(), -j) for j, _, o in minutes), default=(0, 0))
                if found[0] >= 0.5:
                    out.add((m, i, -found[1], round(found[0], 9)))
    return out


def got(t):
    rows = [tuple(r) for r in officer_divergence_fuzzy(t).select("meeting_id", "agenda_id", "minutes_id", "confidence").collect()]
    assert len(rows) == len(set(rows))
    return {(m, a, b, round(c, 9)) for m, a, b, c in rows}


def test_only_items_without_a_number_match(spark):
    rows = [
        (1, 3, "agenda", "7", "Road works", "a"),
        (1, 5, "agenda", " 8 ", "Road works", "a"),
        (1, 9, "agenda", None, "Library hours", "b"),
        (1, 11, "agenda", "9", "zzzz", "q"),
        (1, 21, "minutes", "8", "Road work", "a"),
        (1, 13, "minutes", "30", "Road work", "a"),
        (1, 15, "minutes", None, "Library hour", "b"),
        (2, 17, "agenda", "7", "Road works", "a"),
    ]
    found = got(SimpleNamespace(items=spark.createDataFrame(rows, COLUMNS)))
    assert found == loop(rows) and {(m, a, b) for m, a, b, _ in found} == {(1, 3, 13), (1, 9, 15)}


def test_all_motions_have_a_side(spark):
    t = civic(spark, "/root/testdata/sf0.01")
    rows = [tuple(r) for r in t.items.select(*COLUMNS).collect()]
    assert len(rows) == t.motions.count() and {r[2] for r in rows} == {"agenda", "minutes"}
    assert got(t) == loop(rows)
