"""Line dedup as the query and the stage run it: no line with a token is left out."""

from __future__ import annotations

import re

import corpus_pipeline
from tallyloom.llm import queries
from tallyloom.llm.shared import stored

TEXTS = [
    "All rights reserved.\none two three four\nan own line of document nought that stays",
    "All rights reserved.\nalpha beta gamma\nanother line that only document one has got here",
    "one two three four five\nalpha beta delta\nthe third text says yet another thing at length",
    "three two one three\nrights All reserved.\nx\nx\n\n \nsomething else entirely in document number three",
    "one two three four\nfour one two three five six\ny",
    "All rights reserved.\nx",
]


def brute(rows):
    """Every non-empty token set against all earlier ones at Jaccard 0.8."""
    seen, out = [], {}
    for i, t in rows:
        kept, gone = [], 0
        for line in t.split("\n"):
            s = set(re.findall(r"[^\x20\x09-\x0D]+", line))
            goes = bool(s) and any(5 * len(s & o) >= 4 * len(s | o) for o in seen)
            seen += [s] if s else []
            gone += goes
            kept += [] if goes else [line]
        out[i] = ("\n".join(kept), gone)
    return out


def test_short_lines_take_part(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    want = brute(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.lines_gone) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == want and want[5] == ("", 2) and want[2][1] == 1
    left = stored(corpus_pipeline.line_dedup(spark, docs, str(tmp_path)), "left").collect()
    assert {r.doc_id: r.text for r in left} == {i: t for i, (t, _) in want.items() if t.strip()}
    assert all(r.n_chars == len(r.text) for r in left)


def test_short_lines_of_the_sample(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: (r.text or "", r.lines_gone) for r in queries.op3_line_dedup(spark, sf).collect()}
    assert got == brute(rows)
