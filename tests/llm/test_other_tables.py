"""Searches, pages and conversations."""

from __future__ import annotations

import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import chat, grid, nearest, rendering
from tallyloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in x[i]], "a", "b", "c") for i in range(300)]
    odd = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] + [1.0] * 7), (905, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (7, [float(v) for v in x[7]])]
    return x, spark.createDataFrame(rows + [(*r, "a", "b", "c") for r in odd], "vec_id long, embedding array<float>, id string, kind string, body string")


def test_nearest(spark):
    x, df = vectors(spark)
    got = {}
    for r in nearest.nearest(df, every=50, k=10, block_rows=32).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 300, 50):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(300), d)) if i != q][:10]
        rows = sorted(got[q])
        assert [v for _, v, _ in rows] == want and [s for *_, s in rows] == pytest.approx(d[want], rel=1e-14)
    assert set(got) == set(range(0, 300, 50))


def test_nearest_few_and_none(spark):
    _, df = vectors(spark)
    few = df.filter("vec_id < 4")
    assert nearest.nearest(few, every=100, k=10).count() == 3
    assert nearest.nearest(df.limit(0)).count() == 0


def ranks(rows):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def brute(points, queries, distance, k=10):
    """points: (id, value); an id counts by its nearest value."""
    out = {}
    for q, v in queries.items():
        near = {}
        for i, x in points:
            if i != q:
                near[i] = min(near.get(i, math.inf), distance(v, x))
        out[q] = [(n + 1, i, pytest.approx(d, rel=1e-14)) for n, (i, d) in enumerate(sorted(near.items(), key=lambda e: (e[1], e[0]))[:k])]
    return out


@pytest.mark.parametrize("blocks", [1, 16])
def test_nearest_of_repeated_ids_and_dimensions(spark, monkeypatch, blocks):
    monkeypatch.setattr(grid, "GROUP_BLOCKS", blocks)
    rng = np.random.default_rng(6)
    points = [(int(rng.integers(0, 120)), [float(np.float32(v)) for v in rng.normal(size=d)]) for d in (3, 70) for _ in range(150)]
    points += [(200 + i, [float(np.float32(1e30)), float(i), 0.0]) for i in range(4)]
    points += [(300, points[5][1])] * 40
    df = spark.createDataFrame(points, "vec_id long, embedding array<float>")
    got = ranks(nearest.nearest(df, every=10, k=10, block_rows=16).collect())
    queries = {i: min(v for j, v in points if j == i) for i in {j for j, _ in points} if i % 10 == 0}
    want = brute(points, queries, lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))) if len(a) == len(b) else math.inf, k=400)
    assert got == {q: [e for e in x if e[2] != math.inf][:10] for q, x in want.items()}


def codes_frame(spark, rows, bits):
    return spark.createDataFrame([(i, None if v is None else bytearray(int(v).to_bytes(-(-bits // 8), "little")), bits) for i, v in rows], "id long, code binary, kind int")


@pytest.mark.parametrize("bits", [5, 64, 100])
def test_codes(spark, monkeypatch, bits):
    monkeypatch.setattr(grid, "GROUP_BLOCKS", 1)
    rng = np.random.default_rng(3)
    c = [int(rng.integers(0, 1 << 62)) * (1 << 40) + int(rng.integers(0, 1 << 40)) & (1 << bits) - 1 for _ in range(400)]
    c[100:160] = [c[100]] * 60
    c[200:220] = [c[100] ^ 5] * 20
    points = list(enumerate(c)) + [(3, c[100]), (3, c[7]), (150, c[9])]
    df = codes_frame(spark, points + [(None, 1), (999, None), (3, c[3])], bits)
    got = ranks(nearest.nearest_codes(df, every=50, k=10, block_rows=64).collect())
    asked = {i: min((v for j, v in points if j == i), key=lambda v: v.to_bytes(-(-bits // 8), "little")) for i in range(0, 400, 50)}
    assert got == brute(points, asked, lambda a, b: (a ^ b).bit_count())
    assert nearest.nearest_codes(df.limit(0)).count() == 0


def test_sign_codes(spark):
    wide = [-1.0] * 70 + [2.0]
    df = spark.createDataFrame([(1, [1.0, -1.0, 2.0]), (2, wide)], "id long, v array<float>")
    got = {r.id: (int.from_bytes(r.code, "little"), r.kind) for r in nearest.sign_codes(df).collect()}
    assert got == {1: (5, 3), 2: (1 << 70, 71)}


def test_vectors_that_differ_beyond_the_first_word(spark, tmp_path):
    rows = [(i, [1.0] * 64 + [1.0 if i == 50 else -1.0]) for i in range(0, 60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = ranks(r for r in QUERIES["op6_multi_index_topk"](spark, str(tmp_path)).withColumnRenamed("distance", "score").collect())
    assert {e[2] for e in got[50]} == {1} and {e[2] for e in got[0]} == {0}


PAGE = """<!doctype html><title>T</title><style>.x, #y{display:none}</style><body><h1>Head &amp; x</h1><p>one <b>two<br>three<p>four</b> five<div class=x>no</div><div hidden>no</div>
<ul><li>a<li>b<ol start=3><li>n<li>m</ol><li>c</ul><table><tr><th>Name<th>Value<tr><td>alpha<td>1<tr><td>be<td>22 <p>x</table><pre> a
  b</pre><details><summary>S</summary>no</details><p style="display: none">no<p>after<script>var a="</p>"</script> <!-- c -->end"""


def test_rendering():
    out = rendering.visible_text(PAGE)
    assert "no" not in out.split() and "alpha  1" in out and "- a\n- b\n  3. n\n  4. m\n- c" in out and "\n a\n  b\n" in out


@pytest.mark.parametrize("page, want", [(None, None), ("", ""), ("a < b & c", "a < b & c"), ("<p>un<p>closed <i", "un\n\nclosed"), ("</p></div>x", "x"), ("<div>" * 50_000 + "deep", "deep"), ("<td>cell", "cell"), ("<script>x", ""), ("<!-- open", "")])
def test_rendering_defined_cases(page, want):
    assert rendering.visible_text(page) == want


def test_extract(spark):
    df = spark.createDataFrame([(1, "<p>a", "z"), (1, "<p>a", "z"), (None, None, "z")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text or "") for r in rendering.extract(df).collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert rendering.extract(df.limit(0)).count() == 0


def test_chat_links(spark):
    calls = json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": {"z": 1, "a": "x"}}, {"id": "b", "name": "f", "arguments": {"a": "y", "z": {"$ref": "a"}}}, {"id": "c", "name": "g", "arguments": {}}, {"id": "d", "name": "f", "arguments": {"a": {"$ref": "e"}}}, {"id": "e", "name": "f", "arguments": {"a": {"$ref": "d"}}}, {"id": "h", "name": "f", "arguments": {"a": {"$ref": "nowhere"}}}]})
    rows = [(1, 0, "user", "hi", "q"), (1, 1, "assistant", calls, "q"), (1, 2, "tool", '{"tool_call_id":"a","content":"42"}', "q"), (1, 3, None, None, "q"), (2, 0, "assistant", "x", "q"), (None, None, "user", None, "q"), (1, 4, "tool", '{"tool_call_id":"a","content":"43"}', "q")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level string")
    out = {(r.conv_id, r.turn, r.call_id): r for r in chat.linked(chat.events(m), {"f": {"required": ["a"], "types": {"z": "integer"}}, **chat.REPLY}).collect()}
    a, b, c, d, h = (out[1, 1, k] for k in "abcdh")
    assert a.valid and a.linked_turn == 2 and json.loads(a.json)["arguments"] == {"a": "x", "z": 1}
    assert a.json.index('"a"') < a.json.index('"z"')
    assert b.level == 1 and "z is no integer" in b.errors and "no result" in b.errors
    assert "unknown tool" in c.errors and d.level is None and "cyclic reference" in d.errors and "unknown reference" in h.errors
    assert out[2, 0, "2:-1"].errors == ["no call"] and out[1, 2, "a"].linked_turn == 1
    assert chat.linked(chat.events(m.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = c.execute(ORACLE_SQL[name])
    by = [[d[0] for d in got.description].index(x) for x in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in by)) for r in got.fetchall())
