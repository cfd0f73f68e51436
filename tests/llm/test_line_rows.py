"""Line dedup of rows that share an id, repeat, or bring clashing column names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.llm import lines

LINE = "a b c d e f"


def test_texts_under_one_id_are_documents_of_their_own(spark):
    other = "wholly other unique words stand here"
    docs = spark.createDataFrame([(1, LINE), (2, LINE), (2, other), (2, other), (3, f"{other}\nits own words only in here")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.lines_gone) for r in lines.dedup(docs).collect())
    assert got == [(1, LINE, 0), (2, "", 1), (2, other, 0), (2, other, 0), (3, "its own words only in here", 1)]


def test_clashing_names_stay(spark):
    names = ["_gone", "_id", "_hash", "lines_gone", "line", "line_no", "set_id", "k", "s", "text_hash", "first"]
    docs = spark.createDataFrame([(1, LINE, *names), (2, f"{LINE}\nx", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = lines.dedup(docs)
    assert got.columns == [*docs.columns, "lines_gone_"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[2].text == "x" and by[2]["lines_gone_"] == 1 and by[1].text == LINE
    assert all(by[i][n] == n for i in by for n in names)


def test_odd_white_space_and_long_lines(spark):
    rows = [(1, " lead and  double\ttab\x0bin here "), (2, "here in tab double and lead"), (3, "\r\n\x0c\n \n"), (4, " ".join(f"t{i}" for i in range(5000))), (5, " ".join(f"t{i}" for i in range(4100)))]
    got = {r.doc_id: (r.text, r.lines_gone) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("", 1) and got[3] == (rows[2][1], 0) and got[4][1] == 0 and got[5] == ("", 1)


def test_one_long_document_of_repeats(spark):
    text = "\n".join(["same line of words"] * 20_000 + [f"line {i}" for i in range(2000)])
    got = lines.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert got.lines_gone == 19_999 and got.text == "\n".join(["same line of words"] + [f"line {i}" for i in range(2000)])


def test_tokens_and_their_keys(spark):
    """op3: cutting lines takes no regular expression unless white space asks for it, and a token is hashed once."""
    import re

    texts = ["", " ", "a", " a", "a ", "a  b", "a b a", "a\tb", "a\x0bb", "a\x0cb", "a\rb", "a b\r", "\t", "\xa0 a\x85b", "é ü é"]
    places = F.array_repeat(F.lit(7), lines.CLASSES)
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    found = df.select("line", lines.tokens(F.col("line")).alias("t"), lines.token_set(F.col("line"), places).alias("k")).collect()
    want = {t: [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x] for t in texts}
    assert {r.line: r.t for r in found} == want
    assert all(len(r.k) == len(set(want[r.line])) and list(r.k) == sorted(r.k) and all(k >> lines.REST == 7 for k in r.k) for r in found)
    plan = df.select(lines.tokens(F.col("line")), lines.token_set(F.col("line"), places))._jdf.queryExecution().analyzed().toString()
    assert "RLIKE" not in plan and not re.search(r"\bhash\(", plan)
