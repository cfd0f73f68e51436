"""Language models against a plain Kneser-Ney, held-out accuracy, letters of all planes."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyloom.llm import langid, queries

TEXTS = {"x": ["Abra cadabra, banana!", "cab \U00010428\U00010429 bad"], "y": ["dada caba baba", "xyz abba", "a"]}


def cleaned(text):
    out = " "
    for c in text.lower() + " ":
        c = c if c.isalpha() else " "
        out += "" if c == out[-1] == " " else c
    return out


def plain_models(texts, order):
    """p(language, history, symbol) by dictionaries of strings."""
    grams = {x: [Counter() for _ in range(order + 1)] for x in texts}
    for x, ts in texts.items():
        for t in map(cleaned, ts):
            for n in range(1, order + 1):
                for k in range(len(t) - n + 1):
                    if n > 1 or k:  # the opening space is a context only
                        grams[x][n][t[k : k + n]] += 1
    alphabet = {g for x in texts for g in grams[x][1]}
    weight = {}
    for x in texts:
        for n in range(1, order + 1):
            before = defaultdict(set)
            if n < order:
                for g in grams[x][n + 1]:
                    before[g[1:]].add(g[0])
            weight[x, n] = {g: (c if n == order else len(before[g]) or 1) for g, c in grams[x][n].items()}

    def p(x, history, symbol):
        n = len(history) + 1
        w = weight[x, n]
        ones, twos = (sum(c == k for c in w.values()) for k in (1, 2))
        off = ones / (ones + 2 * twos) if ones and twos else 0.5
        lower = 1 / (len(alphabet) + 1) if n == 1 else p(x, history[1:], symbol)
        own = {g: c for g, c in w.items() if g[:-1] == history}
        if not own:
            return lower
        total = sum(own.values())
        return max(own.get(history + symbol, 0) - off, 0) / total + off * len(own) / total * lower

    return p, alphabet


def models_of(texts, order):
    letters = langid._letters()
    return langid.kneser_ney({x: langid.count_grams(t, order, letters) for x, t in texts.items()}, order)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_probabilities(order):
    m, (p, alphabet) = models_of(TEXTS, order), plain_models(TEXTS, order)
    scorer = langid.Scorer(m)
    for history in ("abr", " ab", "ana", "zzz", "dab", " \U00010428\U00010429"):
        history = history[len(history) - order + 1 :] if order > 1 else ""
        total = {x: p(x, history, "?") for x in TEXTS}
        for c in sorted(alphabet) + ["?"]:
            cp = np.array([ord(k) for k in history + c], np.uint64)
            got = scorer._logs(langid.gram_hashes(cp, order), order, np.array([order - 1]))[0]
            for j, x in enumerate(m.langs):
                assert math.exp(float(got[j])) == pytest.approx(p(x, history, c), rel=1e-4)
                total[x] += p(x, history, c) if c != "?" else 0
        assert all(v == pytest.approx(1) for v in total.values())


def test_cross_entropy_of_whole_texts():
    m, (p, _) = models_of(TEXTS, 3), plain_models(TEXTS, 3)
    text = "Bad cab: xyz 12 dada"
    t = cleaned(text)
    got, n = langid.Scorer(m).entropy(text)
    assert n == len(t) - 1
    for j, x in enumerate(m.langs):
        assert got[j] == pytest.approx(-sum(math.log(p(x, t[max(0, k - 2) : k], t[k])) for k in range(1, len(t))) / n, rel=1e-4)


def test_texts_without_a_letter_are_unknown(spark):
    rows = [(1, "der hund und die katze " * 5, "de"), (2, "the dog and the cat " * 5, "en"), (3, "\U0001F600 \U0001F4A9 12 \u2460", None), (4, "\U0001D7D8\U0001F000", None), (5, "\U00010428\U00020000", None), (None, "the cat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs, parts=1, held=1)).collect()}
    assert got[3].lang_pred == got[4].lang_pred == "und" and got[3].score == got[4].score == 0
    assert got[5].lang_pred in ("de", "en") and got[1].lang_pred == "de" and got[2].lang_pred == got[None].lang_pred == "en"


def test_rare_language_is_kept_beside_a_large_one(spark):
    rows = [(i, f"the dog and the cat number{i} " * 3, "en") for i in range(300)] + [(1000, "der hund und die katze", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.fit(docs, parts=1, held=1)
    assert models.langs == ["de", "en"] and np.isinf(models.limits[0])
    assert {r.lang_pred for r in langid.predict(docs.filter("doc_id = 1000"), models).collect()} == {"de"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()}
    got = queries.op7_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id][0] and r.lang_pred != "und"]
    assert len(held) > 200 and np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) >= 0.98
