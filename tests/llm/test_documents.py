"""Operators on documents against brute force, and their defined cases."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import langid, lines, mixing, packing, quality, queries, shared, simhash
from tallyloom.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, fp string, size string, shard string"
ROWS = [(1, "The quick brown fox jumps over the lazy dog\nshort one", "en", "a", 0), (2, None, None, None, 0), (3, "", "en", "b", 0), (3, "", "en", "b", 0), (None, "no id at all here", "en", None, 0), (4, "The quick brown fox jumps over the lazy dog\nother words that differ a lot", "en", "a", 0), (5, "x" * 5000 + " " + "word " * 9000, "de", "b", 0)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns named like the operators' own."""
    return spark.createDataFrame([(*r, "p", "f", "s", "h") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# quality


def test_quality_learns(spark):
    good = [f"this is a plain sentence number {i} about council work and roads" for i in range(200)]
    bad = [f"BUY!! NOW!! {i}!! CHEAP!! THINGS!!" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in rows] + [(0, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.quality_predicted for r in quality.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i] == int(i < 200) for i in held)


def test_quality_defined_cases(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(odd, none)
    assert model.score("anything") == 1.0
    out = quality.score(odd, model)
    assert out.columns[: len(odd.columns)] == odd.columns and out.count() == len(ROWS)
    assert quality.score(empty, model).count() == 0
    assert 0 <= quality.QualityModel(np.zeros(quality.DIM, np.float32), 0.1, 1.0, 0.0, 0.0).score(None) <= 1


def test_quality_keeps_clashing_columns(spark, odd):
    docs = odd.withColumn("quality_score", F.lit("own")).withColumn("Quality_Predicted", F.lit("mine"))
    out = quality.score(docs, quality.QualityModel(None, 0.0, 1.0, 0.0, 0.7))
    assert out.columns == [*docs.columns, "quality_score_", "quality_predicted_"] == [*docs.columns, *quality.added(docs)]
    assert {(r.quality_score, r.Quality_Predicted, r.quality_score_, r.quality_predicted_) for r in out.collect()} == {("own", "mine", 0.7, 1)}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.score, label[r.doc_id]) for r in queries.op9_quality_nbsvm(spark, sf).collect() if r.held_out and label.get(r.doc_id) is not None]
    ones, zeros = [s for s, y in got if y == 1], [s for s, y in got if y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert len(got) > 40 and auc >= 0.9


def test_dual_coordinate_descent_separates():
    w = quality.descend(np.array([0, 1, 2]), np.array([0, 1]), np.ones(2), np.arange(2), np.array([1.0, -1.0]), 2, 1.0, 50, 0)
    assert w[0] + w[2] > 0 > w[1] + w[2]


# language


def test_language_defined_cases(odd, empty):
    models = langid.fit(odd)
    got = langid.predict(odd, models).collect()
    assert len(got) == len(ROWS)
    assert all((r.lang_pred == "und") == (r.cross_entropy is None) for r in got)
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


# packing


def test_packing_round_trip(docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: e.ids + [1] for r, e in zip(rows, t.encode_batch([r.text or "" for r in rows], add_special_tokens=False))}
    got = packing.pack(docs, *vocabulary()).collect()
    ids = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        piece = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == len(ids.setdefault(r.doc_id, [])) and r.length == len(piece) and r.doc_tokens == len(want[r.doc_id])
        ids[r.doc_id] += piece
    assert ids == want
    check_sequences(got, 2048)


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_defined_cases(odd, empty):
    got = packing.pack(odd, *vocabulary(), capacity=64, tail=8, keep=3).collect()
    assert sum(r.start == 0 for r in got) == len(ROWS)
    check_sequences(got, 64)
    assert packing.pack(empty, *vocabulary()).count() == 0


def test_tokens_beyond_latin():
    from tokenizers import Tokenizer

    import public_tokenizers as P

    own, theirs = packing.Tokens(*vocabulary()), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in ("", " a  b\t\n c d", "½²ªº × ÷ 日本語 🙂 it's we'll", "ends with spaces   ", "\x1c\x85\n\n x", "a b", "١٢٣ ⅷ"):
        assert own(t).tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_splits_of_settled_code_points():
    from tokenizers import Tokenizer

    import public_tokenizers as P

    path, settled = P.path("byte_bpe_50k.json"), re.compile(f"[{packing.SETTLED}]")
    own, theirs = packing.Tokens(path, P.PATTERN), Tokenizer.from_file(path)
    texts = [f"a{c}1{c}{c} {c}b .{c}" for c in map(chr, range(0x10000)) if settled.match(c)]
    joined = ["".join(texts[low : low + 64]) for low in range(0, len(texts), 64)]
    assert all(own(t).tolist() == e.ids for t, e in zip(joined, theirs.encode_batch(joined, add_special_tokens=False)))


def test_lengths():
    for n in (1, 127, 128, 129, 1365, 2047, 2048, 2049, 100_000):
        cut = packing.lengths_of(n, 2048, 128)
        assert sum(cut) == n and all(x <= 128 or 2048 // (2048 // x) == x for x in cut)


# mixing


def targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in stopped]
        if not open_:
            return stopped
        share = (total - sum(stopped.values())) / sum(w[s] for s in open_)
        over = [s for s in open_ if share * w[s] > most * sizes[s]]
        if not over:
            return stopped | {s: share * w[s] for s in open_}
        stopped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("block", [16, 256])
def test_mix(docs, block):
    placed, mixed = mixing.mix(docs, block_words=block)
    got = mixing.totals(placed, mixed, block_words=block).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    size = {r.doc_id: len(words(r.text)) for r in rows}
    source = {r.doc_id: r.source for r in rows}
    sums = Counter()
    for r in rows:
        sums[r.source] += size[r.doc_id]
    want, taken = targets(sums), Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sums[source[r.doc_id]] and r.taken <= 3 * r.size
        assert r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= block + 1 for s in want)


def test_mix_of_small_sources(spark):
    rows = [(i, "w " * (i % 7), s) for i, s in enumerate(["a"] * 30 + ["b"] * 3 + [None] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.totals(*mixing.mix(docs, block_words=4), block_words=4).collect()
    again = mixing.totals(*mixing.mix(docs, block_words=4), block_words=4).collect()
    assert sorted(got) == sorted(again) and len(got) == len(rows)
    sums = Counter()
    for _, t, s in rows:
        sums[s] += len(words(t))
    want = targets(sums)
    assert {round(r.target, 6) for r in got} == {round(x, 6) for x in want.values()}


def test_draws_beyond_one_count(monkeypatch):
    totals = np.array([123, 0, 4567, 89])
    for most in (mixing.DRAWN, 100, 37):
        monkeypatch.setattr(mixing, "DRAWN", most)
        for shards in (1, 3, 64, 1000):
            at = np.zeros(4, np.int64)
            for k in range(shards):
                first, count = mixing.drawn(totals, shards, k, 11)
                assert (first == at).all() and (count >= 0).all()
                at = first + count
            assert (at == totals).all()
    monkeypatch.undo()
    first, count = mixing.drawn(np.array([6 * 10**11, 3 * 10**9, 5]), 10**8, 12_345_678, 11)
    after, _ = mixing.drawn(np.array([6 * 10**11, 3 * 10**9, 5]), 10**8, 12_345_679, 11)
    assert (first + count == after).all() and abs(count.sum() - 6030) < 5


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        i = np.arange(n)
        assert sorted(mixing.permuted(i, np.full(n, n), np.full(n, 99, np.uint64))) == list(range(n))


def test_shards_share_all_slots():
    total = np.array([10, 0, 33, 7])
    parts = [mixing.drawn(total, 5, k, 1) for k in range(5)]
    assert (sum(c for _, c in parts) == total).all()
    at = np.zeros(4, int)
    for first, count in parts:
        assert (first == at).all()
        at += count


def test_mixed_texts(odd, empty):
    out = mixing.mixed_texts(odd, block_words=8)
    assert out.columns == odd.columns
    assert all(r.text and r.n_chars == len(r.text) for r in out.collect())
    assert mixing.mixed_texts(empty).count() == 0
    assert mixing.cut_pieces("a  b\nc d", [{"turn": 0, "start": 2, "words": 2}, {"turn": 0, "start": 0, "words": 2}, {"turn": 1, "start": 1, "words": 1}]) == ["a  b\nc d", "b"]


# simhash


def brute_fingerprint(t, n=3):
    w = [x for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())]
    s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps, radius):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= radius:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    got = simhash.classes(docs, words=3, radius=2).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps, 2)


def test_simhash_links_over_shards(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 60, dtype=np.int64)
    chain = [int(b) ^ (1 << k) ^ (1 << (k + 1)) for b in base[:20] for k in range(0, 12, 3)]
    points = np.unique(np.array([*map(int, base), *chain], np.int64))
    df = spark.createDataFrame([(int(p),) for p in points], "fp long")
    want = brute_components({int(p): int(p) % (1 << 64) for p in points}, 2)
    got = {r.u: r.v for r in simhash.link(df, radius=2, shard_rows=8, sample_rows=4096).collect()}
    assert {p: got.get(p, p) for p in want} == want


def test_simhash_defined_cases(odd, empty):
    got = simhash.classes(odd).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].fp == 0 and by[2].component_id == by[3].component_id == 2
    assert simhash.classes(empty).count() == 0


# lines


def brute_lines(rows, least=1):
    gone, seen = {}, []
    for doc_id, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for k, line in enumerate(text.split("\n")):
            s = frozenset(words(line))
            if len(s) >= least:
                if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                    gone.setdefault(doc_id, set()).add(k)
                seen.append(s)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) if t is not None else None for i, t in rows}


def test_line_dedup(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_of_near_groups(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for d in range(60):
        w = list(base)
        for k in rng.choice(40, int(rng.integers(0, 6)), replace=False):
            w[k] = f"n{int(rng.integers(0, 30))}"
        wide = [f"v{i}" for i in range(120)]
        for k in rng.choice(120, int(rng.integers(0, 20)), replace=False):
            wide[k] = f"m{int(rng.integers(0, 50))}"
        rows.append((d, " ".join(w) + "\nfree line of words " + str(d) + "\n" + " ".join(wide)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup(df).collect()} == brute_lines(rows)


def test_line_dedup_beyond_broadcasts(spark, docs, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", -1)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: r.text for r in lines.dedup(docs).collect()} == brute_lines(rows)


def test_line_dedup_defined_cases(odd, empty):
    got = lines.dedup(odd)
    assert got.columns == [*odd.columns, "lines_gone"]
    out = {r.doc_id: r for r in got.collect()}
    assert out[4].text == "other words that differ a lot" and out[2].text is None and out[None].lines_gone == 0
    assert got.count() == len(ROWS)
    assert lines.dedup(empty).count() == 0


def test_splits_go_to_the_model_alone():
    """op5: a split that the table lacks costs a look at the merges, not a run of the whole tokenizer; ids stay the tokenizer's."""
    tokens = packing.Tokens(*vocabulary())
    whole, texts = tokens.one, ["Some words, naïve ones\tand  42 \x00 \xad ½ ²\n\n", "中文 and かな, don't", " ", "x\x85y\xa0z"]
    want = [whole(t) for t in texts]
    tokens.one = None
    assert [tokens(t).tolist() for t in texts] == want
    from tokenizers import Tokenizer

    encode = packing.split_encoder(Tokenizer.from_file(vocabulary()[0]))
    assert encode.__closure__ and not any(isinstance(c.cell_contents, Tokenizer) for c in encode.__closure__)
    assert encode(" naïve") == whole(" naïve")
