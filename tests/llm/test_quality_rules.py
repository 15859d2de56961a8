import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from weftline.llm import ngrams, quality_rules as q
from weftline.llm.shared import Texts


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, cover = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


TEXT = st.one_of(st.none(), st.text(st.sampled_from("ab é\n\t\x0b#|\U0001f600\x85\xa0"), max_size=60), st.lists(st.sampled_from(["x", "yy", "\n", "z#"]), max_size=60).map(" ".join))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_base_counts(texts):
    found = q.base_counts(Texts(pa.array(texts, pa.string())))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(int(found[n][i]) for n in names) for i in range(len(texts))] == [brute(t) for t in texts]


def test_lines_with_one_hash_are_told_apart(monkeypatch):
    texts = ["one line\nother line\none line\n\nonE line", "x\nx", "same\nlong line of words here\nlong line of wordz here"]
    monkeypatch.setattr(Texts, "hashes", lambda self, starts, ends, **_: np.arange(len(starts), dtype=np.uint64) * np.uint64(0))
    assert q.base_counts(Texts(pa.array(texts)))["n_dup_lines"].tolist() == [1, 1, 0]


def spelled(text, chars, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [[text[i : i + n] for i in range(len(text) - n + 1)] for n in chars] + [[tuple(w[i : i + n]) for i in range(len(w) - n + 1)] for n in words]


def test_ngrams_are_of_code_points_and_words():
    texts = ["one two", "", "é", "Straße\U0001f600é 三 x", "a", "one two three " * 50, "ab"]
    found = ngrams.buckets(Texts(pa.array(texts)), 18, (1, 2, 3), (1, 2))
    number = {}
    for order, (bucket, bounds) in enumerate(found):
        assert bounds.tolist() == np.cumsum([0] + [len(spelled(t, (1, 2, 3), (1, 2))[order]) for t in texts]).tolist()
        for i, t in enumerate(texts):
            for gram, b in zip(spelled(t, (1, 2, 3), (1, 2))[order], bucket[bounds[i] : bounds[i + 1]].tolist(), strict=True):
                assert number.setdefault((order, gram), b) == b and b >> 18 == order
    assert len(set(number.values())) == len(number)


def test_margins_against_a_plain_sum_and_apart_from_neighbours():
    texts = ["one two", "", "xé", "one two three " * 50]
    w = np.random.default_rng(2).normal(size=5 << 18).astype(np.float32)
    got = ngrams.margins(Texts(pa.array(texts)), w, 18, (1, 2, 3), (1, 2))
    for i, t in enumerate(texts):
        (at, x), = ngrams.shares(Texts(pa.array([t])), 18, (1, 2, 3), (1, 2))
        assert abs(got[i] - float(w[at].astype(np.float64) @ x)) < 1e-4
        assert got[i] == ngrams.margins(Texts(pa.array([t])), w, 18, (1, 2, 3), (1, 2))[0]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType())])


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(400):
        words = rng.choice(["river", "stone", "walks", "gently", "over", "the", "hill", "morning", "light"], 60)
        good = i % 3 > 0
        rows.append((i, " ".join(words if good else [w + "%%%" for w in words]), "x"))
        labels.append((i, int(good)))
    return rows, labels


def test_learns_and_keeps_clean_texts(spark, made):
    rows, labels = made
    extra = [(None, "no id " * 3, "x"), (900, None, "x"), (901, "", "x"), (902, "word " * 50_000, "x"), (3, rows[3][1], "x")]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    known = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, label int").union(spark.createDataFrame([(None, 1), (5, None), (7, 9)], "doc_id long, label int"))
    out = q.score(df, q.fit(df, known)).collect()
    assert len(out) == len(rows) + len(extra)
    by = {r.doc_id: r for r in out}
    assert all(by[i].kept == bool(y) for i, y in labels)
    assert all(by[i].base_failed and not by[i].kept for i in (None, 900, 901, 902))


def test_rare_rejects_are_sampled_by_label(spark):
    rng = np.random.default_rng(12)
    vocabulary = ["river", "stone", "walks", "gently", "over", "the", "hill", "morning", "light"]
    rows, labels = [], []
    for i in range(3000):
        bad = i % 50 == 0
        text = [w + "%%%" if bad else w for w in rng.choice(vocabulary, 40)]
        # most rejects fail the base rules, and those say nothing about the others
        rows.append((i, " ".join(text[:5] if bad and i % 100 else text), "x"))
        labels.append((i, int(not bad)))
    model = q.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, label int"), sample=120)
    assert model["slope"] != 0.0
    out = {r.doc_id: r for r in q.score(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert not any(out[i].kept for i in range(0, 3000, 50)) and sum(r.kept for r in out.values()) > 2900


def test_empty_tables_and_missing_labels(spark, made):
    none = spark.createDataFrame([], "doc_id long, label int")
    df = spark.createDataFrame(made[0][:5], SCHEMA)
    assert all(r.kept for r in q.score(df, q.fit(df, none)).collect())
    assert q.score(df.limit(0), q.fit(df.limit(0), none)).count() == 0


def test_platt_scaling_is_calibrated():
    rng = np.random.default_rng(6)
    z = rng.normal(size=20000)
    y = (rng.random(20000) < 1 / (1 + np.exp(-(2.5 * z - 1)))).astype(float)
    a, b = ngrams.fit_platt(z, y)
    assert abs(a - 2.5) < 0.15 and abs(b + 1) < 0.1
