import hashlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import winnowing as w


def brute(text, k, window):
    points = np.array([ord(c) for c in text], np.uint32)
    grams = [int(w._gram_hashes(points[i : i + k], k)[0] >> np.uint64(32)) for i in range(len(points) - k + 1)]
    span, out = min(window, len(grams)), []
    for i in range(len(grams) - span + 1):
        part = grams[i : i + span]
        j = i + max(x for x in range(span) if part[x] == min(part))
        if not out or out[-1] != j:
            out.append(j)
    return out, [grams[j] for j in out]


def test_winnow_is_the_windowed_minimum_with_rightmost_ties(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(w, "BLOCK", 150)
    for n in (16, 17, 40, 79, 80, 300, 1000):
        for alphabet in ("ab", "aé\U0001f600z", "a"):
            text = "".join(rng.choice(list(alphabet), n))
            at, values = w.winnow(text)
            want = brute(text, w.K, w.WINDOW)
            assert at.tolist() == want[0] and values.tolist() == want[1]
    assert w.winnow("")[0].size == 0 and w.winnow("abc")[0].tolist() == [0]
    assert w.winnow("abc")[1].tolist() != w.winnow("abd")[1].tolist()


def test_match_guarantee():
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    for _ in range(30):
        common = word(w.K + w.WINDOW - 1)
        a, b = word(400) + common + word(333), word(77) + common + word(500)
        assert set(w.winnow(a)[1].tolist()) & set(w.winnow(b)[1].tolist())


def expected(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        other = t[: len(t) - half] + following[:half]
        a, b, c = (w.winnow(x) for x in (t, other, following))
        out.append((d, len(t), hashlib.sha256(other.encode()).hexdigest(), w.fingerprint(*a), w.fingerprint(*b), w.likeness(a[1], b[1]), w.likeness(a[1], c[1])))
    return sorted(out, key=str)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("range", T.StringType()), T.StructField("guest", T.StringType())])


def test_edited_texts_and_order_against_a_single_list(spark):
    rng = np.random.default_rng(3)
    texts = ["", None, "x", "läng" * 3000] + [" ".join(rng.choice(["uno", "dós", "tres", "\U0001f600"], rng.integers(1, 200))) for _ in range(60)]
    rows = [(int(i) * 7 - 50, t) for i, t in enumerate(texts)] + [(6, "twice"), (6, "twice"), (6, "again"), (None, "no id"), (None, None)]
    for part in (rows, rows[:1], rows[:2], []):
        df = spark.createDataFrame([(*r, "a", "b") for r in part], SCHEMA)
        for n in (1, 5, 9):
            got = sorted((tuple(r) for r in w.fingerprints(df, n).collect()), key=str)
            assert got == expected(part)


def test_equal_texts_have_equal_fingerprints_and_edits_are_nearer_than_neighbours():
    a, b = "the quick brown fox jumps " * 40 + "one", "lorem ipsum dolor sit amet " * 50
    assert w.fingerprint(*w.winnow(a)) == w.fingerprint(*w.winnow(str(a)))
    rng = np.random.default_rng(5)
    a, b = ("".join(rng.choice(list("abcdefghij "), 4000)) for _ in range(2))
    assert w.likeness(w.winnow(a)[1], w.winnow(w.edited(a, b))[1]) > 0.25 > w.likeness(w.winnow(a)[1], w.winnow(b)[1])


def test_ids_that_many_rows_share_are_spread_over_ranges(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["uno", "dos", "tres"], 12)) + str(i) for i in range(120)]
    rows = [([None, 7, i][i % 3], t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    hashes = {(r.doc_id, r.text): r.h for r in frame.withColumn("h", F.xxhash64("text")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r]))
    want = []
    for i, (d, t) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        want.append((d, hashlib.sha256(w.edited(t, following).encode()).hexdigest()))
    out = w.fingerprints(frame, 12)
    got = [(r.doc_id, r.edited_sha256) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 40


def test_query_has_the_contract_s_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a text of some words", "x", "y"), (2, None, "x", "y")], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in w.op2_fingerprints(spark, str(tmp_path)).collect()}
    assert out[1].n_chars == 20 and out[2].n_chars == 0 and out[2].fingerprint == "" and 0 <= out[1].near_edited <= 1
    assert out[1].edited_sha256 == hashlib.sha256(b"a text of ").hexdigest()
