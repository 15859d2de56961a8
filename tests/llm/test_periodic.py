import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import periodic


def runs(words):
    """Every maximal repetition, from the definition: all lags, all stretches, least periods only."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute(doc_id, text):
    """A row of op11 from its contract."""
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(listed), digest(kept))


def found_in(texts):
    codes = [np.array([zlib.crc32(w.encode()) * 0x9E3779B1 + 1 for w in t], np.uint64) for t in texts]
    bounds = np.cumsum([0] + [len(t) for t in texts])
    return periodic.find_runs(np.concatenate([*codes, np.zeros(0, np.uint64)]), bounds).tolist(), bounds


PERIODIC = st.builds(lambda head, unit, n, tail: head + (unit * (n // len(unit) + 1))[:n] + tail, st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abcd"), min_size=1, max_size=70), st.integers(0, 400), st.lists(st.sampled_from("abc"), max_size=9))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(PERIODIC, st.lists(st.sampled_from("ab"), max_size=60)), max_size=4))
def test_runs_equal_the_definition_s(texts):
    found, bounds = found_in(texts)
    want = [[int(bounds[i]) + s, n, q] for i, t in enumerate(texts) for s, n, q in runs(t)]
    assert found == sorted(want, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("q", [9, 15, 16, 17, 31, 32, 33, 64, 65, 100, 257])
def test_each_period_at_its_least_length(q):
    rng = np.random.default_rng(q)
    unit = [f"w{i}" for i in rng.integers(0, 5, q)]
    unit[-1] = "end"  # primitive
    for extra, many in ((0, 1), (-1, 0), (1, 1)):
        words = ["x"] + (unit * 5)[: 4 * q + extra] + ["y"]
        found, _ = found_in([words, words])
        assert sum(r[2] == q for r in found) == 2 * many


def test_runs_of_runs_and_neighbours_in_other_texts():
    inner = (list("ab") * 4 + ["c"]) * 5
    found, _ = found_in([inner])
    assert [r for r in found if r[2] == 9] == [[0, 45, 9]] and len([r for r in found if r[2] == 2]) == 5
    found, _ = found_in([list("ab") * 2, list("ab") * 2])
    assert found == []


def rows_of(spark, folder):
    from weftline.llm.queries import queries

    return sorted((tuple(r) for r in queries()["op11_periodic_runs"](spark, str(folder)).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[-1]))


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(None, "a " * 9), (None, None), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b " * 40), (5, "a b " * 40), (7, "x " * 30_000), (8, "é  ü " * 12 + "\u0085 q")]
    for i in range(10, 150):
        rows.append((i, " ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(1, 300)))))
    spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, id string, runs string, start int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = [brute(*r) for r in rows]
    assert rows_of(spark, tmp_path) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[-1]))
    assert sum(r[1] > 0 for r in want) > 10


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "go  stop stop\nstop stop stop stop on"), (2, "p " + "q r s " * 4 + "t"), (3, None)], "id long, text string")
    out = {r.id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.collapse_runs(docs, "id", "text").collect()}
    assert out == {1: (8, [(1, 6, 1)], "go stop on"), 2: (14, [(1, 12, 3)], "p q r s t"), 3: (0, [], "")}


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows_of(spark, tmp_path) == []
