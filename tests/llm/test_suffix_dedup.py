import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import suffix_dedup as S
from weftline.llm.queries import queries


def brute(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text), from the contract."""
    least, raw = {}, [(d, (t or "").encode()) for d, t in rows]
    for d, x in raw:
        if d is not None:
            for i in range(len(x) - length + 1):
                s = x[i : i + length]
                least[s] = min(d, least.get(s, d))
    out = []
    for d, x in raw:
        gone = np.zeros(len(x) + 2, bool)
        if d is not None:
            for i in range(len(x) - length + 1):
                if least[x[i : i + length]] < d:
                    gone[i + 1 : i + length + 1] = True
        starts = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(x, np.uint8)[~gone[1:-1]])
        out.append((d, len(x), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def stored(spark, rows, path):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, mark string, start int").repartition(3).write.parquet(f"{path}/documents.parquet")


def rows_of(spark, path):
    return sorted((tuple(r) for r in queries()["op12_suffix_dedup"](spark, str(path)).collect()), key=key)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab\0\xff"), max_size=200), st.integers(1, 30))
def test_equal_groups_are_the_repeated_windows(text, length):
    raw = text.encode("latin-1")
    at = np.arange(max(0, len(raw) - length + 1))
    live, group = S.equal_groups(np.frombuffer(raw, np.uint8), at, length)
    found = {}
    for i, g in zip(live.tolist(), group.tolist(), strict=True):
        found.setdefault(g, set()).add(i)
    want = {}
    for i in at.tolist():
        want.setdefault(raw[i : i + length], set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


@pytest.mark.parametrize("size", [50, 51, 84, 85, 400])
def test_each_window_has_one_anchor(size):
    data = np.frombuffer(np.random.default_rng(size).integers(97, 100, size + 100, np.uint8).tobytes(), np.uint8)
    owner, start, windows, gram = S._anchors(data, np.array([0, size]), np.array([size - 49, 51]), 50)
    assert np.concatenate([np.arange(s, s + n) for s, n in zip(start, windows, strict=True)]).tolist() == [*range(size - 49), *range(size, size + 51)]
    assert owner.tolist() == sorted(owner.tolist())
    # equal windows elsewhere have equal grams
    of = dict(zip(np.repeat(start, windows) + 0, np.repeat(gram, windows), strict=False))
    again = S._anchors(data[7:], np.array([0]), np.array([size - 56]), 50) if size > 56 else None
    if again:
        grams = {int(s) + 7 + j: g for s, n, g in zip(again[1], again[2], again[3], strict=True) for j in range(n)}
        first = {int(s) + j: g for s, n, g in zip(start, windows, gram, strict=True) for j in range(n)}
        assert all(grams[p] == first[p] for p in grams) and of


@pytest.fixture(scope="module")
def awkward():
    rng = np.random.default_rng(4)
    words = ["the", "river", "runs", "é", "slow\n", "\U0001f600", "stone"]
    text = lambda n: " ".join(rng.choice(words, n))
    shared = [text(30), text(9), "x" * 300, "Copyright line that every page has got, more than fifty bytes long.\n"]
    rows = [(None, shared[0]), (None, None), (1, None), (2, ""), (3, "short"), (4, shared[2]), (5, shared[2] + "y"), (6, shared[0]), (6, shared[0]), (6, "other " + shared[0]), (-5, text(60)), (7, "y" * 49), (8, "y" * 49), (9, "y" * 50), (10, "z" + "y" * 50)]
    for i in range(20, 160):
        parts = [text(rng.integers(0, 40)), shared[rng.integers(len(shared))][rng.integers(0, 12) :], text(rng.integers(0, 40))]
        rows.append((i, "".join(parts) if i % 3 else parts[0]))
    return rows + [(200 + i, r[1]) for i, r in enumerate(rows[20:60])]


@pytest.mark.parametrize(("together", "bits"), [(S.TOGETHER, S.FILTER_BITS), (2, S.FILTER_BITS), (S.TOGETHER, 1 << 15), (2, 1 << 15)])
def test_awkward_rows_by_brute_force_and_sql(spark, tmp_path, monkeypatch, awkward, together, bits):
    """With two contexts at most sorted together, most grams' windows are dealt out by their content instead; a filter
    of 4 KB lets much through in vain."""
    monkeypatch.setattr(S, "TOGETHER", together)
    monkeypatch.setattr(S, "FILTER_BITS", bits)
    stored(spark, awkward, tmp_path)
    found = rows_of(spark, tmp_path)
    assert found == sorted(brute(awkward), key=key)
    assert sum(r[2] > 0 for r in found) > 60
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(db.sql(S.SQL).fetchall(), key=key) == found


def test_a_text_of_several_blocks(spark, tmp_path):
    long = bytes(np.random.default_rng(5).integers(97, 123, S.SLICE_BYTES * 2 + 777, np.uint8)).decode()
    cuts = [S.SLICE_BYTES - 30, S.SLICE_BYTES, 2 * S.SLICE_BYTES - 49]
    rows = [(i, long[c : c + 120]) for i, c in enumerate(cuts)] + [(10, long), (11, "a" + long[5:])]
    stored(spark, rows, tmp_path)
    assert rows_of(spark, tmp_path) == sorted(brute(rows), key=key)


def test_spans_and_what_is_kept(spark):
    common = "passage that two documents have in common, and it is long enough to go"
    docs = spark.createDataFrame([(1, f"a {common} b"), (2, f"é{common}ü"), (3, "none")], "id long, text string")
    out = {r.id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept).decode()) for r in S.remove_repeats(docs, "id", "text").collect()}
    n = len(common)
    assert out == {1: (n + 4, [], f"a {common} b"), 2: (n + 4, [(2, n + 2)], "éü"), 3: (4, [], "none")}
    with pytest.raises(ValueError):
        S.remove_repeats(docs, "id", "text", 20)


def test_no_rows(spark, tmp_path):
    stored(spark, [], tmp_path)
    assert rows_of(spark, tmp_path) == []
