import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from weftline.llm import merkle
from weftline.llm.queries import queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        run = i // 16 * 16
        yield level[run:i], level[i + 1 : run + 16]
        i //= 16


def brute(rows):
    """All rows of the manifest, from the contract. rows: (doc_id, source, lang, n_chars, text)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by_source = {}
    for r in rows:
        lowered = r[4]
        if r[0] is not None and lowered is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
            lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in lowered)
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, sha("".join(map(part, r))), sha("".join(map(part, (*r[:4], lowered))))))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (known, doc_id, leaf, other) in enumerate(sorted(by_source[s])):
            path = [*siblings(trees[s], i), *siblings(top, at)]
            folded = other
            for before, after in path:
                folded = sha("".join([*before, folded, *after]))
            out.append((doc_id if known else None, leaf, trees[s][-1][0], top[-1][0], sha("".join(x for b, a in path for x in (*b, *a))), folded, folded == top[-1][0]))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def stored(spark, rows, path):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int").repartition(3).write.parquet(f"{path}/documents.parquet")


def rows_of(spark, path):
    return sorted((tuple(r) for r in queries()["op13_merkle_manifest"](spark, str(path)).collect()), key=key)


AWKWARD = [(None, None, None, None, None), (None, "a", "en", 3, "NO id"), (None, "a", "en", 3, "no ID"), (7, "a", None, 0, ""), (7, "a", None, 0, ""), (7, "a", "en", 5, "Other"), (8, "", "en", 1, None), (-3, "é", "en", 2, "Ünï" * 40_000), (9, "\U0001f600", "de", 1, "ÄB"), (10, "Z", "de", -1, "1:a-")]


def test_awkward_rows_by_brute_force_and_sql(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = AWKWARD + [(i, ["hot", "a", None, "é"][min(3, i % 9)], "en", 5, f"Text {rng.integers(9)}") for i in range(100, 500)]
    stored(spark, rows, tmp_path)
    found = rows_of(spark, tmp_path)
    assert found == sorted(brute(rows), key=key)
    assert 0 < sum(r[-1] for r in found) < len(found)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(db.sql(merkle.SQL).fetchall(), key=key) == found


@pytest.mark.parametrize("most", [1, 2])
def test_trees_of_several_blocks(spark, most):
    """Blocks of 16 or 256 neighbours: some hundred rows make trees of several of them, one upon another."""
    rows = [("hot", i) for i in range(16 * 16 + 17)] + [(f"s{i}", 1000 + i) for i in range(40)] + [("even", 2000 + i) for i in range(16)] + [(None, 5)]
    leaves = [(s, i, sha(str(i)), sha(f"other {i}")) for s, i in rows]
    found = merkle.manifest(spark.createDataFrame(leaves, "tree string, id long, leaf string, other string"), most).collect()
    names = sorted({s for s, _ in rows}, key=lambda s: (s is not None, s or ""))
    trees = {s: tree([sha(str(i)) for t, i in rows if t == s]) for s in names}
    top, want = tree([trees[s][-1][0] for s in names]), []
    for at, s in enumerate(names):
        for i, doc_id in enumerate(d for t, d in rows if t == s):
            path, folded = [*siblings(trees[s], i), *siblings(top, at)], sha(f"other {doc_id}")
            for before, after in path:
                folded = sha("".join([*before, folded, *after]))
            want.append((doc_id, sha(str(doc_id)), trees[s][-1][0], top[-1][0], sha("".join(x for b, a in path for x in (*b, *a))), folded))
    assert sorted(map(tuple, found)) == sorted(want)


def test_one_document_and_none(spark, tmp_path):
    stored(spark, [(1, "a", "en", 1, "A")], tmp_path / "one")
    (row,) = rows_of(spark, tmp_path / "one")
    assert row[1] == row[2] == row[3] and row[4] == sha("") and row == brute([(1, "a", "en", 1, "A")])[0]
    stored(spark, [], tmp_path / "none")
    assert rows_of(spark, tmp_path / "none") == []


def test_states_go_on_as_a_fresh_hash_would():
    levels = merkle.climbed([sha(str(i)).encode() for i in range(300)], 3, 0)
    states = merkle.Midstates(levels, [(b"left" * 16, b"right")])
    for i in (0, 15, 16, 299):
        assert states.folded(i, levels[0][i]).decode() == sha("left" * 16 + levels[-1][0].decode() + "right")
