"""Each registered query on one small folder of awkward documents: columns, rows and what its contract fixes."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from weftline.llm import mixing
from weftline.llm.queries import oracle_sql, queries

from .test_near_dedup import brute as components
from .test_quality_rules import brute as counts

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators give to columns of their own.
CLASHING = ["kept", "score", "members", "size", "id", "label", "held_out", "range", "hash", "mark", "host", "rank"]
WORDS = {"en": "the of and with this river walks gently".split(), "de": "der und nicht für eine straße über läuft".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    rows, labels = [], []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        words = rng.choice(WORDS[lang], rng.integers(3, 90)).tolist()
        if i % 7 == 0:
            words = [w + "###" for w in words]
        rows.append((3 * i, " ".join(words), lang if i % 11 else None, ["a", "b", None, "é"][i % 4], 0))
        labels.append((3 * i, int(i % 7 > 0), 0))
    rows += [(700, None, "en", "a", None), (701, "", "en", "b", 0), (702, " \n\t", None, "a", 3), (703, "long word " * 30_000, "en", "a", 0), (704, "12 34", "de", "b", 5), (706, "12 <|endoftext|> 34", "de", "b", 5), (705, rows[5][1], "en", "é", 0), (3, rows[1][1], "en", "b", 0), (None, "no id at all", "en", "a", 0), (None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("contract"))
    schema = T.StructType([*SCHEMA.fields, *[T.StructField(c, T.StringType()) for c in CLASHING]])
    spark.createDataFrame([(*r, *CLASHING) for r in rows], schema).repartition(3).write.parquet(path + "/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    spark.createDataFrame([], schema).write.parquet(path + "-none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(path + "-none/labels.parquet")
    return rows, path


COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_license_scan": "doc_id licenses rules",
    "op4_line_dedup": "doc_id source n_lines n_dropped text",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_language_mixture": "doc_id held_out lang_pred score",
    "op7_token_files": "doc_id start n_tokens ids_crc32",
    "op8_near_dedup": "doc_id n_shingles component_id kept",
    "op9_mix_sources": "doc_id size source_size target taken",
    "op10_quality_cnn": "doc_id held_out score predicted",
    "op11_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op13_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.fixture(scope="module")
def results(spark, folder):
    out = {}

    def get(name):
        if name not in out:
            df = queries()[name](spark, folder[1])
            assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split() if name != "op4_line_dedup" else set(df.columns) == set(COLUMNS[name].split())
            out[name] = df.collect()
        return out[name]

    return get


def test_every_operator_has_its_query():
    assert set(queries()) == set(COLUMNS) and set(oracle_sql()) == {"op4_line_dedup", "op12_suffix_dedup", "op13_merkle_manifest"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_no_rows(spark, folder, name):
    assert queries()[name](spark, folder[1] + "-none").count() == 0


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - {"op5_packing"}))
def test_a_row_for_each_document(results, folder, name):
    assert sorted(str(r.doc_id) for r in results(name)) == sorted(str(r[0]) for r in folder[0])


def test_op1(results, folder):
    want = sorted((str(d), *counts(t)) for d, t, *_ in folder[0])
    assert sorted((str(r.doc_id), *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]) for r in results("op1_quality_rules")) == want
    for r in results("op1_quality_rules"):
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)


def test_op2(results, folder):
    rows = sorted(((d, t or "") for d, t, *_ in folder[0]), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (d, t) in enumerate(rows):
        following, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in results("op2_fingerprints")) == sorted(want)
    by = {}
    for r in results("op2_fingerprints"):
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by[705] == by[15] and len(by[3]) == 1


def ids_of(folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return sorted((str(d), zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, *_ in folder[0])


def test_op7(results, folder):
    out = results("op7_token_files")
    assert sorted((str(r.doc_id), r.ids_crc32, r.n_tokens) for r in out) == ids_of(folder)
    ordered = sorted(out, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known)


def test_op5(results, folder):
    pieces, sequences, docs = {}, {}, []
    for r in results("op5_packing"):
        pieces.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.start == 0 and r.length == r.doc_tokens:
            docs.append((str(r.doc_id), r.ids_crc32, r.doc_tokens))
    for (_, total), found in pieces.items():
        assert sum(n for _, n in found) % total == 0
    for found in sequences.values():
        found.sort()
        assert [a for a, _ in found] == np.cumsum([0] + [n for _, n in found])[:-1].tolist() and sum(n for _, n in found) <= 1024
    assert set(docs) <= set(ids_of(folder))
    lengths = np.array([sum(n for _, n in found) for found in sequences.values()])
    padded = np.where(lengths & (lengths - 1) == 0, 0, 1024 - lengths).sum()
    assert padded <= 0.1 * lengths.sum()


def test_op6(results, folder):
    for r in results("op6_language_mixture"):
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    by = {r.doc_id: r.lang_pred for r in results("op6_language_mixture")}
    assert all(by[d] == "und" for d in (700, 701, 702, 704)) and set(by.values()) == {"en", "de", "und"}
    right = [by[d] == lang for d, t, lang, *_ in folder[0][:160] if lang and t and d != 3]
    assert np.mean(right) > 0.95


def test_op8(results, folder):
    rows = [(d, t) for d, t, *_ in folder[0] if d is not None]
    want = components(rows, 2)
    for r in results("op8_near_dedup"):
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]


def test_op9(results, folder):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, source, _ in folder[0]:
        sizes[source] = sizes.get(source, 0) + size(t)
    wanted, taken = mixing.targets(sizes), dict.fromkeys(sizes, 0)
    for r in results("op9_mix_sources"):
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source]) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in sizes)
    assert sorted((str(r.doc_id), r.size) for r in results("op9_mix_sources")) == sorted((str(d), size(t)) for d, t, *_ in folder[0])


def test_op10(results):
    for r in results("op10_quality_cnn"):
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


@pytest.mark.parametrize("name", ["op6_language_mixture", "op10_quality_cnn"])
def test_labels_of_held_out_rows_change_nothing(spark, folder, results, tmp_path, name):
    remainder = {"op6_language_mixture": (5, 0), "op10_quality_cnn": (4, 2)}[name]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % remainder[0] == remainder[1]
    docs, labels = (spark.read.parquet(f"{folder[1]}/{t}.parquet").collect() for t in ("documents", "labels"))
    docs = [(*r[:2], "xx" if held(r.doc_id) else r.lang, *r[3:]) for r in docs]
    labels = [(r.doc_id, 1 - r.quality if held(r.doc_id) else r.quality, r.toxic) for r in labels]
    spark.createDataFrame(docs, spark.read.parquet(folder[1] + "/documents.parquet").schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    again = queries()[name](spark, str(tmp_path)).collect()
    before, after = ({(str(r.doc_id), i): r.score for i, r in enumerate(sorted(rows, key=lambda r: (str(r.doc_id), round(r.score, 4))))} for rows in (results(name), again))
    assert after == pytest.approx(before, abs=1e-5)


def test_op3_finds_what_stands_in_a_text(spark, tmp_path):
    rows = [(1, "Intro.\nReleased under the MIT License.\nEnd", "en", "a", 0), (2, "none here", "en", "a", 0), (3, None, "en", "a", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.licenses for r in queries()["op3_license_scan"](spark, str(tmp_path)).collect()} == {1: ["MIT"], 2: [], 3: []}
