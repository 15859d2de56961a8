import collections
import os
import re

import numpy as np
import pytest
from pyspark.sql import types as T

import corpus_pipeline as cp
from weftline.llm import mixing
from weftline.llm.line_dedup import MIN_PAGES, RATIO

from .test_mixing import take
from .test_near_dedup import brute
from .test_quality_rules import brute as base

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(240):
        words = rng.choice(vocabulary, rng.integers(5, 90)).tolist()
        if i % 4 == 3:
            words = [w + "%%%" for w in words]
        text = " ".join(words)
        if i % 5 == 0:
            text = "Share this page\n" + text
        if i and i % 6 == 0:
            text = rows[-1][1]
        rows.append((i, text, "en", ["a", "b", None][i % 3]))
        labels.append((i, int("%%%" not in text)))
    rows += [(900, None, "en", "a"), (901, "", None, "b"), (902, "same as before", "en", "a"), (None, " ".join(rng.choice(vocabulary, 40)), "en", "a")]
    rows = [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(os.path.join(path, "labels.parquet"))
    return rows, dict(labels), path


def test_each_stage_against_brute_force(spark, made):
    rows, labels, path = made
    docs = spark.read.parquet(path + "/documents.parquet")
    first = [tuple(r) for r in cp.quality_stage(spark, docs, path).collect()]
    passed = [r for r in rows if base(r[1])[0] >= 20 and 100 * base(r[1])[4] <= 30 * base(r[1])[0] and "%%%" not in r[1]]
    assert sorted(first, key=str) == sorted(passed, key=str)

    df = spark.createDataFrame(first, SCHEMA)
    second = [tuple(r) for r in cp.line_stage(spark, df, path).collect()]
    host = collections.Counter(r[3] for r in first)
    lines = collections.Counter((r[3], x) for r in first for x in set(r[1].split("\n")) if re.search(r"[^\x20\x09-\x0D]", x))
    bad = {k for k, n in lines.items() if n >= MIN_PAGES and n > RATIO * host[k[0]]}
    cut = ["\n".join(x for x in r[1].split("\n") if (r[3], x) not in bad) for r in first]
    assert sorted(second, key=str) == sorted([(r[0], t, r[2], r[3], len(t)) for r, t in zip(first, cut, strict=True)], key=str)
    assert len(bad) >= 2

    df = spark.createDataFrame(second, SCHEMA)
    third = [tuple(r) for r in cp.near_stage(spark, df, path).collect()]
    groups = brute([r[:2] for r in second if r[0] is not None], 5)
    assert sorted(third, key=str) == sorted([r for r in second if r[0] is None or groups[r[0]][2]], key=str)
    assert len(third) < len(second)

    df = spark.createDataFrame(third, SCHEMA)
    fourth = [tuple(r) for r in cp.mix_stage(spark, df, path).collect()]
    taken = take(spark, [(r[0], r[1], [r[3]]) for r in third])
    want = [r for r in third for _ in range(int(taken[r[0]] / len(r[1].split()) + 0.5))]
    assert sorted(fourth, key=str) == sorted(want, key=str)


def test_run_is_the_stages_in_order(spark, made):
    _, _, path = made
    docs = spark.read.parquet(path + "/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == [f.name for f in SCHEMA]
    want = sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in cp.STAGES[-1][1](spark, docs, path).select("doc_id", "start", "length", "ids_crc32").collect())
    got = sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in cp.run(spark, path).collect())
    assert sum(x[2] for x in got) == sum(x[2] for x in want) and {x[0] for x in got} == {x[0] for x in want}


def test_repeated_ids_and_no_rows(spark, made):
    _, _, path = made
    text = " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "a", 1)], SCHEMA)
    assert [r.doc_id for r in cp.near_stage(spark, df, path).collect()] == [1]
    for _, stage in cp.STAGES:
        assert stage(spark, df.limit(0), path).count() == 0


def test_columns_with_clashing_names_long_texts_ties_and_nulls(spark, made):
    rows, labels, path = made
    extra = ["kept", "probability", "n_words", "line_dedup", "members", "size", "taken", "id", "component", "label", "mark", "class"]
    schema = T.StructType([*SCHEMA.fields, *[T.StructField(c, T.StringType()) for c in extra], T.StructField("m", T.MapType(T.StringType(), T.LongType()))])
    long = " ".join(f"long{i}" for i in range(40_000))
    docs = [*rows, (950, long, "en", "a", len(long)), (951, long + " end", "en", None, len(long) + 4), (952, rows[1][1], None, None, None), (1, rows[1][1], None, "a", None)]
    wide = spark.createDataFrame([(*r, *[f"{c}{i}" for c in extra], {"k": i}) for i, r in enumerate(docs)], schema)
    narrow = spark.createDataFrame(docs, SCHEMA)
    for _, stage in cp.STAGES[:-1]:
        want = sorted(map(str, stage(spark, narrow, path).collect()))
        out = stage(spark, wide, path)
        assert out.columns == wide.columns
        got = out.collect()
        assert sorted(str(T.Row(**{c: r[c] for c in narrow.columns})) for r in got) == want
        assert all(r.kept == f"kept{r.m['k']}" and r.line_dedup == f"line_dedup{r.m['k']}" for r in got)
        wide, narrow = spark.createDataFrame(got, schema), spark.createDataFrame([tuple(r[c] for c in narrow.columns) for r in got], SCHEMA)
    assert {950, 1} <= {r.doc_id for r in wide.collect()} and 951 not in {r.doc_id for r in wide.collect()}
    pieces = cp.pack_stage(spark, wide, path).collect()
    assert sum(r.length for r in pieces if r.doc_id == 950) == max(r.doc_tokens for r in pieces if r.doc_id == 950)


def test_of_rows_with_one_id_the_least_hash_is_kept(spark, made):
    _, _, path = made
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = [(1, a, "en", "a", 1), (1, b, "de", "b", 2), (2, a + " end", "en", "a", 3)]
    first = spark.createDataFrame(docs, SCHEMA).where("doc_id = 1").selectExpr("text", "xxhash64(text) AS h").orderBy("h").first().text
    for n in (1, 3):
        out = cp.near_stage(spark, spark.createDataFrame(docs, SCHEMA).repartition(n), path).collect()
        assert [r.text for r in out if r.doc_id == 1] == [first]


def test_rows_without_an_id_are_mixed_by_their_own_source(spark, made):
    _, _, path = made
    docs = [(None, " ".join(f"{s}{i}x{j}" for j in range(60)), "en", s, 1) for s in ("a", "b", "c") for i in range(20)]
    out = cp.mix_stage(spark, spark.createDataFrame(docs, SCHEMA), path).collect()
    wanted = mixing.targets({"a": 1200, "b": 1200, "c": 1200})
    for s, target in wanted.items():
        assert abs(60 * sum(r.source == s for r in out) - target) <= 60
    assert max(collections.Counter(r.text for r in out).values()) == 2
