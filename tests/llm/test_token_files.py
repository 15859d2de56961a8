import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from weftline.llm import token_files as f
from weftline.llm import tokens


@pytest.mark.parametrize(("n", "most"), [(1, 5), (127, 3), (5000, 50_000), (f.BLOCK + 1, 300), (3 * f.BLOCK, 40_000), (2000, 1)])
def test_round_trip_whole_and_by_block(n, most):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, most - 1).astype(np.uint32)
    data = f.write_segment(pa.array([None] + [7] * (n > 1), pa.int64()), ids, np.array([1, n - 1][: 1 + (n > 1)]))
    segment = f.Segment(data)
    assert (segment.blocks() == ids).all()
    assert segment.doc_ids.to_pylist() == [None] + [7] * (n > 1)
    for b in range(len(segment.header["checkpoints"])):
        assert (segment.blocks([b]) == ids[b * f.BLOCK : (b + 1) * f.BLOCK]).all()


def test_size_is_near_the_entropy():
    rng = np.random.default_rng(9)
    ids = np.minimum(rng.zipf(1.5, 1 << 19), 50_000).astype(np.uint32)
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(f.write_segment(pa.array([1]), ids, np.array([len(ids)]))) < 1.04 * -(p * np.log2(p)).sum() * len(ids) / 8 + 20_000


def test_damage_is_noticed():
    data = bytearray(f.write_segment(pa.array([1]), np.arange(1000, dtype=np.uint32), np.array([1000])))
    data[-5] ^= 1
    with pytest.raises(ValueError):
        f.Segment(bytes(data))


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("part", T.StringType())])


def test_files_against_the_library(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i) * 5 - 40, " ".join(rng.choice(["uno", "dos,", "três.", "\n"], rng.integers(0, 300))), "x") for i in rng.permutation(80)]
    rows += [(None, "no id", "x"), (10_000, None, "x"), (10_001, "", "x"), (10_002, "long text " * 30_000, "x"), (10_003, "twice", "x"), (10_003, "twice", "x")]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, before = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], np.uint32)
        want.append((doc_id, before, len(ids), tokens.crc32(ids)))
        before += len(ids)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    files = f.encode(spark.createDataFrame(rows, SCHEMA), n=3, segment=2000).cache()
    assert files.count() > 5
    assert sorted((tuple(r) for r in f.read(files).collect()), key=lambda r: r[1]) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    none = f.encode(spark.createDataFrame([], SCHEMA))
    assert f.read(none).count() == 0
