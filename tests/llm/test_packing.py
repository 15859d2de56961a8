import itertools

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from weftline.llm import packing, tokens


def best(at, penalty, most):
    out = None
    inner = range(1, len(at) - 1)
    for n in range(len(at)):
        for chosen in itertools.combinations(inner, n):
            cuts = [*chosen, len(at) - 1]
            lengths = np.diff(at[[0, *cuts]])
            if lengths.max() <= most:
                cost = packing.padding(lengths, most).sum() + penalty[cuts].sum()
                out = cost if out is None else min(out, cost)
    return out


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(150):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, rng.integers(1, 11)))])
        penalty = rng.choice([0.0, 4.0, 16.0], len(at))
        cuts = packing.choose_cuts(at, penalty, 16)
        lengths = np.diff(at[np.concatenate([[0], cuts])])
        assert lengths.max() <= 16 and cuts[-1] == len(at) - 1
        assert packing.padding(lengths, 16).sum() + penalty[cuts].sum() == pytest.approx(best(at, penalty, 16))


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType())])


def test_every_id_lies_in_one_piece_and_little_is_padded(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vocabulary = ["walk", "river.", "house,", "unbelievable", "it", "stone\nand", "über."]
    texts = ["", None, "one", "no sentence end " * 4000] + [" ".join(rng.choice(vocabulary, rng.integers(1, 900))) for _ in range(150)]
    rows = [(3 * i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x")]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA), n=3).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text, _ in rows:
        own = pieces[pieces.doc_id.isna() if doc_id is None else pieces.doc_id == doc_id].sort_values("start")
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], np.uint32)
        assert (own.doc_tokens == len(ids)).all() and own.length.sum() == len(ids)
        assert own.start.tolist() == np.concatenate([[0], np.cumsum(own.length)[:-1]]).tolist()
        assert [tokens.crc32(ids[a : a + n]) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.concatenate([[0], np.cumsum(s.length)[:-1]]).tolist()
    lengths = pieces.groupby("sequence_id").length.sum().to_numpy()
    assert lengths.max() <= 1024 and packing.padding(lengths).sum() < 0.02 * lengths.sum() + 3 * 1024


def test_twice_the_same_row_and_no_rows(spark):
    df = spark.createDataFrame([(1, "same", "x"), (1, "same", "x")], SCHEMA)
    out = packing.pack(df, n=2).collect()
    assert sum(r.length for r in out) == 2 * out[0].doc_tokens
    assert packing.pack(df.limit(0)).count() == 0
