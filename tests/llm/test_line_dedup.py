import collections
import re

import numpy as np
from pyspark.sql import types as T

from weftline.llm import line_dedup as ld

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("host", T.StringType()), T.StructField("line_dedup", T.StringType())])


def brute(rows, ratio, least):
    host = collections.Counter(r[2] for r in rows)
    lines = collections.Counter((r[2], x) for r in rows for x in set((r[1] or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x))
    bad = {k for k, n in lines.items() if n >= least and n > ratio * host[k[0]]}
    out = []
    for d, t, s, *rest in rows:
        kept = None if t is None else [x for x in t.split("\n") if (s, x) not in bad]
        out.append((d, None if t is None else "\n".join(kept), s, *rest[:1], 0 if t is None else t.count("\n") + 1, 0 if t is None else t.count("\n") + 1 - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, ratio=0.2, least=3):
    out = ld.drop_lines(spark.createDataFrame(rows, SCHEMA), "source", "text", ratio, least)
    return sorted(((r.doc_id, r.text, r.source, r.host, r.line_dedup.n_lines, r.line_dedup.n_dropped) for r in out.collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    menu = [f"line {i}" for i in range(30)] + ["", "  ", "Share", "Share ", "ünï"]
    rows = []
    for i in range(200):
        lines = rng.choice(menu, rng.integers(1, 12)).tolist() + ["Footer"] * (i % 3 > 0)
        rows.append((i, "\n".join(lines), ["a", "b", None, "lone"][min(3, i % 3 + 3 * (i == 7))], "h", "x"))
    rows += [(500, None, "a", "h", "x"), (501, "", "a", "h", "x"), (None, "Footer\nFooter", "b", "h", "x"), (502, "long line " * 20_000 + "\nFooter", "b", "h", "x"), (3, rows[3][1], rows[3][2], "h", "x")]
    want = brute(rows, 0.2, 3)
    assert sum(r[-1] for r in want) > 50
    assert run(spark, rows) == want
    monkeypatch.setattr(ld, "BROADCAST_ROWS", 0)
    assert run(spark, rows) == want


def test_a_host_of_few_pages_keeps_its_lines_and_no_rows(spark):
    rows = [(1, "same\nline", "a", "h", "x"), (2, "same\nline", "a", "h", "x")]
    assert run(spark, rows) == brute(rows, 0.2, 3) and all(r[-1] == 0 for r in run(spark, rows))
    assert run(spark, []) == []
