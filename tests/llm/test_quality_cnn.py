import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import quality_cnn as q
from weftline.llm.ngrams import sigmoid
from weftline.llm.shared import Texts


def texts(*x):
    return Texts(pa.array(x, pa.string()))


def plain_logit(net, text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    room = max(q.CHUNK, -(-len(data) // q.STRIDE) * q.STRIDE)
    data = np.concatenate([data, np.zeros(room - len(data), np.uint8)])
    starts = list(range(0, room - q.CHUNK, q.STEP)) + [room - q.CHUNK]
    out = []
    for s in starts:
        x = net.p["embed"][data[s : s + q.CHUNK]]
        conv = np.array([x[i : i + q.WIDTH].reshape(-1) @ net.p["filter"] for i in range(0, q.CHUNK - q.WIDTH + 1, q.STRIDE)])
        top = np.maximum(conv.max(axis=0) + net.p["shift"], 0)
        out.append(np.maximum(top @ net.p["hidden"] + net.p["hidden_shift"], 0) @ net.p["out"] + net.p["out_shift"][0])
    return np.mean(out)


def test_whole_texts_against_plain_loops():
    net, rng = q.Network(3), np.random.default_rng(1)
    some = ["", "short", "é" * 255, "x" * 512, "".join(rng.choice(list("abc é\n"), 3001)), "".join(rng.choice(list("xyz"), 90_000)), "end"]
    assert np.allclose(net.logits(texts(*some)), [plain_logit(net, t) for t in some], atol=2e-4)


def test_every_byte_lies_in_a_chunk():
    for n in (0, 1, 511, 512, 513, 959, 960, 961, 5000):
        flat, starts, bounds = q.layout(texts("a" * n, "b"))
        covered = np.zeros(len(flat), bool)
        for s in starts[: bounds[1]]:
            covered[s : s + q.CHUNK] = True
        assert covered[:n].all() and (np.diff(starts[: bounds[1]]) <= q.STEP).all()


def test_gradients_against_differences():
    net, rng = q.Network(5), np.random.default_rng(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    chunks = rng.integers(0, 256, (4, q.CHUNK)).astype(np.uint8)
    y, weight = np.array([0, 1, 1, 0.0]), np.array([1, 2, 0.5, 1])

    def loss():
        out = 0
        for c, t, w in zip(chunks, y, weight, strict=True):
            x = net._windows(c) @ net.p["filter"] + net.p["shift"]
            z = np.maximum(np.maximum(x.max(axis=0), 0) @ net.p["hidden"] + net.p["hidden_shift"], 0) @ net.p["out"] + net.p["out_shift"][0]
            p = sigmoid(z)
            out -= w * (t * np.log(p) + (1 - t) * np.log(1 - p)) / len(y)
        return out

    grads = net.gradients(chunks, y, weight)
    for name, g in grads.items():
        flat, own = net.p[name].reshape(-1), g.reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old, step = flat[i], 1e-5
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert own[i] == pytest.approx((up - down) / (2 * step), abs=2e-5)


def test_learns_held_out_quality_and_edge_cases(spark):
    rng = np.random.default_rng(6)
    words = "river stone walks gently over the hill morning light and water".split()
    rows = []
    for i in range(400):
        w = rng.choice(words, rng.integers(20, 200))
        rows.append((i, " ".join(w) + "." if i % 3 else " ".join(x + rng.choice(["%%%", "###"]) for x in w), int(i % 3 > 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    net = q.fit(docs, docs.where("doc_id < 300").select("doc_id", "label"), sample=90)
    extra = spark.createDataFrame([(None, "no id"), (900, None), (901, ""), (902, "gentle words " * 30_000)], "doc_id long, text string")
    out = {r.doc_id: r for r in q.score(docs.select("doc_id", "text").union(extra).select("doc_id", F.lit(True).alias("held_out"), "text"), net).collect()}
    assert len(out) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    assert np.mean([out[i].predicted == y for i, _, y in rows[300:]]) > 0.95
    assert out[900].score == out[901].score


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    net = q.fit(docs, spark.createDataFrame([], "doc_id long, label int"))
    frame = docs.select("doc_id", F.lit(False).alias("held_out"), "text")
    assert [r.score for r in q.score(frame, net).collect()] == [0.5]
    assert q.score(frame.limit(0), net).count() == 0
