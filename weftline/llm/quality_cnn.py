"""Operator 10: document quality by a byte-level convolutional network, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngrams import fit_platt, sigmoid
from .shared import Texts, bounded_batches, crc_bucket, documents, dropped, runs, slices, written

#: Bytes of a chunk and between starts of chunks; width and stride of the filters (bytes); sizes of the embedding, the filters and the hidden layer.
CHUNK, STEP, WIDTH, STRIDE, DIM, FILTERS, HIDDEN = 512, 448, 8, 2, 8, 24, 16
#: Positions of a chunk, and chunks between starts in positions.
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1
#: Labelled documents of each label to fit on at most, MB of whole texts of a label at most, epochs, chunks of a step, and the least score of a good text.
SAMPLE, SAMPLE_MB, EPOCHS, BATCH, GOOD = 1200, 8, 8, 64, 0.7
#: One in so many of the sample only fits the calibration.
CALIBRATION = 5


def layout(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each filled up with zeros to whole chunks; start of each chunk; bounds of the texts' chunks.

    Chunks start STEP apart and the last one ends at the text's end (rounded up to the stride), so they overlap and
    cover the whole text. An empty text is one chunk of zeros.
    """
    size = np.diff(texts.bounds)
    room = np.maximum(CHUNK, -(-size // STRIDE) * STRIDE)
    begin = np.cumsum(room) - room
    flat = np.zeros(int(room.sum()) + CHUNK, np.uint8)
    flat[runs(begin, size)] = texts.bytes
    n = 1 + -(-(room - CHUNK) // STEP)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(begin, n) + np.minimum(within * STEP, np.repeat(room - CHUNK, n))
    return flat, starts, np.concatenate([[0], np.cumsum(n)])


class Network:
    """Embedding, filters with a rectifier, maximum over a chunk, a hidden layer, and one value; a text's logit is the mean of its chunks'."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)),
            "filter": rng.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)),
            "shift": np.zeros(FILTERS),
            "hidden": rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)),
            "hidden_shift": np.zeros(HIDDEN),
            "out": rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN),
            "out_shift": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.slope, self.offset = 1.0, 0.0

    def _windows(self, flat: np.ndarray) -> np.ndarray:
        """The embedded bytes under each position of the filters."""
        x = self.p["embed"][flat]
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(-1), WIDTH * DIM)
        return view[:: STRIDE * DIM]

    def pooled(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each chunk; starts ascend. Positions are worked through in blocks."""
        out = np.empty((len(starts), FILTERS), np.float32)
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + (1 << 16))))
            low, high = int(starts[first]), int(starts[last - 1]) + CHUNK
            conv = self._windows(flat[low:high]) @ self.p["filter"]
            at = (starts[first:last] - low) // STRIDE
            conv = np.concatenate([conv, np.zeros((1, FILTERS), np.float32)])
            out[first:last] = np.maximum.reduceat(conv, np.stack([at, at + POSITIONS], axis=1).reshape(-1), axis=0)[::2]
            first = last
        return np.maximum(out + self.p["shift"], 0)

    def logits(self, texts: Texts) -> np.ndarray:
        flat, starts, bounds = layout(texts)
        top = self.pooled(flat, starts)
        z = np.maximum(top @ self.p["hidden"] + self.p["hidden_shift"], 0) @ self.p["out"] + self.p["out_shift"][0]
        return np.add.reduceat(z.astype(np.float64), bounds[:-1]) / np.diff(bounds) if texts.n else np.zeros(0)

    def score(self, texts: Texts) -> np.ndarray:
        """Calibrated probability of label 1 of each whole text."""
        return sigmoid(self.slope * self.logits(texts) + self.offset)

    def gradients(self, chunks: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss over chunks (n x CHUNK bytes); a maximum passes its gradient to one position."""
        n, p = len(chunks), self.p
        windows = np.stack([self._windows(c) for c in chunks])
        conv = windows @ p["filter"] + p["shift"]
        where = conv.argmax(axis=1)
        top = np.maximum(np.take_along_axis(conv, where[:, None], axis=1)[:, 0], 0)
        mid = np.maximum(top @ p["hidden"] + p["hidden_shift"], 0)
        error = (weight * (sigmoid(mid @ p["out"] + p["out_shift"][0]) - y) / n).astype(np.float32)
        d_mid = error[:, None] * p["out"] * (mid > 0)
        d_top = d_mid @ p["hidden"].T * (top > 0)
        seen = windows[np.arange(n)[:, None], where]  # n x FILTERS x WIDTH * DIM
        d_embed = np.zeros_like(p["embed"])
        d_seen = (d_top[:, :, None] * p["filter"].T).reshape(-1, DIM)
        spots = where[:, :, None] * STRIDE + np.arange(WIDTH)
        np.add.at(d_embed, np.take_along_axis(chunks, spots.reshape(n, -1), axis=1).reshape(-1), d_seen)
        return {
            "embed": d_embed, "filter": np.einsum("nfk,nf->kf", seen, d_top), "shift": d_top.sum(axis=0),
            "hidden": top.T @ d_mid, "hidden_shift": d_mid.sum(axis=0), "out": mid.T @ error, "out_shift": error.sum(keepdims=True),
        }

    def train(self, chunks: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.004, seed: int = 8) -> None:
        """Adam over shuffled steps of BATCH chunks; the rate falls linearly."""
        rng, t, steps = np.random.default_rng(seed), 0, epochs * -(-len(y) // BATCH)
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                some = order[i : i + BATCH]
                t += 1
                for k, g in self.gradients(chunks[some], y[some], weight[some]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    step = rate * (1 - (t - 1) / steps) * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
                    self.p[k] = (self.p[k] - step).astype(np.float32)


def _chunked(batches):
    """Labelled texts as all of their chunks."""
    for batch in batches:
        for part, texts in slices(batch):
            flat, starts, bounds = layout(texts)
            out = [b"".join(flat[s : s + CHUNK].tobytes() for s in starts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("rank"), pa.array(out, pa.binary())], ["label", "rank", "chunks"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_mb: float = SAMPLE_MB) -> Network:
    """Fits on at most `sample` labelled texts of each label, the first ones in hash order of doc_id, with all chunks.

    A label's texts end where they would take more than `sample_mb` together. docs: doc_id, text (a null one is empty);
    labels: doc_id, label (0/1, others are ignored). With under 10 texts of either label nothing is learned and every
    score is 0.5.
    """
    bounded_batches(docs.sparkSession)
    rank = F.xxhash64(F.lit("cnn"), F.col("doc_id"))
    known = labels.select("doc_id", F.col("label").cast("int").alias("label")).where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.where("label = 0").orderBy(rank, "doc_id").limit(sample).union(known.where("label = 1").orderBy(rank, "doc_id").limit(sample))
    rows = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", rank.alias("rank"), "text"), "labelled")
    sizes = sorted((r["label"], r["rank"], r["n"]) for r in rows.select("label", "rank", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect())
    last = {}
    for label in (0, 1):
        own = [x for x in sizes if x[0] == label]
        fits = int(np.searchsorted(np.cumsum([n for _, _, n in own]), sample_mb * 1e6, "right"))
        last[label] = own[max(1, fits) - 1][1] if own else 0
    within = rows.where(F.col("rank") <= F.when(F.col("label") == 0, last[0]).otherwise(last[1]))
    found = sorted(((r["rank"], r["label"], r["chunks"]) for r in within.mapInArrow(_chunked, "label int, rank long, chunks binary").collect()))
    dropped(rows)
    net = Network()
    y = np.array([r[1] for r in found], np.float32)
    if min(y.sum(), len(y) - y.sum()) < 10:
        net.slope = 0.0
        return net
    chunks = [np.frombuffer(r[2], np.uint8).reshape(-1, CHUNK) for r in found]
    count = np.array([len(c) for c in chunks])
    balance = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    held = np.arange(len(y)) % CALIBRATION == 0
    use = np.repeat(~held, count)
    flat = np.concatenate(chunks)
    net.train(flat[use], np.repeat(y, count)[use], np.repeat(balance / count * count.mean(), count)[use].astype(np.float32))
    rest = [c for c, h in zip(chunks, held, strict=True) if h]
    if 0 < y[held].sum() < held.sum():
        joined = np.concatenate(rest)
        top = net.pooled(np.concatenate([joined.reshape(-1), np.zeros(CHUNK, np.uint8)]), np.arange(len(joined)) * CHUNK)
        z = np.maximum(top @ net.p["hidden"] + net.p["hidden_shift"], 0) @ net.p["out"] + net.p["out_shift"][0]
        starts = np.concatenate([[0], np.cumsum(count[held])[:-1]])
        net.slope, net.offset = fit_platt(np.add.reduceat(z.astype(np.float64), starts) / count[held], y[held])
    return net


def score(docs: DataFrame, net: Network, good: float = GOOD) -> DataFrame:
    """docs (doc_id, held_out, text) with score and predicted (1 if score >= good) instead of the text.

    A null text counts as empty, and an empty one has a score like any other. No row is dropped.
    """
    bounded_batches(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, most=1 << 19):
                p = packed.value.score(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= good).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no remainder: it isn't held out; labels of null ids are of no use."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_bucket(F.col("doc_id"), 4) != 2)
    net = fit(docs.where(~F.col("held_out")), labels.select("doc_id", F.col("quality").alias("label")))
    return score(docs, net)
