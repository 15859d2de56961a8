"""Operator 6: language proportions of a document by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngrams import char_buckets
from .shared import Texts, bounded_batches, crc_bucket, documents, slices

#: Byte n-grams (A-Z lower-cased) and their hash buckets; labelled documents of each language to learn from, about.
N, BITS, SAMPLE = 3, 15, 3000
#: Bytes of a segment, which is in one language; an n-gram's evidence counts 1 / N, as N of them overlap.
SEGMENT = 64
#: Rounds of expectation-maximisation, smoothing of counts, cost of another language in log-likelihood beside half the log of the segments.
ROUNDS, SMOOTHING, PENALTY = 12, 0.5, 4.0
#: Log-likelihoods (segments by languages) that are held at once, about; a longer single text takes more.
AT_ONCE = 1 << 20
UNKNOWN = "und"


def _counter(batches):
    """(lang, bucket, n) of a task's texts."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part, texts in slices(batch):
            bucket, inside = char_buckets(texts, N, BITS, lower=True)
            langs = part.column("lang").to_pylist()
            names = {x: i for i, x in enumerate(sorted(set(langs)))}
            owner = np.repeat(np.array([names[x] for x in langs], np.int64), np.diff(texts.bounds))[: len(bucket)]
            found = np.bincount((owner << BITS) + bucket, weights=inside, minlength=len(names) << BITS).reshape(len(names), -1)
            for name, i in names.items():
                total[name] = total.get(name, 0) + found[i]
    for name, counts in total.items():
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> dict:
    """n-gram log-probabilities of each language in labelled (text, lang, rank long), from about `sample` of its texts.

    Those with the least `rank` (a hash) are taken: a share of each language that makes `sample` texts of it. What comes
    to the driver is a number by language and bucket, so the model (and each worker's copy) grows with the number of
    languages, by 128 KB each, and with nothing else.
    """
    bounded_batches(labelled.sparkSession)
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {"names": [], "table": np.zeros((1 << BITS, 0), np.float32), "prior": np.zeros(0)}
    share = labelled.sparkSession.createDataFrame([(k, min(1.0, sample / n)) for k, n in sizes.items()], "lang string, share double")
    unit = F.pmod("rank", F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.join(F.broadcast(share), "lang").where(unit < F.col("share")).select("text", "lang")
    rows = chosen.mapInArrow(_counter, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(sizes)
    table = np.full((1 << BITS, len(names)), SMOOTHING, np.float32)
    table[rows["bucket"].to_numpy(np.int64), rows["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(np.int64)] += rows["n"].to_numpy(np.float32)
    table /= table.sum(axis=0, dtype=np.float64).astype(np.float32)
    np.log(table, out=table)
    table /= N
    return {"names": names, "table": table, "prior": np.array([sizes[x] for x in names]) / sum(sizes.values())}


def mixtures(ll: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages in each document and the set chosen (documents x languages, float and bool).

    ll: log-likelihood of each segment under each language; a document's segments lie between its bounds. Starting
    from all languages, the one with the least share goes as long as that raises the likelihood less the penalty.
    """
    n, k = len(bounds) - 1, ll.shape[1]
    size = np.diff(bounds)
    filled = np.flatnonzero(size)
    share, chosen = np.zeros((n, k)), np.zeros((n, k), bool)
    if not len(filled) or not k:
        return share, chosen

    def climb(docs, mask):
        rows = np.repeat(bounds[docs] - np.concatenate([[0], np.cumsum(size[docs])[:-1]]), size[docs]) + np.arange(size[docs].sum())
        own, owner = ll[rows], np.repeat(np.arange(len(docs)), size[docs])
        starts = np.concatenate([[0], np.cumsum(size[docs])[:-1]])
        top = own.max(axis=1, keepdims=True)
        like = np.exp(own - top)
        p = mask / mask.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            joint = like * p[owner]
            total = joint.sum(axis=1, keepdims=True) + 1e-300
            p = np.add.reduceat(joint / total, starts, axis=0) / size[docs][:, None]
        total = (like * p[owner]).sum(axis=1) + 1e-300
        return p, np.add.reduceat(np.log(total) + top[:, 0], starts)

    def worth(docs, mask, fit):
        return fit - (mask.sum(axis=1) - 1) * (PENALTY + 0.5 * np.log(size[docs]))

    docs, mask = filled, np.ones((len(filled), k), bool)
    p, fit = climb(docs, mask)
    value = worth(docs, mask, fit)
    share[docs], chosen[docs] = p, mask
    small = p < 1e-3
    small[np.arange(len(docs)), p.argmax(axis=1)] = False
    drop = small
    while len(docs):
        single = np.where(mask, p, np.inf).argmin(axis=1)
        one = np.zeros_like(mask)
        one[np.arange(len(docs)), single] = True
        mask = np.where(drop.any(axis=1)[:, None], mask & ~drop, mask & ~one)
        open_ = mask.any(axis=1) & (mask.sum(axis=1) < chosen[docs].sum(axis=1))
        docs, mask, value = docs[open_], mask[open_], value[open_]
        if not len(docs):
            break
        p, fit = climb(docs, mask)
        new = worth(docs, mask, fit)
        better = new >= value
        docs, mask, p, value = docs[better], mask[better], p[better], new[better]
        share[docs], chosen[docs] = p, mask
        drop = np.zeros_like(mask)
    return share, chosen


def _has_letter(texts: Texts, column: pa.Array) -> np.ndarray:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[[*range(65, 91), *range(97, 123)]] = True
    out = texts.sums(ascii_letter[texts.bytes]) > 0
    for i in np.flatnonzero(~out & (np.diff(texts.bounds) > 0)):
        out[i] = any(map(str.isalpha, column[int(i)].as_py()))
    return out


def identify(texts: Texts, column: pa.Array, model: dict) -> tuple[list[str], np.ndarray, list[list[str]], list[list[float]]]:
    """Most frequent language, its share, and the chosen languages with their shares, of each text."""
    names, table = model["names"], model["table"]
    bucket, inside = char_buckets(texts, N, BITS, lower=True)
    begins = [np.arange(a, max(a + 1, b), SEGMENT) for a, b in zip(texts.bounds[:-1].tolist(), (texts.bounds[1:] - N + 1).tolist(), strict=True) if b > a]
    sized = np.diff(texts.bounds) >= N
    starts = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.where(sized, -(-(np.diff(texts.bounds) - N + 1) // SEGMENT), 0))])
    ll = np.zeros((len(starts), len(names)), np.float32)
    if len(starts) and names:
        for j in range(0, len(names), 8):
            rows = table[bucket, j : j + 8]
            rows[~inside] = 0
            ll[:, j : j + 8] = np.add.reduceat(rows, starts, axis=0)
    share, chosen = mixtures(ll.astype(np.float64), bounds)
    known = _has_letter(texts, column)
    if names:
        share[~sized] = model["prior"]
    pred, score, langs, shares = [], np.zeros(texts.n), [], []
    for i in range(texts.n):
        if not known[i] or not names:
            pred.append(UNKNOWN), langs.append([]), shares.append([])
            continue
        best = int(share[i].argmax())
        some = [j for j in np.argsort(-share[i], kind="stable") if chosen[i, j]] or [best]
        pred.append(names[best]), langs.append([names[j] for j in some]), shares.append([float(share[i, j]) for j in some])
        score[i] = min(1.0, max(0.0, share[i, best]))
    return pred, score, langs, shares


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, held_out, text) with lang_pred, score, langs and shares instead of the text.

    A text without a letter (null and empty ones too) is UNKNOWN with score 0; one that is too short for an n-gram gets
    the most frequent language. Whole texts are read; a text's prediction depends on nothing but its bytes.
    """
    bounded_batches(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast(model)
    most = max(1 << 12, min(1 << 20, AT_ONCE * SEGMENT // max(1, len(model["names"]))))

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, most=most):
                pred, score, langs, shares = identify(texts, part.column("text"), packed.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], ["doc_id", "held_out", "lang_pred", "score", "langs", "shares"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>")


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no remainder: it isn't held out, and nothing is learned from it."""
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False)))
    labelled = docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()).select("text", "lang", F.xxhash64(F.lit("lang"), F.col("doc_id")).alias("rank"))
    return predict(docs.select("doc_id", "held_out", "text"), fit(labelled))
