"""Operator 1: base counts of a text, and a calibrated n-gram logistic regression against fixed thresholds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ngrams import fit_logistic, fit_platt, margins, shares
from .shared import IS_INK, Texts, bounded_batches, combined, documents, dropped, mixed, same_spans, slices, written

#: Base rules: words at least; most percent of words in repeated windows; words of a window.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: The model: buckets of each order (2**BITS), orders of n-grams of code points and of words, and the most that it is fitted on: labelled rows, and MB of features of one label's rows.
BITS, CHARS, WORDS, SAMPLE, SAMPLE_MB = 18, (1, 2, 3), (1, 2), 3000, 24
#: Fixed thresholds of the probability: from the first on a text is kept, from the second on it is called clean.
KEEP, CLEAN = 0.5, 0.9
#: Bytes that are scored at once.
AT_ONCE = 1 << 18
#: Labels that are broadcast to the texts at most; more are joined as Spark sees fit.
MOST_BROADCAST = 200_000
#: Share of the sample that only fits the calibration: one row in so many.
CALIBRATION = 5

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
IS_POINT = (np.arange(256) & 0xC0) != 0x80


def base_counts(texts: Texts, window: int = WINDOW) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts, ends, first = texts.words()
    data = texts.bytes
    out = {"n_words": np.diff(first), "word_chars": texts.sums(IS_INK[data] & IS_POINT[data]), "n_symbols": texts.sums(IS_SYMBOL[data])}
    salt = mixed(np.arange(1, texts.n + 1, dtype=np.uint64))
    # lines with a word, beyond the first of equal ones
    breaks = np.flatnonzero(data == 10)
    opens = np.unique(np.concatenate([texts.bounds[:-1], breaks + 1])) if texts.n else np.zeros(0, np.int64)
    opens = opens[opens < len(data)]
    of_line = np.searchsorted(texts.bounds, opens, "right") - 1
    at = np.searchsorted(breaks, opens)
    closes = np.minimum(np.append(breaks, len(data))[at], texts.bounds[of_line + 1]) if len(opens) else opens
    with_word = np.searchsorted(starts, closes) > np.searchsorted(starts, opens)
    opens, closes, of_line = opens[with_word], closes[with_word], of_line[with_word]
    size = closes - opens
    lines = texts.hashes(opens, closes) ^ salt[of_line]
    _, once, index = np.unique(lines, return_index=True, return_inverse=True)
    out["n_dup_lines"] = np.bincount(of_line, minlength=texts.n) - np.bincount(of_line[once], minlength=texts.n)
    model = once[index]
    fair = (size == size[model]) & (of_line == of_line[model])
    fair[fair] = same_spans(texts, opens[fair], texts, opens[model[fair]], size[fair])
    for i in np.unique(of_line[~fair]):  # lines that share a hash are counted by themselves
        own = [texts.bytes[a:b].tobytes() for a, b in zip(opens[of_line == i], closes[of_line == i], strict=True)]
        out["n_dup_lines"][i] = len(own) - len(set(own))
    # words in windows that a text has twice
    of_word = np.repeat(np.arange(texts.n), np.diff(first))
    grams = combined(texts.hashes(starts, ends), window)
    inside = np.flatnonzero(of_word[: len(grams)] == of_word[window - 1 :]) if len(grams) else np.zeros(0, np.int64)
    grams = grams[inside] ^ salt[of_word[inside]]
    ordered = np.sort(grams)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    cover = np.zeros(len(starts) + 1, np.int64)
    if len(twice):
        found = np.searchsorted(twice, grams)
        hit = inside[twice[np.minimum(found, len(twice) - 1)] == grams]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    out["n_repeat_words"] = covered[first[1:]] - covered[first[:-1]]
    return out


def base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > REPEAT_PERCENT * found["n_words"])


def _sampled(batches):
    """Feature rows of labelled texts that pass the base rules."""
    for batch in batches:
        for part, texts in slices(batch, most=AT_ONCE):
            good = np.flatnonzero(~base_failed(base_counts(texts)))
            if len(good):
                rows = pa.array(good)
                found = shares(Texts(part.column("text").take(rows)), BITS, CHARS, WORDS)
                x = [at.astype("<i4").tobytes() + value.astype("<f2").tobytes() for at, value in found]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array([len(r) for r in x], pa.int64()), part.column("label").take(rows), part.column("rank").take(rows)], ["x", "size", "label", "rank"])


def _row(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(x) // 6
    return np.frombuffer(x, "<i4", n), np.frombuffer(x, "<f2", n, 4 * n)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_mb: float = SAMPLE_MB) -> dict:
    """Fits on at most `sample` labelled texts, up to half of each label, the first ones in hash order of doc_id; texts
    that fail the base rules need no verdict and are left out, and a label's rows end where their features (of whole
    texts) would take more than `sample_mb`. docs: doc_id, text; labels: doc_id, label (0/1). One in CALIBRATION rows of
    each label fits only the calibration, which is then set to the labels' own shares. If no text of a label passes the
    base rules, the model keeps everything (probability 1)."""
    bounded_batches(docs.sparkSession)
    rank = F.xxhash64(F.lit("quality"), F.col("doc_id"))
    known = labels.select("doc_id", F.col("label").cast("int").alias("label")).where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    half, found, passing = sample // 2, {}, {}
    for label in (0, 1):
        # ever more labels of the kind are looked at, until enough of their texts pass the base rules
        tried = 2 * half
        while True:
            chosen = known.where(F.col("label") == label).orderBy(rank, "doc_id").limit(tried)
            chosen = F.broadcast(chosen) if tried <= MOST_BROADCAST else chosen
            rows = texts.join(chosen, "doc_id").select("text", "label", rank.alias("rank"))
            rows = written(rows.mapInArrow(_sampled, "x binary, size long, label int, rank long"), "labelled")
            picked = rows.select("rank", "size").orderBy("rank", "size").limit(half).collect()
            if len(picked) == half or tried >= sizes.get(label, 0):
                break
            dropped(rows)
            tried *= 8
        fits = int(np.searchsorted(np.cumsum([r["size"] for r in picked]), sample_mb * 1e6, "right"))
        last = picked[max(1, fits) - 1]["rank"] if picked else 0
        found[label] = [_row(bytes(r["x"])) for r in rows.where(F.col("rank") <= last).orderBy("rank", "size").select("x").collect()]
        dropped(rows)
        # of the label's rows, those that pass: as many as stand up to the last one's rank, carried on to all
        seen = sizes.get(label, 0)
        if found[label] and (len(picked) == half or fits < len(picked)):
            seen = known.where((F.col("label") == label) & (rank <= last)).count()
        passing[label] = len(found[label]) * sizes.get(label, 0) / max(1, seen)
    size = (len(CHARS) + len(WORDS)) << BITS
    if not (found[0] and found[1]):
        return {"w": np.zeros(size, np.float32), "b": 0.0, "slope": 0.0, "shift": 35.0}
    y = np.repeat([0.0, 1.0], [len(found[0]), len(found[1])])
    x = found.pop(0) + found.pop(1)
    held = np.concatenate([np.arange(int((y == label).sum())) % CALIBRATION == CALIBRATION - 1 for label in (0, 1)])
    w, b = fit_logistic([x[i] for i in np.flatnonzero(~held)], y[~held], size)
    kinds = np.array([(1 - y[held]).sum(), y[held].sum()])
    if kinds.min() > 0:  # rows weigh as much as their label's share of all texts that pass
        share = np.array([passing[0], passing[1]]) / (passing[0] + passing[1])
        z = np.array([float(w[x[i][0]] @ x[i][1].astype(np.float32)) for i in np.flatnonzero(held)]) + b
        slope, shift = fit_platt(z, y[held], weight=(share * kinds.sum() / kinds)[y[held].astype(int)])
    else:  # the regression weighs both labels alike
        slope, shift = 1.0, float(np.log(passing[1] / passing[0]))
    return {"w": w, "b": b, "slope": slope, "shift": shift}


def score(docs: DataFrame, model: dict, keep: float = KEEP, clean: float = CLEAN) -> DataFrame:
    """docs with base counts, base_failed, probability (that the label is 1), kept and clean (by the two thresholds).

    All of docs' columns stay (those of these names give way); needs a string column text. Null and empty texts have
    zero words, so they fail. Texts are counted whole. No row is dropped; repeated rows are judged alike.
    """
    made = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("probability", "double"), ("kept", "boolean"), ("clean", "boolean")]
    names = [n for n, _ in made]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    bounded_batches(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        m = packed.value
        for batch in batches:
            for part, texts in slices(batch, most=AT_ONCE):
                found = base_counts(texts)
                failed = base_failed(found)
                z = margins(texts, m["w"], BITS, CHARS, WORDS) + m["b"]
                p = 1 / (1 + np.exp(-np.clip(m["slope"] * z + m["shift"], -35, 35)))
                new = [pa.array(found[n].astype(np.int64)) for n in names[:5]] + [pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep)), pa.array(~failed & (p >= clean))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *names])

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in made:
        schema = schema.add(name, kind)
    return docs.mapInArrow(judge, schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document. Null and empty texts have no words, so they fail; labels of null ids and
    repeated labels of an id are left to fit(); repeated rows are judged alike."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability", "clean")
