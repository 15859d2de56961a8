"""Operator 11: periodic runs of words by multi-scale minimizers, and texts with each run cut to one period."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Texts, bounded_batches, documents, mixed, slices

#: A run repeats its period at least so often and has at least so many words.
POWER, LEAST = 4, 6
#: Periods up to this one (a power of two) are found by direct scans of the lag; longer ones by minimizers.
SHORT = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal stretch of True."""
    edge = np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _lag_runs(codes: np.ndarray, owner: np.ndarray, lag: int, power: int, least: int) -> Iterator[tuple[int, int, int]]:
    if len(codes) <= lag:
        return
    starts, ends = _stretches((codes[lag:] == codes[:-lag]) & (owner[lag:] == owner[:-lag]))
    long = np.flatnonzero(ends - starts + lag >= max(least, power * lag))
    for i in long.tolist():
        yield int(starts[i]), int(ends[i]) + lag, lag


def _swept(values: np.ndarray, width: int, of) -> np.ndarray:
    """of (minimum or maximum) of each window of `width` values, a power of two."""
    step = 1
    while step < width:
        values = of(values[:-step], values[step:])
        step *= 2
    return values


def _minimizer_pairs(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring minimizers that are equal, as (position, distance).

    A position is a minimizer if its value is the least of a window of `width` around it (any of equal ones is).
    """
    least = _swept(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(_swept(np.concatenate([edge, least, edge]), width, np.maximum) == grams)
    pair = np.flatnonzero(grams[chosen[1:]] == grams[chosen[:-1]])
    return chosen[pair], chosen[pair + 1] - chosen[pair]


def _reach(codes: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The stretch around word `at` within [low, high) in which words `lag` apart are the same, doubling what is looked at."""
    end, step = at + lag, 64
    while end < high:
        size = min(step, high - end)
        differ = np.flatnonzero(codes[end : end + size] != codes[end - lag : end - lag + size])
        if len(differ):
            end += int(differ[0])
            break
        end, step = end + size, 2 * step
    start, step = at, 64
    while start > low:
        size = min(step, start - low)
        differ = np.flatnonzero(codes[start - size : start] != codes[start - size + lag : start + lag])
        if len(differ):
            start -= size - 1 - int(differ[-1])
            break
        start, step = start - size, 2 * step
    return start, end


def _scaled_runs(codes: np.ndarray, bounds: np.ndarray, power: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Runs of periods above SHORT, scale by scale.

    Scale w is for periods in (w/2, w]. A gram of w words stands once in each period of a run, and a run of four
    periods holds windows of w grams that cover a whole one, so the least gram of a period and its next copy are
    neighbouring minimizers, a period apart. Each pair at such a distance is followed to both sides, word by word.
    """
    grams, width = codes, 1
    longest = int(np.diff(bounds).max(initial=0))
    while power * (width // 2 + 1) <= longest and len(grams) > width:
        if width > SHORT and len(grams) >= width:
            at, lag = _minimizer_pairs(grams, width)
            fits = (lag > width // 2) & (lag <= width)
            at, lag = at[fits], lag[fits]
            order = np.lexsort((at, lag))
            at, lag = at[order], lag[order]
            i = 0
            while i < len(at):
                a, q = int(at[i]), int(lag[i])
                text = int(np.searchsorted(bounds, a, "right")) - 1
                if a + q >= bounds[text + 1]:  # the pair lies in two texts
                    i += 1
                    continue
                start, end = _reach(codes, a, q, int(bounds[text]), int(bounds[text + 1]))
                if end - start >= max(least, power * q):
                    yield start, end, q
                # pairs of this run that are still to come
                last = int(np.searchsorted(lag, q, "right"))
                i = max(i + 1, int(np.searchsorted(at[i:last], end - q)) + i)
        grams = mixed(grams[:-width] * _ODD + grams[width:])
        width *= 2


def find_runs(codes: np.ndarray, bounds: np.ndarray, power: int = POWER, least: int = LEAST) -> np.ndarray:
    """Runs in texts side by side, as rows (start, length, period) ascending by start and period.

    codes: a 64-bit value for each word; bounds: where each text begins, and the end. A run is a stretch of one text
    with least period q and at least max(least, power * q) words that can't be extended with that period. power is
    POWER at least: a shorter run need not hold two windows with one minimizer.
    """
    if power < POWER:
        raise ValueError(f"a power of {power}, not {POWER} at least")
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, SHORT + 1):
        for start, end, q in _lag_runs(codes, owner, lag, power, least):
            found.setdefault((start, end), q)  # a multiple of a period fills the same stretch
    for start, end, q in _scaled_runs(codes, bounds, power, least):
        found.setdefault((start, end), q)
    rows = sorted((start, q, end - start) for (start, end), q in found.items())
    return np.array([(s, n, q) for s, q, n in rows], np.int64).reshape(-1, 3)


RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapsed(power: int, least: int):
    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                starts, ends, first = texts.words()
                found = find_runs(texts.hashes(starts, ends), first, power, least)
                text_of = np.searchsorted(first, found[:, 0], "right") - 1
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, found[:, 0] + found[:, 2], 1)
                np.add.at(change, found[:, 0] + found[:, 1], -1)
                kept = np.cumsum(change[:-1]) == 0
                raw, out = texts.bytes.tobytes(), []
                runs_of: list[list] = [[] for _ in range(texts.n)]
                for t, (s, n, q) in zip(text_of.tolist(), found.tolist(), strict=True):
                    runs_of[t].append((s - int(first[t]), n, q))
                for t in range(texts.n):
                    words = raw[texts.bounds[t] : texts.bounds[t + 1]].split()
                    if runs_of[t]:
                        words = [words[i] for i in np.flatnonzero(kept[first[t] : first[t + 1]]).tolist()]
                    out.append(b" ".join(words))
                runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in some] for some in runs_of], _RUNS)
                text = pa.array(out, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(first)), runs, text], ["id", "n_words", "runs", "collapsed"])

    return run


def collapse_runs(docs: DataFrame, id_col: str, text_col: str, power: int = POWER, least: int = LEAST) -> DataFrame:
    """(id long, n_words, runs, collapsed) of each row of docs.

    runs: all runs by start and period, in word numbers from 0. collapsed: the words that no run holds after its first
    period, joined by single spaces. Null and wordless texts have no runs and become empty. Rows stay one to one,
    repeated ids and null ids as well. Words are told apart by 64 bits of hash (those up to eight bytes exactly); two
    of a text's 20,000 longer ones share one with probability 1e-11. A text is handled whole within its task, in
    some 100 bytes a word.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_collapsed(power, least), f"id long, n_words long, runs {RUNS}, collapsed string")


def planted(doc_id: int | None, text: str | None) -> str | None:
    """The text, or with a tenth of ids its words up to a place and from there on a stretch of them again and again."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if text is None or h is None or h % 10:
        return text
    words = text.encode().split()
    if not words:
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode()


def _planted(batches):
    for batch in batches:
        ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(planted, ids, texts), pa.string())], ["doc_id", "text"])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, a tenth of them with a stretch planted; the columns are digests of collapse_runs()."""
    bounded_batches(spark)
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_planted, "doc_id long, text string")
    found = collapse_runs(docs, "doc_id", "text")
    greater = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.reduce("runs", F.element_at("runs", 1), lambda most, r: F.when(greater(r, most), r).otherwise(most))
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
