"""Operator 2: document fingerprints by winnowing."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, documents, mixed, partitions

#: Code points of a k-gram, and k-grams of a window; both powers of two. Two texts that share K + WINDOW - 1 code points in a row share a fingerprint hash.
K, WINDOW = 16, 64
#: Code points that are hashed at once; longer texts go through in overlapping blocks.
BLOCK = 1 << 20
_ODD = 0x9E3779B97F4A7C15


def _gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams, from those of half the length at every step."""
    h, n, power = mixed(points.astype(np.uint64) + np.uint64(1)), 1, _ODD
    while n < k:
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power % (1 << 64), 2 * n
    return mixed(h)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points, ascending) and 32-bit hashes of a text's fingerprint.

    Of each window of neighbouring k-grams the one with the least hash is chosen, of equal ones the rightmost. A text
    with fewer k-grams than a window is one window; one shorter than k is one gram. An empty text has none.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if n < k:
        whole = np.concatenate([points, np.full(k - n, 0xFFFFFFFE, np.uint32)])
        return np.zeros(1, np.int64), (_gram_hashes(whole, k) >> np.uint64(32)).astype(np.uint32)
    at, values, grams = [], [], n - k + 1
    w = 1
    while 2 * w <= min(window, grams):
        w *= 2
    span = min(window, grams)
    for start in range(0, max(1, grams - span + 1), BLOCK):
        h = _gram_hashes(points[start : start + BLOCK + span + k - 2], k) >> np.uint64(32)
        # the least value wins, of equal ones the one with the least distance from the end
        key = (h << np.uint64(32)) | np.arange(len(h) - 1, -1, -1, dtype=np.uint64)
        least, size = key, 1
        while size < w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if span > w:
            least = np.minimum(least[: len(least) - (span - w)], least[span - w :])
        chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
        at.append(start + len(h) - 1 - (chosen & np.uint64(0xFFFFFFFF)).astype(np.int64))
        values.append((chosen >> np.uint64(32)).astype(np.uint32))
    at, values = np.concatenate(at), np.concatenate(values)
    fresh = np.concatenate([[True], at[1:] != at[:-1]])
    return at[fresh], values[fresh]


def fingerprint(at: np.ndarray, values: np.ndarray) -> str:
    """Text form: base64 of the 32-bit hashes, a dot, and base64 of the steps between positions (uint16, or 0xFFFF and a uint32)."""
    if not len(at):
        return ""
    steps = np.diff(at, prepend=0)
    if steps.max() < 0xFFFF:
        packed = steps.astype("<u2").tobytes()
    else:
        packed = b"".join(int(s).to_bytes(2, "little") if s < 0xFFFF else b"\xff\xff" + int(s).to_bytes(4, "little") for s in steps)
    return base64.b64encode(values.astype("<u4").tobytes()).decode() + "." + base64.b64encode(packed).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes by all hashes of two fingerprints; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points give way to the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches):
    """Rows of one or more ranges, each in order and followed by its guest: the first row of the next range."""
    held, waiting = None, []  # the latest row as (doc_id, text, positions, hashes)

    def row(now, following):
        _, text, at, values = now
        other = edited(text, following[1])
        at2, values2 = winnow(other)
        return (now[0], len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(at, values), fingerprint(at2, values2), likeness(values, values2), likeness(values, following[3]))

    def flush():
        out = [pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), TYPES, strict=True)]
        waiting.clear()
        return pa.RecordBatch.from_arrays(out, NAMES)

    for batch in batches:
        for doc_id, text, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest")), strict=True):
            if held is None and guest:  # a range's guests after the first one
                continue
            now = (doc_id, text or "", *winnow(text or ""))
            if held is not None:
                waiting.append(row(held, now))
            held = None if guest else now
            if len(waiting) >= 2000:
                yield flush()
    if waiting:
        yield flush()


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _at(bounds: list[int]) -> Column:
    """How many of the ascending bounds a doc_id has reached, by two short lists each instead of one long one."""
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not parts:
        return F.lit(0)
    reached = lambda some: F.size(F.filter(some, lambda b: b <= F.col("doc_id")))
    longs = lambda some: F.array(*[F.lit(b) for b in some]).cast("array<long>")
    coarse = reached(longs([part[0] for part in parts]))
    fine = F.element_at(F.array(*[longs(part) for part in parts]), coarse)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + reached(fine))


def fingerprints(docs: DataFrame, n: int | None = None) -> DataFrame:
    """Fingerprints of docs (doc_id long, text) and of their edited texts, as SCHEMA.

    Order is by ascending doc_id, a null id first, equal ids by text (those of an id that fills several ranges by the
    text's hash before); the last document is followed by the first, a single one by itself. Null texts count as empty.
    The texts are shuffled once, to about n ranges of ids, a partition each; each range's first document also goes to
    the range before, so that no task needs another one's rows. An id, or none, that many rows share takes as many
    ranges as its share of the rows needs. What comes to the driver is a row for each range.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = n or partitions(spark)
    docs = docs.select("doc_id", "text")
    ids = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("q"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    often = Counter(ids["q"] or [])
    heavy = {b: m for b, m in often.items() if m > 1}
    if (m := ids["nulls"] * n // max(1, ids["rows"])) > 1:
        heavy[None] = m
    most = max(heavy.values(), default=1)
    split = F.lit(None).cast("int")
    for b, m in heavy.items():
        split = F.when(F.col("doc_id").eqNullSafe(F.lit(b).cast("long")), m).otherwise(split)
    busy = split.isNotNull() if heavy else F.lit(False)
    docs = docs.withColumn("hash", F.when(busy, F.xxhash64("text")).otherwise(0))
    place = F.when(busy, F.least(split - 1, F.floor((F.col("hash") / 2.0**64 + 0.5) * split))).otherwise(most)
    number = F.when(F.col("doc_id").isNull(), 0).otherwise(1 + _at(sorted(often))) * (most + 1) + place
    docs = docs.withColumn("range", number.cast("int"))
    firsts = sorted((r["range"], *r["first"]) for r in docs.groupBy("range").agg(F.min(F.struct("doc_id", "hash")).alias("first")).collect())
    table = [(number, i, (i or len(firsts)) - 1, doc_id, hashed) for i, (number, doc_id, hashed) in enumerate(firsts)]
    ranges = F.broadcast(spark.createDataFrame(table, "range int, own int, before int, first_id long, first_hash long"))
    home, guest = (F.struct(F.col(c).alias("own"), F.lit(g).alias("guest")) for c, g in (("own", False), ("before", True)))
    opens = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
    to = F.explode(F.when(opens, F.array(home, guest)).otherwise(F.array(home)))
    dealt = docs.join(ranges, "range").withColumn("to", to).select("doc_id", "hash", "text", "to.own", "to.guest")
    return dealt.repartitionById(max(1, len(firsts)), F.col("own")).sortWithinPartitions("own", "guest", "doc_id", "hash", "text").select("doc_id", "text", "guest").mapInArrow(_rows, SCHEMA)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents. A null text is empty; null ids come first, equal ids follow their texts."""
    return fingerprints(documents(spark, sf_dir))
