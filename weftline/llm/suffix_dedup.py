"""Operator 12: removal of repeated byte strings by a radix sort of suffixes that ends at the threshold's depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SLICE_BYTES, Texts, bounded_batches, documents, dropped, mixed, partitions, runs, slices, written

#: Bytes of a string that is removed where it stands again, and bytes of the grams that such strings are dealt by.
LENGTH, GRAM = 50, 24
#: Bits of the filters of grams that stand in several documents and of texts' first documents: 16 MB each at any size. What they let through in vain costs work, not correctness.
FILTER_BITS = 1 << 27
#: Contexts of one gram that are sorted together at most; a gram with more has its windows dealt out by their content.
TOGETHER = 4096
#: Such grams are broadcast up to this count; beyond it Spark joins them by shuffles.
MOST_BROADCAST = 100_000
#: Bytes of contexts that are sorted at once.
AT_ONCE = 1 << 21
_ODD = 0x9E3779B97F4A7C15
_MARK = ["id", "mark"]


def equal_groups(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the positions `at` begin strings of `length` bytes that stand at several of them, and their groups.

    Most significant digits first, eight bytes to a digit: each pass orders every group by its next digit, splits it
    where the digit changes and leaves out what stands alone. No suffix is looked at beyond `length`, so the groups left
    are the repeated strings. Returns indexes into `at` by group, and ascending group numbers.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    loads = np.ndarray(len(data) + 1, ">u8", buffer=padded.data, strides=(1,))
    live, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for depth in range(0, length, 8):
        digit = loads[at[live] + depth].astype(np.uint64) >> np.uint64(8 * max(0, depth + 8 - length))
        order = np.lexsort((digit, group))
        live, group, digit = live[order], group[order], digit[order]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        several = ~fresh | np.append(~fresh[1:], False)
        live, group = live[several], np.cumsum(fresh)[several]
    return live, group


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all grams, put together from those of GRAM's powers of two."""
    part, n, power, h = mixed(data.astype(np.uint64) + np.uint64(1)), 1, _ODD, None
    done = 0
    while done < GRAM:
        if GRAM & n:
            tail = part[done:]
            h = tail if h is None else h[: len(tail)] * np.uint64(power) + tail[: len(h)]
            done += n
        if done < GRAM:
            part = part[:-n] * np.uint64(power) + part[n:]
            power, n = power * power % (1 << 64), 2 * n
    return mixed(h[: len(data) - GRAM + 1])


def _anchors(data: np.ndarray, begin: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For the windows of `length` bytes that start at begin, begin + 1, ... (many of them): each run of windows with one
    anchor, as (place in begin, first window, windows, gram).

    A window's anchor is its gram with the least hash, of equal ones the last, so equal windows have equal anchors.
    """
    h = _gram_hashes(data)
    least, size, width = ((h >> np.uint64(32)) << np.uint64(32)) | np.arange(len(h) - 1, -1, -1, dtype=np.uint64), 1, length - GRAM + 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < width:
        least = np.minimum(least[: size - width], least[width - size :])
    starts, owner = runs(begin, many), np.repeat(np.arange(len(begin)), many)
    chosen = least[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    gram = h[len(h) - 1 - (chosen[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    return owner[at], starts[at], np.diff(np.append(at, len(starts))), (gram >> np.uint64(16)).astype(np.int64)


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & (8 * len(bits) - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _pieces(batch: pa.RecordBatch, firsts: np.ndarray, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Texts of a batch side by side, or parts of a long one: (rows, bytes, where windows begin by row, how many, bytes before).

    Documents that aren't the first of their text have no windows.
    """
    batch = batch.filter(pa.array(_passes(firsts, batch.column("key").to_numpy(zero_copy_only=False))))
    for part, texts in slices(batch):
        sizes = np.diff(texts.bounds)
        if texts.n == 1 and sizes[0] > SLICE_BYTES:
            for start in range(0, int(sizes[0]) - length + 1, SLICE_BYTES):
                some = texts.bytes[start : start + SLICE_BYTES + length - 1]
                yield part, some, np.zeros(1, np.int64), np.array([len(some) - length + 1]), start
        elif texts.n:
            yield part, texts.bytes, texts.bounds[:-1], sizes - length + 1, 0


def _grams(firsts, length: int):
    def run(batches):
        for batch in batches:
            for part, data, begin, many, _ in _pieces(batch, firsts.value, length):
                owner, _, _, gram = _anchors(data, begin, many, length)
                yield pa.RecordBatch.from_arrays([pa.array(gram), part.column("id").take(pa.array(owner))], ["gram", "id"])

    return run


CONTEXTS = "gram long, a long, b long, first long, context binary"
PLACES = "id long, mark long, start long, windows int, gram long, a long, b long"


def _found(firsts, bits, length: int) -> Iterator:
    """Runs of windows whose anchor's gram passes the filter: rows, bytes and, of each run, its columns of PLACES and its end."""

    def run(batches):
        for batch in batches:
            for part, data, begin, many, before in _pieces(batch, firsts.value, length):
                owner, start, windows, gram = _anchors(data, begin, many, length)
                passed = np.flatnonzero(_passes(bits.value, gram))
                owner, start, windows, gram = owner[passed], start[passed], windows[passed], gram[passed]
                ends = start + windows + length - 1
                texts = Texts.of(data.tobytes())
                a, b = (texts.hashes(start, ends, lane=lane).view(np.int64) for lane in (0, 1))
                yield part, data, owner, start, ends, (start - begin[owner] + before, windows.astype(np.int32), gram, a, b)

    return run


def _places(firsts, bits, length: int):
    def run(batches):
        for part, _, owner, _, _, columns in _found(firsts, bits, length)(batches):
            rows = [part.column(c).take(pa.array(owner)) for c in _MARK]
            yield pa.RecordBatch.from_arrays([*rows, *map(pa.array, columns)], [c.split()[0] for c in PLACES.split(", ")])

    return run


def _contexts(firsts, bits, shared, heads, length: int):
    """Contexts with all their bytes: of grams that the filter `shared` has, in documents that `heads` has them for."""

    def run(batches):
        for part, data, owner, start, ends, (_, _, gram, a, b) in _found(firsts, bits, length)(batches):
            ids = part.column("id").to_numpy()[owner]
            chosen = np.flatnonzero(_passes(shared.value, gram) & _passes(heads.value, a ^ ids))
            raw = data.tobytes()
            taken = [raw[s:e] for s, e in zip(start[chosen].tolist(), ends[chosen].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x[chosen]) for x in (gram, a, b, ids)], pa.array(taken, pa.binary())], [c.split()[0] for c in CONTEXTS.split(", ")])

    return run


RANGES = "array<struct<start:long,end:long>>"
_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _ranges(at: np.ndarray) -> list[dict]:
    """Ascending numbers as ranges, the end excluded."""
    cuts = np.flatnonzero(np.diff(at) != 1)
    return [{"start": int(at[a]), "end": int(at[b]) + 1} for a, b in zip([0, *(cuts + 1)], [*cuts, len(at) - 1], strict=True)]


def _later_windows(length: int):
    """Of contexts in order of gram, hashes and document: windows that stand in a context of a smaller first document too, as (a, b, later)."""

    def flush(held):
        a, b, first, raw = zip(*held, strict=True)
        sizes = np.array([len(x) for x in raw])
        begin, many = np.cumsum(sizes) - sizes, sizes - length + 1
        of = np.repeat(np.arange(len(held)), many)
        live, group = equal_groups(np.frombuffer(b"".join(raw), np.uint8), runs(begin, many), length)
        ids = np.array(first, np.int64)[of[live]]
        heads = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.zeros(0, np.int64)
        least = np.repeat(np.minimum.reduceat(ids, heads), np.diff(np.append(heads, len(ids)))) if len(ids) else ids
        later = np.sort(live[ids > least])
        rows = []
        for i, some in zip(*_split(of[later], later), strict=True):
            rows.append((a[i], b[i], _ranges(some - int(many[:i].sum()))))
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), _RANGES))], ["a", "b", "later"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for gram, *row in zip(*(batch.column(c).to_pylist() for c in ("gram", "a", "b", "first", "context")), strict=True):
                if gram != last and size > AT_ONCE:
                    yield flush(held)
                    held, size = [], 0
                if gram != last or row[:2] != held[-1][:2]:  # else a document that isn't the context's first
                    held.append(row)
                    size += len(row[3])
                last = gram
        if held:
            yield flush(held)

    return run


def _split(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Values by key, of ascending keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return (keys[np.append(0, cuts)].tolist(), np.split(values, cuts)) if len(keys) else ([], [])


def _windows(length: int):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                a, b, first, raw = (batch.column(c).slice(start, 256).to_pylist() for c in ("a", "b", "first", "context"))
                of = [i for i, x in enumerate(raw) for _ in range(len(x) - length + 1)]
                k = [k for x in raw for k in range(len(x) - length + 1)]
                out = [pa.array([c[i] for i in of], pa.int64()) for c in (a, b, first)]
                window = pa.array([raw[i][j : j + length] for i, j in zip(of, k, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*out, pa.array(k, pa.int64()), window], ["a", "b", "first", "k", "window"])

    return run


def _filter(keys: DataFrame):
    """The last bits of keys (key), a bit each, as a broadcast of fixed size."""
    spark = keys.sparkSession
    place = keys.select(F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("place"))
    pages = place.groupBy(F.expr("place div 32768").alias("page")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("bits"))
    bits = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for row in pages.toLocalIterator():
        bits[row["page"]] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(bits.reshape(-1))


def _release(spark: SparkSession) -> None:
    """Has the driver collect what it no longer holds, on which Spark deletes the shuffle files of steps that are over."""
    spark._jvm.System.gc()


def _key(id_: str) -> Column:
    return F.xxhash64(id_, "mark").alias("key")


def later_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, mark, later) of rows (id, mark, text), mark being the text's xxhash64: where strings of `length` bytes start
    that also start in a document with a smaller id, as ranges of byte offsets.

    Of equal texts only the first document is looked at; the others go whole. Windows are dealt by their anchor's gram,
    together with their neighbours of the same anchor (a context). Grams that only one document has never leave their
    task. Of equal contexts, told by 128 bits of hash, the least id stands for all, found with partial aggregates, and
    where a gram has a single context that settles it. Other contexts go, once each, with their bytes to where their
    gram's are sorted together.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col("id").isNotNull() & (F.octet_length("text") >= length)).withColumn("key", _key("id"))
    texts = docs.select("id", "mark", F.xxhash64(F.lit("text"), "text").alias("other"), F.octet_length("text").alias("size"))
    same = ["mark", "other", "size"]
    groups = written(texts.groupBy(*same).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "texts")
    firsts = _filter(groups.select(_key("first")))
    copies = texts.join(groups.where("n > 1").drop("n"), same).where("id > first")
    grams = docs.select("id", "key", "text").mapInArrow(_grams(firsts, length), "gram long, id long").groupBy("gram").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    bits = _filter(grams.where("least < most").select(F.col("gram").alias("key")))
    del grams
    _release(spark)
    places = docs.mapInArrow(_places(firsts, bits, length), PLACES)
    distinct = written(places.groupBy("gram", "a", "b").agg(F.min("id").alias("first")), "distinct-contexts")
    _release(spark)
    several = written(distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-grams")
    shared = _filter(several.select(F.col("gram").alias("key")))
    heads = _filter(distinct.select(F.col("a").bitwiseXOR(F.col("first")).alias("key")))
    _release(spark)
    contexts = written(docs.mapInArrow(_contexts(firsts, bits, shared, heads, length), CONTEXTS), "contexts")
    crowded = several.where(F.col("n") > TOGETHER).select("gram")
    busy = crowded.count()
    crowded = F.broadcast(crowded) if busy <= MOST_BROADCAST else crowded
    few = contexts.join(crowded, "gram", "left_anti") if busy else contexts
    dealt = few.repartition(partitions(spark), "gram").sortWithinPartitions("gram", "a", "b", "first")
    later = together = written(dealt.mapInArrow(_later_windows(length), f"a long, b long, later {RANGES}"), "later-windows")
    _release(spark)
    if busy:
        exact = contexts.join(crowded, "gram", "left_semi").join(distinct, ["gram", "a", "b", "first"], "left_semi")
        windows = written(exact.mapInArrow(_windows(length), "a long, b long, first long, k long, window binary"), "busy-windows")
        least = windows.groupBy("window").agg(F.min("first").alias("least"))
        one = F.struct(F.col("k").alias("start"), (F.col("k") + 1).alias("end"))
        apart = written(windows.join(least, "window").where("first > least").groupBy("a", "b").agg(F.collect_set(one).alias("later")), "busy-later")
        later = together.union(apart)
        dropped(windows)
        _release(spark)
    dropped(several, contexts)
    settled = distinct.select("a", "b", "first").join(later, ["a", "b"], "left")
    shifted = F.transform("later", lambda r: F.struct((r["start"] + F.col("start")).alias("start"), (r["end"] + F.col("start")).alias("end")))
    whole = F.array(F.struct(F.col("start"), (F.col("start") + F.col("windows")).alias("end")))
    pieces = places.join(settled, ["a", "b"]).select(*_MARK, F.explode(F.when(F.col("id") > F.col("first"), whole).otherwise(shifted)).alias("range"))
    gone = copies.select(*_MARK, F.struct(F.lit(0).cast("long").alias("start"), (F.col("size") - length + 1).cast("long").alias("end")).alias("range"))
    out = written(pieces.union(gone).groupBy(*_MARK).agg(F.collect_set("range").alias("later")), "removed")
    dropped(groups, distinct, together)
    for each in (firsts, bits, shared, heads):
        each.unpersist()
    _release(spark)
    return out


def _cut(length: int):
    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                raw, spans, kept = texts.bytes.tobytes(), [], []
                for i, later in enumerate(part.column("later").to_pylist()):
                    text = raw[texts.bounds[i] : texts.bounds[i + 1]]
                    own: list[list[int]] = []
                    for start, end in sorted((r["start"], r["end"] + length - 1) for r in later or []):
                        if own and start <= own[-1][1]:
                            own[-1][1] = max(end, own[-1][1])
                        else:
                            own.append([start, end])
                    spans.append([{"start": a, "end": b} for a, b in own])
                    kept.append(b"".join(text[a:b] for a, b in zip([0, *(e for _, e in own)], [*(s for s, _ in own), len(text)], strict=True)) if own else text)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(texts.bounds)), pa.array(spans, _RANGES), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH) -> DataFrame:
    """(id long, n_bytes, spans, kept binary) of each row of docs.

    A byte of a text's UTF-8 goes if a string of `length` bytes covers it that also starts in a row with a smaller id;
    all is judged on the input. spans: the maximal removed runs, ends excluded; kept: what is left, which may cut a
    character. Null texts count as empty; texts under `length` bytes stay whole. Rows of one id don't count as smaller
    than each other, and a row without an id neither loses bytes nor takes any from others.
    """
    if length < 2 * GRAM:
        raise ValueError(f"a length of {length}, not {2 * GRAM} at least")
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return rows.join(later_windows(rows, length), _MARK, "left").select("id", "text", "later").mapInArrow(_cut(length), f"id long, n_bytes long, spans {RANGES}, kept binary")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's digest of remove_repeats(). Null texts are empty and lose nothing; nor does a row without an id;
    rows of one id lose nothing to each other."""
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")
    removed = F.reduce("spans", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
parts AS (SELECT row, doc_id, q, substr(x, 2 * q + 1, {2 * (256 + LENGTH - 1)}) AS x FROM (SELECT *, unnest(range(0, length(x) // 2 - {LENGTH - 1}, 256)) AS q FROM d WHERE doc_id IS NOT NULL)),
w AS (SELECT row, doc_id, q + i AS p, substr(x, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT *, unnest(range(0, length(x) // 2 - {LENGTH - 1})) AS i FROM parts)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
r AS (SELECT row, p, p - lag(p) OVER (PARTITION BY row ORDER BY p) > {LENGTH} AS gap FROM w JOIN m USING (s) WHERE least < doc_id),
g AS (SELECT row, p, count(*) FILTER (gap) OVER (PARTITION BY row ORDER BY p) AS span FROM r),
spans AS (SELECT row, min(p) AS a, max(p) + {LENGTH} AS b FROM g GROUP BY row, span),
sides AS (SELECT row, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT row, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM sides JOIN d USING (row) GROUP BY row)
SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN kept IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (row)
"""
