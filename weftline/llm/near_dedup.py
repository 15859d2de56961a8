"""Operator 8: near-duplicates by SetSketch registers: banded, estimated by joint likelihood, verified on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Texts, bounded_batches, combined, documents, dropped, mixed, partitions, runs, slices, written

#: BANDS bands of ROWS registers; M (a prime) registers in all. Two sets of Jaccard similarity 0.8 share 12.6 bands on average and none with probability 4.6e-7; one that they share makes them a candidate.
ROWS, BANDS, M = 6, 48, 293
#: Base and rate of the registers' exponential scale: register = floor(1 - log_BASE(least x)), x scaled by 1 / RATE, within 16 bits.
BASE, RATE = 1.001, 20.0
#: Shingles of a block of strays and of a block of members, about; a longer text's set makes its block larger.
STRAY_BLOCK, MEMBER_BLOCK = 1 << 21, 1 << 23
#: Members around one centre are dealt to so many tasks at least, if there are more than SMALL_BLOCK shingles for each.
SPREAD, SMALL_BLOCK = 16, 1 << 15
#: Linked documents whose ids are broadcast to the texts at most; beyond that the texts are shuffled to the ids.
MOST_BROADCAST = 1_000_000
#: Standard deviations by which an estimate may fall short of the similarity before a pair is given up.
MARGIN = 5.0

_GAMMA = np.log1p(np.arange(M) / (M - np.arange(M)))  # where the j-th point of an element starts
_GAP = np.append(-np.expm1(_GAMMA[:-1] - _GAMMA[1:]), 1.0)


def shingles(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text as two 64-bit hashes (ascending by the first), and the bounds of the texts among them.

    Words are compared with A-Z lower-cased. A text with under k words is one shingle; one without words has none.
    """
    starts, ends, first = texts.words()
    words = np.diff(first)
    of_word = np.repeat(np.arange(texts.n), words)
    short = np.flatnonzero((words > 0) & (words < k))
    lanes = []
    for lane in (0, 1):
        hashes = texts.hashes(starts, ends, lower=True, lane=lane)
        grams = combined(hashes, k)
        inside = of_word[: len(grams)] == of_word[k - 1 :] if len(grams) else np.zeros(0, bool)
        whole = np.array([combined(hashes[first[i] : first[i + 1]], int(words[i]))[0] for i in short], np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
        lanes.append(np.concatenate([grams[inside], whole]))
    owner = np.concatenate([of_word[: len(inside)][inside], short])
    a, b = lanes
    order = np.argsort(a)
    order = order[np.argsort(owner[order], kind="stable")]
    a, b, owner = a[order], b[order], owner[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (a[1:] != a[:-1])
    if (b[1:] != b[:-1])[~fresh[1:]].any():  # one hash for two shingles: both lanes count
        order = np.lexsort((b, a, owner))
        a, b, owner = a[order], b[order], owner[order]
        fresh[1:] = (owner[1:] != owner[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[fresh], b[fresh], np.searchsorted(owner[fresh], np.arange(texts.n + 1))


def in_common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Shingles that two sets share, each given by its two hashes."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.searchsorted(b[0], a[0])
    hit = at < len(b[0])
    hit[hit] = b[0][at[hit]] == a[0][hit]
    if (a[1][hit] == b[1][at[hit]]).all():
        return int(hit.sum())
    return len(set(zip(a[0].tolist(), a[1].tolist(), strict=True)) & set(zip(b[0].tolist(), b[1].tolist(), strict=True)))


def sketch(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers (texts x M, uint16) of sets of hashes; sets can be merged by the registers' maximum.

    Each element has a point for each register, in ascending order and one to an interval of the exponential scale,
    dealt to the registers by a permutation of its own. Registers keep the least point. An element is done when its
    next point lies above all of its set's registers.
    """
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    least = np.full((n, M), np.inf)
    seed = mixed(values)
    spot = mixed(seed + np.uint64(1))
    at = (spot % np.uint64(M)).astype(np.int64)
    step = ((spot >> np.uint64(32)) % np.uint64(M - 1)).astype(np.int64) + 1
    for j in range(M):
        seed = mixed(seed + np.uint64(0x632BE59BD9B4E019))
        x = _GAMMA[j] - np.log1p(-_GAP[j] * ((seed >> np.uint64(11)).astype(np.float64) * 2.0**-53))
        np.minimum.at(least.reshape(-1), owner * M + at, x)
        if j + 1 < M:
            top = least.max(axis=1)
            alive = np.flatnonzero(_GAMMA[j + 1] < top[owner])
            if not len(alive):
                break
            owner, seed, step = owner[alive], seed[alive], step[alive]
            at = at[alive] + step
            at[at >= M] -= M
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(k, 0, 65535).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sets from their registers (pairs x M) and sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(32):
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def _sketcher(k: int):
    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                values, other, bounds = shingles(texts, k)
                size = np.diff(bounds)
                regs = sketch(values, bounds)
                sums = []
                for lane, salt in ((values, 3), (other, 5)):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(lane + np.uint64(salt)), dtype=np.uint64)])
                    sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                raw = pa.array([r.tobytes() for r in regs], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), pa.array(size.astype(np.int64)), *map(pa.array, sums), raw], ["id", "mark", "size", "h1", "h2", "regs"])

    return run


def _estimated(percent: int):
    least = percent / 100 - MARGIN * np.sqrt(percent / 100 * (1 - percent / 100) / M)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, M) for c in ("regs_a", "regs_b"))
                size_a, size_b = (batch.column(c).to_numpy().astype(np.float64) for c in ("size_a", "size_b"))
                near = (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)) & (estimate(a, b, size_a, size_b) >= least)
                keep = pa.array(np.flatnonzero(near))
                yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    return run


def _verified(k: int, percent: int):
    """Pairs (a, b, text_a, text_b) whose full shingle sets are similar enough."""

    def run(batches):
        for batch in batches:
            for part, _ in slices(batch, "text_a"):
                for pairs, texts_b in slices(part, "text_b"):
                    sets = [shingles(t, k) for t in (Texts(pairs.column("text_a")), texts_b)]
                    linked = []
                    for i in range(pairs.num_rows):
                        x, y = ((v[bounds[i] : bounds[i + 1]], w[bounds[i] : bounds[i + 1]]) for v, w, bounds in sets)
                        both = in_common(x, y)
                        linked.append(both > 0 and 100 * both >= percent * (len(x[0]) + len(y[0]) - both))
                    keep = pa.array(np.flatnonzero(linked))
                    yield pa.RecordBatch.from_arrays([pairs.column("a").take(keep), pairs.column("b").take(keep)], ["a", "b"])

    return run


def _links(strays, members, percent: int) -> list[tuple[int, int]]:
    """Links between two lists of (id, component, set): one for each stray and component at most."""
    if not strays or not members:
        return []
    sizes = [np.array([len(x[2][0]) for x in side]) for side in (strays, members)]
    values = np.concatenate([x[2][0] for x in strays])
    other = np.concatenate([x[2][1] for x in strays])
    owner = np.repeat(np.arange(len(strays)), sizes[0])
    order = np.argsort(values, kind="stable")
    values, other, owner = values[order], other[order], owner[order]
    found = []
    step = max(1, min(256, (1 << 22) // len(strays)))
    for start in range(0, len(members), step):
        some = members[start : start + step]
        theirs, their_other = (np.concatenate([x[2][lane] for x in some]) for lane in (0, 1))
        their_owner = np.repeat(np.arange(len(some)), sizes[1][start : start + step])
        low = np.searchsorted(values, theirs)
        count = np.searchsorted(values, theirs, "right") - low
        both = np.zeros(len(strays) * len(some), np.int64)
        # shared shingles in pieces of bounded size
        ends = np.cumsum(count)
        cut = 0
        while cut < len(count):
            stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + (1 << 21), "right")))
            at = runs(low[cut:stop], count[cut:stop])
            same = other[at] == np.repeat(their_other[cut:stop], count[cut:stop])
            key = owner[at] * len(some) + np.repeat(their_owner[cut:stop], count[cut:stop])
            both += np.bincount(key[same], minlength=len(both))
            cut = stop
        both = both.reshape(len(strays), len(some))
        union = sizes[0][:, None] + sizes[1][None, start : start + step] - both
        for i, j in zip(*np.nonzero((both > 0) & (100 * both >= percent * union)), strict=True):
            if strays[i][1] != some[j][1]:
                found.append((strays[i], some[j]))
    return [(s[0], m[0]) for s, m in {(s[0], m[1]): (s, m) for s, m in found}.values()]


BLOCK_KEYS = ["centre", "stray_block", "member_block"]


def _stray_links(k: int, percent: int):
    """Rows (centre, stray_block, member_block, member, id, component, text), the strays of a key before its members."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, strays, members, size = None, [], [], 0

        def flush():
            nonlocal size
            out = _links(strays, members, percent)
            members.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

        for batch in batches:
            for part, texts in slices(batch):
                values, other, bounds = shingles(texts, k)
                columns = [part.column(c).to_pylist() for c in (*BLOCK_KEYS, "member", "id", "component")]
                for i, (centre, sb, mb, is_member, id_, component) in enumerate(zip(*columns, strict=True)):
                    if (centre, sb, mb) != key:
                        yield flush()
                        strays.clear()
                        key = (centre, sb, mb)
                    own = (id_, component, tuple(x[bounds[i] : bounds[i + 1]].copy() for x in (values, other)))
                    (members if is_member else strays).append(own)
                    size += len(own[2][0]) * is_member
                    if size > 1 << 20:
                        yield flush()
        yield flush()

    return run


def _texts_of(texts: DataFrame, heads: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of some representatives: heads (id, mark) has the mark of the text to take for an id, ids has ids."""
    wanted = written(heads.join(ids.distinct(), "id", "left_semi").select("id", "mark"), "wanted")
    chosen = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    return written(texts.join(chosen, ["id", "mark"], "left_semi").dropDuplicates(["id"]).select("id", "text"), "texts")


def link_classes(texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets, as (id, size, class), and components of the linked classes, as (id, component).

    texts: id long, text. class is the class's least id, null for an empty set. A bucket's members are compared with its
    centre; members that don't come to be linked with it (strays) then with all others around that centre, in blocks.
    """
    spark = texts.sparkSession
    bounded_batches(spark)
    texts = texts.select("id", "text", F.xxhash64("text").alias("mark"))
    made = written(texts.mapInArrow(_sketcher(k), "id long, mark long, size long, h1 long, h2 long, regs binary").withColumn("row", F.monotonically_increasing_id()), "sketches")
    filled = made.where("size > 0")
    sets = written(filled.groupBy("h1", "h2", "size").agg(F.min("id").alias("class"), F.min_by(F.struct("row", "mark"), F.struct(F.col("id").isNull(), "id", "mark", "row")).alias("head")), "sets")
    # of an id with several texts one set stands for all
    heads = written(sets.where("class IS NOT NULL").groupBy(F.col("class").alias("id")).agg(F.min_by("head", F.struct("h1", "h2", "size")).alias("head")).select("id", "head.row", "head.mark"), "heads")
    one = written(filled.join(heads.select("row"), "row", "left_semi").select("id", "size", "regs"), "representatives")
    band = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])
    bands = one.select("id", F.explode(band).alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(bands.join(shared, "key"), "buckets")
    # the centre of a bucket: the member whose buckets are fullest, that is the text the others are copies of
    weight = buckets.groupBy("id").agg(F.sum("n").alias("weight"))
    star = buckets.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("centre"))
    star = written(star, "centres")
    around = written(buckets.join(star, "key").select("centre", "id").distinct(), "around")
    dropped(buckets, star)
    active = written(one.join(around.select("id").distinct(), "id", "left_semi"), "active")
    dropped(one)
    pairs = around.where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    of = {s: active.select(F.col("id").alias(s), F.col("size").alias(f"size_{s}"), F.col("regs").alias(f"regs_{s}")) for s in "ab"}
    near = written(pairs.join(of["a"], "a").join(of["b"], "b").mapInArrow(_estimated(percent), "a long, b long"), "near")
    ends = _texts_of(texts, heads, near.select(F.col("a").alias("id")).union(near.select("b")))
    text_of = {s: ends.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"}
    links = written(near.join(text_of["a"], "a").join(text_of["b"], "b").mapInArrow(_verified(k, percent), "a long, b long"), "links")
    dropped(near, ends)
    found = components(links)
    # strays against the other members around the same centre, block by block
    sized = around.join(active.select("id", "size"), "id")
    named = written(sized.join(found, "id", "left").select("centre", "id", "size", F.coalesce("component", "id").alias("component")), "named")
    dropped(active)
    centres = named.where("id = centre").select("centre", F.col("component").alias("home"))
    strays = written(named.join(centres, "centre").where("component <> home").select("centre", "id", "size", "component"), "strays")
    if strays.isEmpty():
        return made.join(sets, ["h1", "h2", "size"], "left").select("id", "size", "class"), found
    theirs = strays.groupBy("centre").agg(F.sum("size").alias("stray_size"), F.count(F.lit(1)).alias("strays"))
    blocks = theirs.join(named.groupBy("centre").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("members")), "centre")
    # as many tasks as the members' size is worth, dealt so that strays and members are copied least: the fewer strays
    # there are, the fewer blocks of strays each member goes to
    tasks = F.least(F.lit(SPREAD), F.ceil(F.col("size") / SMALL_BLOCK))
    balanced = F.greatest(F.lit(1), F.round(F.sqrt(tasks * F.col("strays") / F.col("members"))))
    blocks = blocks.withColumn("sb", F.greatest(F.ceil(F.col("stray_size") / STRAY_BLOCK), balanced).cast("int"))
    blocks = blocks.withColumn("mb", F.greatest(F.ceil(F.col("size") / MEMBER_BLOCK), F.ceil(tasks / F.col("sb"))).cast("int"))
    # a centre and one stray have been compared already
    blocks = written(blocks.where("members > 2").select("centre", "sb", "mb"), "blocks")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    as_stray = strays.join(blocks, "centre").select("centre", "id", "component", own("sb").alias("stray_block"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("member_block"), F.lit(False).alias("member"))
    as_member = named.join(blocks, "centre").select("centre", "id", "component", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("stray_block"), own("mb").alias("member_block"), F.lit(True).alias("member"))
    rows = written(as_stray.union(as_member), "block-rows")
    their = _texts_of(texts, heads, rows.select("id"))
    dealt = rows.join(their, "id").repartition(partitions(spark), *BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS, "member", "id")
    more = written(dealt.select(*BLOCK_KEYS, "member", "id", "component", "text").mapInArrow(_stray_links(k, percent), "a long, b long"), "stray-links")
    dropped(rows, their, named, strays, blocks, around)
    if not more.isEmpty():
        found = components(links.union(more))
    return made.join(sets, ["h1", "h2", "size"], "left").select("id", "size", "class"), found


def near_components(docs: DataFrame, id_col: str, text_col: str, k: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of each row of docs.

    Rows are linked if their sets of distinct k-word shingles have 100 * intersection >= percent * union. Null and
    wordless texts have no set: each is its own component. Rows with one id count as one document. A null id is never
    the least of a component; a row whose whole component has null ids gets a null one, and such rows aren't kept.
    """
    classes, found = link_classes(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), k, percent)
    out = classes.join(found.withColumnRenamed("id", "class"), "class", "left")
    component = F.coalesce("component", "class", "id")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by two-word shingles. Null and wordless texts are components of their own; rows of one id
    are one document, and a null id is never kept."""
    return near_components(documents(spark, sf_dir), "doc_id", "text", k=2)
