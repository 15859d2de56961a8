"""Operator 9: mix sources to target weights by a min-cost flow over groups of documents with the same memberships."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .shared import WORD, documents, dropped, partitions, written

#: Weights of the sources in code-point order, again and again; words of the mix by words there are; most uses of one document.
WEIGHTS, SHARE, COPIES = (3, 1, 2), 1.5, 2
SEED = 20240607
#: Bins of the seeded order of a group's documents, FINE of them to a coarse one: only the bin in which its quota ends is sorted.
BINS, FINE = 1 << 14, 1 << 7
#: Rows of a table by source or by membership pattern that are broadcast at most; beyond that Spark shuffles it.
MOST_BROADCAST = 100_000
#: Sources that are numbered in one task, about.
AT_ONCE = 50_000
#: Patterns and sources of a network, about: components of the memberships are put together up to so many.
NETWORK = 1000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> dict[str | None, float]:
    """Words wanted of each source: `share` of all sizes by weight, at most `copies` times a source's size each."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, names
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > copies * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(copies * sizes[s])
        left = max(0.0, left - sum(out[s] for s in over))
        open_ = [s for s in open_ if s not in over]
    return out


class _Flow:
    """A network to which capacity may be added; push() makes the flow from node 0 to node 1 maximal (Dinic's levels)."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, cap: int) -> int:
        """Number of the new edge; the next number is its way back."""
        for x, y, c in ((a, b, cap), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
        return len(self.to) - 2

    def _levels(self) -> list[int]:
        level, queue = [-1] * len(self.out), [0]
        level[0] = 0
        for a in queue:
            for e in self.out[a]:
                if self.cap[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def push(self) -> None:
        while (level := self._levels())[1] >= 0:
            tried, path, a = [0] * len(self.out), [], 0
            while True:
                if a == 1:
                    amount = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= amount
                        self.cap[e ^ 1] += amount
                    cut = next(i for i, e in enumerate(path) if not self.cap[e])
                    a = self.to[path[cut] ^ 1]
                    del path[cut:]
                elif tried[a] < len(self.out[a]):
                    e = self.out[a][tried[a]]
                    if self.cap[e] > 0 and level[self.to[e]] == level[a] + 1:
                        path.append(e)
                        a = self.to[e]
                    else:
                        tried[a] += 1
                elif path:
                    a = self.to[path.pop() ^ 1]
                    tried[a] += 1
                else:
                    break


def route(patterns: list[tuple[tuple, int]], quotas: dict, copies: int = COPIES) -> list[dict]:
    """Words that each pattern gives each of its sources: a maximal flow of least cost.

    patterns: (sources, words). The k-th use of a pattern's words costs k - 1 a word, so that nothing is repeated
    while fresh words of a member source are left. quotas: whole words by source. As costs lie on the patterns' own
    edges only, a path costs what its first edge costs: the flow is made maximal with the first uses alone, then with
    the second ones added, and so on.
    """
    ids = {s: 2 + i for i, s in enumerate(quotas)}
    net = _Flow(2 + len(ids) + len(patterns))
    for s, quota in quotas.items():
        net.edge(ids[s], 1, quota)
    own = [net.edge(0, 2 + len(ids) + i, 0) for i in range(len(patterns))]
    given = [{s: net.edge(2 + len(ids) + i, ids[s], copies * words) for s in members} for i, (members, words) in enumerate(patterns)]
    for _ in range(copies):
        for e, (_, words) in zip(own, patterns, strict=True):
            net.cap[e] += words
        net.push()
    return [{s: net.cap[e + 1] for s, e in edges.items() if net.cap[e + 1]} for edges in given]


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """(source, source_size, target) of all sources in sizes (source, size): targets() over a table.

    Sources are numbered by code point, null last, within ranges of names; the level at which targets stop rising is
    found by aggregates, a few numbers at a time. Only those come to the driver.
    """
    spark = sizes.sparkSession
    many = sizes.count()
    if many > AT_ONCE:
        sizes = sizes.repartitionByRange(max(2, min(partitions(spark), many // AT_ONCE)), F.col("source").asc_nulls_last())
    placed = written(sizes.withColumn("range", F.spark_partition_id() if many > AT_ONCE else F.lit(0)), "sources")
    found = sorted((r["range"], r["n"]) for r in placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets = [(found[i][0], sum(n for _, n in found[:i])) for i in range(len(found))]
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("offset")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    full = F.col("source_size") * F.lit(float(copies))
    placed_ = placed.join(F.broadcast(spark.createDataFrame(offsets, "range int, offset long")), "range")
    table = written(placed_.select("source", F.col("size").alias("source_size"), weight.alias("weight")), "weights")
    dropped(placed)
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, last = 0.0, -1.0
    while level > last * (1 + 1e-12):  # a source is full when its share at this level would be above what it can give
        over = F.lit(level) * F.col("weight") > full
        r = table.agg(F.sum(F.when(over, full)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        level, last = (max(0.0, total - (r["full"] or 0.0)) / r["open"] if r["open"] else level), level
    target = F.when(F.lit(level) * F.col("weight") > full, full).otherwise(F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def _networks(patterns: DataFrame, quotas: DataFrame) -> DataFrame:
    """Rows (part, members, words, source, quota): each pattern and each source with the component of the memberships
    that it lies in. A source that shares no document is a component with its one pattern."""
    key = lambda c: F.xxhash64(F.lit("source"), c.isNull(), c)
    named = patterns.where(F.size("members") > 0).withColumn("first", key(F.col("members")[0]))
    links = named.where(F.size("members") > 1).select(F.col("first").alias("a"), F.explode(F.transform("members", key)).alias("b"))
    joined = None if links.isEmpty() else components(links)
    part = lambda df, c: df.withColumn("part", F.col(c)) if joined is None else df.join(joined.withColumnRenamed("id", c), c, "left").withColumn("part", F.coalesce("component", c))
    own = part(named, "first").select("part", "members", "words", F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("quota"))
    ends = part(quotas.withColumn("key", key(F.col("source"))), "key").select("part", F.lit(None).cast("array<string>").alias("members"), F.lit(None).cast("long").alias("words"), "source", "quota")
    return own.union(ends)


def _routed(copies: int):
    """Flows of networks: rows of a component follow one another, a few small components make one network."""

    def flush(patterns, quotas):
        patterns.sort(key=str)
        flows = route(patterns, dict(sorted(quotas.items(), key=str)), copies)
        made = [[list(m) for m, _ in patterns], [w for _, w in patterns], [sum(f.values()) for f in flows]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.list_(pa.string()), pa.int64(), pa.int64()), strict=True)], ["members", "words", "given"])

    def min_cost_flow(batches):
        patterns, quotas, last = [], {}, None
        for batch in batches:
            for part, members, words, source, quota in zip(*(batch.column(c).to_pylist() for c in ("part", "members", "words", "source", "quota")), strict=True):
                if part != last and len(patterns) + len(quotas) >= NETWORK:
                    yield flush(patterns, quotas)
                    patterns, quotas = [], {}
                last = part
                if members is None:
                    quotas[source] = quota
                else:
                    patterns.append((tuple(members), words))
        if patterns:
            yield flush(patterns, quotas)

    return min_cost_flow


def _plan(patterns: DataFrame, wanted: DataFrame, copies: int) -> DataFrame:
    """(members, whole, rest): whole uses of all the pattern's documents, and words of one more, by the flow."""
    quotas = wanted.select("source", F.bround("target").cast("long").alias("quota"))
    rows = _networks(patterns, quotas).repartition(partitions(patterns.sparkSession), "part").sortWithinPartitions("part")
    given = rows.mapInArrow(_routed(copies), "members array<string>, words long, given long")
    whole = F.when(F.col("words") > 0, F.least(F.lit(copies), F.floor(F.col("given") / F.col("words")))).otherwise(0).cast("long")
    nothing = patterns.where(F.size("members") == 0).select("members", F.lit(0).cast("long").alias("whole"), F.lit(0).cast("long").alias("rest"))
    return given.select("members", whole.alias("whole"), (F.col("given") - whole * F.col("words")).alias("rest")).union(nothing)


def _crossed(bins: DataFrame, by: str) -> DataFrame:
    """Of rows (members, rest, `by`, words) in order of `by` the one in which the sum of words reaches rest, and what is left of rest before it."""
    upto = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("members").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))
    return upto.where((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("upto") >= F.col("rest"))).withColumn("rest", F.col("rest") - F.col("upto") + F.col("words")).drop("upto", "words")


def _mixed(docs: DataFrame, id_col: str, size: Column, members: Column, weights, share: float, copies: int, seed: int, whole_rows: bool) -> tuple[DataFrame, DataFrame]:
    """docs with __id, __members, __size and __taken, or these alone, and source_targets() of the mix.

    Whole rows are read again for the result, their sizes counted once more; otherwise a narrow table is read.
    """
    names = F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))
    content = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    sized = lambda df: df.withColumn("__size", F.coalesce(size.cast("long"), F.lit(0))).withColumn("__tie", content)
    rank = F.xxhash64(F.lit(seed), F.col("__id"))
    table = docs.select("*", F.col(f"`{id_col}`").alias("__id"), names.alias("__members")).withColumn("__rank", rank).withColumn("__bin", F.pmod("__rank", F.lit(BINS)).cast("int"))
    complete = sized
    if not whole_rows:
        table, complete = written(sized(table).select("__id", "__members", "__rank", "__bin", "__size", "__tie"), "mix-sizes"), lambda df: df
    bins = written(complete(table).groupBy(F.col("__members").alias("members"), F.col("__bin").alias("bin")).agg(F.sum("__size").alias("words")), "mix-bins")
    patterns = written(bins.groupBy("members").agg(F.sum("words").alias("words")), "mix-patterns")
    wanted = source_targets(patterns.select(F.explode("members").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("size")), weights, share, copies)
    plan = written(_plan(patterns, wanted, copies), "mix-plan")
    many = plan.count()
    coarse = bins.groupBy("members", F.floor(F.col("bin") / FINE).alias("coarse")).agg(F.sum("words").alias("words"))
    first = _crossed(coarse.join(_few(plan.select("members", "rest"), many), "members"), "coarse")
    inside = bins.withColumn("coarse", F.floor(F.col("bin") / FINE)).join(_few(first, many), ["members", "coarse"]).select("members", "rest", "bin", "words")
    last = _crossed(inside, "bin").select("members", F.col("bin").alias("__last_bin"), F.col("rest").alias("__last_words"))
    edge = written(plan.select("members", F.col("whole").alias("__whole")).join(_few(last, many), "members", "left").withColumnRenamed("members", "__members"), "mix-edge")
    dropped(bins, patterns, plan)
    found = table.join(_few(edge, many), "__members")
    inner = F.col("__bin") == F.col("__last_bin")
    outer = complete(found.where(~F.coalesce(inner, F.lit(False))))
    outer = outer.withColumn("__taken", F.col("__size") * (F.col("__whole") + F.coalesce((F.col("__bin") < F.col("__last_bin")).cast("long"), F.lit(0))))
    order = Window.partitionBy("__members").orderBy("__rank", "__id", "__size", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    crossing = complete(found.where(inner)).withColumn("__before", F.sum("__size").over(order) - F.col("__size"))
    crossing = crossing.withColumn("__taken", F.col("__size") * F.col("__whole") + F.greatest(F.lit(0), F.least("__size", F.col("__last_words") - F.col("__before"))))
    columns = [*([F.col(f"`{c}`") for c in docs.columns] if whole_rows else []), "__id", "__members", "__size", F.col("__taken").cast("long").alias("__taken")]
    return outer.select(*columns).unionByName(crossing.select(*columns)), wanted


def mixed_rows(docs: DataFrame, id_col: str, size: Column, members: Column, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: int = SEED) -> DataFrame:
    """docs with all columns, and __id, __members, __size and __taken as mix() gives them.

    What is taken of a row hangs on its content alone, so rows without an id or of one id are told apart by their other
    columns (maps don't count).
    """
    return _mixed(docs, id_col, size, members, weights, share, copies, seed, True)[0]


def mix(docs: DataFrame, id_col: str, size: Column, members: Column, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: int = SEED) -> DataFrame:
    """How many words the mix takes of each document, as (id_col, members, size, taken).

    members: array of source names (a null name is a source, last in order; a null array counts as empty, a repeated
    name once). Documents are grouped by their members; the flow gives each group its words; in a seeded order of the
    group's documents all are taken floor(words / size of the group) times and the first ones once more, the last of
    these in part. A document is never taken more than `copies` times. Size 0 and no members take 0. Rows with one id
    count as documents of their own. Reruns agree. Each component of sources that share documents is a network of its
    own, solved in one task, as large as its membership patterns are many; nothing comes to the driver.
    """
    rows, _ = _mixed(docs, id_col, size, members, weights, share, copies, seed, False)
    return rows.select(F.col("__id").alias(id_col), F.col("__members").alias("members"), F.col("__size").alias("size"), F.col("__taken").alias("taken"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each a member of its own source. Null texts have size 0 and, like wordless ones, give nothing."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    rows, wanted = _mixed(docs, "doc_id", n_words(F.col("text")), F.array("source"), WEIGHTS, SHARE, COPIES, SEED, False)
    mixed = rows.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__taken").alias("taken"), F.col("__members")[0].alias("source"))
    by_source = wanted.withColumnRenamed("source", "source_")
    out = mixed.join(_few(by_source, by_source.count()), F.col("source").eqNullSafe(F.col("source_")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")
