"""Operator 13: a Merkle manifest of a dataset whose parents keep their hash states before each child."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import crc_bucket, documents, dropped, partitions, written

#: Children of a node, levels that one task folds at once, and characters of a digest.
FANOUT, LEVELS, _HEX = 16, 3, 64

PATH = "array<struct<before:string,after:string>>"
_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def encoded(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def climbed(nodes: list[bytes], most: int, block: int) -> list[list[bytes]]:
    """Levels above a block of neighbouring nodes: `most` of them, or in a tree's first block until one node is left."""
    levels = [nodes]
    while len(levels[-1]) > 1 if block == 0 else len(levels) <= most:
        last = levels[-1]
        levels.append([hashlib.sha256(b"".join(last[i : i + FANOUT])).hexdigest().encode() for i in range(0, len(last), FANOUT)])
    return levels


class Midstates:
    """Levels of a block; for each node the state of its parent's hash just before the node's slot."""

    def __init__(self, levels: list[list[bytes]], above: list[tuple[bytes, bytes]]):
        self.joined = [b"".join(level) for level in levels[:-1]]
        self.states = []
        for level in levels[:-1]:
            row = []
            for i, child in enumerate(level):
                if i % FANOUT == 0:
                    state = hashlib.sha256()
                row.append(state.copy())
                state.update(child)
            self.states.append(row)
        self.above = [(hashlib.sha256(before), before, after) for before, after in above]

    def siblings(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        """(before, after) of node i of the lowest level and its ancestors, up to the root."""
        for joined in self.joined:
            first, at = i // FANOUT * FANOUT * _HEX, i * _HEX
            yield joined[first:at], joined[at + _HEX : first + FANOUT * _HEX]
            i //= FANOUT
        for _, before, after in self.above:
            yield before, after

    def folded(self, i: int, node: bytes) -> bytes:
        """The root with `node` in place of node i: each parent's kept state goes on with it and what stands right of it."""
        for states, joined in zip(self.states, self.joined, strict=True):
            state = states[i].copy()
            state.update(node)
            state.update(joined[(i + 1) * _HEX : (i // FANOUT + 1) * FANOUT * _HEX])
            node = state.hexdigest().encode()
            i //= FANOUT
        for kept, _, after in self.above:
            state = kept.copy()
            state.update(node)
            state.update(after)
            node = state.hexdigest().encode()
        return node


def _blocks(batches, columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((tree, block), rows) of rows sorted by tree and block, which `columns` begin with."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[:2] != key:
                if rows:
                    yield key, rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield key, rows


def _climb(most: int):
    names, types = ["tree", "pos", "node"], [pa.string(), pa.int64(), pa.string()]

    def run(batches):
        out = []
        for (tree, block), rows in _blocks(batches, ["tree", "block", "node"]):
            out.append((tree, block, climbed([r[2].encode() for r in rows], most, block)[-1][0].decode()))
            if len(out) == 4096:
                yield _batch(out, names, types)
                out = []
        if out:
            yield _batch(out, names, types)

    return run


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _known(rows: list[tuple], most: int, block: int) -> tuple[list[tuple], Midstates]:
    """A block's own rows and its states; its first row, at -1, brings the path above the block."""
    path = [(p["before"].encode(), p["after"].encode()) for p in rows[0][4]]
    return rows[1:], Midstates(climbed([r[3].encode() for r in rows[1:]], most, block), path)


def _paths(most: int):
    def run(batches):
        for (tree, block), rows in _blocks(batches, ["tree", "block", "pos", "node", "path"]):
            rows, states = _known(rows, most, block)
            for start in range(0, len(rows), 256):
                some = enumerate(rows[start : start + 256], start)
                out = [(tree, r[2], r[3], [{"before": a.decode(), "after": b.decode()} for a, b in states.siblings(i)]) for i, r in some]
                yield _batch(out, ["tree", "pos", "node", "path"], [pa.string(), pa.int64(), pa.string(), _PATH])

    return run


def _proofs(most: int):
    def run(batches):
        for (_, block), rows in _blocks(batches, ["tree", "block", "pos", "node", "path", "id", "other", "top"]):
            top, out = rows[0][7], []
            rows, states = _known(rows, most, block)
            for i, r in enumerate(rows):
                proof = hashlib.sha256()
                for before, after in states.siblings(i):
                    proof.update(before)
                    proof.update(after)
                out.append((r[5], r[3], top, proof.hexdigest(), states.folded(i, r[6].encode()).decode()))
            yield _batch(out, ["id", "leaf", "subroot", "proof_sha256", "folded_root"], [pa.int64(), *[pa.string()] * 4])

    return run


def _places(batches):
    """Rows in order with their partition, place among the partition's rows of their tree, and whether theirs is its first tree."""
    part, tree, place, opening = TaskContext.get().partitionId(), None, -1, None
    for batch in batches:
        places, opens = [], []
        for t in batch.column("tree").to_pylist():
            if opening is None or t != tree:
                tree, place, opening = t, -1, opening is None
            place += 1
            places.append(place)
            opens.append(opening)
        new = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64()), pa.array(opens, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "part", "place", "opening"])


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree, ...) with pos, their place in the tree by `order`, nulls first; a table.

    Rows are dealt by ranges, a busy tree over several of them. A tree goes on only at a range's start, so that what
    the ranges are told of each other is a number each. Rows alike in `order` are dealt by a number of their own.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)] + [F.col("salt")]
    ranged = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).drop("salt")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "part int, place long, opening boolean"])
    placed = written(ranged.mapInArrow(_places, schema), "merkle-places")
    counts = placed.groupBy("part", "tree", "opening").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", before).where("opening AND before > 0").select("part", "before")
    pos = F.col("place") + F.when(F.col("opening"), F.coalesce("before", F.lit(0))).otherwise(0)
    out = written(placed.join(F.broadcast(offsets), "part", "left").select(*rows.columns, pos.alias("pos")), "merkle-numbered")
    dropped(placed)
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "pos")


def _block(most: int) -> Column:
    return F.expr(f"pos div {FANOUT**most}").alias("block")


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Tables (tree, pos, node) of every `most`-th level above numbered nodes; the last has one node for each tree."""
    out, last = [], nodes
    while not out or not last.where("pos > 0").isEmpty():
        last = written(_dealt(last.select("tree", _block(most), "pos", "node")).mapInArrow(_climb(most), "tree string, pos long, node string"), "merkle-level")
        out.append(last)
    return out


def _down(levels: list[DataFrame], tops: DataFrame, most: int) -> DataFrame:
    """(tree, pos, node, path) of the lowest of the levels: siblings up to the root. tops: the same of the last level."""
    found = tops
    for below in levels[-2::-1]:
        # the path above a block stands before the block's nodes
        heads = found.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "node", "path")
        rows = below.select("tree", _block(most), "pos", "node", F.lit(None).cast(PATH).alias("path"))
        found = written(_dealt(heads.unionByName(rows)).mapInArrow(_paths(most), f"tree string, pos long, node string, path {PATH}"), "merkle-paths")
    return found


def manifest(leaves: DataFrame, most: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root) of leaves (tree string, id long, leaf, other).

    In each tree leaves ascend by (id, leaf), a null id first; every FANOUT neighbours become the SHA-256 of their hex
    digests until one is left, the tree's subroot. Subroots in order of their tree's name, a null one first, become the
    root likewise. proof_sha256 hashes a leaf's siblings from below to the root; folded_root is what the root would be
    with `other` in place of the leaf. One leaf alone is its own subroot and root, and no siblings hash as no bytes.
    Rows alike get the same results. No leaves give no rows.

    Blocks of FANOUT ** most neighbours are folded by a task each, their results in blocks again, and so on; the paths
    come back down the same way, one row to a block. The digest of the whole is all that the driver sees.
    """
    numbered = _numbered(leaves, "id", "leaf")
    levels = _levels(numbered.select("tree", "pos", F.col("leaf").alias("node")), most)
    # the trees' tops are the leaves of one more tree
    tops = _numbered(levels[-1].select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("name"), "node"), "name")
    upper = _levels(tops.select("tree", "pos", "node"), most)
    root = upper[-1].first()
    root = root["node"] if root else None
    nothing = F.array().cast(PATH)
    highest = _down([tops.select("tree", "pos", "node"), *upper], upper[-1].withColumn("path", nothing), most)
    named = tops.select("pos", "name").join(highest.select("pos", "path"), "pos")
    start = written(named.join(levels[-1], F.col("name").eqNullSafe(F.col("tree"))).select("tree", levels[-1]["pos"].alias("pos"), "node", "path"), "merkle-tops")
    low = _down(levels, start, most)
    heads = low.join(levels[-1].select(F.col("tree").alias("name"), F.col("node").alias("top")), F.col("tree").eqNullSafe(F.col("name")))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("other", "string"))]
    heads = heads.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "node", "path", *none, "top")
    rows = numbered.select("tree", _block(most), "pos", F.col("leaf").alias("node"), F.lit(None).cast(PATH).alias("path"), "id", "other", F.lit(None).cast("string").alias("top"))
    out = _dealt(heads.unionByName(rows)).mapInArrow(_proofs(most), "id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select("id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row a leaf of its source's tree. The leaf put in to verify has the text with A-Z in lower case where 5
    divides the id's crc32; a null text stays null, and a row without an id is left as it is."""
    docs = documents(spark, sf_dir)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.when(crc_bucket(F.col("doc_id"), 5) == 0, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    own, other = (leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars")), t) for t in (F.col("text"), text))
    leaves = written(docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("id"), own.alias("leaf"), other.alias("other")), "merkle-leaves")
    out = manifest(leaves)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_levels(name: str, start: str) -> str:
    return f"""{name} AS ({start} UNION ALL
  SELECT level + 1, tree, pos // {FANOUT}, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS nodes FROM {name}) WHERE nodes > 1 GROUP BY level, tree, pos // {FANOUT}),
{name}_top AS (SELECT tree, max(level) AS level, arg_max(node, level) AS node FROM {name} GROUP BY tree),
{name}_sides AS (SELECT a.level, a.tree, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM {name} a JOIN {name} b ON a.level = b.level AND a.tree IS NOT DISTINCT FROM b.tree AND a.pos // {FANOUT} = b.pos // {FANOUT}
  JOIN {name}_top t ON t.tree IS NOT DISTINCT FROM a.tree AND a.level < t.level GROUP BY a.level, a.tree, a.pos)"""


def _sql_walk(name: str, over: str, start: str) -> str:
    return f"""{name} AS ({start} UNION ALL
  SELECT w.row, s.level + 1, w.tree, w.pos // {FANOUT}, sha256(s.before || w.node || s.after), w.proof || s.before || s.after
  FROM {name} w JOIN {over}_sides s ON s.level = w.level AND s.tree IS NOT DISTINCT FROM w.tree AND s.pos = w.pos)"""


_PARTS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y)
    WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""
SQL = f"""
WITH RECURSIVE lowered AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM documents),
hashed AS (SELECT doc_id, source AS tree, sha256({_PARTS} || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256({_PARTS} || coalesce(strlen(changed) || ':' || changed, '-')) AS other FROM lowered),
leaves AS (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
{_sql_levels("t", "SELECT 0 AS level, tree, pos, leaf AS node FROM leaves")},
{_sql_levels("u", "SELECT 0 AS level, '' AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, node FROM t_top")},
places AS (SELECT tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos FROM t_top),
{_sql_walk("w", "t", "SELECT row, 0 AS level, tree, pos, other AS node, '' AS proof FROM leaves")},
ends AS (SELECT w.* FROM w JOIN t_top ON w.tree IS NOT DISTINCT FROM t_top.tree AND w.level = t_top.level),
{_sql_walk("v", "u", "SELECT e.row, 0 AS level, '' AS tree, p.pos, e.node, e.proof FROM ends e JOIN places p ON e.tree IS NOT DISTINCT FROM p.tree")}
SELECT l.doc_id, l.leaf, t_top.node AS subroot, u_top.node AS root, sha256(v.proof) AS proof_sha256, v.node AS folded_root, v.node = u_top.node AS verified
FROM leaves l JOIN t_top ON l.tree IS NOT DISTINCT FROM t_top.tree CROSS JOIN u_top JOIN v ON v.row = l.row AND v.level = u_top.level
"""
