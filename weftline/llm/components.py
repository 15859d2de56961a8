"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def _joined(edges: DataFrame, least: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges with each a's least id, and that table. It is written first: a plain table on both sides of the join lets
    Spark broadcast the least ids if they are few, and deal a busy id's edges to several tasks if they are not."""
    least = written(least, "least")
    return edges.join(least, "a"), least


def _large_star(edges: DataFrame) -> DataFrame:
    """Each id's larger neighbours are linked to the least of the id and its neighbours instead."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined, least = _joined(both, both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")))
    out = written(joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), "edges")
    dropped(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Each id and its smaller neighbours are linked to the least of these instead. Of an edge a is the larger end."""
    joined, least = _joined(edges, edges.groupBy("a").agg(F.min("b").alias("least")))
    ends = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    out = written(ends.where("a <> b").distinct(), "edges")
    dropped(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % (1 << 31))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (a, b), component being the smallest id reachable.

    Rounds of large and small stars, until every id is linked with its component's least id and nothing else; their
    number grows with the logarithm of the longest path. No key's links are gathered: each step is a least value by id
    and a join with it, which a busy id's rows go through in as many tasks as Spark deals them to. Every round's links
    are written, so a lost executor costs one round at most. Null ends link nothing. No links give no rows.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = _mark(edges)
    while True:
        large = _large_star(edges)
        small = _small_star(large)
        dropped(edges, large)
        edges, last, mark = small, mark, _mark(small)
        if mark == last:
            roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
