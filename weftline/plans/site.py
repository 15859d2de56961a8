"""Pages of a site: groups with members in a given order, and what their records refer to, embedded some levels deep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validate import repeated, require_none, violations
from .settle import settled


def pages(members: DataFrame, edges: DataFrame, known: DataFrame, depth: int = 2) -> DataFrame:
    """(page, place, pid, field, status) of all entries of pages; ascending by page and place they read from top to end.

    members: (page, pos, pid), where every position of a page is given once and holds one record; edges: (pid, field, n,
    target), what records refer to; known: (pid) of all records. An entry's place is its member's position followed by
    the rank of each reference among its record's (by field, then n), `depth` of them at most. status is 'embedded'; 'cycle' for
    a record that an entry above it is of, which isn't followed again; or 'missing' for a reference to no record. Each
    level is one join, so a page of any size is many tasks' work.
    """
    lacking = members.join(known.select("pid"), "pid", "left_anti")
    require_none([
        violations(repeated(members, "page", "pos"), "repeated position", F.col("page"), F.col("pos")),
        violations(repeated(members, "page", "pid"), "repeated member", F.col("page"), F.col("pid")),
        violations(lacking, "member without a record", F.col("page"), F.col("pid")),
    ])
    ordered = edges.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("field", "n", "target"))).alias("all"))
    ranked = settled(ordered.select("pid", F.posexplode("all").alias("rank", "e")).select(F.col("pid").alias("above"), F.col("rank").cast("long").alias("rank"), "e.field", "e.target"))
    there = known.select(F.col("pid").alias("target"), F.lit(True).alias("there"))
    ranked = settled(ranked.join(there, "target", "left"))
    level = members.select("page", F.array(F.col("pos").cast("long")).alias("place"), "pid", F.lit(None).cast("string").alias("field"), F.lit("embedded").alias("status"), F.array("pid").alias("line"))
    out = level
    for _ in range(depth):
        level = level.where("status = 'embedded'").join(ranked, F.col("pid") == F.col("above"))
        status = F.when(F.col("there").isNull(), "missing").when(F.array_contains("line", F.col("target")), "cycle").otherwise("embedded")
        level = settled(level.select("page", F.concat("place", F.array("rank")).alias("place"), F.col("target").alias("pid"), ranked["field"].alias("field"), status.alias("status"), F.concat("line", F.array("target")).alias("line")))
        out = out.union(level)
    return out.drop("line")
