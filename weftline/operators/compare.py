"""Comparison of record sets: keyed differences, containment, and what reviewers have decided."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import batched


def keyed_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change) with change 'added', 'removed', 'changed' or 'unchanged'; nulls equal nulls."""
    def side(df, mark):
        return df.select(F.col(key).alias(f"__key_{mark}"), F.struct(*columns).alias(f"__{mark}"))

    both = side(before, "b").join(side(after, "a"), F.col("__key_b") == F.col("__key_a"), "full_outer")
    change = F.when(F.col("__key_b").isNull(), "added").when(F.col("__key_a").isNull(), "removed").when(F.col("__b").eqNullSafe(F.col("__a")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("__key_a", "__key_b").alias(key), change.alias("change"))


def changed_only(df: DataFrame, proposed: Column, baseline: Column) -> DataFrame:
    """Rows whose proposal isn't the baseline; nulls equal nulls."""
    return df.where(~proposed.eqNullSafe(baseline))


def missing_fields(left: DataFrame, right: DataFrame, key: str, fields: str) -> DataFrame:
    """(key, path) where a flat record (map) of left isn't contained in right's: '/key/field', or '/key' without a record.
    A field that is null must stand there as null, as in containment()."""
    theirs = right.select(F.col(key).alias("__key"), F.col(fields).alias("__theirs"))
    both = left.join(theirs, F.col(key) == F.col("__key"), "left")
    wrong = F.filter(F.map_entries(fields), lambda e: ~(F.map_contains_key("__theirs", e["key"]) & F.col("__theirs")[e["key"]].eqNullSafe(e["value"])))
    paths = F.when(F.col("__key").isNull(), F.array(F.concat(F.lit("/"), key))).otherwise(F.transform(wrong, lambda e: F.concat(F.lit("/"), F.col(key), F.lit("/"), e["key"])))
    return both.select(key, F.explode(paths).alias("path"))


def _violations(reviewed, actual, path: str) -> list[str]:
    if isinstance(reviewed, dict) and isinstance(actual, dict):
        out = []
        for k, v in reviewed.items():
            out += _violations(v, actual[k], f"{path}/{k}") if k in actual else [f"{path}/{k}"]
        return out
    if isinstance(reviewed, list) and isinstance(actual, list):
        left = iter(enumerate(actual))
        # each entry takes what is left up to its match; without one it takes all
        return [f"{path}/{i}" for i, want in enumerate(reviewed) if not any(not _violations(want, other, "") for _, other in left)]
    return [] if reviewed == actual else [path or "/"]


def _contained(reviewed: str | None, actual: str | None, path: str) -> list[str]:
    if reviewed is None:
        return []
    return [path] if actual is None else _violations(json.loads(reviewed), json.loads(actual), path)


def containment(reviewed: Column, actual: Column, path: Column) -> Column:
    """Pointers under path where a JSON record isn't contained in another: mappings by field, lists as ordered
    subsequences (an entry without a match leaves nothing for those after it), scalars by equality, numbers by value.
    Names of fields stand in a pointer as they are. Without another record it is the path itself."""
    return batched(_contained, T.ArrayType(T.StringType()))(reviewed, actual, path)


def projection_violations(reviewed: DataFrame, canonical: DataFrame, key: str = "pid", record: str = "record") -> DataFrame:
    """(key, path) of containment of reviewed records (JSON text) in canonical ones, by key."""
    other = canonical.select(F.col(key).alias("__key"), F.col(record).alias("__record"))
    both = reviewed.join(other, F.col(key) == F.col("__key"), "left")
    return both.select(key, F.explode(containment(F.col(record), F.col("__record"), F.concat(F.lit("/"), F.col(key)))).alias("path"))


def all_contained(expected: Column, actual: Column, fields: list[str]) -> Column:
    """Whether each struct of an array is contained in some struct of another: its non-null fields are equal there."""
    def inside(e, a):
        out = F.lit(True)
        for f in fields:
            out = out & (e[f].isNull() | e[f].eqNullSafe(a[f]))
        return out

    return F.forall(expected, lambda e: F.exists(actual, lambda a: inside(e, a)))


def pending(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates (pid, claim_sha256, ...) without a decision on the same claim; accepted and rejected ones are both settled."""
    return candidates.join(decisions.select("pid", "claim_sha256").distinct(), ["pid", "claim_sha256"], "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame, target: str, key: str) -> DataFrame:
    """Edges whose target isn't a node."""
    return edges.join(nodes.select(F.col(key).alias("__key")), F.col(target) == F.col("__key"), "left_anti")
