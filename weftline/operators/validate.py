"""Fail-closed checks: each gives the rows that break a rule; a stage collects them all before it makes any output."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """Input or policy breaks the contract; nothing has been written."""


def violations(df: DataFrame, code: str, pid: Column, detail: Column) -> DataFrame:
    """(code, pid, detail) of the rows of df."""
    return df.select(F.lit(code).alias("code"), pid.cast("string").alias("pid"), detail.cast("string").alias("detail"))


def all_violations(df: DataFrame, *rules: tuple[Column, str, Column, Column]) -> DataFrame:
    """violations() of several rules (condition, code, pid, detail) in one pass over df."""
    found = [F.when(when, F.struct(F.lit(code).alias("code"), pid.cast("string").alias("pid"), detail.cast("string").alias("detail"))) for when, code, pid, detail in rules]
    return df.select(F.inline(F.array_compact(F.array(*found))))


def require_none(checks: Iterable[DataFrame], shown: int = 20) -> None:
    """Raises IntegrityError with the first violations (ascending) of all checks together, if there are any."""
    found = reduce(DataFrame.unionByName, checks).orderBy("code", "pid", "detail").limit(shown + 1).collect()
    if found:
        lines = [f"{r.code}: {r.pid}: {r.detail}" for r in found[:shown]]
        raise IntegrityError("; ".join(lines) + ("; and more" if len(found) > shown else ""))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, with `rows`."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def missing(df: DataFrame, key: str) -> DataFrame:
    """Rows without a key."""
    return df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) == "")


def outside(df: DataFrame, column: str, domain: DataFrame, value: str) -> DataFrame:
    """Rows whose column (null counts) isn't a value of the domain."""
    return df.join(domain.select(F.col(value).alias("__value")), F.col(column) == F.col("__value"), "left_anti")


def judged(df: DataFrame, target: str, allowed: DataFrame, omitted: DataFrame, value: str) -> DataFrame:
    """df with `status` of the target under a policy: 'keep', 'omit', or 'unreviewed' (an error)."""
    policy = allowed.select(F.col(value).alias("__target"), F.lit("keep").alias("status")).unionByName(omitted.select(F.col(value).alias("__target"), F.lit("omit").alias("status")))
    out = df.join(policy, F.col(target) == F.col("__target"), "left")
    return out.drop("__target").withColumn("status", F.coalesce("status", F.lit("unreviewed")))


def unknown_fields(df: DataFrame, contract: Iterable[str]) -> list[str]:
    """Columns that the contract doesn't know."""
    return sorted(set(df.columns) - set(contract))


def unused(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Declared policy entries (same columns as used) that nothing has used."""
    return declared.distinct().join(used.distinct(), declared.columns, "left_anti")


def residue(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, as (key, side)."""
    both = left.select(key).distinct().withColumn("l", F.lit(True)).join(right.select(key).distinct().withColumn("r", F.lit(True)), key, "full_outer")
    return both.where("l IS NULL OR r IS NULL").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))
