"""Groups of rows that denote one entity: class, representative, unions, conflicts and collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_key(doi: Column, key: Column, prefix: str = "item:") -> Column:
    """'doi:' and the DOI, or the row's own key behind `prefix`."""
    return F.when(doi.isNotNull(), F.concat(F.lit("doi:"), doi)).otherwise(F.concat(F.lit(prefix), key))


def classes(rows: DataFrame, group: str, class_: str) -> tuple[DataFrame, DataFrame]:
    """(group, class) of the groups with exactly one class, and (group, classes) of the others. Null isn't a class."""
    found = rows.groupBy(group).agg(F.array_sort(F.collect_set(class_)).alias("classes"))
    return found.where(F.size("classes") == 1).select(group, F.col("classes")[0].alias(class_)), found.where(F.size("classes") != 1)


def representative(rows: DataFrame, group: str, columns: list[str], order: list[Column]) -> DataFrame:
    """The row of each group with the greatest order tuple, as (group, columns...). Partial maxima are combined."""
    best = rows.groupBy(group).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__best"))
    return best.select(group, *[F.col(f"__best.{c}").alias(c) for c in columns])


def union_of(rows: DataFrame, group: str, array: str, out: str) -> DataFrame:
    """(group, out): distinct elements of the arrays of a group's rows, ascending."""
    return rows.select(group, F.explode(array).alias("__x")).groupBy(group).agg(F.array_sort(F.collect_set("__x")).alias(out))


def field_conflicts(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, field, values) of the fields of which a group has several non-empty values, ascending."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(F.col(f).cast("string"), F.lit("")).alias("value")) for f in fields])
    values = rows.select(group, F.inline(pairs)).where("value IS NOT NULL")
    return values.groupBy(group, "field").agg(F.array_sort(F.collect_set("value")).alias("values")).where(F.size("values") > 1)


def collisions(rows: DataFrame, key: str, pid: str) -> DataFrame:
    """(key, pids) of non-empty keys with several pids, ascending."""
    found = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.array_sort(F.collect_set(pid)).alias("pids"))
    return found.where(F.size("pids") > 1)


def merged_first(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the rows that differ from it in the columns. Partial minima are combined, and the
    first rows are joined with the others, so that no key's rows are sorted or gathered."""
    first = rows.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__row"))
    kept = first.select("__key", F.struct(*[F.col(f"__row.{c}").alias(c) for c in columns]).alias("__first"))
    later = rows.join(kept, F.col(key) == F.col("__key")).where(~F.struct(*columns).eqNullSafe(F.col("__first"))).drop("__key", "__first")
    return first.select("__row.*"), later


def ordered_lists(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): values in order, as the rows stand."""
    gathered = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__value"))))
    return rows.groupBy(*keys).agg(F.transform(gathered, lambda x: x["__value"]).alias(out))


def content_digest(rows: DataFrame, name: str, payload: str) -> DataFrame:
    """sha256 over name NUL payload NUL of all rows in order of name, as one row `digest`. For files of a directory: few and small."""
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    gathered = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(payload).alias("p"))))
    return rows.agg(F.sha2(F.array_join(F.transform(gathered, lambda x: F.concat(x["n"], nul, x["p"], nul)), ""), 256).alias("digest"))
