"""Ownership-aware merge: a source may add and take back its own assertions, and never those of others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_assertions(baseline: DataFrame, source: DataFrame, owner: str, keys: list[str], pids: DataFrame | None = None) -> DataFrame:
    """Assertions after one owner's claim, as (keys..., owner, pos, change).

    baseline: keys (pid, path, predicate, content), owner (null: human) and pos; source: keys and pos. Of the records in
    the claim (those of source, or pids if given, so that an empty claim takes back too): others' rows stay ('kept'); own
    rows stay if claimed again ('kept') and go otherwise ('removed'); a claimed row that nobody else has is 'added' with
    the owner; one that somebody has gains no owner. Records outside the claim stay. Repeated claims count once.
    """
    claimed = source.groupBy(*keys).agg(F.min("pos").alias("__pos")).withColumn("__claimed", F.lit(True))
    records = (pids if pids is not None else source).select(keys[0]).distinct().withColumn("__own", F.lit(True))
    held = baseline.join(records, keys[0], "left").join(claimed, keys, "full_outer")
    own = F.coalesce(F.col("owner") == owner, F.lit(False))
    new = F.col("pos").isNull()
    change = F.when(new, "added").when(own & F.coalesce("__own", F.lit(False)) & F.col("__claimed").isNull(), "removed").otherwise("kept")
    return held.select(*keys, F.when(new, F.lit(owner)).otherwise(F.col("owner")).alias("owner"), F.coalesce("pos", "__pos").alias("pos"), change.alias("change"))


def merged_lists(merged: DataFrame, keys: list[str], content: str, out: str) -> DataFrame:
    """(keys, out): contents after the merge; what stays in its order, then what is added in its order."""
    alive = merged.where("change <> 'removed'").withColumn("__late", (F.col("change") == "added").cast("int"))
    gathered = F.array_sort(F.collect_list(F.struct("__late", "pos", F.col(content).alias("__content"))))
    return alive.groupBy(*keys).agg(F.transform(gathered, lambda x: x["__content"]).alias(out))


def topical(baseline: Column, source: Column) -> Column:
    """A record's own field: what curators have entered stays, an absent one is filled from the source."""
    return F.coalesce(F.nullif(baseline, F.lit("")), F.nullif(source, F.lit("")))


def companion(merged: DataFrame, digest: Column, imported_from: Column) -> DataFrame:
    """Provenance rows (pid, path, assertion_sha256, owner, imported_from) of the owned assertions after a merge."""
    owned = merged.where("change <> 'removed' AND owner IS NOT NULL")
    return owned.select("pid", "path", digest.alias("assertion_sha256"), F.col("owner").alias("imported_by"), imported_from.alias("imported_from"))


def split_inline(assertions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assertions with provenance in place, as records (pid, path, pos, content, assertion_sha256) and a companion."""
    plain = assertions.select("pid", "path", "pos", "content", "assertion_sha256")
    notes = assertions.where("imported_by IS NOT NULL").select("pid", "path", "assertion_sha256", "imported_by", "imported_from").distinct()
    return plain, notes


def compact_inline(plain: DataFrame, notes: DataFrame) -> DataFrame:
    """The inverse of split_inline: provenance is joined by record, path and digest."""
    return plain.join(notes, ["pid", "path", "assertion_sha256"], "left").select("pid", "path", "pos", "content", "assertion_sha256", "imported_by", "imported_from")


def orphan_notes(plain: DataFrame, notes: DataFrame) -> DataFrame:
    """Companion rows that select no assertion, which is an error."""
    return notes.join(plain.select("pid", "path", "assertion_sha256").distinct(), ["pid", "path", "assertion_sha256"], "left_anti")


def omitted_after(previous: DataFrame, current: DataFrame, key: str, predicate: str, out: str) -> DataFrame:
    """(key, out): current predicates in first-seen order (pos), then previously owned ones that are gone, ascending."""
    now = current.groupBy(key, predicate).agg(F.min("pos").alias("__pos")).withColumn("__gone", F.lit(0))
    gone = previous.select(key, predicate).distinct().join(now, [key, predicate], "left_anti").select(key, predicate, F.lit(0).cast("long").alias("__pos"), F.lit(1).alias("__gone"))
    both = now.select(key, predicate, F.col("__pos").cast("long").alias("__pos"), "__gone").unionByName(gone)
    n = F.row_number().over(Window.partitionBy(key).orderBy("__gone", "__pos", predicate))
    ranked = both.withColumn("__n", n)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", predicate))), lambda x: x[predicate]).alias(out))
