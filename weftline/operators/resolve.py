"""Resolution of names, terms and references against controlled vocabularies. All joins are equi-joins on keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_index(labels: DataFrame, key: str, pid: str) -> DataFrame:
    """(key, pid) of the non-empty keys that name exactly one pid; ambiguous keys are left out."""
    grouped = labels.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min(pid).alias(pid), F.max(pid).alias("__last"))
    return grouped.where(F.col(pid) == F.col("__last")).drop("__last")


def ambiguous(labels: DataFrame, key: str, pid: str) -> DataFrame:
    """Keys with more than one pid, which is an error for reviewed aliases."""
    return labels.groupBy(key).agg(F.min(pid).alias("first"), F.max(pid).alias("last")).where("first <> last")


def named(df: DataFrame, keys: str, names: DataFrame, key: str, name: str, out: str, row_id: str, hold: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """df with `out`: the distinct names of an array of keys, ascending; a key without a name is '[unknown:key]'.

    row_id tells the arrays apart: a row's key, or the array itself where rows have no key of their own. What is
    found by row_id goes through `hold`: arrays that many rows share would otherwise deal those rows to a task each.
    """
    pairs = df.select(*dict.fromkeys((row_id, keys))).distinct().select(row_id, F.explode(keys).alias("__key")).join(names.select(F.col(key).alias("__key"), F.col(name).alias("__name")), "__key", "left")
    found = pairs.groupBy(row_id).agg(F.array_sort(F.collect_set(F.coalesce("__name", F.concat(F.lit("[unknown:"), F.col("__key"), F.lit("]"))))).alias(out))
    return df.join(hold(found), row_id, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def resolve_creators(creators: DataFrame, aliases: DataFrame, people: DataFrame, organizations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attributions and unresolved rows of creators (item, pos, key, single_field, role, name).

    An alias decides; else a single-field name may be an organization or a person (two different hits are none); else a
    person. The indexes are (key, pid). Attributions are (item, pos, pid, role), each (pid, role) of an item once, at its
    first position. Creators without a key are passed over.
    """
    hits = creators.where("key <> ''")
    for name, index in (("alias", aliases), ("person", people), ("organization", organizations)):
        hits = hits.join(index.select("key", F.col("pid").alias(name)), "key", "left")
    both = F.array_distinct(F.array_compact(F.array("organization", "person")))
    direct = F.when(F.col("single_field"), F.when(F.size(both) == 1, both[0])).otherwise(F.col("person"))
    hits = hits.withColumn("pid", F.coalesce("alias", direct))
    resolved = hits.where("pid IS NOT NULL").groupBy("item", "pid", "role").agg(F.min("pos").alias("pos")).select("item", "pos", "pid", "role")
    return resolved, hits.where("pid IS NULL").select("item", "pos", "role", "name")


def resolve_terms(terms: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (item, pid) of terms (item, key, name) by an index (key, pid), and the terms that it lacks."""
    hits = terms.where("key <> ''").join(index, "key", "left")
    return hits.where("pid IS NOT NULL").select("item", "pid").distinct(), hits.where("pid IS NULL").select("item", "name")


def attach(selected: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """selected, and those of the others whose key is one of its keys, with `attached`."""
    more = others.join(selected.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
    return selected.withColumn("attached", F.lit(False)).unionByName(more.withColumn("attached", F.lit(True)))


def token_index(records: DataFrame) -> DataFrame:
    """(token, class, pid) of records (class, pid, tokens), each once."""
    return records.select(F.explode("tokens").alias("token"), "class", "pid").distinct()


def match_records(source: DataFrame, target: DataFrame) -> DataFrame:
    """(class, pid, matched, how, candidates) of source against target, both (class, pid, tokens).

    Equal pids match ('pid'; 'class-conflict' if the classes differ); else one target of the class that shares a token
    ('identifier'), several ('ambiguous') or none ('unmatched').
    """
    exact = target.select("pid", F.col("class").alias("__class"))
    hits = token_index(source).join(token_index(target).withColumnRenamed("pid", "__hit"), ["token", "class"])
    hits = hits.groupBy("class", "pid").agg(F.array_sort(F.collect_set("__hit")).alias("candidates"))
    out = source.select("class", "pid").join(exact, "pid", "left").join(hits, ["class", "pid"], "left")
    found = F.coalesce("candidates", F.array().cast("array<string>"))
    how = F.when(F.col("__class") == F.col("class"), "pid").when(F.col("__class").isNotNull(), "class-conflict").when(F.size(found) == 1, "identifier").when(F.size(found) > 1, "ambiguous").otherwise("unmatched")
    out = out.withColumn("how", how)
    matched = F.when(F.col("how") == "pid", F.col("pid")).when(F.col("how") == "identifier", found[0])
    return out.select("class", "pid", matched.alias("matched"), "how", F.when(F.col("how").isin("identifier", "ambiguous"), found).otherwise(F.array().cast("array<string>")).alias("candidates"))


def match_outcomes(source: DataFrame, target: DataFrame) -> DataFrame:
    """match_records() with two candidates at most, the least and the greatest.

    A token's targets are counted by their ends before anything is joined, so no pair of records is made: one token that
    all records share costs each of them one row.
    """
    ends = token_index(target).groupBy("token", "class").agg(F.min("pid").alias("__least"), F.max("pid").alias("__most"))
    hits = token_index(source).join(ends, ["token", "class"]).groupBy("class", "pid").agg(F.min("__least").alias("__least"), F.max("__most").alias("__most"))
    exact = target.select("pid", F.col("class").alias("__class"))
    out = source.select("class", "pid").join(exact, "pid", "left").join(hits, ["class", "pid"], "left")
    one, none = F.col("__least") == F.col("__most"), F.col("__least").isNull()
    how = F.when(F.col("__class") == F.col("class"), "pid").when(F.col("__class").isNotNull(), "class-conflict").when(none, "unmatched").when(one, "identifier").otherwise("ambiguous")
    out = out.withColumn("how", how)
    matched = F.when(F.col("how") == "pid", F.col("pid")).when(F.col("how") == "identifier", F.col("__least"))
    both = F.when(F.col("how").isin("identifier", "ambiguous"), F.array_distinct(F.array("__least", "__most"))).otherwise(F.array().cast("array<string>"))
    return out.select("class", "pid", matched.alias("matched"), "how", both.alias("candidates"))


def dependencies(primary: DataFrame, pool: DataFrame, references: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the pool that primary's arrays of references name, and the references that the pool lacks."""
    wanted = primary.select(F.explode(references).alias(key)).where(F.col(key).isNotNull()).distinct()
    return pool.join(wanted, key, "left_semi"), wanted.join(pool.select(key), key, "left_anti")


def differing_overlap(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys on both sides whose columns (null-safe) aren't all equal."""
    other = right.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(other, F.col(key) == F.col("__key")).where(~same).select(key)


def retarget(edges: DataFrame, pid_map: DataFrame, target: str) -> DataFrame:
    """edges with targets in pid_map (old, new) replaced."""
    out = edges.join(pid_map.select(F.col("old").alias("__old"), F.col("new").alias("__new")), F.col(target) == F.col("__old"), "left")
    return out.withColumn(target, F.coalesce("__new", target)).drop("__old", "__new")
