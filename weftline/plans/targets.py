"""Source records of several classes matched with canonical ones, renamed, and retargeted to the names they get."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import records as R
from ..functions import text as X
from ..operators import resolve
from ..operators.validate import all_violations, repeated, require_none, violations
from .settle import settled

#: Fields whose values refer to records: single, lists, and relations whose `object` does.
SCALARS, LISTS, RELATIONS = ("at_location", "creator"), ("about", "part_of"), ("associated_with", "attributed_to", "generated_by", "part_of")


def _rewritten(value, pids: dict, name: str | None = None):
    """value of the field `name` with references replaced. Mappings in a list of references stay as they are."""
    if isinstance(value, str):
        return pids.get(value, value) if name in SCALARS else value
    if isinstance(value, list):
        if name in LISTS:
            return [pids.get(v, v) if isinstance(v, str) else v for v in value]
        return [_rewritten(v, pids, name) for v in value]
    if isinstance(value, dict):
        out = {k: _rewritten(v, pids, k) for k, v in value.items()}
        if name in RELATIONS and "object" in value:
            target = value["object"]
            out["object"] = pids.get(target, target) if isinstance(target, str) else target
        return out
    return value


def _referred(value, name: str | None = None) -> set[str]:
    """What _rewritten() would look up."""
    if isinstance(value, str):
        return {value} if name in SCALARS else set()
    if isinstance(value, list):
        return {v for v in value if isinstance(v, str)} if name in LISTS else {x for v in value for x in _referred(v, name)}
    if isinstance(value, dict):
        relation = name in RELATIONS
        found = {x for k, v in value.items() if not (relation and k == "object") for x in _referred(v, k)}
        return found | ({value["object"]} if relation and isinstance(value.get("object"), str) else set())
    return set()


def _roles(value) -> set[str]:
    if isinstance(value, dict):
        return {r for k, v in value.items() for r in ((set(v) if k == "roles" and isinstance(v, list) else set()) | _roles(v))}
    return {r for v in value for r in _roles(v)} if isinstance(value, list) else set()


def _texts(f) -> Callable[..., Column]:
    return R.batched(lambda text: sorted(f(json.loads(text))) if text else [], T.ArrayType(T.StringType()))


def references(record: Column) -> Column:
    """Distinct pids that a JSON record refers to by its relation fields, at any depth, ascending."""
    return _texts(_referred)(record)


def referenced_roles(record: Column) -> Column:
    """Distinct entries of all `roles` of a JSON record, at any depth, ascending."""
    return _texts(_roles)(record)


def rewritten(record: Column, pid_map: Column) -> Column:
    """A JSON record with references in the map (only this record's own ones) replaced, in relation fields only."""
    change = R.batched(lambda text, pids: R.canonical_text(_rewritten(json.loads(text), json.loads(pids) if pids else {})), T.StringType())
    return change(record, F.to_json(pid_map))


def _native(text: str, pid: str, minted: str, type_: str, source_pid: str, identifier_type: str, pids: str | None) -> str:
    record = {**json.loads(text), "pid": pid, "schema_type": type_}
    known = record.get("identifiers", [])
    if minted != source_pid and not any(isinstance(i, dict) and i.get("notation") == source_pid for i in known):
        record["identifiers"] = [*known, {"notation": source_pid, "schema_type": identifier_type}]
    return R.canonical_text(_rewritten(record, json.loads(pids) if pids else {}))


def with_roles(primary: DataFrame, pool: DataFrame, role_class: str) -> DataFrame:
    """primary (class, pid, record) but for its role records, and the pool's role records that primary refers to (from
    its own role records too). A pid in both must have the same class and record; a role that the pool lacks is an error."""
    roles = pool.where(F.col("class") == role_class)
    needed, lacking = resolve.dependencies(primary.withColumn("refs", referenced_roles(F.col("record"))), roles, "refs", "pid")
    differ = resolve.differing_overlap(primary.withColumn("record", R.canonical_json(F.col("record"))), pool.withColumn("record", R.canonical_json(F.col("record"))), "pid", ["class", "record"])
    require_none([violations(differ, "records differ between sources", F.col("pid"), F.lit("")), violations(lacking, "role without a record", F.col("pid"), F.lit(""))])
    return primary.where(F.col("class") != role_class).select("class", "pid", "record").unionByName(needed.select("class", "pid", "record"))


#: Name of a class whose records have a directory of their own.
CLASS_NAME = r"^[A-Z][A-Za-z0-9]*$"


def source_targets(source: DataFrame, canonical: DataFrame, own_prefix: str, minted: dict[str, str], type_prefix: str = "", identifier_type: str = "dlthings:Identifier") -> DataFrame:
    """(class, source_pid, pid, path, record, baseline) of source records (class, pid, record) against canonical ones
    (class, pid, rel_path, record).

    Records match by pid or by one shared identifier in the class; others get a new pid and path, which must be free.
    A record of a class whose pids are minted keeps its source pid as an identifier, if the minted one is another,
    matched or not. References to source records then follow them. Ambiguous matches, repeated targets, names of classes
    that aren't CLASS_NAME, a schema_type of another class and identifiers that are no list are errors.
    """
    def tokens(df):
        notes = F.from_json(F.get_json_object("record", "$.identifiers"), "array<struct<notation: string>>")
        return df.withColumn("tokens", X.identity_tokens(F.col("pid"), F.transform(notes, lambda i: i["notation"])))

    source, canonical = settled(source), settled(canonical)
    matched = resolve.match_outcomes(tokens(source), tokens(canonical))
    new_pid = R.minted_pid(F.col("class"), F.col("pid"), own_prefix, minted)
    named = source.join(matched.select("class", "pid", "matched", "how", "candidates"), ["class", "pid"]).withColumn("minted", new_pid).withColumn("target", F.coalesce("matched", "minted"))
    held = canonical.select(F.col("pid").alias("target"), F.col("rel_path").alias("held_path"), F.col("record").alias("baseline"))
    named = named.join(held, "target", "left")
    path = F.coalesce("held_path", F.concat("class", F.lit("/"), X.record_stem(F.col("target"), own_prefix), F.lit(".yaml")))
    named = settled(named.withColumn("path", path))
    fresh = named.where("matched IS NULL")
    type_ = F.concat(F.lit(type_prefix), "class")
    given, listed = F.get_json_object("record", "$.schema_type"), F.get_json_object("record", "$.identifiers")
    require_none([
        all_violations(
            source,
            (~F.col("class").rlike(CLASS_NAME), "class without a directory", F.col("pid"), F.col("class")),
            (given.isNotNull() & (given != type_), "type of another class", F.col("pid"), given),
            (listed.isNotNull() & ~listed.startswith("["), "identifiers aren't a list", F.col("pid"), F.lit("")),
        ),
        all_violations(
            named,
            (F.col("how") == "ambiguous", "ambiguous match", F.col("pid"), F.array_join("candidates", ", ")),
            (F.col("how") == "class-conflict", "pid of another class", F.col("pid"), F.col("class")),
            (F.col("path").isNull(), "no file name", F.col("pid"), F.col("target")),
            (F.col("matched").isNull() & F.col("baseline").isNotNull(), "new pid is taken", F.col("target"), F.col("pid")),
        ),
        violations(fresh.join(canonical.select(F.col("rel_path").alias("path")), "path", "left_semi"), "new path is taken", F.col("path"), F.col("pid")),
        violations(repeated(named, "target"), "repeated target pid", F.col("target"), F.col("rows")),
        violations(repeated(named, "path"), "repeated target path", F.col("path"), F.col("rows")),
    ])
    edges = named.select("pid", F.explode(references(F.col("record"))).alias("old"))
    moves = named.where("pid <> target").select(F.col("pid").alias("old"), F.col("target").alias("new"))
    maps = edges.join(moves, "old").groupBy("pid").agg(F.map_from_entries(F.collect_set(F.struct("old", "new"))).alias("pid_map"))
    native = R.batched(_native, T.StringType())(F.col("record"), F.col("target"), F.col("minted"), type_, F.col("pid"), F.lit(identifier_type), F.to_json("pid_map"))
    out = named.join(maps, "pid", "left")
    return out.select("class", F.col("pid").alias("source_pid"), F.col("target").alias("pid"), "path", native.alias("record"), F.when(F.col("matched").isNotNull(), F.col("baseline")).alias("baseline"))
