"""Change candidates of source records of any class: shredded into assertions, merged by owner, put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import records as R
from ..functions import text as X
from ..operators import compare, merge
from ..operators.validate import all_violations, repeated, require_none, violations
from .settle import few, local_rows, settled

#: Fields that a source may give: those with a value of their own in a record, lists of objects, and the rest.
TOPICAL = (
    "about",
    "additional_names",
    "at_location",
    "broad_mappings",
    "close_mappings",
    "description",
    "display_label",
    "family_name",
    "formatted_name",
    "given_name",
    "name",
    "nickname",
    "part_of",
    "short_name",
    "title",
)
OBJECT_LISTS = ("associated_with", "attributed_to", "generated_by", "identifiers")
STRUCTURAL = ("pid", "schema_type")
#: Lists of a record whose entries are assertions: attributes and characterizations hold those of the topical fields too.
ASSERTED = ("associated_with", "attributed_to", "attributes", "characterized_by", "generated_by", "identifiers")
ATTRIBUTE_KEYS = ("predicate", "schema_type", "value")

_CONTENT = ["pid", "path", "content"]


def shredded(records: DataFrame, json: str, *keys: str) -> DataFrame:
    """(keys..., field, value variant) of the fields of JSON objects; a null text has none. No Python is run."""
    parsed = records.select(*keys, F.parse_json(json).alias("__v"))
    return parsed.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("__v").outer())).select(*keys, F.col("key").alias("field"), "value")


def elements(fields: DataFrame, *keys: str) -> DataFrame:
    """(keys..., field, n, value) of the entries of fields' lists; what is no list is its own only entry, null has none."""
    text = F.to_json("value")
    as_list = F.when(text.startswith("["), F.col("value")).when(text != "null", F.to_variant_object(F.array("value")))
    listed = fields.select(*keys, "field", as_list.alias("__list"))
    found = listed.lateralJoin(fields.sparkSession.tvf.variant_explode(F.col("__list").outer()))
    return found.select(*keys, "field", F.col("pos").cast("long").alias("n"), "value")


def filled(value: Column) -> Column:
    """Whether a variant says something: it isn't null, empty text or an empty list."""
    return F.coalesce(~F.to_json(value).isin("null", '""', "[]"), F.lit(False))


def put_together(fields: DataFrame, *keys: str) -> DataFrame:
    """(keys..., record): JSON objects of fields (keys..., field, value), in canonical form."""
    entries = F.map_from_entries(F.collect_list(F.struct("field", "value")))
    return fields.groupBy(*keys).agg(F.to_json(F.to_variant_object(entries)).alias("record"))


def source_record_uri(namespace: str, directory: Column, class_: Column, pid: Column) -> Column:
    """Where a source row stands, whatever its revision."""
    return F.concat(F.lit(f"{namespace}/blob/main/"), directory, F.lit("/"), X.percent_encoded(class_), F.lit(".json#record="), X.percent_encoded(pid))


def claimed_assertions(source: DataFrame, slots: DataFrame, attribute_type: str) -> DataFrame:
    """(pid, path, predicate, content, pos) that records (class, pid, record) assert, fields in ascending order.

    slots: (class, slot, predicate, is_object) of the topical fields. A value of a data field becomes an attribute, one
    of an object field a characterization; entries of object lists and attributes assert themselves.
    """
    fields = shredded(source, "record", "class", "pid").where(~F.col("field").isin(*STRUCTURAL))
    entries = elements(fields, "class", "pid").join(slots.withColumnRenamed("slot", "field"), ["class", "field"], "left")
    topical = F.col("field").isin(*TOPICAL)
    given = F.try_variant_get("value", "$.predicate", "string")
    as_data = F.to_variant_object(F.struct("predicate", F.lit(attribute_type).alias("schema_type"), "value"))
    as_object = F.to_variant_object(F.struct(F.col("value").alias("object"), "predicate"))
    content = F.when(topical & F.col("is_object"), F.to_json(as_object)).when(topical, F.to_json(as_data)).otherwise(F.to_json("value"))
    path = F.when(topical & F.col("is_object"), "characterized_by").when(topical, "attributes").otherwise(F.col("field"))
    rows = entries.select("pid", F.concat(F.lit("/"), path).alias("path"), F.when(topical, F.col("predicate")).otherwise(given).alias("predicate"), content.alias("content"), "field", "n")
    # attributes stand predicate by predicate, in the order of each one's first
    first = F.min("n").over(Window.partitionBy("pid", "field", "predicate"))
    place = F.row_number().over(Window.partitionBy("pid").orderBy("field", "first", "n", "content"))
    return rows.withColumn("first", first).withColumn("pos", place.cast("long")).select("pid", "path", "predicate", "content", "pos")


def _held_assertions(canonical: DataFrame, notes: DataFrame, predicates: DataFrame) -> DataFrame:
    """(pid, path, content, digest, owner, pos) of canonical records. An owner's characterization by a predicate that
    no field has can't be taken back by a source, so it counts as nobody's there."""
    rows = elements(shredded(canonical, "record", "pid").where(F.col("field").isin(*ASSERTED)), "pid")
    rows = rows.select("pid", F.concat(F.lit("/"), "field").alias("path"), F.try_variant_get("value", "$.predicate", "string").alias("predicate"), F.to_json("value").alias("content"), F.col("n").alias("pos"))
    rows = rows.withColumn("digest", R.digest(F.col("content"))).join(notes.select("pid", "path", F.col("assertion_sha256").alias("digest"), F.col("imported_by").alias("owner"), "imported_from"), ["pid", "path", "digest"], "left")
    return rows.join(predicates.withColumn("mapped", F.lit(True)), "predicate", "left").withColumn("mapped", F.coalesce("mapped", F.lit(False)) | (F.col("path") != "/characterized_by"))


def _lists(rows: DataFrame) -> DataFrame:
    """(pid, field, value): lists of the contents of rows (pid, path, late, pos, content) in order."""
    gathered = F.array_sort(F.collect_list(F.struct("late", "pos", "content")))
    as_list = F.to_variant_object(F.transform(gathered, lambda x: F.parse_json(x["content"])))
    return rows.groupBy("pid", "path").agg(as_list.alias("value")).select("pid", F.substring("path", 2, 1000).alias("field"), "value")


def _shape_checks(source: DataFrame, canonical: DataFrame, notes: DataFrame, slots: DataFrame, type_prefix: str, attribute_type: str, held: DataFrame) -> list[DataFrame]:
    """Violations of what records may hold."""
    fields = settled(shredded(source, "record", "class", "pid"))
    text, detail = F.to_json("value"), F.col("field")
    type_ = F.to_json(F.to_variant_object(F.array(F.concat(F.lit(type_prefix), "class"))))
    named = fields.join(slots.withColumnRenamed("slot", "field"), ["class", "field"], "left")
    entries = elements(fields.where(F.col("field").isin("attributes", *OBJECT_LISTS)), "class", "pid")
    entry = F.to_json("value")
    attributes = entries.where("field = 'attributes'")
    keys = F.json_object_keys(entry)
    right = (F.array_sort(keys) == F.array(*map(F.lit, ATTRIBUTE_KEYS))) & F.coalesce(F.schema_of_variant(F.try_variant_get("value", "$.value", "variant")) == "STRING", F.lit(False))
    right = right & F.coalesce(F.try_variant_get("value", "$.schema_type", "string") == attribute_type, F.lit(False)) & (F.coalesce(F.try_variant_get("value", "$.predicate", "string"), F.lit("")) != "")
    explicit = attributes.select("class", "pid", F.try_variant_get("value", "$.predicate", "string").alias("predicate"))
    own_type = shredded(canonical.join(source.select("pid", "class"), "pid"), "record", "class", "pid").where("field = 'schema_type'")
    given = fields.where("field = 'schema_type'")
    return [
        all_violations(
            fields,
            (~F.col("field").isin(*STRUCTURAL, *TOPICAL, *OBJECT_LISTS, "attributes"), "unsupported field", F.col("pid"), detail),
            (F.col("field").isin("attributes", *OBJECT_LISTS) & ~text.startswith("["), "field isn't a list of assertions", F.col("pid"), detail),
        ),
        violations(named.where(F.col("field").isin(*TOPICAL) & F.col("predicate").isNull()), "field without a predicate in its class", F.col("pid"), detail),
        violations(source.select("pid").join(given.where(F.concat(F.lit("["), text, F.lit("]")) == type_), "pid", "left_anti"), "type of another class", F.col("pid"), F.lit("")),
        violations(own_type.where(F.concat(F.lit("["), text, F.lit("]")) != type_), "canonical type of another class", F.col("pid"), text),
        all_violations(
            entries,
            (~entry.startswith("{"), "assertion isn't a mapping", F.col("pid"), detail),
            ((F.col("field") == "attributes") & entry.startswith("{") & ~F.coalesce(right, F.lit(False)), "attribute of another shape", F.col("pid"), entry),
        ),
        violations(explicit.join(slots.where(F.col("slot").isin(*TOPICAL)).select("class", "predicate").distinct(), ["class", "predicate"], "left_semi"), "attribute by a field's predicate", F.col("pid"), F.col("predicate")),
        violations(merge.orphan_notes(held.select("pid", "path", F.col("digest").alias("assertion_sha256")), notes.join(canonical.select("pid"), "pid", "left_semi")), "companion entry without an assertion", F.col("pid"), F.col("path")),
        violations(repeated(source, "pid"), "repeated target pid", F.col("pid"), F.col("rows")),
    ]


def candidates(targets: DataFrame, notes: DataFrame, decisions: DataFrame, agents: DataFrame, slots: DataFrame, owner: str, namespace: str, role_directory: str = "", type_prefix: str = "", attribute_type: str = "dlthings:AttributeSpecification") -> DataFrame:
    """What accepting source records would change, as (class, pid, path, operation, source_record_id, imported_from,
    record, companion, claim_sha256), for records of any class at once.

    targets: targets.source_targets() with the `directory` of each row; notes: companions (pid, path, assertion_sha256,
    imported_by, imported_from); agents: (pid, class), where the owner must be an Instrument; slots: (class, slot,
    predicate, is_object), as schema.induced_slots() gives them.

    All supported fields are gone through, so one that a source no longer gives takes back the owner's assertions of it
    and nothing else. Others' assertions, those of people and fields that are filled stay; absent fields are filled; an
    assertion that somebody has already gets no owner. Left out are records that stay as they are, claims that were
    decided on, and roles (rows of role_directory) whose canonical record is the source's own; another canonical role is
    an error. claim_sha256 digests what the source alone says, with pid and path, and not the baseline or provenance.
    """
    spark = targets.sparkSession
    targets = settled(targets.withColumn("imported_from", source_record_uri(namespace, F.col("directory"), F.col("class"), F.col("source_pid"))))
    canonical = targets.where("baseline IS NOT NULL").select("pid", F.col("baseline").alias("record"))
    notes = notes.join(targets.select("pid"), "pid", "left_semi")
    slots = few(slots)
    mapped = slots.where(F.col("slot").isin(*TOPICAL)).select("predicate").distinct()
    held = settled(_held_assertions(canonical, notes, mapped))
    agent = local_rows(spark, [(owner,)], "pid string").join(agents.where("class = 'Instrument'"), "pid", "left_anti")
    require_none([violations(agent, "owner isn't an instrument", F.col("pid"), F.lit("")), *_shape_checks(targets, canonical, notes, slots, type_prefix, attribute_type, held)])

    claimed = settled(claimed_assertions(targets.select("class", "pid", "record"), slots, attribute_type))
    known = held.groupBy(*_CONTENT).agg(F.max(F.when(F.col("mapped"), F.col("owner"))).alias("owner"), F.min("pos").alias("pos"), F.max("owner").alias("note_owner"), F.max("imported_from").alias("note_from"))
    merged = settled(merge.merge_assertions(known.select(*_CONTENT, "owner", "pos"), claimed, owner, _CONTENT, targets.select("pid")))
    alive = merged.where("change <> 'removed'")
    # what stands in a list twice stays there twice
    stays = held.join(merged.where("change = 'removed'").select(*_CONTENT), _CONTENT, "left_anti").select("pid", "path", F.lit(False).alias("late"), "pos", "content")
    lists = _lists(stays.union(merged.where("change = 'added'").select("pid", "path", F.lit(True), "pos", "content")))
    said = _lists(claimed.groupBy(*_CONTENT).agg(F.min("pos").alias("pos")).withColumn("late", F.lit(False)))

    topical = shredded(targets, "record", "pid").where(F.col("field").isin(*TOPICAL))
    base = shredded(canonical, "record", "pid")
    bare = targets.where("baseline IS NULL").select("pid", F.explode(F.array(F.struct(F.lit("pid").alias("field"), F.col("pid").alias("text")), F.struct(F.lit("schema_type").alias("field"), F.concat(F.lit(type_prefix), "class").alias("text")))).alias("f"))
    bare = bare.select("pid", "f.field", F.variant_get(F.to_variant_object(F.array("f.text")), "$[0]", "variant").alias("value"))
    asserted = held.select("pid", F.substring("path", 2, 1000).alias("field")).distinct()
    plain = base.join(asserted, ["pid", "field"], "left_anti").join(lists.select("pid", "field"), ["pid", "field"], "left_anti")
    own = plain.unionByName(bare).select("pid", "field", F.col("value").alias("own"))
    fields = own.join(topical.select("pid", "field", F.col("value").alias("new")), ["pid", "field"], "full_outer")
    fields = fields.select("pid", "field", F.when(filled(F.col("own")) | F.col("new").isNull(), F.col("own")).otherwise(F.col("new")).alias("value"))
    proposed = put_together(fields.unionByName(lists), "pid")
    schema_type = targets.select("pid", F.lit("schema_type").alias("field"), F.variant_get(F.to_variant_object(F.array(F.concat(F.lit(type_prefix), "class"))), "$[0]", "variant").alias("value"))
    claim = put_together(schema_type.unionByName(topical).unionByName(said), "pid").withColumnRenamed("record", "claim")

    origin = alive.join(known.select(*_CONTENT, "note_owner", "note_from"), _CONTENT, "left").join(targets.select("pid", "imported_from"), "pid")
    by = F.coalesce("owner", "note_owner")
    noted = origin.where(by.isNotNull()).select("pid", "path", R.digest(F.col("content")).alias("assertion_sha256"), by.alias("imported_by"), F.when((by == owner) & F.col("owner").isNotNull(), F.col("imported_from")).otherwise(F.col("note_from")).alias("imported_from"))
    shape = F.struct("path", "assertion_sha256", "imported_by", "imported_from")
    companion = noted.groupBy("pid").agg(F.array_sort(F.collect_set(shape)).alias("companion"))
    former = notes.groupBy("pid").agg(F.array_sort(F.collect_set(shape)).alias("former"))

    digest = R.digest(F.to_json(F.struct("claim", "path", "pid"))).alias("claim_sha256")
    plan = targets.withColumnRenamed("record", "source").join(proposed, "pid").join(claim, "pid").join(companion, "pid", "left").join(former, "pid", "left")
    canonical_form = lambda c: F.to_json(F.parse_json(c))
    same = F.col("record").eqNullSafe(canonical_form(F.col("baseline"))) & F.col("companion").eqNullSafe(F.col("former"))
    changed = settled(plan.where(~same).withColumn("role", (F.col("directory") == role_directory) & F.col("baseline").isNotNull()))
    other_role = changed.where(F.col("role") & (canonical_form(F.col("baseline")) != canonical_form(F.col("source"))))
    require_none([violations(other_role, "authoritative role differs from the canonical one", F.col("pid"), F.col("source_pid"))])
    open_ = compare.pending(changed.where("NOT role").select("*", digest), decisions)
    operation = F.when(F.col("baseline").isNull(), "add").otherwise("modify").alias("operation")
    return open_.select("class", "pid", "path", operation, F.concat("class", F.lit(":"), "source_pid").alias("source_record_id"), "imported_from", "record", "companion", "claim_sha256")
