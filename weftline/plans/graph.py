"""Records as a graph of statements, and its validation against shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .claims import elements, shredded

#: Kinds of what a statement says, by the type of its value in a record.
KINDS = {"STRING": "text", "BOOLEAN": "boolean", "BIGINT": "number", "DOUBLE": "number", "DECIMAL": "number", "VOID": "nothing"}


def statements(records: DataFrame, slots: DataFrame) -> DataFrame:
    """(class, pid, predicate, value, kind) of records (class, pid, record JSON): a row for each entry of each field.

    slots: (class, slot, predicate, is_object). A field's predicate is its slot's; one that the class lacks is a
    predicate by its own name with the kind 'unmapped'. What an object slot names, and the `object` of a mapping, are
    of kind 'reference'; another mapping is 'structure', with its canonical JSON as value.
    """
    entries = elements(shredded(records, "record", "class", "pid"), "class", "pid").join(slots.withColumnRenamed("slot", "field"), ["class", "field"], "left")
    type_ = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    target = F.try_variant_get("value", "$.object", "string")
    kind = F.when(F.col("predicate").isNull(), "unmapped").when(target.isNotNull(), "reference").when(F.col("is_object") & (type_ == "STRING"), "reference")
    for name, what in KINDS.items():
        kind = kind.when(type_ == name, what)
    text = F.when(type_.isin(*KINDS), F.try_variant_get("value", "$", "string")).otherwise(F.to_json("value"))
    return entries.select("class", "pid", F.coalesce("predicate", "field").alias("predicate"), F.coalesce(target, text).alias("value"), kind.otherwise("structure").alias("kind"))


def shape_violations(found: DataFrame, subjects: DataFrame, shapes: DataFrame) -> DataFrame:
    """(pid, predicate, problem, value) of statements against shapes (class, predicate, least, most, kind, object_class).

    subjects: (class, pid) of all records. A predicate's statements are fewer than `least` or more than `most`; one is
    of another kind; one refers to no record, or to one of another class than object_class; its class has no shape for
    the predicate. Null limits, kinds and classes allow anything. Counts are aggregates, so no record's statements are
    gathered.
    """
    of_class = subjects.join(shapes, "class")
    counts = found.groupBy("pid", "predicate").agg(F.count(F.lit(1)).alias("n"))
    counted = of_class.join(counts, ["pid", "predicate"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    amount = F.when(F.col("n") < F.col("least"), "too few").when(F.col("n") > F.col("most"), "too many")
    number = counted.select("pid", "predicate", amount.alias("problem"), F.col("n").cast("string").alias("value"))
    shaped = found.withColumnRenamed("kind", "given").join(shapes.withColumn("shaped", F.lit(True)), ["class", "predicate"], "left")
    known = subjects.select(F.col("pid").alias("value"), F.col("class").alias("target_class"))
    linked = shaped.join(known, "value", "left")
    refers = F.col("object_class").isNotNull() & (F.col("given") == "reference")
    problem = F.when(F.col("shaped").isNull(), "no shape").when(F.col("kind") != F.col("given"), "another kind").when(refers & F.col("target_class").isNull(), "no record").when(refers & (F.col("target_class") != F.col("object_class")), "another class")
    content = linked.select("pid", "predicate", problem.alias("problem"), "value")
    return number.union(content).where("problem IS NOT NULL")
