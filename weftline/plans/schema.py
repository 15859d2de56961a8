"""A view of a class schema: what slots a class has, after inheritance, mixins and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.validate import IntegrityError, require_none, repeated, violations
from .settle import few, settled

#: What a slot says of itself and a class may say otherwise.
FACETS = ("slot_uri", "range", "multivalued", "required")
#: Levels that a hierarchy may have: a power of two.
MOST = 64


def _above(classes: DataFrame) -> DataFrame:
    """(class, turn, up) of classes: what stands right above, mixins in their order before the parent."""
    mixed = classes.select("class", F.posexplode("mixins").alias("turn", "up")).select("class", "turn", "up")
    return mixed.union(classes.where("is_a IS NOT NULL").select("class", F.lit(1 << 20).alias("turn"), F.col("is_a").alias("up")))


def ancestors(classes: DataFrame, most: int = MOST) -> DataFrame:
    """(class, ancestor, distance, nearness) of classes (class, is_a, mixins), each its own nearest ancestor.

    Nearer ones come first; of equally near ones a mixin's line before the parent's, mixins in their order: nearness
    sorts them. An ancestor reached by several lines counts by the nearest. Rounds follow the hierarchy's depth; a
    cycle, or more than `most` levels, is an error.
    """
    above = settled(_above(classes))
    found = settled(classes.select("class", F.col("class").alias("ancestor"), F.array().cast("array<int>").alias("line")))
    levels, latest, depth = [found], found, 0
    while True:
        up = latest.join(above.withColumnRenamed("class", "ancestor"), "ancestor").select("class", F.col("up").alias("ancestor"), F.concat("line", F.array("turn")).alias("line"))
        # lines that meet go on as one
        latest = settled(up.groupBy("class", "ancestor").agg(F.min("line").alias("line")))
        depth += 1
        if latest.isEmpty():
            break
        loop = latest.where("class = ancestor").first()
        if loop or depth > most:
            raise IntegrityError(f"class is its own ancestor: {loop['class']}" if loop else f"more than {most} levels of classes")
        levels.append(latest)
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.union(level)
    nearest = rows.groupBy("class", "ancestor").agg(F.min(F.struct(F.size("line").alias("distance"), "line")).alias("nearness"))
    return nearest.select("class", "ancestor", F.col("nearness.distance").alias("distance"), "nearness")


def jumps(classes: DataFrame) -> list[DataFrame]:
    """(class, ancestor, rank) of the ancestors by lines of just 1, 2, 4, 8... levels, as far as there are any; rank sorts
    those of a class by the least line to each, as in ancestors(). Errors are those of ancestors()."""
    found, levels = [settled(_above(classes).groupBy("class", F.col("up").alias("ancestor")).agg(F.min("turn").alias("rank")))], 1
    while True:
        latest = found[-1]
        rows, loop = latest.agg(F.count(F.lit(1)), F.min(F.when(F.col("class") == F.col("ancestor"), F.col("class")))).first()
        if loop is not None:
            raise IntegrityError(f"class is its own ancestor: {loop}")
        if not rows:
            return found[:-1]
        upper = (found[0] if levels == MOST else latest).select(F.col("class").alias("ancestor"), F.col("ancestor").alias("upper"), F.col("rank").alias("then"))
        longer = latest.join(upper, "ancestor")
        if levels == MOST:
            if not longer.isEmpty():
                # names the class of a loop, if it is one
                ancestors(classes)
            return found
        # lines that meet go on as one
        longer = longer.repartition("class").groupBy("class", F.col("upper").alias("ancestor")).agg(F.min(F.struct("rank", "then")).alias("line"))
        found.append(settled(longer.select("class", "ancestor", F.row_number().over(Window.partitionBy("class").orderBy("line")).alias("rank"))))
        levels *= 2


def induced_slots(classes: DataFrame, slots: DataFrame, holds: DataFrame, usage: DataFrame, prefix: str) -> DataFrame:
    """(class, slot, predicate, range, multivalued, required, is_object, declared_by) of all slots that classes have.

    classes: (class, is_a, mixins); slots: (slot, slot_uri, range, multivalued, required), the general definitions;
    holds: (class, slot) that a class declares; usage: (class, slot, and the same facets), what a class says otherwise,
    null where it says nothing. A class has its ancestors' slots; each facet is the nearest ancestor's that says
    something, else the slot's own. predicate is slot_uri, or prefix and the slot's name; is_object tells that the range
    is a class; declared_by is the nearest class that declares the slot. Names that nothing defines are errors.
    """
    names = classes.select("class")
    known = lambda df, c, what: violations(df.where(F.col(c).isNotNull()).join(names.select(F.col("class").alias(c)), c, "left_anti"), what, F.col(c), F.lit(""))
    lacking = lambda df, what: violations(df.join(slots.select("slot"), "slot", "left_anti"), what, F.col("slot"), F.col("class"))
    require_none([
        violations(repeated(classes, "class"), "repeated class", F.col("class"), F.col("rows")),
        violations(repeated(slots, "slot"), "repeated slot", F.col("slot"), F.col("rows")),
        violations(repeated(usage, "class", "slot"), "repeated usage", F.col("class"), F.col("slot")),
        known(classes, "is_a", "unknown parent"),
        known(classes.select(F.explode("mixins").alias("mixin")), "mixin", "unknown mixin"),
        known(holds.select("class"), "class", "slot of an unknown class"),
        known(usage.select("class"), "class", "usage in an unknown class"),
        lacking(holds, "unknown slot"),
        lacking(usage, "usage of an unknown slot"),
    ])
    is_class = names.select(F.col("class").alias("range"), F.lit(True).alias("is_object"))
    own = {f: F.when(F.col(f).isNotNull(), F.struct(F.lit(0).alias("distance"), F.lit(0).alias("rank"), (F.struct("range", "is_object") if f == "range" else F.col(f)).alias("value"))).alias(f) for f in FACETS}
    said = usage.join(is_class, "range", "left").select("class", "slot", *own.values())
    declared = F.struct(F.lit(0).alias("distance"), F.lit(0).alias("rank"), F.col("class").alias("value")).alias("declared")
    near = said.unionByName(holds.select("class", "slot", declared), allowMissingColumns=True)
    parts = ["declared", *FACETS]
    near = near.repartition("class").groupBy("class", "slot").agg(*[F.min(f).alias(f) for f in parts])
    # what is known within 1, 2, 4... levels, and from as many levels further up: nearer ones come first, then ranks
    for k, step in enumerate(jumps(classes)):
        step = step.select("class", "ancestor", "rank", F.lit(1 << k).alias("step"))
        step = step.union(names.select("class", F.col("class").alias("ancestor"), F.lit(0), F.lit(0)))
        near = step.join(near.withColumnRenamed("class", "ancestor"), "ancestor")
        further = [F.when(F.col(f).isNotNull(), F.struct((F.col(f)["distance"] + F.col("step")).alias("distance"), "rank", F.col(f)["value"].alias("value"))).alias(f) for f in parts]
        near = near.select("class", "slot", *further).repartition("class").groupBy("class", "slot").agg(*[F.min(f).alias(f) for f in parts])
    general = few(slots.join(is_class, "range", "left").select("slot", *[F.col(f).alias(f"general_{f}") for f in FACETS], "is_object"))
    out = near.where("declared IS NOT NULL").join(general, "slot")
    facet = {f: F.coalesce(F.col(f)["value"], f"general_{f}") for f in FACETS if f != "range"}
    of_range = lambda name, otherwise: F.when(F.col("range").isNotNull(), F.col("range")["value"][name]).otherwise(F.col(otherwise))
    false = F.lit(False)
    return out.select(
        "class", "slot", F.coalesce(facet["slot_uri"], F.concat(F.lit(prefix), "slot")).alias("predicate"), of_range("range", "general_range").alias("range"), F.coalesce(facet["multivalued"], false).alias("multivalued"),
        F.coalesce(facet["required"], false).alias("required"), F.coalesce(of_range("is_object", "is_object"), false).alias("is_object"), F.col("declared")["value"].alias("declared_by"),
    )


def predicate_of(induced: DataFrame) -> DataFrame:
    """(slot, predicate) of slots that have one predicate in all classes; others depend on the class."""
    return induced.groupBy("slot").agg(F.min("predicate").alias("predicate"), F.max("predicate").alias("__other")).where("predicate = __other").select("slot", "predicate")


def unexpected(fields: DataFrame, induced: DataFrame) -> DataFrame:
    """Fields (class, pid, field, entries) of records that their class hasn't, or holds too often: (pid, field, problem),
    and required slots that a record lacks. entries: how many values the field has."""
    named = fields.join(induced.withColumnRenamed("slot", "field"), ["class", "field"], "left")
    problem = F.when(F.col("predicate").isNull(), "unknown").when((F.col("entries") > 1) & ~F.col("multivalued"), "repeated")
    wrong = named.select("pid", "field", problem.alias("problem")).where("problem IS NOT NULL")
    needed = fields.select("class", "pid").distinct().join(induced.where("required").select("class", F.col("slot").alias("field")), "class")
    return wrong.union(needed.join(fields.where("entries > 0").select("pid", "field"), ["pid", "field"], "left_anti").select("pid", "field", F.lit("missing")))
