"""Publications under a site policy, change candidates against canonical records, and the refresh review."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as X
from ..operators import compare, merge
from ..operators.validate import IntegrityError, all_violations, judged, repeated, require_none, residue, unknown_fields, unused, violations
from ..vocabulary import FIELD_PREDICATES
from .settle import local_rows, settled


def _table(spark: SparkSession, values, column: str = "target") -> DataFrame:
    return local_rows(spark, [(v,) for v in values], f"{column} string")


def render(publications: DataFrame, policy: dict, item_keys: DataFrame, own_prefix: str, group: int, scheme: str = "library", namespace: str = "dlthings:") -> dict[str, DataFrame]:
    """Site records of publications (ingest.transform's records) under a policy (sources.records.parse_policy).

    Attributions and events are kept, omitted and counted, or unreviewed (an error); curated events are added. Every
    publication must have an identifier of an item in the snapshot (item_keys: key), a pid of its own, and every policy
    entry must be used. Gives records, omissions (kind, target, n) and pid_map (source_pid, pid).
    """
    spark = publications.sparkSession
    pattern = rf"^{scheme}:group:{group}:item:(.+)$"
    pubs = publications.withColumn("keys", F.filter(F.transform(R.notations(F.col("identifiers"), namespace + "Identifier"), lambda n: F.regexp_extract(n, pattern, 1)), lambda k: k != ""))
    overrides = local_rows(spark, policy["pid_overrides"].items(), "__pid string, __override string")
    pubs = pubs.join(F.broadcast(overrides), F.col("pid") == F.col("__pid"), "left").withColumn("site_pid", R.stable_pid(F.col("pid"), R.notations(F.col("identifiers"), namespace + "DOI"), F.col("keys"), F.col("__override"), own_prefix))
    pubs = settled(pubs)
    allowed, omitted = _table(spark, policy["allowed_attribution_targets"]), _table(spark, policy["omitted_attribution_targets"])
    people = settled(judged(pubs.select("pid", F.posexplode("attributed_to").alias("pos", "a")).select("pid", "pos", "a", F.col("a.object").alias("object")), "object", allowed, omitted, "target"))
    events = pubs.select("pid", F.explode("generated_by").alias("g")).select("pid", F.col("g.object").alias("object"))
    events = settled(judged(events, "object", _table(spark, []), _table(spark, policy["omitted_generation_objects"]), "target"))
    topics = pubs.select("pid", F.explode("about").alias("object"))
    curated = [(p, i, g["object"], g.get("at_location"), g.get("at_time")) for p, rows in policy["curated_generations"].items() for i, g in enumerate(rows)]
    curated = local_rows(spark, curated, "pid string, pos int, object string, at_location string, at_time string")
    mine = curated.join(pubs.select("pid"), "pid", "left_semi")
    used = lambda kind, df, column="object": df.select(F.lit(kind).alias("category"), F.col(column).alias("entry"))
    kinds = ["pid_overrides", "allowed_attribution_targets", "omitted_attribution_targets", "allowed_about_targets", "omitted_generation_objects", "allowed_curated_generation_targets", "curated_generations"]
    declared = local_rows(spark, [(k, e) for k in kinds for e in policy[k]], "category string, entry string")
    usage = used(kinds[0], pubs.where("__override IS NOT NULL"), "pid")
    for kind, df, column in ((kinds[1], people.where("status = 'keep'"), "object"), (kinds[2], people.where("status = 'omit'"), "object"), (kinds[3], topics, "object"), (kinds[4], events.where("status = 'omit'"), "object"), (kinds[5], mine, "object"), (kinds[6], mine, "pid")):
        usage = usage.unionByName(used(kind, df, column))
    keyed = pubs.select("pid", F.explode("keys").alias("key"))
    require_none([
        all_violations(
            pubs,
            (F.expr("coalesce(pid, '') = '' OR coalesce(title, '') = ''"), "publication without pid or title", F.col("pid"), F.col("title")),
            (F.size("keys") == 0, "publication without a source item", F.col("pid"), F.lit("")),
            (F.col("site_pid").isNull(), "no stable identifier", F.col("pid"), F.lit("")),
        ),
        violations(keyed.join(item_keys, "key", "left_anti"), "item not in the snapshot", F.col("pid"), F.col("key")),
        violations(repeated(pubs, "site_pid"), "repeated site pid", F.col("site_pid"), F.col("rows")),
        violations(people.where("status = 'unreviewed'"), "unreviewed attribution target", F.col("pid"), F.col("object")),
        violations(events.where("status = 'unreviewed'"), "unreviewed generation target", F.col("pid"), F.col("object")),
        violations(topics.join(_table(spark, policy["allowed_about_targets"], "object"), "object", "left_anti"), "unreviewed topic", F.col("pid"), F.col("object")),
        violations(mine.join(_table(spark, policy["allowed_curated_generation_targets"], "object"), "object", "left_anti"), "unreviewed curated generation", F.col("pid"), F.col("object")),
        violations(unused(declared, usage), "unused policy entry", F.col("category"), F.col("entry")),
    ])
    kept = people.where("status = 'keep'").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("pos", "a"))).alias("k")).select("pid", R.typed(F.transform("k", lambda x: x["a"]), namespace + "Attribution").alias("attributions"))
    added = mine.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("pos", "object", "at_location", "at_time"))).alias("k")).select("pid", F.transform("k", lambda x: F.struct(x["object"].alias("object"), x["at_location"].alias("at_location"), x["at_time"].alias("at_time"), F.lit(namespace + "Generation").alias("schema_type"))).alias("generations"))
    out = pubs.join(kept, "pid", "left").join(added, "pid", "left")
    records = out.select(F.col("site_pid").alias("pid"), "title", F.coalesce("display_label", "title").alias("display_label"), "description", "kind", "identifiers", F.col("attributions").alias("attributed_to"), "about", R.typed(F.col("attributes"), namespace + "AttributeSpecification").alias("attributes"), F.col("generations").alias("generated_by"))
    omissions = people.where("status = 'omit'").select(F.lit("attribution").alias("kind"), "object").unionByName(events.where("status = 'omit'").select(F.lit("generation").alias("kind"), "object")).groupBy("kind", F.col("object").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return {"records": records, "omissions": omissions, "pid_map": pubs.select(F.col("pid").alias("source_pid"), F.col("site_pid").alias("pid"))}


def assertions(records: DataFrame, namespace: str = "dlthings:") -> DataFrame:
    """(pid, path, predicate, content, pos) of records: top-level fields by their predicates, attributes, and object lists."""
    parts = []
    have = set(records.columns)
    for name in ("title", "display_label", "description"):
        if name in have:
            parts.append(F.array(F.struct(F.lit("/attributes").alias("path"), F.lit(FIELD_PREDICATES[name]).alias("predicate"), F.col(name).cast("string").alias("content"))))
    if "kind" in have:
        parts.append(F.array(F.struct(F.lit("/characterized_by").alias("path"), F.lit(FIELD_PREDICATES["kind"]).alias("predicate"), F.col("kind").alias("content"))))
    if "about" in have:
        parts.append(F.transform("about", lambda x: F.struct(F.lit("/characterized_by").alias("path"), F.lit(FIELD_PREDICATES["about"]).alias("predicate"), x.alias("content"))))
    if "attributes" in have:
        parts.append(F.transform("attributes", lambda x: F.struct(F.lit("/attributes").alias("path"), x["predicate"].alias("predicate"), x["value"].alias("content"))))
    for name in ("identifiers", "attributed_to", "generated_by"):
        if name in have:
            path = F.lit(f"/{name}")
            parts.append(F.transform(name, lambda x: F.struct(path.alias("path"), F.lit("").alias("predicate"), F.to_json(x).alias("content"))))  # noqa: B023
    empty = F.array().cast("array<struct<path: string, predicate: string, content: string>>")
    every = F.concat(*[F.coalesce(p, empty) for p in parts])
    return records.select("pid", F.posexplode(every).alias("pos", "a")).select("pid", "a.path", "a.predicate", "a.content", F.col("pos").cast("long").alias("pos")).where("content IS NOT NULL AND content <> ''")


def claims(rows: DataFrame) -> DataFrame:
    """(pid, claim_sha256): digest of what a source asserts of a record, whatever the baseline and the fetch."""
    gathered = F.array_sort(F.collect_list(F.struct("path", "predicate", "pos", "content")))
    text = F.array_join(F.transform(gathered, lambda x: F.concat_ws("\x1f", x["path"], x["predicate"], x["content"])), "\x1e")
    return rows.groupBy("pid").agg(R.digest(F.concat_ws("\x1d", "pid", text)).alias("claim_sha256"))


def candidates(source: DataFrame, baseline: DataFrame, decisions: DataFrame, owner: str, known: DataFrame, agents: DataFrame) -> DataFrame:
    """Changes that await a decision: (pid, operation, claim_sha256, added, removed).

    source: assertions of the proposed records; baseline: assertions with owner; known: pids of canonical records;
    agents: (pid, class), where the owner must be an Instrument. A record without a change, or whose same claim was
    accepted or rejected before, is left out.
    """
    keys = ["pid", "path", "predicate", "content"]
    require_none([violations(local_rows(source.sparkSession, [(owner,)], "pid string").join(agents.where("class = 'Instrument'"), "pid", "left_anti"), "owner isn't an instrument", F.col("pid"), F.lit(""))])
    merged = merge.merge_assertions(baseline.join(source.select("pid").distinct(), "pid", "left_semi"), source, owner, keys)
    changed = merged.groupBy("pid").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed")).where("added + removed > 0")
    out = changed.join(claims(source), "pid").join(known.select("pid", F.lit(True).alias("__known")), "pid", "left")
    out = out.select("pid", F.when(F.col("__known"), "modify").otherwise("add").alias("operation"), "claim_sha256", "added", "removed")
    return compare.pending(out, decisions).select("pid", "operation", "claim_sha256", "added", "removed")


#: Predicates of attributes that a source may assert.
SOURCE_PREDICATES = ("bibo:locator", "dcterms:issued", "dcterms:language", "dcterms:rights")
#: Fields of a rendered record, those with one value of their own in a record, and its lists of objects.
RENDERED_FIELDS = ("pid", "title", "display_label", "description", "kind", "identifiers", "attributed_to", "about", "attributes", "generated_by")
TOPICAL, OBJECTS = ("title", "display_label", "description", "kind"), ("identifiers", "attributed_to")
KEYS = ["pid", "path", "predicate", "content"]


def source_identity(records: DataFrame, group: int, scheme: str = "library", namespace: str = "dlthings:", root: str = "https://api.example.org/groups") -> DataFrame:
    """(pid, source_record_id, imported_from) of rendered records by the keys of their items: 'item:K' or 'items:K1,K2'."""
    keys = F.array_sort(F.array_distinct(F.filter(F.transform(R.notations(F.col("identifiers"), namespace + "Identifier"), lambda n: F.regexp_extract(n, rf"^{scheme}:group:{group}:item:(.+)$", 1)), lambda k: k != "")))
    one, all_ = F.concat(F.lit(f"{root}/{group}/items/"), F.col("keys")[0]), F.concat(F.lit(f"{root}/{group}/items?itemKey="), X.percent_encoded(F.array_join("keys", ",")))
    return records.select("pid", keys.alias("keys")).select("pid", R.source_record_id(F.col("keys")).alias("source_record_id"), F.when(F.size("keys") == 1, one).when(F.size("keys") > 1, all_).alias("imported_from"))


def source_coordinate(source: dict) -> dict:
    """What a plan says of the snapshot it was made from: its group, version and digest."""
    group, version, sha = (source.get(k) for k in ("group_id", "library_version", "content_sha256"))
    if isinstance(group, bool) or not isinstance(group, int) or isinstance(version, bool) or not isinstance(version, int) or not isinstance(sha, str) or not re.fullmatch("[0-9a-f]{64}", sha):
        raise IntegrityError("the snapshot's coordinate is invalid")
    return {"content_sha256": f"sha256:{sha}", "group_id": group, "kind": "public-library", "library_version": version}


def _shape_checks(rendered: DataFrame, namespace: str) -> list[DataFrame]:
    """Violations of what a source record may hold: known fields, mapped attributes, each predicate's values once."""
    strange = unknown_fields(rendered, RENDERED_FIELDS)
    attributes = rendered.select("pid", F.explode("attributes").alias("a")).select("pid", "a.*")
    return [
        violations(rendered.limit(1) if strange else rendered.limit(0), "unsupported fields", F.lit(", ".join(strange)), F.lit("")),
        violations(rendered.where("coalesce(title, '') = '' OR coalesce(display_label, '') = '' OR coalesce(kind, '') = ''"), "record without title, label or kind", F.col("pid"), F.lit("")),
        violations(attributes.where(~F.col("predicate").isin(*SOURCE_PREDICATES) | (F.col("schema_type") != namespace + "AttributeSpecification") | F.col("value").isNull()), "attribute outside the mapping", F.col("pid"), F.col("predicate")),
        violations(repeated(attributes, "pid", "predicate", "value"), "repeated attribute", F.col("pid"), F.col("predicate")),
        violations(repeated(rendered, "pid"), "repeated pid", F.col("pid"), F.col("rows")),
    ]


def proposals(rendered: DataFrame, canonical: DataFrame, notes: DataFrame, decisions: DataFrame, owner: str, agents: DataFrame, group: int, namespace: str = "dlthings:", class_name: str = "Publication") -> DataFrame:
    """The records and companions that accepting rendered records would give, as (pid, path, operation, source_record_id,
    record, companion, claim_sha256, added, removed).

    rendered: render()'s records; canonical: records in the same form and rel_path; notes: companions of theirs as (pid,
    path, assertion_sha256, imported_by, imported_from), where path and digest name an assertion. Every source value is
    an assertion of the owner, unless someone asserts it already; the owner's former ones that aren't claimed again go.
    A curated field keeps its value and an absent one is filled. A curated event must stand in the record, if there is
    one: its absence is an error. A record without a change, and one whose same claim was decided on, is left out;
    claim_sha256 digests record path, pid and what the source asserts.
    """
    rendered = settled(rendered)
    checks = _shape_checks(rendered, namespace)
    require_none([violations(local_rows(rendered.sparkSession, [(owner,)], "pid string").join(agents.where("class = 'Instrument'"), "pid", "left_anti"), "owner isn't an instrument", F.col("pid"), F.lit("")), *checks])
    fields = [*TOPICAL, "about", "attributes", *OBJECTS, "generated_by"]
    held = canonical.select("pid", "rel_path", F.struct(*fields).alias("held"))
    both = settled(rendered.select("pid", F.struct(*fields).alias("source")).join(source_identity(rendered, group, namespace=namespace), "pid").join(held, "pid", "left"))
    absent = F.filter("source.generated_by", lambda e: ~F.coalesce(compare.all_contained(F.array(e), F.col("held.generated_by"), ["object", "at_location", "at_time"]), F.lit(False)))
    require_none([violations(both.where(F.col("held").isNotNull() & (F.size(absent) > 0)), "curated event is absent", F.col("pid"), F.lit(""))])

    digest = R.digest(F.to_json(F.struct("path", "predicate", "content")))
    owned = notes.select("pid", "path", F.col("assertion_sha256").alias("digest"), F.col("imported_by").alias("owner"))
    # events are the site's own: they are checked above and asserted by nobody
    known = settled(assertions(both.where("held IS NOT NULL").select("pid", "held.*").drop("generated_by")).withColumn("digest", digest))
    theirs = notes.join(both.where("held IS NOT NULL").select("pid"), "pid", "left_semi")
    require_none([violations(merge.orphan_notes(known.withColumnRenamed("digest", "assertion_sha256"), theirs), "companion entry without an assertion", F.col("pid"), F.col("path"))])
    known = known.join(owned, ["pid", "path", "digest"], "left").drop("digest")
    claimed = assertions(both.select("pid", "source.*").drop("generated_by"))
    # an assertion that stands in a record twice (in its own field and among the attributes) is one
    known = known.groupBy(*KEYS).agg(F.max("owner").alias("owner"), F.min("pos").alias("pos"))
    merged = settled(merge.merge_assertions(known, claimed, owner, KEYS))
    plain = F.filter(F.collect_list(F.when(F.col("change") != "removed", F.struct((F.col("change") == "added").alias("late"), "pos", "path", "predicate", "content", F.col("owner").isNotNull().alias("owned")))), lambda x: x.isNotNull())
    lists = merged.groupBy("pid").agg(F.array_sort(plain).alias("rows"), F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
    companion = merge.companion(merged, digest, F.lit(None).cast("string")).groupBy("pid").agg(F.collect_set(F.struct("path", "assertion_sha256", "imported_by")).alias("owned"))
    out = both.join(lists, "pid").join(companion, "pid", "left").join(claims(claimed), "pid")

    of = lambda path: F.filter("rows", lambda x: x["path"] == path)
    field = {name: merge.topical(F.col(f"held.{name}"), F.col(f"source.{name}")) for name in TOPICAL}
    topics = F.when(F.size("held.about") > 0, F.col("held.about")).when(F.size("source.about") > 0, F.col("source.about"))
    # what only repeats a field of the record is no attribute, unless it is owned or stood among the attributes
    predicates = F.create_map(*[x for name in TOPICAL for x in (F.lit(FIELD_PREDICATES[name]), field[name])])
    stood = lambda x: F.coalesce(F.exists("held.attributes", lambda a: (a["predicate"] == x["predicate"]) & (a["value"] == x["content"])), F.lit(False))
    extra = F.filter(of("/attributes"), lambda x: x["owned"] | stood(x) | ~F.coalesce(predicates[x["predicate"]] == x["content"], F.lit(False)))
    attributes = F.transform(extra, lambda x: F.struct(x["predicate"].alias("predicate"), x["content"].alias("value"), F.lit(namespace + "AttributeSpecification").alias("schema_type")))
    parsed = lambda kind: lambda x: F.from_json(x["content"], kind)
    objects = {name: F.transform(of(f"/{name}"), parsed(rendered.schema[name].dataType.elementType)) for name in OBJECTS}
    record = F.struct("pid", *[field[n].alias(n) for n in TOPICAL], topics.alias("about"), attributes.alias("attributes"), *[objects[n].alias(n) for n in OBJECTS], F.coalesce("held.generated_by", "source.generated_by").alias("generated_by"))
    former = notes.groupBy("pid").agg(F.collect_set(F.struct("path", "assertion_sha256", "imported_by", "imported_from")).alias("former"))
    out = out.join(former, "pid", "left")
    # a companion entry keeps where it was imported from
    origin = lambda n: F.coalesce(F.get(F.filter("former", lambda f: (f["path"] == n["path"]) & (f["assertion_sha256"] == n["assertion_sha256"])), F.lit(0))["imported_from"], F.col("imported_from"))
    entries = F.array_sort(F.transform("owned", lambda n: F.struct(n["path"].alias("path"), n["assertion_sha256"].alias("assertion_sha256"), n["imported_by"].alias("imported_by"), origin(n).alias("imported_from"))))
    stem = F.concat(F.lit(f"{class_name}/"), F.regexp_extract("pid", "([^/:]+)$", 1), F.lit(".yaml"))
    path = F.coalesce("rel_path", stem)
    filled = lambda n: F.coalesce(F.nullif(F.col(f"held.{n}"), F.lit("")).isNull() & F.nullif(F.col(f"source.{n}"), F.lit("")).isNotNull(), F.lit(False))
    changed = F.col("held").isNull() | (F.col("added") + F.col("removed") > 0)
    for name in TOPICAL:
        changed = changed | filled(name)
    plan = out.where(changed).select(
        "pid", path.alias("path"), F.when(F.col("held").isNull(), "add").otherwise("modify").alias("operation"), "source_record_id", record.alias("record"), entries.alias("companion"),
        R.digest(F.concat_ws("\x1d", path, "source_record_id", "claim_sha256")).alias("claim_sha256"), "added", "removed",
    )
    return compare.pending(plan, decisions)


def file_changes(plan: DataFrame) -> DataFrame:
    """(pid, file, operation) that a plan of proposals makes: each record, and its companion if it has entries."""
    record = F.struct(F.concat(F.lit("records/"), "path").alias("file"), F.col("operation").alias("operation"))
    note = F.when(F.size("companion") > 0, F.struct(F.concat(F.lit("annotations/"), "path").alias("file"), F.col("operation").alias("operation")))
    return plan.select("pid", F.inline(F.array_compact(F.array(record, note))))


def coverage(source_pids: DataFrame, rendered: DataFrame, pid_map: DataFrame) -> None:
    """Source, pid map and rendered records must correspond one to one."""
    require_none([
        violations(residue(source_pids.select(F.col("pid").alias("k")), pid_map.select(F.col("source_pid").alias("k")), "k"), "source without a site pid", F.col("k"), F.col("side")),
        violations(residue(rendered.select(F.col("pid").alias("k")), pid_map.select(F.col("pid").alias("k")), "k"), "record outside the map", F.col("k"), F.col("side")),
        violations(repeated(pid_map, "pid"), "repeated site pid", F.col("pid"), F.col("rows")),
    ])


def review(reviewed: DataFrame, stored: DataFrame, live: DataFrame, key: str, columns: list[str], render_live: Callable[[], DataFrame], rendered: DataFrame, canonical: DataFrame, plan: DataFrame | None = None) -> dict:
    """A refresh review: the stored candidates must be what the stored snapshot gives (else it is stale, an error); then
    what the live snapshot changes, in candidates and in rendered records, and where rendered records (pid, record) aren't
    contained in canonical ones. Live input that breaks the contract is a blocker, not a failure. `queue` counts the
    proposals of a plan that await a decision by operation, and `update` says whether the live snapshot is to be taken
    over: it changes something and nothing blocks it."""
    stale = compare.keyed_diff(stored, reviewed, key, columns).where("change <> 'unchanged'")
    require_none([violations(stale, "stored candidates are stale", F.col(key), F.col("change"))])
    blockers, site = [], None
    try:
        site = compare.keyed_diff(rendered, render_live(), "pid", ["record"])
    except ValueError as error:
        blockers.append(str(error))
    changes = compare.keyed_diff(reviewed, live, key, columns)
    queue = plan.groupBy("operation").agg(F.count(F.lit(1)).alias("n")) if plan is not None else None
    update = not blockers and not changes.where("change <> 'unchanged'").isEmpty()
    return {"changes": changes, "site_changes": site, "violations": compare.projection_violations(rendered, canonical), "blockers": blockers, "queue": queue, "update": update}
