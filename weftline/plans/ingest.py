"""From source items to candidate records and a review report: filter, group, classify, represent, resolve, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as X
from ..operators import entity, resolve
from ..operators.validate import require_none, violations
from ..vocabulary import COMPLETENESS_FIELDS, CONFLICT_FIELDS, CREATOR_ROLES, JOURNAL_KIND, PROCEEDINGS_KIND, PUBLICATION_KINDS, PUBLISHING, SOFTWARE_KIND, Options
from .settle import few, settled


def _mapped(value: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), value) if pairs else F.lit(None).cast("string")


def name_index(records: DataFrame) -> DataFrame:
    """(key, pid) of records (pid, labels array<string>): normalized labels that belong to exactly one pid."""
    return resolve.unique_index(records.select("pid", F.explode("labels").alias("label")).select(X.name_key(F.col("label")).alias("key"), "pid"), "key", "pid")


def source_items(items: DataFrame, collections: DataFrame, options: Options) -> DataFrame:
    """Items that aren't deleted, with `names` of their collections, `item_doi` (normalized), and `bucket`: selected, unfiled or excluded."""
    alive = items.where(~F.coalesce("deleted", F.lit(False))).withColumn("key", F.coalesce("key", F.lit("")))
    named = resolve.named(alive, "collections", collections, "key", "name", "names", "collections", few)
    keys = F.transform("names", lambda n: X.label_key(n, options.label_prefix))
    wanted = F.array(*[F.lit(x) for x in options.included]).cast("array<string>")
    bucket = F.when(F.arrays_overlap(keys, wanted), "selected").when(F.size("names") == 0, "unfiled").otherwise("excluded")
    return named.withColumn("label_keys", keys).withColumn("item_doi", X.item_doi(F.col("DOI"), F.col("extra"))).withColumn("bucket", bucket)


def classify(items: DataFrame, options: Options) -> DataFrame:
    """items with `class`, `kind` and `reason` (of having no class)."""
    type_ = X.clean(F.col("itemType"))
    hints = F.array_distinct(F.array_compact(F.transform("label_keys", lambda k: _mapped(k, options.document_classes))))
    hint = F.when(F.size(hints) == 1, hints[0])
    document = type_ == "document"
    class_ = (
        F.when(type_ == "dataset", "Dataset")
        .when(type_ == "computerProgram", "Instrument")
        .when(~document & type_.isin(*PUBLICATION_KINDS), "Publication")
        .when(document & (F.size(hints) == 0), "Document")
        .when(document & (hint == "dataset"), "Dataset")
        .when(document & (hint == "instrument"), "Instrument")
        .when(document & (hint == "publication"), "Publication")
    )
    kind = F.when(F.col("class") == "Instrument", SOFTWARE_KIND).when(F.col("class").isin("Publication", "Document"), _mapped(type_, PUBLICATION_KINDS))
    reason = F.when(F.col("class").isNotNull(), F.lit(None)).when(document & (F.size(hints) > 1), "conflicting collection classification").when(document, "registry enrichment required").otherwise(F.concat(F.lit("unmapped item type: "), F.when(type_ == "", "[missing]").otherwise(type_)))
    return items.withColumn("class", class_).withColumn("kind", kind).withColumn("reason", reason)


def identifiers(options: Options) -> Column:
    """array<struct<schema_type, notation>> of one item: DOI, item key, URL, ISSNs, ISBNs, PMID, PMCID."""
    ns = options.namespace
    one = lambda kind, value: F.when(value.isNotNull(), F.struct(F.lit(ns + kind).alias("schema_type"), value.alias("notation")))
    many = lambda kind, values, prefix="": F.transform(values, lambda v: F.struct(F.lit(ns + kind).alias("schema_type"), F.concat(F.lit(prefix), v).alias("notation")))
    coded = [F.concat(F.lit(f"{label}:"), X.labelled_line(F.col("extra"), label)) for label in ("PMID", "PMCID")]
    key = F.concat(F.lit(f"{options.scheme}:group:{options.group}:item:"), F.nullif("key", F.lit("")))
    single = F.array_compact(F.array(one("Identifier", key), one("Identifier", X.filled(F.col("url"))), *[one("Identifier", c) for c in coded]))
    return F.concat(single, many("ISSN", X.issns(F.col("ISSN"))), many("Identifier", X.isbns(F.col("ISBN")), "ISBN:"))


def creators(items: DataFrame) -> DataFrame:
    """(item, pos, creator_type, name, key, single_field, role) of the items' creators; role is null for an unknown type."""
    rows = items.select(F.col("key").alias("item"), F.posexplode("creators").alias("pos", "c"))
    name = X.person_name(F.col("c.name"), F.col("c.firstName"), F.col("c.lastName"))
    rows = rows.select("item", "pos", X.clean(F.col("c.creatorType")).alias("creator_type"), F.coalesce(name, F.lit("")).alias("name"), (F.coalesce("c.name", F.lit("")) != "").alias("single_field"))
    return rows.withColumn("key", X.name_key(F.col("name"))).withColumn("role", _mapped(F.col("creator_type"), CREATOR_ROLES))


def transform(items: DataFrame, collections: DataFrame, people: DataFrame, organizations: DataFrame, topics: DataFrame, aliases: DataFrame, existing: DataFrame, options: Options) -> dict[str, DataFrame]:
    """Candidate records and the tables of the review report.

    items (vocabulary.ITEM) and collections (key, name) are the source; people, organizations and topics are (pid,
    labels); aliases (key, pid) are reviewed; existing (pid, files) are the pids in use. A creator with an unknown role,
    or an alias that points nowhere or against the index, is an error before anything is made.
    """
    rows = settled(source_items(items, collections, options))
    selected, unfiled = rows.where("bucket = 'selected'"), rows.where("bucket = 'unfiled'")
    person_index, org_index = name_index(people), name_index(organizations)
    automatic = person_index.unionByName(org_index).withColumnRenamed("pid", "auto")
    known = people.select("pid").unionByName(organizations.select("pid"))
    made = settled(creators(selected))
    require_none([
        violations(made.where("role IS NULL"), "unsupported creator role", F.col("item"), F.concat_ws(" ", "pos", "creator_type", "name")),
        violations(aliases.join(known, "pid", "left_anti"), "alias of an unknown pid", F.col("pid"), F.col("key")),
        violations(aliases.join(automatic, "key").where("pid <> auto"), "alias against the index", F.col("key"), F.concat_ws(", ", "pid", "auto")),
    ])
    grouped = resolve.attach(selected, unfiled, "item_doi").withColumn("group", entity.group_key(F.col("item_doi"), F.col("key")))
    classified = settled(classify(grouped, options))
    own = classified.where("NOT attached")
    one, several = entity.classes(own, "group", "class")
    order = [R.score([F.col(f) for f in COMPLETENESS_FIELDS], F.size("creators"), F.col("itemType") == "document"), F.coalesce("version", F.lit(0)), F.col("key")]
    best = entity.representative(own.join(one, ["group", "class"]), "group", ["key", "class", "kind"], order)
    preferred = settled(best.join(classified.drop("class", "kind", "group"), "key"))

    ids = entity.union_of(classified.withColumn("ids", identifiers(options)), "group", "ids", "plain_ids")
    attributed, unresolved_creators = resolve.resolve_creators(made.join(preferred.select(F.col("key").alias("item")), "item", "left_semi"), aliases, person_index, org_index)
    attributions = attributed.groupBy(F.col("item").alias("key")).agg(F.array_sort(F.collect_list(F.struct("pos", "pid", "role"))).alias("a"))
    attributions = attributions.select("key", F.transform("a", lambda x: F.struct(x["pid"].alias("object"), F.array(x["role"]).alias("roles"))).alias("attributed_to"))
    tags = preferred.select(F.col("key").alias("item"), F.explode("tags").alias("t")).select("item", X.clean(F.col("t.tag")).alias("name")).withColumn("key", X.name_key(F.col("name")))
    about, unresolved_topics = resolve.resolve_terms(tags, name_index(topics))
    about = about.groupBy(F.col("item").alias("key")).agg(F.array_sort(F.collect_set("pid")).alias("about"))

    doi_id = F.when(F.col("item_doi").isNotNull(), F.array(F.struct(F.lit(options.namespace + "DOI").alias("schema_type"), F.col("item_doi").alias("notation")))).otherwise(F.array().cast("array<struct<schema_type: string, notation: string>>"))
    publication = F.col("class") == "Publication"
    title, issns = X.filled(F.col("title")), X.issns(F.col("ISSN"))
    venue_pid = F.when(publication & (F.size(issns) > 0), F.concat(F.lit("ISSN:"), issns[0]))
    locator = F.nullif(X.joined(", ", F.col("volume"), F.col("issue"), F.col("pages")), F.lit(""))
    attributes = R.attribute_rows([("bibo:locator", locator), ("dcterms:issued", F.col("date")), ("dcterms:language", F.col("language")), ("dcterms:rights", F.col("rights"))])
    event = F.struct(F.lit(PUBLISHING).alias("object"), venue_pid.alias("at_location"), X.full_date(F.col("date")).alias("at_time"))
    full = preferred.join(ids, "group").join(attributions, "key", "left").join(about, "key", "left")
    records = full.select(
        "class", F.when(F.col("item_doi").isNotNull(), F.concat(F.lit("https://doi.org/"), "item_doi")).otherwise(F.concat(F.lit(f"{options.root}/{options.group}/items/"), "key")).alias("pid"),
        F.array_sort(F.array_union("plain_ids", doi_id)).alias("identifiers"), F.when(F.col("class") != "Instrument", title).alias("title"), F.when(F.col("class") == "Instrument", title).alias("name"),
        title.alias("display_label"), X.filled(F.col("abstractNote")).alias("description"), "kind", "attributed_to", "about",
        F.when(publication & (F.size(attributes) > 0), attributes).alias("attributes"), F.when(publication & (venue_pid.isNotNull() | X.full_date(F.col("date")).isNotNull()), F.array(event)).alias("generated_by"),
    )
    records = settled(records)

    venue_title = F.coalesce(F.nullif("publicationTitle", F.lit("")), F.col("proceedingsTitle"))
    venues = preferred.where(publication & (F.size(issns) > 0)).select("group", F.concat(F.lit("ISSN:"), issns[0]).alias("pid"), issns.alias("issns"), F.when(X.clean(F.col("itemType")) == "conferencePaper", PROCEEDINGS_KIND).otherwise(JOURNAL_KIND).alias("kind"), X.filled(venue_title).alias("title"))
    first, conflicts = entity.merged_first(venues, "pid", ["group"], ["issns", "kind", "title"])
    pids = records.select("class", "pid").unionByName(first.select(F.lit("PublicationVenue").alias("class"), "pid"))
    titles = records.select(X.name_key(F.coalesce("title", "name")).alias("key"), "pid").unionByName(first.select(X.name_key(F.col("title")).alias("key"), "pid"))
    shared = classified.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("key")).alias("item_keys")).where("n > 1")
    counts = [pids.groupBy(F.lit("candidate_records").alias("kind"), F.col("class").alias("name")).count(), rows.select(F.explode("names").alias("name")).groupBy(F.lit("collection_memberships").alias("kind"), "name").count(), rows.groupBy(F.lit("bucket").alias("kind"), F.col("bucket").alias("name")).count()]
    return {
        "records": records,
        "venues": first.select("pid", "issns", "kind", "title"),
        "venue_conflicts": conflicts.select("pid", "group", "title"),
        "review_items": several.join(own.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("key", "class", "reason"))).alias("classifications")), "group"),
        "unresolved_creators": unresolved_creators.select("item", "pos", "name"),
        "unresolved_topics": unresolved_topics,
        "unresolved_venues": preferred.where(publication & (F.size(issns) == 0)).select(F.col("key").alias("item"), X.filled(venue_title).alias("title")).where("title IS NOT NULL"),
        "missing_titles": preferred.where(title.isNull()).select(F.col("key").alias("item")),
        "duplicate_dois": shared.join(preferred.where("item_doi IS NOT NULL").select("group", F.col("item_doi").alias("doi"), F.col("key").alias("preferred")), "group"),
        "field_conflicts": entity.field_conflicts(classified.join(preferred.where("item_doi IS NOT NULL").select("group"), "group", "left_semi").withColumns({f: X.filled(F.col(f)) for f in CONFLICT_FIELDS}), "group", CONFLICT_FIELDS),
        "pid_collisions": pids.join(existing, "pid"),
        "title_collisions": entity.collisions(titles, "key", "pid"),
        "excluded": rows.where("bucket = 'excluded'").select("key", "names"),
        "unfiled": unfiled.select("key", F.col("item_doi").alias("doi")),
        "attached": classified.where("attached").select("key"),
        "alias_usage": made.join(aliases, "key").groupBy("key", "pid").count(),
        "counts": counts[0].unionByName(counts[1]).unionByName(counts[2]),
    }
