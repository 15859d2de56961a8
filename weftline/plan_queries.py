"""Queries that run whole plans over the driver's tables: parts as source items, nations as people.

Their SQL says independently what each plan must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .catalogue import query, read
from .functions import records as R
from .functions import text as X
from .operators import compare, entity, resolve
from .plans import claims, graph, ingest, publish, schema, site, targets
from .plans.settle import local_rows, spread
from .vocabulary import ITEM, PUBLISHING, Options

OPTIONS = Options(group=7, included=("papers",), label_prefix="my ")
OWN = "own:publications/"

# Two of four parts share a DOI; one brand's number is an ISSN; a seventh has no collection, another one a foreign one.
_ITEMS = """
i AS (SELECT p_partkey AS k, 'P' || p_partkey AS key, p_size AS version, p_name AS title, CASE p_size % 4 WHEN 0 THEN 'journalArticle' WHEN 1 THEN 'book' WHEN 2 THEN 'computerProgram' ELSE 'patent' END AS t,
  CASE WHEN p_partkey % 4 < 2 THEN '10.1234/g' || (p_partkey // 4) END AS doi, CASE WHEN p_size % 4 = 0 THEN '0000-' || lpad(replace(p_brand, 'Brand#', ''), 4, '0') END AS issn,
  '2020-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') AS date, p_size AS person, p_type AS topic, CASE p_partkey % 7 WHEN 0 THEN 'unfiled' WHEN 1 THEN 'excluded' ELSE 'selected' END AS bucket FROM part),
g AS (SELECT *, coalesce('doi:' || doi, 'item:' || key) AS grp, bucket = 'unfiled' AS attached, CASE t WHEN 'computerProgram' THEN 'Instrument' WHEN 'patent' THEN NULL ELSE 'Publication' END AS class
  FROM i WHERE bucket = 'selected' OR (bucket = 'unfiled' AND doi IN (SELECT doi FROM i WHERE bucket = 'selected' AND doi IS NOT NULL))),
one AS (SELECT grp, min(class) AS class FROM g WHERE NOT attached GROUP BY 1 HAVING count(DISTINCT class) = 1),
best AS (SELECT g.grp, arg_max(key, ((t = 'journalArticle')::INT, version, key)) AS key FROM g JOIN one USING (grp, class) WHERE NOT attached GROUP BY 1),
ids AS (SELECT grp, list_sort(list(DISTINCT n)) AS notations FROM (SELECT grp, 'library:group:7:item:' || key AS n FROM g UNION ALL SELECT grp, issn FROM g WHERE issn IS NOT NULL UNION ALL SELECT grp, doi FROM g WHERE doi IS NOT NULL) GROUP BY 1),
pref AS (SELECT g.*, notations, coalesce('https://doi.org/' || doi, 'https://api.example.org/groups/7/items/' || key) AS pid, CASE WHEN person < 25 THEN 'own:p/' || person END AS who FROM best JOIN g USING (grp, key) JOIN ids USING (grp)),
pub AS (SELECT *, coalesce('own:publications/doi-' || regexp_replace(doi, '[^a-z0-9]+', '-', 'g'), 'own:publications/item-' || lower(key)) AS site FROM pref WHERE class = 'Publication')
"""


def _items(spark, sf_dir) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("journalArticle", "book", "computerProgram", "patent")]), F.col("p_size") % 4 + 1)
    article = F.col("p_size") % 4 == 0
    given = {
        "key": F.concat(F.lit("P"), "p_partkey"), "version": F.col("p_size"), "itemType": kind, "deleted": F.lit(False), "title": F.col("p_name"),
        "DOI": F.when(F.col("p_partkey") % 4 < 2, F.concat(F.lit("https://doi.org/10.1234/G"), F.floor(F.col("p_partkey") / 4))),
        "ISSN": F.when(article, F.concat(F.lit("0000-"), F.lpad(F.replace("p_brand", F.lit("Brand#"), F.lit("")), 4, "0"))), "publicationTitle": F.when(article, F.col("p_type")),
        "date": F.concat(F.lit("2020-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")),
        "collections": F.when(F.col("p_partkey") % 7 == 0, F.array()).when(F.col("p_partkey") % 7 == 1, F.array(F.lit("C2"))).otherwise(F.array(F.lit("C1"))),
        "creators": F.array(F.struct(F.lit("author").alias("creatorType"), F.lit("Ada").alias("firstName"), F.concat(F.lit("N"), "p_size").alias("lastName"), F.lit("").alias("name"))),
        "tags": F.array(F.struct(F.col("p_type").alias("tag"))),
    }
    schema = T.StructType.fromDDL(ITEM)
    return spread(read(spark, sf_dir, "part")).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _transformed(spark, sf_dir) -> dict[str, DataFrame]:
    collections = local_rows(spark, [("C1", "My Papers"), ("C2", "Other")], "key string, name string")
    people = read(spark, sf_dir, "nation").select(F.concat(F.lit("own:p/"), "n_nationkey").alias("pid"), F.array(F.concat(F.lit("Ada N"), "n_nationkey")).alias("labels"))
    labels = lambda *x: local_rows(spark, x, "pid string, labels array<string>")
    aliases = local_rows(spark, [], "key string, pid string")
    existing = read(spark, sf_dir, "part").where("p_size < 17").select(F.concat(F.lit("https://doi.org/10.1234/g"), "p_partkey").alias("pid"), F.array(F.lit("file")).alias("files"))
    return ingest.transform(_items(spark, sf_dir), collections, people, labels(("own:o/lab", ["The Lab"])), labels(("own:t/economy", ["Economy"]), ("own:t/small", ["SMALL", "Little"])), aliases, existing, OPTIONS)


@query(f"""
WITH {_ITEMS}
SELECT class, pid, title, CASE WHEN class = 'Instrument' THEN 'obo:IAO_0000010' WHEN t = 'book' THEN 'bibo:Book' ELSE 'bibo:AcademicArticle' END AS kind, notations,
  CASE WHEN who IS NULL THEN NULL ELSE [who || '|marcrel:aut'] END AS attributed, CASE topic WHEN 'ECONOMY' THEN ['own:t/economy'] WHEN 'SMALL' THEN ['own:t/small'] END AS about,
  CASE WHEN class = 'Publication' THEN ['dcterms:issued=' || date] END AS attributes, CASE WHEN class = 'Publication' THEN coalesce('ISSN:' || issn, '') || '@' || date END AS event FROM pref
""")
def ingest_records(spark, sf_dir):
    """Source items as records: buckets, groups by DOI, classes, representatives, unions of identifiers, attributions, topics, attributes, events."""
    out = _transformed(spark, sf_dir)["records"]
    event = F.col("generated_by")[0]
    return out.select(
        "class", "pid", F.coalesce("title", "name").alias("title"), "kind", F.array_sort(F.transform("identifiers", lambda i: i["notation"])).alias("notations"),
        F.transform("attributed_to", lambda a: F.concat_ws("|", a["object"], F.array_join(a["roles"], ","))).alias("attributed"), "about",
        F.transform("attributes", lambda a: F.concat_ws("=", a["predicate"], a["value"])).alias("attributes"), F.concat(F.coalesce(event["at_location"], F.lit("")), F.lit("@"), event["at_time"]).alias("event"),
    )


@query(f"""
WITH {_ITEMS},
title AS (SELECT regexp_replace(lower(title), '[^0-9a-z]', '', 'g') AS k, pid FROM pref UNION SELECT regexp_replace(lower(v), '[^0-9a-z]', '', 'g'), 'ISSN:' || issn FROM (SELECT issn, arg_min(topic, grp) AS v FROM pref WHERE class = 'Publication' AND issn IS NOT NULL GROUP BY 1))
SELECT 'review_items' AS report, (SELECT count(*) FROM (SELECT grp FROM g WHERE NOT attached GROUP BY 1 HAVING count(DISTINCT class) <> 1))::BIGINT AS n
UNION ALL SELECT 'unresolved_creators', (SELECT count(*) FROM pref WHERE who IS NULL)
UNION ALL SELECT 'unresolved_topics', (SELECT count(*) FROM pref WHERE topic NOT IN ('ECONOMY', 'SMALL'))
UNION ALL SELECT 'venues', (SELECT count(DISTINCT issn) FROM pref WHERE class = 'Publication')
UNION ALL SELECT 'duplicate_dois', (SELECT count(*) FROM pref WHERE doi IS NOT NULL AND grp IN (SELECT grp FROM g GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'pid_collisions', (SELECT count(*) FROM pref JOIN part ON p_size < 17 AND pid = 'https://doi.org/10.1234/g' || p_partkey)
UNION ALL SELECT 'title_collisions', (SELECT count(*) FROM (SELECT k FROM title WHERE k <> '' GROUP BY 1 HAVING count(DISTINCT pid) > 1))
UNION ALL SELECT 'excluded', (SELECT count(*) FROM i WHERE bucket = 'excluded')
UNION ALL SELECT 'unfiled', (SELECT count(*) FROM i WHERE bucket = 'unfiled')
UNION ALL SELECT 'attached', (SELECT count(*) FROM g WHERE attached)
UNION ALL SELECT 'missing_titles', (SELECT count(*) FROM pref WHERE trim(title) = '')
""")
def ingest_report(spark, sf_dir):
    """Rows of the tables of the review report."""
    out = _transformed(spark, sf_dir)
    names = ["review_items", "unresolved_creators", "unresolved_topics", "venues", "duplicate_dois", "pid_collisions", "title_collisions", "excluded", "unfiled", "attached", "missing_titles"]
    parts = [out[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("report"), "n") for n in names]
    while len(parts) > 1:
        parts = [a.union(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
    return parts[0]


def _rendered(spark, sf_dir) -> dict[str, DataFrame]:
    """People with an even number may be named, the others are omitted, and so are publishing events."""
    pubs = _transformed(spark, sf_dir)["records"].where("class = 'Publication'")
    # a policy's entries must all be used: those of the vocabularies (25 people, 2 topics) that are
    people = [r[0] for r in pubs.select(F.explode("attributed_to.object")).distinct().collect()]
    topics = [r[0] for r in pubs.select(F.explode("about")).distinct().collect()]
    even = {p: int(p.rsplit("/", 1)[1]) % 2 == 0 for p in people}
    policy = {
        "pid_overrides": {}, "allowed_attribution_targets": [p for p in people if even[p]], "omitted_attribution_targets": {p: "odd" for p in people if not even[p]}, "allowed_about_targets": topics,
        "omitted_generation_objects": {PUBLISHING: "in the date"}, "allowed_curated_generation_targets": [], "curated_generations": {},
    }
    return publish.render(pubs, policy, _items(spark, sf_dir).select("key"), OWN, OPTIONS.group)


@query(f"""
WITH {_ITEMS}
SELECT site AS pid, title, notations, CASE WHEN person < 25 AND person % 2 = 0 THEN ['own:p/' || person || '|dlthings:Attribution'] END AS attributed, ['dcterms:issued=' || date || '|dlthings:AttributeSpecification'] AS attributes FROM pub
""")
def render_records(spark, sf_dir):
    """Publications under a policy, with the pids of the site."""
    out = _rendered(spark, sf_dir)["records"]
    return out.select(
        "pid", "title", F.array_sort(F.transform("identifiers", lambda i: i["notation"])).alias("notations"), F.transform("attributed_to", lambda a: F.concat_ws("|", a["object"], a["schema_type"])).alias("attributed"),
        F.transform("attributes", lambda a: F.concat(a["predicate"], F.lit("="), a["value"], F.lit("|"), a["schema_type"])).alias("attributes"),
    )


@query(f"""
WITH {_ITEMS}
SELECT 'attribution' AS kind, 'own:p/' || person AS target, count(*)::BIGINT AS n FROM pub WHERE person < 25 AND person % 2 = 1 GROUP BY 2
UNION ALL SELECT 'generation', 'obo:IAO_0000444', count(*) FROM pub HAVING count(*) > 0
""")
def render_omissions(spark, sf_dir):
    """What a policy leaves out, counted by target."""
    return _rendered(spark, sf_dir)["omissions"]


@query("""
SELECT p_partkey, '10.' || (1000 + p_size) || '/' || lower(replace(p_name, ' ', '/')) AS a, '10.5/' || p_partkey AS b, NULL::VARCHAR AS b_locator, NULL::VARCHAR AS c, '10.1234/' || p_partkey AS c_locator,
  '10.7777/' || lower(p_type) AS extra, CASE WHEN p_size % 2 = 0 THEN 'doi:10.5/' || p_partkey ELSE 'item:' || p_partkey END AS grp FROM part
""")
def doi_rules(spark, sf_dir):
    """DOIs in fields, in free text and as locators, and the keys of groups by them."""
    part = read(spark, sf_dir, "part")
    a = F.concat(F.lit(" https://doi.org/10."), F.col("p_size") + 1000, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("%2F")), F.lit(".) "))
    b, c = F.concat(F.lit("DOI: 10.5/"), "p_partkey"), F.concat(F.lit("HTTPS://X.DOI.ORG/10.1234/"), "p_partkey", F.lit("//"))
    extra = F.concat(F.lit("PMID: 7\nsee doi: 10.7777/"), "p_type", F.lit(", and more"))
    group = entity.group_key(F.when(F.col("p_size") % 2 == 0, X.doi(b)), F.col("p_partkey").cast("string"))
    return part.select("p_partkey", X.doi(a).alias("a"), X.doi(b).alias("b"), X.locator_doi(b).alias("b_locator"), X.doi(c).alias("c"), X.locator_doi(c).alias("c_locator"), X.item_doi(F.lit("n/a"), extra).alias("extra"), group.alias("grp"))


@query("""
WITH s AS (SELECT s_suppkey AS k, right(s_name, 9) AS t FROM supplier), c AS (SELECT c_custkey AS k, right(c_name, 9) AS t FROM customer),
h AS (SELECT s.k, list_sort(list('own:c/' || c.k)) AS candidates FROM s JOIN c USING (t) GROUP BY 1)
SELECT 'Agent' AS class, 'ext:' || s.k AS pid, CASE WHEN len(candidates) = 1 THEN candidates[1] END AS matched, CASE WHEN candidates IS NULL THEN 'unmatched' WHEN len(candidates) = 1 THEN 'identifier' ELSE 'ambiguous' END AS how, coalesce(candidates, []) AS candidates FROM s LEFT JOIN h USING (k)
""")
def identity_match(spark, sf_dir):
    """Records matched by the tokens of their pids and identifiers; letters' case and a slash at the end don't count."""
    def side(table, key, name, prefix, mark):
        rows = read(spark, sf_dir, table)
        return rows.select(F.lit("Agent").alias("class"), F.concat(F.lit(prefix), key).alias("pid"), F.array(F.concat(F.lit(mark), F.substring(name, -9, 9)), F.lit(None)).alias("notes")).withColumn("tokens", X.identity_tokens(F.col("pid"), F.col("notes")))

    return resolve.match_records(side("supplier", "s_suppkey", "s_name", "ext:", "STRASSE "), side("customer", "c_custkey", "c_name", "own:c/", "straße "))


@query("""
WITH t AS (SELECT o_custkey AS item, o_orderpriority AS name FROM orders), x AS (SELECT * FROM (VALUES ('1urgent', 'top'), ('2high', 'top'), ('5low', 'low')) AS v(key, pid))
SELECT DISTINCT item, pid AS term, 'resolved' AS status FROM t JOIN x ON regexp_replace(lower(name), '[^0-9a-z]', '', 'g') = key
UNION SELECT DISTINCT item, name, 'unresolved' FROM t WHERE regexp_replace(lower(name), '[^0-9a-z]', '', 'g') NOT IN (SELECT key FROM x)
""")
def term_resolution(spark, sf_dir):
    """Terms by a vocabulary whose keys name one record each; 'shared' names two and none."""
    labels = local_rows(spark, [("top", ["1-URGENT", "2-High"]), ("low", ["5 low", "shared"]), ("other", ["Shared"])], "pid string, labels array<string>")
    terms = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), X.name_key(F.col("o_orderpriority")).alias("key"), F.col("o_orderpriority").alias("name"))
    found, lacking = resolve.resolve_terms(terms, ingest.name_index(labels))
    return found.select("item", F.col("pid").alias("term"), F.lit("resolved").alias("status")).union(lacking.select("item", F.col("name"), F.lit("unresolved")).distinct())


@query("""
SELECT l_orderkey, list_sort(list(CASE WHEN p_size <= 10 THEN 'part/' || l_partkey ELSE l_partkey::VARCHAR END)) AS targets, list_sort(list(DISTINCT 'role ' || l_returnflag)) AS roles,
  CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 'item:' || min(l_suppkey::VARCHAR) ELSE 'items:' || array_to_string(list_sort(list(DISTINCT l_suppkey::VARCHAR)), ',') END AS source_record_id FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def nested_references(spark, sf_dir):
    """References in arrays replaced by a record's own map, the roles that relations name, and the identity of a record of several items."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("object"), F.array(F.concat(F.lit("role "), "l_returnflag")).alias("roles"), F.col("l_suppkey").cast("string").alias("s"))
    moved = read(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").cast("string").alias("object"), F.concat(F.lit("part/"), "p_partkey").alias("new"))
    rows = lines.join(moved, "object", "left").groupBy("l_orderkey").agg(F.collect_list(F.struct("object", "roles")).alias("relations"), F.collect_set(F.when(F.col("new").isNotNull(), F.struct("object", "new"))).alias("moves"), F.collect_list("s").alias("keys"))
    targets_ = R.retargeted(F.transform("relations", lambda r: r["object"]), F.map_from_entries("moves"))
    return rows.select("l_orderkey", F.array_sort(targets_).alias("targets"), R.roles(F.col("relations")).alias("roles"), R.source_record_id(F.col("keys")).alias("source_record_id"))


@query("""
SELECT p_partkey::VARCHAR AS pid, unnest(CASE WHEN p_size % 7 = 0 THEN ['/' || p_partkey] ELSE list_filter([CASE WHEN p_size % 3 = 0 THEN '/' || p_partkey || '/name' END, CASE WHEN p_size % 2 = 0 THEN '/' || p_partkey || '/words/1' END, CASE WHEN p_size % 2 = 0 THEN '/' || p_partkey || '/words/2' END, CASE WHEN p_size % 5 = 0 THEN '/' || p_partkey || '/by/a~/x' END], lambda x: x IS NOT NULL) END) AS path FROM part
""")
def nested_containment(spark, sf_dir):
    """Pointers where records aren't contained in others: fields, lists as ordered subsequences, nested mappings, numbers by value."""
    part = read(spark, sf_dir, "part").withColumn("pid", F.col("p_partkey").cast("string"))
    record = lambda *fields: F.to_json(F.struct(*fields))
    size, nested = F.col("p_size"), lambda v: F.struct(F.struct(v.alias("x")).alias("a~"))
    reviewed = part.select("pid", record(F.col("p_name").alias("name"), F.array(F.lit("one"), F.lit("two"), F.lit("three")).alias("words"), nested(size).alias("by")).alias("record"))
    words = F.when(size % 2 == 0, F.array(F.lit("two"), F.lit("one"), F.lit("end"))).otherwise(F.array(F.lit("one"), F.lit("more"), F.lit("two"), F.lit("three")))
    actual = part.where("p_size % 7 <> 0").select("pid", record(F.when(size % 3 == 0, "another").otherwise(F.col("p_name")).alias("name"), words.alias("words"), nested(F.when(size % 5 == 0, size + 0.5).otherwise(size.cast("double"))).alias("by"), F.lit("further").alias("more")).alias("record"))
    return compare.projection_violations(reviewed, actual)


@query("""
WITH c AS (SELECT c_custkey AS k, c_acctbal < 0 AS known FROM customer),
r AS (SELECT 'Person' AS class, 'ext:person/' || k AS source_pid, CASE WHEN known THEN 'own:persons/' || k ELSE 'ext:person/' || k END AS pid, known, CASE WHEN known THEN 'Person/' || k || '.yaml' ELSE 'Person/ext-person-' || k || '.yaml' END AS path, NULL AS refs, NULL::VARCHAR AS identifier FROM c),
p AS (SELECT p_partkey AS k, 'own:publications/doi-10-1234-p' || p_partkey AS pid FROM part)
SELECT class, source_pid, pid, path, known AS matched, NULL::VARCHAR AS author, NULL::VARCHAR AS part_of, identifier FROM r
UNION ALL SELECT 'Publication', 'https://doi.org/10.1234/P' || p.k, p.pid, 'Publication/doi-10-1234-p' || p.k || '.yaml', false, CASE WHEN c.known THEN 'own:persons/' || c.k WHEN c.k IS NOT NULL THEN 'ext:person/' || c.k ELSE 'ext:person/' || p.k END, 'https://doi.org/10.1234/P' || p.k, 'https://doi.org/10.1234/P' || p.k FROM p LEFT JOIN c USING (k)
""")
def target_records(spark, sf_dir):
    """People and publications of a source matched with canonical ones, renamed, and their references retargeted."""
    customer, part = (spread(read(spark, sf_dir, t)) for t in ("customer", "part"))
    person = F.concat(F.lit("ext:person/"), "c_custkey")
    notes = F.array(F.struct(F.concat(F.lit("ID-"), "c_custkey").alias("notation")))
    people = customer.select(F.lit("Person").alias("class"), person.alias("pid"), F.to_json(F.struct(person.alias("pid"), notes.alias("identifiers"))).alias("record"))
    doi = F.concat(F.lit("https://doi.org/10.1234/P"), "p_partkey")
    # a mapping in a list of references stays as it is; the object of an attribution follows its record
    relations = F.struct(doi.alias("pid"), F.array(F.struct(F.concat(F.lit("ext:person/"), "p_partkey").alias("object"))).alias("attributed_to"), F.array(F.struct(doi.alias("object"))).alias("part_of"))
    publications = part.select(F.lit("Publication").alias("class"), doi.alias("pid"), F.to_json(relations).alias("record"))
    known = customer.where("c_acctbal < 0").select(F.lit("Person").alias("class"), F.concat(F.lit("own:persons/"), "c_custkey").alias("pid"), F.concat(F.lit("Person/"), "c_custkey", F.lit(".yaml")).alias("rel_path"), F.lower(F.to_json(F.struct(notes.alias("identifiers")))).alias("record"))
    out = targets.source_targets(people.union(publications), known, "own:", {"Publication": OWN})
    get = lambda path: F.get_json_object("record", path)
    return out.select("class", "source_pid", "pid", "path", F.col("baseline").isNotNull().alias("matched"), get("$.attributed_to[0].object").alias("author"), get("$.part_of[0].object").alias("part_of"), F.when(F.col("class") == "Publication", get("$.identifiers[0].notation")).alias("identifier"))


@query(f"""
WITH {_ITEMS},
src AS (SELECT *, right(date, 2)::INT % 3 AS c, coalesce(person < 25 AND person % 2 = 0, false) AS named, topic IN ('ECONOMY', 'SMALL') AS known FROM pub)
-- a new record asserts title, label, issue date, kind, topic, identifiers and attribution; where title and label are curated, the source's are asserted beside them
SELECT site AS pid, CASE WHEN c = 0 THEN 'add' ELSE 'modify' END AS operation, 'Publication/' || replace(site, 'own:publications/', '') || '.yaml' AS path, CASE WHEN c = 0 THEN title ELSE 'Curated' END AS title,
  (CASE WHEN c = 0 THEN 4 + known::INT + len(notations) + named::INT ELSE 2 END)::BIGINT AS owned, 3::BIGINT AS attributes, (CASE WHEN c = 0 AND doi IS NULL THEN 1 ELSE 0 END)::BIGINT AS single
FROM src WHERE c < 2
""")
def proposed_records(spark, sf_dir):
    """Proposals of rendered records by the day of issue: a third is new, a third has a curated title, a third stands there as it is."""
    rendered = _rendered(spark, sf_dir)["records"]
    c = F.substring(rendered["attributes"][0]["value"], -2, 2).cast("int") % 3
    path = F.concat(F.lit("Publication/"), F.replace("pid", F.lit(OWN), F.lit("")), F.lit(".yaml"))
    title = lambda name: F.when(c == 1, "Curated").otherwise(F.col(name)).alias(name)
    canonical = rendered.where(c > 0).select(*[title(n) if n in ("title", "display_label") else F.col(n) for n in rendered.columns], path.alias("rel_path"))
    empty = lambda ddl: local_rows(spark, [], ddl)
    notes = empty("pid string, path string, assertion_sha256 string, imported_by string, imported_from string")
    agents = local_rows(spark, [("own:adapter", "Instrument")], "pid string, class string")
    plan = publish.proposals(rendered, canonical, notes, empty("pid string, claim_sha256 string"), "own:adapter", agents, OPTIONS.group)
    single = (F.col("operation") == "add") & F.col("source_record_id").startswith("item:") & ~F.col("pid").contains("/doi-")
    return plan.select("pid", "operation", "path", F.col("record.title").alias("title"), F.size("companion").cast("long").alias("owned"), F.size("record.attributes").cast("long").alias("attributes"), single.cast("long").alias("single"))


@query(f"""
WITH {_ITEMS}
SELECT site AS pid, 'records/Publication/' || replace(site, 'own:publications/', '') || '.yaml' AS file, 'add' AS operation FROM pub
UNION ALL SELECT site, 'annotations/Publication/' || replace(site, 'own:publications/', '') || '.yaml', 'add' FROM pub
""")
def proposed_files(spark, sf_dir):
    """The files that accepting all rendered records as new ones would write."""
    rendered = _rendered(spark, sf_dir)["records"]
    empty = lambda ddl: local_rows(spark, [], ddl)
    canonical = rendered.limit(0).withColumn("rel_path", F.lit(None).cast("string"))
    notes = empty("pid string, path string, assertion_sha256 string, imported_by string, imported_from string")
    agents = local_rows(spark, [("own:adapter", "Instrument")], "pid string, class string")
    return publish.file_changes(publish.proposals(rendered, canonical, notes, empty("pid string, claim_sha256 string"), "own:adapter", agents, OPTIONS.group))


@query("""
SELECT o_orderkey, 'a%20' || replace(o_orderpriority, ' ', '%20') AS encoded, 'a ' || o_orderpriority AS decoded, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
  list_filter(['1' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || '-567X'], lambda x: o_orderkey % 3 = 0) AS issns, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey::VARCHAR END AS pmid,
  list_filter(['978316148' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0')], lambda x: o_orderkey % 4 = 0) AS isbns FROM orders
""")
def field_codes(spark, sf_dir):
    """Percent escapes, dates, ISSNs, ISBNs and labelled lines of fields."""
    orders, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    some = lambda n, value: F.when(key % n == 0, value).otherwise("none")
    pad = lambda n, width: F.lpad((key % n).cast("string"), width, "0")
    day = F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    issn = some(3, F.concat(F.lit("print 1"), pad(1000, 3), F.lit("-567x; again 1"), pad(1000, 3), F.lit("-567X, no 12345-6789")))
    isbn = some(4, F.concat(F.lit("978-3-16-148 "), pad(10000, 4)))
    pmid = F.when(key % 5 == 0, F.concat(F.lit("note\npmid:  "), "o_custkey", F.lit(" \nmore"))).otherwise(F.concat(F.lit("see PMID: "), "o_custkey"))
    return orders.select("o_orderkey", X.percent_encoded(F.concat(F.lit("a "), "o_orderpriority")).alias("encoded"), X.percent_decoded(F.concat(F.lit("a%20"), "o_orderpriority")).alias("decoded"), X.full_date(day).alias("day"), X.issns(issn).alias("issns"), X.labelled_line(pmid, "PMID").alias("pmid"), X.isbns(isbn).alias("isbns"))


@query("""
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'doi-10-1234-s' || s_suppkey WHEN 1 THEN 'issn-' || lpad(s_suppkey::VARCHAR, 4, '0') WHEN 2 THEN 'grosse-' || s_suppkey WHEN 3 THEN 'ror-0' || s_suppkey ELSE 'ext-x-' || s_suppkey END AS stem,
  CASE s_suppkey % 5 WHEN 2 THEN 'own:a/Große ' || s_suppkey WHEN 0 THEN 'own:v/doi-10-1234-s' || s_suppkey WHEN 1 THEN 'own:v/issn-' || lpad(s_suppkey::VARCHAR, 4, '0') WHEN 3 THEN 'own:v/ror-0' || s_suppkey ELSE 'own:v/ext-x-' || s_suppkey END AS minted,
  CASE WHEN s_suppkey % 3 = 0 THEN ['n1', 'own'] ELSE ['n1', 'n2', 'own'] END AS identifiers FROM supplier
""")
def minted_names(spark, sf_dir):
    """File stems and minted pids of records, and an identifier added unless it is there."""
    rows = read(spark, sf_dir, "supplier")
    k, key = F.col("s_suppkey") % 5, F.col("s_suppkey").cast("string")
    pid = F.when(k == 0, F.concat(F.lit("https://doi.org/10.1234/S"), key)).when(k == 1, F.concat(F.lit("issn:"), F.lpad(key, 4, "0"))).when(k == 2, F.concat(F.lit("own:a/Große "), key)).when(k == 3, F.concat(F.lit("ROR:0"), key)).otherwise(F.concat(F.lit("ext:x/"), key))
    one = lambda n: F.struct(F.lit(n).alias("notation"), F.lit("t").alias("schema_type"))
    held = F.when(F.col("s_suppkey") % 3 == 0, F.array(one("n1"), one("own"))).otherwise(F.array(one("n1"), one("n2")))
    return rows.select("s_suppkey", X.record_stem(pid, "own:").alias("stem"), R.minted_pid(F.lit("Venue"), pid, "own:", {"Venue": "own:v/"}).alias("minted"), F.transform(R.with_identifier(held, F.lit("own"), "t"), lambda i: i["notation"]).alias("identifiers"))


@query("""
WITH RECURSIVE k AS (SELECT p_partkey AS k, p_size AS size, lower(p_type) AS type FROM part),
edges AS (SELECT 'C' || k AS class, 0 AS turn, 'M' || size % 5 AS up FROM k UNION ALL SELECT 'C' || a.k, 9, 'C' || b.k FROM k a JOIN k b ON b.k = a.k // 2 AND b.k < a.k UNION ALL SELECT 'M' || i, 9, 'M0' FROM (SELECT DISTINCT size % 5 AS i FROM k) WHERE i > 0),
lines AS (SELECT DISTINCT class, class AS ancestor, []::INT[] AS line FROM (SELECT class FROM edges UNION ALL SELECT 'M0') UNION ALL SELECT l.class, e.up, l.line || [e.turn] FROM lines l JOIN edges e ON e.class = l.ancestor),
near AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY len(line), line) AS n FROM lines),
holds AS (SELECT 'C' || k AS ancestor, type AS slot FROM k WHERE size % 3 = 0 UNION ALL SELECT 'M0', 'mixed'),
had AS (SELECT class, slot, arg_min(ancestor, n) AS declared_by FROM near JOIN holds USING (ancestor) GROUP BY 1, 2),
usage AS (SELECT 'C' || k AS ancestor, type AS slot, 'u:' || k AS uri, CASE WHEN size % 2 = 0 THEN 'C' || k ELSE NULL END AS range FROM k WHERE size % 7 = 0),
said AS (SELECT class, slot, arg_min(uri, n) AS uri, arg_min(range, n) FILTER (range IS NOT NULL) AS range FROM near JOIN usage USING (ancestor) GROUP BY 1, 2)
SELECT class, slot, coalesce(uri, 'x:' || slot) AS predicate, coalesce(range, 'string') AS range, slot <> 'mixed' AND length(slot) % 2 = 0 AS multivalued, slot = 'mixed' AS required, range IS NOT NULL AS is_object, declared_by
FROM had LEFT JOIN said USING (class, slot)
""")
def induced_slots(spark, sf_dir):
    """Slots of a hierarchy of classes, a class to each part below half its number, with mixins and overrides."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.lower("p_type").alias("type"))
    name = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    numbers = part.select(F.col("k").alias("half"))
    own, half = name("C", F.col("k")), F.floor(F.col("k") / 2)
    below = part.join(numbers, (F.col("half") == half) & (half < F.col("k")), "left")
    mixins = part.select((F.col("size") % 5).alias("i")).union(spark.range(1).select(F.lit(0).alias("i"))).distinct()
    classes = below.select(own.alias("class"), name("C", F.col("half")).alias("is_a"), F.array(name("M", F.col("size") % 5)).alias("mixins"))
    classes = classes.union(mixins.select(name("M", F.col("i")), F.when(F.col("i") > 0, "M0"), F.array().cast("array<string>")))
    fixed = F.col("slot") == "mixed"
    slots = part.select(F.col("type").alias("slot")).distinct().union(spark.range(1).select(F.lit("mixed")))
    slots = slots.select("slot", F.concat(F.lit("x:"), "slot").alias("slot_uri"), F.lit("string").alias("range"), (~fixed & (F.length("slot") % 2 == 0)).alias("multivalued"), F.when(fixed, True).alias("required"))
    holds = part.where("size % 3 = 0").select(own.alias("class"), F.col("type").alias("slot")).union(spark.range(1).select(F.lit("M0"), F.lit("mixed")))
    nothing = F.lit(None).cast("boolean")
    usage = part.where("size % 7 = 0").select(own.alias("class"), F.col("type").alias("slot"), name("u:", F.col("k")).alias("slot_uri"), F.when(F.col("size") % 2 == 0, own).alias("range"), nothing.alias("multivalued"), nothing.alias("required"))
    return schema.induced_slots(classes, slots, holds, usage, "x:")


@query("""
WITH c AS (SELECT c_custkey AS k, c_name AS name, c_acctbal < 0 AS known FROM customer)
-- a known person: curated names get the source's beside them, and an old description of the owner goes; others are new
SELECT 'Person' AS class, CASE WHEN known THEN 'own:persons/' || k ELSE 'ext:person/' || k END AS pid, CASE WHEN known THEN 'modify' ELSE 'add' END AS operation, CASE WHEN known THEN 'Person/' || k || '.yaml' ELSE 'Person/ext-person-' || k || '.yaml' END AS path,
  'https://example.org/source/blob/main/data/people/Person.json#record=ext%3Aperson%2F' || k AS imported_from, CASE WHEN known AND k % 2 = 1 THEN 'Curated' ELSE name END AS label, (CASE WHEN NOT known THEN 2 ELSE k % 2 END)::BIGINT AS owned, (CASE WHEN known AND k % 2 = 1 THEN 2 ELSE 1 END)::BIGINT AS attributes, NULL::VARCHAR AS author
FROM c WHERE NOT known OR k % 2 = 1 OR k % 3 = 0
UNION ALL SELECT 'Publication', 'own:publications/doi-10-1234-p' || p_partkey, 'add', 'Publication/doi-10-1234-p' || p_partkey || '.yaml', 'https://example.org/source/blob/main/data/people/Publication.json#record=https%3A%2F%2Fdoi.org%2F10.1234%2FP' || p_partkey, p_name, 4, 1,
  CASE WHEN known THEN 'own:persons/' || k ELSE 'ext:person/' || p_partkey END FROM part LEFT JOIN c ON k = p_partkey
UNION ALL SELECT 'Role', 'ext:role/' || s_suppkey, 'add', 'Role/ext-role-' || s_suppkey || '.yaml', 'https://example.org/source/blob/main/data/pool/Role.json#record=ext%3Arole%2F' || s_suppkey, s_name, 1, 1, NULL FROM supplier WHERE s_suppkey % 2 = 1
""")
def proposed_claims(spark, sf_dir):
    """What accepting people, publications and roles of a source would change in canonical records, over source_targets."""
    customer, part, supplier = (spread(read(spark, sf_dir, t)) for t in ("customer", "part", "supplier"))
    k, person = F.col("c_custkey"), F.concat(F.lit("ext:person/"), "c_custkey")
    notes = F.array(F.struct(F.concat(F.lit("ID-"), "c_custkey").alias("notation")))
    record = lambda *fields: F.to_json(F.struct(*fields)).alias("record")
    people = customer.select(F.lit("Person").alias("class"), person.alias("pid"), record(person.alias("pid"), F.col("c_name").alias("given_name"), notes.alias("identifiers")))
    doi = F.concat(F.lit("https://doi.org/10.1234/P"), "p_partkey")
    by = F.array(F.struct(F.concat(F.lit("ext:person/"), "p_partkey").alias("object")))
    papers = part.select(F.lit("Publication").alias("class"), doi.alias("pid"), record(doi.alias("pid"), F.col("p_name").alias("title"), by.alias("attributed_to"), F.array(F.lit("t:1")).alias("about")))
    role = F.concat(F.lit("ext:role/"), "s_suppkey")
    roles = supplier.select(F.lit("Role").alias("class"), role.alias("pid"), record(role.alias("pid"), F.lit("Role").alias("schema_type"), F.col("s_name").alias("title")))

    attribute = lambda predicate, value: F.struct(F.lit(predicate).alias("predicate"), F.lit("dlthings:AttributeSpecification").alias("schema_type"), value.alias("value"))
    name, old = F.when(k % 2 == 1, "Curated").otherwise(F.col("c_name")), attribute("dcterms:description", F.lit("Old"))
    held = F.concat(F.array(attribute("dlthings:given_name", name)), F.when(k % 3 == 0, F.array(old)).otherwise(F.array_remove(F.array(old), old)))
    known = customer.where("c_acctbal < 0").withColumn("own", F.concat(F.lit("own:persons/"), "c_custkey"))
    canonical = known.select(F.lit("Person").alias("class"), F.col("own").alias("pid"), F.concat(F.lit("Person/"), "c_custkey", F.lit(".yaml")).alias("rel_path"), record(F.col("own").alias("pid"), F.lit("Person").alias("schema_type"), name.alias("given_name"), notes.alias("identifiers"), held.alias("attributes")))
    canonical = canonical.union(roles.where("pid RLIKE '[02468]$'").select("class", "pid", F.concat(F.replace("pid", F.lit("ext:role/"), F.lit("Role/")), F.lit(".yaml")), "record"))
    owned = known.where(k % 3 == 0).select(F.col("own").alias("pid"), F.lit("/attributes").alias("path"), R.digest(F.to_json(old)).alias("assertion_sha256"), F.lit("own:adapter").alias("imported_by"), F.lit("before").alias("imported_from"))

    rows = lambda ddl, *x: local_rows(spark, x, ddl)
    slots = schema.induced_slots(
        rows("class string, is_a string, mixins array<string>", ("Thing", None, []), ("Person", "Thing", []), ("Publication", "Thing", []), ("Role", "Thing", [])),
        rows("slot string, slot_uri string, range string, multivalued boolean, required boolean", ("title", None, "string", False, False), ("description", "dcterms:description", "string", False, False), ("given_name", None, "string", False, False), ("about", "dcterms:subject", "Thing", True, False)),
        rows("class string, slot string", ("Thing", "title"), ("Thing", "description"), ("Thing", "about"), ("Person", "given_name")),
        rows("class string, slot string, slot_uri string, range string, multivalued boolean, required boolean"),
        "dlthings:",
    )
    found = targets.source_targets(people.union(papers).union(roles), canonical, "own:", {"Publication": OWN}).withColumn("directory", F.when(F.col("class") == "Role", "data/pool").otherwise("data/people"))
    plan = claims.candidates(found, owned, rows("pid string, claim_sha256 string"), rows("pid string, class string", ("own:adapter", "Instrument")), slots, "own:adapter", "https://example.org/source", "data/pool")
    get = lambda path: F.get_json_object("record", path)
    label = F.coalesce(get("$.given_name"), get("$.title"))
    return plan.select("class", "pid", "operation", "path", "imported_from", label.alias("label"), F.coalesce(F.size("companion"), F.lit(0)).cast("long").alias("owned"), F.size(F.from_json(get("$.attributes"), "array<string>")).cast("long").alias("attributes"), get("$.attributed_to[0].object").alias("author"))


@query("""
WITH s AS (SELECT CASE s_nationkey % 2 WHEN 0 THEN 'A' ELSE 'B' END AS class, 's' || s_suppkey AS pid, 'all' AS shared, 'k' || s_suppkey AS own FROM supplier),
c AS (SELECT CASE c_nationkey % 2 WHEN 0 THEN 'A' ELSE 'C' END AS class, CASE WHEN c_custkey % 50 = 0 THEN 's' || (c_custkey // 50) ELSE 'c' || c_custkey END AS pid, CASE WHEN c_nationkey % 2 = 0 THEN 'all' END AS shared, 'k' || c_custkey AS own FROM customer),
a AS (SELECT min(pid) AS least, max(pid) AS most FROM c WHERE class = 'A')
SELECT s.class, s.pid, CASE WHEN e.class = s.class THEN s.pid WHEN e.class IS NULL AND s.class = 'A' AND least = most THEN least END AS matched,
  CASE WHEN e.class = s.class THEN 'pid' WHEN e.class IS NOT NULL THEN 'class-conflict' WHEN s.class = 'A' AND least IS NOT NULL THEN CASE WHEN least = most THEN 'identifier' ELSE 'ambiguous' END ELSE 'unmatched' END AS how,
  CASE WHEN e.class IS NULL AND s.class = 'A' AND least < most THEN [least, most] WHEN e.class IS NULL AND s.class = 'A' AND least = most THEN [least] ELSE [] END AS candidates
FROM s LEFT JOIN c e ON e.pid = s.pid CROSS JOIN a
""")
def token_outcomes(spark, sf_dir):
    """Suppliers against customers by a token that all of a class share, and one of their own."""
    def side(table, key, nation, other, pid):
        even = F.col(nation) % 2 == 0
        shared = F.when(even, "all").otherwise(None if other == "C" else "all")
        tokens = F.array_compact(F.array(shared, F.concat(F.lit("k"), key)))
        return read(spark, sf_dir, table).select(F.when(even, "A").otherwise(other).alias("class"), pid.alias("pid"), tokens.alias("tokens"))

    source = side("supplier", "s_suppkey", "s_nationkey", "B", F.concat(F.lit("s"), "s_suppkey"))
    number = F.floor(F.col("c_custkey") / 50)
    target = side("customer", "c_custkey", "c_nationkey", "C", F.when(F.col("c_custkey") % 50 == 0, F.concat(F.lit("s"), number.cast("string"))).otherwise(F.concat(F.lit("c"), "c_custkey")))
    return resolve.match_outcomes(source, target)


@query("""
WITH c AS (SELECT c_custkey AS k, 'c' || c_custkey AS pid, c_nationkey AS n, c_mktsegment AS seg FROM customer)
SELECT pid, 'x:name' AS predicate, 'too few' AS problem, '0' AS value FROM c WHERE k % 5 = 0
UNION ALL SELECT pid, 'x:segment', 'too many', '2' FROM c WHERE k % 3 = 0
UNION ALL SELECT pid, 'x:balance', 'another kind', 'unknown' FROM c WHERE k % 7 = 0
UNION ALL SELECT pid, 'x:nation', 'another class', pid FROM c WHERE k % 11 = 0
UNION ALL SELECT pid, 'x:nation', 'no record', 'n0' FROM c WHERE k % 11 <> 0 AND n = 0
UNION ALL SELECT pid, 'color', 'no shape', 'red' FROM c WHERE k % 13 = 0
UNION ALL SELECT 'n' || n_nationkey, 'x:code', 'too many', '2' FROM nation WHERE n_nationkey > 0 AND n_nationkey % 4 = 2
UNION ALL SELECT 'n' || n_nationkey, 'x:code', 'another kind', '{"a":1}' FROM nation WHERE n_nationkey % 4 = 1
UNION ALL SELECT 'n' || n_nationkey, 'x:code', 'another kind', 'c1' FROM nation WHERE n_nationkey > 0 AND n_nationkey % 4 = 2
""")
def shape_violations(spark, sf_dir):
    """People and nations as statements against shapes: cardinality, kinds, references, classes and predicates without a shape."""
    k = F.col("c_custkey")
    own, nation = F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")
    segment = F.when(k % 3 == 0, F.array("c_mktsegment", F.lit("second"))).otherwise(F.array("c_mktsegment"))
    balance = F.when(k % 7 == 0, F.to_variant_object(F.array(F.lit("unknown")))).otherwise(F.to_variant_object(F.array("c_acctbal")))
    person = F.to_json(F.struct(F.when(k % 5 != 0, F.col("c_name")).alias("name"), F.when(k % 11 == 0, own).otherwise(nation).alias("nation"), segment.alias("segment"), balance.alias("balance"), F.when(k % 13 == 0, "red").alias("color")))
    people = read(spark, sf_dir, "customer").select(F.lit("Person").alias("class"), own.alias("pid"), person.alias("record"))
    code = F.when(F.col("n_nationkey") % 4 == 1, '[{"a": 1}]').when(F.col("n_nationkey") % 4 == 2, '[true, {"object": "c1"}]').otherwise("null")
    nations = read(spark, sf_dir, "nation").where("n_nationkey > 0").select(F.lit("Nation").alias("class"), F.concat(F.lit("n"), "n_nationkey").alias("pid"), F.concat(F.lit('{"code": '), code, F.lit("}")).alias("record"))
    records = people.union(nations)
    rows = lambda ddl, *x: local_rows(spark, x, ddl)
    slots = rows("class string, slot string, predicate string, is_object boolean", ("Person", "name", "x:name", False), ("Person", "nation", "x:nation", True), ("Person", "segment", "x:segment", False), ("Person", "balance", "x:balance", False), ("Nation", "code", "x:code", False))
    shapes = rows("class string, predicate string, least int, most int, kind string, object_class string", ("Person", "x:name", 1, 1, "text", None), ("Person", "x:nation", 1, None, "reference", "Nation"), ("Person", "x:segment", None, 1, None, None), ("Person", "x:balance", None, None, "number", None), ("Nation", "x:code", 0, 1, "boolean", None))
    return graph.shape_violations(graph.statements(records, slots), records.select("class", "pid"), shapes)


@query("""
WITH RECURSIVE c AS (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal AS b FROM customer),
e AS (SELECT k, 'boss' AS field, 0 AS rank, k // 2 AS target FROM c UNION ALL SELECT k, 'peer', 1, xor(k, 1) FROM c),
w AS (SELECT 'n' || n AS page, [row_number() OVER (PARTITION BY n ORDER BY b, k)] AS place, k, NULL::VARCHAR AS field, 'embedded' AS status, [k] AS line, 0 AS depth FROM c WHERE b > 0 AND k % 10 <> 9
  UNION ALL SELECT w.page, w.place || [e.rank], e.target, e.field, CASE WHEN e.target % 10 = 9 THEN 'missing' WHEN list_contains(w.line, e.target) THEN 'cycle' ELSE 'embedded' END, w.line || [e.target], w.depth + 1
  FROM w JOIN e ON e.k = w.k WHERE w.status = 'embedded' AND w.depth < 3)
SELECT page, array_to_string(place, '.') AS place, 'c' || k AS pid, field, status FROM w
""")
def site_pages(spark, sf_dir):
    """Nations' pages of customers by balance, with a superior and a peer of each embedded three levels deep."""
    every = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("b"))
    pid = lambda k: F.concat(F.lit("c"), k.cast("string"))
    known = every.where("k % 10 <> 9")
    place = F.row_number().over(Window.partitionBy("n").orderBy("b", "k"))
    members = known.where("b > 0").select(F.concat(F.lit("n"), "n").alias("page"), place.alias("pos"), pid(F.col("k")).alias("pid"))
    boss, peer = F.expr("k div 2"), F.col("k").bitwiseXOR(F.lit(1))
    edge = lambda field, target: every.select(pid(F.col("k")).alias("pid"), F.lit(field).alias("field"), F.lit(0).cast("long").alias("n"), pid(target).alias("target"))
    out = site.pages(members, edge("boss", boss).union(edge("peer", peer)), known.select(pid(F.col("k")).alias("pid")), 3)
    return out.select("page", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"), "pid", "field", "status")
