"""The queries of the metadata operators (those of whole plans are in plan_queries) on the driver's tables, each with its DuckDB oracle where SQL can express it.

documents stand for source items, labels for curation, documents.source for collections, nation and region for
controlled vocabularies, customer and supplier for organizations and people, orders and lineitem for references, part
for instruments, events for snapshots and decisions, pages.url for locators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import records as R
from .functions import text as X
from .operators import compare, entity, merge, resolve, validate
from .plans import ingest
from .vocabulary import Options

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import plan_queries  # noqa: F401  (registers its own)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import plan_queries  # noqa: F401

    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text_key(text):
    """Letters and digits of ASCII, lower-cased: the key of equal texts."""
    return F.regexp_replace(F.lower(text), "[^0-9a-z]", "")


# A group of all documents whose texts agree is one row; long texts are grouped by their digest.
_KEY_SQL = "sha256(regexp_replace(lower(text), '[^0-9a-z]', '', 'g'))"


def _keyed(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.withColumn("key", F.sha2(_text_key(F.col("text")), 256))


@query(f"""
WITH d AS (SELECT {_KEY_SQL} AS key, doc_id, source, lang, n_chars, coalesce(quality, -1) AS q FROM documents LEFT JOIN labels USING (doc_id))
SELECT key, arg_max(doc_id, (q, n_chars, -doc_id)) AS doc_id, arg_max(source, (q, n_chars, -doc_id)) AS source, arg_max(lang, (q, n_chars, -doc_id)) AS lang FROM d GROUP BY key
""")
def representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _keyed(spark, sf_dir).join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    docs = docs.withColumn("q", F.coalesce(F.col("quality").cast("long"), F.lit(-1)))
    return entity.representative(docs, "key", ["doc_id", "source", "lang"], [F.col("q"), F.col("n_chars"), -F.col("doc_id")])


@query("SELECT 'region' AS class, 'region:' || r_regionkey AS pid, r_name AS name FROM region UNION ALL SELECT 'nation', 'nation:' || n_nationkey, n_name FROM nation")
def tagged_union(spark, sf_dir):
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    one = region.select(F.lit("region").alias("class"), F.concat(F.lit("region:"), "r_regionkey").alias("pid"), F.col("r_name").alias("name"))
    return one.unionByName(nation.select(F.lit("nation").alias("class"), F.concat(F.lit("nation:"), "n_nationkey").alias("pid"), F.col("n_name").alias("name")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.none'), json_extract_string(props, '$.k'), '') AS key FROM events")
def json_field(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(F.get_json_object("props", "$.none"), k, F.lit("")).alias("key"))


@query(r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'))::BIGINT AS n, sha256(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def clean_text(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("clean", X.clean(F.col("text")))
    return docs.select("doc_id", F.char_length("clean").cast("long").alias("n"), F.sha2("clean", 256).alias("digest"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') AS key FROM part")
def name_key(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.name_key_ascii(F.col("p_name")).alias("key"))


# The letters of the driver's tables fold by taking off accents and writing sharp s out.
@query("SELECT doc_id, sha256(regexp_replace(replace(strip_accents(lower(coalesce(text, ''))), 'ß', 'ss'), '[^0-9a-z]', '', 'g')) AS digest FROM documents")
def name_key_unicode(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(X.name_key(F.col("text")), 256).alias("digest"))


@query(r"""
WITH l AS (SELECT c_custkey, regexp_replace(lower(trim(c_mktsegment || '  ' || c_name)), '\s+', ' ', 'g') AS x FROM customer)
SELECT c_custkey, CASE WHEN starts_with(x, 'building ') THEN substr(x, 10) ELSE x END AS label FROM l
""")
def label_normalize(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", X.label_key(F.concat("c_mktsegment", F.lit("  "), "c_name"), "building ").alias("label"))


@query("SELECT p_partkey, concat_ws(' ', nullif(trim(p_brand), ''), nullif(trim(p_name), '')) AS name, concat_ws(', ', nullif(trim(p_type), ''), nullif('', ''), p_size::VARCHAR) AS locator FROM part")
def composed_name(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", X.person_name(F.lit(""), F.col("p_brand"), F.col("p_name")).alias("name"), X.joined(", ", F.col("p_type"), F.lit(""), F.col("p_size")).alias("locator"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '/+$', ''), '^https?://(www\.)?', '') AS locator FROM pages")
def locator_normalize(spark, sf_dir):
    low = F.regexp_replace(X.folded(X.clean(F.col("url"))), "/+$", "")
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(low, r"^https?://(www\.)?", "").alias("locator"))


_MAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"


@query(f"""
WITH c AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '{_MAIL}'), lambda x: upper(x)))) AS codes FROM documents)
SELECT doc_id, codes, len(codes)::BIGINT AS n FROM c WHERE len(codes) > 0
""")
def code_extract(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", X.codes(F.col("text"), _MAIL).alias("codes"))
    return docs.where(F.size("codes") > 0).withColumn("n", F.size("codes").cast("long"))


@query()
def code_extract_lookaround(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", X.isbns(F.col("text")).alias("isbns"), X.issns(F.col("text")).alias("issns"), X.labelled_line(F.col("text"), "PMID").alias("pmid"))


@query("""
SELECT p_partkey, u.predicate, u.value FROM (SELECT p_partkey, unnest([{'predicate': 'brand', 'value': p_brand}, {'predicate': 'type', 'value': p_type}, {'predicate': 'size', 'value': p_size::VARCHAR}]) AS u FROM part) WHERE coalesce(u.value, '') <> ''
""")
def attribute_unpivot(spark, sf_dir):
    rows = R.attribute_rows([("brand", F.col("p_brand")), ("type", F.col("p_type")), ("size", F.col("p_size"))])
    return read(spark, sf_dir, "part").select("p_partkey", F.inline(rows))


@query("""
SELECT doc_id, CASE WHEN lang <> 'en' THEN 'publication' WHEN quality = 0 AND toxic = 1 THEN NULL WHEN quality = 1 THEN 'dataset' WHEN quality = 0 THEN 'instrument' ELSE 'document' END AS class,
CASE WHEN lang = 'en' AND quality = 0 AND toxic = 1 THEN 'conflicting collection classification' END AS reason FROM documents LEFT JOIN labels USING (doc_id)
""")
def classify_case(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    keys = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("quality") == 0, "poor"), F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "toxic"), F.lit("other")))
    rows = docs.select("doc_id", F.when(F.col("lang") != "en", "book").otherwise("document").alias("itemType"), keys.alias("label_keys"))
    options = Options(group=7, document_classes={"good": "dataset", "poor": "instrument", "toxic": "registry"})
    return ingest.classify(rows, options).select("doc_id", F.lower("class").alias("class"), "reason")


@query("""
SELECT doc_id, ((text <> '')::INT + (lang <> '')::INT + (source <> '')::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + least(n_chars, 10) + CASE WHEN lang = 'en' THEN 0 ELSE 100 END)::BIGINT AS score FROM documents LEFT JOIN labels USING (doc_id)
""")
def completeness_score(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    score = R.score([F.col(c) for c in ("text", "lang", "source", "quality", "toxic")], F.col("n_chars"), F.col("lang") == "en")
    return docs.select("doc_id", score.cast("long").alias("score"))


@query(r"SELECT p_partkey, 'part/' || regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS pid FROM part")
def slug_pid(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("part/"), X.slug(F.concat_ws(" ", "p_brand", "p_name"))).alias("pid"))


@query("""
SELECT l_orderkey, list_sort(list(l_partkey::VARCHAR) FILTER (WHERE l_returnflag = 'R')) AS returned, count(*)::BIGINT AS n FROM lineitem GROUP BY 1
""")
def typed_array(spark, sf_dir):
    lists = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.collect_list(F.when(rule, F.struct(F.col("l_partkey").cast("string").alias("notation")))).alias(name) for name, rule in (("yes", F.col("l_returnflag") == "R"), ("no", F.col("l_returnflag") != "R"))])
    rows = lists.withColumn("identifiers", F.concat(R.typed(F.col("yes"), "R"), R.typed(F.col("no"), "other")))
    found = F.array_sort(R.notations(F.col("identifiers"), "R"))
    return rows.select("l_orderkey", F.when(F.size(found) > 0, found).alias("returned"), F.size("identifiers").cast("long").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN p_size <= 10 THEN 'part/' || l_partkey ELSE l_partkey::VARCHAR END AS object FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
""")
def retarget(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("object"))
    pid_map = read(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").cast("string").alias("old"), F.concat(F.lit("part/"), "p_partkey").alias("new"))
    return resolve.retarget(edges, pid_map, "object")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal < 0)")
def role_closure(spark, sf_dir):
    used = read(spark, sf_dir, "supplier").select(F.array("s_nationkey").alias("refs")).unionByName(read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.array("c_nationkey").alias("refs")))
    return resolve.dependencies(used, read(spark, sf_dir, "nation"), "refs", "n_nationkey")[0].select("n_nationkey", "n_name")


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN 'selected' WHEN user_id % 10 = 0 THEN 'unfiled' ELSE 'excluded' END AS bucket, count(*)::BIGINT AS n FROM events GROUP BY 1")
def bucket_route(spark, sf_dir):
    names = F.when(F.col("event_type").isin("click", "view"), F.array(F.lit("in"))).when(F.col("user_id") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("out")))
    items = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("key"), F.lit(False).alias("deleted"), names.alias("collections"), F.lit(None).cast("string").alias("DOI"), F.lit(None).cast("string").alias("extra"))
    collections = spark.createDataFrame([("in", "My Papers"), ("out", "Other")], "key string, name string")
    rows = ingest.source_items(items, collections, Options(group=7, included=("papers",), label_prefix="my "))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'unsupported role' AS code, event_id::VARCHAR AS pid, event_type AS detail FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')")
def domain_violations(spark, sf_dir):
    allowed = spark.createDataFrame([("click",), ("view",), ("purchase",)], "role string")
    rows = validate.outside(read(spark, sf_dir, "events"), "event_type", F.broadcast(allowed), "role")
    return validate.violations(rows, "unsupported role", F.col("event_id"), F.col("event_type"))


@query("SELECT o_orderpriority, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'keep' WHEN o_orderpriority = '5-LOW' THEN 'omit' ELSE 'unreviewed' END AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2")
def allow_omit_list(spark, sf_dir):
    allowed = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "target string")
    omitted = spark.createDataFrame([("5-LOW",)], "target string")
    rows = validate.judged(read(spark, sf_dir, "orders").select("o_orderpriority"), "o_orderpriority", F.broadcast(allowed), F.broadcast(omitted), "target")
    return rows.groupBy("o_orderpriority", "status").agg(F.count(F.lit(1)).alias("n"))


_HALVES = "SELECT user_id AS k, max(CASE WHEN event_id % 2 = 0 THEN event_type END) AS b, max(CASE WHEN event_id % 2 = 1 THEN event_type END) AS a FROM events GROUP BY 1"


@query(f"SELECT k, a, b FROM ({_HALVES}) WHERE a IS DISTINCT FROM b")
def noop_suppress(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    half = lambda i: F.max(F.when(F.col("event_id") % 2 == i, F.col("event_type")))
    both = events.groupBy(F.col("user_id").alias("k")).agg(half(1).alias("a"), half(0).alias("b"))
    return compare.changed_only(both, F.col("a"), F.col("b")).select("k", "a", "b")


@query("SELECT d.doc_id, [coalesce(n.n_name, '[unknown:' || (d.doc_id % 40) || ']')] AS names FROM documents d LEFT JOIN nation n ON d.doc_id % 40 = n.n_nationkey")
def lookup_default(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.array((F.col("doc_id") % 40).cast("string"), (F.col("doc_id") % 40).cast("string")).alias("keys"))
    names = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), "n_name")
    return resolve.named(docs, "keys", names, "key", "n_name", "names", "doc_id").select("doc_id", "names")


@query("""
WITH c AS (SELECT c_custkey AS item, c_nationkey AS k, c_acctbal < 0 AS single FROM customer),
ali AS (SELECT n_nationkey AS k, 'reviewed' || n_nationkey AS pid FROM nation WHERE n_regionkey IN (2, 4)),
org AS (SELECT s_nationkey AS k, min(s_suppkey) AS pid FROM supplier WHERE s_acctbal > 0 GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1),
per AS (SELECT n_nationkey AS k, 'nation' || n_nationkey AS pid FROM nation WHERE n_regionkey < 3),
r AS (SELECT item, coalesce(ali.pid, CASE WHEN NOT single THEN per.pid WHEN per.pid IS NULL THEN 'supplier' || org.pid WHEN org.pid IS NULL THEN per.pid END) AS pid
FROM c LEFT JOIN ali USING (k) LEFT JOIN org USING (k) LEFT JOIN per USING (k))
SELECT item, 0 AS pos, pid, 'aut' AS role FROM r WHERE pid IS NOT NULL
""")
def priority_resolve(spark, sf_dir):
    """Creators by reviewed aliases, people and organizations; some aliases stand before a person or an organization of the same key."""
    customer, supplier, nation = (read(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    creators = customer.select(F.col("c_custkey").alias("item"), F.lit(0).alias("pos"), F.col("c_nationkey").cast("string").alias("key"), (F.col("c_acctbal") < 0).alias("single_field"), F.lit("aut").alias("role"), F.col("c_name").alias("name"))
    orgs = resolve.unique_index(supplier.where("s_acctbal > 0").select(F.col("s_nationkey").cast("string").alias("key"), F.concat(F.lit("supplier"), "s_suppkey").alias("pid")), "key", "pid")
    aliases, people = (nation.where(rule).select(F.col("n_nationkey").cast("string").alias("key"), F.concat(F.lit(mark), "n_nationkey").alias("pid")) for rule, mark in (("n_regionkey IN (2, 4)", "reviewed"), ("n_regionkey < 3", "nation")))
    return resolve.resolve_creators(creators, aliases, people, orgs)[0]


@query("""
WITH s AS (SELECT doc_id, source, lang FROM documents WHERE lang IS DISTINCT FROM 'en'), o AS (SELECT doc_id, source, lang FROM documents WHERE lang = 'en')
SELECT doc_id, source, lang, false AS attached FROM s UNION ALL SELECT doc_id, source, lang, true FROM o WHERE source IN (SELECT source FROM s)
""")
def attach_semi(spark, sf_dir):
    """Every document is selected (not English) or offered (English)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return resolve.attach(docs.where("NOT lang <=> 'en'"), docs.where("lang = 'en'"), "source")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabeled_anti(spark, sf_dir):
    return compare.dangling(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query("""
WITH s AS (SELECT 's' || s_suppkey AS pid, (s_nationkey % 2)::VARCHAR AS class, 'm' || right(s_name, 9) AS t1, 'k' || s_suppkey AS t2 FROM supplier),
c AS (SELECT 'c' || c_custkey AS pid, (c_nationkey % 2)::VARCHAR AS class, 'm' || right(c_name, 9) AS t1, 'k' || (c_custkey * 3) AS t2 FROM customer),
p AS (SELECT s.pid, c.pid AS hit FROM s JOIN c USING (class, t1) UNION SELECT s.pid, c.pid FROM s JOIN c USING (class, t2)),
h AS (SELECT pid, list_sort(list(hit)) AS candidates FROM p GROUP BY 1)
SELECT s.class, s.pid, CASE WHEN len(candidates) = 1 THEN candidates[1] END AS matched,
CASE WHEN candidates IS NULL THEN 'unmatched' WHEN len(candidates) = 1 THEN 'identifier' ELSE 'ambiguous' END AS how, coalesce(candidates, []) AS candidates FROM s LEFT JOIN h USING (pid)
""")
def token_match(spark, sf_dir):
    """All suppliers against all customers, by tokens that few records share: the number in the name and the key."""

    def side(df, key, nation, name, mark, factor):
        tokens = F.array(F.concat(F.lit("m"), F.substring(name, -9, 9)), F.concat(F.lit("k"), F.col(key) * factor))
        return df.select(F.concat(F.lit(mark), key).alias("pid"), (F.col(nation) % 2).cast("string").alias("class"), tokens.alias("tokens"))

    source = side(read(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", "s_name", "s", 1)
    target = side(read(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", "c_name", "c", 3)
    return resolve.match_records(source, target)


@query("""
WITH l AS (SELECT l_orderkey AS k, count(*) AS n, max(l_linestatus) AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey AS k FROM orders JOIN l ON o_orderkey = k WHERE o_orderstatus IS DISTINCT FROM s
""")
def equal_on_overlap(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("s"))
    return resolve.differing_overlap(orders, lines, "k", ["s"])


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000), c AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT k, 'left' AS side FROM o WHERE k NOT IN (SELECT k FROM c) UNION ALL SELECT k, 'right' FROM c WHERE k NOT IN (SELECT k FROM o)
""")
def coverage_join(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return validate.residue(orders, read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT l_orderkey, l_linenumber, p_brand, (p_partkey IS NOT NULL) AS present FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey")
def baseline_lookup(spark, sf_dir):
    part = read(spark, sf_dir, "part").where("p_size < 25").select("p_partkey", "p_brand")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(part, lines.l_partkey == part.p_partkey, "left").select("l_orderkey", "l_linenumber", "p_brand", F.col("p_partkey").isNotNull().alias("present"))


@query("""
WITH a AS (SELECT user_id, max(event_type) AS t, max(props) AS p FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, max(event_type) AS t, max(props) AS p FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT a.user_id::VARCHAR AS pid, CASE WHEN b.user_id IS NULL THEN '/' || a.user_id ELSE '/' || a.user_id || '/' || f END AS path
FROM a LEFT JOIN b USING (user_id), (VALUES ('props'), ('type')) AS v(f)
WHERE (b.user_id IS NULL AND f = 'props') OR (b.user_id IS NOT NULL AND CASE f WHEN 'type' THEN a.t <> b.t ELSE a.p <> b.p END)
""")
def containment(spark, sf_dir):
    def side(i):
        rows = read(spark, sf_dir, "events").where(F.col("event_id") % 2 == i).groupBy(F.col("user_id").cast("string").alias("pid")).agg(F.max("event_type").alias("t"), F.max("props").alias("p"))
        return rows.select("pid", F.create_map(F.lit("type"), "t", F.lit("props"), "p").alias("fields"))

    return compare.missing_fields(side(0), side(1), "pid", "fields")


@query(f"SELECT k, CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' WHEN a = b THEN 'unchanged' ELSE 'changed' END AS change FROM ({_HALVES})")
def keyed_diff(spark, sf_dir):
    half = lambda i: read(spark, sf_dir, "events").where(F.col("event_id") % 2 == i).groupBy(F.col("user_id").alias("k")).agg(F.max("event_type").alias("t"))
    return compare.keyed_diff(half(0), half(1), "k", ["t"])


@query("""
WITH c AS (SELECT user_id::VARCHAR AS pid, sha256(max(event_type)) AS claim_sha256 FROM events GROUP BY 1), d AS (SELECT user_id::VARCHAR AS pid, sha256(min(event_type)) AS claim_sha256 FROM events WHERE event_id % 4 = 0 GROUP BY 1)
SELECT pid, claim_sha256 FROM c WHERE pid || claim_sha256 NOT IN (SELECT pid || claim_sha256 FROM d)
""")
def decision_filter(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("pid", F.col("user_id").cast("string"))
    claims = events.groupBy("pid").agg(F.sha2(F.max("event_type"), 256).alias("claim_sha256"))
    decisions = events.where("event_id % 4 = 0").groupBy("pid").agg(F.sha2(F.min("event_type"), 256).alias("claim_sha256"))
    return compare.pending(claims, decisions)


@query("SELECT lower(p_name || p_brand || p_type) AS key, min(p_partkey) AS pid FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1")
def unique_name_index(spark, sf_dir):
    return resolve.unique_index(read(spark, sf_dir, "part").select(F.lower(F.concat("p_name", "p_brand", "p_type")).alias("key"), F.col("p_partkey").alias("pid")), "key", "pid")


@query("SELECT sha256(text) AS key, count(*)::BIGINT AS rows FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return validate.repeated(read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key")), "key")


@query(f"SELECT {_KEY_SQL} AS key, list_sort(list(DISTINCT source)) AS classes FROM documents GROUP BY 1 HAVING count(DISTINCT source) <> 1")
def class_conflicts(spark, sf_dir):
    return entity.classes(_keyed(spark, sf_dir), "key", "source")[1]


@query(f"SELECT key, list_sort(list(DISTINCT id)) AS identifiers FROM (SELECT {_KEY_SQL} AS key, unnest(['source:' || source, 'lang:' || lang]) AS id FROM documents) GROUP BY 1")
def identifier_union(spark, sf_dir):
    docs = _keyed(spark, sf_dir).withColumn("ids", F.array(F.concat(F.lit("source:"), "source"), F.concat(F.lit("lang:"), "lang")))
    return entity.union_of(docs, "key", "ids", "identifiers")


@query(f"""
WITH v AS (SELECT {_KEY_SQL} AS key, unnest([{{'field': 'source', 'value': source}}, {{'field': 'lang', 'value': lang}}, {{'field': 'n_chars', 'value': n_chars::VARCHAR}}]) AS u FROM documents)
SELECT key, u.field AS field, list_sort(list(DISTINCT u.value)) AS values FROM v GROUP BY 1, 2 HAVING count(DISTINCT u.value) > 1
""")
def field_conflicts(spark, sf_dir):
    return entity.field_conflicts(_keyed(spark, sf_dir), "key", ["source", "lang", "n_chars"])


@query("SELECT 'source' AS kind, source AS name, count(*)::BIGINT AS n FROM documents GROUP BY 2 UNION ALL SELECT 'event', event_type, count(*) FROM events GROUP BY 2")
def membership_counts(spark, sf_dir):
    def counts(df, kind, name):
        return df.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")

    return counts(read(spark, sf_dir, "documents"), "source", "source").unionByName(counts(read(spark, sf_dir, "events"), "event", "event_type"))


@query("SELECT l_orderkey, l_returnflag, list(l_partkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS parts FROM lineitem GROUP BY 1, 2")
def ordered_group(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return entity.ordered_lists(lines, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_suppkey"], "l_partkey", "parts")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT r.o_custkey, r.o_orderkey FROM r JOIN (SELECT * FROM r WHERE n = 1) f ON r.o_custkey = f.o_custkey WHERE r.n > 1 AND (r.o_orderstatus, r.o_orderpriority) IS DISTINCT FROM (f.o_orderstatus, f.o_orderpriority)
""")
def first_wins(spark, sf_dir):
    return entity.merged_first(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])[1].select("o_custkey", "o_orderkey")


@query("SELECT lower(p_name) AS key, list_sort(list(DISTINCT p_partkey)) AS pids FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def title_collisions(spark, sf_dir):
    return entity.collisions(read(spark, sf_dir, "part").withColumn("key", F.lower("p_name")), "key", "p_partkey").select("key", "pids")


@query("SELECT sha256(string_agg(n_name || chr(0) || n_nationkey || ':' || n_regionkey || chr(0), '' ORDER BY n_name)) AS digest FROM nation")
def content_digest(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select("n_name", F.concat_ws(":", "n_nationkey", "n_regionkey").alias("payload"))
    return entity.content_digest(nation, "n_name", "payload")


@query("SELECT * FROM (VALUES ('click'), ('view'), ('retired'), ('unknown')) AS d(entry) WHERE entry NOT IN (SELECT event_type FROM events)")
def policy_coverage(spark, sf_dir):
    declared = spark.createDataFrame([("click",), ("view",), ("retired",), ("unknown",)], "entry string")
    return validate.unused(declared, read(spark, sf_dir, "events").select(F.col("event_type").alias("entry")))


@query("SELECT l_orderkey, min('k' || l_partkey) AS least FROM lineitem GROUP BY 1")
def min_key(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.concat(F.lit("k"), "l_partkey")).alias("least"))


@query("""
SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL
SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL
SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
""")
def set_algebra(spark, sf_dir):
    a, b = (read(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    made = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b))]
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n") for op, df in made]
    return out[0].union(out[1]).union(out[2])


@query("""
WITH b AS (SELECT user_id::VARCHAR AS pid, event_type AS path, event_type AS predicate, props AS content, min(event_id) AS pos, arg_min({'o': CASE WHEN event_id % 3 = 0 THEN 'adapter' WHEN event_id % 3 = 1 THEN 'other' END}, event_id).o AS owner FROM events WHERE value < 100 OR value IS NULL GROUP BY 1, 2, 3, 4),
s AS (SELECT user_id::VARCHAR AS pid, event_type AS path, event_type AS predicate, props AS content, min(event_id) AS pos FROM events WHERE value >= 20 GROUP BY 1, 2, 3, 4)
SELECT coalesce(b.pid, s.pid) AS pid, coalesce(b.path, s.path) AS path, coalesce(b.predicate, s.predicate) AS predicate, coalesce(b.content, s.content) AS content,
CASE WHEN b.pid IS NULL THEN 'adapter' ELSE b.owner END AS owner, coalesce(b.pos, s.pos) AS pos,
CASE WHEN b.pid IS NULL THEN 'added' WHEN b.owner = 'adapter' AND s.pid IS NULL AND b.pid IN (SELECT pid FROM s) THEN 'removed' ELSE 'kept' END AS change
FROM b FULL OUTER JOIN s ON b.pid = s.pid AND b.path = s.path AND b.predicate = s.predicate AND b.content = s.content
""")
def ownership_merge(spark, sf_dir):
    """Every event stands in the baseline (low or no value), in the source (higher value) or, between the two, in both."""
    events = read(spark, sf_dir, "events")
    keys = [F.col("user_id").cast("string").alias("pid"), F.col("event_type").alias("path"), F.col("event_type").alias("predicate"), F.col("props").alias("content")]
    owner = F.when(F.col("event_id") % 3 == 0, "adapter").when(F.col("event_id") % 3 == 1, "other")
    names = ["pid", "path", "predicate", "content"]
    rows = events.where("value < 100 OR value IS NULL").select(*keys, "event_id", owner.alias("o"))
    baseline = rows.groupBy(*names).agg(F.min("event_id").alias("pos"), F.min_by(F.struct("o"), "event_id").alias("o")).select(*names, "pos", F.col("o.o").alias("owner"))
    source = events.where("value >= 20").select(*keys, F.col("event_id").alias("pos"))
    return merge.merge_assertions(baseline, source, "adapter", names)


@query("""
SELECT d.doc_id::VARCHAR AS pid, d.source AS path, sha256(d.text) AS assertion_sha256, CASE WHEN l.doc_id IS NOT NULL THEN 'labels' END AS imported_by FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def provenance_join(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.lit("labels").alias("imported_by"))
    rows = read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    rows = rows.select(F.col("doc_id").cast("string").alias("pid"), F.col("source").alias("path"), F.lit(0).alias("pos"), F.col("lang").alias("content"), F.sha2("text", 256).alias("assertion_sha256"), "imported_by", F.lit("documents").alias("imported_from"))
    return merge.compact_inline(*merge.split_inline(rows)).select("pid", "path", "assertion_sha256", "imported_by")


@query("""
SELECT 'label' AS edge, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS n UNION ALL
SELECT 'order', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL
SELECT 'line', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
""")
def dangling_refs(spark, sf_dir):
    def count(edge, edges, target, nodes, key):
        return compare.dangling(read(spark, sf_dir, edges), read(spark, sf_dir, nodes), target, key).agg(F.count(F.lit(1)).alias("n")).select(F.lit(edge).alias("edge"), "n")

    return count("label", "documents", "doc_id", "labels", "doc_id").union(count("order", "orders", "o_custkey", "customer", "c_custkey")).union(count("line", "lineitem", "l_partkey", "part", "p_partkey"))


@query("""
SELECT doc_id, 'sha256:' || sha256('{' || concat_ws(',', '"doc_id":' || doc_id, '"lang":' || to_json(lang), '"source":' || to_json(source), '"text":' || to_json(text)) || '}') AS digest FROM documents
""")
def canonical_json(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    canonical = R.canonical_json(F.to_json(F.struct("text", "lang", "source", "doc_id")))
    return docs.select("doc_id", R.digest(canonical).alias("digest"))


@query("""
WITH p AS (SELECT o_custkey, o_orderpriority AS predicate, min(o_orderkey) AS pos FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2),
g AS (SELECT DISTINCT o_custkey, o_orderpriority AS predicate FROM orders WHERE o_orderkey % 2 = 1),
u AS (SELECT o_custkey, predicate, pos, 0 AS gone FROM p UNION ALL SELECT o_custkey, predicate, 0, 1 FROM g WHERE (o_custkey, predicate) NOT IN (SELECT o_custkey, predicate FROM p))
SELECT o_custkey, list(predicate ORDER BY gone, pos, predicate) AS predicates FROM u GROUP BY 1
""")
def omitted_predicates(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "predicate").withColumnRenamed("o_orderkey", "pos")
    return merge.omitted_after(orders.where("pos % 2 = 1"), orders.where("pos % 2 = 0"), "o_custkey", "predicate", "predicates")
