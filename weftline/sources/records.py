"""Readers: class arrays in JSON, one-record YAML files with companions, snapshots, policies, aliases, pinned checkouts."""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import canonical_text
from ..functions.text import name_key
from ..operators.resolve import ambiguous
from ..operators.validate import IntegrityError, missing, repeated, require_none, violations
from ..vocabulary import ITEM

try:
    import yaml
except ImportError:  # YAML readers and writers ask for it when they are used
    yaml = None


def class_arrays(spark: SparkSession, path: str, pattern: str = r"^[A-Z][A-Za-z]*$", tolerant: bool = False) -> DataFrame:
    """(class, pid, record, file) of the *.json files under path, each an array of records; class is the file's stem.

    A pid must be there and unique over all classes. tolerant: below any depth; malformed files and other documents
    are passed over, and nothing is checked.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", str(tolerant).lower()).load(path)
    text = files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("class"), F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"))
    if tolerant:
        text = text.where(F.try_variant_get(F.try_parse_json("text"), "$", "array<variant>").isNotNull())
    rows = text.select("class", "file", F.explode(F.from_json("text", "array<string>", {"mode": "PERMISSIVE" if tolerant else "FAILFAST"})).alias("record"))
    rows = rows.select("class", F.get_json_object("record", "$.pid").alias("pid"), "record", "file")
    if tolerant:
        return rows.where("pid IS NOT NULL")
    checks = [
        violations(text.where(~F.col("class").rlike(pattern)), "class name", F.col("class"), F.col("file")),
        violations(missing(rows, "pid"), "missing pid", F.col("class"), F.col("file")),
        violations(repeated(rows.where("pid IS NOT NULL"), "pid"), "repeated pid", F.col("pid"), F.col("rows")),
    ]
    require_none(checks)
    return rows


def pid_files(records: DataFrame) -> DataFrame:
    """(pid, files) of records (pid, file), files ascending."""
    return records.groupBy("pid").agg(F.array_sort(F.collect_set("file")).alias("files"))


if yaml is not None:

    class UniqueKeys(yaml.SafeLoader):
        """Refuses a mapping with a repeated key."""

    def _mapping(loader, node, deep=False):
        out = {}
        for key_node, value_node in node.value:
            key = loader.construct_object(key_node, deep=deep)
            if key in out:
                raise yaml.constructor.ConstructorError(None, None, f"repeated key {key!r}", key_node.start_mark)
            out[key] = loader.construct_object(value_node, deep=deep)
        return out

    UniqueKeys.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def parse_yaml(payload: bytes):
    """One YAML document, without repeated keys."""
    if yaml is None:
        raise ImportError("PyYAML is needed to read YAML")
    return yaml.load(payload.decode("utf-8"), Loader=UniqueKeys)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                value = parse_yaml(bytes(content))
                error = None if isinstance(value, dict) else "not a mapping"
            except (UnicodeDecodeError, yaml.YAMLError if yaml else ValueError) as problem:
                value, error = None, str(problem).split("\n")[0]
            out.append((path, None if error else canonical_text(value), hashlib.sha256(bytes(content)).hexdigest(), error))
        yield pd.DataFrame(out, columns=["path", "record", "sha256", "error"])


def yaml_documents(spark: SparkSession, path: str) -> DataFrame:
    """(rel_path, class, record, sha256, error) of the YAML files under path; each file is read once, hashed and parsed.

    record is canonical JSON text; class the name of the folder. Hidden files are passed over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!.]*.yaml").load(path)
    parsed = files.select("path", "content").mapInPandas(_parsed, "path string, record string, sha256 string, error string")
    base = re.sub(r"^\w+:/*", "/", path.rstrip("/")) + "/"
    rel = F.substring_index(F.regexp_replace("path", r"^\w+:/*", "/"), base, -1)
    return parsed.select(rel.alias("rel_path"), F.element_at(F.split("path", "/"), -2).alias("class"), "record", "sha256", "error")


def foreign_files(spark: SparkSession, path: str, config: str | None = None) -> DataFrame:
    """(rel_path, reason) of what has no place among one-record files: symbolic links, hidden files and folders, and
    other kinds of files. A file named `config` may stand at the top. Names alone are looked at, on the driver."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, found = store.makeQualified(root).toUri().getPath().rstrip("/") + "/", []
    waiting = [root] if store.exists(root) else []
    while waiting:
        for status in store.listStatus(waiting.pop()):
            place = status.getPath()
            rel = place.toUri().getPath().removeprefix(base)
            # a local store doesn't tell links itself
            local = place.toUri().getScheme() in (None, "file")
            if os.path.islink(place.toUri().getPath()) if local else status.isSymlink():
                found.append((rel, "symbolic link"))
            elif place.getName().startswith("."):
                # a store's own checksums aren't part of the folder
                if rel != config and not place.getName().endswith(".crc"):
                    found.append((rel, "hidden"))
            elif status.isDirectory():
                waiting.append(place)
            elif not place.getName().lower().endswith((".yaml", ".yml")):
                found.append((rel, "not a record file"))
    return spark.createDataFrame(found, "rel_path string, reason string")


def yaml_records(spark: SparkSession, path: str, companions: str | None = None, strict: bool = True, config: str | None = None) -> DataFrame:
    """(pid, class, rel_path, record, companion) of one-record files, with the companion at the same path, if any.

    Foreign files (unless strict is off, when hidden and other ones are passed over), unreadable ones, missing or
    repeated pids, and companions without a record are errors.
    """
    if strict:
        require_none([violations(foreign_files(spark, place, config), "foreign file", F.col("rel_path"), F.col("reason")) for place in (path, companions) if place])
    docs = yaml_documents(spark, path).withColumn("pid", F.get_json_object("record", "$.pid"))
    checks = [
        violations(docs.where("error IS NOT NULL"), "unreadable", F.col("rel_path"), F.col("error")),
        violations(docs.where("error IS NULL AND coalesce(pid, '') = ''"), "missing pid", F.col("rel_path"), F.lit("")),
        violations(repeated(docs.where("pid IS NOT NULL"), "pid"), "repeated pid", F.col("pid"), F.col("rows")),
    ]
    records = docs.select("pid", "class", "rel_path", "record")
    if companions is None:
        require_none(checks)
        return records.withColumn("companion", F.lit(None).cast("string"))
    notes = yaml_documents(spark, companions)
    checks += [
        violations(notes.where("error IS NOT NULL"), "unreadable companion", F.col("rel_path"), F.col("error")),
        violations(notes.join(docs, "rel_path", "left_anti"), "companion without a record", F.col("rel_path"), F.lit("")),
    ]
    require_none(checks)
    return records.join(notes.select("rel_path", F.col("record").alias("companion")), "rel_path", "left").select("pid", "class", "rel_path", "record", "companion")


def content_sha256(collections: list, items: list) -> str:
    """Digest of a snapshot's content whatever the time it was fetched."""
    return hashlib.sha256(canonical_text({"collections": collections, "items": items}).encode()).hexdigest()


def snapshot_document(rows: dict[str, DataFrame], root: str, group: int, fetched_at: str, api_version: str = "3") -> dict:
    """A snapshot document, with its digest, of fetched collections and items (http.fetch_snapshot of root/group).

    sinks.atomic_json writes it; load_snapshot reads it. It is one document by its format, so it is put together on the
    driver, a row at a time.
    """
    names = {"collections": "collections", "items/top": "items"}
    content = {out: [json.loads(r["record"]) for r in rows[name].select("key", "record").orderBy("key").toLocalIterator()] for name, out in names.items()}
    urls = {name: [r["url"] for r in rows[name].select("url").distinct().orderBy("url").collect()] or [f"{root}/{group}/{name}?start=0"] for name in names}
    versions = {r[0] for name in names for r in rows[name].select("version").distinct().collect()}
    if len(versions) > 1:
        raise IntegrityError(f"snapshot: several versions {sorted(versions)}")
    source = {
        "group_id": group, "library_version": versions.pop() if versions else 0, "api_root": f"{root}/{group}", "api_version": api_version, "response_api_version": api_version, "fetched_at": fetched_at,
        "total_collections": len(content["collections"]), "total_top_level_items": len(content["items"]), "content_sha256": content_sha256(**content), "collection_urls": urls["collections"], "item_urls": urls["items/top"],
    }
    document = {"source": source, **content}
    validate_snapshot(document, root, api_version)
    return document


def load_snapshot(spark: SparkSession, path: str, root: str, api_version: str = "3") -> tuple[dict, DataFrame, DataFrame]:
    """A stored snapshot's source header, collections (key, name) and items (ITEM), after all integrity checks.

    A snapshot is one JSON document that a single request cycle fetched; rows become distributed from here on.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    snapshot = json.loads(text)
    source = validate_snapshot(snapshot, root, api_version)
    collections = [((c.get("data") or {}).get("key") or c.get("key"), (c.get("data") or {}).get("name")) for c in snapshot["collections"]]
    rows = [(json.dumps(_plain_item(i), ensure_ascii=False),) for i in snapshot["items"] if isinstance(i.get("data", i), dict)]
    items = spark.createDataFrame(rows, "j string").select(F.from_json("j", ITEM, {"mode": "FAILFAST"}).alias("i")).select("i.*")
    return source, spark.createDataFrame(collections, "key string, name string"), items


def _plain_item(item: dict) -> dict:
    data = item["data"] if isinstance(item.get("data"), dict) else item
    tags = [t if isinstance(t, dict) else {"tag": t} for t in data.get("tags") or []]
    return {**data, "tags": tags, "key": data.get("key") or item.get("key") or "", "version": int(data.get("version") or item.get("version") or 0), "deleted": bool(data.get("deleted"))}


def validate_snapshot(snapshot: dict, root: str, api_version: str = "3") -> dict:
    """The source header if header and payload agree: types, root, versions, totals, keys, order, digest, time and URLs."""
    from datetime import datetime

    def need(ok: bool, what: str):
        if not ok:
            raise IntegrityError(f"snapshot: {what}")

    source, collections, items = (snapshot.get(k) for k in ("source", "collections", "items"))
    need(isinstance(source, dict), "source must be a mapping")
    need(isinstance(collections, list) and isinstance(items, list), "collections and items must be lists")
    need(all(isinstance(r, dict) for r in [*collections, *items]), "records must be objects")
    group, version = source.get("group_id"), source.get("library_version")
    need(isinstance(group, int) and group > 0, "group_id must be positive")
    need(isinstance(version, int) and version >= 0, "library_version must not be negative")
    need(source.get("api_root") == f"{root}/{group}", "api_root doesn't belong to group_id")
    need(source.get("api_version") == api_version and source.get("response_api_version") == api_version, "API version")
    for name, rows in (("collections", collections), ("top_level_items", items)):
        keys = [(r.get("data") or {}).get("key") or r.get("key") or "" for r in rows]
        need(source.get(f"total_{name}") == len(rows), f"total_{name} doesn't match")
        need(all(keys) and len(set(keys)) == len(keys), f"{name} keys are missing or repeated")
        need(keys == sorted(keys), f"{name} aren't in order of key")
    need(source.get("content_sha256") == content_sha256(collections, items), "content_sha256 doesn't match")
    try:
        fetched = datetime.fromisoformat(str(source.get("fetched_at")))
    except ValueError:
        fetched = None
    need(fetched is not None and fetched.tzinfo is not None, "fetched_at must be a time with a zone")
    for key, endpoint in (("collection_urls", "collections"), ("item_urls", "items/top")):
        urls = source.get(key)
        need(isinstance(urls, list) and bool(urls) and all(isinstance(u, str) and u.startswith(f"{root}/{group}/{endpoint}?") for u in urls), f"{key} has unexpected URLs")
    return source


def aliases(spark: SparkSession, groups: list[dict]) -> DataFrame:
    """(key, pid) of reviewed alias groups (pid, aliases); an empty alias, or one with two pids, is an error."""
    pairs = spark.createDataFrame([(a, g["pid"]) for g in groups for a in g["aliases"]], "alias string, pid string")
    keyed = pairs.withColumn("key", name_key(F.col("alias")))
    require_none([violations(missing(keyed, "key"), "empty alias", F.col("pid"), F.col("alias")), violations(ambiguous(keyed, "key", "pid"), "alias of two", F.col("key"), F.concat_ws(", ", "first", "last"))])
    return keyed.select("key", "pid").distinct()


#: Fields of a publishing policy and of a curated generation.
POLICY_FIELDS = {"format_version", "description", "pid_overrides", "allowed_attribution_targets", "omitted_attribution_targets", "allowed_about_targets", "omitted_generation_objects", "allowed_curated_generation_targets", "curated_generations"}
GENERATION_FIELDS = {"object", "at_location", "at_time", "rationale"}


def parse_policy(payload: bytes) -> dict:
    """A publishing policy (YAML), if it keeps to its contract: fields, types, no repeats, nothing both allowed and omitted."""
    policy = parse_yaml(payload)

    def need(ok: bool, what: str):
        if not ok:
            raise IntegrityError(f"policy: {what}")

    filled = lambda x: isinstance(x, str) and bool(x.strip())
    need(isinstance(policy, dict) and policy.get("format_version") == 1, "format_version must be 1")
    need(set(policy) == POLICY_FIELDS, f"fields differ: {sorted(set(policy) ^ POLICY_FIELDS)}")
    need(filled(policy["description"]), "description must be a text")
    for name in ("pid_overrides", "omitted_attribution_targets", "omitted_generation_objects"):
        need(isinstance(policy[name], dict) and all(filled(x) for kv in policy[name].items() for x in kv), f"{name} must map texts to texts")
    for name in ("allowed_attribution_targets", "allowed_about_targets", "allowed_curated_generation_targets"):
        values = policy[name]
        need(isinstance(values, list) and all(map(filled, values)) and len(set(values)) == len(values), f"{name} must be distinct texts")
    both = set(policy["allowed_attribution_targets"]) & set(policy["omitted_attribution_targets"])
    need(not both, f"both allowed and omitted: {sorted(both)}")
    curated = policy["curated_generations"]
    need(isinstance(curated, dict) and all(filled(k) and isinstance(v, list) and v for k, v in curated.items()), "curated_generations must map pids to lists")
    for pid, rows in curated.items():
        for row in rows:
            need(isinstance(row, dict) and {"object", "rationale"} <= set(row) <= GENERATION_FIELDS and all(map(filled, row.values())), f"curated generation of {pid}")
        prints = [generation_fingerprint(pid, r) for r in rows]
        need(len(set(prints)) == len(prints), f"curated generations of {pid} repeat")
    return policy


def generation_fingerprint(pid: str, generation: dict) -> str:
    return f"{pid}:{canonical_text({k: v for k, v in generation.items() if k != 'rationale'})}"


def decisions(spark: SparkSession, cache: dict) -> DataFrame:
    """(pid, claim_sha256, disposition, review, source_record_id) of a decision cache (mapping of pid to its decision)."""
    rows = [(pid, d["claim_sha256"], d.get("disposition"), d.get("review"), d.get("source_record_id")) for pid, d in cache.items()]
    return spark.createDataFrame(rows, "pid string, claim_sha256 string, disposition string, review string, source_record_id string")


def pinned_checkout(path: str, commit: str, directory: str) -> dict[str, str]:
    """Commit and tree id of a clean checkout at exactly that commit; the directory is a plain relative path."""
    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", path, *args], check=True, capture_output=True, text=True).stdout.strip()

    if not re.fullmatch("[0-9a-f]{40}", commit or ""):
        raise IntegrityError("a commit has 40 hexadecimal digits")
    parts = directory.split("/")
    if directory.startswith("/") or not all(parts) or {".", ".."} & set(parts):
        raise IntegrityError(f"not a plain relative path: {directory}")
    if git("rev-parse", "HEAD") != commit:
        raise IntegrityError("the checkout is at another commit")
    if git("status", "--porcelain"):
        raise IntegrityError("the checkout has changes")
    return {"commit": commit, "tree": git("rev-parse", f"{commit}:{directory}")}
