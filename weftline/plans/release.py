"""From a snapshot, publications and a policy to published files and their report: all of it or nothing."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import records as R
from ..operators import entity
from ..operators.validate import repeated, require_none, violations
from ..sources import records as S
from ..sources import sinks
from . import publish
from .settle import settled

#: What a report says of the snapshot.
SOURCE_FIELDS = ("api_root", "content_sha256", "fetched_at", "group_id", "library_version", "api_version")


def documents(records: DataFrame) -> DataFrame:
    """(name, payload) of rendered records: a file name by the pid's last part, and one YAML document."""
    text = R.batched(lambda record: sinks.yaml_bytes(json.loads(record)).decode(), T.StringType())
    return records.select(F.concat(F.substring_index("pid", "/", -1), F.lit(".yaml")).alias("name"), text(F.to_json(F.struct("*"))).alias("payload"))


def release(publications: DataFrame, snapshot: str, policy: str | Path, folder: str | Path, report: str | Path, root: str | Path, own_prefix: str, api_root: str, publications_sha256: str | None = None) -> dict:
    """Renders publications (ingest.transform's) under a policy and publishes one file for each, with a report.

    Everything is checked before a file is touched: the snapshot, the policy, items of the snapshot behind each
    publication, stable and distinct pids and names, every policy entry used. Folder and report are then replaced
    together, below `root` and apart from the inputs. Gives the report. Files are rendered and written by tasks; the
    driver puts the finished folder in its place.
    """
    spark: SparkSession = publications.sparkSession
    sinks.safe_destination(folder, root, [policy, snapshot])
    sinks.safe_destination(report, root, [policy, snapshot])
    source, _, items = S.load_snapshot(spark, snapshot, api_root)
    payload = Path(policy).read_bytes()
    out = publish.render(publications, S.parse_policy(payload), items.select("key"), own_prefix, source["group_id"])
    files = settled(documents(out["records"]))
    require_none([violations(repeated(files, "name"), "repeated file name", F.col("name"), F.col("rows"))])
    publish.coverage(publications.select("pid"), out["records"], out["pid_map"])
    kinds = {r["kind"]: r["count"] for r in out["records"].groupBy("kind").count().collect()}
    made = {
        "format_version": 1,
        "source": {k: source.get(k) for k in SOURCE_FIELDS},
        "inputs": {"policy_sha256": hashlib.sha256(payload).hexdigest(), "publications_sha256": publications_sha256},
        "output": {"publication_count": files.count(), "sha256": entity.content_digest(files, "name", "payload").first()[0], "kinds": dict(sorted(kinds.items()))},
        "reviewed_omissions": {f"{r['kind']}:{r['target']}": r["n"] for r in out["omissions"].orderBy("kind", "target").collect()},
        "pid_map": [{"site_pid": r["pid"], "source_pid": r["source_pid"]} for r in out["pid_map"].orderBy("source_pid").collect()],
    }
    text = json.dumps(made, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    sinks.publish_files(files.select(F.col("name").alias("file"), F.col("payload").alias("text")), folder, report, text, root, [policy, snapshot])
    return made
