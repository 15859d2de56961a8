"""Sinks: deterministic JSON and YAML files, and publication that either replaces everything or nothing.

Spark writes large tables by its own committer; files for people and other tools are written by tasks through the data
source of files.py, and the driver swaps finished folders.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validate import IntegrityError, require_none, violations
from .files import swap, write_files


def write_class_tables(df: DataFrame, path: str) -> None:
    """df (class, pid, ...) as JSON lines, a folder for each class, in order of pid within a file and from file to file;
    a large class goes to several tasks."""
    df.repartitionByRange("class", "pid").sortWithinPartitions("class", "pid").write.partitionBy("class").mode("overwrite").json(path)


def atomic_json(path: str | Path, value) -> None:
    """Ascending keys, indented, UTF-8; the file appears whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def class_files(records: DataFrame, folder: str | Path, classes: list[str]) -> dict[str, int]:
    """One JSON array for each class from records (class, pid, record JSON text), in order of pid. Tasks write the
    arrays' parts, so none passes through the driver; files of other classes stay."""
    rows = records.where(F.col("class").isin(*classes)).select(F.concat("class", F.lit(".json")).alias("file"), F.col("record").alias("text"), "pid")
    found = write_files(rows, folder, "pid", shape="json-array", whole=False)
    counts = {name: found.get(f"{name}.json", 0) for name in classes}
    for name in (name for name, n in counts.items() if not n):
        atomic_json(Path(folder) / f"{name}.json", [])
    return counts


def class_arrays(records: DataFrame, folder: str | Path, classes: list[str], report: str | Path, values: dict) -> dict[str, int]:
    """The arrays of all classes and a report of values and counts, replaced together or not at all."""
    counts = {c: 0 for c in classes} | {r["class"]: r["count"] for r in records.groupBy("class").count().collect()}
    if set(counts) - set(classes):
        raise IntegrityError(f"classes without a file: {', '.join(sorted(set(counts) - set(classes)))}")
    text = json.dumps(values | {"records": counts}, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    rows = records.select(F.concat("class", F.lit(".json")).alias("file"), F.col("record").alias("text"), "pid")
    # a class without records is an empty array
    empty = records.sparkSession.createDataFrame([(f"{c}.json",) for c, n in counts.items() if not n], "file string").select("file", F.lit(None).cast("string").alias("text"), F.lit("").alias("pid"))
    write_files(rows.union(empty), folder, "pid", shape="json-array", report=report, report_text=text)
    return counts


def change_set(counts: dict[str, int], existing: set[str]) -> dict[str, str]:
    """What happens to each class's file: 'replace' if there are records, 'delete' if there are none and a file exists."""
    return {c: "replace" if n else "delete" for c, n in counts.items() if n or c in existing}


def yaml_bytes(record: dict) -> bytes:
    """One YAML document: keys in their order, wide lines, text as it is."""
    import yaml

    return yaml.safe_dump(record, sort_keys=False, allow_unicode=True, width=88).encode("utf-8")


def identity_tables(identities: DataFrame, canonical: DataFrame, routes: dict[str, str]) -> dict[str, DataFrame]:
    """Reviewed identities (pid, aliases) as (pid, display_label) tables, routed by prefix of the pid.

    A repeated pid, one that is canonical by now, one without aliases or without a route is an error.
    """
    route = F.lit(None).cast("string")
    for prefix, name in routes.items():
        route = F.when(F.col("pid").startswith(prefix), F.lit(name)).otherwise(route)
    routed = identities.withColumn("route", route)
    require_none([
        violations(identities.groupBy("pid").count().where("count > 1"), "repeated identity", F.col("pid"), F.col("count")),
        violations(identities.join(canonical.select("pid"), "pid", "left_semi"), "identity is canonical", F.col("pid"), F.lit("")),
        violations(identities.where("aliases IS NULL OR size(aliases) = 0"), "identity without alias", F.col("pid"), F.lit("")),
        violations(routed.where("route IS NULL"), "identity without route", F.col("pid"), F.lit("")),
    ])
    rows = routed.select("route", "pid", F.explode("aliases").alias("display_label"))
    return {name: rows.where(F.col("route") == name).select("pid", "display_label") for name in routes.values()}


def safe_destination(path: str | Path, root: str | Path, inputs: list[str | Path] = ()) -> Path:
    """An absolute path strictly below root, without symbolic links on the way, apart from all inputs."""
    path, root = Path(os.path.abspath(path)), Path(os.path.abspath(root))
    if root not in path.parents:
        raise IntegrityError(f"{path} isn't below {root}")
    for part in [path, *path.parents]:
        if part == root.parent:
            break
        if part.is_symlink():
            raise IntegrityError(f"{part} is a symbolic link")
    for other in map(lambda x: Path(os.path.abspath(x)), inputs):
        if other == path or other in path.parents or path in other.parents:
            raise IntegrityError(f"{path} overlaps the input {other}")
    if path.is_dir() and any(p.is_symlink() for p in path.rglob("*")):
        raise IntegrityError(f"{path} holds a symbolic link")
    return path


def _destinations(folder: str | Path, report: str | Path, root: str | Path, inputs: list[str | Path], owned: str) -> tuple[Path, Path]:
    """Folder and report, which exist together or not at all; the folder holds nothing but files like `owned`."""
    folder, report = safe_destination(folder, root, inputs), safe_destination(report, root, inputs)
    if folder.exists() != report.exists():
        raise IntegrityError("folder and report must exist together")
    if folder.exists() and {p.name for p in folder.iterdir()} - {p.name for p in folder.glob(owned)}:
        raise IntegrityError(f"{folder} holds files that aren't ours")
    return folder, report


def publish_files(files: DataFrame, folder: str | Path, report: str | Path, report_text: str, root: str | Path, inputs: list[str | Path] = (), owned: str = "*.yaml") -> int:
    """Replaces a folder of files (file, text), written by tasks, and its report together; gives the files' number. If
    anything fails, both are as they were."""
    folder, report = _destinations(folder, report, root, inputs, owned)
    return len(write_files(files, folder, report=report, report_text=report_text))


def publish(folder: str | Path, files: dict[str, bytes], report: str | Path, report_bytes: bytes, root: str | Path, inputs: list[str | Path] = (), owned: str = "*.yaml") -> None:
    """publish_files() for a few files that the driver has at hand."""
    folder, report = _destinations(folder, report, root, inputs, owned)
    for name in files:
        if Path(name).name != name or name in (".", ".."):
            raise IntegrityError(f"unsafe file name {name!r}")
    for place in (folder, report):
        place.parent.mkdir(parents=True, exist_ok=True)
    stage = Path(tempfile.mkdtemp(prefix=".stage-", dir=folder.parent))
    try:
        (stage / "new").mkdir()
        for name, data in sorted(files.items()):
            (stage / "new" / name).write_bytes(data)
        with open(stage / "report-new", "wb") as f:
            f.write(report_bytes)
            f.flush()
            os.fsync(f.fileno())
        swap([(folder, stage / "new"), (report, stage / "report-new")], stage)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
