"""A Spark data source that writes sets of ordinary files: tasks write their parts, and the whole set appears at once.

Rows are (file, text). A file is what stands before the first row, the rows' texts with what stands between them, and
what stands after the last; a null text makes a file without rows. Every task writes its own segment of a file beside the target folder; only when all tasks
have ended are segments put together, in order of tasks, and the finished folder (and a report, if one goes with it)
takes the old one's place. A failure anywhere leaves everything as it was. Driver and executors must share the folder's
file system.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.validate import IntegrityError

FORMAT = "weftline_files"


def pretty(text: str) -> str:
    """A JSON text as an entry of an indented array: ascending keys, text as it is."""
    return json.dumps(json.loads(text), indent=2, sort_keys=True, ensure_ascii=False).replace("\n", "\n  ")


#: What stands before, between and after the rows of a file, all of a file without rows, and how a row is written.
SHAPES = {"text": ("", "", "", "", str), "json-array": ("[\n  ", ",\n  ", "\n]\n", "[]\n", pretty)}


def swap(pairs: list[tuple[Path, Path]], spare: Path) -> None:
    """Puts each new path in its target's place, the old ones going to `spare` first. A failure undoes all of it."""
    done: list[tuple[Path, Path]] = []
    try:
        for i, (target, _) in enumerate(pairs):
            if target.exists():
                os.replace(target, spare / f"old-{i}")
                done.append((spare / f"old-{i}", target))
        for target, new in pairs:
            os.replace(new, target)
            done.append((target, new))
    except BaseException:
        for now, then in reversed(done):
            os.replace(now, then)
        raise


@dataclass
class Segments(WriterCommitMessage):
    """What a task has written, as (file, segment, rows)."""

    partition: int
    written: list[tuple[str, str, int]]


class FileSetWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.report = Path(options["path"]), options.get("report")
        self.payload, self.manifest, self.shape = options.get("reporttext", ""), options.get("manifest"), options.get("shape", "text")
        self.stage = self.folder.parent / f".stage-{uuid.uuid4().hex}"
        self.whole = options.get("whole", "true") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segments:
        context = TaskContext.get()
        place = self.stage / f"task-{context.partitionId():08d}-{context.taskAttemptId()}"
        _, between, _, _, render = SHAPES[self.shape]
        written: list[tuple[str, str, int]] = []
        handle, name, rows = None, None, 0
        try:
            for batch in iterator:
                for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if file != name:
                        if handle:
                            handle.close()
                            written.append((name, handle.name, rows))
                        if not file or os.path.basename(file) != file or file in (".", ".."):
                            raise IntegrityError(f"unsafe file name {file!r}")
                        place.mkdir(parents=True, exist_ok=True)
                        handle, name, rows = open(place / f"{len(written):08d}", "w", encoding="utf-8"), file, 0
                    if text is not None:
                        handle.write((between if rows else "") + render(text))
                        rows += 1
        finally:
            if handle:
                handle.close()
        if handle:
            written.append((name, handle.name, rows))
        return Segments(context.partitionId(), written)

    def commit(self, messages: list[Segments | None]) -> None:
        try:
            head, between, tail, empty, _ = SHAPES[self.shape]
            files: dict[str, list[tuple[str, int]]] = {}
            for message in sorted((m for m in messages if m), key=lambda m: m.partition):
                for file, segment, rows in message.written:
                    files.setdefault(file, []).append((segment, rows))
            if self.shape == "text" and any(len(s) > 1 or s[0][1] > 1 for s in files.values()):
                raise IntegrityError("repeated file name: " + next(f for f, s in sorted(files.items()) if len(s) > 1 or s[0][1] > 1))
            new = self.stage / "new"
            new.mkdir(parents=True)
            for file, segments in files.items():
                if len(segments) == 1 and not head + tail:
                    os.replace(segments[0][0], new / file)
                    continue
                segments = [s for s in segments if s[1]]
                with open(new / file, "w", encoding="utf-8") as out:
                    if not segments:
                        out.write(empty)
                        continue
                    out.write(head)
                    for i, (segment, _) in enumerate(segments):
                        out.write(between if i else "")
                        with open(segment, encoding="utf-8") as part:
                            shutil.copyfileobj(part, out, 1 << 20)
                    out.write(tail)
            if self.whole:
                pairs = [(self.folder, new)]
            else:
                self.folder.mkdir(parents=True, exist_ok=True)
                pairs = [(self.folder / file, new / file) for file in sorted(files)]
            if self.report:
                with open(self.stage / "report", "wb") as f:
                    f.write(self.payload.encode())
                    f.flush()
                    os.fsync(f.fileno())
                pairs.append((Path(self.report), self.stage / "report"))
            swap(pairs, self.stage)
            if self.manifest:
                Path(self.manifest).write_text(json.dumps({file: sum(n for _, n in s) for file, s in files.items()}))
        finally:
            shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages: list[Segments | None]) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class FileSet(DataSource):
    """Options: path (the folder), shape ('text': a file to a row; 'json-array'), whole ('true': the folder's other
    files go), report and reporttext (a file that is replaced together with the folder), manifest (where counts go)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, text string"

    def writer(self, schema, overwrite: bool) -> FileSetWriter:
        return FileSetWriter(dict(self.options))


def write_files(rows: DataFrame, folder: str | Path, *order: str, shape: str = "text", whole: bool = True, report: str | Path | None = None, report_text: str = "") -> dict[str, int]:
    """Writes rows (file, text, order...) as the files of a folder, in order within each; gives the rows of each file.

    Rows are dealt to tasks by ranges of file and order, so a large file is several tasks' work. No rows make an empty
    folder (with `whole`) and change nothing otherwise.
    """
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(FileSet)
    folder = Path(os.path.abspath(folder))
    folder.parent.mkdir(parents=True, exist_ok=True)
    manifest = folder.parent / f".manifest-{uuid.uuid4().hex}"
    options = {"path": str(folder), "shape": shape, "whole": str(whole).lower(), "manifest": str(manifest)}
    if report:
        Path(report).parent.mkdir(parents=True, exist_ok=True)
        options |= {"report": os.path.abspath(report), "reporttext": report_text}
    ranged = rows.repartitionByRange("file", *order).sortWithinPartitions("file", *order)
    try:
        ranged.select(F.col("file").cast("string"), F.col("text").cast("string")).write.format(FORMAT).mode("append").options(**options).save()
        return json.loads(manifest.read_text())
    finally:
        manifest.unlink(missing_ok=True)
