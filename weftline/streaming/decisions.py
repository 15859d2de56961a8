"""The review queue over time: candidates and decisions arrive in any order, and what awaits a decision is kept up.

Events are (pid, kind 'candidate' or 'decision', claim_sha256, disposition, at). A record's candidate is its latest claim;
it is settled by a decision on that very claim and open otherwise, so a changed claim opens a settled record again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import compare
from . import upkeep

EVENT = "pid string, kind string, claim_sha256 string, disposition string, at timestamp"
CHANGE = "pid string, claim_sha256 string, status string, reopened boolean, seq long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def candidates_of(events: DataFrame) -> DataFrame:
    """(pid, claim_sha256) of each record's latest claim; of claims at one time the greatest."""
    some = events.where("kind = 'candidate' AND pid IS NOT NULL AND claim_sha256 IS NOT NULL AND at IS NOT NULL")
    return some.groupBy("pid").agg(F.max_by("claim_sha256", F.struct("at", "claim_sha256")).alias("claim_sha256"))


def open_claims(events: DataFrame) -> DataFrame:
    """(pid, claim_sha256) that await a decision, from all events at once: what the stream's table comes to."""
    decided = events.where("kind = 'decision' AND pid IS NOT NULL AND claim_sha256 IS NOT NULL AND at IS NOT NULL")
    return compare.pending(candidates_of(events), decided)


class ReviewQueue(StatefulProcessor):
    """Per pid: its claim with the decision on it, and decisions on other claims, which go `keep_ms` after they were last
    touched (never if it is None). Gives a row for each change of what awaits a decision."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "claim string, at long, disposition string, decided long, status string, seq long")
        self.others = handle.getMapState("others", "claim string", "disposition string, decided long", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        claim, at, disposition, decided, status, seq = self.current.get() if self.current.exists() else (None, None, None, None, None, 0)
        before, was_settled = (claim, status), status is not None and status != "open"
        newest, verdicts = (at, claim) if claim is not None else None, {}
        for row in rows:
            if row.kind == "candidate":
                newest = (row.at, row.claim_sha256) if newest is None else max(newest, (row.at, row.claim_sha256))
            elif row.kind == "decision":
                new = (row.at, row.disposition or "")
                verdicts[row.claim_sha256] = max(new, verdicts.get(row.claim_sha256, new))
        if newest is not None and newest[1] != claim:
            if disposition is not None:
                self.others.updateValue((claim,), (disposition, decided))
            claim, at = newest[1], newest[0]
            held = self.others.getValue((claim,)) if self.others.containsKey((claim,)) else None
            disposition, decided = held if held else (None, None)
            if held:
                self.others.removeKey((claim,))
        elif newest is not None:
            at = newest[0]
        for about, (when, what) in verdicts.items():
            if about == claim:
                if decided is None or (when, what) > (decided, disposition):
                    disposition, decided = what, when
            else:
                held = self.others.getValue((about,)) if self.others.containsKey((about,)) else None
                if held is None or (when, what) > (held[1], held[0]):
                    self.others.updateValue((about,), (what, when))
        if claim is None:
            return
        status = "open" if disposition is None else disposition
        changed = (claim, status) != before
        seq += changed
        self.current.update((claim, at, disposition, decided, status, seq))
        if changed:
            yield Row(pid=key[0], claim_sha256=claim, status=status, reopened=was_settled and status == "open", seq=seq)

    def close(self) -> None:
        pass


def review_changes(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """CHANGE rows of a stream of events (EVENT); seq numbers a pid's changes. Events without pid, claim or time are left out.

    State is kept by pid in RocksDB and survives restarts with the query's checkpoint.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    known = events.where("pid IS NOT NULL AND claim_sha256 IS NOT NULL AND at IS NOT NULL").withColumn("at", F.unix_micros("at"))
    mode = "None" if keep_ms is None else "ProcessingTime"
    return known.groupBy("pid").transformWithState(ReviewQueue(keep_ms), CHANGE, "Update", mode)


def keep_queue(events: DataFrame, path: str, checkpoint: str, keep_ms: int | None = None, **trigger) -> StreamingQuery:
    """Starts a query that keeps the latest change of each pid as a table (upkeep.current() reads it). With keep_ms state
    expires by the clock, so such a query goes on until it is stopped and takes no trigger that ends by itself."""
    write = review_changes(events, keep_ms).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    write = write.foreachBatch(lambda batch, i: upkeep.upsert(batch, path, i, "pid", "seq"))
    return (write.trigger(**trigger) if trigger else write).start()
