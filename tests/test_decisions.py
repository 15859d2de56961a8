"""The review queue as a stream, against the anti join over all events."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftline.streaming import decisions, upkeep

pytest.importorskip("google.protobuf")


def event(pid, kind, claim, minute, disposition=None):
    return (pid, kind, claim, disposition, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute))


def fed(spark, tmp_path, batches):
    """Each batch is read by a query of its own, started again on the same checkpoint; gives the changes so far."""
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "check"))
    for rows in batches:
        spark.createDataFrame(rows, decisions.EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(decisions.EVENT).parquet(source)
        decisions.keep_queue(stream, table, checkpoint, availableNow=True).awaitTermination()
    return {r.pid: (r.claim_sha256, r.status, r.reopened, r.seq) for r in upkeep.current(spark, table).collect()}


def test_changed_claims_open_again_and_the_same_ones_stay_settled(spark, tmp_path):
    got = fed(
        spark,
        tmp_path,
        [
            [event("a", "candidate", "1", 0), event("b", "candidate", "1", 0), event("c", "decision", "1", 0, "reject"), event(None, "candidate", "1", 0), event("d", "candidate", None, 0)],
            [event("a", "decision", "1", 5, "accept"), event("a", "decision", "2", 4, "reject"), event("c", "candidate", "1", 9)],
            [event("a", "candidate", "3", 8), event("b", "candidate", "1", 9), event("b", "decision", "0", 9, "accept")],
        ],
    )
    assert got == {"a": ("3", "open", True, 3), "b": ("1", "open", False, 1), "c": ("1", "reject", False, 1)}
    # a claim that comes back finds the decision on it, and an older claim that comes late changes nothing
    got = fed(spark, tmp_path, [[event("a", "candidate", "2", 20), event("b", "candidate", "9", 3)]])
    assert got["a"] == ("2", "reject", False, 4) and got["b"] == ("1", "open", False, 1)


def test_the_table_equals_the_batch_anti_join(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        kind = ["candidate", "decision"][int(rng.integers(2))]
        rows.append(event(f"p{rng.integers(40)}", kind, f"c{rng.integers(4)}", int(rng.integers(200)), ["accept", "reject"][int(rng.integers(2))] if kind == "decision" else None))
    got = fed(spark, tmp_path, [rows[:150], rows[150:160], rows[160:]])
    every = spark.createDataFrame(rows, decisions.EVENT)
    want = {r.pid: r.claim_sha256 for r in decisions.open_claims(every).collect()}
    assert {p: c for p, (c, status, *_) in got.items() if status == "open"} == want and 0 < len(want) < len(got)
    assert {p: v[0] for p, v in got.items()} == {r.pid: r.claim_sha256 for r in decisions.candidates_of(every).collect()}
    latest = every.where("kind = 'decision'").groupBy("pid", "claim_sha256").agg(F.max(F.struct("at", "disposition")).alias("d"))
    said = {(r.pid, r.claim_sha256): r.d.disposition for r in latest.collect()}
    assert all(status in ("open", said.get((p, c))) for p, (c, status, *_) in got.items())


class Kept:
    """States of one key, as a handle gives them."""

    def __init__(self):
        self.value, self.map, self.ttl = None, {}, []

    def getValueState(self, name, schema):
        return type("V", (), {"exists": lambda _: self.value is not None, "get": lambda _: self.value, "update": lambda _, v: setattr(self, "value", v)})()

    def getMapState(self, name, key, value, ttl):
        self.ttl.append(ttl)
        return type("M", (), {"containsKey": lambda _, k: k in self.map, "getValue": lambda _, k: self.map.get(k), "updateValue": lambda _, k, v: self.map.update({k: v}), "removeKey": lambda _, k: self.map.pop(k)})()


def test_only_decisions_on_other_claims_may_expire():
    handle, queue = Kept(), decisions.ReviewQueue(1000)
    queue.init(handle)
    row = lambda kind, claim, at, disposition=None: Row(kind=kind, claim_sha256=claim, disposition=disposition, at=at)
    changes = lambda *rows: [(r.claim_sha256, r.status, r.reopened, r.seq) for r in queue.handleInputRows(("a",), iter(rows), None)]
    assert changes(row("decision", "1", 1, "accept")) == [] and handle.map == {("1",): ("accept", 1)}
    assert changes(row("candidate", "1", 0)) == [("1", "accept", False, 1)] and handle.map == {}
    assert changes(row("candidate", "2", 5)) == [("2", "open", True, 2)] and handle.map == {("1",): ("accept", 1)}
    handle.map.clear()  # the time to live has passed
    assert changes(row("candidate", "1", 9)) == [("1", "open", False, 3)]
    assert handle.ttl == [1000]
