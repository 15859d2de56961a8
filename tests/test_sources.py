import http.server
import json
import os
import subprocess
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from weftline.operators.validate import IntegrityError
from weftline.sources import http as H
from weftline.sources import records as S
from weftline.sources import sinks as K

yaml = pytest.importorskip("yaml")


class Library(http.server.BaseHTTPRequestHandler):
    rows = [{"key": f"K{i:03d}", "data": {"key": f"K{i:03d}", "n": i}} for i in range(101)]
    calls, version, fail, drift = [], 42, [], False

    def do_GET(self):
        cls = type(self)
        cls.calls.append((self.path, dict(self.headers)))
        if cls.fail:
            code, header = cls.fail.pop(0)
            self.send_response(code)
            for k, v in header.items():
                self.send_header(k, v)
            self.end_headers()
            return
        q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
        start, limit = int(q["start"]), int(q["limit"])
        if cls.drift and start:
            cls.version += 1
        body = json.dumps(list(reversed(cls.rows[start : start + limit]))).encode()
        self.send_response(200)
        for k, v in (("Last-Modified-Version", cls.version), ("Total-Results", len(cls.rows)), ("Api-Version", "3")):
            self.send_header(k, str(v))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def library():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Library)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Library.calls, Library.version, Library.fail, Library.drift = [], 42, [], False
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_delays():
    assert H.retry_delay({"Retry-After": "0.25"}, 3) == 0.25 and H.retry_delay({"Backoff": "-2"}, 0) == 0
    assert H.retry_delay({"Retry-After": "soon"}, 2) == 4 and H.retry_delay({}, 9) == 16
    assert H.required_integer_header({"Total-Results": "7"}, "total-results", "u") == 7
    with pytest.raises(ValueError):
        H.required_integer_header({}, "total-results", "u")


def test_retries_and_versions(library):
    waits = []
    Library.fail = [(429, {"Retry-After": "0.25"})]
    rows, _ = H.fetch_json(f"{library}/x?start=0&limit=1", "me", ("Api-Version", "3"), waits.append)
    assert len(rows) == 1 and waits == [0.25] and Library.calls[-1][1]["Api-Version"] == "3"
    with pytest.raises(ValueError, match="API version"):
        H.fetch_json(f"{library}/x?start=0&limit=1", "me", ("Api-Version", "4"), waits.append)
    Library.fail = [(404, {})]
    with pytest.raises(Exception, match="404"):
        H.fetch_json(f"{library}/x?start=0&limit=1", "me", None, waits.append)
    Library.fail = [(503, {})] * 5
    with pytest.raises(Exception, match="503"):
        H.fetch_json(f"{library}/x?start=0&limit=1", "me", None, waits.append)


def test_pages_become_partitions_of_one_snapshot(spark, library):
    out = H.fetch_snapshot(spark, library, ("items/top",), 42, versionHeader="Api-Version", versionValue="3")["items/top"]
    assert [r.key for r in out.collect()] == [r["key"] for r in Library.rows]
    assert out.select("version").distinct().first()[0] == 42
    with pytest.raises(ValueError, match="not 41"):
        H.fetch_snapshot(spark, library, ("items/top",), 41)
    Library.drift = True
    with pytest.raises(Exception, match="changed|SnapshotChanged"):
        H.fetch_snapshot(spark, library, ("items/top",))


def test_class_arrays(spark, tmp_path):
    (tmp_path / "Person.json").write_text('[{"pid": "p1", "name": "é"}, {"pid": "p2"}]')
    (tmp_path / "Topic.json").write_text("[]")
    got = sorted((r["class"], r.pid, r.record) for r in S.class_arrays(spark, str(tmp_path)).collect())
    assert [x[:2] for x in got] == [("Person", "p1"), ("Person", "p2")] and json.loads(got[0][2])["name"] == "é"
    (tmp_path / "Topic.json").write_text('[{"pid": "p1"}, {"name": "none"}]')
    with pytest.raises(IntegrityError, match="missing pid.*repeated pid: p1"):
        S.class_arrays(spark, str(tmp_path))
    (tmp_path / "Bad.json").write_text("{not json")
    (tmp_path / "Object.json").write_text('{"pid": "p3"}')
    found = S.pid_files(S.class_arrays(spark, str(tmp_path), tolerant=True))
    assert {r.pid: len(r.files) for r in found.collect()} == {"p1": 2, "p2": 1}


def test_yaml_records_and_companions(spark, tmp_path):
    for name, text in {"records/Grant/a.yaml": "pid: g1\ntitle: ü\n", "records/Person/b.yaml": "pid: p1\nabout: [x]\n", "records/.hidden.yaml": "x: 1", "notes/Grant/a.yaml": "record: g1\n"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    load = lambda: S.yaml_records(spark, str(tmp_path / "records"), str(tmp_path / "notes"), strict=False)
    got = {r.pid: r for r in load().collect()}
    assert got["g1"]["class"] == "Grant" and got["g1"].rel_path == "Grant/a.yaml" and json.loads(got["g1"].companion) == {"record": "g1"}
    assert got["p1"].companion is None and json.loads(got["p1"].record) == {"pid": "p1", "about": ["x"]}
    (tmp_path / "records/Person/c.yaml").write_text("pid: p2\npid: p3\n")
    (tmp_path / "notes/Person").mkdir()
    (tmp_path / "notes/Person/none.yaml").write_text("record: x\n")
    with pytest.raises(IntegrityError, match="companion without a record.*unreadable: Person/c.yaml"):
        load()


def test_a_fetched_snapshot_becomes_a_document_and_loads_again(spark, tmp_path):
    root = "https://api.example.org/groups"
    rows = lambda name, *keys: spark.createDataFrame([(k, json.dumps({"key": k, "data": {"key": k, "name": "é", "title": "t"}}, ensure_ascii=False), 5, len(keys), f"{root}/7/{name}?start=0") for k in keys], "key string, record string, version long, total long, url string")
    fetched = {"collections": rows("collections", "C2", "C1"), "items/top": rows("items/top", "B", "A")}
    document = S.snapshot_document(fetched, root, 7, "2024-01-01T00:00:00+00:00")
    K.atomic_json(tmp_path / "snapshot.json", document)
    source, collections, items = S.load_snapshot(spark, str(tmp_path / "snapshot.json"), root)
    assert source["library_version"] == 5 and [r.key for r in collections.collect()] == ["C1", "C2"] and [r.key for r in items.collect()] == ["A", "B"]
    with pytest.raises(IntegrityError, match="several versions"):
        S.snapshot_document(fetched | {"collections": fetched["collections"].withColumn("version", F.lit(6).cast("long"))}, root, 7, "2024-01-01T00:00:00+00:00")


def test_foreign_files_are_refused(spark, tmp_path):
    (tmp_path / "records/Grant").mkdir(parents=True)
    (tmp_path / "records/Grant/a.yaml").write_text("pid: g1\n")
    (tmp_path / "records/.store.yaml").write_text("x: 1\n")
    load = lambda: S.yaml_records(spark, str(tmp_path / "records"), config=".store.yaml")
    assert load().count() == 1
    (tmp_path / "records/Grant/note.txt").write_text("x")
    (tmp_path / "records/Grant/.b.yaml").write_text("pid: g2\n")
    (tmp_path / "records/Grant/link.yaml").symlink_to(tmp_path / "records/Grant/a.yaml")
    (tmp_path / "records/linked").symlink_to(tmp_path / "records/Grant")
    found = {r.rel_path: r.reason for r in S.foreign_files(spark, str(tmp_path / "records"), ".store.yaml").collect()}
    assert found == {"Grant/note.txt": "not a record file", "Grant/.b.yaml": "hidden", "Grant/link.yaml": "symbolic link", "linked": "symbolic link"}
    with pytest.raises(IntegrityError, match="foreign file: Grant/.b.yaml"):
        load()


def snapshot():
    items = [{"key": "A", "version": 3, "data": {"key": "A", "itemType": "dataset", "tags": ["plain", {"tag": "t"}]}}, {"key": "B", "data": {"key": "B", "deleted": 1}}]
    collections = [{"key": "C", "data": {"key": "C", "name": "Papers"}}]
    root = "https://api.example.org/groups"
    source = {"group_id": 7, "library_version": 9, "api_root": f"{root}/7", "api_version": "3", "response_api_version": "3", "total_collections": 1, "total_top_level_items": 2, "content_sha256": S.content_sha256(collections, items), "fetched_at": "2024-01-01T00:00:00+00:00", "collection_urls": [f"{root}/7/collections?start=0"], "item_urls": [f"{root}/7/items/top?start=0"]}
    return {"source": source, "collections": collections, "items": items}


def test_snapshot_integrity(spark, tmp_path):
    path = tmp_path / "s.json"
    K.atomic_json(path, snapshot())
    source, collections, items = S.load_snapshot(spark, str(path), "https://api.example.org/groups")
    assert source["group_id"] == 7 and collections.collect()[0].name == "Papers"
    assert [(r.key, r.version, r.deleted, [t.tag for t in r.tags]) for r in items.collect()] == [("A", 3, False, ["plain", "t"]), ("B", 0, True, [])]
    for change in (lambda s: s["items"][0]["data"].update(title="x"), lambda s: s["items"].reverse(), lambda s: s["source"].update(fetched_at="2024-01-01"), lambda s: s["source"].update(library_version=-1), lambda s: s["source"].update(item_urls=["https://elsewhere"]), lambda s: s["items"].append({"key": ""})):
        broken = snapshot()
        change(broken)
        with pytest.raises(IntegrityError):
            S.validate_snapshot(broken, "https://api.example.org/groups")


POLICY = {"format_version": 1, "description": "d", "pid_overrides": {}, "allowed_attribution_targets": ["a"], "omitted_attribution_targets": {"b": "why"}, "allowed_about_targets": [], "omitted_generation_objects": {}, "allowed_curated_generation_targets": ["o"], "curated_generations": {"p": [{"object": "o", "rationale": "r"}]}}


def test_policy_contract():
    assert S.parse_policy(yaml.safe_dump(POLICY).encode()) == POLICY
    for change in ({"extra": 1}, {"format_version": 2}, {"allowed_attribution_targets": ["a", "a"]}, {"omitted_attribution_targets": {"a": "both"}}, {"curated_generations": {"p": []}}, {"curated_generations": {"p": [{"object": "o", "rationale": "r"}, {"object": "o", "rationale": "s"}]}}):
        with pytest.raises(IntegrityError):
            S.parse_policy(yaml.safe_dump(POLICY | change).encode())
    with pytest.raises(yaml.YAMLError):
        S.parse_policy(b"format_version: 1\nformat_version: 1\n")


def test_aliases_and_decisions(spark):
    good = S.aliases(spark, [{"pid": "p", "aliases": ["Ada L.", "ADA-L"]}, {"pid": "q", "aliases": ["Bob"]}])
    assert sorted(map(tuple, good.collect())) == [("adal", "p"), ("bob", "q")]
    with pytest.raises(IntegrityError, match="alias of two: bob.*empty alias"):
        S.aliases(spark, [{"pid": "p", "aliases": ["Bob"]}, {"pid": "q", "aliases": ["bob", "--"]}])
    assert S.decisions(spark, {"p": {"claim_sha256": "c", "disposition": "accept"}}).first().claim_sha256 == "c"


def test_pinned_checkout(tmp_path):
    def git(*args):
        return subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True, text=True).stdout.strip()

    git("init", "-q")
    (tmp_path / "data").mkdir()
    (tmp_path / "data/x").write_text("1")
    git("add", "."), git("commit", "-qm", "x")
    commit = git("rev-parse", "HEAD")
    assert S.pinned_checkout(str(tmp_path), commit, "data")["tree"] == git("rev-parse", "HEAD:data")
    for bad in (("0" * 40, "data"), (commit[:7], "data"), (commit, "../data"), (commit, "/data")):
        with pytest.raises(IntegrityError):
            S.pinned_checkout(str(tmp_path), *bad)
    (tmp_path / "data/x").write_text("2")
    with pytest.raises(IntegrityError, match="changes"):
        S.pinned_checkout(str(tmp_path), commit, "data")


def test_files_of_classes_and_change_sets(spark, tmp_path):
    df = spark.createDataFrame([("A", "2", '{"pid": "2", "b": "é", "a": [1]}'), ("A", "1", '{"pid": "1"}')], "class string, pid string, record string")
    counts = K.class_files(df, tmp_path, ["A", "B"])
    assert counts == {"A": 2, "B": 0}
    text = (tmp_path / "A.json").read_text()
    assert [r["pid"] for r in json.loads(text)] == ["1", "2"] and '"a": [' in text and "é" in text and json.loads((tmp_path / "B.json").read_text()) == []
    assert K.change_set({"A": 2, "B": 0, "C": 0}, {"B"}) == {"A": "replace", "B": "delete"}
    K.write_class_tables(df, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2
    assert K.yaml_bytes({"z": "ü", "a": 1}) == "z: ü\na: 1\n".encode()


def test_identity_tables(spark):
    canonical = spark.createDataFrame([("x",)], "pid string")
    make = lambda *r: spark.createDataFrame(list(r), "pid string, aliases array<string>")
    out = K.identity_tables(make(("own:persons/a", ["A", "B"]), ("own:orgs/c", ["C"])), canonical, {"own:persons/": "people", "own:orgs/": "organizations"})
    assert sorted(map(tuple, out["people"].collect())) == [("own:persons/a", "A"), ("own:persons/a", "B")] and out["organizations"].count() == 1
    with pytest.raises(IntegrityError, match="identity is canonical: x.*identity without alias.*identity without route: x"):
        K.identity_tables(make(("x", ["A"]), ("own:orgs/d", [])), canonical, {"own:orgs/": "organizations"})


def test_publication_is_all_or_nothing(tmp_path, monkeypatch):
    root, folder, report = tmp_path / "build", tmp_path / "build/out", tmp_path / "build/report.json"
    root.mkdir()
    publish = lambda files, data: K.publish(folder, files, report, data, root)
    state = lambda: ({p.name: p.read_bytes() for p in folder.iterdir()}, report.read_bytes(), sorted(p.name for p in root.iterdir()))
    publish({"a.yaml": b"1"}, b"r1")
    before = state()
    real = os.replace
    for fail_at in range(4):
        calls = []

        def broken(a, b, fail_at=fail_at, calls=calls):
            calls.append(a)
            if len(calls) == fail_at + 1:
                raise OSError("no space")
            return real(a, b)

        monkeypatch.setattr(os, "replace", broken)
        with pytest.raises(OSError):
            publish({"b.yaml": b"2"}, b"r2")
        monkeypatch.setattr(os, "replace", real)
        assert state() == before
    publish({"b.yaml": b"2"}, b"r2")
    assert state() == ({"b.yaml": b"2"}, b"r2", ["out", "report.json"])
    (folder / "mine.txt").write_text("x")
    with pytest.raises(IntegrityError, match="aren't ours"):
        publish({}, b"")
    for bad in (lambda: K.safe_destination(tmp_path / "x", root), lambda: K.safe_destination(root, root), lambda: K.safe_destination(folder, root, [folder / "in"]), lambda: publish({"../x": b""}, b"")):
        with pytest.raises(IntegrityError):
            bad()
    (root / "link").symlink_to(tmp_path)
    with pytest.raises(IntegrityError, match="symbolic"):
        K.safe_destination(root / "link/x", root)


def test_streamed_decisions_keep_the_latest(spark, tmp_path):
    from weftline.streaming import upkeep

    schema = "pid string, disposition string, version long"
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "check"))
    for rows in ([("a", "accept", 1), ("b", "reject", 1)], [("a", "reject", 2), ("c", "accept", 1), ("b", "accept", 0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        upkeep.keep_latest(stream, table, checkpoint, "pid", "version", availableNow=True).awaitTermination()
    got = sorted(tuple(r) for r in upkeep.current(spark, table).select("pid", "disposition", "version").collect())
    assert got == [("a", "reject", 2), ("b", "reject", 1), ("c", "accept", 1)]
    upkeep.upsert(spark.createDataFrame([("a", "accept", 1)], schema).where(F.lit(False)), table, 1, "pid", "version")
    assert upkeep.current(spark, table).count() == 2
