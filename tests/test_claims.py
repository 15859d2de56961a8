"""Candidates of records of any class: who owns what, and what a source may change."""

import hashlib
import json

import pytest

from weftline.operators.validate import IntegrityError
from weftline.plans import claims

OWNER, OTHER, SOURCE = "own:adapters/v1", "own:adapters/other", "https://example.org/src"
SLOTS = [(c, s, p, o) for c in ("Person", "Publication", "Role") for s, p, o in (("title", "dlthings:title", False), ("description", "dcterms:description", False), ("additional_names", "dlthings:additional_names", False), ("about", "dcterms:subject", True))]
EMPTY = {"path": "pid string, path string, assertion_sha256 string, imported_by string, imported_from string", "decisions": "pid string, claim_sha256 string"}


def attribute(predicate, value):
    return {"predicate": predicate, "schema_type": "dlthings:AttributeSpecification", "value": value}


def digest(assertion):
    return "sha256:" + hashlib.sha256(json.dumps(assertion, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def run(spark, source, baseline=None, notes=(), decisions=(), class_="Publication", directory="data/a", agents=((OWNER, "Instrument"),), more=(), **options):
    """Candidates of one source record on one canonical record, as rows; notes: (path, assertion, owner)."""
    rows = [(class_, "ext:" + source["pid"], source["pid"], "P/x.yaml", json.dumps(source), json.dumps(baseline) if baseline else None, directory), *more]
    targets = spark.createDataFrame(rows, "class string, source_pid string, pid string, path string, record string, baseline string, directory string")
    noted = spark.createDataFrame([(source["pid"], p, digest(a), by, "old") for p, a, by in notes], EMPTY["path"])
    slots = spark.createDataFrame(SLOTS, "class string, slot string, predicate string, is_object boolean")
    settled_ = spark.createDataFrame(list(decisions), EMPTY["decisions"])
    return claims.candidates(targets, noted, settled_, spark.createDataFrame(list(agents), "pid string, class string"), slots, OWNER, SOURCE, **options).collect()


def record(**fields):
    return {"pid": "own:p/1", "schema_type": "Publication", **fields}


def test_a_new_record_is_qualified_and_says_where_it_comes_from(spark):
    source = record(title="Söurce \"1\"\n", about=["t:2", "t:1"], attributes=[attribute("dcterms:issued", "2026")], attributed_to=[{"object": "p:1", "roles": ["aut"]}], identifiers=[{"notation": "n"}])
    (row,) = run(spark, source)
    assert (row.operation, row.source_record_id) == ("add", "Publication:ext:own:p/1")
    assert row.imported_from == SOURCE + "/blob/main/data/a/Publication.json#record=ext%3Aown%3Ap%2F1"
    got = json.loads(row.record)
    subjects = [{"object": t, "predicate": "dcterms:subject"} for t in ("t:2", "t:1")]
    attributes = [attribute("dcterms:issued", "2026"), attribute("dlthings:title", source["title"])]
    assert got == {**source, "attributes": attributes, "characterized_by": subjects}
    assert row.record == json.dumps(got, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    owned = {("/attributes", digest(a)) for a in attributes} | {("/characterized_by", digest(a)) for a in subjects} | {("/attributed_to", digest(source["attributed_to"][0])), ("/identifiers", digest({"notation": "n"}))}
    assert {(c.path, c.assertion_sha256) for c in row.companion} == owned
    assert {(c.imported_by, c.imported_from) for c in row.companion} == {(OWNER, row.imported_from)}


def test_the_claim_s_digest_follows_what_is_said(spark):
    base = record(title="T", attributes=[attribute("dcterms:issued", "2026")], generated_by=[{"object": "a:1"}])
    (first,), (moved,) = run(spark, base), run(spark, base, directory="data/b")
    assert first.claim_sha256 == moved.claim_sha256 and first.companion != moved.companion
    held = run(spark, base, record(title="Curated", extra=1))
    assert held[0].claim_sha256 == first.claim_sha256 and held[0].operation == "modify"
    for change in (record(title="T", attributes=[attribute("dcterms:language", "2026")], generated_by=[{"object": "a:1"}]), record(title="T", attributes=base["attributes"], generated_by=[{"object": "a:2"}]), record(title="U", attributes=base["attributes"], generated_by=base["generated_by"])):
        assert run(spark, change)[0].claim_sha256 != first.claim_sha256
    assert run(spark, base, decisions=[("own:p/1", first.claim_sha256)]) == [] and len(run(spark, base, decisions=[("own:p/1", "sha256:x"), ("own:p/2", first.claim_sha256)])) == 1


def test_a_filled_field_stays_and_the_source_s_value_is_asserted_beside_it(spark):
    human = attribute("dlthings:title", "Human title")
    (row,) = run(spark, record(title="Source title"), record(title="Human title", attributes=[human], note=None))
    got = json.loads(row.record)
    assert got == record(title="Human title", attributes=[human, attribute("dlthings:title", "Source title")], note=None)
    assert [(c.path, c.assertion_sha256, c.imported_by) for c in row.companion] == [("/attributes", digest(attribute("dlthings:title", "Source title")), OWNER)]


def test_what_somebody_asserts_already_gains_no_owner_and_is_no_change(spark):
    held = record(title="Source title", attributes=[attribute("dlthings:title", "Source title")] * 2, identifiers=[])
    assert run(spark, record(title="Source title"), held) == []
    # nor is a differently written baseline
    rows = [("Publication", "s", "own:p/2", "P/y.yaml", json.dumps(record(title="x") | {"pid": "own:p/2"}), '{ "title":"x", "schema_type":"Publication",\n"pid":"own:p/2", "attributes":[' + json.dumps(attribute("dlthings:title", "x")) + "]}", "d")]
    assert run(spark, record(title="Source title"), held, more=rows) == []


def test_an_empty_field_is_filled_and_an_omitted_one_is_not_made(spark):
    old = attribute("dcterms:description", "Old")
    (row,) = run(spark, record(title="T", additional_names=["a", "b"]), record(title="", attributes=[attribute("dlthings:title", "T"), old]), [("/attributes", old, OWNER)])
    got = json.loads(row.record)
    assert got["title"] == "T" and got["additional_names"] == ["a", "b"] and "description" not in got
    assert got["attributes"] == [attribute("dlthings:title", "T"), attribute("dlthings:additional_names", "a"), attribute("dlthings:additional_names", "b")]


def test_an_omission_takes_back_the_owner_s_assertions_only(spark):
    made = {}
    for predicate in ("dcterms:description", "dcterms:issued"):
        made[predicate] = [attribute(predicate, who) for who in ("mine", "human", "other")]
    subjects = [{"object": f"t:{who}", "predicate": "dcterms:subject"} for who in ("mine", "human", "other")]
    unmapped = {"object": "t:kept", "predicate": "skos:related"}
    given = [{"object": f"p:{who}", "schema_type": "dlthings:Attribution"} for who in ("mine", "human", "other")]
    held = record(title="T", description="Curated", about=["t:curated"], attributes=[attribute("dlthings:title", "T"), *made["dcterms:description"], *made["dcterms:issued"]], characterized_by=[*subjects, unmapped], attributed_to=given, generated_by=[given[0]])
    lists = [("/attributes", made["dcterms:description"]), ("/attributes", made["dcterms:issued"]), ("/characterized_by", subjects), ("/attributed_to", given)]
    notes = [(path, some[i], by) for path, some in lists for i, by in ((0, OWNER), (2, OTHER))] + [("/characterized_by", unmapped, OWNER), ("/generated_by", given[0], OWNER)]
    (row,) = run(spark, record(title="T"), held, notes)
    want = held | {"attributes": [held["attributes"][0], *made["dcterms:description"][1:], *made["dcterms:issued"][1:]], "characterized_by": [*subjects[1:], unmapped], "attributed_to": given[1:]}
    del want["generated_by"]
    assert json.loads(row.record) == want
    assert sorted((c.path, c.imported_by, c.imported_from) for c in row.companion) == [("/attributed_to", OTHER, "old"), ("/attributes", OTHER, "old"), ("/attributes", OTHER, "old"), ("/characterized_by", OTHER, "old"), ("/characterized_by", OWNER, "old")]


def test_a_reclaimed_assertion_keeps_its_place_and_follows_the_source(spark):
    old, human = attribute("dcterms:issued", "2026"), attribute("dcterms:rights", "CC0")
    (row,) = run(spark, record(attributes=[attribute("dcterms:language", "en"), old]), record(attributes=[human, old]), [("/attributes", old, OWNER)])
    assert json.loads(row.record)["attributes"] == [human, old, attribute("dcterms:language", "en")]
    assert {c.imported_from for c in row.companion} == {row.imported_from} and len(row.companion) == 2


def test_roles_of_the_authority(spark):
    role = {"pid": "own:p/1", "schema_type": "Role", "title": "author"}
    options = {"class_": "Role", "directory": "pool", "role_directory": "pool"}
    assert run(spark, role, dict(reversed(role.items())), **options) == []
    assert [r.operation for r in run(spark, role, **options)] == ["add"]
    with pytest.raises(IntegrityError, match="authoritative role differs"):
        run(spark, role, role | {"title": "writer"}, **options)
    assert len(run(spark, role, role | {"title": "writer"}, class_="Role", directory="elsewhere", role_directory="pool")) == 1


@pytest.mark.parametrize(
    ("source", "baseline", "options", "message"),
    [
        (record(color="red"), None, {}, "unsupported field: own:p/1: color"),
        (record(close_mappings=["x"]), None, {}, "field without a predicate"),
        ({"pid": "own:p/1", "schema_type": "Person"}, None, {}, "type of another class"),
        ({"pid": "own:p/1"}, None, {}, "type of another class"),
        (record(), record() | {"schema_type": "Person"}, {}, "canonical type of another class"),
        (record(identifiers="x"), None, {}, "isn't a list of assertions"),
        (record(identifiers=["x"]), None, {}, "assertion isn't a mapping"),
        (record(attributes=[{"predicate": "p", "value": "v"}]), None, {}, "attribute of another shape"),
        (record(attributes=[attribute("p", 3)]), None, {}, "attribute of another shape"),
        (record(attributes=[attribute("", "x")]), None, {}, "attribute of another shape"),
        (record(attributes=[attribute("dlthings:title", "x")]), None, {}, "attribute by a field's predicate"),
        (record(), record(), {"notes": [("/attributes", attribute("p", "gone"), OTHER)]}, "companion entry without an assertion"),
        (record(), None, {"agents": [(OWNER, "Person")]}, "owner isn't an instrument"),
        (record(), None, {"more": [("Publication", "s", "own:p/1", "P/y.yaml", json.dumps(record()), None, "d")]}, "repeated target pid"),
    ],
)
def test_what_is_refused(spark, source, baseline, options, message):
    with pytest.raises(IntegrityError, match=message):
        run(spark, source, baseline, **options)


def test_no_python_runs_in_the_plan(spark):
    source = spark.createDataFrame([("Publication", "own:p/1", json.dumps(record(title="T")))], "class string, pid string, record string")
    slots = spark.createDataFrame(SLOTS, "class string, slot string, predicate string, is_object boolean")
    plan = claims.claimed_assertions(source, slots, "x")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "variant_explode" in plan
