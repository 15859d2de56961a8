import json

import pytest
from pyspark.sql import functions as F

from weftline.operators.validate import IntegrityError
from weftline.plans import ingest, publish, targets
from weftline.vocabulary import ITEM, Options

OPTIONS = Options(group=7, included=("papers",), document_classes={"data": "dataset", "tools": "instrument", "papers": "publication", "lists": "registry"}, label_prefix="my ")
FIELDS = [c.split()[0] for c in ITEM.split(", ") if c.split()[0].isidentifier() and "STRUCT" not in c.split()[0]]


def items(spark, *rows):
    base = {"version": 1, "deleted": False, "collections": ["C1"], "creators": [], "tags": []}
    text = [json.dumps({**base, **r}) for r in rows]
    return spark.createDataFrame([(t,) for t in text], "j string").select(F.from_json("j", ITEM, {"mode": "FAILFAST"}).alias("i")).select("i.*")


COLLECTIONS = [("C1", "My Papers"), ("C2", "Data"), ("C3", "Tools"), ("C4", "Other")]


@pytest.fixture
def run(spark):
    def go(*rows, people=(("own:p/ada", ["Ada Lovelace"]),), orgs=(("own:o/lab", ["The Lab"]),), topics=(("own:t/ml", ["ML"]),), aliases=(), existing=()):
        labels = lambda x: spark.createDataFrame(list(x), "pid string, labels array<string>")
        return ingest.transform(
            items(spark, *rows), spark.createDataFrame(COLLECTIONS, "key string, name string"), labels(people), labels(orgs), labels(topics),
            spark.createDataFrame(list(aliases), "key string, pid string"), spark.createDataFrame(list(existing), "pid string, files array<string>"), OPTIONS)

    return go


def author(name=None, first=None, last=None, type_="author"):
    return {"creatorType": type_, "name": name, "firstName": first, "lastName": last}


def test_items_become_records_and_a_report(run):
    out = run(
        {"key": "A", "itemType": "journalArticle", "title": " One ", "DOI": "10.1/X", "ISSN": "1111-1111", "publicationTitle": "J", "date": "2020-01-02", "volume": "3", "pages": "4", "extra": "PMID: 55",
         "creators": [author(first="Ada", last="Lovelace"), author(name="The Lab", type_="editor"), author(first="No", last="Body"), author(first="Ada", last="Lovelace")], "tags": [{"tag": "ml"}, {"tag": "zzz"}]},
        {"key": "B", "itemType": "journalArticle", "title": "One", "DOI": "https://doi.org/10.1/x", "version": 9},
        {"key": "U", "itemType": "journalArticle", "DOI": "10.1/x", "collections": []},
        {"key": "V", "itemType": "book", "collections": []},
        {"key": "D", "itemType": "document", "title": "Set", "collections": ["C1", "C2"]},
        {"key": "E", "itemType": "book", "title": "ONE!", "publicationTitle": "no issn"},
        {"key": "X", "itemType": "book", "collections": ["C4", "C9"]},
        {"key": "G", "itemType": "book", "deleted": True},
        {"key": "P", "itemType": "computerProgram", "title": "Tool"},
        {"key": "W", "itemType": "patent"},
        {"key": "N", "itemType": "journalArticle", "ISSN": "1111-1111", "publicationTitle": "Other"},
        existing=[("https://doi.org/10.1/x", ["f.json"])],
    )
    records = {r.pid: r for r in out["records"].collect()}
    item = lambda k: f"https://api.example.org/groups/7/items/{k}"
    assert {p: r["class"] for p, r in records.items()} == {"https://doi.org/10.1/x": "Publication", item("E"): "Publication", item("P"): "Instrument", item("N"): "Publication"}
    one = records["https://doi.org/10.1/x"]
    assert one.title == "One" and one.kind == "bibo:AcademicArticle" and one.about == ["own:t/ml"]
    assert [(a.object, a.roles) for a in one.attributed_to] == [("own:p/ada", ["marcrel:aut"]), ("own:o/lab", ["marcrel:edt"])]
    assert {(i.schema_type, i.notation) for i in one.identifiers} == {("dlthings:DOI", "10.1/x"), ("dlthings:ISSN", "1111-1111"), ("dlthings:Identifier", "PMID:55"), *(("dlthings:Identifier", f"library:group:7:item:{k}") for k in "ABU")}
    assert [(a.predicate, a.value) for a in one.attributes] == [("bibo:locator", "3, 4"), ("dcterms:issued", "2020-01-02")]
    assert [(g.object, g.at_location, g.at_time) for g in one.generated_by] == [("obo:IAO_0000444", "ISSN:1111-1111", "2020-01-02")]
    assert records[item("P")].name == "Tool" and records[item("P")].title is None and records[item("P")].kind == "obo:IAO_0000010"
    got = {k: v.collect() for k, v in out.items()}
    assert [r.name for r in got["unresolved_creators"]] == ["No Body"] and [r.name for r in got["unresolved_topics"]] == ["zzz"]
    assert {r.group for r in got["review_items"]} == {"item:D", "item:W"}
    assert [(r.pid, r.title) for r in got["venues"]] == [("ISSN:1111-1111", "J")] and [r.group for r in got["venue_conflicts"]] == ["item:N"]
    assert [(r.doi, r.item_keys, r.preferred) for r in got["duplicate_dois"]] == [("10.1/x", ["A", "B", "U"], "A")]
    assert {(r.group, r.field) for r in got["field_conflicts"]} == {("doi:10.1/x", "DOI")}
    assert [(r.key, len(r.pids)) for r in got["title_collisions"]] == [("one", 2)] and got["pid_collisions"][0].files == ["f.json"]
    assert sorted(r.key for r in got["unfiled"]) == ["U", "V"] and [r.key for r in got["attached"]] == ["U"]
    assert [(r.key, r.names) for r in got["excluded"]] == [("X", ["Other", "[unknown:C9]"])]
    assert sorted(r.item for r in got["missing_titles"]) == ["N"] and [(r.item, r.title) for r in got["unresolved_venues"]] == [("E", "no issn")]
    counts = {(r.kind, r.name): r["count"] for r in got["counts"]}
    assert counts["bucket", "selected"] == 7 and counts["collection_memberships", "My Papers"] == 7 and counts["candidate_records", "PublicationVenue"] == 1


@pytest.mark.parametrize(("collections", "want"), [(["C1"], ("Publication", "bibo:Document", None)), (["C2"], ("Dataset", None, None)), (["C3"], ("Instrument", "obo:IAO_0000010", None)), (["C4"], ("Document", "bibo:Document", None)), (["C2", "C3"], (None, None, "conflicting collection classification")), (["C5"], (None, None, "registry enrichment required"))])
def test_documents_are_classified_by_collection(spark, collections, want):
    names = spark.createDataFrame([*COLLECTIONS, ("C5", "lists")], "key string, name string")
    rows = ingest.classify(ingest.source_items(items(spark, {"key": "A", "itemType": "document", "collections": collections}), names, OPTIONS), OPTIONS)
    assert tuple(rows.select("class", "kind", "reason").first()) == want


def test_roles_and_aliases_fail_closed(run):
    with pytest.raises(IntegrityError, match="unsupported creator role: B"):
        run({"key": "A", "itemType": "book", "DOI": "10.1/x", "creators": []}, {"key": "B", "itemType": "book", "DOI": "10.1/x", "creators": [author(name="x", type_="reviewedAuthor")]})
    with pytest.raises(IntegrityError, match="alias against the index.*alias of an unknown pid"):
        run({"key": "A", "itemType": "book"}, aliases=[("adalovelace", "own:o/lab"), ("x", "nowhere")])
    out = run({"key": "A", "itemType": "book", "creators": [author(first="A.", last="L.")]}, aliases=[("al", "own:p/ada")])
    assert out["records"].first().attributed_to[0].object == "own:p/ada" and out["alias_usage"].first()["count"] == 1


POLICY = {"pid_overrides": {}, "allowed_attribution_targets": ["own:p/ada"], "omitted_attribution_targets": {"own:o/lab": "why"}, "allowed_about_targets": [], "omitted_generation_objects": {"obo:IAO_0000444": "why"}, "allowed_curated_generation_targets": [], "curated_generations": {}}
BOOK = {"key": "A", "itemType": "journalArticle", "title": "T", "DOI": "10.1/x", "date": "2020-01-02", "creators": [author(first="Ada", last="Lovelace"), author(name="The Lab")]}


def test_rendering_under_a_policy(spark, run):
    keys = spark.createDataFrame([("A",)], "key string")
    pubs = run(BOOK)["records"].where("class = 'Publication'")
    out = publish.render(pubs, POLICY, keys, "own:publications/", 7)
    record = out["records"].first()
    assert record.pid == "own:publications/doi-10-1-x" and record.generated_by is None
    assert [(a.object, a.schema_type) for a in record.attributed_to] == [("own:p/ada", "dlthings:Attribution")]
    assert {(r.kind, r.target): r.n for r in out["omissions"].collect()} == {("attribution", "own:o/lab"): 1, ("generation", "obo:IAO_0000444"): 1}
    publish.coverage(pubs.select("pid"), out["records"], out["pid_map"])
    curated = POLICY | {"pid_overrides": {"https://doi.org/10.1/x": "own:publications/mine"}, "allowed_curated_generation_targets": ["ev"], "curated_generations": {"https://doi.org/10.1/x": [{"object": "ev", "at_time": "2021", "rationale": "r"}]}}
    record = publish.render(pubs, curated, keys, "own:publications/", 7)["records"].first()
    assert record.pid == "own:publications/mine" and [(g.object, g.at_time) for g in record.generated_by] == [("ev", "2021")]
    for change, message in (({"allowed_attribution_targets": []}, "unreviewed attribution"), ({"omitted_generation_objects": {}}, "unreviewed generation"), ({"allowed_about_targets": ["t"]}, "unused policy entry: allowed_about_targets"), ({"pid_overrides": {"no": "x"}}, "unused policy entry: pid_overrides")):
        with pytest.raises(IntegrityError, match=message):
            publish.render(pubs, POLICY | change, keys, "own:publications/", 7)
    with pytest.raises(IntegrityError, match="item not in the snapshot"):
        publish.render(pubs, POLICY, keys.limit(0), "own:publications/", 7)


def test_candidates_and_decisions(spark, run):
    pubs = publish.render(run(BOOK)["records"].where("class = 'Publication'"), POLICY, spark.createDataFrame([("A",)], "key string"), "own:publications/", 7)["records"]
    source = publish.assertions(pubs)
    assert source.where("predicate = 'dlthings:title'").first().content == "T"
    baseline = spark.createDataFrame([("own:publications/doi-10-1-x", "/attributes", "dlthings:title", "Old", None, 0), ("own:publications/doi-10-1-x", "/attributes", "x", "stale", "me", 1)], "pid string, path string, predicate string, content string, owner string, pos long")
    agents = spark.createDataFrame([("me", "Instrument")], "pid string, class string")
    none = spark.createDataFrame([], "pid string, claim_sha256 string")
    known = pubs.select("pid")
    plan = publish.candidates(source, baseline, none, "me", known, agents).collect()
    assert len(plan) == 1 and plan[0].operation == "modify" and plan[0].removed == 1 and plan[0].added == source.count()
    done = spark.createDataFrame([(plan[0].pid, plan[0].claim_sha256)], "pid string, claim_sha256 string")
    assert publish.candidates(source, baseline, done, "me", known, agents).count() == 0
    changed = source.withColumn("content", F.when(F.col("content") == "T", "T2").otherwise(F.col("content")))
    assert publish.candidates(changed, baseline, done, "me", known.limit(0), agents).first().operation == "add"
    with pytest.raises(IntegrityError, match="instrument"):
        publish.candidates(source, baseline, none, "other", known, agents)


RECORD = (
    "pid string, title string, display_label string, description string, kind string, identifiers array<struct<schema_type: string, notation: string>>, attributed_to array<struct<object: string, roles: array<string>, schema_type: string>>, "
    "about array<string>, attributes array<struct<predicate: string, value: string, schema_type: string>>, generated_by array<struct<object: string, at_location: string, at_time: string, schema_type: string>>"
)


def test_proposals_are_whole_records_and_companions(spark):
    """A new record; a human title kept; equal unowned values; a missing field filled; own assertions taken back, others' kept."""
    ident = lambda k: [("dlthings:Identifier", f"library:group:7:item:{k}")]
    made = lambda pid, title="T", description="D", kind="k", ids=None, people=None, about=None, attributes=None, events=None: (pid, title, title, description, kind, ids or ident(pid[-1].upper()), people, about, attributes, events)
    issued = [("dcterms:issued", "2020", "dlthings:AttributeSpecification")]
    who = [("own:p/ada", ["marcrel:aut"], "dlthings:Attribution")]
    source = [made("own:n", people=who, about=["t"], attributes=issued), made("own:h"), made("own:e"), made("own:f"), made("own:o", description=None)]
    before = [
        (*made("own:h", title="Human"), "Publication/h.yaml"), (*made("own:e"), "Publication/e.yaml"), (*made("own:f", description=None), "Publication/f.yaml"),
        (*made("own:o", people=who, attributes=[*issued, ("dcterms:rights", "free", "dlthings:AttributeSpecification")]), "Publication/o.yaml"),
    ]
    rendered, canonical = spark.createDataFrame(source, RECORD), spark.createDataFrame(before, RECORD + ", rel_path string")
    facts = publish.assertions(canonical.drop("rel_path")).withColumn("assertion_sha256", publish.R.digest(F.to_json(F.struct("path", "predicate", "content"))))
    mine = facts.where("pid = 'own:o' AND (predicate = 'dcterms:issued' OR path = '/attributed_to' OR content = 'D')")
    theirs = facts.where("pid = 'own:o' AND predicate = 'dcterms:rights'")
    notes = mine.select("pid", "path", "assertion_sha256", F.lit("me").alias("imported_by"), F.lit("from").alias("imported_from")).union(theirs.select("pid", "path", "assertion_sha256", F.lit("other"), F.lit("there")))
    agents = spark.createDataFrame([("me", "Instrument")], "pid string, class string")
    none = spark.createDataFrame([], "pid string, claim_sha256 string")
    plan = {r.pid: r for r in publish.proposals(rendered, canonical, notes, none, "me", agents, 7).collect()}
    assert set(plan) == {"own:n", "own:h", "own:f", "own:o"}  # equal unowned values are no change
    new = plan["own:n"]
    assert new.operation == "add" and new.path == "Publication/n.yaml" and new.source_record_id == "item:N" and new.record.title == "T" and new.record.about == ["t"]
    # title, label, description, issued; kind and topic; identifier; attribution
    assert sorted(n.path for n in new.companion) == ["/attributed_to", *["/attributes"] * 4, *["/characterized_by"] * 2, "/identifiers"] and {n.imported_by for n in new.companion} == {"me"} and new.companion[0].imported_from.endswith("/groups/7/items/N")
    human = plan["own:h"]
    assert human.operation == "modify" and human.record.title == "Human" and {(a.predicate, a.value) for a in human.record.attributes} == {("dlthings:title", "T"), ("skos:prefLabel", "T")} and len(human.companion) == 2
    assert plan["own:f"].record.description == "D" and plan["own:f"].record.title == "T"
    gone = plan["own:o"]
    assert gone.removed == 3 and gone.record.attributed_to == [] and [(a.predicate, a.value) for a in gone.record.attributes] == [("dcterms:rights", "free")]
    assert [(n.imported_by, n.imported_from) for n in gone.companion] == [("other", "there")] and gone.record.description == "D"
    changes = {(r.pid, r.file, r.operation) for r in publish.file_changes(publish.proposals(rendered, canonical, notes, none, "me", agents, 7)).collect()}
    assert ("own:n", "annotations/Publication/n.yaml", "add") in changes and ("own:h", "records/Publication/h.yaml", "modify") in changes
    done = spark.createDataFrame([(r.pid, r.claim_sha256) for r in plan.values()], "pid string, claim_sha256 string")
    assert publish.proposals(rendered, canonical, notes, done, "me", agents, 7).count() == 0


def test_proposals_fail_closed(spark):
    agents, none = spark.createDataFrame([("me", "Instrument")], "pid string, class string"), spark.createDataFrame([], "pid string, claim_sha256 string")
    notes = spark.createDataFrame([], "pid string, path string, assertion_sha256 string, imported_by string, imported_from string")
    base = ("own:n", "T", "T", None, "k", [("dlthings:Identifier", "library:group:7:item:N")], None, None, None, [("ev", None, "2020", "g")])
    canonical = spark.createDataFrame([(*base[:-1], [("ev", "there", "2021", "g")], "P/n.yaml")], RECORD + ", rel_path string")

    def go(record, canonical=canonical, owner="me", extra=""):
        return publish.proposals(spark.createDataFrame([record], RECORD + extra), canonical, notes, none, owner, agents, 7)

    with pytest.raises(IntegrityError, match="curated event is absent: own:n"):
        go(base)
    assert go((*base[:-1], [("ev", None, "2021", "g")])).count() == 0
    bad = (*base[:-2], [("x:other", "v", "dlthings:AttributeSpecification")], None)
    with pytest.raises(IntegrityError, match="attribute outside the mapping: own:n: x:other"):
        go(bad)
    with pytest.raises(IntegrityError, match="owner isn't an instrument"):
        go(base, owner="you")
    with pytest.raises(IntegrityError, match="unsupported fields: surprise"):
        go((*base, "x"), extra=", surprise string")
    lost = spark.createDataFrame([("own:n", "/attributes", "sha256:none", "me", "x")], notes.schema)
    with pytest.raises(IntegrityError, match="companion entry without an assertion: own:n"):
        publish.proposals(spark.createDataFrame([base], RECORD), canonical.withColumn("generated_by", F.array(F.struct(F.lit("ev").alias("object"), F.lit("x").alias("at_location"), F.lit("2020").alias("at_time"), F.lit("g").alias("schema_type")))), lost, none, "me", agents, 7)
    good = {"group_id": 7, "library_version": 3, "content_sha256": "ab" * 32}
    assert publish.source_coordinate(good) == {"content_sha256": "sha256:" + "ab" * 32, "group_id": 7, "kind": "public-library", "library_version": 3}
    for change in ({"group_id": "7"}, {"library_version": None}, {"content_sha256": "AB"}):
        with pytest.raises(IntegrityError):
            publish.source_coordinate(good | change)


def test_review_notices_stale_candidates_and_live_blockers(spark):
    make = lambda *r: spark.createDataFrame(list(r), "pid string, record string")
    stored, live = make(("a", '{"x": 1}')), make(("a", '{"x": 2}'), ("b", "{}"))

    def blocked():
        raise IntegrityError("unreviewed target")

    out = publish.review(stored, stored, live, "pid", ["record"], blocked, stored, make(("a", '{"x": 1, "y": 2}')))
    assert {r.pid: r.change for r in out["changes"].collect()} == {"a": "changed", "b": "added"} and out["blockers"] == ["unreviewed target"] and out["violations"].count() == 0
    assert out["queue"] is None and not out["update"]
    plan = spark.createDataFrame([("a", "modify"), ("b", "add"), ("c", "add")], "pid string, operation string")
    out = publish.review(stored, stored, live, "pid", ["record"], lambda: live, stored, stored, plan)
    assert out["site_changes"].count() == 2 and out["update"] and {r.operation: r.n for r in out["queue"].collect()} == {"modify": 1, "add": 2}
    assert not publish.review(stored, stored, stored, "pid", ["record"], lambda: stored, stored, stored)["update"]
    with pytest.raises(IntegrityError, match="stale"):
        publish.review(live, stored, live, "pid", ["record"], blocked, stored, stored)


def test_items_without_a_key_keep_their_own_collections(spark):
    names = spark.createDataFrame(COLLECTIONS, "key string, name string")
    rows = items(spark, {"itemType": "book", "title": "a", "collections": ["C1"]}, {"itemType": "book", "title": "b", "collections": ["C2"]}, {"itemType": "book", "title": "c", "collections": []}, {"itemType": "book", "title": "d", "collections": None})
    assert {r.title: r.names for r in ingest.source_items(rows, names, OPTIONS).collect()} == {"a": ["My Papers"], "b": ["Data"], "c": [], "d": []}


def test_minted_pids_and_relations_of_source_records(spark):
    src = "class string, pid string, record string"
    dump = lambda *r: spark.createDataFrame([(c, p, json.dumps({"pid": p, **x})) for c, p, x in r], src)
    canonical = spark.createDataFrame([("Person", "own:persons/ada", "Person/ada.yaml", json.dumps({"identifiers": [{"notation": "o-1"}]})), ("Publication", "own:publications/old", "Publication/old.yaml", json.dumps({"identifiers": [{"notation": "x-1"}]}))], "class string, pid string, rel_path string, record string")
    source = dump(
        ("Person", "ext:ada", {"identifiers": [{"notation": "o-1"}]}),
        ("Publication", "ext:pub", {"identifiers": [{"notation": "x-1"}], "part_of": [{"object": "ext:ada"}, "ext:ada"], "generated_by": {"object": "ext:ada", "at_location": "ext:ada"}, "creator": ["ext:ada"], "title": "ext:ada"}),
    )
    out = {r.source_pid: json.loads(r.record) for r in targets.source_targets(source, canonical, "own:", {"Publication": "own:publications/"}).collect()}
    # a matched person isn't renamed by minting, so it gains no identifier; a matched publication does
    assert out["ext:ada"]["pid"] == "own:persons/ada" and out["ext:ada"]["identifiers"] == [{"notation": "o-1"}]
    pub = out["ext:pub"]
    assert pub["pid"] == "own:publications/old" and [i["notation"] for i in pub["identifiers"]] == ["x-1", "ext:pub"]
    assert pub["part_of"] == [{"object": "ext:ada"}, "own:persons/ada"] and pub["title"] == "ext:ada"
    assert pub["generated_by"] == {"object": "own:persons/ada", "at_location": "own:persons/ada"} and pub["creator"] == ["own:persons/ada"]
    for record, message in (({"schema_type": "other"}, "type of another class"), ({"identifiers": {"notation": "x"}}, "identifiers aren't a list")):
        with pytest.raises(IntegrityError, match=message):
            targets.source_targets(dump(("Person", "ext:ada", record)), canonical, "own:", {})
    with pytest.raises(IntegrityError, match="class without a directory"):
        targets.source_targets(dump(("../x", "ext:ada", {})), canonical, "own:", {})


def test_source_targets(spark):
    src = "class string, pid string, record string"
    dump = lambda *r: spark.createDataFrame([(c, p, json.dumps({"pid": p, **x})) for c, p, x in r], src)
    primary = dump(("Publication", "https://doi.org/10.1234/A", {"attributed_to": [{"object": "ext:ada", "roles": ["role:a"]}], "about": ["own:t"]}), ("Person", "ext:ada", {"identifiers": [{"notation": "ORCID-1"}]}), ("AgentRole", "role:b", {"roles": ["role:a"]}))
    pool = dump(("AgentRole", "role:a", {"name": "author"}), ("AgentRole", "role:z", {}))
    source = targets.with_roles(primary, pool, "AgentRole")
    assert sorted(r.pid for r in source.collect()) == ["ext:ada", "https://doi.org/10.1234/A", "role:a"]
    canonical = spark.createDataFrame([("Person", "own:persons/ada", "Person/ada.yaml", json.dumps({"pid": "own:persons/ada", "identifiers": [{"notation": "orcid-1"}]}))], "class string, pid string, rel_path string, record string")
    out = {r.source_pid: r for r in targets.source_targets(source, canonical, "own:", {"Publication": "own:publications/"}, "t:").collect()}
    pub = out["https://doi.org/10.1234/A"]
    assert pub.pid == "own:publications/doi-10-1234-a" and pub.path == "Publication/doi-10-1234-a.yaml" and pub.baseline is None
    record = json.loads(pub.record)
    assert record["attributed_to"][0]["object"] == "own:persons/ada" and record["schema_type"] == "t:Publication" and record["identifiers"][0]["notation"] == "https://doi.org/10.1234/A"
    assert out["ext:ada"].pid == "own:persons/ada" and out["ext:ada"].path == "Person/ada.yaml" and out["ext:ada"].baseline is not None
    with pytest.raises(IntegrityError, match="role without a record: role:a"):
        targets.with_roles(primary, pool.where("pid = 'role:z'"), "AgentRole")
    with pytest.raises(IntegrityError, match="records differ"):
        targets.with_roles(primary, pool.unionByName(dump(("Person", "ext:ada", {"x": 1}))), "AgentRole")
    double = canonical.unionByName(spark.createDataFrame([("Person", "own:persons/ada2", "Person/ada2.yaml", canonical.first().record)], canonical.schema))
    with pytest.raises(IntegrityError, match="ambiguous match: ext:ada"):
        targets.source_targets(source, double, "own:", {}, "t:")


def test_a_release_is_published_whole_or_not_at_all(spark, run, tmp_path):
    yaml = pytest.importorskip("yaml")
    from weftline.__main__ import main
    from weftline.plans.release import release
    from weftline.sources import records as S

    root = "https://api.example.org/groups"
    content = [{"key": "A", "data": {"key": "A", "title": "T"}}]
    source = {"group_id": 7, "library_version": 3, "api_root": f"{root}/7", "api_version": "3", "response_api_version": "3", "total_collections": 0, "total_top_level_items": 1, "content_sha256": S.content_sha256([], content), "fetched_at": "2024-01-01T00:00:00+00:00", "collection_urls": [f"{root}/7/collections?x"], "item_urls": [f"{root}/7/items/top?x"]}
    snapshot, policy = tmp_path / "in" / "snapshot.json", tmp_path / "in" / "policy.yaml"
    snapshot.parent.mkdir()
    snapshot.write_text(json.dumps({"source": source, "collections": [], "items": content}))
    policy.write_text(yaml.safe_dump({"format_version": 1, "description": "d", **POLICY}))
    pubs = run(BOOK)["records"].where("class = 'Publication'")
    build = tmp_path / "build"
    places = (build / "site", build / "report.json")
    made = release(pubs, str(snapshot), policy, *places, build, "own:publications/", root)
    assert [p.name for p in places[0].iterdir()] == ["doi-10-1-x.yaml"] and json.loads(places[1].read_text()) == made
    record = yaml.safe_load((places[0] / "doi-10-1-x.yaml").read_text())
    assert record["pid"] == "own:publications/doi-10-1-x" and record["attributed_to"][0]["object"] == "own:p/ada" and "generated_by" not in record
    assert made["output"]["publication_count"] == 1 and made["reviewed_omissions"] == {"attribution:own:o/lab": 1, "generation:obo:IAO_0000444": 1} and made["pid_map"][0]["source_pid"] == "https://doi.org/10.1/x"
    before = places[1].read_bytes()
    policy.write_text(yaml.safe_dump({"format_version": 1, "description": "d", **POLICY, "allowed_attribution_targets": []}))
    with pytest.raises(IntegrityError, match="unreviewed attribution"):
        release(pubs, str(snapshot), policy, *places, build, "own:publications/", root)
    assert places[1].read_bytes() == before
    policy.write_text(yaml.safe_dump({"format_version": 1, "description": "other", **POLICY}))
    pubs.write.parquet(str(tmp_path / "pubs"))
    main(["release", "--publications", str(tmp_path / "pubs"), "--snapshot", str(snapshot), "--policy", str(policy), "--folder", str(places[0]), "--report", str(places[1]), "--root", str(build), "--own-prefix", "own:publications/", "--api-root", root], spark)
    assert json.loads(places[1].read_text())["inputs"]["policy_sha256"] != made["inputs"]["policy_sha256"]
