import pytest
from pyspark.sql import functions as F

from weftline.operators import compare, entity, merge, resolve, validate


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("", 5)], "pid string, n int")
    assert rows(validate.repeated(df, "pid"), "pid", "rows") == [("a", 2)]
    assert validate.missing(df, "pid").count() == 2
    assert rows(validate.outside(df, "pid", spark.createDataFrame([("a",)], "v string"), "v"), "n") == [(3,), (4,), (5,)]
    assert validate.unknown_fields(df, ["pid"]) == ["n"]
    one = spark.createDataFrame([("x", "1"), ("y", "1")], "category string, entry string")
    assert rows(validate.unused(one, one.where("category = 'x'")), "category") == [("y",)]
    assert rows(validate.residue(df, spark.createDataFrame([("b",), ("c",)], "pid string"), "pid"), "pid", "side") == [("", "left"), ("a", "left"), ("c", "right"), (None, "left")]
    judged = validate.judged(df, "pid", spark.createDataFrame([("a",)], "t string"), spark.createDataFrame([("b",)], "t string"), "t")
    assert rows(judged, "n", "status") == [(1, "keep"), (2, "keep"), (3, "omit"), (4, "unreviewed"), (5, "unreviewed")]
    validate.require_none([validate.violations(df.limit(0), "x", F.col("pid"), F.col("n"))])
    with pytest.raises(validate.IntegrityError, match="repeated: a: 2"):
        validate.require_none([validate.violations(validate.repeated(df, "pid"), "repeated", F.col("pid"), F.col("rows"))])


def test_name_resolution(spark):
    labels = spark.createDataFrame([("ada", "p1"), ("ada", "p1"), ("bob", "p2"), ("bob", "p3"), ("", "p4")], "key string, pid string")
    assert rows(resolve.unique_index(labels, "key", "pid"), "key", "pid") == [("ada", "p1")]
    assert rows(resolve.ambiguous(labels, "key", "pid"), "key") == [("bob",)]
    creators = spark.createDataFrame(
        [("i", 0, "ada", False, "aut", "Ada"), ("i", 1, "lab", True, "aut", "Lab"), ("i", 2, "both", True, "aut", "Both"), ("i", 3, "ali", False, "edt", "Ali"), ("i", 4, "ada", False, "aut", "Ada"), ("i", 5, "lab", False, "aut", "Lab"), ("i", 6, "", False, "aut", "?"), ("i", 7, "same", True, "aut", "Same")],
        "item string, pos int, key string, single_field boolean, role string, name string",
    )
    index = lambda *x: spark.createDataFrame(list(x), "key string, pid string")
    good, bad = resolve.resolve_creators(creators, index(("ali", "p9")), index(("ada", "p1"), ("both", "p2"), ("same", "s")), index(("lab", "o1"), ("both", "o2"), ("same", "s")))
    assert sorted(tuple(r) for r in good.collect()) == [("i", 0, "p1", "aut"), ("i", 1, "o1", "aut"), ("i", 3, "p9", "edt"), ("i", 7, "s", "aut")]
    assert rows(bad, "pos", "name") == [(2, "Both"), (5, "Lab")]


def test_matching(spark):
    schema = "class string, pid string, tokens array<string>"
    source = spark.createDataFrame([("A", "x", ["t1"]), ("A", "new", ["t2", "t3"]), ("A", "two", ["t4"]), ("B", "none", ["t2"]), ("A", "clash", [])], schema)
    target = spark.createDataFrame([("A", "x", []), ("A", "y", ["t2", "t3"]), ("A", "z", ["t4"]), ("A", "w", ["t4"]), ("B", "clash", [])], schema)
    got = {r.pid: (r.matched, r.how, r.candidates) for r in resolve.match_records(source, target).collect()}
    assert got == {"x": ("x", "pid", []), "new": ("y", "identifier", ["y"]), "two": (None, "ambiguous", ["w", "z"]), "none": (None, "unmatched", []), "clash": (None, "class-conflict", [])}
    assert {r.pid: (r.matched, r.how, r.candidates) for r in resolve.match_outcomes(source, target).collect()} == got


def test_a_token_that_all_records_share_makes_no_pairs(spark):
    source, target = (spark.range(20_000).selectExpr("'A' AS class", f"concat('{s}', lpad(id, 5, '0')) AS pid", "array('all', concat('own', id)) AS tokens") for s in "st")
    found = resolve.match_outcomes(source, target)
    counts = found.groupBy("how", "candidates").count().collect()
    assert [(r.how, r.candidates, r["count"]) for r in counts] == [("ambiguous", ["t00000", "t19999"], 20_000)]


def test_groups(spark):
    df = spark.createDataFrame([("g", "A", 1, ["i2", "i1"], "t"), ("g", None, 3, ["i1"], "T"), ("h", "A", 1, None, "u"), ("h", "B", 2, [], "u"), ("n", None, 1, [], None)], "grp string, class string, v int, ids array<string>, title string")
    one, several = entity.classes(df, "grp", "class")
    assert rows(one, "grp", "class") == [("g", "A")] and rows(several, "grp", "classes") == [("h", ["A", "B"]), ("n", [])]
    assert rows(entity.representative(df, "grp", ["v", "class"], [F.col("v")]), "grp", "v", "class") == [("g", 3, None), ("h", 2, "B"), ("n", 1, None)]
    assert rows(entity.union_of(df, "grp", "ids", "u"), "grp", "u") == [("g", ["i1", "i2"])]
    assert rows(entity.field_conflicts(df, "grp", ["title"]), "grp", "field", "values") == [("g", "title", ["T", "t"])]
    first, differ = entity.merged_first(df, "grp", ["v"], ["title"])
    assert rows(first, "grp", "v") == [("g", 1), ("h", 1), ("n", 1)] and rows(differ, "grp", "v") == [("g", 3)]


def test_content_digest_is_sha256_over_sorted_files(spark):
    import hashlib

    files = {"b": "2", "a": "é"}
    want = hashlib.sha256(b"".join(k.encode() + b"\0" + files[k].encode() + b"\0" for k in sorted(files))).hexdigest()
    assert entity.content_digest(spark.createDataFrame(list(files.items()), "n string, p string"), "n", "p").first()[0] == want


def test_diff_and_containment(spark):
    before = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    after = spark.createDataFrame([(2, None), (3, "d"), (4, "e")], "k int, v string")
    assert rows(compare.keyed_diff(before, after, "k", ["v"]), "k", "change") == [(1, "removed"), (2, "unchanged"), (3, "changed"), (4, "added")]
    record = lambda *x: spark.createDataFrame(list(x), "pid string, record string")
    good = record(("p", '{"t": "x", "ids": [{"n": 1, "extra": 0}, {"n": 9}, {"n": 2}], "more": 1}'), ("q", "{}"))
    assert compare.projection_violations(record(("p", '{"t": "x", "ids": [{"n": 1}, {"n": 2}]}')), good).count() == 0
    bad = record(("p", '{"t": "y", "ids": [{"n": 2}, {"n": 1}]}'), ("gone", "{}"))
    assert rows(compare.projection_violations(bad, good), "path") == [("/gone",), ("/p/ids/1",), ("/p/t",)]
    flat = lambda *x: spark.createDataFrame(list(x), "k string, f map<string,string>")
    assert rows(compare.missing_fields(flat(("a", {"x": "1", "y": "2"}), ("b", {})), flat(("a", {"x": "1", "y": "3"})), "k", "f"), "path") == [("/a/y",), ("/b",)]
    nulls = flat(("a", {"x": None}), ("b", {"x": None}), ("c", {"x": None}))
    assert rows(compare.missing_fields(nulls, flat(("a", {}), ("b", {"x": None}), ("c", {"x": "1"})), "k", "f"), "path") == [("/a/x",), ("/c/x",)]


def test_containment_uses_up_what_an_unmatched_entry_has_searched(spark):
    record = lambda x: spark.createDataFrame([("p", x)], "pid string, record string")
    paths = lambda a, b: [r.path for r in compare.projection_violations(record(a), record(b)).collect()]
    assert paths('["A", "X", "B"]', '["A", "B"]') == ["/p/1", "/p/2"]
    assert paths('{"n": 1, "a/b": {"~": 1}}', '{"n": 1.0, "a/b": {"~": 2}}') == ["/p/a/b/~"]
    assert paths('{"n": [1]}', '{"n": {"0": 1}}') == ["/p/n"] and paths('{"n": null}', "{}") == ["/p/n"]


def test_expected_events_are_contained(spark):
    event = "array<struct<object: string, at: string>>"
    df = spark.createDataFrame([(1, [("o", None)], [("o", "x")]), (2, [("o", "y")], [("o", "x")]), (3, [], [])], f"i int, e {event}, a {event}")
    assert [r[1] for r in sorted(df.select("i", compare.all_contained(F.col("e"), F.col("a"), ["object", "at"])).collect())] == [True, False, True]


def test_decisions(spark):
    claims = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "pid string, claim_sha256 string")
    done = spark.createDataFrame([("a", "1", "accept"), ("b", "2", "reject"), ("c", "old", "accept")], "pid string, claim_sha256 string, disposition string")
    assert rows(compare.pending(claims, done), "pid") == [("c",)]


KEYS = ["pid", "path", "predicate", "content"]


def test_ownership_merge(spark):
    base = "pid string, path string, predicate string, content string, owner string, pos long"
    baseline = spark.createDataFrame(
        [("r", "/a", "title", "human", None, 0), ("r", "/a", "title", "mine-old", "me", 1), ("r", "/a", "title", "theirs", "other", 2), ("r", "/a", "title", "mine-kept", "me", 3), ("s", "/a", "title", "elsewhere", "me", 0)], base)
    source = spark.createDataFrame([("r", "/a", "title", "mine-kept", 0), ("r", "/a", "title", "human", 1), ("r", "/a", "title", "new", 2), ("r", "/a", "title", "new", 3), ("t", "/a", "title", "first", 0)], "pid string, path string, predicate string, content string, pos long")
    out = merge.merge_assertions(baseline, source, "me", KEYS)
    got = {(r.pid, r.content): (r.owner, r.change) for r in out.collect()}
    assert got == {
        ("r", "human"): (None, "kept"), ("r", "mine-old"): ("me", "removed"), ("r", "theirs"): ("other", "kept"), ("r", "mine-kept"): ("me", "kept"),
        ("r", "new"): ("me", "added"), ("s", "elsewhere"): ("me", "kept"), ("t", "first"): ("me", "added"),
    }
    lists = {r.pid: r.c for r in merge.merged_lists(out, ["pid", "path", "predicate"], "content", "c").collect()}
    assert lists["r"] == ["human", "theirs", "mine-kept", "new"]
    again = merge.merge_assertions(out.where("change <> 'removed'").drop("change"), source, "me", KEYS)
    assert again.where("change <> 'kept'").count() == 0
    empty = merge.merge_assertions(baseline, source.limit(0), "me", KEYS, baseline.select("pid").where("pid = 's'"))
    assert rows(empty.where("change = 'removed'"), "content") == [("elsewhere",)]


def test_provenance_splits_and_joins_again(spark):
    df = spark.createDataFrame([("p", "/a", 0, "x", "d1", "me", "src"), ("p", "/a", 1, "y", "d2", None, None), ("p", "/b", 0, "x", "d1", "me", "src")], "pid string, path string, pos int, content string, assertion_sha256 string, imported_by string, imported_from string")
    plain, notes = merge.split_inline(df)
    assert notes.count() == 2 and rows(merge.compact_inline(plain, notes), *df.columns) == rows(df, *df.columns)
    assert merge.orphan_notes(plain, notes).count() == 0 and merge.orphan_notes(plain.where("path = '/a'"), notes).count() == 1
    prev = spark.createDataFrame([("p", "z"), ("p", "b"), ("p", "a")], "pid string, predicate string")
    now = spark.createDataFrame([("p", "b", 0), ("p", "a", 5), ("p", "a", 1), ("q", "x", 0)], "pid string, predicate string, pos int")
    assert rows(merge.omitted_after(prev, now, "pid", "predicate", "o"), "pid", "o") == [("p", ["b", "a", "z"]), ("q", ["x"])]


def test_dependencies_and_retargeting(spark):
    primary = spark.createDataFrame([(["r1", "r2"],), (["r2", "r9"],), (None,)], "refs array<string>")
    have, lack = resolve.dependencies(primary, spark.createDataFrame([("r1",), ("r2",), ("r3",)], "pid string"), "refs", "pid")
    assert rows(have, "pid") == [("r1",), ("r2",)] and rows(lack, "pid") == [("r9",)]
    edges = spark.createDataFrame([("a", "x"), ("b", "y")], "src string, dst string")
    assert rows(resolve.retarget(edges, spark.createDataFrame([("x", "X")], "old string, new string"), "dst"), "src", "dst") == [("a", "X"), ("b", "y")]
    assert rows(compare.dangling(edges, spark.createDataFrame([("x",)], "n string"), "dst", "n"), "src") == [("b",)]


def test_rules_of_one_table_are_checked_in_one_pass(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "pid string, n int")
    found = validate.all_violations(rows, (F.col("n") > 0, "positive", F.col("pid"), F.col("n")), (F.col("n") == 2, "two", F.col("pid"), F.lit("")))
    assert sorted(tuple(r) for r in found.collect()) == [("positive", "a", "1"), ("positive", "b", "2"), ("two", "b", "")]
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1
