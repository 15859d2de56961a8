"""Records as statements, and what shapes say of them."""

import json

from weftline.plans import graph

SLOTS = [("P", "name", "x:name", False), ("P", "knows", "x:knows", True), ("P", "by", "x:by", False), ("P", "n", "x:n", False)]
SHAPE = "class string, predicate string, least int, most int, kind string, object_class string"


def statements(spark, *records):
    rows = [(c, p, None if r is None else json.dumps(r)) for c, p, r in records]
    return graph.statements(spark.createDataFrame(rows, "class string, pid string, record string"), spark.createDataFrame(SLOTS, "class string, slot string, predicate string, is_object boolean"))


def test_each_entry_is_a_statement(spark):
    record = {"name": "é", "knows": ["p:2", {"object": "p:3", "since": 1}], "by": {"b": 1, "a": [None]}, "n": [1, 2.5, 1e40, True], "other": "?", "none": None}
    got = sorted((r.predicate, r.value, r.kind) for r in statements(spark, ("P", "p:1", record), ("P", "p:2", None), ("P", "p:3", {})).collect())
    assert got[:5] == [("other", "?", "unmapped"), ("x:by", '{"a":[null],"b":1}', "structure"), ("x:knows", "p:2", "reference"), ("x:knows", "p:3", "reference"), ("x:n", "1", "number")]
    assert {k for p, _, k in got if p == "x:n"} == {"number", "boolean"} and ("x:name", "é", "text") in got and len(got) == 9


def test_violations(spark):
    found = statements(spark, ("P", "p:1", {"name": ["a", "b"], "knows": ["p:2", "gone", "o:1"], "n": "x"}), ("P", "p:2", {"name": 5, "color": "red"}), ("O", "o:1", {}))
    subjects = spark.createDataFrame([("P", "p:1"), ("P", "p:2"), ("O", "o:1")], "class string, pid string")
    shapes = spark.createDataFrame([("P", "x:name", 1, 1, "text", None), ("P", "x:knows", None, None, "reference", "P"), ("P", "x:n", 1, None, None, None)], SHAPE)
    got = sorted(tuple(r) for r in graph.shape_violations(found, subjects, shapes).collect())
    assert got == [("p:1", "x:knows", "another class", "o:1"), ("p:1", "x:knows", "no record", "gone"), ("p:1", "x:name", "too many", "2"), ("p:2", "color", "no shape", "red"), ("p:2", "x:n", "too few", "0"), ("p:2", "x:name", "another kind", "5")]
    assert graph.shape_violations(found.limit(0), subjects.limit(0), shapes).count() == 0
