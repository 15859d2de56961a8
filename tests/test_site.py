"""Pages of ordered groups with embedded records."""

import pytest

from weftline.operators.validate import IntegrityError
from weftline.plans import site


def read(spark, members, edges, known, depth=2):
    frame = lambda rows, ddl: spark.createDataFrame(list(rows), ddl)
    out = site.pages(frame(members, "page string, pos long, pid string"), frame(edges, "pid string, field string, n long, target string"), frame([(k,) for k in known], "pid string"), depth)
    return [(r.page, r.place, r.pid, r.field, r.status) for r in sorted(out.collect(), key=lambda r: (r.page, r.place))]


def test_members_in_order_with_what_they_refer_to(spark):
    edges = [("b", "works", 1, "x"), ("b", "works", 0, "y"), ("b", "about", 5, "gone"), ("x", "author", 0, "b"), ("x", "next", 0, "z"), ("z", "next", 0, "z")]
    got = read(spark, [("p", 2, "a"), ("p", 1, "b"), ("q", 1, "z")], edges, "abxyz")
    assert got == [
        ("p", [1], "b", None, "embedded"),
        ("p", [1, 0], "gone", "about", "missing"),
        ("p", [1, 1], "y", "works", "embedded"),
        ("p", [1, 2], "x", "works", "embedded"),
        ("p", [1, 2, 0], "b", "author", "cycle"),
        ("p", [1, 2, 1], "z", "next", "embedded"),
        ("p", [2], "a", None, "embedded"),
        ("q", [1], "z", None, "embedded"),
        ("q", [1, 0], "z", "next", "cycle"),
    ]
    assert read(spark, [("p", 1, "b")], edges, "abxyz", 0) == [("p", [1], "b", None, "embedded")] and read(spark, [], edges, "ab") == []


@pytest.mark.parametrize(("members", "message"), [([("p", 1, "a"), ("p", 1, "b")], "repeated position: p: 1"), ([("p", 1, "a"), ("p", 2, "a")], "repeated member: p: a"), ([("p", 1, "c")], "member without a record: p: c")])
def test_what_is_refused(spark, members, message):
    with pytest.raises(IntegrityError, match=message):
        read(spark, members, [], "ab")
