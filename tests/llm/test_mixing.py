import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import mixing as mx

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("members", T.ArrayType(T.StringType())), T.StructField("bin", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def mixed(spark, rows, **options):
    return mx.mix(frame(spark, rows), "doc_id", mx.n_words(F.col("text")), F.col("members"), **options).collect()


def take(spark, rows, seed=mx.SEED):
    """Words taken of each document by the plain rule: whole uses of all, and once more along the seeded order."""
    order = {r.doc_id: r.rank for r in frame(spark, rows).select("doc_id", F.xxhash64(F.lit(seed), F.col("doc_id")).alias("rank")).collect()}
    sizes, by = {}, {}
    for doc_id, text, (source,) in rows:
        by.setdefault(source, []).append((order[doc_id] % mx.BINS, order[doc_id], doc_id, len((text or "").split())))
        sizes[source] = sizes.get(source, 0) + by[source][-1][3]
    wanted, out = mx.targets(sizes), {}
    for source, docs in by.items():
        left, total = round(wanted[source]), sizes[source]
        whole = min(2, left // total) if total else 0
        left -= whole * total
        for _, _, doc_id, n in sorted(docs, key=lambda d: (d[0], d[1], d[2] is not None, d[2] or 0)):
            more = min(n, left)
            out[doc_id] = n * whole + more
            left -= more
    return out


def words(rng, n):
    return " ".join(["w"] * n)


def test_targets():
    assert mx.targets({"a": 100, "b": 100, "c": 100}) == {"a": 200.0, "b": pytest.approx(250 / 3), "c": pytest.approx(500 / 3)}
    assert mx.targets({"b": 10, None: 10, "a": 1000}) == {"a": pytest.approx(1490), "b": 20.0, None: 20.0}
    assert mx.targets({}) == {} and mx.targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0}
    assert sum(mx.targets({str(i): i * i for i in range(30)}).values()) == pytest.approx(1.5 * sum(i * i for i in range(30)))


def test_selection_against_the_plain_rule_and_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, words(rng, int(rng.integers(0, 40))), [[None, "a", "b", "é"][int(rng.integers(4)) if i % 3 else 1]]) for i in range(400)] + [(1000, None, ["a"]), (1001, words(rng, 30_000), ["a"]), (None, words(rng, 7), ["b"])]
    out = mixed(spark, rows)
    assert {r.doc_id: r.taken for r in out} == take(spark, rows)
    assert all(r.taken <= 2 * r.size for r in out) and len(out) == len(rows)
    wanted = mx.targets({s: sum(r.size for r in out if r.members[0] == s) for s in ("a", "b", "é", None)})
    for s, t in wanted.items():
        assert abs(sum(r.taken for r in out if r.members[0] == s) - t) <= 1
    assert sorted(map(tuple, map(str, out))) == sorted(map(tuple, map(str, mixed(spark, rows))))


def test_flow_of_overlapping_sources_costs_least():
    # b's quota can only come from the shared group; so a takes its own words first, and nothing is repeated
    flows = mx.route([(("a",), 50), (("a", "b"), 60), (("b", "c"), 10)], {"a": 60, "b": 50, "c": 10})
    assert [sum(f.values()) for f in flows] == [50, 60, 10]
    assert sum(f.get("a", 0) for f in flows) == 60 and sum(f.get("b", 0) for f in flows) == 50
    flows = mx.route([(("a",), 10), (("b",), 100)], {"a": 100, "b": 30})
    assert flows == [{"a": 20}, {"b": 30}]


def test_overlapping_documents_and_repeated_and_no_rows(spark):
    rows = [(i, "one two three four five", ["a", "b"] if i % 2 else ["a"]) for i in range(40)] + [(0, "one two three four five", ["a"])] * 2
    out = mixed(spark, rows)
    assert len(out) == 42 and all(r.taken <= 2 * r.size for r in out)
    assert mixed(spark, []) == []
    assert all(r.taken == 0 for r in mixed(spark, [(1, "", ["a"]), (2, None, ["b"])]))


def test_many_sources_in_ranges_and_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(mx, "MOST_BROADCAST", 0)
    monkeypatch.setattr(mx, "AT_ONCE", 7)
    rng = np.random.default_rng(8)
    rows = [(i, words(rng, int(rng.integers(1, 30))), [f"host{i % 40}"]) for i in range(200)]
    assert {r.doc_id: r.taken for r in mixed(spark, rows)} == take(spark, rows)
    # documents of two sources among many of one: both ways agree
    rows += [(1000 + i, "one two three", ["host1", "host2"]) for i in range(5)]
    some = {r.doc_id: r.taken for r in mixed(spark, rows)}
    sizes = {}
    for _, text, members in rows:
        for s in members:
            sizes[s] = sizes.get(s, 0) + len(text.split())
    grouped = {}
    for _, text, members in rows:
        grouped[tuple(members)] = grouped.get(tuple(members), 0) + len(text.split())
    flows = mx.route(sorted(grouped.items()), {s: round(x) for s, x in mx.targets(sizes).items()})
    for (members, _), flow in zip(sorted(grouped.items()), flows, strict=True):
        assert sum(some[d] for d, _, m in rows if tuple(m) == members) == sum(flow.values())


def test_targets_of_a_table_are_those_of_a_list(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for n, at_once in ((1, 50), (40, 50), (40, 6)):
        monkeypatch.setattr(mx, "AT_ONCE", at_once)
        sizes = {f"s{i}é": int(rng.integers(0, 50) ** 2) for i in range(n)} | {None: 30, "z": 0}
        out = mx.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(3)).collect()
        assert {r.source: r.source_size for r in out} == sizes
        assert {r.source: r.target for r in out} == pytest.approx(mx.targets(sizes))
    assert mx.source_targets(spark.createDataFrame([], "source string, size long")).count() == 0


def cheapest(patterns, quotas, copies=2):
    """(words routed at most, repeats at least for that) by going through all flows."""
    best = {}
    states = {tuple(quotas.values()): 0}
    names = list(quotas)
    for members, n in patterns:
        new = {}
        for left, cost in states.items():
            ways = {left: 0}
            for s in members:
                i = names.index(s)
                ways = {(*x[:i], x[i] - g, *x[i + 1 :]): used + g for x, used in ways.items() for g in range(min(x[i], copies * n - used) + 1)}
            for x, used in ways.items():
                c = cost + max(0, used - n)
                new[x] = min(c, new.get(x, 1 << 30))
        states = new
    total = sum(quotas.values())
    for left, cost in states.items():
        best[total - sum(left)] = min(cost, best.get(total - sum(left), 1 << 30))
    return max(best), best[max(best)]


def test_routes_against_all_flows():
    rng = np.random.default_rng(3)
    for _ in range(40):
        names = ["a", "b", "c"][: int(rng.integers(1, 4))]
        patterns = [(tuple(sorted(rng.choice(names, int(rng.integers(1, len(names) + 1)), replace=False).tolist())), int(rng.integers(0, 4))) for _ in range(int(rng.integers(1, 4)))]
        quotas = {s: int(rng.integers(0, 6)) for s in names}
        flows = mx.route(patterns, quotas)
        routed = sum(sum(f.values()) for f in flows)
        repeats = sum(max(0, sum(f.values()) - n) for f, (_, n) in zip(flows, patterns, strict=True))
        assert all(sum(f.get(s, 0) for f in flows) <= q for s, q in quotas.items()) and all(sum(f.values()) <= 2 * n and set(f) <= set(m) for f, (m, n) in zip(flows, patterns, strict=True))
        assert (routed, repeats) == cheapest(patterns, quotas)


def test_more_patterns_than_were_allowed_once():
    patterns = [((f"s{i % 50}", f"t{i % 601}"), 1 + i % 7) for i in range(25_000)]
    sizes = {}
    for members, n in patterns:
        for s in members:
            sizes[s] = sizes.get(s, 0) + n
    quotas = {s: n // 3 for s, n in sizes.items()}
    flows = mx.route(patterns, quotas)
    assert sum(sum(f.values()) for f in flows) == sum(quotas.values())
    assert all(sum(f.values()) <= n for f, (_, n) in zip(flows, patterns, strict=True))


def test_null_and_repeated_members(spark):
    out = {r.doc_id: (r.members, r.taken) for r in mixed(spark, [(1, "one two", None), (2, "one two", []), (3, "one two", ["a", "a"]), (4, "one two", ["b", None])])}
    assert out[1] == out[2] == ([], 0) and out[3][0] == ["a"] and out[4][0] == ["b", None] and out[3][1] > 0


def test_quotas_come_from_the_flow(spark, monkeypatch):
    """Single sources as well: the plan runs the network, and without it there are no quotas."""
    patterns = spark.createDataFrame([(["a"], 50), (["b"], 10), ([None], 7), ([], 3)], "members array<string>, words long")
    wanted = spark.createDataFrame([("a", 75.4), ("b", 20.0), (None, 3.0)], "source string, target double")
    plan = mx._plan(patterns, wanted, 2)
    assert "min_cost_flow" in plan._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r.members): (r.whole, r.rest) for r in plan.collect()} == {("a",): (1, 25), ("b",): (2, 0), (None,): (0, 3), (): (0, 0)}
    monkeypatch.setattr(mx, "_routed", lambda copies: lambda batches: (b.slice(0, 0).select(["members", "words", "quota"]).rename_columns(["members", "words", "given"]) for b in batches))
    assert [r.members for r in mx._plan(patterns, wanted, 2).collect()] == [[]]


def test_components_apart_give_what_one_network_does(spark):
    rng = np.random.default_rng(6)
    grouped = {}
    for i in range(400):
        block = int(rng.integers(20))
        names = tuple(sorted({f"s{block}-{int(x)}" for x in rng.integers(0, 4, int(rng.integers(1, 4)))}))
        grouped[names] = int(rng.integers(1, 50))
    sizes = {}
    for members, n in grouped.items():
        for s in members:
            sizes[s] = sizes.get(s, 0) + n
    wanted = mx.targets(sizes)
    rows = mx._plan(spark.createDataFrame([(list(m), n) for m, n in grouped.items()], "members array<string>, words long"), spark.createDataFrame(list(wanted.items()), "source string, target double"), 2).collect()
    given = {tuple(r.members): r.whole * grouped[tuple(r.members)] + r.rest for r in rows}
    flows = mx.route(sorted(grouped.items()), {s: round(x) for s, x in wanted.items()})
    assert sum(given.values()) == sum(sum(f.values()) for f in flows)
    repeats = lambda each: sum(max(0, g - n) for g, n in each)
    assert repeats((given[m], n) for m, n in grouped.items()) == repeats((sum(f.values()), n) for f, (_, n) in zip(flows, sorted(grouped.items()), strict=True))
