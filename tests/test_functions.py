import unicodedata
import urllib.parse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import records as R
from weftline.functions import text as X
from weftline.plans import settle


def apply(spark, f, values, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[1] for r in sorted(df.select("i", f(F.col("v"))).collect())]


CASES = [
    (X.clean, ["\t a b\n", None, " ", "　x\x1c", ""], ["a b", "", "", "x", ""]),
    (X.filled, [" ", None, " a"], [None, None, "a"]),
    (X.percent_decoded, ["a%20b+c", "100%", "%zz%41", "%C3%A9"], ["a b+c", "100%", "%zzA", "é"]),
    (X.doi, ["https://doi.org/10.1000/ABC.", "doi: 10.5555/x;)", "HTTP://DX.DOI.ORG/10.1/y", "11.1/x", "10.1", None, "10.1000%2Fabc+d", "", "10.1/a,).;"], ["10.1000/abc", "10.5555/x", "10.1/y", None, None, None, "10.1000/abc+d", None, "10.1/a"]),
    (X.locator_doi, ["https://x.doi.org/10.1234/A/", "doi:10.1234/b", "10.12/x", "10.1234/a b", None], ["10.1234/a", "10.1234/b", None, None, None]),
    (X.name_key, ["Jürgen Straße-1", None, "ﬁne №5", "İ"], ["jurgenstrasse1", "", "fineno5", "i"]),
    (X.name_key_ascii, ["O'Neil-Smith 3", None], ["oneilsmith3", ""]),
    (lambda c: X.label_key(c, "my "), ["My  Papers\t& Posters ", "papers", None], ["papers & posters", "papers", ""]),
    (X.issns, ["1234-567x and 0000-0001, 1234-567X", None, "12345-678"], [["0000-0001", "1234-567X"], [], []]),
    (X.isbns, ["ISBN 978-3-16-148410-0; 0-306-40615-2", None, "12345"], [["0306406152", "9783161484100"], [], []]),
    (lambda c: X.labelled_line(c, "PMID"), ["x\npmid:  123 \ny", "see PMID: 5", None, "PMCID: 7"], ["123", None, None, None]),
    (X.full_date, ["2020-01-02", "2020-01-02T10:00", "2020-1", None, "2020-01-023"], ["2020-01-02", "2020-01-02", None, None, None]),
    (X.slug, ["--A b/C.d--", "ÄÖ"], ["a-b-c-d", ""]),
    (lambda c: X.record_stem(c, "own:"), ["https://doi.org/10.1234/A.b", "ISSN:1234-5678", "own:people/jane", "ROR:02x", "weird id", "**"], ["doi-10-1234-a-b", "issn-1234-5678", "jane", "ror-02x", "weird-id", None]),
    (X.percent_encoded, ["a b/c~*é"], ["a%20b%2Fc~%2A%C3%A9"]),
    (R.canonical_json, ['{"b": 1.0, "a": ["é", null]}', None], ['{"a":["é",null],"b":1.0}', None]),
    (R.digest, ["abc"], ["sha256:ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_scalars(spark, case):
    f, given_, want = CASES[case]
    assert apply(spark, f, given_) == want


def test_decoding_and_encoding_as_the_standard_library_does(spark):
    values = ["a%2Fb", "%", "%4", "%e4%bd%a0", "x+y", "%25%zz", "plain", "ü?&=#", "~-._"]
    assert apply(spark, X.percent_decoded, values) == [urllib.parse.unquote(v) for v in values]
    assert apply(spark, X.percent_encoded, values) == [urllib.parse.quote(v, safe="") for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=30, max_size=30))
def test_name_keys_and_stripping_of_any_text(spark, values):
    values = [v.replace("\x00", "") for v in values if not any(0xD800 <= ord(c) < 0xE000 for c in v)]
    assert apply(spark, X.name_key, values) == ["".join(c for c in unicodedata.normalize("NFKD", v).casefold() if c.isalnum()) for v in values]
    assert apply(spark, X.clean, values) == [v.strip() for v in values]


def test_folding_as_the_standard_library_does(spark):
    values = ["Straße", "GROẞ", "ΟΔΟΣ ΟΔΟς", "İstanbul ı I", "ﬁne ŉ ſ µ", "ᾳ ΐ", "Ꭰ ꭰ ᏸ", "ÀÉ", "", None]
    assert apply(spark, X.folded, values) == [None if v is None else v.casefold() for v in values]
    every = ["a" + chr(c) + "b" for c in range(1, 0xA000)]
    assert sum(a != b.casefold() for a, b in zip(apply(spark, X.folded, every), every, strict=True)) <= 3  # letters that one of the two doesn't know yet
    assert apply(spark, X.slug, ["Große Straße"]) == ["grosse-strasse"]
    assert apply(spark, lambda c: X.label_key(c, "my "), ["MY  Straße"]) == ["strasse"]


def test_item_doi_and_names(spark):
    df = spark.createDataFrame([(None, "see https://doi.org/10.1234/Z. ", "", "Ada", " Lovelace"), ("10.1/a", "doi:10.1234/b", "CERN ", "x", "y"), ("bad", "", None, None, "Solo")], "d string, e string, n string, f string, l string")
    out = df.select(X.item_doi(F.col("d"), F.col("e")).alias("doi"), X.person_name(F.col("n"), F.col("f"), F.col("l")).alias("name")).collect()
    assert [tuple(r) for r in out] == [("10.1234/z", "Ada Lovelace"), ("10.1/a", "CERN"), (None, "Solo")]


def test_tokens_pids_and_relations(spark):
    ids = "array<struct<notation: string, schema_type: string>>"
    df = spark.createDataFrame([("P", "own:x/1", [("https://doi.org/10.1234/A/", "DOI"), ("Name ", "Id")]), ("V", "ISSN:1-2", None), ("Q", "ISSN:1-2", [])], f"c string, pid string, i {ids}")
    tokens = df.select(X.identity_tokens(F.col("pid"), F.transform("i", lambda x: x["notation"])).alias("t")).collect()
    assert [r.t for r in tokens] == [["value:own:x/1", "value:https://doi.org/10.1234/a", "value:name", "doi:10.1234/a"], ["value:issn:1-2"], ["value:issn:1-2"]]
    assert [r[0] for r in df.select(R.minted_pid(F.col("c"), F.col("pid"), "own:", {"P": "own:p/", "V": "own:v/"})).collect()] == ["own:x/1", "own:v/issn-1-2", "ISSN:1-2"]
    more = [[tuple(x) for x in r[0]] for r in df.select(R.with_identifier(F.col("i"), F.col("pid"), "Id")).collect()]
    assert more[0][-1] == ("own:x/1", "Id") and more[1] == [("ISSN:1-2", "Id")] and len(more[0]) == 3
    assert [r[0] for r in df.select(R.notations(F.col("i"), "DOI")).collect()] == [["https://doi.org/10.1234/A/"], None, []]


def test_stable_pid_and_source_record_id(spark):
    df = spark.createDataFrame([("a", ["10.1/X"], ["K2", "K1"], None), ("b", ["1", "2"], ["K2", "K1"], None), ("c", [], ["K"], "over"), ("d", [], [], None)], "pid string, dois array<string>, keys array<string>, o string")
    assert [r[0] for r in df.select(R.stable_pid(F.col("pid"), F.col("dois"), F.col("keys"), F.col("o"), "own:p/")).collect()] == ["own:p/doi-10-1-x", "own:p/item-k1", "over", None]
    assert [r[0] for r in df.select(R.source_record_id(F.col("keys"))).collect()] == ["items:K1,K2", "items:K1,K2", "item:K", None]


def test_score_and_roles_and_retarget(spark):
    rel = "array<struct<object: string, roles: array<string>>>"
    df = spark.createDataFrame([("t", "", 15, "document", [("x", ["b", "a"]), ("y", None), ("z", ["a"])], ["x", "q"], {"x": "X"})], f"a string, b string, n int, t string, r {rel}, refs array<string>, m map<string,string>")
    out = df.select(R.score([F.col("a"), F.col("b")], F.col("n"), F.col("t") == "document").alias("s"), R.roles(F.col("r")).alias("r"), R.retargeted(F.col("refs"), F.col("m")).alias("t")).first()
    assert (out.s, out.r, out.t) == (11, ["a", "b"], ["X", "q"])


def test_keys_that_are_filtered_are_computed_once(spark):
    rows = spark.range(9).select(X.name_key(F.col("id").cast("string")).alias("key"), "id").where("key <> ''")
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert rows.count() == 9


def test_rows_of_the_driver_are_read_without_python(spark):
    rows = settle.local_rows(spark, [("a", ["x", None], 1), ("b", None, None)], "name string, list array<string>, n int")
    assert [tuple(r) for r in rows.collect()] == [("a", ["x", None], 1), ("b", None, None)]
    assert "LocalTableScan" in rows._jdf.queryExecution().executedPlan().toString()
    assert settle.local_rows(spark, [], "name string").isEmpty()
