"""The filter language: syntax, semantics on JSON texts and typed documents."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from orderlake.functions.dates import date_seconds, parse_date
from orderlake.operators.policy import PolicyError, reject_regex
from orderlake.plans.filter import JsonDocuments, TypedDocuments, compile_filter, leaves, where_json
from orderlake.plans.syntax import Group, Item, QuerySyntaxError, Range, Scoped, Term, parse, split_path

DOC = {
    "title": "harbour crane number seven",
    "load": 48,
    "idle": False,
    "reach": 7.25,
    "parts": ["cable", "Winch"],
    "grid": [["buried"]],
    "site": {"dock": "North", "berth": "00412"},
    "crew": [{"role": "pilot"}, {"role": "rigger"}],
    "x.y": "plain",
    "seen": "2019-11-23T18:05:00Z",
    "local": "2019-11-23T01:15:00+03:00",
    "gone": None,
}

#: By rule of the language: queries that the document matches, and queries that it doesn't.
RULES = {
    "words within a distance": (["crene", "title:crane~0", "site.dock:north~1", "parts:wench"], ["title:crene~0", "site.dock:north~0", "parts:wench~1", "title:tower"]),
    "phrases inside a text": (['title:"crane num"', 'title:"CRANE"', 'parts:"inch"'], ['title:"seven harbour"', 'parts:"cables"']),
    "globs over a whole text": (["title:harb*", "title:*seven", "load:4?"], ["title:crane*", "load:5?"]),
    "regular expressions": (["title:/seven$/", "title:/^harb.+ c/"], ["title:/Seven$/", "title:/)/"]),
    "numbers": (["load:48", "reach:7.25", "load:48.0"], ["load:47", "reach:7.2500000001"]),
    "truth values": (["idle:false"], ['idle:"true"', "idle:true"]),
    "paths and arrays": (["buried", "crew.role:pilot~0", r"x\.y:plain~0", '"rigger"'], ["grid:buried", "crew:pilot", "x.y:plain", "gone:null", "nowhere:1"]),
    "ranges of numbers": (["reach:[7 TO 8]", "load:{47 TO 49}", "site.berth:[400 TO 500]"], ["reach:{7.25 TO 8}", "site.berth:[400.0 TO 411.5]", "title:[1 TO 9]"]),
    "ranges of texts": (["site.dock:[North TO South]"], ["site.dock:{North TO South}", "site.dock:[A TO M]", "load:[a TO z]", "load:[* TO 90]"]),
    "calendar": (["seen:2019-11", "seen:[2019 TO 2019]", "seen:{2019-11-20 TO 2019-11-24}", "local:2019-11-22"], ["seen:2019-12", "seen:{2019-11-23 TO 2019-11-25}", "local:2019-11-23", "load:[1900 TO 2100]"]),
    "occurrence": (["+load:48 -idle:true~0", "load:47 parts:cable", "-load:47"], ["+load:47 parts:cable", "-load:48", "load:47 load:46"]),
    "operators": (["nowhere:x OR load:48", "NOT load:47", "load:47 parts:cable OR idle:false"], ["NOT load:48", "load:47 parts:cable AND idle:false", "load:48 AND load:47"]),
    "groups": (["site:(dock:north~1 AND berth:/^004/)", "(load:48^3 && !load:47)^2"], ["site:(dock:north~1 AND berth:/^5/)", "!(load:48)"]),
}
CASES = [(q, want) for yes, no in RULES.values() for queries, want in ((yes, True), (no, False)) for q in queries]


def test_semantics(spark):
    read = spark.createDataFrame([(json.dumps(DOC),)], "value string").select(leaves(F.col("value")).alias("l"))
    got = read.select(*[compile_filter(q, JsonDocuments(F.col("l"))).alias(f"c{i}") for i, (q, _) in enumerate(CASES)]).first()
    assert {q: g for (q, want), g in zip(CASES, got) if g is not want} == {}


def test_rows_without_json_are_skipped(spark):
    frame = spark.createDataFrame([("a", "{"), ("b", None), ("c", '{"x": 1}'), ("d", "7")], "key string, value string")
    assert [r.key for r in where_json(frame, "NOT x:2").orderBy("key").collect()] == ["c", "d"]


def test_tree():
    assert parse("a b") == Group((Item(Term("a")), Item(Term("b"))))
    assert parse("+a AND x.y:[1 TO 2]^3").items[1].expr == Scoped(("x", "y"), Range("1", "2", True, 3.0))
    assert parse(r"a\:b~300^2").items[0].expr == Term("a:b", slop=None, boost=2.0)
    assert parse("FORD").items == (Item(Term("F"), "", "or"), Item(Term("D")))
    assert parse("NOTE").items == (Item(Term("E"), "-"),)
    assert split_path(r"a\.b.c\\") == ("a.b", "c\\")


@pytest.mark.parametrize("text", ["", "a AND", "OR b", "(a", "a:", "[1 TO 2}", '"open', "BRAND", "a:b:c"])
def test_not_a_query(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def test_dates_agree(spark):
    texts = ["2025", "2025-03", "2025-02-30", "2025-03-08T09:30", "2025-03-08 09:30:15.25Z", "2025-03-08t09:30:00-05:30", "0000-01-01", "2025-13", "2025-3", "20250", "2025-03-08T24:00", "x"]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", date_seconds(F.col("s"))).collect()
    assert dict(map(tuple, got)) == {t: None if (p := parse_date(t)) is None else p.start for t in texts}


def test_typed_documents(spark):
    frame = spark.createDataFrame([(1, {"a": "Oslo"}, ["x", "y"], 2.5, None), (2, {"a": "Lima"}, [], None, "z")], "id int, m map<string,string>, l array<string>, v double, s string")
    ids = lambda q: [r.id for r in frame.where(compile_filter(q, TypedDocuments(frame.schema))).orderBy("id").collect()]
    assert ids('m.a:"lima"') == [2]
    assert ids("l:x~0") == [1]
    assert ids("NOT v:2.5") == [2]
    assert ids("missing:1") == []
    assert ids('"z"') == [2]


def test_contract_search_has_no_regex():
    with pytest.raises(PolicyError):
        reject_regex(parse("a AND (b:/x/)"))
