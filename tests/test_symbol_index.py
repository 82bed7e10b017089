"""Indexes in their wire format, and what is made of them."""

from __future__ import annotations

import json
import random

import pytest

from weft.operators import symbols
from weft.sources import scip_index as si

ROWS = [
    ("./a.ts", "ts", "x\ny", "UTF8", [([1, 2, 3], "s1", 1, [1, 0, 4, 1]), ([0, -5, 300000], "s2", 0, [])], [("s1", "n1", "Class", ["d", "e"], [("s9", True, False, True, False)])]),
    ("é.py", "", "", None, [], []),
    (None, None, None, None, [], [("ext", "E", "Function", [], [])]),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "all")
    si.write_index(spark.createDataFrame(ROWS * 100, si.DOCUMENTS).repartition(2), path, tool="t", projectroot="r")
    return path


def test_tables_come_back(spark, index):
    read = lambda t: si.index_table(spark, index, t, split=2000)
    assert read("occurrences").rdd.getNumPartitions() > 4  # several tasks a file
    assert {tuple(map(str, r)) for r in read("occurrences").collect()} == {("./a.ts", "0", "s1", "1", "[1, 2, 3]", "[1, 0, 4, 1]", "UTF8"), ("./a.ts", "1", "s2", "0", "[0, -5, 300000]", "[]", "UTF8")}
    assert read("occurrences").count() == 200 and read("documents").count() == 200
    assert {(r.relative_path, r.text, r.encoding, r.occurrences, r.symbols) for r in read("documents").collect()} == {("./a.ts", "x\ny", "UTF8", 2, 1), ("é.py", "", "Unspecified", 0, 0)}
    by = {r.symbol: r for r in read("symbols").collect()}
    assert by["ext"].relative_path is None and by["ext"].kind == "Function"
    assert by["s1"].kind == "Class" and by["s1"].documentation == ["d", "e"] and by["s1"].relationships[0].asDict() == {"symbol": "s9", "is_reference": True, "is_implementation": False, "is_type_definition": True, "is_definition": False}
    assert [tuple(r) for r in read("metadata").collect()] == [("r", 1, "t", "", [])]


def test_numbers_and_unknown_fields():
    rnd = random.Random(1)
    for x in [0, 1, 127, 128, 2**31 - 1, -1, -(2**31), *(rnd.randint(-(2**31), 2**31 - 1) for _ in range(200))]:
        value, at = si.varint(si.number(x) + b"z", 0)
        assert si._int(value) == x and at == len(si.number(x))
    unpacked = si.number(1 << 3) + si.number(7) + si.number(1 << 3) + si.number(9) + si._bytes(2, "s") + si._bytes(99, "skipped") + si.number(98 << 3 | 5) + b"1234" + si.number(97 << 3 | 1) + b"12345678"
    assert si.occurrence(unpacked) == {"range": [7, 9], "symbol": "s", "roles": 0, "enclosing_range": []}
    with pytest.raises(ValueError, match="kind 3"):
        list(si.fields(si.number(1 << 3 | 3)))


def test_kinds_are_numbered():
    assert (si.KINDS[7], si.KINDS[17], si.KINDS[26], si.KINDS[61], si.KINDS[84], si.KINDS[86], len(si.KINDS)) == ("Class", "Function", "Method", "Variable", "Extension", "Concept", 87)


def test_cut_off_files_are_errors(spark, tmp_path):
    whole = b"".join(si.encoded({"relative_path": f"p{i}", "language": "", "text": "t" * 50, "encoding": None, "occurrences": [], "symbols": []}) for i in range(50))
    (tmp_path / "a.scip").write_bytes(whole[:-3])
    for split in (100, 1 << 20):
        with pytest.raises(Exception, match="ends within"):
            si.index_table(spark, str(tmp_path / "a.scip"), "documents", split=split).collect()
    (tmp_path / "b.scip").write_bytes(b"")
    assert si.index_table(spark, str(tmp_path / "b.scip"), "documents").collect() == []


def test_consume_follows_definitions_references_and_orphans(spark):
    occ = [("a.ts", 0, "S#f", 1, 2, "f"), ("a.ts", 1, "S#lost", 1, 3, "lost"), ("a.ts", 2, "local 1", 1, 4, "tmp"), ("a.ts", 3, "S#f", 0, 9, "f"), ("a.ts", 4, "X#y", 0, 3, "y"), ("b.ts", 0, "S#f", 0, 1, "f"), ("a.ts", 5, "S#f", 0, 2, "f")]
    info = [("a.ts", "S#lost", "Lost", "Class", []), ("a.ts", "S#f", "f", "Function", [("S#base", False, True, False, False)]), (None, "X#y", "y", "Method", [])]
    nodes = [("n:f", "f", "function", "a.ts", 1, 5, 1), ("n:g", "g", "function", "a.ts", 7, 8, 1)]
    edges = [("repo://r/a.ts", "n:f", "CONTAINS")]
    foreign = [("X#y", "other", "X#y@other", 0)]
    make = spark.createDataFrame
    got_nodes, got_edges, lost = symbols.consume(
        make(occ, "path string, ord int, symbol string, roles int, line int, token string"), make(info, "relative_path string, symbol string, display_name string, kind string, relationships " + si._RELATIONS),
        make(nodes, "node_id string, label string, kind string, path string, start_line int, end_line int, start_col int"), make(edges, "source_id string, target_id string, edge_type string"), make(foreign, "symbol string, repo string, node_id string, ord int"), "r",
    )
    assert {(r.node_id, r.kind, r.original_id, r.symbol_source) for r in got_nodes.collect()} == {("S#f", "function", "n:f", "scip"), ("n:g", "function", None, "provisional"), ("S#lost", "class", "scip-orphan:S#lost", "scip_orphan")}
    found = {(r.source_id, r.target_id, r.edge_type, r.target_repo) for r in got_edges.collect()}
    assert found == {
        ("repo://r/a.ts", "S#f", "CONTAINS", None), ("S#f", "S#f", "DEFINES", None), ("repo://r/a.ts", "S#lost", "CONTAINS", None), ("S#lost", "S#lost", "DEFINES", None), ("S#f", "S#base", "IMPLEMENTS", None),
        ("S#lost", "S#f", "REFERENCES", None), ("S#f", "X#y@other", "CROSS_REFERENCE", "other"), ("repo://r/b.ts", "S#f", "REFERENCES", None),
    }
    assert {(r.symbol, r.addressable) for r in lost.collect()} == {("S#lost", True), ("local 1", False)}


def test_places_beside_spans_meet_the_nearest(spark):
    rnd = random.Random(3)
    spans = [("p", f"n{i}", a, a + rnd.choice([0, 1, 3, 700]), rnd.randint(0, 2)) for i, a in enumerate(rnd.sample(range(0, 3000, 7), 40))]
    points = [("p", rnd.randint(0, 3600), f"s{i}") for i in range(150)] + [("q", 1, "s")]
    got = {(r.path, r.line, r.symbol): r.node_id for r in symbols.nearest(spark.createDataFrame(points, "path string, line int, symbol string"), spark.createDataFrame(spans, "path string, node_id string, start_line int, end_line int, start_col int")).collect()}
    for path, line, symbol in points:
        own = [(not a <= line <= b, b - a if a <= line <= b else abs(a - line) + abs(b - line), c, i) for p, i, a, b, c in spans if p == path]
        assert got[path, line, symbol] == (min(own)[3] if own else None)


def test_texts_and_tokens(spark):
    docs = spark.createDataFrame([("./a.ts", ""), ("b.ts", "own")], "relative_path string, text string")
    texts = symbols.with_texts(docs, spark.createDataFrame([("a.ts", "let éa = 1\nx"), ("b.ts", "other")], "path string, content string"))
    assert {r.relative_path: r.text for r in texts.collect()} == {"./a.ts": "let éa = 1\nx", "b.ts": "own"}
    occ = spark.createDataFrame([("./a.ts", 0, "s", 1, [0, 4, 7], "UTF8"), ("b.ts", 0, "t", 0, [0, 0, 3], "Unspecified"), ("c.ts", 0, "u", 0, [], "UTF8")], "relative_path string, ord int, symbol string, roles int, range array<int>, encoding string")
    assert {(r.path, r.line, r.token) for r in symbols.tokens(occ, texts).collect()} == {("a.ts", 1, "éa"), ("b.ts", 1, "own"), ("c.ts", 1, "")}


def test_symbol_indexes_of_two_shapes(spark, tmp_path):
    entries = {"S#a": [{"repo_name": "r1", "node_id": "S#a"}, {"repo_name": "r2", "node_id": "S#a"}], "bad": 3, "empty": [], "odd": [{"x": 1}]}
    for name, data in (("flat.json", entries), ("deep.json", {"version": 1, "symbols": entries})):
        (tmp_path / name).write_text(json.dumps(data))
        assert [tuple(r) for r in symbols.read_symbol_index(spark, str(tmp_path / name)).orderBy("ord").collect()] == [("S#a", "r1", "S#a", 0), ("S#a", "r2", "S#a", 1)]
    made = symbols.symbol_index(spark.createDataFrame([("r2", "S#a"), ("r1", "S#a"), ("r1", "")], "repo string, node_id string"))
    assert sorted(map(tuple, made.collect())) == [("S#a", "r1", "S#a", 0), ("S#a", "r2", "S#a", 1)]
