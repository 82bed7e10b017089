from __future__ import annotations

import os
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weft import session
from weft.functions import ids
from weft.operators import evaluation, evidence, graph, retrieval, simulate, symbols, temporal
from weft.plans import adapters as A
from weft.plans import catalogue
from weft.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_ids(spark):
    lit = F.lit
    assert one(spark, ids.normalize_relative_path(lit("..\\a//b/./c.ts"))) == "a/b/c.ts"
    assert one(spark, ids.normalize_relative_path(lit(".env.ts"))) == "env.ts"
    assert one(spark, ids.resolve_relative_path(lit("src/a"), lit("../b/./c"))) == "src/b/c"
    assert one(spark, ids.project_id(lit("a b/c"))) == "project:a_b_c"
    assert one(spark, ids.file_uri(lit("/org/repo/"), lit("./x.py"))) == "repo://org/repo/x.py"
    assert one(spark, ids.module_spec(lit("@a/b/c"))) == "module:@a/b"
    assert one(spark, ids.module_spec(lit("a/b?x=1"))) == "module:a"
    for raw, want in (("a/b/", "a/b"), ("a/.", "a"), ("a/.//b", "a/b"), ("./a//./b", "a/b"), ("", ""), ("/", ""), ("a/../b", "a/../b"), ("a\\b\\", "a/b")):
        assert one(spark, ids.normalize_relative_path(lit(raw))) == want
    assert one(spark, ids.project_id(lit("/org/repo/"))) == "project:org_repo"
    for raw, want in ((" 'lodash/fp'", "lodash"), ('"@a/b/c"', "@a/b"), ("@a", "@a"), ("@a/", "@a/"), ("", ""), ("x?y/z", "x")):
        assert one(spark, ids.module_spec(lit(raw))) == "module:" + want
    assert one(spark, ids.snippet(lit("  é  x\n😀€" + "a" * 300))) == "\\xe9 x \\U0001f600\\u20ac" + "a" * 231
    assert [one(spark, lit(x).rlike(ids.glob_pattern("src/*/a?.ts"))) for x in ("src/x/y/ab.ts", "src/a.ts", "src/x/ab.ts\n")] == [True, False, False]
    assert one(spark, ids.split_identifier(lit("userName_of-Order"))) == "user Name of Order"
    assert one(spark, ids.is_test_path(lit("src/__tests__/a.ts"))) is True
    assert one(spark, ids.is_test_path(lit("src/contest/a.ts"))) is False
    assert one(spark, ids.slug(lit("Hello, World"))) == "hello-world"


def test_lexical_score_needs_terms(spark):
    assert retrieval.terms("does this auth work or by") == ["does", "this", "auth", "work"]
    docs = spark.createDataFrame([(1, "on the way"), (2, "auth work")], "doc_id long, text string")
    assert retrieval.lexical_rank(docs, "on the").count() == 0
    assert [tuple(r) for r in retrieval.lexical_rank(docs, "auth work").collect()] == [(2, 5.0)]


def test_passages_are_found_inside_words(spark, monkeypatch):
    passage = "the cat sat on the mat by the old sat"
    docs = spark.createDataFrame([(1, passage), (2, "bathe cat sat on the mat by the old satellite"), (3, "xthe cat sat on the mat by the old satx"), (4, "the cat sat on a mat by the old sat"), (5, None), (6, "concat enated")], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (2, "cat ena"), (3, "t"), (4, "old sat"), (5, " "), (6, None), (7, "sat on the mat")], "item_id long, text string")
    want = {(1, 1), (1, 2), (1, 3), (2, 6), (3, 1), (3, 2), (3, 3), (3, 4), (3, 6), (4, 1), (4, 2), (4, 3), (4, 4), (7, 1), (7, 2), (7, 3)}
    for few in (50_000, 1):
        monkeypatch.setattr(retrieval, "FEW", few)
        assert {tuple(r) for r in retrieval.contained_texts(docs, items).collect()} == want


def test_monte_carlo_repeats_and_grows(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 0.0)], "source_id string, target_id string, weight double")
    seeds = spark.createDataFrame([("a",)], "node_id string")
    runs = [sorted(map(tuple, graph.monte_carlo_reach(edges, seeds, runs=3).collect())) for _ in range(2)]
    assert runs[0] == runs[1] == [(r, n) for r in range(3) for n in "abc"]


def test_hubs_are_reached_but_not_left(spark):
    edges = spark.createDataFrame([("s", "hub", "CALLS"), *((f"x{i}", "hub", "CALLS") for i in range(5))], "source_id string, target_id string, edge_type string")
    assert {r.node_id for r in graph.impact_radius(edges, "s", depth=3, hub=3).collect()} == {"s", "hub"}
    assert graph.impact_radius(edges, "s", depth=3, hub=10).count() == 7


def test_shortest_path_of_a_node_to_itself_and_of_no_path(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS")], "source_id string, target_id string, edge_type string")
    assert [tuple(r) for r in graph.shortest_path(edges, "a", "a").collect()] == [("a", 0)]
    assert graph.shortest_path(edges, "b", "a").count() == 0


def plain_moves(rows):
    """Every addition against every deletion still free."""
    out, stem = set(), lambda x: x.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    for key in {r[:3] for r in rows}:
        left = {r[3]: set(r[5].split(",")) for r in rows if r[:3] == key and r[4] == "D"}
        for r in sorted((r for r in rows if r[:3] == key and r[4] == "A"), key=lambda r: r[3]):
            def score(p, r=r):
                name = 5 if p.rsplit("/", 1)[-1] == r[3].rsplit("/", 1)[-1] else 2 if stem(p) == stem(r[3]) else 0
                return name + bool((left[p] & set(r[6].split(","))) - {""})
            best = min(((-score(p), p) for p in left), default=(0, ""))
            if best[0] < 0 and left[best[1]] != set(r[6].split(",")):
                out.add((*key, best[1], r[3]))
                del left[best[1]]
    return out


def test_moves_equal_a_plain_loop(spark):
    rnd = random.Random(3)
    rows = [("r", "1", "2", "old/x.ts", "D", "Money", ""), ("r", "1", "2", "old/y.ts", "D", "View", ""), ("r", "1", "2", "new/x.ts", "A", "", "Money,View"), ("r", "1", "2", "new/z.ts", "A", "", "View"), ("r", "1", "2", "new/w.ts", "A", "", "Other")]
    rows += [("d", "1", "2", f"a/n{i:02}.ts", "A", "", "View") for i in range(25)] + [("d", "1", "2", f"b/m{i:02}.ts", "D", "Money,View" if i % 5 else "View", "") for i in range(30)]
    for repo in "abc":
        for path in {f"{rnd.choice('pqr')}/{rnd.choice('klmnop')}.{rnd.choice(['ts', 'js'])}" for _ in range(30)}:
            blocks = ",".join(sorted(rnd.sample(["Money", "View", "Entry"], rnd.choice([1, 1, 2]))))
            rows.append((repo, "1", "2", path, *(("D", blocks, "") if rnd.random() < 0.5 else ("A", "", blocks))))
    diffs = spark.createDataFrame(rows, "repo string, before string, after string, path string, status string, before_blocks string, after_blocks string")
    got = {(r.repo, r.before, r.after, r.old_path, r.path) for r in temporal.move_drift(diffs).collect()}
    assert got == plain_moves(rows) and ("r", "1", "2", "old/x.ts", "new/x.ts") in got


def test_precision_and_recall(spark):
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "k string")
    r = temporal.precision_recall(rows("a", "b"), rows("b", "c", "d"), ["k"]).first()
    assert (r.hits, r.precision, r.recall) == (1, 0.5, 1 / 3)


def test_gate_status(spark):
    rows = spark.createDataFrame([(i,) for i in range(3)], "k int")
    assert temporal.known_changes_gate(rows, rows).first().status == "pass"
    assert temporal.known_changes_gate(rows, rows.where("k > 0")).first().unexpected == 1


def test_terms_drop_stop_words():
    assert retrieval.terms("Where is the auth_token for it?") == ["auth_token"]


def test_statistics_of_equal_runs(spark):
    r = evaluation.run_statistics(spark.createDataFrame([(4,), (4,)], "n int")).first()
    assert (r["mean"], r["std"], r.consistency) == (4.0, 0.0, 1.0)


def test_simulation_query_runs(spark):
    assert QUERIES["mc_reach"](spark, DATA).count() == 64


def test_adapters_cover_all_rows(spark):
    assert A.nodes(spark, DATA).groupBy("node_id").count().where("count > 1").count() == 0


def test_files_scan_and_manifest(spark, tmp_path):
    from weft.sources import files

    for name, body in {"src/a.ts": "import x from './b'\nexport const q = require('@o/p/z')", "src/b.ts": "export default 1", "node_modules/z.ts": "1", "m.py": "from os import path\nimport json.decoder\nclass C:\n  def f(self): pass", "x.bin": "1"}.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text(body)
    scan = files.source_files(spark, str(tmp_path), "org/repo").cache()
    assert {r.path for r in scan.collect()} == {"src/a.ts", "src/b.ts", "m.py"}
    edges = {(r.source_id, r.target_id, r.edge_type) for r in files.import_edges(scan).collect()}
    assert ("repo://org/repo/src/a.ts", "repo://org/repo/src/b.ts", "DEPENDS_ON_FILE") in edges
    assert ("repo://org/repo/src/a.ts", "module:@o/p", "IMPORTS_MODULE") in edges
    assert ("repo://org/repo/m.py", "module:json", "IMPORTS_MODULE") in edges
    symbols = {(r.name, r.kind) for r in files.symbols(scan).collect()}
    assert {("C", "class"), ("f", "method"), ("q", "variable")} <= symbols
    assert files.manifest(scan).where("length(sha256) = 64").count() == 3


def plain_reach(steps, start, depth, blocked=()):
    near, seen = {}, {start: 0}
    for a, b in steps:
        near.setdefault(a, set()).add(b)
    level = [start]
    for n in range(1, depth + 1):
        level = {b for a in level if a == start or a not in blocked for b in near.get(a, ())} - seen.keys()
        seen.update(dict.fromkeys(level, n))
    return seen


def test_whole_traversals_equal_plain_search(spark):
    edges = A.edges(spark, DATA).collect()
    both = [p for e in edges for p in ((e.source_id, e.target_id), (e.target_id, e.source_id))]
    degree = Counter(a for a, _ in both)
    want = plain_reach(both, "customer:7", 5, {x for x, n in degree.items() if n > 80})
    assert max(want.values()) > 3 and {r.node_id: r.depth for r in QUERIES["impact_radius_whole"](spark, DATA).collect()} == want
    symbols = [p for e in edges if e.edge_type in graph.TRACE_TYPES for p in ((e.source_id, e.target_id), (e.target_id, e.source_id))]
    want = plain_reach(symbols, "customer:7", 8)
    assert max(want.values()) > 3 and {r.node_id: r.depth for r in QUERIES["symbol_trace_whole"](spark, DATA).collect()} == want
    path = QUERIES["bfs_path_whole"](spark, DATA).collect()
    ends = path[0].path.split(" > ")
    steps = {(e.source_id, e.target_id) for e in edges}
    assert len(path) == 1 and all(s in steps for s in zip(ends, ends[1:], strict=False))
    assert plain_reach(steps, "project:EUROPE", 6)[ends[-1]] == path[0].depth == len(ends) - 1


def test_monte_carlo_query_equals_plain_search(spark):
    got = {r.run: r.reached for r in QUERIES["mc_reach"](spark, DATA).collect()}
    assert sorted(got) == list(range(64))
    weighted = catalogue._overlay(spark, DATA)
    nth = F.row_number().over(Window.partitionBy("source_id", "target_id", "edge_type").orderBy("adjusted_weight"))
    weighted = weighted.withColumn("nth", nth)
    way = lambda a, b, x: weighted.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.concat_ws(":", "edge_type", F.lit(x), F.col("nth").cast("string")).alias("edge"), "adjusted_weight")
    both = way("source_id", "target_id", "a").union(way("target_id", "source_id", "b"))
    for run in (0, 63):
        passed = both.where(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("42"), F.lit(str(run)), "src", "dst", "edge")), 1, 8), 16, 10).cast("long") <= F.col("adjusted_weight") * float(1 << 32))
        assert got[run] == len(plain_reach([(r.src, r.dst) for r in passed.collect()], "customer:7", 8))


def test_whole_queries_take_all_rows(spark, tmp_path):
    texts = ["the the cat", "bathe them", None, "The.the,THE", "other"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_the for r in QUERIES["barrel_counts_whole"](spark, str(tmp_path)).collect()} == {0: 2, 1: 0, 2: 0, 3: 3, 4: 0}
    lines, events = A.table(spark, DATA, "lineitem"), A.table(spark, DATA, "events")
    best = lines.groupBy("l_suppkey").count().agg(F.max("count")).first()[0]
    assert QUERIES["entity_rank_whole"](spark, DATA).agg(F.max("n_actions")).first()[0] == best
    by_user = Counter(r.user_id for r in events.select("user_id").collect())
    got = QUERIES["contradictions_whole"](spark, DATA).collect()
    assert {r.target: r.n for r in got} == {u: n for u, n in by_user.items() if n > 1}


def test_ranges_are_cut_by_encoding(spark):
    text = "aé😀b\nsecond line\nlast"
    want = [("UTF8", [0, 1, 3], "é"), ("UTF8", [0, 3, 7], "😀"), ("UTF16", [0, 2, 4], "😀"), ("UTF32", [0, 2, 3], "😀"), ("UTF32", [0, 3, 2, 4], "b\nsecond line\nlast"), ("UTF16", [1, 0, 6], "second"), ("UTF32", [9, 0, 3], "")]
    rows = spark.createDataFrame([(i, text, r, e) for i, (e, r, _) in enumerate(want)], "i int, c string, r array<int>, e string")
    got = {x.i: x.t for x in rows.select("i", symbols.cut_out(F.col("c"), F.col("r"), F.col("e")).alias("t")).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(want)}
    assert one(spark, ids.source_slice(lit := F.lit(text), F.lit(1), F.lit(1), F.lit(1), F.lit(3))) == "é😀"
    assert one(spark, ids.source_slice(lit, F.lit(1), F.lit(3), F.lit(2), F.lit(6))) == "b\nsecond"


def test_places_meet_the_narrowest_span(spark):
    rnd = random.Random(5)
    spans = [(f"f{i % 3}", f"s{i}", a := rnd.randrange(1, 900), a + rnd.choice([0, 3, 40, 200, 2000]), i % 4) for i in range(200)]
    points = [(f"f{i % 4}", rnd.randrange(1, 1200), f"y{i}") for i in range(300)]
    got = {r.symbol: r.node_id for r in symbols.narrowest(spark.createDataFrame(points, "path string, line int, symbol string"), spark.createDataFrame(spans, "path string, node_id string, start_line int, end_line int, start_col int")).collect()}
    want = {y: min(((e - s, c, n) for p, n, s, e, c in spans if p == path and s <= line <= e), default=(0, 0, None))[2] for path, line, y in points}
    assert got == want


def test_paths_between_evidence(spark):
    edges = spark.createDataFrame([("a", "b", "X"), ("b", "c", "X"), ("a", "d", "X"), ("d", "c", "X"), ("c", "e", "X")], "source_id string, target_id string, edge_type string")
    chosen = spark.createDataFrame([(0, "a"), (1, "c"), (2, "e"), (3, "a")], "ord int, node_id string")
    assert [tuple(r) for r in evidence.evidence_paths(edges, chosen).collect()] == [("a > b > c", 2), ("c > e", 1)]


def test_answers_without_blocks_are_refused(spark):
    assert evidence.plan_question("tell me a story").blocks == ()
    assert evidence.plan_question("trace the login session").trace is True
    questions = spark.createDataFrame([(1, "which service is this"), (2, "activation workflow"), (3, "cats"), (4, "the user api")], "id int, question string")
    assert {r.id: r.route for r in evidence.planned(questions).collect()} == {1: "query_projects", 2: "trace_entity_workflow", 3: "unsupported", 4: "answer_with_evidence"}


def test_seeds_fall_back_to_degrees(spark):
    nodes = spark.createDataFrame([("a", "x", "p"), ("b", "y", "q")], "node_id string, label string, file_path string")
    edges = spark.createDataFrame([("b", "c", "CALLS")], "source_id string, target_id string, edge_type string")
    none = spark.createDataFrame([], "node_id string, primary_block string")
    hot = spark.createDataFrame([], "file_path string")
    assert [tuple(r) for r in simulate.seeds(nodes, none, hot, edges, "zzz", 1).collect()] == [("b", 0.0)]


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError, match="checkpoint"):
        session.cut(type("Frame", (), {"sparkSession": Session})())


def test_runs_move_as_bits(spark):
    """A hub with more steps than a group draws for, and more runs than a long has bits, match plain Python; a level makes
    a row for a node, not for each of its runs."""
    import hashlib

    rows = [("hub", f"n{i}", "CALLS", 0.4) for i in range(graph.DRAWN + 10)] + [("n1", "z", "CALLS", 0.7), ("n1", "z", "CALLS", 0.9), ("n2", "z", "X", 1.5)]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, edge_type string, weight double")
    seeds = spark.createDataFrame([("n1",), ("n2",)], "node_id string")
    steps, nth = {}, {}
    for s, t, kind, w in rows:
        nth[s, t, kind] = nth.get((s, t, kind), 0) + 1
        steps.setdefault(s, []).append((t, f"{kind}:a:{nth[s, t, kind]}", w))
        steps.setdefault(t, []).append((s, f"{kind}:b:{nth[s, t, kind]}", w))
    want = set()
    for run in range(70):
        seen, new = {"n1", "n2"}, {"n1", "n2"}
        for _ in range(2):
            new = {t for s in new for t, e, w in steps[s] if int(hashlib.md5(f"42:{run}:{s}:{t}:{e}".encode()).hexdigest()[:8], 16) <= w * 2**32} - seen
            seen |= new
        want |= {(run, n) for n in seen}
    assert set(map(tuple, graph.monte_carlo_reach(edges, seeds, 70, 2).collect())) == want
    bits = graph.monte_carlo_bits(edges, seeds, 70, 2)
    assert bits.count() == len({(n, run // graph.BITS) for run, n in want})


def test_spans_of_one_line_make_no_pairs(spark):
    """2,000 nodes of one name over the same lines and 2,000 definitions there: what the plan's joins make stays near the rows read."""
    nodes = spark.range(2000).selectExpr("'f' AS path", "'n' AS label", "concat('x', id) AS node_id", "cast(id % 50 AS int) AS start_line", "cast(id % 50 + id % 7 AS int) AS end_line", "cast(id % 5 AS int) AS start_col")
    occurrences = spark.range(2000).selectExpr("'f' AS path", "id AS ord", "concat('s', id) AS symbol", "1 AS roles", "cast(id % 60 AS int) AS line", "'n' AS token")
    info = spark.createDataFrame([], "symbol string, display_name string, kind string")
    spans = [(r.start_line, r.end_line, r.start_col, r.node_id) for r in nodes.collect()]
    best = lambda line: min((not s <= line <= e, e - s, c, i) for s, e, c, i in spans)[3]
    found = symbols.definitions(occurrences, nodes, info)
    assert {(r.ord, r.node_id) for r in found.collect()} == {(i, best(i % 60)) for i in range(2000)}
    points = occurrences.select("path", "line", "symbol")
    near = lambda line: min((not s <= line <= e, e - s if s <= line <= e else abs(s - line) + abs(e - line), c, i) for s, e, c, i in spans)[3]
    assert {(r.symbol, r.node_id) for r in symbols.nearest(points, nodes).collect()} == {(f"s{i}", near(i % 60)) for i in range(2000)}
    held = symbols.holding(points, nodes, ["path"])
    assert held.count() == len({i % 60 for i in range(2000) if any(s <= i % 60 <= e for s, e, _, _ in spans)})  # a row a place


def test_draws_equal_md5():
    import hashlib

    import numpy as np

    from weft.operators import draws

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab:é") for _ in range(n)).encode() for n in range(140)]
    row, run = ([rnd.choice(x) for _ in range(3000)] for x in (range(len(texts)), [0, 9, 10, 63, 100, 1999]))
    got = draws.draws(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.array(row), np.array(run), 42)
    assert got.tolist() == [int(hashlib.md5(f"42:{r}:".encode() + texts[t]).hexdigest()[:8], 16) for t, r in zip(row, run, strict=True)]


def test_late_levels_ask_for_few_steps(spark, monkeypatch):
    """Once nearly all nodes are reached by all runs, only steps into the others are taken: here none, though all
    steps leave nodes that were reached last."""
    from weft.operators import draws

    some = [(f"a{i}", f"b{j}", 1.0) for i in range(30) for j in range(30)]
    edges = spark.createDataFrame([*some, *((f"b{j}", "c", 0.5) for j in range(3))], "source_id string, target_id string, weight double")
    seeds = spark.createDataFrame([("a0",)], "node_id string")
    asked, plain = spark.sparkContext.accumulator(0), draws.passing

    def passing(seed):
        inner = plain(seed)

        def counted(batches):
            held = list(batches)
            asked.add(sum(b.num_rows for b in held))
            yield from inner(iter(held))

        return counted

    monkeypatch.setattr(draws, "passing", passing)
    got = graph.monte_carlo_bits(edges, seeds, 64, 6)
    assert got.where("runs = -1").count() == 60 and got.count() == 61
    assert 900 <= asked.value <= 30 + 29 * 30 + 3 + 3  # each step to a node that lacks a run, and none back
