"""Fingerprints, integrity checks, gates, and searches with paths."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weft.operators import classify, graph, integrity


def test_fingerprints_see_changed_lost_repeated_and_shifted_rows(spark):
    rows = [(i, None if i % 3 else "x", {"a": i}, [1.5, None]) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, s string, m map<string,int>, a array<double>")
    one = lambda some: integrity.fingerprint(some).first()
    base = one(df)
    assert base == one(df.orderBy(F.rand()).repartition(7).select("a", "m", "s", "i")) and base.n == 50
    for other in (df.where("i <> 7"), df.unionByName(df.where("i = 7")), df.withColumn("s", F.when(F.col("i") == 7, "y").otherwise(F.col("s"))), df.unionByName(df.where("i IN (7, 7)")).where("i <> 8"), df.unionByName(df).where("true")):
        assert not integrity.same_rows(df, other).first().same
    pairs = spark.createDataFrame([(None, "a")], "x string, y string"), spark.createDataFrame([("a", None)], "x string, y string")
    assert not integrity.same_rows(*pairs).first().same
    assert integrity.same_rows(df.limit(0), df.limit(0)).first().same and integrity.same_rows(df, df, ["s"]).where("NOT same").count() == 0
    assert {(r.s, r.n_left, r.n_right) for r in integrity.same_rows(df, df.where("s IS NULL"), ["s"]).where("s = 'x'").collect()} == {("x", 17, 0)}


def test_checks_find_each_kind_of_fault(spark):
    nodes = spark.createDataFrame([("project:p", "project", None), ("f", "file", "a.ts"), ("c", "code", "a.ts"), ("d", "code", "gone.ts"), ("s", "semantic", None), ("t", "test", None), ("t", "test", None), ("None", "code", "a.ts")], "node_id string, layer string, file_path string")
    edges = [("f", "c", "CONTAINS", "x"), ("f", "module:z", "IMPORTS_MODULE", "x"), ("c", "local 3", "REFERENCES", "x"), ("c", "lost", "REFERENCES", "x"), ("module:z", "c", "IMPORTS_MODULE", "x"), ("provisional://a", "c", "CALLS", None), ("s", "c", "DESCRIBES", "x")]
    edges = spark.createDataFrame(edges, "source_id string, target_id string, edge_type string, provenance string")
    manifest = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "")], "path string, sha256 string")
    report = integrity.integrity_report({
        "structural": integrity.structural_checks(nodes, edges), "canonical": integrity.canonical_checks(nodes, edges, (nodes, edges.where("provenance IS NOT NULL"))),
        "scip": integrity.index_checks(spark.createDataFrame([(5, 3)], "resolved int, total int"), True, False), "semantic": integrity.semantic_checks(nodes, None),
        "manifest": integrity.manifest_checks(manifest, spark.createDataFrame([("a", "9"), ("c", "3")], "path string, sha256 string")),
    })
    got = {r.check_id: (r.status, r.detail) for r in report.collect()}
    assert got == {
        "no_dangling_edges": ("fail", 3), "no_provisional_edge_leakage": ("fail", 1), "code_files_materialized": ("fail", 1), "code_is_contained": ("fail", 2),
        "canonical_graph_no_dangling_targets": ("fail", 3), "canonical_graph_all_edges_have_provenance": ("fail", 1), "canonical_graph_stable_node_ids": ("fail", 2), "canonical_graph_derived_nodes_link_to_evidence": ("fail", 2),
        "canonical_graph_reloads_without_loss": ("fail", 1), "scip_binary_has_metadata": ("fail", 1), "scip_consumed_has_index": ("pass", 0), "scip_resolution_counts_bounded": ("warn", 1), "semantic_layer_optional": ("pass", 0),
        "manifest_files_exist": ("fail", 1), "manifest_hashes_current": ("fail", 1),
    }


def test_history_gates_and_their_summary(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n int, path string")
    score = spark.createDataFrame([(0.9, 0.8)], "precision double, recall double")
    status = lambda *a: {r.gate_id.removeprefix("temporal_gate_"): r.status for r in integrity.history_gates(*a).collect()}
    assert status(rows, rows) == {"metrics_reproducible": "pass", "known_changes": "blocked", "drift_detection": "blocked"}
    assert status(rows, rows.where("n = 1"), rows, rows.where("n = 2"), score) == {"metrics_reproducible": "fail", "known_changes": "pass", "drift_detection": "fail"}
    assert integrity.gates_summary(integrity.history_gates(rows, rows)).first().overall_status == "blocked"
    assert integrity.gates_summary(integrity.history_gates(rows, rows, rows, rows, score.withColumn("recall", F.lit(0.85)))).first().asDict() == {"gate_count": 3, "failed": 0, "blocked": 0, "overall_status": "pass"}


def test_paths_from_both_ends_are_shortest_and_reach_less(spark):
    rnd = random.Random(4)
    made = {(f"n{rnd.randint(0, 400)}", f"n{rnd.randint(0, 400)}") for _ in range(700)}
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in made] + [("n1", "far", "CONTAINS")], "source_id string, target_id string, edge_type string")
    steps = {}
    for a, b in made:
        steps.setdefault(a, set()).add(b), steps.setdefault(b, set()).add(a)

    def plain(start):
        depth, level = {start: 0}, [start]
        while level:
            level = [y for x in level for y in steps.get(x, ()) if y not in depth and not depth.update({y: depth[x] + 1})]
        return depth

    for start, end in (("n1", "n200"), ("n5", "n5"), ("n1", "far")):
        path, counts = graph.trace_path(edges, start, end)
        got = [r.node_id for r in path.orderBy("ord").collect()]
        depth = plain(start)
        if end not in depth or depth[end] > 8:
            assert got == []
            continue
        assert len(got) == depth[end] + 1 and (got[0], got[-1]) == (start, end) and all(b in steps[a] for a, b in zip(got, got[1:], strict=False))
        assert sum(counts.values()) <= max(2, sum(d <= depth[end] for d in depth.values()))


def test_impact_subgraphs_have_edges_and_pruned_nodes(spark):
    edges = spark.createDataFrame([("s", "hub", "CALLS"), ("s", "a", "CALLS"), ("a", "b", "USES"), ("b", "c", "USES"), *((f"x{i}", "hub", "CALLS") for i in range(5))], "source_id string, target_id string, edge_type string")
    nodes, touched, pruned = graph.impact_subgraph(edges, "s", depth=1, most=10, hub=3)
    assert {r.node_id for r in nodes.collect()} == {"s", "hub", "a", "b"}
    assert {(r.source_id, r.target_id) for r in touched.collect()} == {("s", "hub"), ("s", "a"), ("a", "b")}
    assert [(r.node_id, r.incident_edges) for r in pruned.collect()] == [("hub", 6)]
    assert graph.impact_subgraph(edges, "s", most=2)[0].count() == 2


def test_all_rules_of_paths(spark):
    rows = [("src/auth/x.ts",), ("SRC\\DB\\a.sql",), ("plain.md",), ("a/cookie/store.ts",)]
    got = [r.blocks for r in classify.path_blocks(spark.createDataFrame(rows, "path string")).collect()]
    assert got == ["Access Control", "Data Persistence", "Unclassified", "Data Sovereignty,State Management,Persistence Strategy"] and len(classify.BLOCK_PATHS) == 24


def test_phases_of_an_index_a_store_and_gold_rows(spark):
    from weft.operators import phases

    nodes = spark.createDataFrame([("S#a", "function", "scip", "old"), ("b", "class", "provisional", None), ("d", "db_model", "provisional", None), ("f", "file_surface", "file_surface", None)], "node_id string, kind string, symbol_source string, original_id string")
    edges = spark.createDataFrame([("f", "old", "CONTAINS", ""), ("S#a", "S#a", "DEFINES", "scip_definition"), ("S#a", "b", "REFERENCES", "scip_reference_code"), ("S#a", "x", "CROSS_REFERENCE", "scip_cross_repo"), ("f", "b", "REFERENCES", "scip_file_fallback")], "source_id string, target_id string, edge_type string, provenance string")
    orphans = spark.createDataFrame([(True,), (False,)], "addressable boolean")
    values = lambda df: {r.metric_id: round(r.value, 6) for r in df.collect()}
    assert values(phases.identity(nodes, edges, orphans, edges.limit(4))) == {
        "resolved_symbol_rate": 0.5, "orphaned_symbol_rate": 0.5, "raw_orphaned_symbol_rate": 0.5, "stale_provisional_target_count": 1, "total_code_nodes": 3, "scip_eligible_code_nodes": 2,
        "nodes_with_scip_identity": 1, "orphaned_symbol_count": 1, "raw_orphaned_symbol_count": 2, "addressable_symbol_total": 2,
    }
    assert values(phases.references(nodes, edges)) == {"resolved_symbol_rate": 0.5, "defines_edge_count": 1, "reference_edge_count": 3, "cross_repo_reference_count": 1, "file_fallback_reference_rate": round(1 / 3, 6)}
    assert values(phases.storage((nodes, edges), (nodes, edges.where("provenance <> ''")))) == {"verify_pass": 0, "code_rows": 4, "edge_rows": 4}
    blocked = phases.report(phases.identity(nodes, edges, None, None), phases.references(nodes, None), phases.storage((nodes, edges), None), phases.semantics(nodes, None), phases.evaluation(nodes, nodes, None), phases.history(nodes, None), phases.structure(nodes, edges, nodes))
    assert {r.phase_id: r.availability for r in phases.availability(blocked).collect()} == {**dict.fromkeys(phases.NEEDS, "blocked"), "phase_1": "available"}


def test_structural_checks_read_edges_once(spark):
    """Loops, repeated nodes, unknown and null ends; edges are worked out once for all four checks."""
    from pyspark.sql import functions as F

    from weft.operators import graph

    read = spark.sparkContext.accumulator(0)

    def kind(x):
        read.add(1)
        return x

    nodes = spark.createDataFrame([("a", "code"), ("a", "code"), ("b", "code"), ("c", "file"), (None, "code")], "node_id string, layer string")
    edges = spark.createDataFrame([("c", "b", "CONTAINS"), ("a", "x", "CALLS"), ("a", "module:m", "IMPORTS_MODULE"), ("y", "a", "CALLS"), ("b", "b", "CALLS"), (None, "b", "CALLS"), ("b", None, "CALLS")], "source_id string, target_id string, edge_type string")
    got = graph.integrity_checks(nodes, edges.withColumn("edge_type", F.udf(kind, "string")("edge_type")))
    # a is in no file, twice, and its edges lead to nothing known; the node without an id has neither
    assert {r.check_id: r.detail for r in got.collect()} == {"node_ids_unique": 1, "no_dangling_edges": 4, "code_is_contained": 3, "nodes_connected": 3}
    assert read.value == 7
