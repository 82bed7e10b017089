"""Compositions: enrichment of a repository, and a change from its description to its impact."""

from __future__ import annotations

from weft.operators import classify, enrichment, graph, semantic, simulate


def _nodes(spark):
    rows = [
        ("n1", "code", "function", "sessionGuard", "src/auth/session.ts", "jwt session permission role"), ("n2", "code", "db_model", "User", "prisma/schema.prisma", "model User prisma database"),
        ("n3", "code", "route_handler", "login", "src/routes/login.ts", "router request endpoint login"), ("n4", "code", "function", "helper", "src/util.ts", "x"),
    ]
    return spark.createDataFrame(rows, "node_id string, layer string, kind string, label string, file_path string, content string")


def test_enrichment_is_its_parts(spark):
    nodes = _nodes(spark)
    near = spark.createDataFrame([("n1", ["module:jose"], [], ["n4"])], "node_id string, imports array<string>, imported_by array<string>, same_file array<string>")
    made = enrichment.enrich(nodes, "org/app", "app", "project:org_app", near)
    assigned = {r.node_id: r.primary_block for r in made.assignments.collect()}
    assert assigned == {r.node_id: r.primary_block for r in classify.classify_nodes(nodes, near).collect()} and len(assigned) == 4
    texts = {r.node_id: (r.summary_type, r.text) for r in made.summaries.collect()}
    assert len(texts) == 6 and texts["n1"][1].endswith(f"maps to {assigned['n1']} with 1 import edge(s) and 1 sibling code node(s).")
    assert texts["project:org_app"][0] == "project" and "derived from 4 code-node" in texts["project:org_app"][1] and assigned["n2"] in texts["project:org_app"][1]
    assert texts["system:local"][1].startswith("System org/app currently contains 1 project graph(s).") and "Project app represents" in texts["system:local"][1]
    known = {r.entity_id for r in made.entities.collect()}
    assert known and {r.entity_id for r in made.actions.collect()} <= known
    assert {r.node_id for r in made.actions.collect()} == {r.node_id for r in semantic.actions(nodes, made.assignments, made.entities).collect()}
    none = made.assignments.limit(0)
    assert "unclassified code" in enrichment.project_text(none, "a", "b").first().text


def test_a_change_is_overlay_seeds_and_reach(spark):
    nodes = _nodes(spark)
    edges = spark.createDataFrame([("n1", "n2", "CALLS"), ("n3", "n1", "CALLS"), ("n4", "n3", "REFERENCES")], "source_id string, target_id string, edge_type string")
    assigned = classify.classify_nodes(nodes)
    hot = spark.createDataFrame([("src/auth/session.ts",)], "file_path string")
    starts, impacted, stats = simulate.change(nodes, edges, assigned, hot, "change the session login", runs=32)
    assert {r.node_id for r in starts.collect()} == {r.node_id for r in simulate.seeds(nodes, assigned, hot, edges, "change the session login").collect()} and starts.count() >= 2
    overlay = graph.causal_overlay(nodes, edges, hot, assigned.selectExpr("node_id", "primary_block AS block"), simulate.change_tokens("change the session login"))
    runs = graph.monte_carlo_reach(overlay.selectExpr("source_id", "target_id", "edge_type", "adjusted_weight AS weight"), starts.select("node_id"), runs=32)
    assert {(r.node_id, r.hits) for r in impacted.collect()} == {(r["node_id"], r["count"]) for r in runs.groupBy("node_id").count().collect()}
    row = stats.first()
    assert 0.02 <= row.confidence <= 0.98 and row["mean"] > 1
