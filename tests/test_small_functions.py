"""Functions that few others call: each with the cases that it is for."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weft.functions import ids
from weft.operators import canonical, correlate, evaluation, evidence, gold, graph, regret, symbols
from weft.sources import files, store
from weft.streaming import online


def test_points_meet_spans_of_all_sizes(spark):
    rnd = random.Random(1)
    spans = [(rnd.choice("ab"), i, low, low + rnd.choice([0, 1, 5, 63, 64, 900, 100_000])) for i, low in enumerate(rnd.randint(-500, 5000) for _ in range(150))]
    points = [(rnd.choice("abc"), i, rnd.randint(-3000, 9000)) for i in range(300)]
    made = graph.containment_join(spark.createDataFrame(points, "k string, point_id int, at long"), spark.createDataFrame(spans, "k string, span_id int, low long, high long"), "k")
    got = {r.point_id: (r.span_id, r.inside) for r in made.collect()}
    for k, i, at in points:
        own = [(not low <= at <= high, high - low if low <= at <= high else min(abs(at - low), abs(at - high)), s) for kk, s, low, high in spans if kk == k]
        assert got.get(i) == ((min(own)[2], not min(own)[0]) if own else None)
    assert graph.containment_join(spark.createDataFrame(points, "k string, point_id int, at long"), spark.createDataFrame([], "k string, span_id int, low long, high long"), "k").count() == 0


def test_columns(spark):
    row = spark.createDataFrame([("s", "p", "A", 7.5)], "sha string, path string, status string, x double").select(ids.change_key("sha", "path", "status").alias("k"), ids.clamp(F.col("x"), 0.0, 1.0).alias("c"), ids.clamp(F.col("x"), 8.0, 9.0).alias("d")).first()
    assert tuple(row) == ("s|p|A", 1.0, 8.0)
    names = spark.createDataFrame([("",), ("org/app",), ("app",), ("p",), ("other",), (None,), (" app ",)], "repo_name string")
    assert [r.repo_name for r in names.where(gold.applies("org/app")).collect()] == ["", "org/app", "app", None, " app "]


def test_interfaces_and_infrastructure(spark):
    ops = spark.createDataFrame([("s", "GET", f"/t{i:02}") for i in range(45)], "spec string, method string, template string")
    met = spark.createDataFrame([("s", "GET", "/t03", "routes/a.ts")], "spec string, method string, template string, target string")
    hints = correlate.flow_hints(ops, met).collect()
    assert len(hints) == 40 and [(r.template, r.target) for r in hints if r.target] == [("/t03", "routes/a.ts")]
    edges = correlate.openapi_edges(met)
    assert [tuple(r) for r in edges.collect()] == [("spec:s", "codefile:routes/a.ts", "OPENAPI_GET")]
    sources = spark.createDataFrame([("routes/a.ts",), ("x/main.tf",), ("node_modules/y.yaml",), ("k.yml",)], "path string")
    assert {tuple(r) for r in correlate.infra_files(sources).collect()} == {("x/main.tf", "terraform"), ("k.yml", "helm_yaml")}
    nodes = spark.createDataFrame([("codefile:other",)], "node_id string")
    assert [tuple(r) for r in correlate.code_files(edges, nodes, sources).collect()] == [("codefile:routes/a.ts", "routes/a.ts")]
    assert correlate.code_files(edges, edges.select(F.col("target_id").alias("node_id")), sources).count() == 0


def test_producers_of_documents_and_regrets(spark):
    nodes, edges = canonical.documents(spark.createDataFrame([("a.ts",)], "path string"), "r")
    assert nodes.first()["node_id"] == "scip-document:a.ts" and edges.first()["target_id"] == "repo://r/a.ts"
    nodes, edges = canonical.regrets(spark.createDataFrame([("g1", "Too many", ["n1", "n2"])], "regret_id string, title string, node_ids array<string>"), "r")
    assert nodes.first()["node_id"] == "regret:g1" and {r.target_id for r in edges.collect()} == {"n1", "n2"}


def test_gates_counts_and_runs(spark, tmp_path):
    checks = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "gate string, ok boolean")
    assert {tuple(r) for r in evaluation.validation_gates(checks, ["a", "b", "c"]).collect()} == {("a", "fail"), ("b", "pass"), ("c", "fail")}
    for name, row in (("nodes", ("r", "n", "x")), ("edges", ("r", "n", "m", "CALLS")), ("assignments", ("r", "n", "Money"))):
        store.upsert(spark.createDataFrame([row], store.KEYS[name] + (["kind"] if name == "nodes" else [])), str(tmp_path), name)
    have = store.stored_counts(spark, str(tmp_path))
    want = spark.createDataFrame([("nodes", "r", 1), ("edges", "r", 2), ("assignments", "r", 1), ("nodes", "q", 1)], "table string, repo_name string, n long")
    assert {(r.table, r.repo_name, r.status) for r in evaluation.verified(have, want).collect()} == {("nodes", "r", "pass"), ("edges", "r", "fail"), ("assignments", "r", "pass"), ("nodes", "q", "fail")}
    runs = spark.createDataFrame([("r", "1", 5), ("r", "2", 7), ("r", "3", 7), ("q", "9", 1)], "repo string, run string, modified int")
    assert {(r.repo, r.run) for r in symbols.latest_runs(runs).collect()} == {("r", "3"), ("q", "9")}
    assert symbols.resolution_rate(spark.createDataFrame([("a",), (None,)], "node_id string")).first().rate == 0.5


def test_plans_and_workflows(spark):
    found = spark.createDataFrame([("p1",), ("p2",)], "pattern_id string")
    assert {tuple(r) for r in regret.with_plans(found, spark.createDataFrame([("p1", "split")], "pattern_id string, plan string")).collect()} == {("p1", "split"), ("p2", None)}
    entities = spark.createDataFrame([("e", "invoice"), ("f", "cart")], "entity_id string, name string")
    actions = spark.createDataFrame([("e", "n2", "PERSIST"), ("e", "n1", "CREATE"), ("f", "n1", "CREATE")], "entity_id string, node_id string, action string")
    assert [(r.node_id, r.action) for r in evidence.entity_workflow(entities, actions, "invoice flow").collect()] == [("n1", "CREATE"), ("n2", "PERSIST")]


def test_files_and_their_manifests(spark):
    one = spark.createDataFrame([("o/r", "./a.ts", 3, "x"), ("o/r", "b.ts", 1, "y")], "repo_name string, path string, size long, content string")
    assert {r.node_id for r in files.file_nodes(one).collect()} == {"repo://o/r/a.ts", "repo://o/r/b.ts"}
    two = one.withColumn("content", F.when(F.col("path") == "b.ts", "z").otherwise(F.col("content"))).unionByName(one.limit(1).withColumn("path", F.lit("new.ts")))
    assert {r.path for r in files.stale(files.manifest(one), files.manifest(two)).collect()} == {"b.ts", "new.ts"} and files.stale(files.manifest(one), files.manifest(one)).count() == 0


def test_ledgers_and_windows_as_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"2024-01-01 00:00:{i:02}", "Money") for i in range(0, 60, 5)] + [("b", "2024-01-03 00:00:00", "View")], "client string, at string, block string").withColumn("ts", F.to_timestamp("at"))
    online.append_ledger(rows.select("client", "block", "ts"), str(tmp_path / "ledger"))
    stream = online.ledger(spark, str(tmp_path / "ledger"), "client string, block string, ts timestamp, entry_id string, written_at timestamp")
    for name, made in (("rates", online.rate_by_window(stream, 60, 60)), ("churn", online.churn_by_window(stream))):
        made.writeStream.format("memory").queryName(name).outputMode("complete" if name == "none" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert {(r.client, r.requests) for r in spark.table("rates").collect()} == {("a", 12)}  # the last window is open
    assert {(r.block, r.changes) for r in spark.table("churn").collect()} == {("Money", 12)}
    online.into_table(stream, str(tmp_path / "table"), str(tmp_path / "at"), lambda df: df.select("client")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 13 and spark.read.json(str(tmp_path / "ledger")).select("entry_id").distinct().count() == 13
