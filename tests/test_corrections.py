"""Cases that were once wrong."""

from __future__ import annotations

import fnmatch
import random

from pyspark.sql import functions as F

from weft.functions import ids
from weft.operators import gold, graph, temporal


def test_parallel_edges_are_tried_one_by_one(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS", 0.5), ("a", "b", "USES", 0.5)], "source_id string, target_id string, edge_type string, weight double")
    seeds = spark.createDataFrame([("a",)], "node_id string")
    for some in (edges, edges.drop("edge_type"), edges.withColumn("edge_type", F.lit("CALLS"))):
        hit = graph.monte_carlo_reach(some, seeds, runs=2000).where("node_id = 'b'").count()
        assert 1400 < hit < 1600  # one draw for both would give 1,000
    both = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5)], "source_id string, target_id string, weight double")
    assert 1400 < graph.monte_carlo_reach(both, seeds, runs=2000).where("node_id = 'b'").count() < 1600


def test_targets_under_review_only_are_contradictions(spark):
    schema = "id string, repo_name string, node_id string, file_path string, file_glob string, accepted_blocks array<string>, primary_block string, confidence string, status string, notes string"
    row = lambda i, node, block, status: (i, "r", node, None, None, [block], block, "high", status, "")
    rows = [row("1", "n", "X", "needs_review"), row("2", "n", "Y", "needs_review"), row("3", "m", "X", "active"), row("4", "m", "Y", "needs_review"), row("5", "o", "X", "active"), row("6", "o", "Y", "active"), row("7", "p", "X", "needs_review")]
    got = gold.audit(spark.createDataFrame(rows, schema)).first()
    assert (got.contradictions, got.status) == (2, "fail")  # n and o
    assert gold.audit(spark.createDataFrame(rows[2:4], schema)).first().status == "pass"


def test_globs_have_classes(spark):
    globs = ["src/[ab].ts", "src/[!ab].ts", "*[0-9]?", "[]x]a", "[[]z", "a[b", "x.y+(z)", "[^a]b", "[a-", "**/q", "{a}|$", "[a&&b]", "", "[!]]k", "é?"]
    names = ["src/a.ts", "src/c.ts", "f7x", "]a", "xa", "[z", "a[b", "x.y+(z)", "xxyzz", "^b", "cb", "[a-", "d/e/q", "{a}|$", "&", "b", "", "ak", "]k", "éa", "src/a.ts\n"]
    rnd = random.Random(1)
    globs += ["".join(rnd.choice("ab*?[]!-x/") for _ in range(rnd.randint(1, 7))) for _ in range(80)]
    names += ["".join(rnd.choice("ab[]!-x/") for _ in range(rnd.randint(0, 5))) for _ in range(80)]
    valid = [g for g in globs if "--" not in g and not any(a > b for a, b in zip(g, g[2:], strict=False))] + globs[:15]
    df = spark.createDataFrame([(g,) for g in set(valid)], "g string").join(spark.createDataFrame([(n,) for n in set(names)], "n string"))
    for r in df.select("g", "n", F.rlike("n", ids.glob_regex("g")).alias("hit")).collect():
        assert r.hit == fnmatch.fnmatchcase(r.n, r.g), r


def test_moves_that_depend_on_each_other_take_no_rounds(spark):
    n = 60
    rows = [("r", "1", "2", f"a/n{i:02}.ts", "A", "", "View" if i % 2 else f"View,X{i:02}") for i in range(n)] + [("r", "1", "2", f"b/m{i:02}.ts", "D", f"View,X{i:02}" if i % 3 else "View", "") for i in range(n)]
    rows += [(None, "1", "2", "a/k.ts", "A", "", "View"), (None, "1", "2", "b/k.ts", "D", "Other", "")]
    diffs = spark.createDataFrame(rows, "repo string, before string, after string, path string, status string, before_blocks string, after_blocks string")
    free, want = {r[3]: r[5] for r in rows if r[0] and r[4] == "D"}, set()
    for r in sorted(x for x in rows if x[0] and x[4] == "A"):
        best = next((p for p in sorted(free) if set(free[p].split(",")) & set(r[6].split(","))), None)
        if best and free[best] != r[6]:
            want.add((best, r[3], free.pop(best), r[6]))
    spark.sparkContext.setJobGroup("moves", "moves")
    got = {(r.old_path, r.path, r.before_blocks, r.after_blocks) for r in temporal.move_drift(diffs).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("moves")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and len(jobs) <= 3  # once some jobs for every round, and rounds by the additions


def test_gold_rows_meet_sets_of_blocks_and_parts_of_paths(spark, monkeypatch):
    monkeypatch.setattr(gold, "DEALT", 2)
    nodes = spark.createDataFrame([(f"n{i}", "a/x.ts" if i < 7 else "a/y.ts" if i < 9 else None) for i in range(10)], "node_id string, file_path string")
    schema = "node_id string, primary_block string, secondary array<struct<block:string,confidence:double>>"
    assigned = spark.createDataFrame([(f"n{i}", None if i != 3 else "X", [("Y", 0.5)] if i == 8 else None) for i in range(9)], schema)
    row = lambda i, node, path, glob, block: (i, "", node, path, glob, [block], block, "high", "active")
    rows = [row("id", "n0", "", "", "X"), row("path", "", "a/x.ts", "", "X"), row("other", "", "a/x.ts", "", "Y"), row("glob", "", "", "a/*", "Y"), row("none", "", "", "b/*", "X"), row("lost", "n9", "", "", "X")]
    golds = spark.createDataFrame(rows, "id string, repo_name string, node_id string, file_path string, file_glob string, accepted_blocks array<string>, primary_block string, confidence string, status string")
    got = {r.id: (r.found, r.hit) for r in gold.benchmark(golds, nodes, assigned).collect()}
    assert got == {"id": (True, False), "path": (True, True), "other": (True, False), "glob": (True, True), "none": (False, False), "lost": (False, False)}  # without a block: found
    met = sorted((r.id, r.node_id) for r in gold.targets(golds, nodes).where("via <> 'node_id'").collect())
    assert met == sorted([(i, f"n{n}") for i in ("path", "other") for n in range(7)] + [("glob", f"n{n}") for n in range(9)])


def test_nodes_of_a_union_work_edges_out_once(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "node_id string")
    for more in ("d", "e"):
        nodes = nodes.unionByName(spark.createDataFrame([(more,)], "node_id string"))
    edges = spark.range(6).select(F.element_at(F.array(*map(F.lit, "abxyza")), (F.col("id") + 1).cast("int")).alias("source_id"), F.element_at(F.array(*map(F.lit, "bxcydd")), (F.col("id") + 1).cast("int")).alias("target_id"), F.lit("CALLS").alias("edge_type"))
    found = graph.connected_to_known(nodes, edges)
    assert sorted(r.node_id for r in found.collect()) == ["a", "a", "b", "d"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 6") == 1  # once for each part of nodes


def test_rows_of_a_glob_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(gold, "MADE", 5000)
    nodes = spark.range(400).selectExpr("concat('n', id) AS node_id", "concat('src/', id % 2, '.ts') AS file_path")
    rows = spark.range(100).selectExpr("concat('g', id) AS id", "'' AS node_id", "CASE WHEN id = 0 THEN 'src/0.ts' ELSE '' END AS file_path", "'src/*.ts' AS file_glob")
    got = gold.targets(rows, nodes)
    assert got.count() == got.distinct().count() == 99 * 400 + 200
    in_tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(in_tasks) >= 4 and max(in_tasks) < 0.6 * sum(in_tasks)
