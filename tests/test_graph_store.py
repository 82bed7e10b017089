"""The store: upserts, cleared repositories, failed writes, compaction, and what a look-up reads."""

from __future__ import annotations

import pytest

from weft.operators import integrity
from weft.sources.graph_store import BUCKETS, GraphStore

NODE = "node_id string, layer string, label string"
EDGE = "source_id string, target_id string, edge_type string, provenance string"


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "Adaptive" in plan.getClass().getName():
        plan = plan.executedPlan()

    def scans(p):
        name = p.getClass().getSimpleName()
        if "QueryStage" in name:
            yield from scans(p.plan())
        elif name == "FileSourceScanExec":
            yield p
        children = p.children()
        for i in range(children.size()):
            yield from scans(children.apply(i))

    return sum(s.metrics().apply("numFiles").value() for s in scans(plan))


def tables(spark, n, label="x"):
    nodes = [("project:r", "project", "r"), ("f", "file", "f"), *((f"c{i}", "code", f"{label}{i}") for i in range(n))]
    edges = [("f", f"c{i}", "CONTAINS", None) for i in range(n)] + [("c0", "c1", "CALLS", "scip"), ("c0", "module:z", "IMPORTS_MODULE", None), ("c0", "c1", "CALLS", "scip")]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame([("c0", "Money", 0.5), ("c1", "View", 0.7)], "node_id string, primary_block string, confidence double")


def code(store, repo=None):
    return {(r.repo_name, r.node_id, r.label) for r in store.read("code", repo).collect()}


def test_repositories_are_replaced_and_deleted(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"))
    assert store.read("code").count() == 0 and store.commits() == []
    store.load("a", *tables(spark, 4))
    store.load("b", *tables(spark, 2))
    store.load("a", *tables(spark, 2, "y"))
    assert code(store) == {("a", "c0", "y0"), ("a", "c1", "y1"), ("b", "c0", "x0"), ("b", "c1", "x1")} and code(store, "b") == {("b", "c0", "x0"), ("b", "c1", "x1")}
    assert {(r.target_id, r.provenance) for r in store.read("edges", "a").collect()} == {("c0", "structural"), ("c1", "structural"), ("c1", "scip"), ("module:z", "structural")}
    assert store.read("edges", "a").count() == 4 and [r.package_ref for r in store.read("modules", "b").collect()] == ["module:z"] and {r.label for r in store.blocks().collect()} == {"Money", "View"}
    store.load("b", *tables(spark, 3, "z"), clear=False)
    store.delete("code", spark.createDataFrame([("b", "c0"), ("a", "none")], "repo_name string, node_id string"))
    store.clear("a")
    assert code(store) == {("b", "c1", "z1"), ("b", "c2", "z2")} and store.read("projects", "a").count() == 0
    before = {name: store.read(name) for name in ("code", "edges", "assignments", "files")}
    before = {name: integrity.fingerprint(df).first() for name, df in before.items()}
    store.compact()
    assert {name: integrity.fingerprint(store.read(name)).first() for name in before} == before and len(store.commits()) == 1
    store.vacuum()
    assert {name: integrity.fingerprint(store.read(name)).first() for name in before} == before
    assert len(list((tmp_path / "s" / "code").glob("seq=*"))) == 1 and len(list((tmp_path / "s" / "_commits").glob("[0-9]*.json"))) == 1
    store.load("a", *tables(spark, 1, "n"))
    assert code(store, "a") == {("a", "c0", "n0")}


def test_failed_writes_are_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, str(tmp_path / "s"))
    store.load("a", *tables(spark, 2))
    real = GraphStore._at
    monkeypatch.setattr(GraphStore, "_at", lambda self, path: (_ for _ in ()).throw(RuntimeError("lost")) if path == "_commits/000000000001.json" else real(self, path))
    with pytest.raises(RuntimeError, match="lost"):
        store.load("a", *tables(spark, 5, "half"))
    monkeypatch.setattr(GraphStore, "_at", real)
    assert code(store) == {("a", "c0", "x0"), ("a", "c1", "x1")}
    store.load("a", *tables(spark, 3, "whole"))
    assert code(store) == {("a", f"c{i}", f"whole{i}") for i in range(3)}
    with pytest.raises(Exception, match="(?i)exist"):  # another writer took the number
        files, at = store._at("_commits/000000000001.json")
        files.create(at, False)


def test_lookups_read_one_bucket(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"))
    store.load("a", *tables(spark, 400))
    store.load("b", *tables(spark, 400))
    store.compact()
    every = files_read(store.read("code"))
    assert every == 2 * BUCKETS and files_read(store.lookup("c7")) == 2 and files_read(store.lookup("c7", "a")) == 1
    assert [(r.repo_name, r.label) for r in store.lookup("c7", "a").collect()] == [("a", "x7")]
    assert {(r.source_id, r.target_id) for r in store.incident("c1", "a").collect()} == {("f", "c1"), ("c0", "c1")}
    assert files_read(store.read("edges", "a", "c0")) == 1


def test_history_is_replaced(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"))
    snaps = lambda *s: spark.createDataFrame([(x, 3) for x in s], "commit_sha string, file_count int")
    diffs = spark.createDataFrame([("s1", "s2", 4)], "before_sha string, after_sha string, changes int")
    summary = spark.createDataFrame([("s2", 0.5)], "commit_sha string, churn double")
    store.load("r", *tables(spark, 1))
    store.persist_history("r", snaps("s1", "s2"), diffs, summary)
    store.persist_history("q", snaps("s1"), diffs.limit(0), summary)
    store.persist_history("r", snaps("s2"), diffs, summary)
    got = {(r.repo_name, r.record_kind, r.commit_sha) for r in store.read("temporal").collect()}
    assert got == {("r", "snapshot", "s2"), ("r", "diff", "s2"), ("r", "summary", "s2"), ("q", "snapshot", "s1"), ("q", "summary", "s2")}
    assert code(store) == {("r", "c0", "x0")}
    assert '"file_count":3' in store.read("temporal", "r").where("record_kind = 'snapshot'").first().figures
