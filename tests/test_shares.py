"""Work that is done once, and shares that don't grow with the table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from weft.operators import canonical
from weft.plans import adapters
from weft.sources import files, scip_index


def test_a_scan_has_few_tasks_and_reads_every_range(spark, tmp_path):
    doc = lambda i: {"relative_path": f"p{i}", "language": "go", "text": "x", "encoding": "UTF8", "occurrences": [], "symbols": [{"symbol": f"s{i}", "display_name": "n", "kind": "Class", "documentation": [], "relationships": []}]}
    n = 3 * scip_index.TASKS + 1
    (tmp_path / "x.scip").write_bytes(b"".join(scip_index.encoded(doc(i)) for i in range(n)))
    from pyspark.sql.types import StructType

    reader = scip_index._Reader("symbols", StructType.fromDDL(scip_index.TABLES["symbols"]), str(tmp_path), 1)
    found = reader.partitions()
    assert len(found) <= scip_index.TASKS and sum(len(s.ranges) for s in found) == n
    assert [s for p in found for b in reader.read(p) for s in b.column("symbol").to_pylist()] == [f"s{i}" for i in range(n)]


def test_a_writer_holds_few_documents_as_objects(tmp_path, monkeypatch):
    import pyspark

    sizes = []
    monkeypatch.setattr(scip_index, "encoded", lambda row: sizes.append(row) or b"")
    batch = pa.RecordBatch.from_pylist([{"relative_path": str(i)} for i in range(100)])

    class Batch:
        num_rows = batch.num_rows

        def to_pylist(self):
            raise AssertionError("a whole batch as objects")

        def slice(self, i, n):
            assert n <= scip_index.HELD
            return batch.slice(i, n)

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("C", (), {"partitionId": lambda s: 1, "taskAttemptId": lambda s: 1})()))
    scip_index._Writer(str(tmp_path / "out"), {}, False).write(iter([Batch()]))
    assert [r["relative_path"] for r in sizes] == [str(i) for i in range(100)]


def test_edges_of_sources_scan_texts_once(spark):
    some = spark.createDataFrame([("r", "a.py", "python", "import os\ndef f(): pass\n"), ("r", "b.config.ts", "typescript", "// config\nexport default {}")], "repo_name string, path string, language string, content string")
    nodes, edges = files.ingest(some)
    assert "MapInArrow" not in edges._jdf.queryExecution().optimizedPlan().toString()  # the one scan is done
    assert nodes._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    held = {r.target_id for r in edges.where("edge_type = 'CONTAINS'").collect()}
    assert {r.node_id for r in nodes.collect()} <= held and any("config_object" in x for x in held)
    assert [r.target_id for r in edges.where("edge_type = 'IMPORTS_MODULE'").collect()] == ["module:os"]


def test_weak_edges_work_nodes_out_once(spark):
    node = lambda df: df.select(F.col("id").cast("string").alias("node_id"), *(F.lit("x").alias(c) for c in canonical.NODE[1:]))
    edge = lambda df, kind: df.select(F.lit("0").alias("source_id"), F.col("id").cast("string").alias("target_id"), kind.alias("edge_type"), *(F.lit("x").alias(c) for c in canonical.EDGE[3:]))
    kind = F.when(F.col("id") % 2 == 0, "SUMMARIZES").otherwise("CALLS")
    made = [(node(spark.range(0, 7)), edge(spark.range(0, 11), kind)), (node(spark.range(3, 8)), edge(spark.range(5, 12), kind))]
    nodes, edges = canonical.canonical(made)
    assert sorted(int(r.target_id) for r in edges.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 11]
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 7") == 1
    assert canonical.summary(nodes, edges).first().asDict() == {"node_count": 8, "layers": "x", "edge_count": 10, "dangling_edge_count": 2, "external_edge_count": 0}


def test_lines_are_dealt_out_by_their_number(spark, monkeypatch):
    from weft import session

    monkeypatch.setattr(session, "ROWS", 100)
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert session.parts(rows, spark) == -(-rows // 100)
    assert "hashpartitioning(l_orderkey#" in (plan := adapters.edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()) and f", {-(-rows // 100)})" in plan
