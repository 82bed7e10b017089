"""Fingerprints of tables, checks of a graph's integrity, and gates of its history.

A fingerprint is a digest of a table as a bag of rows: its count, two sums of independent row hashes and
an exclusive-or of both. It doesn't depend on order or partitions, is added up within tasks first, and
can be taken for every group, so two runs, or a store and its source, are compared by a few numbers for each
instead of a shuffle of all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators import graph

#: Layers whose nodes are derived from others, and prefixes of symbols that edges may leave the graph for
#: (fixed values).
DERIVED = ("semantic", "scip", "test", "openapi", "infra", "temporal", "regret")
EXTERNAL = ("scip-typescript npm ", "local ")
#: Precision and recall that drift detection needs (fixed value).
DRIFT = 0.85


def _cell(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    return F.array_sort(F.map_entries(column)) if isinstance(field.dataType, T.MapType) else column


def fingerprint(df: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """(*by, n, one, two, mixed): the digest of each group's rows (of all, if ``by`` is empty). Columns count by
    name, in order of name; nulls count as such."""
    fields = sorted((f for f in df.schema if f.name not in by), key=lambda f: f.name)
    cells = [_cell(f) for f in fields]
    missing = [c.isNull() for c in cells]
    one = F.xxhash64(F.lit(1), *cells, *missing)
    two = F.xxhash64(F.lit(2), *missing, *reversed(cells))
    hashed = df.select(*by, one.alias("a"), two.alias("b"))
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
    return hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), total("a").alias("one"), total("b").alias("two"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("mixed"))


def same_rows(left: DataFrame, right: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """(*by, n_left, n_right, same): whether two tables hold the same bag of rows, group by group."""
    digest = F.struct("n", "one", "two", "mixed")
    sides = [fingerprint(df, by).select(*by, F.lit(side).alias("side"), digest.alias("digest")) for side, df in (("left", left), ("right", right))]
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("digest"))).alias(side)
    met = sides[0].unionByName(sides[1]).groupBy(*by).agg(of("left"), of("right"))  # a group may be null
    return met.select(*by, F.coalesce("left.n", F.lit(0)).alias("n_left"), F.coalesce("right.n", F.lit(0)).alias("n_right"), F.col("left").eqNullSafe(F.col("right")).alias("same"))


def history_gates(first: DataFrame, again: DataFrame, observed: DataFrame | None = None, expected: DataFrame | None = None, drifted: DataFrame | None = None) -> DataFrame:
    """(gate_id, status): whether two runs of the metrics are equal; whether every expected change (any columns)
    is observed; and whether precision and recall (one row of each) of drift are high enough. A gate
    that isn't given what it needs is blocked."""
    spark = first.sparkSession
    gate = lambda df, name, passed: df.select(F.lit(name).alias("gate_id"), F.when(passed, "pass").otherwise("fail").alias("status"))
    blocked = lambda name: spark.createDataFrame([(name, "blocked")], "gate_id string, status string")
    out = [gate(same_rows(first, again), "temporal_gate_metrics_reproducible", F.col("same"))]
    if observed is None or expected is None:
        out.append(blocked("temporal_gate_known_changes"))
    else:
        lost = expected.distinct().join(observed.distinct(), expected.columns, "left_anti").agg(F.count(F.lit(1)).alias("n"))
        out.append(gate(lost, "temporal_gate_known_changes", F.col("n") == 0))
    if drifted is None:
        out.append(blocked("temporal_gate_drift_detection"))
    else:
        out.append(gate(drifted, "temporal_gate_drift_detection", (F.col("precision") >= DRIFT) & (F.col("recall") >= DRIFT)))
    return reduce(DataFrame.unionByName, out)


def gates_summary(gates: DataFrame) -> DataFrame:
    """One row: gate_count, failed, blocked, overall_status."""
    out = gates.agg(F.count(F.lit(1)).alias("gate_count"), F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "blocked").alias("blocked"))
    return out.withColumn("overall_status", F.when(F.col("blocked") > 0, "blocked").when(F.col("failed") > 0, "fail").otherwise("pass"))


def leaving(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (source_id, target_id, edge_type) with an end (side) that isn't a node, and whether it may be: modules
    that are imported, and symbols of other packages or of a function, as targets."""
    known = nodes.select(F.col("node_id").alias("end")).distinct()
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("end")) for s in ("source", "target")))
    open_ = edges.select("source_id", "target_id", "edge_type", F.inline(sides)).join(known, "end", "left_anti")
    module = (F.col("edge_type") == "IMPORTS_MODULE") & F.col("end").startswith("module:")
    symbol = F.col("edge_type").isin("REFERENCES", "IMPLEMENTS") & reduce(Column.__or__, (F.col("end").startswith(p) for p in EXTERNAL))
    return open_.withColumn("external", (F.col("side") == "target") & (module | symbol))


def _row(df: DataFrame, layer: str, check: str, worst: str = "fail") -> DataFrame:
    """A check that passes if df has no rows; detail: how many it has."""
    n = F.col("detail")
    return df.agg(F.count(F.lit(1)).alias("detail")).select(F.lit(layer).alias("layer"), F.lit(check).alias("check_id"), F.when(n == 0, "pass").otherwise(worst).alias("status"), n)


def structural_checks(nodes: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """nodes: node_id, layer (project, file or code), file_path."""
    open_ = leaving(edges, nodes).where("NOT external")
    leaked = edges.where(F.col("source_id").startswith("provisional://") | F.col("target_id").startswith("provisional://"))
    files = nodes.where("layer = 'file'").select("file_path").distinct()
    lost = nodes.where("layer = 'code' AND file_path IS NOT NULL").select("file_path").distinct().join(files, "file_path", "left_anti")
    return [
        _row(open_.select("source_id", "target_id", "edge_type").distinct(), "structural", "no_dangling_edges"), _row(leaked, "structural", "no_provisional_edge_leakage"),
        _row(lost, "structural", "code_files_materialized"), _row(graph.missing_containment(nodes, edges), "structural", "code_is_contained"),
    ]


def canonical_checks(nodes: DataFrame, edges: DataFrame, reloaded: tuple[DataFrame, DataFrame] | None = None) -> list[DataFrame]:
    """nodes: node_id, layer; edges: source_id, target_id, edge_type, provenance. reloaded: both as they are read
    back from where they were written."""
    repeated = nodes.groupBy("node_id").count().where("count > 1").select("node_id")
    unstable = nodes.where("coalesce(lower(node_id), '') IN ('', 'none', 'null')").select("node_id")
    apart = nodes.where(F.col("layer").isin(*DERIVED)).join(graph.connected_to_known(nodes, edges).select("node_id"), "node_id", "left_anti")
    dangling = leaving(edges, nodes).where("NOT external")
    out = [
        _row(dangling, "canonical", "canonical_graph_no_dangling_targets"), _row(edges.where("provenance IS NULL"), "canonical", "canonical_graph_all_edges_have_provenance"),
        _row(repeated.unionByName(unstable), "canonical", "canonical_graph_stable_node_ids"), _row(apart, "canonical", "canonical_graph_derived_nodes_link_to_evidence"),
    ]
    if reloaded is not None:
        lost = same_rows(nodes, reloaded[0]).unionByName(same_rows(edges, reloaded[1])).where("NOT same")
        out.append(_row(lost, "canonical", "canonical_graph_reloads_without_loss"))
    return out


def index_checks(resolution: DataFrame | None, has_index: bool = True, has_metadata: bool = True) -> list[DataFrame]:
    """resolution: one row of resolved and total code nodes, of an index that was consumed; None: there is none."""
    if resolution is None:
        return []
    one = resolution.select(F.lit(1).alias("x"))
    return [
        _row(one.where(F.lit(has_index and not has_metadata)), "scip", "scip_binary_has_metadata"), _row(one.where(F.lit(not has_index)), "scip", "scip_consumed_has_index"),
        _row(resolution.where("resolved > total"), "scip", "scip_resolution_counts_bounded", "warn"),
    ]


def semantic_checks(nodes: DataFrame, assignments: DataFrame | None) -> list[DataFrame]:
    if assignments is None:
        return []
    lost = assignments.join(nodes.select("node_id").distinct(), "node_id", "left_anti")
    some = assignments.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return [_row(lost, "semantic", "semantic_assignments_target_graph_nodes"), _row(some, "semantic", "semantic_assignments_nonempty")]


def manifest_checks(listed: DataFrame | None, present: DataFrame | None = None) -> list[DataFrame]:
    """listed, present: path, sha256, as a manifest has them and as they are."""
    if listed is None or present is None:
        return []
    met = listed.select("path", F.col("sha256").alias("was")).join(present.select("path", F.col("sha256").alias("now")), "path", "left")
    return [_row(met.where("now IS NULL"), "manifest", "manifest_files_exist"), _row(met.where("now IS NOT NULL AND coalesce(was, '') <> '' AND was <> now"), "manifest", "manifest_hashes_current")]


def integrity_report(parts: dict[str, list[DataFrame]]) -> DataFrame:
    """(layer, check_id, status, detail) of all layers; one that isn't there passes with a check of that name."""
    rows = [df for some in parts.values() for df in some]
    spark = rows[0].sparkSession
    absent = [(layer, f"{layer}_layer_optional", "pass", 0) for layer, some in parts.items() if not some]
    out = reduce(DataFrame.unionByName, rows)
    return out.unionByName(spark.createDataFrame(absent, "layer string, check_id string, status string, detail bigint")) if absent else out
