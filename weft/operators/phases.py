"""Metrics of a project by phase, one row a metric, and which phases lack what they need.

Each function takes the tables of its phase, or None where there are none, which blocks the phase. Phases 5, 6
and 8 of the numbering count source files of tools and aren't data, so they aren't here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.ids import ratio
from weft.operators import gold, integrity, temporal

#: Kinds of nodes that a symbol index may identify (fixed values).
ELIGIBLE = ("function", "class", "interface", "method", "variable", "react_hook", "config_object", "middleware", "service_boundary")
#: What each phase needs (fixed values).
NEEDS = {"phase_0": "symbol index", "phase_2": "symbol index", "phase_3": "graph store", "phase_4": "assignments", "phase_7": "gold rows", "phase_9": "history"}


def _metrics(df: DataFrame, phase: str, **values: Column) -> DataFrame:
    """df (one row) as (phase_id, metric_id, value)."""
    each = F.array(*(F.struct(F.lit(phase).alias("phase_id"), F.lit(m).alias("metric_id"), v.cast("double").alias("value")) for m, v in values.items()))
    return df.select(F.inline(each))


def _one(*parts: DataFrame) -> DataFrame:
    """Several tables of one row as one row."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)


def _blocked(df: DataFrame, phase: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(phase, f"blocked by: {NEEDS[phase]}", None)], "phase_id string, metric_id string, value double")


def identity(nodes: DataFrame, edges: DataFrame, orphans: DataFrame | None, definitions: DataFrame | None) -> DataFrame:
    """nodes: node_id, kind, symbol_source, original_id, of code. orphans: addressable. definitions: a row for each."""
    if orphans is None or definitions is None:
        return _blocked(nodes, "phase_0")
    own = nodes.where("symbol_source <> 'file_surface'")
    eligible = F.col("kind").isin(*ELIGIBLE)
    counts = own.agg(F.count(F.lit(1)).alias("total"), F.count_if(eligible).alias("eligible"), F.count_if(eligible & (F.col("symbol_source") == "scip")).alias("known"))
    lost = orphans.agg(F.count(F.lit(1)).alias("raw"), F.count_if("addressable").alias("lost"))
    renamed = nodes.where("original_id IS NOT NULL AND original_id <> node_id").select(F.col("original_id").alias("target_id")).distinct()
    stale = edges.join(renamed, "target_id", "left_semi").agg(F.count(F.lit(1)).alias("stale"))
    row = _one(counts, lost, stale, definitions.agg(F.count(F.lit(1)).alias("n")))
    known, lost_, raw = F.col("known"), F.col("lost"), F.col("raw")
    every = F.when(F.col("n") > 0, F.col("n")).otherwise(known + raw)
    return _metrics(
        row, "phase_0", resolved_symbol_rate=ratio(known, F.col("eligible")), orphaned_symbol_rate=ratio(lost_, known + lost_), raw_orphaned_symbol_rate=ratio(raw, every), stale_provisional_target_count=F.col("stale"),
        total_code_nodes=F.col("total"), scip_eligible_code_nodes=F.col("eligible"), nodes_with_scip_identity=known, orphaned_symbol_count=lost_, raw_orphaned_symbol_count=raw, addressable_symbol_total=known + lost_,
    )


def structure(nodes: DataFrame, edges: DataFrame, neighborhoods: DataFrame) -> DataFrame:
    """nodes: node_id, kind, of code; neighborhoods: node_id."""
    code = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("kinds"))
    kind = F.col("edge_type")
    counts = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(kind.isin("DEPENDS_ON_FILE", "DEPENDS_ON", "IMPORTS_MODULE")).alias("depends"), F.count_if(kind == "DEPENDS_ON_FILE").alias("across"))
    near = neighborhoods.agg(F.count_distinct("node_id").alias("near"))
    return _metrics(
        _one(code, counts, near), "phase_1", node_kind_diversity=F.col("kinds"), neighborhood_coverage_rate=ratio(F.col("near"), F.col("n")), dependency_edge_count=F.col("depends"),
        cross_file_dependency_count=F.col("across"), edges_per_code_node=ratio(F.col("edges"), F.col("n")),
    )


def references(nodes: DataFrame, edges: DataFrame | None) -> DataFrame:
    """edges: edge_type, provenance, after an index was consumed."""
    if edges is None:
        return _blocked(nodes, "phase_2")
    by = F.col("provenance")
    eligible = F.col("kind").isin(*ELIGIBLE)
    known = nodes.agg(F.count_if(eligible).alias("eligible"), F.count_if(eligible & (F.col("symbol_source") == "scip")).alias("known"))
    counts = edges.agg(
        F.count_if(F.col("edge_type") == "DEFINES").alias("defines"), F.count_if(F.col("edge_type").isin("REFERENCES", "CROSS_REFERENCE")).alias("refers"), F.count_if(by == "scip_cross_repo").alias("across"),
        F.count_if(by == "scip_file_fallback").alias("loose"), F.count_if(by.isin("scip_reference_code", "scip_cross_repo")).alias("tight"),
    )
    return _metrics(
        _one(known, counts), "phase_2", resolved_symbol_rate=ratio(F.col("known"), F.col("eligible")), defines_edge_count=F.col("defines"), reference_edge_count=F.col("refers"), cross_repo_reference_count=F.col("across"),
        file_fallback_reference_rate=ratio(F.col("loose"), F.col("loose") + F.col("tight")),
    )


def storage(written: tuple[DataFrame, DataFrame], stored: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """(code, edges) as they were written and as they are read back."""
    if stored is None:
        return _blocked(written[0], "phase_3")
    same = [integrity.same_rows(a.select(b.columns), b).select(F.col("same").alias(f"same_{i}"), F.col("n_right").alias(f"n_{i}")) for i, (a, b) in enumerate(zip(written, stored, strict=True))]
    return _metrics(_one(*same), "phase_3", verify_pass=(F.col("same_0") & F.col("same_1")), code_rows=F.col("n_0"), edge_rows=F.col("n_1"))


def semantics(nodes: DataFrame, assignments: DataFrame | None, summaries: DataFrame | None = None, entities: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """assignments: primary_block, confidence."""
    if assignments is None:
        return _blocked(nodes, "phase_4")
    own = assignments.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.coalesce("confidence", F.lit(0.0))), F.lit(0.0)).alias("confidence"), F.count_distinct(F.when(F.col("primary_block") != "", F.col("primary_block"))).alias("blocks"))
    some = {"summaries": summaries, "entities": entities, "actions": actions}
    counts = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in some.items() if df is not None]
    n = lambda name: F.lit(0) if some[name] is None else F.col(name)
    row = _one(own, nodes.agg(F.count(F.lit(1)).alias("code")), *counts)
    return _metrics(
        row, "phase_4", assignment_coverage_rate=ratio(F.col("n"), F.col("code")), average_assignment_confidence=F.col("confidence"), unique_block_count=F.col("blocks"),
        semantic_summary_count=n("summaries"), entity_count=n("entities"), action_count=n("actions"),
    )


def evaluation(nodes: DataFrame, assignments: DataFrame, rows: DataFrame | None) -> DataFrame:
    """rows: gold rows."""
    if rows is None:
        return _blocked(nodes, "phase_7")
    report = gold.benchmark_report(gold.benchmark(rows, nodes, assignments))
    return _metrics(report, "phase_7", gold_example_count=F.col("total"), benchmark_accuracy=F.col("accuracy"), missing_node_rate=F.col("missing_rate"))


def history(nodes: DataFrame, changes: DataFrame | None) -> DataFrame:
    """changes: repo, day, path, block."""
    if changes is None:
        return _blocked(nodes, "phase_9")
    snaps = temporal.snapshots(changes)
    diffs = temporal.diff(snaps)
    pairs = temporal.day_pairs(snaps).agg(F.count(F.lit(1)).alias("pairs"))
    days = snaps.agg(F.count_distinct("repo", "day").alias("days"), F.count_distinct("block").alias("blocks"), F.count_distinct("repo", "path").alias("paths"))
    drift = diffs.agg(F.count_distinct("repo", "before", "after").alias("full"), F.count(F.lit(1)).alias("files"), F.count_if(F.col("before_blocks") != F.col("after_blocks")).alias("drifted"))
    index = temporal.success_index(diffs).agg(F.count_distinct("block").alias("indexed"))
    again = integrity.same_rows(temporal.temporal_metrics(diffs), temporal.temporal_metrics(temporal.diff(temporal.snapshots(changes)))).select("same")
    return _metrics(
        _one(days, pairs, drift, index, again), "phase_9", commit_count=F.col("days"), architecture_snapshot_count=F.col("days"), architecture_diff_count=F.col("pairs"), non_empty_diff_count=F.col("full"),
        tracked_block_count=F.col("blocks"), file_hotspot_count=F.col("paths"), drift_candidate_count=F.col("drifted"), architectural_drift_candidate_rate=ratio(F.col("drifted"), F.col("files")),
        pattern_success_index_block_count=F.col("indexed"), metrics_reproducible=F.col("same"),
    )


def report(*phases: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, phases)


def availability(metrics: DataFrame) -> DataFrame:
    """(phase_id, availability): blocked if a phase has no value."""
    return metrics.groupBy("phase_id").agg(F.when(F.count("value") > 0, "available").otherwise("blocked").alias("availability"))
