"""One pass from nodes to their meaning: assignments, entities, summaries of nodes, project and system, actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import classify, semantic

#: Sentences of a project and of the system (fixed values).
PROJECT = "Project %s represents repository %s. Its strongest observed responsibilities are %s. The summary is derived from %s code-node semantic summaries."
SYSTEM = "System %s currently contains %s project graph(s). It exposes cross-cutting architecture evidence through structural code nodes, semantic entities, project summaries, and action edges. %s"


@dataclass(frozen=True)
class Enriched:
    assignments: DataFrame
    entities: DataFrame
    summaries: DataFrame
    actions: DataFrame


def project_text(assignments: DataFrame, name: str, repo: str, top: int = 5) -> DataFrame:
    """One row (text): a project by its most frequent blocks."""
    counts = assignments.where("primary_block <> ''").groupBy("primary_block").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "primary_block").limit(top).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "primary_block"))), lambda x: x["primary_block"]), ", ").alias("blocks"))
    row = best.join(F.broadcast(assignments.agg(F.count(F.lit(1)).alias("total"))))  # one row each
    return row.select(F.format_string(PROJECT, F.lit(name), F.lit(repo), F.when(F.col("blocks") == "", "unclassified code").otherwise(F.col("blocks")), F.col("total").cast("string")).alias("text"))


def system_text(projects: DataFrame, name: str) -> DataFrame:
    """One row (text): a system by the texts of its projects (text), the first 500 characters of these."""
    every = projects.agg(F.count(F.lit(1)).alias("n"), F.substring(F.array_join(F.sort_array(F.collect_list("text")), " "), 1, 500).alias("all"))
    return every.select(F.format_string(SYSTEM, F.lit(name), F.col("n").cast("string"), F.col("all")).alias("text"))


def enrich(nodes: DataFrame, repo: str, name: str, project_id: str, neighborhoods: DataFrame | None = None, imports: DataFrame | None = None) -> Enriched:
    """Everything that is said of a repository's nodes (node_id, kind, label, file_path, content).

    neighborhoods: node_id, imports, imported_by, same_file (arrays). imports: node_id, target_id. Assignments are
    read several times: persist nodes, or write the assignments first, where that matters.
    """
    assigned = classify.classify_nodes(nodes, neighborhoods)
    found = semantic.entities(nodes, assigned, imports)
    if neighborhoods is None:
        near = nodes.select("node_id", F.lit(0).alias("n_imports"), F.lit(0).alias("n_siblings"))
    else:
        near = neighborhoods.select("node_id", F.size("imports").alias("n_imports"), F.size("same_file").alias("n_siblings"))
    row = lambda df, node, kind: df.select(node.alias("node_id"), F.lit(kind).alias("summary_type"), "text")
    own = semantic.summaries(nodes, assigned, near)
    project = project_text(assigned, name, repo)
    summaries = row(own, F.col("node_id"), "code_node").unionByName(row(project, F.lit(project_id), "project")).unionByName(row(system_text(project, repo), F.lit("system:local"), "system"))
    return Enriched(assigned, found, summaries, semantic.actions(nodes, assigned, found))


def candidates(nodes: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sure, starts): the first 25 nodes of a confidence of 0.7 or more by block and path, and the first 15 of all by
    kind and path."""
    rows = nodes.select("node_id", "label", "kind", "file_path").join(assignments.select("node_id", "primary_block", "confidence"), "node_id", "left")
    sure = rows.where("confidence >= 0.7").orderBy("primary_block", "file_path", "node_id").limit(25)
    return sure, rows.orderBy("kind", "file_path", "node_id").limit(15)
