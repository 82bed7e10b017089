"""Simulation of a change: seeds from the words of its description, reach over the causal overlay."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import evaluation, graph

#: Phrases that count as words of a change wherever they stand, and words that point to blocks (fixed values).
PHRASES = ("auth", "database", "route", "api", "middleware", "logger", "prisma", "supabase")
TOKEN_BLOCKS = (
    (("auth", "jwt", "session", "login", "bearer", "oauth"), ("Access Control",)),
    (("database", "prisma", "drizzle", "sql", "persist", "repository"), ("Data Persistence",)),
    (("route", "router", "api", "handler", "middleware", "endpoint"), ("Traffic Control", "Network Edge")),
    (("log", "telemetry", "metric", "trace"), ("System Telemetry",)),
    (("render", "react", "ui", "component"), ("Core Rendering",)),
)


def change_tokens(text: str) -> list[str]:
    """Identifiers of three characters or more, and the phrases that the description holds."""
    low = text.lower()
    return sorted({w for w in re.findall(r"[a-zA-Z_][a-zA-Z0-9_]*", low) if len(w) >= 3} | {p for p in PHRASES if p in low})


def change_blocks(tokens: list[str]) -> list[str]:
    joined = " ".join(tokens).lower()
    return sorted({b for words, blocks in TOKEN_BLOCKS if any(w in joined for w in words) for b in blocks})


def seeds(nodes: DataFrame, assignments: DataFrame, hot_files: DataFrame, edges: DataFrame, change: str, most: int = 6) -> DataFrame:
    """(node_id, score): the nodes that a change most likely starts from; the nodes of highest degree,
    with score 0, if its words touch none. hot_files: file_path, a few rows.

    1.6 for each word in a node's label or path, 1.0 for a hot file, 2.4 for a block that the words
    point to; ties by node_id.
    """
    tokens, blocks = change_tokens(change), change_blocks(change_tokens(change))
    text = F.lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("file_path", F.lit(""))))
    hits = sum((F.when(text.contains(t), 1).otherwise(0) for t in tokens), F.lit(0))
    rows = nodes.join(assignments.select("node_id", F.col("primary_block").alias("b")), "node_id", "left")
    rows = rows.join(hot_files.select("file_path", F.lit(1).alias("hot")).distinct(), "file_path", "left")
    score = hits * 1.6 + F.when(F.col("hot") == 1, 1.0).otherwise(0.0) + F.when(F.col("b").isin(*blocks) if blocks else F.lit(False), 2.4).otherwise(0.0)
    best = rows.select("node_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "node_id").limit(most)
    if not best.isEmpty():
        return best
    by_degree = nodes.select("node_id").join(graph.degrees(edges), "node_id", "left").orderBy(F.coalesce("degree", F.lit(0)).desc(), "node_id").limit(most)
    return by_degree.select("node_id", F.lit(0.0).alias("score"))


def adjusted_confidence(raw: Column, bias: Column, brier: Column) -> Column:
    """A confidence less its learned bias and what a bad Brier score takes, within 0.02 and 0.98."""
    shrink = F.when(brier.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.15), brier - 0.1)))
    return F.greatest(F.lit(0.02), F.least(F.lit(0.98), raw - bias - shrink))


def simulate(nodes: DataFrame, weighted: DataFrame, starts: DataFrame, runs: int = 64, depth: int = 8, seed: int = 42, bias: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(impacted, statistics) of a change at starts (node_id).

    impacted: node_id, file_path, hits (runs that reach it), of code nodes. statistics: one row with mean and
    deviation of the nodes reached in a run, consistency, and confidence. weighted: source_id,
    target_id, weight. Both statistics come from the same runs.
    """
    bits = graph.monte_carlo_bits(weighted, starts.select("node_id"), runs, depth, seed)
    code = nodes.where("layer = 'code'").select("node_id", "file_path")
    impacted = bits.groupBy("node_id").agg(F.sum(F.bit_count("runs")).alias("hits")).join(code, "node_id")
    stats = evaluation.run_statistics(graph.run_sizes(bits).select("n"))
    n_code = code.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_code"))
    raw = F.least(F.lit(0.92), 0.15 + 0.45 * F.col("consistency") + 0.4 * F.least(F.lit(1.0), F.col("mean") / F.col("n_code")))
    stats = stats.join(F.broadcast(n_code)).withColumn("confidence", adjusted_confidence(raw, F.lit(bias), F.lit(None).cast("double"))).drop("n_code")
    return impacted, stats


def change(nodes: DataFrame, edges: DataFrame, assignments: DataFrame, hot_files: DataFrame, description: str, runs: int = 64, depth: int = 8, seed: int = 42, bias: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds, impacted, statistics) of a change by its description: the causal overlay of all edges with its words,
    the seeds that they point to, and reach from these. nodes: node_id, layer, label, file_path.
    assignments: node_id, primary_block. hot_files: file_path, a few rows."""
    blocks = assignments.select("node_id", F.col("primary_block").alias("block"))
    overlay = graph.causal_overlay(nodes, edges, hot_files, blocks, change_tokens(description))
    weighted = overlay.select("source_id", "target_id", "edge_type", F.col("adjusted_weight").alias("weight"))
    code = nodes.where("layer = 'code'")
    starts = seeds(code, assignments, hot_files, edges, description)
    impacted, stats = simulate(nodes, weighted, starts, runs, depth, seed, bias)
    return starts, impacted, stats
