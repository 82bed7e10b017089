"""Regrets: patterns of a project's texts that point to work put off, with a score and evidence.

nodes: node_id, label, file_path, content. assignments: node_id, primary_block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.classify import regret_score

#: Patterns: id, title, keywords, blocks that strengthen a hit, base score (fixed values).
PATTERNS = (
    ("scattered_auth", "Auth logic spread across many route files", ("auth", "session", "jwt", "bearer", "login"), ("Access Control",), 0.55),
    ("logging_inconsistency", "Multiple logging or telemetry entry styles", ("logger", "console.log", "pino", "winston", "telemetry"), ("System Telemetry",), 0.45),
    ("database_sprawl", "Database access scattered outside a small persistence layer", ("prisma", "drizzle", "sql", "query", "database", "supabase"), ("Data Persistence",), 0.5),
    ("fat_routes", "Route module may be doing too much (many handlers in one file)", ("routes", "router", "controller"), ("Traffic Control", "Network Edge"), 0.4),
)
#: Characters of a text that patterns read (their definition), nodes kept as evidence, and nodes of a file
#: from which on it is a dense route file.
READ, EVIDENCE, DENSE = 800, 40, 12


def pattern_regrets(nodes: DataFrame, assignments: DataFrame, least: float = 0.35) -> DataFrame:
    """(pattern_id, hits, n_nodes, n_files, align, score): patterns that reach the least score: keyword hits
    over all nodes, nodes and files with a hit, and the share of those nodes with one of the pattern's blocks."""
    rows = nodes.join(assignments.select("node_id", "primary_block"), "node_id", "left")
    low = F.lower(F.concat(F.coalesce("label", F.lit("")), F.lit("\n"), F.substring(F.coalesce("content", F.lit("")), 1, READ)))
    count = lambda words: sum((F.when(F.col("low").contains(w), 1).otherwise(0) for w in words), F.lit(0))
    own = lambda blocks: F.coalesce(F.col("primary_block").isin(*blocks), F.lit(False))
    each = F.array(*(F.struct(F.lit(p).alias("pattern_id"), F.lit(base).alias("base"), count(words).alias("n"), own(blocks).alias("own")) for p, _, words, blocks, base in PATTERNS))
    hit = rows.withColumn("low", low).select("node_id", "file_path", F.inline(each)).where("n > 0")
    out = hit.groupBy("pattern_id", "base").agg(F.sum("n").alias("hits"), F.count_distinct("node_id").alias("n_nodes"), F.count_distinct("file_path").alias("n_files"), F.avg(F.when(F.col("own"), 1.0).otherwise(0.0)).alias("align"))
    score = regret_score(F.col("base"), F.col("hits"), F.col("align"), F.col("n_files"))
    return out.select("pattern_id", "hits", "n_nodes", "n_files", "align", score.alias("score")).where(F.col("score") >= least)


def dense_routes(nodes: DataFrame, least: int = DENSE) -> DataFrame:
    """(file_path, n, score): route files with ``least`` nodes or more."""
    counts = nodes.where(F.lower("file_path").contains("route")).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least).select("file_path", "n", F.least(F.lit(0.85), 0.35 + F.col("n") / 40.0).alias("score"))


def with_plans(found: DataFrame, plans: DataFrame) -> DataFrame:
    """found with the plan of its pattern (pattern_id, plan), null where there is none."""
    return found.join(plans, "pattern_id", "left")
