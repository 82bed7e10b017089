"""The graph store: Parquet tables partitioned by repository, replaced one repository at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.ids import record_id
from weft.operators.graph import last_written

#: Tables and the columns that key their rows.
KEYS = {
    "nodes": ["repo_name", "node_id"],
    "edges": ["repo_name", "source_id", "target_id", "edge_type"],
    "assignments": ["repo_name", "node_id", "block"],
}


def upsert(rows: DataFrame, root: str, name: str) -> None:
    """Replaces the repositories that rows hold, the last row of a key winning (by write_ord; without it
    by a hash of the row, so that reruns agree), in one job; other repositories' partitions stay."""
    ordered = rows if "write_ord" in rows.columns else rows.withColumn("write_ord", F.xxhash64(*rows.columns))
    keyed = last_written(ordered, KEYS[name], "write_ord").withColumn("record_id", record_id(*KEYS[name]))
    if "provenance" in keyed.columns:
        keyed = keyed.withColumn("provenance", F.coalesce("provenance", F.lit("structural")))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_name").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str, repo: str | None = None) -> DataFrame:
    table = spark.read.parquet(f"{root}/{name}")
    return table if repo is None else table.where(F.col("repo_name") == repo)  # prunes partitions


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, repo_name, n) of every table; compared with what was to be written, it verifies a store."""
    each = [df.groupBy("repo_name").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "repo_name", "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def stored_counts(spark: SparkSession, root: str) -> DataFrame:
    return counts({name: spark.read.parquet(f"{root}/{name}") for name in KEYS})


def modules(edges: DataFrame) -> DataFrame:
    """(node_id): the distinct external modules that edges import, which a store keeps as nodes."""
    return edges.where("edge_type = 'IMPORTS_MODULE' AND target_id LIKE 'module:%'").select(F.col("target_id").alias("node_id")).distinct()


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON, blank ones skipped."""
    return spark.read.schema(schema).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole-file JSON document, or no rows where the file is missing."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
