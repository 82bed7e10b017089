"""The driver's tables as nodes, edges, texts, changes and labels of the engine, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import ids
from weft.session import parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def places(spark: SparkSession, d: str) -> DataFrame:
    """n_nationkey, repo_name, file_path of every nation."""
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", F.col("r_name").alias("repo_name"), ids.file_uri("r_name", "n_name").alias("file_path"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    place = places(spark, d)
    of = lambda df, key: df.join(place, F.col(key) == F.col("n_nationkey"))
    none = F.lit(None).cast("string")
    cols = lambda node, layer, kind, label, repo, path: [node.alias("node_id"), F.lit(layer).alias("layer"), kind.alias("kind"), label.alias("label"), repo.alias("repo_name"), path.alias("file_path")]
    made = [
        table(spark, d, "region").select(*cols(ids.project_id("r_name"), "project", F.lit("project"), F.col("r_name"), F.col("r_name"), none)),
        place.select(*cols(F.col("file_path"), "file", F.lit("file"), F.col("file_path"), F.col("repo_name"), F.col("file_path"))),
        of(table(spark, d, "customer"), "c_nationkey").select(*cols(_id("customer", "c_custkey"), "code", F.col("c_mktsegment"), F.col("c_name"), F.col("repo_name"), F.col("file_path"))),
        of(table(spark, d, "supplier"), "s_nationkey").select(*cols(_id("supplier", "s_suppkey"), "code", F.lit("supplier"), F.col("s_name"), F.col("repo_name"), F.col("file_path"))),
        table(spark, d, "part").select(*cols(_id("part", "p_partkey"), "code", F.col("p_type"), F.col("p_name"), none, none)),
        table(spark, d, "orders").select(*cols(_id("order", "o_orderkey"), "code", F.col("o_orderpriority"), F.col("o_orderstatus"), none, none)),
    ]
    out = made[0]
    for p in made[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    place = places(spark, d)
    line = table(spark, d, "lineitem")
    n = parts(line.count(), spark)  # what the footers say
    ends = lambda key: line.select("l_orderkey", key).repartition(n, "l_orderkey").distinct()
    cols = lambda s, t, kind: [s.alias("source_id"), t.alias("target_id"), F.lit(kind).alias("edge_type")]
    made = [
        place.select(*cols(ids.project_id("repo_name"), F.col("file_path"), "CONTAINS")),
        table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(*cols(F.col("file_path"), _id("customer", "c_custkey"), "CONTAINS")),
        table(spark, d, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(*cols(F.col("file_path"), _id("supplier", "s_suppkey"), "CONTAINS")),
        table(spark, d, "orders").select(*cols(_id("customer", "o_custkey"), _id("order", "o_orderkey"), "CALLS")),
        ends("l_partkey").select(*cols(_id("order", "l_orderkey"), _id("part", "l_partkey"), "REFERENCES")),
        ends("l_suppkey").select(*cols(_id("order", "l_orderkey"), _id("supplier", "l_suppkey"), "DEPENDS_ON")),
        table(spark, d, "part").select(*cols(_id("part", "p_partkey"), ids.module_spec("p_brand"), "IMPORTS_MODULE")),
    ]
    out = made[0]
    for p in made[1:]:
        out = out.unionByName(p)
    return out


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Events as changes: repo (of four), day (a commit), path (a user), block (the event's type)."""
    return table(spark, d, "events").select(F.concat(F.lit("repo_"), (F.col("user_id") % 4).cast("string")).alias("repo"), F.to_date("ts").cast("string").alias("day"), F.concat(F.lit("src/user_"), F.col("user_id").cast("string"), F.lit(".ts")).alias("path"), F.col("event_type").alias("block"), "event_id", "ts", "value", "user_id")


def assignments(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a block (their segment) and a confidence by balance, as a classifier's output."""
    c = table(spark, d, "customer")
    return c.select(_id("customer", "c_custkey").alias("node_id"), F.col("c_mktsegment").alias("block"), (F.least(F.greatest(F.col("c_acctbal"), F.lit(0.0)), F.lit(10000.0)) / 10000.0).alias("confidence"))


NODES_SQL = """places AS (
  SELECT n_nationkey, r_name AS repo_name, 'repo://' || r_name || '/' || n_name AS file_path FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'project:' || regexp_replace(r_name, '[^a-zA-Z0-9_.-]+', '_', 'g') AS node_id, 'project' AS layer, 'project' AS kind, r_name AS label, r_name AS repo_name, NULL AS file_path FROM region
  UNION ALL SELECT file_path, 'file', 'file', file_path, repo_name, file_path FROM places
  UNION ALL SELECT 'customer:' || c_custkey, 'code', c_mktsegment, c_name, repo_name, file_path FROM customer JOIN places ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'code', 'supplier', s_name, repo_name, file_path FROM supplier JOIN places ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, 'code', p_type, p_name, NULL, NULL FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'code', o_orderpriority, o_orderstatus, NULL, NULL FROM orders)"""
EDGES_SQL = """edges AS (
  SELECT 'project:' || regexp_replace(repo_name, '[^a-zA-Z0-9_.-]+', '_', 'g') AS source_id, file_path AS target_id, 'CONTAINS' AS edge_type FROM places
  UNION ALL SELECT file_path, 'customer:' || c_custkey, 'CONTAINS' FROM customer JOIN places ON c_nationkey = n_nationkey
  UNION ALL SELECT file_path, 'supplier:' || s_suppkey, 'CONTAINS' FROM supplier JOIN places ON s_nationkey = n_nationkey
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'CALLS' FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'REFERENCES' FROM lineitem
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'DEPENDS_ON' FROM lineitem
  UNION ALL SELECT 'part:' || p_partkey, 'module:' || split_part(p_brand, '/', 1), 'IMPORTS_MODULE' FROM part),
both_ways AS (SELECT source_id AS src, target_id AS dst, edge_type FROM edges UNION ALL SELECT target_id, source_id, edge_type FROM edges)"""
CHANGES_SQL = "changes AS (SELECT 'repo_' || user_id % 4 AS repo, strftime(ts, '%Y-%m-%d') AS day, 'src/user_' || user_id || '.ts' AS path, event_type AS block, event_id, ts, value, user_id FROM events)"
ASSIGN_SQL = "assign AS (SELECT 'customer:' || c_custkey AS node_id, c_mktsegment AS block, least(greatest(c_acctbal, 0.0), 10000.0) / 10000.0 AS confidence FROM customer)"


#: Sample paths and kinds that documents take in turn as nodes with texts, and words added to their texts.
PATHS = ("src/routes/r.ts", "lib/cache/c.ts", "src/utils/security.ts", "schema.prisma", "src/modules/user/index.ts", "emails/welcome.tsx", "workers/mail.ts", "config/env.ts", "src/auth.test.ts", "services/pay.ts", "README.ts", "src/db.ts", "tests/store.ts")
KINDS = ("function", "route_handler", "middleware", "db_model", "react_hook", "config_object", "service_boundary", "file_surface")
WORDS = ("", "import a export b import c", "jwt session role", "prisma query", "route request endpoint", "logger metric", "secret token hash", "queue worker cron", "render component", "user profile login", "retry fallback")
ASSIGNED = ("Access Control", "Data Persistence", "Network Edge", "System Telemetry", "Security Ops", "Core Rendering")


def _turn(values: tuple[str, ...], i):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (i % len(values) + 1).cast("int"))


def text_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as nodes: node_id, kind, label, file_path, content."""
    i = F.col("doc_id")
    content = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _turn(WORDS, i))
    return table(spark, d, "documents").select(_id("doc", "doc_id").alias("node_id"), _turn(KINDS, i).alias("kind"), F.concat(F.lit("n"), i.cast("string")).alias("label"), F.concat((i % 40).cast("string"), F.lit("/"), _turn(PATHS, i)).alias("file_path"), content.alias("content"))


def text_assignments(spark: SparkSession, d: str) -> DataFrame:
    """A block, a confidence and perhaps a secondary block of every document."""
    i = F.col("doc_id")
    second = F.when(i % 2 == 0, F.array(F.struct(_turn(ASSIGNED, i * 7 + 1).alias("block"), ((i * 13 % 100) / 100.0).alias("confidence")))).otherwise(F.array().cast("array<struct<block:string,confidence:double>>"))
    return table(spark, d, "documents").select(_id("doc", "doc_id").alias("node_id"), _turn(ASSIGNED, i).alias("primary_block"), ((i * 37 % 100) / 100.0).alias("confidence"), F.lit("").alias("reasoning"), second.alias("secondary"))


def _turn_sql(values: tuple[str, ...], i: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({i} % {len(values)} + 1 AS INTEGER)]"


TEXT_SQL = f"""text_nodes AS (SELECT doc_id, 'doc:' || doc_id AS node_id, {_turn_sql(KINDS, 'doc_id')} AS kind, 'n' || doc_id AS label, (doc_id % 40) || '/' || {_turn_sql(PATHS, 'doc_id')} AS file_path, coalesce(text, '') || ' ' || {_turn_sql(WORDS, 'doc_id')} AS content FROM documents),
text_assign AS (SELECT 'doc:' || doc_id AS node_id, {_turn_sql(ASSIGNED, 'doc_id')} AS primary_block, CAST(doc_id * 37 % 100 AS DOUBLE) / 100.0::DOUBLE AS confidence, CASE WHEN doc_id % 2 = 0 THEN {_turn_sql(ASSIGNED, '(doc_id * 7 + 1)')} END AS second, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id * 13 % 100 AS DOUBLE) / 100.0::DOUBLE ELSE 0 END AS second_confidence FROM documents)"""
