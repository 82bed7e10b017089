"""Entities, actions and summaries of classified nodes.

nodes: node_id, kind, label, file_path, content. assignments: node_id, primary_block, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import ids

#: Rules for actions and for entities that a text points to, in order, and folders that name no entity
#: (fixed values).
ACTIONS = (
    ("AUTHORIZE", r"auth|session|jwt|token|role|permission|guard|password"),
    ("PERSIST", r"prisma|database|query|insert|update|delete|select|schema|profile"),
    ("CONNECT", r"route|fetch|http|request|response|elysia|express|hono"),
    ("OBSERVE", r"log|metric|trace|telemetry|sentry|error"),
    ("RENDER", r"component|jsx|tsx|render|className|useState|form"),
    ("CONFIGURE", r"env|config|cors|rate|limit|secret|key"),
    ("PROCESS", r"queue|worker|job|task|schedule|cron"),
)
ENTITIES = (
    ("Identity principal", r"\b(user|profile|account|identity|session)\b"),
    ("Authorization policy", r"\b(role|permission|rbac|guard|admin)\b"),
    ("Database model", r"\b(prisma|model|schema|table|profile|user)\b"),
    ("Database client", r"\b(db|database|client|pool|adapter|postgres)\b"),
    ("HTTP surface", r"\b(route|router|endpoint|request|response|elysia|express|hono)\b"),
    ("Configuration contract", r"\b(config|env|secret|key|url)\b"),
    ("Worker process", r"\b(queue|job|worker|task|cron)\b"),
    ("Telemetry stream", r"\b(log|metric|trace|telemetry|event)\b"),
    ("UI component", r"\b(component|page|form|button|input|view)\b"),
)
GENERIC = ("src", "lib", "app", "server", "client", "components", "pages")
#: Kinds that are entities by their own name (fixed values).
OWN_NAME = ("middleware", "service_boundary", "config_object", "react_hook")


def _text(*parts: str) -> Column:
    return F.concat_ws(" ", *(F.coalesce(F.col(p), F.lit("")) for p in parts), F.substring(F.coalesce("content", F.lit("")), 1, 2000))


def entity_names() -> Column:
    """Distinct names of a node: its label, its file's stem and its folders, split into words."""
    parts = F.split(F.coalesce("file_path", F.lit("")), "/")
    last = F.element_at(parts, -1)
    stem = F.when(last.contains("."), F.regexp_replace(last, r"\.[^.]*$", "")).otherwise(last)
    folders = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: ~p.isin(*GENERIC))
    names = F.transform(F.concat(F.array(F.coalesce("label", F.lit("")), stem), folders), ids.split_identifier)
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def domain_entities() -> Column:
    """Distinct labels that a node's text and kind point to."""
    text = _text("kind", "label", "file_path")
    found = [F.when(text.rlike("(?isU)" + p), F.lit(e)) for e, p in ENTITIES]
    kind = F.col("kind")
    found += [F.when(kind == "db_model", F.concat(ids.split_identifier("label"), F.lit(" model"))), F.when(kind == "route_handler", F.lit("HTTP route")), F.when(kind.isin(*OWN_NAME), ids.split_identifier("kind"))]
    return F.array_distinct(F.array_compact(F.array(*found)))


def entities(nodes: DataFrame, assignments: DataFrame, imports: DataFrame | None = None, top: int = 200) -> DataFrame:
    """(category, name, n, entity_id): the most frequent entities of all blocks. imports: node_id,
    target_id; of each node the first eight module: targets by name count too."""
    named = nodes.join(assignments.select("node_id", "primary_block"), "node_id").select(F.col("primary_block").alias("category"), F.explode(F.concat(entity_names(), domain_entities())).alias("name"))
    if imports is not None:
        first = imports.withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy("target_id"))).where("r <= 8 AND target_id LIKE 'module:%'")
        modules = first.join(assignments.select("node_id", "primary_block"), "node_id").select(F.col("primary_block").alias("category"), F.expr("substring(target_id, 8)").alias("name"))
        named = named.unionByName(modules)
    counts = named.groupBy("category", "name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category", "name").limit(top)
    return counts.withColumn("entity_id", ids.entity_id("category", "name"))


def actions(nodes: DataFrame, assignments: DataFrame, found: DataFrame) -> DataFrame:
    """(node_id, entity_id, action, confidence): what each node does to an entity of its block: the first
    of them, by count and name, that the node names, else the first one. found: entities(), a few rows."""
    low = F.lower(_text("label", "file_path"))
    action = F.coalesce(*(F.when(low.rlike("(?is)" + p), F.lit(a)) for a, p in ACTIONS), F.lit("REPRESENT"))
    listed = found.groupBy("category").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "name", "entity_id"))).alias("all"))
    rows = nodes.join(assignments.select("node_id", "primary_block", "confidence"), "node_id").select("node_id", entity_names().alias("names"), action.alias("action"), F.col("primary_block").alias("category"), "confidence")
    rows = rows.join(F.broadcast(listed), "category")  # at most ``top`` entities
    own = F.filter("all", lambda e: F.array_contains("names", e["name"]))
    target = F.when(F.size(own) > 0, F.get(own, F.lit(0))["entity_id"]).otherwise(F.get("all", F.lit(0))["entity_id"])
    return rows.select("node_id", target.alias("entity_id"), "action", F.greatest(F.lit(0.1), F.least("confidence", F.lit(0.95))).alias("confidence"))


def summaries(nodes: DataFrame, assignments: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(node_id, text): a sentence about each node. neighbors: node_id, n_imports, n_siblings."""
    rows = nodes.join(assignments.select("node_id", "primary_block"), "node_id").join(neighbors, "node_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return rows.select("node_id", F.concat("kind", F.lit(" "), "label", F.lit(" in "), "file_path", F.lit(" maps to "), "primary_block", F.lit(" with "), n("n_imports"), F.lit(" import edge(s) and "), n("n_siblings"), F.lit(" sibling code node(s).")).alias("text"))


def project_summary(assignments: DataFrame, project: str, top: int = 5) -> DataFrame:
    """One row (project, blocks, n): the most frequent blocks of all nodes, with their counts."""
    counts = assignments.groupBy("primary_block").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "primary_block").limit(top)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "primary_block"))), lambda x: F.concat(x["primary_block"], F.lit(" ("), (-x["o"]).cast("string"), F.lit(")"))), ", ")
    return best.agg(listed.alias("blocks"), F.count(F.lit(1)).alias("n")).select(F.lit(project).alias("project"), "blocks", "n")


def insights(surfaces: DataFrame, per_block: int = 5) -> DataFrame:
    """(title, rank, node_id, block): ready-made retrievals over classified nodes. surfaces: node_id,
    file_path, label, block, confidence. Blocks' best rows come from one window; what is left is small."""
    groups = {
        "Where is auth?": ("Access Control", "Security Ops"),
        "What changes if I touch this?": ("Network Edge", "Connectivity Layer", "Data Persistence", "Background Processing"),
        "What are the risky seams?": ("Access Control", "Security Ops", "System Telemetry", "Error Boundaries", "Resiliency"),
    }
    order = [F.desc("confidence"), F.col("file_path"), F.col("node_id")]
    best = surfaces.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy(*order))).where(F.col("r") <= per_block)
    out = None
    for title, blocks in groups.items():
        place = F.array_position(F.array(*(F.lit(b) for b in blocks)), F.col("block"))
        some = best.where(F.col("block").isin(*blocks)).withColumn("rank", F.row_number().over(Window.orderBy(place, "r"))).where(F.col("rank") <= per_block)
        some = some.select(F.lit(title).alias("title"), "rank", "node_id", "block")
        out = some if out is None else out.unionByName(some)
    weak = surfaces.where("confidence < 0.62").orderBy("confidence", "file_path", "node_id").limit(6)
    weak = weak.withColumn("rank", F.row_number().over(Window.orderBy("confidence", "file_path", "node_id")))
    return out.unionByName(weak.select(F.lit("What should I refactor first?").alias("title"), "rank", "node_id", "block"))
