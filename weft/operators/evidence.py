"""Answers to architecture questions as ranked evidence.

A question's intent (blocks, keywords, whether it asks for a trace) comes from rules over the question.
Nodes are scored in one pass over nodes and their block assignments; of every block the few rows that a
balanced choice can reach are kept by windows, and the choice itself reads only those.

nodes: node_id, kind, label, file_path, content. assignments: node_id, primary_block, confidence,
reasoning, secondary (array of block and confidence).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import ids
from weft.operators import graph, retrieval

#: Rules of the question planner, in order: block, pattern, keywords (fixed values).
INTENTS = (
    ("Access Control", r"\b(auth|access|permission|role|rbac|guard|jwt|session|identity|user)\b", ("auth", "access", "permission", "role", "guard", "jwt", "session", "user")),
    ("Identity UI", r"\b(identity ui|login|sign[- ]?in|profile|account)\b", ("identity", "login", "signin", "profile", "account")),
    ("Data Persistence", r"\b(database|db|persistence|persist|schema|model|migration|prisma|drizzle|sql|redis|store)\b", ("database", "db", "schema", "model", "migration", "prisma", "drizzle", "sql", "redis", "store")),
    ("Persistence Strategy", r"\b(cache|persistence strategy)\b", ("cache", "redis", "store")),
    ("Network Edge", r"\b(route|api|http|request|response|endpoint|middleware|webhook)\b", ("route", "api", "http", "request", "response", "endpoint", "middleware")),
    ("Background Processing", r"\b(queue|worker|job|cron|schedule|background|async)\b", ("queue", "worker", "job", "cron", "schedule", "background")),
    ("System Telemetry", r"\b(log|logging|telemetry|metric|tracing|observability|sentry|otel)\b", ("log", "logger", "telemetry", "metric", "tracing", "observability")),
    ("Security Ops", r"\b(secret|encrypt|decrypt|hash|csrf|cors|key|token)\b", ("secret", "encrypt", "decrypt", "hash", "csrf", "cors", "key", "token")),
    ("Core Rendering", r"\b(render|component|ui|view|page|screen)\b", ("render", "component", "ui", "view", "page", "screen")),
    ("Global Interface", r"\b(config|configuration|environment|env|settings)\b", ("config", "configuration", "environment", "env", "settings")),
)
#: Words that speak for a block in a node's text (fixed values).
BLOCK_KEYWORDS = {
    "Access Control": ("auth", "access", "permission", "role", "guard", "jwt", "session", "user"),
    "Identity UI": ("identity", "login", "signin", "profile", "account"),
    "Data Persistence": ("database", "db", "schema", "model", "migration", "prisma", "drizzle", "sql", "redis", "store"),
    "Persistence Strategy": ("cache", "redis", "store"),
    "Network Edge": ("route", "http", "request", "response", "endpoint", "middleware", "webhook", "server"),
    "Background Processing": ("queue", "worker", "job", "cron", "schedule", "background", "async"),
    "System Telemetry": ("log", "logger", "telemetry", "metric", "tracing", "observability", "sentry", "otel"),
    "Security Ops": ("secret", "encrypt", "decrypt", "hash", "csrf", "cors", "key", "token"),
    "Core Rendering": ("render", "component", "ui", "view", "page", "screen"),
    "Global Interface": ("config", "configuration", "environment", "env", "settings"),
}
#: Questions that ask for a trace, for a workflow, for a project (fixed values).
TRACE = r"\b(trace|flow|from .* to |touch|impact|change)\b"
WORKFLOW = r"\b(entity|entities|workflow|flow|creation|activation|delete|deletion|produce|configure)\b"
PROJECT = r"\b(project|repo|repository|service|services|component|components)\b"


@dataclass(frozen=True)
class Intent:
    blocks: tuple[str, ...]
    keywords: tuple[str, ...]
    trace: bool


def plan_question(question: str) -> Intent:
    """The intent of one question, which is the driver's to know."""
    low = question.lower()
    hit = [(block, words) for block, pattern, words in INTENTS if re.search(pattern, low)]
    return Intent(tuple(b for b, _ in hit), tuple(dict.fromkeys(w for _, words in hit for w in words)), bool(re.search(TRACE, low)))


def planned(questions: DataFrame, question: str = "question") -> DataFrame:
    """questions with intent_blocks (in the rules' order), trace, and route: how each is answered."""
    low = F.lower(F.col(question))
    like = lambda pattern: low.rlike("(?U)" + pattern)
    blocks = F.array_compact(F.array(*(F.when(like(p), F.lit(b)) for b, p, _ in INTENTS)))
    out = questions.withColumns({"intent_blocks": blocks, "trace": like(TRACE)})
    route = F.when(F.size("intent_blocks") > 0, "answer_with_evidence").when(like(WORKFLOW), "trace_entity_workflow").when(like(PROJECT), "query_projects").otherwise("unsupported")
    return out.withColumn("route", route)


def node_text(nodes: DataFrame) -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("file_path", "label", "kind", "reasoning", "content")]
    return F.lower(F.concat_ws(" ", *parts))


def _hits(text: Column, words: Sequence[str], when: Column | None = None) -> Column:
    hit = lambda w: text.contains(w) if when is None else text.contains(w) & when
    return sum((F.when(hit(w), 1).otherwise(0) for w in words), F.lit(0))


def rank_evidence(nodes: DataFrame, assignments: DataFrame, intent: Intent) -> DataFrame:
    """Nodes that an intent's blocks are assigned to, with a positive score: node_id, kind, label,
    file_path, confidence, blocks (assigned ones), score, is_test, and fits: the score for each block."""
    joined = nodes.join(assignments, "node_id").withColumn("text", node_text(nodes))
    blocks = F.array_distinct(F.concat(F.array_compact(F.array("primary_block")), F.coalesce(F.transform("secondary", lambda s: s["block"]), F.array().cast("array<string>"))))
    joined = joined.withColumn("blocks", blocks).where(F.arrays_overlap("blocks", F.array(*(F.lit(b) for b in intent.blocks))))
    of = {b: F.array_contains("blocks", b) for b in intent.blocks}
    words = dict.fromkeys(w for b in intent.blocks for w in BLOCK_KEYWORDS.get(b, ()))
    text = F.col("text")
    speaks = lambda w: reduce(lambda a, c: a | c, (of[b] for b in intent.blocks if w in BLOCK_KEYWORDS.get(b, ())))
    hits = sum((F.when(text.contains(w) & speaks(w), 1).otherwise(0) for w in words), F.lit(0))
    matched = sum((F.when(c, 1).otherwise(0) for c in of.values()), F.lit(0))
    confidence = F.coalesce("confidence", F.lit(0.0))
    is_test = F.coalesce(ids.is_test_path("file_path"), F.lit(False))
    score = retrieval.candidate_score(matched, confidence, hits, F.col("kind") == "file_surface", is_test, bool(intent.keywords))

    def fit(block: str) -> Column:
        secondary = F.aggregate(F.filter(F.coalesce("secondary", F.array().cast("array<struct<block:string,confidence:double>>")), lambda s: s["block"] == block), F.lit(0.0), lambda a, s: F.greatest(a, F.coalesce(s["confidence"], F.lit(0.0))))
        own = F.when(F.col("primary_block") == block, confidence).otherwise(secondary)
        return own * 4.0 + F.least(_hits(text, BLOCK_KEYWORDS.get(block, ())), F.lit(5)) * 1.2 - F.when(is_test, 2.0).otherwise(0.0)

    fits = F.array_compact(F.array(*(F.when(of[b], F.struct(F.lit(b).alias("block"), fit(b).alias("fit"))) for b in intent.blocks)))
    return joined.select("node_id", "kind", "label", "file_path", F.col("confidence"), "blocks", score.alias("score"), is_test.alias("is_test"), fits.alias("fits")).where("score > 0")


def choose_evidence(ranked: DataFrame, blocks: Sequence[str], per_block: int = 4) -> DataFrame:
    """(ord, block, node_id, file_path, score): the balanced choice, in the order that it is made."""
    path = F.coalesce("file_path", F.lit(""))
    each = ranked.select("node_id", path.alias("file_path"), "is_test", F.col("score").alias("overall"), F.explode("fits").alias("f"))
    candidates = each.select("node_id", "file_path", F.col("f.block").alias("block"), F.col("f.fit").alias("score"), "is_test", "overall")
    return retrieval.balanced_top(candidates, blocks, per_block, ties=["is_test", "-overall", "file_path"])


def answer(nodes: DataFrame, assignments: DataFrame, question: str) -> DataFrame:
    """The evidence for a question about blocks: the choice with each node's kind, confidence and blocks."""
    intent = plan_question(question)
    if not intent.blocks:
        raise ValueError("the question names no block; see planned() for its route")
    ranked = rank_evidence(nodes, assignments, intent)
    chosen = choose_evidence(ranked, intent.blocks).drop("score")
    return chosen.join(ranked.select("node_id", "kind", "label", "confidence", "blocks", "score"), "node_id")


def summary(evidence: DataFrame, question: str) -> DataFrame:
    """One row: claim, confidence, covered and missing blocks of an answer's evidence."""
    intent = plan_question(question)
    wanted = F.array(*(F.lit(b) for b in intent.blocks))
    some = evidence.agg(F.count(F.lit(1)).alias("n_nodes"), F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("seen"), F.avg(F.when(F.col("ord") < 8, F.col("confidence"))).alias("mean"), F.sort_array(F.collect_set("file_path")).alias("files"))
    covered = F.filter(wanted, lambda b: F.array_contains("seen", b))
    coverage = F.size(covered) / F.lit(float(max(1, len(intent.blocks))))
    claim = F.concat(F.lit(f"Question: {question} Matched block evidence for "), F.array_join(F.sort_array(covered), ", "), F.lit(". Evidence starts in "), F.array_join(F.slice("files", 1, 5), ", "), F.lit("."))
    nothing = F.lit(f"No graph evidence matched the requested architecture concept(s): {', '.join(intent.blocks)}.")
    found = F.col("n_nodes") > 0
    return some.select(
        F.lit("answer_with_evidence").alias("query_type"), F.when(found, claim).otherwise(nothing).alias("claim"),
        F.when(found, retrieval.bundle_confidence(coverage, F.coalesce("mean", F.lit(0.0)))).otherwise(0.25).alias("confidence"),
        "n_nodes", F.array_join(covered, ",").alias("covered"), F.array_join(F.array_except(wanted, covered), ",").alias("missing"),
    )


def evidence_paths(edges: DataFrame, evidence: DataFrame, depth: int = 4, most: int = 4) -> DataFrame:
    """(path, depth): shortest paths between nodes that follow each other in the evidence, until there
    are ``most``; the evidence is a few rows."""
    here = Window.orderBy("ord")
    pairs = evidence.select(F.col("ord").alias("pair"), F.col("node_id").alias("start"), F.lead("node_id").over(here).alias("end")).where("end IS NOT NULL")
    return graph.shortest_paths(edges, pairs, depth).orderBy("pair").limit(most).select("path", "depth")


def explain_node(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """One row about a node: its kind and file, and how many edges touch it; confidence 0 if there is none."""
    n = graph.incident_count(edges, node_id)
    node = nodes.where(F.col("node_id") == node_id).agg(F.min("kind").alias("kind"), F.min("file_path").alias("file_path"), F.count(F.lit(1)).alias("found"))
    claim = F.when(F.col("found") == 0, f"No node found for {node_id}").otherwise(F.concat(F.lit(f"{node_id} is a "), "kind", F.lit(" surface in "), F.coalesce("file_path", F.lit("the graph")), F.lit(".")))
    return node.join(F.broadcast(n)).select(F.lit(node_id).alias("node_id"), claim.alias("claim"), F.when(F.col("found") == 0, 0.0).otherwise(0.75).alias("confidence"), F.col("n").alias("incident"))


def explain_files(nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    """(file_path, n_nodes, blocks, confidence) of every file: its nodes and the blocks assigned to them."""
    joined = nodes.where("file_path IS NOT NULL").select("node_id", "file_path").join(assignments.select("node_id", "primary_block"), "node_id", "left")
    out = joined.groupBy("file_path").agg(F.count_distinct("node_id").alias("n_nodes"), F.array_join(F.sort_array(F.collect_set("primary_block")), ", ").alias("blocks"))
    return out.select("file_path", "n_nodes", F.when(F.col("blocks") == "", "unclassified").otherwise(F.col("blocks")).alias("blocks"), F.when(F.col("blocks") == "", 0.45).otherwise(0.7).alias("confidence"))


def find_block(nodes: DataFrame, assignments: DataFrame, block: str) -> DataFrame:
    """Nodes with the block as their primary or a secondary one."""
    has = (F.col("primary_block") == block) | F.coalesce(F.exists("secondary", lambda s: s["block"] == block), F.lit(False))
    return nodes.join(assignments.where(has).select("node_id"), "node_id", "left_semi")


def rank_nodes(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(node_id, file_path, score): nodes by the terms of a query in their path, label, kind and content."""
    text = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("file_path", "label", "kind", "content")))
    is_test = F.coalesce(ids.is_test_path("file_path"), F.lit(False))
    scored = nodes.select("node_id", "file_path", retrieval.lexical_score(text, query).alias("score"), is_test.alias("is_test")).where("score > 0")
    return scored.orderBy(F.desc("score"), "is_test", F.coalesce("file_path", F.lit("")), "node_id").limit(limit).drop("is_test")


def entity_workflow(entities: DataFrame, actions: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """(node_id, entity_id, action, rank): what code does to the entities that a query matches, in the
    order of a workflow. entities: entity_id, name; actions: entity_id, node_id, action. Of each entity
    the first three actions by node count."""
    matched = retrieval.entity_rank(entities, actions, query, limit).select("entity_id")
    few = graph.ranked(actions.join(F.broadcast(matched), "entity_id").select("entity_id", "node_id", "action"), ["entity_id"], [F.col("node_id"), F.col("action")], 3)
    rank = retrieval.workflow_rank(F.upper("action"))
    return few.select("node_id", "entity_id", "action", rank.alias("workflow_rank")).orderBy("workflow_rank", "node_id", "entity_id").limit(limit)
