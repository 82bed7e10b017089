"""Answers to a table of questions at once.

questions: id, question. Evidence for blocks depends on a question only by the blocks that it names, so
questions meet nodes as their distinct sets of blocks, of which there are few whatever the number of
questions; every set's balanced choice is found by windows. Workflow and project questions are scored by
their terms: all terms of all questions are looked for in one pass over the texts (``patterns``), and
questions meet what was found in joins.

nodes, assignments: as for ``evidence``. entities: entity_id, name, category, description. actions:
entity_id, node_id, action. projects: project_id, name, repo_name, text (its summaries).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import ids
from weft.operators import evidence, patterns, retrieval

#: Blocks that the planner knows, in its order.
BLOCKS = tuple(b for b, _, _ in evidence.INTENTS)
_CHOSEN = "intent string, ord int, block string, node_id string, file_path string, score double, kind string, label string, confidence double, blocks array<string>"


def _routed(questions: DataFrame) -> DataFrame:
    return evidence.planned(questions.select("id", "question")).withColumn("intent", F.array_join("intent_blocks", "|"))


def ranked_many(nodes: DataFrame, assignments: DataFrame, intents: DataFrame) -> DataFrame:
    """rank_evidence for every intent (intent, intent_blocks): its rows once for each block they fit, with that
    block, its fit, and n_blocks of the intent."""
    empty = F.array().cast("array<struct<block:string,confidence:double>>")
    secondary = F.coalesce("secondary", empty)
    joined = nodes.join(assignments, "node_id").withColumn("text", evidence.node_text(nodes))
    joined = joined.withColumn("blocks", F.array_distinct(F.concat(F.array_compact(F.array("primary_block")), F.transform(secondary, lambda s: s["block"]))))
    words = {b: evidence.BLOCK_KEYWORDS.get(b, ()) for b in BLOCKS}
    # the words of each of a node's blocks that its text holds: hits of any intent are a union of these
    held = F.create_map(*(x for b in BLOCKS for x in (F.lit(b), F.when(F.array_contains("blocks", b), F.array_compact(F.array(*(F.when(F.col("text").contains(w), F.lit(w)) for w in words[b])))))))
    base = joined.select(
        "node_id", "kind", "label", "file_path", F.coalesce("confidence", F.lit(0.0)).alias("__confidence"), "confidence", "primary_block", secondary.alias("secondary"), "blocks",
        F.coalesce(ids.is_test_path("file_path"), F.lit(False)).alias("is_test"), held.alias("held"),
    )
    met = base.withColumn("block", F.explode("blocks")).join(F.broadcast(intents.withColumn("block", F.explode("intent_blocks"))), "block")
    shared = F.array_intersect("intent_blocks", "blocks")
    hits = F.size(F.array_distinct(F.flatten(F.transform(shared, lambda b: F.coalesce(F.col("held")[b], F.array().cast("array<string>"))))))
    overall = retrieval.candidate_score(F.size(shared), F.col("__confidence"), hits, F.col("kind") == "file_surface", F.col("is_test"))
    second = F.aggregate(F.filter("secondary", lambda s: s["block"] == F.col("block")), F.lit(0.0), lambda a, s: F.greatest(a, F.coalesce(s["confidence"], F.lit(0.0))))
    own = F.when(F.col("primary_block") == F.col("block"), F.col("__confidence")).otherwise(second)
    fit = own * 4.0 + F.least(F.size(F.coalesce(F.col("held")[F.col("block")], F.array().cast("array<string>"))), F.lit(5)) * 1.2 - F.when(F.col("is_test"), 2.0).otherwise(0.0)
    return met.select("intent", F.size("intent_blocks").alias("n_blocks"), "node_id", "kind", "label", F.coalesce("file_path", F.lit("")).alias("file_path"), "confidence", "blocks", "is_test", "block", overall.alias("overall"), fit.alias("fit")).where("overall > 0")


def _picked(per_block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, rows = set(), []
        for block in BLOCKS:
            files: set[str] = set()
            for r in pdf[pdf.block == block].sort_values("place").itertuples():
                if len(files) == per_block:
                    break
                if r.node_id not in taken and r.file_path not in files:
                    taken.add(r.node_id)
                    files.add(r.file_path)
                    rows.append((r.intent, len(rows), block, r.node_id, r.file_path, r.overall, r.kind, r.label, r.confidence, r.blocks))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _CHOSEN.split(", ")])

    return run


def chosen_many(ranked: DataFrame, per_block: int = 4) -> DataFrame:
    """The balanced choice of every intent. Blocks before one can have taken only so many nodes, so few rows
    of each file and block can matter, and an intent's group is these."""
    order = [F.desc("fit"), "is_test", F.desc("overall"), "file_path", "node_id"]
    taken = per_block * (F.col("n_blocks") - 1)
    some = ranked.withColumn("place", F.row_number().over(Window.partitionBy("intent", "block", "file_path").orderBy(*order))).where(F.col("place") <= taken + 1)
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("intent", "block").orderBy(*order))).where(F.col("place") <= taken + per_block * (taken + 1))
    return some.groupBy("intent").applyInPandas(_picked(per_block), _CHOSEN)


def block_answers(nodes: DataFrame, assignments: DataFrame, questions: DataFrame, per_block: int = 4) -> DataFrame:
    """(id, ord, block, node_id, file_path, kind, label, confidence, blocks, score): what ``evidence.answer``
    gives for each question that names a block."""
    asked = _routed(questions).where("route = 'answer_with_evidence'")
    intents = asked.select("intent", "intent_blocks").distinct()  # sets of BLOCKS, so at most 2 ** 10 of them
    chosen = chosen_many(ranked_many(nodes, assignments, intents), per_block)
    return asked.select("id", "intent").join(chosen, "intent").drop("intent")


def _terms(question: Column) -> Column:
    found = F.regexp_extract_all(F.lower(question), F.lit(r"([a-zA-Z][a-zA-Z0-9_]{2,})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*retrieval.STOP_WORDS))


def text_scores(texts: DataFrame, key: str, questions: DataFrame) -> DataFrame:
    """(id, key, lexical): what lexical_score gives for every question and text (key, text) where it is positive."""
    asked = questions.select("id", _terms(F.col("question")).alias("terms"), F.trim(F.lower("question")).alias("whole")).where(F.size("terms") > 0)
    weighed = asked.select("id", F.explode(F.concat(F.transform("terms", lambda t: F.struct(t.alias("pattern"), F.lit(1.0).alias("w"))), F.array(F.struct(F.col("whole").alias("pattern"), F.lit(3.0).alias("w"))))).alias("x")).select("id", "x.pattern", "x.w")
    weighed = weighed.groupBy("id", "pattern").agg(F.sum("w").alias("w"))
    found = patterns.occurrences(texts.select(key, F.lower("text").alias("text")), weighed, [key])
    return found.join(weighed, "pattern").groupBy("id", key).agg(F.sum("w").alias("lexical"))


def workflow_answers(entities: DataFrame, actions: DataFrame, questions: DataFrame, limit: int = 30) -> tuple[DataFrame, DataFrame]:
    """(steps, bundles) of questions (id, question) about workflows. steps: id, ord, node_id, entity_id, action,
    in the order of a workflow: of each of the best ``limit`` entities the first three actions by node.
    bundles: id, claim, confidence."""
    name = entities.select("entity_id", F.coalesce("name", F.lit("")).alias("name"), F.concat_ws(" ", "name", "category", "description").alias("text"))
    n = actions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    score = F.col("lexical") + 0.2 * F.least(F.coalesce("n", F.lit(0)), F.lit(5))
    best = Window.partitionBy("id").orderBy(F.desc("score"), "name", "entity_id")
    hits = text_scores(name, "entity_id", questions).join(n, "entity_id", "left").join(name.select("entity_id", "name"), "entity_id").withColumn("score", score)
    hits = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
    first = Window.partitionBy("entity_id").orderBy("node_id", "action")
    few = actions.withColumn("k", F.row_number().over(first)).where("k <= 3")
    paths = hits.select("id", "entity_id", "place").join(few, "entity_id")
    paths = paths.withColumn("p", F.row_number().over(Window.partitionBy("id").orderBy("place", "k"))).where(F.col("p") <= limit)
    order = Window.partitionBy("id").orderBy(retrieval.workflow_rank(F.upper("action")), "node_id", "entity_id", "action")
    steps = paths.select("id", (F.row_number().over(order) - 1).alias("ord"), "node_id", "entity_id", F.upper("action").alias("action"))
    known = hits.select("id", "entity_id").join(actions.select("entity_id", "node_id"), "entity_id").groupBy("id").agg(F.count(F.lit(1)).alias("acts"))
    met = hits.groupBy("id").agg(F.count(F.lit(1)).alias("entities")).join(steps.groupBy("id").agg(F.count(F.lit(1)).alias("steps")), "id", "left").join(known, "id", "left")
    out = questions.join(met, "id", "left")
    q = F.col("question")
    spans = F.concat(F.lit("Workflow evidence for '"), q, F.lit("' spans "), F.col("steps").cast("string"), F.lit(" semantic action edge(s)."))
    matched = F.concat(F.lit("Matched "), F.col("entities").cast("string"), F.lit(" semantic entities for '"), q, F.lit("'."))
    claim = F.when(F.col("entities").isNull(), F.concat(F.lit("No semantic entities matched query: "), q)).when(F.col("steps").isNull(), matched).otherwise(spans)
    confidence = F.when(F.col("entities").isNull(), 0.2).otherwise(F.least(0.55 + 0.05 * F.least(F.coalesce("acts", F.lit(0)), F.lit(5)), F.lit(0.85)))
    return steps, out.select("id", claim.alias("claim"), confidence.alias("confidence"))


def project_answers(projects: DataFrame, nodes: DataFrame, questions: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(found, bundles) of questions (id, question) about projects. found: id, ord, node_id, file_path, score: the
    nodes of each, as rank_nodes orders them. bundles: id, project_id, claim, confidence, for every
    project that matches or, where none does, once without."""
    text = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("file_path", "label", "kind", "content")))
    is_test = F.coalesce(ids.is_test_path("file_path"), F.lit(False))
    about = nodes.select("node_id", "file_path", is_test.alias("is_test"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "is_test", F.coalesce("file_path", F.lit("")), "node_id")
    hits = text_scores(nodes.select("node_id", text.alias("text")), "node_id", questions).withColumnRenamed("lexical", "score").join(about, "node_id")
    found = hits.withColumn("ord", F.row_number().over(order) - 1).where(F.col("ord") < limit).select("id", "ord", "node_id", "file_path", "score")
    named = projects.select("project_id", "name", F.concat_ws(" ", "name", "repo_name", "text").alias("text"))
    scored = text_scores(named, "project_id", questions).join(named.select("project_id", "name"), "project_id")
    n = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    every = projects.select("project_id", "name")
    own = questions.join(scored, "id", "left").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    only = every.agg(F.count(F.lit(1)).alias("projects"), F.min("project_id").alias("p"), F.min("name").alias("q"))
    own = own.join(F.broadcast(only))  # one row; a lone project is the one that is meant
    lone = (F.col("projects") == 1) & F.col("project_id").isNull() & (F.col("n") > 0)
    own = own.withColumns({"project_id": F.when(lone, F.col("p")).otherwise(F.col("project_id")), "name": F.when(lone, F.col("q")).otherwise(F.col("name"))})
    hit = F.coalesce("lexical", F.lit(0.0)) + F.col("n") > 0
    claim = F.when(~hit, F.concat(F.lit("No project evidence matched query: "), "question")).otherwise(F.concat(F.lit("Project "), F.coalesce("name", F.lit("(none)")), F.lit(" matched '"), "question", F.lit("' with "), F.col("n").cast("string"), F.lit(" supporting node(s).")))
    confidence = F.when(~hit, 0.2).otherwise(F.least(0.55 + 0.05 * F.coalesce("lexical", F.lit(0.0)) + 0.03 * F.least("n", F.lit(5)), F.lit(0.85)))
    return found, own.select("id", "project_id", claim.alias("claim"), confidence.alias("confidence"))


def answer_many(nodes: DataFrame, assignments: DataFrame, entities: DataFrame, actions: DataFrame, projects: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, route, ord, node_id, file_path, blocks): the evidence for every question, by the route that the planner
    gives it; a question without evidence has one row without a node. Its rows with a
    node are what the evidence benchmark takes."""
    routed = _routed(questions)
    of = lambda route: routed.where(F.col("route") == route).select("id", "question")
    place = nodes.select("node_id", "file_path")
    none = F.lit(None).cast("array<string>")
    by_block = block_answers(nodes, assignments, questions).select("id", "ord", "node_id", "file_path", "blocks")
    steps = workflow_answers(entities, actions, of("trace_entity_workflow"))[0].join(place, "node_id", "left").select("id", "ord", "node_id", "file_path", none.alias("blocks"))
    found = project_answers(projects, nodes, of("query_projects"))[0].select("id", "ord", "node_id", "file_path", none.alias("blocks"))
    return routed.select("id", "route").join(by_block.unionByName(steps).unionByName(found), "id", "left").select("id", "route", "ord", "node_id", "file_path", "blocks")
