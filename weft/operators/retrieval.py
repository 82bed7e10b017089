"""Lexical and intent-weighted retrieval over text surfaces; questions may be one or a column of many."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import patterns

#: Words that don't count as terms of a question (fixed values).
STOP_WORDS = ("a", "an", "and", "are", "by", "for", "from", "how", "in", "is", "of", "on", "or", "the", "to", "what", "where", "which", "with")
#: Order of actions along a workflow; others come at 50 (fixed values).
WORKFLOW = ("CONFIGURE", "AUTHORIZE", "CONNECT", "CREATE", "PRODUCE", "PROCESS", "PERSIST", "OBSERVE", "RENDER", "REPRESENT")


def terms(question: str) -> list[str]:
    return [w for w in re.findall(r"[a-zA-Z][a-zA-Z0-9_]{2,}", question.lower()) if w not in STOP_WORDS]


def lexical_score(text: Column, question: str) -> Column:
    """1 for each term that is a substring, and 3 if the whole question is; 0 for a question without terms."""
    if not terms(question):
        return F.lit(0.0)
    low = F.lower(F.coalesce(text, F.lit("")))
    score = sum((F.when(low.contains(t), 1.0).otherwise(0.0) for t in terms(question)), F.lit(0.0))
    return score + F.when(low.contains(question.strip().lower()), 3.0).otherwise(0.0)


def lexical_rank(docs: DataFrame, question: str, text: str = "text", key: str = "doc_id", top: int = 20) -> DataFrame:
    """The best rows by score, then key; Spark keeps only ``top`` rows of each task."""
    scored = docs.select(key, lexical_score(F.col(text), question).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(top)


def entity_rank(entities: DataFrame, actions: DataFrame, question: str, top: int = 20) -> DataFrame:
    """entities (entity_id, name) that a term matches, by lexical score plus 0.2 for each of at most five actions."""
    n = actions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_actions"))
    scored = entities.join(n, "entity_id", "left").withColumn("n_actions", F.coalesce("n_actions", F.lit(0)))
    lexical = lexical_score(F.col("name"), question)
    total = lexical + 0.2 * F.least("n_actions", F.lit(5))
    return scored.where(lexical > 0).select("entity_id", "name", "n_actions", total.alias("score")).orderBy(F.desc("score"), "name").limit(top)


def workflow_rank(action: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ((a, i) for i, a in enumerate(WORKFLOW)) for x in pair))
    return F.coalesce(known[action], F.lit(50))


def candidate_score(matched: Column, confidence: Column, hits: Column, surface: Column, is_test: Column, keywords: bool = True) -> Column:
    """Score of an answer candidate by matched blocks, confidence and keyword hits, less penalties.

    keywords: whether the question has any, so that a candidate without hits is marked down.
    """
    off = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    score = 3.0 * matched + 3.0 * confidence + 0.9 * F.least(hits, F.lit(5)) - off(surface, 0.25) - off(is_test, 1.5)
    return (score - off(hits == 0, 2.0) if keywords else score) - off((hits == 0) & (confidence < 0.35), 2.5)


def _picked(blocks: Sequence[str], per_block: int):
    """The balanced choice among few candidates, which come with their place within their block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, rows = set(), []
        for block in blocks:
            files: set[str] = set()
            for r in pdf[pdf.block == block].sort_values("place").itertuples():
                if len(files) == per_block:
                    break
                if r.node_id not in taken and r.file_path not in files:
                    taken.add(r.node_id)
                    files.add(r.file_path)
                    rows.append((len(rows), block, r.node_id, r.file_path, r.score))
        return pd.DataFrame(rows, columns=["ord", "block", "node_id", "file_path", "score"])

    return run


def balanced_top(candidates: DataFrame, blocks: Sequence[str], per_block: int = 4, ties: Sequence[str] = ()) -> DataFrame:
    """(ord, block, node_id, file_path, score): up to ``per_block`` for each block in order, no node twice
    and no file twice for a block. candidates: node_id, file_path, block, score.

    Ties go by the columns of ``ties`` (a minus sign: downwards), then node_id. Blocks before one can
    have taken only so many nodes, so of each file and of each block only as many rows can matter; these
    are found by windows, which Spark limits before it shuffles, and the choice reads nothing else.
    """
    order = [F.desc("score"), *(F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in ties), F.asc("node_id")]
    taken = per_block * (len(blocks) - 1)
    some = candidates.where(F.col("block").isin(*blocks))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("block", "file_path").orderBy(*order))).where(F.col("place") <= taken + 1)
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(*order))).where(F.col("place") <= taken + per_block * (taken + 1))
    few = some.select("block", "node_id", "file_path", "score", "place")
    kind = {f.name: f.dataType.simpleString() for f in few.schema}
    return few.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_picked(tuple(blocks), per_block), f"ord int, block string, node_id {kind['node_id']}, file_path string, score {kind['score']}")


def bundle_confidence(coverage: Column, mean_confidence: Column) -> Column:
    return F.least(0.25 + 0.45 * coverage + 0.3 * mean_confidence, F.lit(0.95))


#: Passages, and characters of them, up to which one automaton holds them all.
FEW, FEW_CHARS = patterns.MOST, patterns.MOST_CHARS


def contained_texts(docs: DataFrame, passages: DataFrame, words: int = 8) -> DataFrame:
    """(item_id, doc_id): documents that hold a passage (item_id, text) whole, as a substring.

    Passages that are few, by a count, are looked for in one pass by an automaton over all of them. Of many,
    those with a word between their first and last one meet documents on a hash: a document that holds
    a passage holds these words, while the first and last may be parts of longer words there. So the
    first ``words`` of them, or all if they are fewer, are hashed, and only runs as long as some passage's
    key are made of documents. Shorter passages go through automata, a block of them at a time.
    """
    tokens = F.split(F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[ \\t\\n\\x0b\\f\\r]+", " ")), " ")
    run = lambda a, i, n: F.xxhash64(F.array_join(F.slice(a, i, n), " "))
    p = passages.where("length(trim(text)) > 0").select("item_id", tokens.alias("p"), F.col("text").alias("passage"))
    p = p.withColumn("n", F.least(F.size("p") - 2, F.lit(words)))
    size = p.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("passage")).alias("chars")).collect()  # words + 2 rows

    def by_automaton(some: DataFrame) -> DataFrame:
        found = patterns.occurrences(docs, some, ["doc_id"], pattern="passage").withColumnRenamed("pattern", "passage")
        return found.join(some.select("item_id", "passage"), "passage").select("item_id", "doc_id").distinct()

    if sum(r["rows"] for r in size) <= FEW and sum(r["chars"] for r in size) <= FEW_CHARS:
        return by_automaton(p)
    long, short = p.where("n > 0").withColumn("k", run(F.col("p"), F.lit(2), F.col("n"))), p.where("n <= 0")
    d = docs.select("doc_id", "text", tokens.alias("d"))
    out = []
    if lengths := sorted(r["n"] for r in size if r["n"] > 0):
        runs_of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("d") - n + 1, F.lit(1))), lambda i: run(F.col("d"), i, F.lit(n)))
        runs = F.flatten(F.array(*map(runs_of, lengths)))
        met = d.select("doc_id", F.explode(F.array_distinct(runs)).alias("k")).join(long.select("item_id", "passage", "k"), "k").join(docs.select("doc_id", "text"), "doc_id")
        out.append(met.where(F.contains("text", "passage")).select("item_id", "doc_id"))
    if any(r["n"] <= 0 for r in size):
        out.append(by_automaton(short))
    return reduce(DataFrame.unionByName, out).distinct()
