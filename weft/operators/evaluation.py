"""Evaluation: gold labels, confusion, audits, gates, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import ids
from weft.functions.ids import ratio

MISSING = "__missing_node__"


def confusion(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """(expected, got, n): gold (key, expected) against predicted (key, got); no prediction is MISSING."""
    joined = gold.join(predicted, key, "left").select("expected", F.coalesce("got", F.lit(MISSING)).alias("got"))
    return joined.groupBy("expected", "got").agg(F.count(F.lit(1)).alias("n"))


def accuracy(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """(total, scorable, correct, accuracy, scorable_accuracy, missing_rate)."""
    joined = gold.join(predicted, key, "left")
    out = joined.agg(F.count(F.lit(1)).alias("total"), F.count("got").alias("scorable"), F.count_if(F.col("got") == F.col("expected")).alias("correct"))
    return out.select("*", ratio(F.col("correct"), F.col("total")).alias("accuracy"), ratio(F.col("correct"), F.col("scorable")).alias("scorable_accuracy"), ratio(F.col("total") - F.col("scorable"), F.col("total")).alias("missing_rate"))


def accuracy_by(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    joined = gold.join(predicted, key, "left")
    hit = F.when(F.col("got") == F.col("expected"), 1.0).otherwise(0.0)
    return joined.groupBy("expected").agg(F.count(F.lit(1)).alias("total"), F.avg(hit).alias("accuracy"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_texts(rows: DataFrame, text: str = "text") -> DataFrame:
    """(text, n) of texts that come more than once; texts are grouped by digest and length, not moved as keys."""
    keyed = rows.groupBy(F.sha2(F.coalesce(text, F.lit("")), 256).alias("d"), F.length(text).alias("l")).agg(F.count(F.lit(1)).alias("n"), F.any_value(text).alias(text))
    return keyed.where("n > 1").select(text, "n")


def contradictions(gold: DataFrame) -> DataFrame:
    """Targets (target) with several rows that are all under review or whose active rows disagree."""
    out = gold.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "active").alias("active"), F.count_distinct(F.when(F.col("status") == "active", F.col("primary_block"))).alias("labels"))
    return out.where("n > 1 AND (active = 0 OR labels > 1)")


def round_robin(rows: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """rows taken in turn from every group until there are ``limit``."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("turn", turn).orderBy("turn", group).limit(limit)


def multi_label(rows: DataFrame, key: list[str], label: str, strength: str) -> DataFrame:
    """(key, labels, strongest): distinct labels in order, joined by commas, and the greatest strength."""
    return rows.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels"), F.max(strength).alias("strongest"))


def brier(rows: DataFrame, by: list[str], p: str = "p", y: str = "y", least: int = 3) -> DataFrame:
    """(by, n, brier): mean squared error of chances, null below ``least`` rows."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))
    return out.withColumn("brier", F.when(F.col("n") >= least, F.col("brier")))


def recent_bias(events: DataFrame, by: str, recent: int = 20, cap: float = 0.15) -> DataFrame:
    """(by, n, bias): mean of (predicted - actual) / 100 over each group's last events, held within
    +-cap; 0 below 3 events. events: by, ord, predicted, actual."""
    w = Window.partitionBy(by).orderBy(F.desc("ord"))
    last = events.withColumn("r", F.row_number().over(w)).where(F.col("r") <= recent)
    out = last.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("predicted") - F.col("actual")).alias("off"))
    mean = F.col("off").cast("double") / F.col("n") / 100
    return out.select(by, "n", F.when(F.col("n") >= 3, F.least(F.greatest(mean, F.lit(-cap)), F.lit(cap))).otherwise(0.0).alias("bias"))


def run_statistics(counts: DataFrame) -> DataFrame:
    """(mean, std, consistency) of n over runs: population deviation, 1 - std / mean held in 0 to 1."""
    out = counts.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"))
    return out.withColumn("consistency", F.least(F.greatest(1 - F.coalesce(F.try_divide(F.col("std"), F.col("mean")), F.lit(1.0)), F.lit(0.0)), F.lit(1.0)))


def corpus_gate(runs: DataFrame, attempted: int = 50, success: float = 1.0, failures: int = 0, empty: int = 0) -> DataFrame:
    """(check_id, value, status) over corpus runs (status, node_count)."""
    ok = F.col("status") == "ok"
    t = runs.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.count_if(ok & (F.col("node_count") == 0)).alias("empty"))
    rate = F.col("ok").cast("double") / F.greatest("attempted", F.lit(1))
    checks = [("attempted", F.col("attempted").cast("double"), F.col("attempted") >= attempted), ("success_rate", rate, rate >= success), ("failures", F.col("failed").cast("double"), F.col("failed") <= failures), ("zero_nodes", F.col("empty").cast("double"), F.col("empty") <= empty)]
    return t.select(F.inline(F.array(*(F.struct(F.lit(c).alias("check_id"), v.alias("value"), F.when(g, "pass").otherwise("fail").alias("status")) for c, v, g in checks))))


def top_files(nodes: DataFrame, n: int = 10, names: int = 5) -> DataFrame:
    """(file_path, n, names): the files with most nodes and their first labels."""
    counts = nodes.where("file_path IS NOT NULL").groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_path").limit(n)
    first = Window.partitionBy("file_path").orderBy("node_id")
    some = nodes.join(F.broadcast(counts.select("file_path")), "file_path").withColumn("r", F.row_number().over(first)).where(F.col("r") <= names)
    lists = some.groupBy("file_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]), ",").alias("names"))
    return counts.join(lists, "file_path")


def migration_lanes(suggestions: DataFrame) -> DataFrame:
    """suggestions with risk: high with blocked files, low with high confidence and a few files, else medium."""
    risk = F.when(F.col("blocked") > 0, "high").when((F.col("confidence") == "high") & (F.col("candidates") <= 3), "low").otherwise("medium")
    return suggestions.withColumn("risk", risk)


def evidence_scores(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, match, has_evidence, block_match, file_match, hallucinated) of every question. questions: id,
    expected_blocks, expected_files, expected_globs (arrays), unsupported; answers: id, file_path, blocks,
    a row for each node of an answer.

    A question that can't be answered matches if its answer is empty; another if its answer has one of
    the blocks and one of the files or globs that it expects, where it expects any.
    """
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    got = answers.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("seen"), F.collect_set("file_path").alias("files"))
    q = questions.join(got, "id", "left").withColumn("has_evidence", F.col("seen").isNotNull())
    none = F.array().cast("array<string>")
    seen, files = F.coalesce("seen", none), F.coalesce("files", none)
    block = ~some("expected_blocks") | F.arrays_overlap("expected_blocks", seen)
    by_glob = F.exists(F.coalesce("expected_globs", none), lambda g: F.exists(files, lambda f: F.rlike(f, ids.glob_regex(g))))
    file = (~some("expected_files") & ~some("expected_globs")) | (some("expected_files") & F.arrays_overlap(F.coalesce("expected_files", none), files)) | by_glob
    empty = ~F.col("has_evidence")
    open_ = F.col("unsupported")
    return q.select(
        "id", F.when(open_, empty).otherwise(~empty & block & file).alias("match"), "has_evidence", F.when(open_, empty).otherwise(block).alias("block_match"),
        F.when(open_, empty).otherwise(file).alias("file_match"), (open_ & ~empty).alias("hallucinated"), open_.alias("unsupported"),
    )


def evidence_report(scores: DataFrame) -> DataFrame:
    out = scores.agg(F.count(F.lit(1)).alias("scored"), F.count_if("match").alias("correct"), F.count_if("unsupported").alias("unsupported"), F.count_if(F.col("unsupported") & F.col("match")).alias("unsupported_correct"), F.count_if("hallucinated").alias("hallucinated"), F.count_if(~F.col("has_evidence") & ~F.col("unsupported")).alias("missing"))
    return out.select("*", ratio(F.col("correct"), F.col("scored")).alias("accuracy"), ratio(F.col("hallucinated"), F.col("unsupported")).alias("hallucination_rate"))


#: Words that speak for nodes about identity and about data (fixed values).
AUTH_WORDS = ("auth", "login", "session", "password", "token", "profile")
DATA_WORDS = ("prisma", "schema", "db", "database", "profile", "query", "seed")


def smoke(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of what a graph must have to be used: files with code, nodes about identity and data (by their
    label, path and first 500 characters), code that nothing contains, and whether it passes."""
    low = F.lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("file_path", F.lit("")), F.substring(F.coalesce("content", F.lit("")), 1, 500)))
    any_of = lambda words: low.rlike("|".join(words))
    held = edges.where("edge_type = 'CONTAINS'").select(F.col("target_id").alias("node_id"), F.lit(1).alias("held")).distinct()
    rows = nodes.withColumns({"auth": any_of(AUTH_WORDS), "data": any_of(DATA_WORDS)}).select("node_id", "file_path", "auth", "data").join(held, "node_id", "left")
    out = rows.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("file_path").alias("files"), F.count_if("auth").alias("auth"), F.count_if("data").alias("data"), F.count_if(F.col("held").isNull()).alias("loose"))
    ok = (F.col("nodes") > 0) & (F.col("auth") > 0) & (F.col("data") > 0) & (F.col("loose") == 0)
    return out.withColumn("status", F.when(ok, "pass").otherwise("fail"))


def layer_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def corpus_summary(repos: DataFrame) -> DataFrame:
    """(language, repos, ok, nodes, largest): repositories (repo, language, status, node_count) by language."""
    return repos.groupBy("language").agg(F.count(F.lit(1)).alias("repos"), F.count_if(F.col("status") == "ok").alias("ok"), F.sum("node_count").alias("nodes"), F.max_by("repo", F.struct("node_count", "repo")).alias("largest"))


def verified(written: DataFrame, expected: DataFrame) -> DataFrame:
    """(table, repo_name, n, wanted, status) of two results of counts(): what a store holds, what it should."""
    both = written.join(expected.withColumnRenamed("n", "wanted"), ["table", "repo_name"], "full")
    return both.withColumn("status", F.when(F.col("n").eqNullSafe(F.col("wanted")), "pass").otherwise("fail"))


def validation_gates(checks: DataFrame, required: list[str]) -> DataFrame:
    """(gate, status): each required gate of checks (gate, ok): fail if any check fails or there is none."""
    have = checks.groupBy("gate").agg(F.min(F.col("ok").cast("int")).alias("ok"))
    wanted = checks.sparkSession.createDataFrame([(g,) for g in required], "gate string")
    return wanted.join(have, "gate", "left").select("gate", F.when(F.col("ok") == 1, "pass").otherwise("fail").alias("status"))


def review_packet(nodes: DataFrame, edges: DataFrame, n_nodes: int = 80, n_edges: int = 120) -> tuple[DataFrame, DataFrame]:
    """The first nodes by path, kind and label, and the first edges by type and ends, for people to review."""
    some = nodes.orderBy(F.coalesce("file_path", F.lit("")), "kind", "label", "node_id").limit(n_nodes)
    return some, edges.orderBy("edge_type", "source_id", "target_id").limit(n_edges)
