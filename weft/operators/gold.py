"""Gold rows: their targets among nodes, their audit, and a benchmark of predicted blocks against them.

gold: id, repo_name, node_id, file_path, file_glob, accepted_blocks (array), primary_block, confidence,
status, notes; nodes: node_id, file_path, repo_name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import ids
from weft.operators import evaluation
from weft.session import cut

#: Values that a gold row may have (fixed values).
STATUSES = ("active", "needs_review", "deprecated")
CONFIDENCES = ("high", "medium", "low")


def _blank(name: str):
    return F.coalesce(F.col(name), F.lit("")) == ""


def normalized(gold: DataFrame) -> DataFrame:
    """gold with defaults: the primary block is the first accepted one, the status active."""
    some = F.filter(F.coalesce("accepted_blocks", F.array().cast("array<string>")), lambda b: F.trim(F.coalesce(b, F.lit(""))) != "")
    out = gold.withColumn("accepted_blocks", F.when(F.size(some) > 0, some).when(~_blank("primary_block"), F.array("primary_block")).otherwise(some))
    primary = F.when(~_blank("primary_block"), F.col("primary_block")).otherwise(F.coalesce(F.get("accepted_blocks", F.lit(0)), F.lit("")))
    return out.withColumns({"primary_block": primary, "status": F.when(_blank("status"), "active").otherwise(F.col("status"))})


def applies(repo: str):
    """Whether a gold row is about this repository: no name, its full or short name, or the end of it."""
    name = F.trim(F.coalesce("repo_name", F.lit("")))
    return (name == "") | name.isin(repo, repo.rsplit("/", 1)[-1]) | F.lit(repo).endswith(F.concat(F.lit("/"), name))


#: Globs that a broadcast may hold.
FEW_GLOBS = 100_000


def _met_paths(globbed: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(file_glob, file_path): globs with the distinct paths that they match, FEW_GLOBS of them at most in a broadcast."""
    globs = globbed.select("file_glob").distinct()
    n = globs.count()
    paths = nodes.select("file_path").where("file_path IS NOT NULL").distinct()
    met = None
    for i in range(-(-n // FEW_GLOBS)):
        part = globs.where(F.pmod(F.xxhash64("file_glob"), F.lit(-(-n // FEW_GLOBS))) == i).withColumn("pattern", ids.glob_regex("file_glob"))
        one = paths.join(F.broadcast(part), F.rlike("file_path", F.col("pattern"))).select("file_glob", "file_path")
        met = one if met is None else met.unionByName(one)
    return met


def _by_target(gold: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The gold rows that go by their node_id, else by their file_path, else by their file_glob."""
    rest = gold.where(_blank("node_id"))
    return gold.where(~_blank("node_id")), rest.where(~_blank("file_path")), rest.where(_blank("file_path") & ~_blank("file_glob"))


#: Nodes of a path that one part holds, and rows that it makes; paths with more are dealt out to several, so no task makes all their rows.
DEALT, MADE = 4096, 4_000_000


def targets(gold: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node_id, via): the nodes of each gold row, by its node_id, else by its file_path, else by its
    file_glob. Globs meet the distinct paths and only then nodes, in as many parts as the rows need that come of
    them: what is dealt out is small and would else be merged into few tasks.
    """
    own, by_path, globbed = _by_target(gold)
    by_id = own.select("id", "node_id").join(nodes.select("node_id"), "node_id", "left_semi").select("id", "node_id", F.lit("node_id").alias("via"))
    asked = by_path.select("id", "file_path", F.lit("file_path").alias("via"))
    met = _met_paths(globbed, nodes)
    if met is not None:
        asked = asked.unionByName(globbed.select("id", "file_glob").join(met, "file_glob").select("id", "file_path", F.lit("file_glob").alias("via")))
    count = lambda df, name: df.groupBy("file_path").agg(F.count(F.lit(1)).alias(name))
    paths = count(nodes, "n").join(count(asked, "times"), "file_path")
    needed = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / DEALT), F.ceil(F.col("n") * F.col("times") / MADE)))
    paths = cut(paths.select("file_path", needed.alias("parts"), (F.col("n") * F.col("times")).alias("rows")))
    rows = paths.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // MADE))
    frequent = paths.where("parts > 1").select("file_path", "parts")
    dealt = lambda df: df.join(F.broadcast(frequent), "file_path", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    asked = dealt(asked).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    held = dealt(nodes.select("node_id", "file_path")).select("node_id", "file_path", F.pmod(F.xxhash64("node_id"), "parts").alias("part"))
    at = lambda df: df.repartition(tasks, "file_path", "part")
    return by_id.unionByName(at(asked).join(at(held), ["file_path", "part"]).select("id", "node_id", "via"))


def benchmark(gold: DataFrame, nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    """(id, found, hit): whether any node of an active gold row exists, and whether any has an accepted
    block as its primary or a secondary one. assignments: node_id, primary_block, secondary.

    Whether a row hits depends on which blocks its nodes have, not on which of them has which: blocks are
    gathered once a path, then once a glob, and a gold row meets one set of blocks and none of its nodes.
    """
    rows = normalized(gold).where("status = 'active'")
    own, by_path, globbed = _by_target(rows)
    blocks = F.concat(F.array("primary_block"), F.coalesce(F.transform("secondary", lambda s: s["block"]), F.array().cast("array<string>")))
    known = nodes.select("node_id", "file_path").join(assignments.select("node_id", blocks.alias("blocks")), "node_id")
    union = lambda df, by: df.select(by, F.explode_outer("blocks").alias("block")).distinct().groupBy(by).agg(F.collect_set("block").alias("blocks"))
    of_path = union(known.where("file_path IS NOT NULL"), "file_path")
    met = own.select("id", "node_id").join(known.select("node_id", "blocks"), "node_id").select("id", "blocks")
    met = met.unionByName(by_path.select("id", "file_path").join(of_path, "file_path").select("id", "blocks"))
    paths = _met_paths(globbed, nodes)
    if paths is not None:
        met = met.unionByName(globbed.select("id", "file_glob").join(union(paths.join(of_path, "file_path"), "file_glob"), "file_glob").select("id", "blocks"))
    met = met.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(F.array_compact("blocks")))).alias("blocks"))
    hits = rows.select("id", F.array_compact("accepted_blocks").alias("accepted")).join(met, "id").groupBy("id").agg(F.max(F.arrays_overlap("accepted", "blocks")).alias("hit"))
    return rows.select("id").join(hits, "id", "left").select("id", F.col("hit").isNotNull().alias("found"), F.coalesce("hit", F.lit(False)).alias("hit"))


def benchmark_report(scored: DataFrame) -> DataFrame:
    out = scored.agg(F.count(F.lit(1)).alias("total"), F.count_if("found").alias("scorable"), F.count_if("hit").alias("correct"))
    return out.select("*", ids.ratio(F.col("correct"), F.col("total")).alias("accuracy"), ids.ratio(F.col("correct"), F.col("scorable")).alias("scorable_accuracy"), ids.ratio(F.col("total") - F.col("scorable"), F.col("total")).alias("missing_rate"))


def audit(gold: DataFrame) -> DataFrame:
    """One row of counts over gold rows: by status, duplicates (of ids, and of repository, target, block and
    status), contradictions, missing fields, invalid values, several labels; status pass or fail."""
    rows = normalized(gold)
    target = F.concat_ws(":", F.when(~_blank("node_id"), "node_id").when(~_blank("file_path"), "file_path").otherwise("file_glob"), F.coalesce(*(F.when(~_blank(c), F.col(c)) for c in ("node_id", "file_path", "file_glob")), F.lit("")))
    rows = rows.withColumn("target", target)
    active = F.col("status") == "active"
    missing = _blank("id") | _blank("primary_block") | _blank("confidence") | (_blank("node_id") & _blank("file_path") & _blank("file_glob"))
    invalid = ~F.col("status").isin(*STATUSES) | (~_blank("confidence") & ~F.col("confidence").isin(*CONFIDENCES)) | (~_blank("primary_block") & (F.size("accepted_blocks") > 0) & ~F.array_contains("accepted_blocks", F.col("primary_block")))
    several = (F.size("accepted_blocks") > 1) & (F.col("status") != "deprecated")
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(active).alias("active"), F.count_if(F.col("status") == "needs_review").alias("needs_review"), F.count_if(F.col("status") == "deprecated").alias("deprecated"),
        F.count_if(missing).alias("missing"), F.count_if(invalid).alias("invalid"), F.count_if(several).alias("multi_label"),
    )
    same_id = rows.where(~_blank("id")).groupBy("id").count().where("count > 1")
    same_row = rows.groupBy("repo_name", "target", "primary_block", "status").count().where("count > 1")
    apart = evaluation.contradictions(rows.where("status <> 'deprecated'").withColumn("target", F.concat_ws("\n", "repo_name", "target")))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = counts
    for one in (n(same_id, "same_id"), n(same_row, "same_row"), n(apart, "contradictions")):
        out = out.join(F.broadcast(one))  # one row each
    issues = F.col("same_id") + F.col("same_row") + F.col("contradictions") + F.col("missing") + F.col("invalid")
    return out.withColumn("status", F.when(issues == 0, "pass").otherwise("fail"))
