"""History operators: snapshots, diffs, churn, hot spots, drift, metrics, gates.

changes: repo, day, path, block. snapshots: repo, day, path, block (a file's blocks on a day). Days are
whatever orders the states of a repository; histories of different repositories never mix.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def churn(changes: DataFrame) -> DataFrame:
    """(block, changes): how many distinct (repo, day, path) touch each block."""
    return changes.select("repo", "day", "path", "block").distinct().groupBy("block").agg(F.count(F.lit(1)).alias("changes"))


def hotspots(changes: DataFrame, top: int = 100) -> DataFrame:
    """(repo, path, changes): the files that change most."""
    counts = changes.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("changes"))
    return counts.orderBy(F.desc("changes"), "repo", "path").limit(top)


def hotspot_share(changes: DataFrame) -> DataFrame:
    """(repo, top, total, concentration): the largest path's share of a repository's changes."""
    counts = changes.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("repo").agg(F.max("n").alias("top"), F.sum("n").alias("total")).withColumn("concentration", F.coalesce(F.try_divide(F.col("top").cast("double"), F.col("total").cast("double")), F.lit(0.0)))


def snapshots(changes: DataFrame) -> DataFrame:
    return changes.select("repo", "day", "path", "block").distinct()


def snapshot_at(snaps: DataFrame, day: str) -> DataFrame:
    """The snapshot of every repository on its last day up to ``day``."""
    upto = snaps.where(F.col("day") <= day)
    last = upto.groupBy("repo").agg(F.max("day").alias("day"))
    return upto.join(last, ["repo", "day"], "left_semi")


def block_files(snaps: DataFrame) -> DataFrame:
    """(repo, day, block, files): how many files have each block in each snapshot."""
    return snaps.groupBy("repo", "day", "block").agg(F.count(F.lit(1)).alias("files"))


def day_pairs(days: DataFrame) -> DataFrame:
    """(repo, before, after): consecutive days of each repository."""
    each = Window.partitionBy("repo").orderBy("day")
    return days.select("repo", "day").distinct().withColumn("before", F.lag("day").over(each)).where("before IS NOT NULL").select("repo", "before", F.col("day").alias("after"))


def _sides(snaps: DataFrame) -> DataFrame:
    """(repo, before, after, path, block, new): each row of a snapshot as 'after' on its day, and as 'before'
    on the next."""
    pairs = day_pairs(snaps)
    after = snaps.withColumnRenamed("day", "after").join(pairs, ["repo", "after"]).withColumn("new", F.lit(True))
    before = snaps.withColumnRenamed("day", "before").join(pairs, ["repo", "before"]).withColumn("new", F.lit(False))
    return after.unionByName(before)


def diff(snaps: DataFrame) -> DataFrame:
    """(repo, before, after, path, status, before_blocks, after_blocks) of every consecutive pair of days;
    block sets joined by commas; paths whose blocks stay the same are left out. One aggregation aligns
    all pairs, so no day is gathered anywhere.
    """
    blocks = lambda new: F.array_join(F.sort_array(F.collect_set(F.when(F.col("new") == new, F.col("block")))), ",")
    sets = _sides(snaps).groupBy("repo", "before", "after", "path").agg(blocks(False).alias("before_blocks"), blocks(True).alias("after_blocks"))
    status = F.when(F.col("before_blocks") == "", "A").when(F.col("after_blocks") == "", "D").otherwise("M")
    return sets.where("before_blocks <> after_blocks").withColumn("status", status)


def block_delta(snaps: DataFrame) -> DataFrame:
    """(repo, before, after, block, delta): signed change of each block's file count; zeros left out."""
    signed = F.sum(F.when(F.col("new"), 1).otherwise(-1)).alias("delta")
    return _sides(snaps).groupBy("repo", "before", "after", "block").agg(signed).where("delta <> 0")


def accumulated_delta(snaps: DataFrame) -> DataFrame:
    """(repo, after, block, total): the deltas of a block added up over the days, from the first one on."""
    upto = Window.partitionBy("repo", "block").orderBy("after").rowsBetween(Window.unboundedPreceding, 0)
    return block_delta(snaps).select("repo", "after", "block", F.sum("delta").over(upto).alias("total"))


def temporal_metrics(diffs: DataFrame) -> DataFrame:
    """Per repository and pair of days: changed files, drifted ones (blocks differ), drift rate, mean coupling."""
    both = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, ",")))
    out = diffs.groupBy("repo", "before", "after").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "M").alias("drifted"), F.sum(F.greatest(both("before_blocks"), both("after_blocks"))).alias("coupling_sum"))
    return out.withColumn("drift_rate", F.col("drifted").cast("double") / F.col("files")).withColumn("coupling", F.col("coupling_sum").cast("double") / F.col("files")).drop("coupling_sum")


def success_index(diffs: DataFrame) -> DataFrame:
    """(repo, block, activity, drift, success): 1 - drift / activity for every block that a diff touches."""
    touched = diffs.withColumn("block", F.explode(F.array_distinct(F.filter(F.split(F.concat_ws(",", "before_blocks", "after_blocks"), ","), lambda x: x != ""))))
    out = touched.groupBy("repo", "block").agg(F.count(F.lit(1)).alias("activity"), F.count_if(F.col("status") == "M").alias("drift"))
    return out.withColumn("success", 1 - F.col("drift").cast("double") / F.col("activity"))


def history_report(snaps: DataFrame) -> DataFrame:
    """(repo, metric, key, value): of each repository its blocks' net change and that by pair of days, its drift rate,
    how much of what changes is one file, and how risk accumulates: both together, 1 at most."""
    diffs = diff(snaps)
    row = lambda df, metric, key, value: df.select("repo", F.lit(metric).alias("metric"), key.alias("key"), F.round(value.cast("double"), 4).alias("value"))
    none = F.lit("")
    pairs = day_pairs(snaps).groupBy("repo").agg(F.count(F.lit(1)).alias("pairs"))
    net = block_delta(snaps).groupBy("repo", "block").agg(F.sum("delta").alias("total")).join(pairs, "repo")
    changed = diffs.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before_blocks") != F.col("after_blocks")).alias("d"))
    sums = changed.groupBy("repo").agg(F.sum("n").alias("files"), F.sum("d").alias("drifted"), F.max("n").alias("top"))
    rate, share = F.col("drifted") / F.col("files"), F.col("top") / F.col("files")
    return (
        row(net, "block_delta_total", F.col("block"), F.col("total")).unionByName(row(net, "block_churn_rate", F.col("block"), F.abs("total") / F.col("pairs")))
        .unionByName(row(sums, "architectural_drift_candidate_rate", none, rate)).unionByName(row(sums, "hotspot_concentration", none, share))
        .unionByName(row(sums, "regret_accumulation_score", none, F.least(F.lit(1.0), rate + share)))
    )


def direct_drift(diffs: DataFrame) -> DataFrame:
    """Files present on both sides whose blocks differ, at confidence 0.9."""
    return diffs.where("status = 'M'").select("repo", "before", "after", "path", "before_blocks", "after_blocks", F.lit(0.9).alias("confidence"))


_DIFF = ["repo", "before", "after"]


def _stem(name: Column) -> Column:
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


_MOVES = "repo {0}, before {1}, after {2}, old_path string, path string, before_blocks string, after_blocks string"


class _Free:
    """The deletions of one diff that are still free, by what an addition may share with them."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.blocks: list[str] = []
        self.taken = bytearray()
        self.lists: dict[tuple, list] = {}  # what is shared: place of the first that may be free, deletions in order

    @staticmethod
    def keys(name: str, stem: str, blocks: str) -> Iterator[tuple[int, tuple]]:
        """The lists of a file with the score of a match by them: its name (5: name 3, stem 2), its stem (2), each
        of its blocks (1), and a block with its name or stem."""
        yield 5, ("n", name)
        yield 2, ("s", stem)
        for b in dict.fromkeys(filter(None, blocks.split(","))):
            yield 6, ("n", name, b)
            yield 3, ("s", stem, b)
            yield 1, ("b", b)

    def add(self, path: str, name: str, stem: str, blocks: str) -> None:
        for _, key in self.keys(name, stem, blocks):
            self.lists.setdefault(key, [0, array("l")])[1].append(len(self.paths))
        self.paths.append(path)
        self.blocks.append(blocks)
        self.taken.append(0)

    def best(self, name: str, stem: str, blocks: str) -> int | None:
        found = None
        for score, key in self.keys(name, stem, blocks):
            waiting = self.lists.get(key)
            if waiting is None:
                continue
            at, places = waiting
            while at < len(places) and self.taken[places[at]]:
                at += 1
            waiting[0] = at
            if at < len(places) and (found is None or (-score, places[at]) < found):
                found = (-score, places[at])
        return found and found[1]


def _moved(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows by diff, its deletions before its additions, each by path."""
    diff, free = None, _Free()
    for batch in batches:
        out = []
        for *key, _adds, path, name, stem, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != diff:
                diff, free = key, _Free()
            if not _adds:
                free.add(path, name, stem, blocks)
            elif (i := free.best(name, stem, blocks)) is not None and free.blocks[i] != blocks:
                free.taken[i] = 1
                out.append((*key, free.paths[i], path, free.blocks[i], blocks))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def move_drift(diffs: DataFrame) -> DataFrame:
    """Moves: each added file, by path, takes the best-scored deleted file still free (same name 5, same
    stem 2, a common block 1 more), ties by path; it is a move if their blocks differ, and only then is
    the deleted file taken.

    What an addition takes depends on all before it, so a diff goes in order: Spark deals diffs out and sorts
    each, deletions first; additions stream past. A task holds the deletions of one diff at a time, and a
    list never looks twice at one that is taken, so time grows with a diff's files and their blocks.
    """
    added = F.col("status") == "A"
    blocks = F.when(added, F.col("after_blocks")).otherwise(F.col("before_blocks"))
    name = F.element_at(F.split("path", "/"), -1)
    files = diffs.where(F.col("status").isin("A", "D") & (blocks != "")).dropna(subset=[*_DIFF, "path"])
    files = files.select(*_DIFF, added.alias("adds"), "path", name.alias("name"), _stem(name).alias("stem"), blocks.alias("blocks"))
    out = _MOVES.format(*(files.schema[c].dataType.simpleString() for c in _DIFF))
    schema = to_arrow_schema(StructType.fromDDL(out))
    sorted_ = files.repartition(*_DIFF).sortWithinPartitions(*_DIFF, "adds", "path")
    return sorted_.mapInArrow(lambda batches: _moved(batches, schema), out).withColumn("confidence", F.lit(0.82))


def known_changes_gate(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(status, missing, unexpected) of two sets of rows with the same columns."""
    lost = expected.exceptAll(found).select(F.lit(1).alias("m"), F.lit(0).alias("u"))
    more = found.exceptAll(expected).select(F.lit(0).alias("m"), F.lit(1).alias("u"))
    out = lost.unionByName(more).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("missing"), F.coalesce(F.sum("u"), F.lit(0)).alias("unexpected"))
    return out.withColumn("status", F.when((F.col("missing") == 0) & (F.col("unexpected") == 0), "pass").otherwise("fail"))


def precision_recall(found: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """(hits, found, expected, precision, recall) over distinct keys."""
    f, e = found.select(*key).distinct(), expected.select(*key).distinct()
    sides = f.withColumn("f", F.lit(1)).join(e.withColumn("e", F.lit(1)), key, "full")
    out = sides.agg(F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull()).alias("hits"), F.count("f").alias("found"), F.count("e").alias("expected"))
    part = lambda d: F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col(d).cast("double")), F.lit(0.0))
    return out.withColumn("precision", part("found")).withColumn("recall", part("expected"))


def requests_in_window(events: DataFrame, seconds: int = 60) -> DataFrame:
    """(user_id, event_id, recent): each user's events in the ``seconds`` up to and with this one."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.select("user_id", "event_id", F.count(F.lit(1)).over(w).alias("recent"))


def last_n(events: DataFrame, n: int, by: str = "user_id") -> DataFrame:
    """The last n events of each group, with their rank from the end."""
    w = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
