"""Version history as tables: commits and changed files from git, one repository per task."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMMITS = "repo string, sha string, authored_at string, subject string, ord int, status string, old_path string, path string, error string"


def _git(folder: str, *args: str) -> str:
    return subprocess.run(["git", "-C", folder, *args], check=True, capture_output=True, text=True, errors="replace").stdout


def _changes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in COMMITS.split(", ")]
    for batch in batches:
        for repo, folder in zip(batch.column("repo").to_pylist(), batch.column("folder").to_pylist(), strict=True):
            rows = []
            try:
                log = _git(folder, "log", f"-n{most}", "--name-status", "--find-renames", "--format=%x1e%H%x1f%aI%x1f%s")
                for ord_, entry in enumerate(e for e in log.split("\x1e") if e.strip()):
                    head, *files = entry.strip("\n").split("\n")
                    sha, at, subject = head.split("\x1f", 2)
                    for line in filter(None, files):
                        status, *paths = line.split("\t")
                        rows.append((repo, sha, at, subject, ord_, status, paths[0] if len(paths) > 1 else None, paths[-1], None))
            except (subprocess.CalledProcessError, OSError) as e:  # a bad repository is a row, not a failed job
                rows.append((repo, *[None] * 7, str(e)[:500]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if n == "ord" else pa.string()) for i, n in enumerate(names)], names=names)


def changed_files(repositories: DataFrame, most: int = 50) -> DataFrame:
    """Changed files of the last commits of repositories (repo, folder), newest first; raw statuses.

    folder must be readable where the task runs.
    """
    return repositories.select("repo", "folder").mapInArrow(lambda batches: _changes(batches, most), COMMITS)


def as_changes(files: DataFrame) -> DataFrame:
    """Renames (R) as a deletion of old_path and an addition of path; other statuses stay."""
    row = lambda status, path: F.struct(status.alias("status"), F.translate(path, "\\", "/").alias("path"))
    moved = F.array(row(F.lit("D"), F.col("old_path")), row(F.lit("A"), F.col("path")))
    rows = F.when(F.col("status").startswith("R") & F.col("old_path").isNotNull(), moved).otherwise(F.array(row(F.col("status"), F.col("path"))))
    return files.where("error IS NULL").withColumn("row", F.explode(rows)).drop("status", "path", "old_path", "error").select("*", "row.status", "row.path").drop("row")


TREE = "repo string, ref string, path string, error string"


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for repo, folder, ref in zip(*(batch.column(c).to_pylist() for c in ("repo", "folder", "ref")), strict=True):
            try:
                rows = [(repo, ref, p.replace("\\", "/"), None) for p in _git(folder, "ls-tree", "-r", "--name-only", ref).splitlines() if p.strip()]
            except (subprocess.CalledProcessError, OSError) as e:
                rows = [(repo, ref, None, str(e)[:500])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["repo", "ref", "path", "error"])


def files_at(commits: DataFrame) -> DataFrame:
    """(repo, ref, path, error): the files of each commit; commits: repo, folder, ref. One task lists one
    commit, so the commits of a long history are listed by many tasks."""
    return commits.select("repo", "folder", "ref").repartition("repo", "ref").mapInArrow(_tree, TREE)


def intervals(changes: DataFrame) -> DataFrame:
    """(repo, path, status, since, until): each stretch of commits in which a path exists: from the commit
    ``since``, at which it got ``status``, to before the commit ``until``; null if it still exists. From the
    changes (repo, ord, status, path) of a history; ord counts back from the newest commit, at 0. Of
    several changes of a path in a commit, as of renames, one that isn't a deletion counts."""
    gone = F.substring("status", 1, 1) == "D"
    each = changes.groupBy("repo", "path", "ord").agg(F.min_by("status", F.struct(gone, "status")).alias("status"))
    w = Window.partitionBy("repo", "path").orderBy(F.desc("ord"))
    stretches = each.withColumn("until", F.lead("ord").over(w)).where(~gone)
    return stretches.select("repo", "path", "status", F.col("ord").alias("since"), "until")


def replay(changes: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(repo, ord, path, status): the files that exist after each commit of a history, with the status that
    they got last, from its changes (repo, ord, status, path). refs: repo, ord of the commits that are wanted, else all.

    A stretch in which a file exists is dealt out to its commits, so one shuffle by path is all; with
    refs it meets those of its repository in bins of 64 commits.
    """
    stretches = intervals(changes).withColumn("last", F.coalesce(F.col("until") + 1, F.lit(0)))
    if refs is None:
        return stretches.select("repo", F.explode(F.sequence("last", "since")).alias("ord"), "path", "status")
    size = 64
    bins = lambda c: F.floor(F.col(c) / size)
    binned = stretches.withColumn("bin", F.explode(F.sequence(bins("last"), bins("since"))))
    wanted = refs.select("repo", "ord").distinct().withColumn("bin", bins("ord"))
    return binned.join(wanted, ["repo", "bin"]).where("ord BETWEEN last AND since").select("repo", "ord", "path", "status")


def replayed_counts(changes: DataFrame) -> DataFrame:
    """(repo, ord, files, added, gone): how many files exist after each commit that changes any, and how many it
    adds and deletes; a running sum over a repository's commits, without listing files."""
    stretches = intervals(changes)
    w = Window.partitionBy("repo", "path").orderBy(F.desc("since"))
    begun = F.lag("until").over(w)
    begins = stretches.withColumn("fresh", begun.isNull() | (begun != F.col("since"))).where("fresh").select("repo", F.col("since").alias("ord"), F.lit(1).alias("a"), F.lit(0).alias("d"))
    following = F.lead("since").over(w)
    ends = stretches.withColumn("over", F.col("until").isNotNull() & (following.isNull() | (following != F.col("until")))).where("over").select("repo", F.col("until").alias("ord"), F.lit(0).alias("a"), F.lit(1).alias("d"))
    touched = changes.select("repo", "ord", F.lit(0).alias("a"), F.lit(0).alias("d"))
    each = begins.unionByName(ends).unionByName(touched).groupBy("repo", "ord").agg(F.sum("a").alias("added"), F.sum("d").alias("gone"))
    running = Window.partitionBy("repo").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    return each.select("repo", "ord", F.sum(F.col("added") - F.col("gone")).over(running).alias("files"), "added", "gone")


#: Parts of a path, and suffixes, of files that don't count for the architecture (fixed values).
IGNORED_PARTS = (".git", "node_modules", "dist", "build", ".next", ".turbo", "__pycache__")
IGNORED_SUFFIXES = (".lock", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".map")


def architectural(path: Column | str) -> Column:
    """Whether a path counts for the architecture."""
    plain = F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/")
    inside = F.arrays_overlap(F.split(plain, "/"), F.array(*(F.lit(p) for p in IGNORED_PARTS)))
    return ~inside & ~reduce(Column.__or__, (plain.endswith(x) for x in IGNORED_SUFFIXES))
