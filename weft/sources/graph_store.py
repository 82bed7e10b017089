"""A graph store on Parquet: a log of upserts, deletions and cleared repositories, merged when it is read.

A write is a commit: its rows go to folders of their own for each table, and then a marker, which is
created only if there is none of that number, makes all of them visible at once. What a failed write
leaves has no marker and is never read; writing again gives the same store. Of equal keys the row of the
last commit counts, unless that deletes it or a later commit clears its repository. ``compact`` writes the merged
tables as one commit, from which readers start; ``vacuum`` deletes what is older.

Rows are dealt by repository and by a hash of their key's first column into BUCKETS folders, so a
look-up by id reads the files of one bucket (of one repository, if it is named); within files they are sorted by
that column, and Bloom filters on ids let row groups be skipped for the other end of an edge.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import ids
from weft.sources.store import modules

BUCKETS = 16
#: Tables, the columns that key their rows within a repository, and the ids that have Bloom filters.
TABLES = {
    "projects": (("node_id",), ()),
    "files": (("node_id",), ("node_id",)),
    "code": (("node_id",), ("node_id",)),
    "edges": (("source_id", "target_id", "edge_type"), ("source_id", "target_id")),
    "modules": (("package_ref",), ()),
    "assignments": (("node_id", "primary_block"), ("node_id",)),
    "temporal": (("record_key",), ()),
}


@dataclass(frozen=True)
class Commit:
    seq: int
    tables: tuple[str, ...]
    cleared: tuple[str, ...] = ()
    base: bool = False


def bucket(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(BUCKETS)).cast("int")


class GraphStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def commits(self) -> list[Commit]:
        """The commits that count, in order: from the last compaction on."""
        files, at = self._at("_commits")
        if not files.exists(at):
            return []
        names = sorted(x.getPath().getName() for x in files.listStatus(at) if x.getPath().getName().endswith(".json"))
        out: list[Commit] = []
        for name in reversed(names):
            stream = files.open(self._at(f"_commits/{name}")[1])
            try:
                text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            x = json.loads(text)
            out.append(Commit(x["seq"], tuple(x["tables"]), tuple(x["cleared"]), x["base"]))
            if x["base"]:
                break
        return out[::-1]

    def write(self, rows: dict[str, DataFrame], cleared: tuple[str, ...] = (), dropped: dict[str, DataFrame] | None = None, base: bool = False) -> int:
        """Commits rows by table (with repo_name), keys to delete by table, and repositories whose earlier rows go.
        Returns the commit's number; another writer that takes the number first makes this one fail."""
        seq = max((c.seq for c in self.commits()), default=-1) + 1
        parts: dict[str, list[DataFrame]] = {}
        for name, df in rows.items():
            parts.setdefault(name, []).append(df.withColumn("op", F.lit("put")))
        for name, df in (dropped or {}).items():
            parts.setdefault(name, []).append(df.select("repo_name", *TABLES[name][0]).withColumn("op", F.lit("drop")))
        for name, some in parts.items():
            keys, blooms = TABLES[name]
            every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some).withColumn("bucket", bucket(keys[0]))
            out = every.repartition("repo_name", "bucket").sortWithinPartitions("repo_name", "bucket", *keys).write.mode("overwrite").partitionBy("repo_name", "bucket")
            for column in blooms:
                out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
            out.parquet(f"{self.root}/{name}/seq={seq}")
        files, at = self._at(f"_commits/{seq:012d}.json")
        stream = files.create(at, False)
        try:
            stream.write(bytearray(json.dumps({"seq": seq, "tables": sorted(parts), "cleared": list(cleared), "base": base}).encode()))
        finally:
            stream.close()
        return seq

    def _log(self, name: str) -> DataFrame | None:
        """The rows that may count, with seq and op."""
        commits = self.commits()
        paths = [f"{self.root}/{name}/seq={c.seq}" for c in commits if name in c.tables]
        if not paths:
            return None
        log = self.spark.read.option("basePath", f"{self.root}/{name}").option("mergeSchema", "true").parquet(*paths)
        log = log.withColumn("repo_name", F.col("repo_name").cast("string"))
        last = {repo: c.seq for c in commits for repo in c.cleared}  # a line for each repository cleared since the compaction
        if last:
            gone = self.spark.createDataFrame(list(last.items()), "repo_name string, since int")
            log = log.join(F.broadcast(gone), "repo_name", "left").where("since IS NULL OR seq >= since").drop("since")
        return log

    def read(self, name: str, repo: str | None = None, key: str | None = None) -> DataFrame:
        """A table as it is now; repo and key (of the first key column) read only what may hold them. A table that
        was never written has its keys and no rows."""
        keys = TABLES[name][0]
        log = self._log(name)
        if log is None:
            return self.spark.createDataFrame([], "repo_name string, " + ", ".join(f"{k} string" for k in keys))
        if repo is not None:
            log = log.where(F.col("repo_name") == repo)
        if key is not None:
            log = log.where((F.col("bucket") == bucket(F.lit(key))) & (F.col(keys[0]) == key))
        columns = [c for c in log.columns if c not in ("seq", "op", "bucket")]
        rest = [c for c in columns if c not in ("repo_name", *keys)]
        last = log.groupBy("repo_name", *keys).agg(F.max_by(F.struct("op", *rest), F.struct("seq", "op")).alias("x"))
        return last.where("x.op = 'put'").select("repo_name", *keys, *(f"x.{c}" for c in rest))

    def lookup(self, node_id: str, repo: str | None = None) -> DataFrame:
        return self.read("code", repo, node_id)

    def incident(self, node_id: str, repo: str | None = None) -> DataFrame:
        """Edges that leave a node, from one bucket, and edges that lead to it."""
        to = self.read("edges", repo).where(F.col("target_id") == node_id)
        return self.read("edges", repo, node_id).unionByName(to).distinct()

    def load(self, repo: str, nodes: DataFrame, edges: DataFrame, assignments: DataFrame | None = None, clear: bool = True) -> int:
        """Replaces (or, without ``clear``, upserts) a repository: nodes (node_id, layer, ...) as projects, files and
        code, edges with their provenance, the modules they import, and assignments with their blocks."""
        with_repo = lambda df: df.withColumn("repo_name", F.lit(repo))
        provenance = F.coalesce("provenance", F.lit("structural")) if "provenance" in edges.columns else F.lit("structural")
        rows = {name: with_repo(nodes.where(F.col("layer") == layer)) for name, layer in (("projects", "project"), ("files", "file"), ("code", "code"))}
        rows["edges"] = with_repo(edges.withColumn("provenance", provenance)).withColumn("record_id", ids.record_id("repo_name", "source_id", "target_id", "edge_type"))
        rows["modules"] = with_repo(modules(edges).withColumnRenamed("node_id", "package_ref"))
        if assignments is not None:
            rows["assignments"] = with_repo(assignments)
        keyed = {name: df.dropDuplicates(["repo_name", *TABLES[name][0]]) for name, df in rows.items()}
        return self.write(keyed, (repo,) if clear else ())

    def blocks(self) -> DataFrame:
        """(label): the blocks that are assigned anywhere."""
        return self.read("assignments").select(F.col("primary_block").alias("label")).distinct()

    def persist_history(self, repo: str, snapshots: DataFrame, diffs: DataFrame, summary: DataFrame) -> int:
        """Replaces a repository's history: snapshots (commit_sha, ...), diffs (before_sha, after_sha, ...) and a summary of one
        row (commit_sha, ...) as records of their kind, their figures as JSON."""
        def record(df: DataFrame, kind: str, key: Column, sha: str) -> DataFrame:
            return df.select(F.lit(repo).alias("repo_name"), F.concat(F.lit(f"{repo}:{kind}:"), key).alias("record_key"), F.lit(kind).alias("record_kind"), F.col(sha).alias("commit_sha"), F.to_json(F.struct("*")).alias("figures"))

        between = F.concat("before_sha", F.lit(":"), "after_sha")
        parts = [record(snapshots, "snapshot", F.col("commit_sha"), "commit_sha"), record(diffs, "diff", between, "after_sha"), record(summary, "summary", F.coalesce("commit_sha", F.lit("empty")), "commit_sha")]
        log = self._log("temporal")
        old = None if log is None else self.read("temporal", repo).select("repo_name", "record_key")
        new = reduce(DataFrame.unionByName, parts)
        return self.write({"temporal": new}, dropped=None if old is None else {"temporal": old.join(new, "record_key", "left_anti")})

    def delete(self, name: str, keys: DataFrame) -> int:
        """Deletes rows by key (repo_name and the table's keys)."""
        return self.write({}, dropped={name: keys})

    def clear(self, repo: str) -> int:
        return self.write({}, (repo,))

    def compact(self) -> int:
        """Writes all tables as they are now in one commit from which readers start."""
        return self.write({name: self.read(name) for name in TABLES if self._log(name) is not None}, base=True)

    def vacuum(self) -> None:
        """Deletes the folders and markers of commits before the last compaction, and of writes that failed."""
        known = {c.seq for c in self.commits()}
        least = min(known, default=0)
        for name in TABLES:
            files, at = self._at(name)
            for x in files.listStatus(at) if files.exists(at) else ():
                seq = x.getPath().getName().removeprefix("seq=")
                if seq.isdigit() and (int(seq) < least or (int(seq) < max(known, default=0) and int(seq) not in known)):
                    files.delete(x.getPath(), True)
        files, at = self._at("_commits")
        for x in files.listStatus(at) if files.exists(at) else ():
            if int(x.getPath().getName().split(".")[0]) < least:
                files.delete(x.getPath(), False)
