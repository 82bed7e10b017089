from __future__ import annotations

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from weft.sources import files, history, store
from weft.streaming import online


def test_upsert_replaces_one_repository(spark, tmp_path):
    cols = "repo_name string, node_id string, kind string, write_ord int"
    store.upsert(spark.createDataFrame([("r1", "a", "x", 1), ("r1", "a", "y", 2), ("r2", "b", "x", 1)], cols), str(tmp_path), "nodes")
    store.upsert(spark.createDataFrame([("r1", "c", "z", 1)], cols), str(tmp_path), "nodes")
    got = {(r.repo_name, r.node_id, r.kind) for r in store.read(spark, str(tmp_path), "nodes").collect()}
    assert got == {("r1", "c", "z"), ("r2", "b", "x")}
    assert store.read(spark, str(tmp_path), "nodes", "r2").count() == 1


def test_missing_json_is_empty(spark, tmp_path):
    assert store.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert store.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").where("a IS NOT NULL").count() == 2


def test_git_history_and_bad_repository(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (repo / "a.ts").write_text("x" * 200)
    git("add", "."), git("commit", "-qm", "one")
    git("mv", "a.ts", "b.ts"), git("commit", "-qm", "two")
    df = spark.createDataFrame([("r", str(repo)), ("bad", str(tmp_path / "none"))], "repo string, folder string")
    got = history.changed_files(df).collect()
    assert {(r.repo, r.status, r.path, r.ord) for r in got if r.error is None} == {("r", "R100", "b.ts", 0), ("r", "A", "a.ts", 1)}
    assert [r.repo for r in got if r.error] == ["bad"]
    rows = history.as_changes(history.changed_files(df))
    assert {(r.ord, r.status, r.path) for r in rows.collect()} == {(0, "D", "a.ts"), (0, "A", "b.ts"), (1, "A", "a.ts")}
    assert {(r.ord, r.path, r.status) for r in history.replay(rows).collect()} == {(1, "a.ts", "A"), (0, "b.ts", "A")}
    commits = spark.createDataFrame([("r", str(repo), "HEAD"), ("r", str(repo), "HEAD~1"), ("r", str(repo), "none")], "repo string, folder string, ref string")
    listed = history.files_at(commits).collect()
    assert {(r.ref, r.path) for r in listed if r.error is None} == {("HEAD", "b.ts"), ("HEAD~1", "a.ts")} and len(listed) == 3


def test_replay_equals_a_walk_over_commits(spark):
    rnd = random.Random(5)
    rows, wanted, counts = [], set(), set()
    for repo in ("r", "s"):
        alive = {}
        for ord_ in range(150, -1, -1):
            before = set(alive)
            for path in rnd.sample("abcdefgh", rnd.randint(1, 3)):
                kinds = [rnd.choice(["A", "M", "D", "R100"])] if rnd.random() < 0.9 else ["D", "A"]
                rows += [(repo, ord_, k, path) for k in kinds]
                kept = [k for k in kinds if k != "D"]
                alive.pop(path, None)
                if kept:
                    alive[path] = kept[0]
            wanted |= {(repo, ord_, p, s) for p, s in alive.items()}
            counts.add((repo, ord_, len(alive), len(set(alive) - before), len(before - set(alive))))
    log = spark.createDataFrame(rows, "repo string, ord int, status string, path string")
    assert set(map(tuple, history.replay(log).collect())) == wanted
    refs = spark.createDataFrame([("r", 7), ("s", 100), ("s", 0), ("none", 1)], "repo string, ord int")
    assert set(map(tuple, history.replay(log, refs).collect())) == {x for x in wanted if x[:2] in {("r", 7), ("s", 100), ("s", 0)}}
    assert set(map(tuple, history.replayed_counts(log).collect())) == counts
    paths = spark.createDataFrame([("src/a.ts",), ("x/build/a.ts",), ("yarn.lock",), ("d\\dist\\b.ts",), ("a.svg",)], "path string")
    assert [r.path for r in paths.where(history.architectural("path")).collect()] == ["src/a.ts"]


def test_source_files_are_those_of_known_suffixes(spark, tmp_path):
    for name in ("vendor/a.ts", "target/b.PY", "coverage/c.hpp", "node_modules/d.ts", ".tox/e.py", "mine/f.js", "g.txt", "h.cjs", "bad.go"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"ok\xff\xfe!" if name == "bad.go" else "é\uFFFD".encode())
    got = files.source_files(spark, str(tmp_path), "r", ignored=["mine"]).collect()
    assert {r.path: (r.language, r.content) for r in got} == {"vendor/a.ts": ("typescript", "é\uFFFD"), "target/b.PY": ("python", "é\uFFFD"), "coverage/c.hpp": ("cpp", "é\uFFFD"), "h.cjs": ("javascript", "é\uFFFD"), "bad.go": ("go", "ok!")}
    with pytest.raises(ValueError, match="allowed"):
        files.source_files(spark, str(tmp_path), "r", most=2)


def test_imports_resolve_by_a_join(spark):
    rows = [("r", "src/a.ts", "typescript", 1, "import x from './b'\nimport y from '../lib'\nimport z from 'lodash/fp'"), ("r", "src/b.ts", "typescript", 1, ""), ("r", "lib/index.ts", "typescript", 1, ""), ("r", "p/m.py", "python", 1, "from .n import k\nimport os.path")]
    rows.append(("r", "p/n.py", "python", 1, ""))
    df = spark.createDataFrame(rows, "repo_name string, path string, language string, size long, content string")
    got = {(r.source_id, r.target_id, r.edge_type) for r in files.import_edges(df).collect()}
    u = "repo://r/"
    assert got == {(u + "src/a.ts", u + "src/b.ts", "DEPENDS_ON_FILE"), (u + "src/a.ts", u + "lib/index.ts", "DEPENDS_ON_FILE"), (u + "src/a.ts", "module:lodash", "IMPORTS_MODULE"), (u + "p/m.py", u + "p/n.py", "DEPENDS_ON_FILE"), (u + "p/m.py", "module:os", "IMPORTS_MODULE")}


def test_streamed_churn_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"ts": f"2024-01-0{d} 0{h}:00:00", "block": b} for d in (1, 2, 3) for h in (1, 2) for b in "ab"]
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    stream = online.ledger(spark, str(tmp_path / "in"), "ts timestamp, block string")
    online.into_table(online.churn_by_window(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("block").agg(F.sum("changes").alias("n")).collect()
    assert {r.block: r.n for r in got} == {"a": 4, "b": 4}  # the last day is still open
