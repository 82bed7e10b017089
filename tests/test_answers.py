"""Questions as a table, and many patterns in one pass."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.operators import answers, correlate, evidence, patterns, retrieval
from weft.plans import adapters as A

DATA = "/root/testdata/sf0.001"
ASKED = ["how does the auth guard check a session token before the database store is read", "which login page shows a profile", "what does the queue worker cache", "where is the quantum entanglement", "log a secret hash for each request"]


def test_many_answers_equal_one_by_one(spark):
    nodes, assigned = A.text_nodes(spark, DATA).cache(), A.text_assignments(spark, DATA).cache()
    questions = spark.createDataFrame([(i, ASKED[i % len(ASKED)]) for i in range(12)], "id int, question string")
    got = {}
    for r in answers.block_answers(nodes, assigned, questions).collect():
        got.setdefault(r.id, []).append((r.ord, r.block, r.node_id, r.kind, round(r.score, 9), sorted(r.blocks)))
    assert len(got) > 5
    for i in range(len(ASKED)):
        if not evidence.plan_question(ASKED[i]).blocks:
            assert i not in got
            continue
        want = sorted((r.ord, r.block, r.node_id, r.kind, round(r.score, 9), sorted(r.blocks)) for r in evidence.answer(nodes, assigned, ASKED[i]).collect())
        assert sorted(got.get(i, [])) == want
        assert all(sorted(got.get(j, [])) == want for j in range(i, 12, len(ASKED)))


def test_every_route_is_answered(spark):
    nodes = spark.createDataFrame([("n1", "function", "sessionGuard", "auth.ts", "session"), ("n2", "function", "pay", "pay.ts", "invoice creation"), ("n3", "class", "Widget", "widget.ts", "the widget component")], "node_id string, kind string, label string, file_path string, content string")
    assigned = spark.createDataFrame([("n1", "Access Control", 0.9, "", [])], "node_id string, primary_block string, confidence double, reasoning string, secondary array<struct<block:string,confidence:double>>")
    entities = spark.createDataFrame([("e1", "invoice", "domain", None), ("e2", "order", None, None)], "entity_id string, name string, category string, description string")
    actions = spark.createDataFrame([("e1", "n2", "persist"), ("e1", "n1", "create"), ("e1", "n3", "odd"), ("e1", "n4", "render"), ("e2", "n1", "create")], "entity_id string, node_id string, action string")
    projects = spark.createDataFrame([("project:x", "x", "org/x", None)], "project_id string, name string, repo_name string, text string")
    questions = spark.createDataFrame([(1, "who guards the session"), (2, "invoice creation"), (3, "which widget component of the repository x"), (4, "zzz"), (5, "deletion of qqq"), (6, "qqq repositories")], "id int, question string")
    rows = answers.answer_many(nodes, assigned, entities, actions, projects, questions).collect()
    got = {}
    for r in rows:
        got.setdefault((r.id, r.route), []).append((r.ord, r.node_id, r.file_path))
    assert got[1, "answer_with_evidence"] == [(0, "n1", "auth.ts")]
    assert sorted(got[2, "trace_entity_workflow"]) == [(0, "n1", "auth.ts"), (1, "n2", "pay.ts"), (2, "n3", "widget.ts")]  # create, persist, others
    assert got[4, "unsupported"] == [(None, None, None)] and got[5, "trace_entity_workflow"] == [(None, None, None)]
    asked = questions.where("id IN (2, 5)")
    steps, bundles = answers.workflow_answers(entities, actions, asked)
    assert {(r.id, round(r.confidence, 2)) for r in bundles.collect()} == {(2, 0.75), (5, 0.2)} and steps.count() == 3
    found, about = answers.project_answers(projects, nodes, questions.where("id IN (3, 6)"))
    assert [(r.id, r.ord, r.node_id) for r in found.collect()][0] == (3, 0, "n3")
    assert {(r.id, r.project_id, r.claim.split(" ")[0]) for r in about.collect()} == {(3, "project:x", "Project"), (6, None, "No")}


def test_workflow_scores_equal_one_question_at_a_time(spark):
    entities = spark.createDataFrame([(i, f"entity{i % 7} of {w}") for i, w in enumerate(["pay", "login", "order", "cart", "entity"] * 6)], "entity_id int, name string")
    actions = spark.createDataFrame([(i % 30, f"n{i}", "create") for i in range(70)], "entity_id int, node_id string, action string")
    for q in ("entity3 of pay pay", "the order", "of", "Entity0 of Pay"):
        one = spark.createDataFrame([(0, q)], "id int, question string")
        n = actions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
        got = {r.entity_id: r.lexical + 0.2 * min(r.n or 0, 5) for r in answers.text_scores(entities.withColumnRenamed("name", "text"), "entity_id", one).join(n, "entity_id", "left").collect()}
        assert got == {r.entity_id: r.score for r in retrieval.entity_rank(entities, actions, q, 100).collect()}


@pytest.mark.parametrize("most", [200_000, 7])
def test_patterns_are_found_in_one_pass(spark, monkeypatch, most):
    monkeypatch.setattr(patterns, "MOST", most)
    rnd = random.Random(1)
    some = {"".join(rnd.choice("abé ") for _ in range(rnd.randint(1, 4))) for _ in range(40)}
    texts = [(i, None if i == 3 else "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    got = patterns.occurrences(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in [*some, "", None, "a", "a"]], "pattern string"), ["id"]).collect()
    assert len(got) == len(set(got)) and {(r.id, r.pattern) for r in got} == {(i, p) for i, t in texts if t for p in {*some, "a"} if p in t}


def test_patterns_turn_few_texts_of_a_batch_into_strings_at_once(spark):
    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "__text": ["ab" if i % 2 else "b" for i in range(1000)]})
    shared = SimpleNamespace(value=patterns.Automaton(["a", "b"]))
    got = [b.to_pylist() for b in patterns._scan(shared, ["id"])(iter([batch]))]
    assert max(len({r["id"] for r in rows}) for rows in got) <= patterns.ROWS
    assert sorted((r["id"], r["pattern"]) for rows in got for r in rows) == sorted([(i, "b") for i in range(1000)] + [(i, "a") for i in range(1, 1000, 2)])


@pytest.mark.parametrize("few", [200_000, 0])
def test_contained_texts_both_ways(spark, monkeypatch, few):
    monkeypatch.setattr(retrieval, "FEW", few)
    docs = [(1, "one two three four five"), (2, "xone two threey"), (3, None), (4, "two"), (5, "a.b\nc")]
    passages = [(1, "one two three"), (2, "two"), (3, " "), (4, None), (5, "a.b\nc"), (6, "two"), (7, "one two three four five six")]
    got = retrieval.contained_texts(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(passages, "item_id int, text string")).collect()
    want = {(i, d) for i, p in passages if p and p.strip() for d, t in docs if t and p in t}
    assert {(r.item_id, r.doc_id) for r in got} == want and len(got) == len(want)


def test_operations_meet_the_first_route_file(spark):
    ops = spark.createDataFrame([("s", "GET", "/users/{id}"), ("s", "POST", "/x"), ("s", "GET", "/none/at")], "spec string, method string, template string")
    files = spark.createDataFrame([("src/routes/b.ts", "USERS"), ("src/routes/a.ts", "get('/x')"), ("src/routes/c.ts", "users"), ("lib/x.ts", "none")], "path string, content string")
    assert {(r.method, r.template, r.target) for r in correlate.operations_to_routes(ops, files).collect()} == {("GET", "/users/{id}", "src/routes/b.ts"), ("POST", "/x", "src/routes/a.ts")}
