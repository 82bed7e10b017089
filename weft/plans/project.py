"""Queries about a project's meaning: entities, actions, gold rows, tests, interfaces, seeds, metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weft.functions import ids
from weft.operators import canonical, correlate, evaluation, gold, graph, semantic, simulate, symbols, temporal
from weft.plans import adapters as A
from weft.plans.registry import query
from weft.session import cut, shared_folder
from weft.sources import files, scip_index, store

TEXT = A.TEXT_SQL
SPLIT = "trim(regexp_replace(regexp_replace(translate({}, '_-', '  '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))"
_STEM = "regexp_replace(split_part(file_path, '/', -1), '\\.[^.]*$', '')"
_GENERIC = ", ".join(f"'{g}'" for g in semantic.GENERIC)
NAMES_SQL = f"""named AS (SELECT doc_id, node_id, kind, label, file_path, content, list_distinct(list_filter(list_transform([label, {_STEM}] || list_filter(string_split(file_path, '/')[:-2], lambda p: NOT list_contains([{_GENERIC}], p)),
  lambda x: {SPLIT.format("x")}), lambda x: x <> '')) AS names FROM text_nodes)"""
_ASCII = "regexp_replace({}, '[^\\x00-\\x7F]', 'x', 'g')"
_FOUND = ", ".join(f"CASE WHEN regexp_matches(hay, '(?is){p}') THEN '{e}' END" for e, p in semantic.ENTITIES)
DOMAIN_SQL = f"""domain AS (SELECT node_id, list_distinct(list_filter([{_FOUND}, CASE WHEN kind = 'db_model' THEN {SPLIT.format("label")} || ' model' END, CASE WHEN kind = 'route_handler' THEN 'HTTP route' END,
  CASE WHEN kind IN ('middleware', 'service_boundary', 'config_object', 'react_hook') THEN {SPLIT.format("kind")} END], lambda x: x IS NOT NULL)) AS labels
  FROM (SELECT *, {_ASCII.format("kind || ' ' || label || ' ' || file_path || ' ' || substr(content, 1, 2000)")} AS hay FROM text_nodes))"""


@query(f"WITH {TEXT}, {NAMES_SQL}, {DOMAIN_SQL} SELECT node_id, array_to_string(list_sort(names), '|') AS names, array_to_string(list_sort(labels), '|') AS labels FROM named JOIN domain USING (node_id)")
def entity_names(spark, d):
    joined = lambda x: F.array_join(F.sort_array(x), "|")
    return A.text_nodes(spark, d).select("node_id", joined(semantic.entity_names()).alias("names"), joined(semantic.domain_entities()).alias("labels"))


ENTITIES_SQL = f"""{TEXT}, {NAMES_SQL}, {DOMAIN_SQL},
imports AS (SELECT 'doc:' || doc_id AS node_id, 'module:m' || (doc_id % 7) AS target_id FROM documents UNION ALL SELECT 'doc:' || doc_id, 'local:x' FROM documents),
said AS (SELECT primary_block AS category, unnest(names || labels) AS name FROM named JOIN domain USING (node_id) JOIN text_assign USING (node_id) UNION ALL SELECT primary_block, substr(target_id, 8) FROM imports JOIN text_assign USING (node_id) WHERE target_id LIKE 'module:%'),
ents AS (SELECT category, name, count(*) AS n, 'entity:' || substr(sha256(lower(category || ':' || name)), 1, 16) AS entity_id FROM said GROUP BY 1, 2 ORDER BY n DESC, category, name LIMIT 200)"""


def _entities(spark, d):
    docs = A.table(spark, d, "documents")
    node = F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node_id")
    imports = docs.select(node, F.concat(F.lit("module:m"), (F.col("doc_id") % 7).cast("string")).alias("target_id")).unionByName(docs.select(node, F.lit("local:x").alias("target_id")))
    return semantic.entities(A.text_nodes(spark, d), A.text_assignments(spark, d), imports)


@query(f"WITH {ENTITIES_SQL} SELECT * FROM ents")
def semantic_entities(spark, d):
    return _entities(spark, d)


_ACTION = " ".join(f"WHEN regexp_matches(low, '(?is){p}') THEN '{a}'" for a, p in semantic.ACTIONS)


@query(f"""WITH {ENTITIES_SQL}, r AS (SELECT n.node_id, e.entity_id, lower(label || ' ' || file_path || ' ' || substr(content, 1, 2000)) AS low, confidence,
  row_number() OVER (PARTITION BY n.node_id ORDER BY list_contains(names, e.name) DESC, e.n DESC, e.name) AS k FROM named n JOIN text_assign a USING (node_id) JOIN ents e ON e.category = a.primary_block)
SELECT node_id, entity_id, CASE {_ACTION} ELSE 'REPRESENT' END AS action, greatest(0.1::DOUBLE, least(confidence, 0.95::DOUBLE)) AS confidence FROM r WHERE k = 1""")
def semantic_actions(spark, d):
    return semantic.actions(A.text_nodes(spark, d), A.text_assignments(spark, d), _entities(spark, d))


@query(f"WITH {TEXT} SELECT node_id, kind || ' ' || label || ' in ' || file_path || ' maps to ' || primary_block || ' with ' || (doc_id % 5) || ' import edge(s) and ' || (doc_id % 3) || ' sibling code node(s).' AS text FROM text_nodes JOIN text_assign USING (node_id)")
def node_summaries(spark, d):
    near = A.table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node_id"), (F.col("doc_id") % 5).alias("n_imports"), (F.col("doc_id") % 3).alias("n_siblings"))
    return semantic.summaries(A.text_nodes(spark, d), A.text_assignments(spark, d), near)


@query(f"WITH {TEXT}, c AS (SELECT primary_block, count(*) AS n FROM text_assign GROUP BY 1 ORDER BY n DESC, primary_block LIMIT 5) SELECT 'docs' AS project, string_agg(primary_block || ' (' || n || ')', ', ' ORDER BY n DESC, primary_block) AS blocks, count(*) AS n FROM c")
def project_summary(spark, d):
    return semantic.project_summary(A.text_assignments(spark, d), "docs")


def _insight_sql() -> str:
    sql = f"WITH {TEXT}, s AS (SELECT node_id, file_path, primary_block AS block, confidence FROM text_nodes JOIN text_assign USING (node_id)), b AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY confidence DESC, file_path, node_id) AS r FROM s QUALIFY r <= 5)"
    parts = []
    for title, blocks in (("Where is auth?", ["Access Control", "Security Ops"]), ("What changes if I touch this?", ["Network Edge", "Connectivity Layer", "Data Persistence", "Background Processing"]), ("What are the risky seams?", ["Access Control", "Security Ops", "System Telemetry", "Error Boundaries", "Resiliency"])):
        parts.append(f"(SELECT '{title}' AS title, CAST(row_number() OVER (ORDER BY list_position({blocks}, block), r) AS INTEGER) AS rank, node_id, block FROM b WHERE list_contains({blocks}, block) QUALIFY rank <= 5)")
    parts.append("(SELECT 'What should I refactor first?', CAST(row_number() OVER (ORDER BY confidence, file_path, node_id) AS INTEGER) AS rank, node_id, block FROM s WHERE confidence < 0.62 QUALIFY rank <= 6)")
    return sql + " " + " UNION ALL ".join(parts)


@query(_insight_sql())
def insights(spark, d):
    surfaces = A.text_nodes(spark, d).join(A.text_assignments(spark, d).select("node_id", F.col("primary_block").alias("block"), "confidence"), "node_id")
    return semantic.insights(surfaces)


CHANGE = "add an api route that checks the session login"


def _seeds_sql() -> str:
    tokens, blocks = simulate.change_tokens(CHANGE), simulate.change_blocks(simulate.change_tokens(CHANGE))
    hits = " + ".join(f"CASE WHEN contains(t, '{x}') THEN 1 ELSE 0 END" for x in tokens)
    return f"""WITH {TEXT}, k AS (SELECT node_id, lower(label || ' ' || file_path) AS t, file_path, primary_block FROM text_nodes JOIN text_assign USING (node_id)),
hot AS (SELECT file_path FROM text_nodes GROUP BY 1 ORDER BY count(*) DESC, file_path LIMIT 25),
s AS (SELECT node_id, ({hits}) * 1.6::DOUBLE + CASE WHEN file_path IN (FROM hot) THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN list_contains({blocks}, primary_block) THEN 2.4::DOUBLE ELSE 0 END AS score FROM k)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, node_id LIMIT 6"""


@query(_seeds_sql())
def seeds(spark, d):
    nodes = A.text_nodes(spark, d)
    hot = nodes.groupBy("file_path").count().orderBy(F.desc("count"), "file_path").limit(25)
    return simulate.seeds(nodes, A.text_assignments(spark, d), hot, A.edges(spark, d), CHANGE)


@query("""SELECT event_id, greatest(0.02::DOUBLE, least(0.98::DOUBLE, CAST(value AS DOUBLE) / 100.0::DOUBLE - (event_id % 7 - 3) / 20.0::DOUBLE - CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(0.15::DOUBLE, (event_id % 11) / 20.0::DOUBLE - 0.1::DOUBLE)) END)) AS confidence FROM events""")
def shrunk_confidence(spark, d):
    brier = F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 11) / 20.0)
    return A.table(spark, d, "events").select("event_id", simulate.adjusted_confidence(F.col("value").cast("double") / 100.0, (F.col("event_id") % 7 - 3) / 20.0, brier).alias("confidence"))


# gold rows: one for each label, whose target is given by id, path or glob in turn


def _gold(spark, d):
    i = F.col("doc_id")
    row = A.table(spark, d, "labels").join(A.text_nodes(spark, d).select(F.expr("cast(substring(node_id, 5) AS bigint)").alias("doc_id"), "file_path"), "doc_id")
    turn = lambda n, x: F.when(i % 3 == n, x).otherwise("")
    block = A._turn(A.ASSIGNED, i + F.when(i % 4 == 0, 1).otherwise(0))
    return row.select(
        F.concat(F.lit("g"), (i - F.when(i % 17 == 0, 1).otherwise(0)).cast("string")).alias("id"), F.lit("org/docs").alias("repo_name"), turn(0, F.concat(F.lit("doc:"), i.cast("string"))).alias("node_id"),
        turn(1, F.when(i % 5 == 0, "nowhere.ts").otherwise(F.col("file_path"))).alias("file_path"), turn(2, F.concat((i % 40).cast("string"), F.lit("/*/?*."), F.when(i % 2 == 0, "ts").otherwise("tsx"))).alias("file_glob"),
        F.when(i % 6 == 0, F.array(block, F.lit("Core Rendering"))).otherwise(F.array(block)).alias("accepted_blocks"), F.when(i % 9 == 0, F.lit("Security Ops")).otherwise(block).alias("primary_block"),
        A._turn(("high", "medium", "low", "unsure"), i).alias("confidence"), A._turn(("active", "active", "needs_review", "deprecated", "active"), i).alias("status"),
    )


GOLD_SQL = f"""{TEXT}, g AS (SELECT doc_id AS i, 'g' || (doc_id - CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END) AS id, CASE WHEN doc_id % 3 = 0 THEN 'doc:' || doc_id ELSE '' END AS node_id,
  CASE WHEN doc_id % 3 <> 1 THEN '' WHEN doc_id % 5 = 0 THEN 'nowhere.ts' ELSE file_path END AS file_path, CASE WHEN doc_id % 3 = 2 THEN (doc_id % 40) || '/*/?*.' || CASE WHEN doc_id % 2 = 0 THEN 'ts' ELSE 'tsx' END ELSE '' END AS file_glob,
  {A._turn_sql(A.ASSIGNED, "(doc_id + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END)")} AS block, {A._turn_sql(("high", "medium", "low", "unsure"), "doc_id")} AS confidence, {A._turn_sql(("active", "active", "needs_review", "deprecated", "active"), "doc_id")} AS status
  FROM labels JOIN text_nodes USING (doc_id)),
gold AS (SELECT *, CASE WHEN i % 6 = 0 THEN [block, 'Core Rendering'] ELSE [block] END AS accepted, CASE WHEN i % 9 = 0 THEN 'Security Ops' ELSE block END AS primary_block FROM g),
met AS (SELECT g.i, g.id, n.node_id, CASE WHEN g.node_id <> '' THEN 'node_id' WHEN g.file_path <> '' THEN 'file_path' ELSE 'file_glob' END AS via FROM gold g JOIN text_nodes n
  ON CASE WHEN g.node_id <> '' THEN g.node_id = n.node_id WHEN g.file_path <> '' THEN g.file_path = n.file_path ELSE n.file_path GLOB g.file_glob END)"""


@query(f"WITH {GOLD_SQL} SELECT id, node_id, via FROM met")
def gold_targets_glob(spark, d):
    return gold.targets(_gold(spark, d), A.text_nodes(spark, d))


@query(f"""WITH {GOLD_SQL}, t AS (SELECT *, CASE WHEN node_id <> '' THEN 'node_id:' || node_id WHEN file_path <> '' THEN 'file_path:' || file_path ELSE 'file_glob:' || file_glob END AS target FROM gold),
c AS (SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'deprecated') AS deprecated, 0::BIGINT AS missing,
  count(*) FILTER (confidence = 'unsure' OR NOT list_contains(accepted, primary_block)) AS invalid, count(*) FILTER (len(accepted) > 1 AND status <> 'deprecated') AS multi_label FROM t),
x AS (SELECT (SELECT count(*) FROM (SELECT 1 FROM t GROUP BY id HAVING count(*) > 1)) AS same_id, (SELECT count(*) FROM (SELECT 1 FROM t GROUP BY target, primary_block, status HAVING count(*) > 1)) AS same_row,
  (SELECT count(*) FROM (SELECT 1 FROM t WHERE status <> 'deprecated' GROUP BY target HAVING count(*) > 1 AND (count(*) FILTER (status = 'active') = 0 OR count(DISTINCT CASE WHEN status = 'active' THEN primary_block END) > 1))) AS contradictions)
SELECT *, CASE WHEN same_id + same_row + contradictions + missing + invalid = 0 THEN 'pass' ELSE 'fail' END AS status FROM c, x""")
def gold_audit(spark, d):
    return gold.audit(_gold(spark, d))


@query(f"""WITH {GOLD_SQL}, active AS (SELECT DISTINCT i, id, accepted FROM gold WHERE status = 'active'),
h AS (SELECT a.i, bool_or(list_contains(accepted, primary_block) OR (second IS NOT NULL AND list_contains(accepted, second))) AS hit FROM active a JOIN met USING (i) JOIN text_assign x ON x.node_id = met.node_id GROUP BY a.i),
s AS (SELECT a.i, hit IS NOT NULL AS found, coalesce(hit, false) AS hit FROM active a LEFT JOIN h USING (i))
SELECT count(*) AS total, count(*) FILTER (found) AS scorable, count(*) FILTER (hit) AS correct, CAST(count(*) FILTER (hit) AS DOUBLE) / count(*) AS accuracy, CAST(count(*) FILTER (hit) AS DOUBLE) / count(*) FILTER (found) AS scorable_accuracy, CAST(count(*) - count(*) FILTER (found) AS DOUBLE) / count(*) AS missing_rate FROM s""")
def gold_benchmark(spark, d):
    rows = _gold(spark, d).withColumn("id", F.concat("id", F.lit(":"), "node_id", F.lit(":"), "file_path", F.lit(":"), "file_glob", F.lit(":"), F.monotonically_increasing_id().cast("string")))
    return gold.benchmark_report(gold.benchmark(cut(rows), A.text_nodes(spark, d), A.text_assignments(spark, d)))


# tests, interfaces


def _files(spark, d):
    i = F.col("doc_id")
    q = F.floor(i / 4).cast("long")
    part = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in x))
    pkg = part("pkg", q % 10, "/")
    path = F.when(i % 4 == 0, F.when(q % 2 == 0, part("other/m", q, ".ts")).otherwise(part(pkg, "src/m", q, ".ts"))).when(i % 4 == 1, part(pkg, "src/m", q, ".test.ts")).when(i % 4 == 2, part(pkg, "routes/r", q, ".ts")).otherwise(part(pkg, "lib/m", q + 1, ".spec.ts"))
    return A.table(spark, d, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))


FILES_SQL = """files AS (SELECT CASE doc_id % 4 WHEN 0 THEN CASE WHEN (doc_id // 4) % 2 = 0 THEN 'other/m' || (doc_id // 4) || '.ts' ELSE 'pkg' || ((doc_id // 4) % 10) || '/src/m' || (doc_id // 4) || '.ts' END
  WHEN 1 THEN 'pkg' || ((doc_id // 4) % 10) || '/src/m' || (doc_id // 4) || '.test.ts' WHEN 2 THEN 'pkg' || ((doc_id // 4) % 10) || '/routes/r' || (doc_id // 4) || '.ts' ELSE 'pkg' || ((doc_id // 4) % 10) || '/lib/m' || (doc_id // 4 + 1) || '.spec.ts' END AS path, coalesce(text, '') AS content FROM documents)"""


@query(f"""WITH {FILES_SQL}, tests AS (SELECT DISTINCT path, regexp_replace(path, '(\\.test|\\.spec)\\.ts$', '.ts') AS plain FROM files WHERE path LIKE '%.test.ts' OR path LIKE '%.spec.ts'),
src AS (SELECT DISTINCT path, regexp_replace(split_part(path, '/', -1), '\\.ts$', '') AS stem FROM files WHERE path NOT LIKE '%.test.%' AND path NOT LIKE '%.spec.%'),
beside AS (SELECT t.path, plain AS target FROM tests t WHERE plain IN (SELECT path FROM files)),
guess AS (SELECT t.path, min(s.path) AS target FROM tests t JOIN src s ON s.stem = regexp_replace(split_part(plain, '/', -1), '\\.ts$', '') WHERE t.path NOT IN (SELECT path FROM beside) GROUP BY 1)
SELECT 'test:' || path AS source_id, 'codefile:' || target AS target_id, 'TESTS' AS edge_kind FROM beside UNION ALL SELECT 'test:' || path, 'codefile:' || target, 'TESTS_HEURISTIC' FROM guess""")
def test_source_corr(spark, d):
    return correlate.tests_to_sources(_files(spark, d))


def _specs(spark, d):
    word = F.regexp_extract(F.lower("text"), "([a-z]{3,})", 1)
    body = F.concat(F.lit('{"paths": {"/'), word, F.lit('/{id}": {"get": {"operationId": "op'), F.col("item_id").cast("string"), F.lit('"}, "summary": {}}}}'))
    return A.table(spark, d, "benchmark").select(F.concat(F.lit("spec"), F.col("item_id").cast("string"), F.lit("/openapi.json")).alias("path"), body.alias("content"))


@query(f"""WITH {FILES_SQL}, ops AS (SELECT 'spec' || item_id || '/openapi.json' AS spec, 'GET' AS method, '/' || regexp_extract(lower(text), '([a-z]{{3,}})', 1) || '/{{id}}' AS template, regexp_extract(lower(text), '([a-z]{{3,}})', 1) AS k FROM benchmark),
routes AS (SELECT path, lower(content) AS t FROM files WHERE path LIKE '%/routes/%')
SELECT spec, method, template, min(path) AS target FROM ops JOIN routes ON contains(t, k) OR contains(t, template) WHERE k <> '' GROUP BY ALL""")
def openapi_theta(spark, d):
    return correlate.operations_to_routes(correlate.openapi_operations(_specs(spark, d)), _files(spark, d))


# metrics

PHASES_SQL = f"""WITH {A.NODES_SQL}, {A.EDGES_SQL}, {A.ASSIGN_SQL}, {A.CHANGES_SQL},
m AS (SELECT 'ingest' AS phase, 'nodes' AS metric, CAST((SELECT count(*) FROM nodes) AS DOUBLE) AS value
UNION ALL SELECT 'ingest', 'files', (SELECT count(*) FROM nodes WHERE layer = 'file') UNION ALL SELECT 'graph', 'edges', (SELECT count(*) FROM edges)
UNION ALL SELECT 'graph', 'edge_types', (SELECT count(DISTINCT edge_type) FROM edges)
UNION ALL SELECT 'graph', 'dangling', (SELECT count(*) FROM edges WHERE target_id NOT IN (SELECT node_id FROM nodes) AND edge_type <> 'IMPORTS_MODULE') + (SELECT count(*) FROM edges WHERE source_id NOT IN (SELECT node_id FROM nodes))
UNION ALL SELECT 'classify', 'assigned', (SELECT count(*) FROM assign) UNION ALL SELECT 'classify', 'blocks', (SELECT count(DISTINCT block) FROM assign)
UNION ALL SELECT 'classify', 'coverage', (SELECT CAST(count(*) AS DOUBLE) FROM assign) / (SELECT count(*) FROM nodes WHERE layer = 'code')
UNION ALL SELECT 'classify', 'confidence', (SELECT round(avg(confidence), 9) FROM assign) UNION ALL SELECT 'history', 'changes', (SELECT count(*) FROM changes) UNION ALL SELECT 'history', 'paths', (SELECT count(DISTINCT path) FROM changes))
SELECT * FROM m"""


@query(PHASES_SQL)
def phase_metrics_long(spark, d):
    return graph.phase_metrics(A.nodes(spark, d), A.edges(spark, d), A.assignments(spark, d), A.changes(spark, d))


@query(f"WITH {A.CHANGES_SQL} SELECT repo, day, block, count(*) AS files FROM (SELECT DISTINCT repo, day, path, block FROM changes) GROUP BY ALL")
def snapshot_blocks(spark, d):
    return temporal.block_files(temporal.snapshots(A.changes(spark, d)))


# symbol index: lines of orders are occurrences, parts are the nodes that they may define


def _occurrences(spark, d):
    s = F.col("l_suppkey") % 97
    token = F.when(F.col("l_linenumber") == 5, "").otherwise(F.concat(F.lit("n"), (s % 40).cast("string")))
    return A.table(spark, d, "lineitem").select(F.concat(F.lit("src/p"), (F.col("l_partkey") % 50).cast("string"), F.lit(".ts")).alias("path"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"), F.concat(F.when(s % 10 == 9, "local s").otherwise("s"), s.cast("string")).alias("symbol"), F.when(F.col("l_linenumber") % 3 == 1, 1).otherwise(8).alias("roles"), F.col("l_quantity").cast("int").alias("line"), token.alias("token"))


def _info(spark, d):
    s = A.table(spark, d, "supplier").select((F.col("s_suppkey") % 97).alias("s")).distinct()
    rows = s.select(F.concat(F.when(F.col("s") % 10 == 9, "local s").otherwise("s"), F.col("s").cast("string")).alias("symbol"), F.when(F.col("s") % 6 != 5, F.concat(F.lit("n"), (F.col("s") % 70).cast("string"))).alias("display_name"), A._turn(("Class", "Method", "Parameter", "Variable"), F.col("s")).alias("kind"))
    return symbols.symbol_information(rows, rows.where("symbol LIKE 's1%'").withColumn("kind", F.lit("Interface")))


def _code(spark, d):
    k = F.col("p_partkey")
    start = F.col("p_size") % 25
    return A.table(spark, d, "part").select(F.concat(F.lit("part:"), k.cast("string")).alias("node_id"), F.concat(F.lit("n"), (k % 30).cast("string")).alias("label"), F.concat(F.lit("src/p"), (k % 50).cast("string"), F.lit(".ts")).alias("path"), start.alias("start_line"), (start + k % 17 * F.when(k % 23 == 0, 60).otherwise(1)).alias("end_line"), (k % 5).alias("start_col"))


SYMBOLS_SQL = f"""occ AS (SELECT 'src/p' || (l_partkey % 50) || '.ts' AS path, l_orderkey * 100 + l_linenumber AS ord, CASE WHEN l_suppkey % 97 % 10 = 9 THEN 'local s' ELSE 's' END || (l_suppkey % 97) AS symbol, l_linenumber % 3 = 1 AS def, CAST(l_quantity AS INTEGER) AS line,
  CASE WHEN l_linenumber = 5 THEN '' ELSE 'n' || (l_suppkey % 97 % 40) END AS token FROM lineitem),
raw AS (SELECT DISTINCT s_suppkey % 97 AS s FROM supplier),
info AS (SELECT CASE WHEN s % 10 = 9 THEN 'local s' ELSE 's' END || s AS symbol, CASE WHEN s % 6 <> 5 THEN 'n' || (s % 70) END AS display_name, CASE WHEN s % 10 <> 9 AND CAST(s AS VARCHAR) LIKE '1%' THEN 'Interface' ELSE {A._turn_sql(("Class", "Method", "Parameter", "Variable"), "s")} END AS kind FROM raw),
code AS (SELECT 'part:' || p_partkey AS node_id, 'n' || (p_partkey % 30) AS label, 'src/p' || (p_partkey % 50) || '.ts' AS path, p_size % 25 AS start_line, p_size % 25 + p_partkey % 17 * CASE WHEN p_partkey % 23 = 0 THEN 60 ELSE 1 END AS end_line, p_partkey % 5 AS start_col FROM part),
d AS (SELECT path, ord, o.symbol, line, CASE WHEN token <> '' THEN token ELSE coalesce(display_name, '') END AS token FROM occ o LEFT JOIN info USING (symbol) WHERE def),
ranked AS (SELECT d.*, c.node_id, row_number() OVER (PARTITION BY d.path, ord, line, symbol ORDER BY NOT coalesce(line BETWEEN start_line AND end_line, false), end_line - start_line, start_col, c.node_id) AS k FROM d LEFT JOIN code c ON c.path = d.path AND c.label = d.token),
defs AS (SELECT path, ord, line, symbol, token, node_id FROM ranked WHERE k = 1),
names AS (SELECT node_id, arg_max(symbol, (ord, line, symbol)) AS symbol FROM defs WHERE node_id IS NOT NULL GROUP BY 1)"""


@query(f"WITH {SYMBOLS_SQL} SELECT path, ord, line, symbol, token, coalesce(node_id, '') AS node_id FROM defs")
def scip_definitions(spark, d):
    return symbols.definitions(_occurrences(spark, d), _code(spark, d), _info(spark, d)).withColumn("node_id", F.coalesce("node_id", F.lit("")))


def _consumed(spark, d):
    info = _info(spark, d)
    return symbols.definitions(_occurrences(spark, d), _code(spark, d), info), info


@query(f"WITH {SYMBOLS_SQL} SELECT * FROM names")
def scip_resolved(spark, d):
    return symbols.resolved(_consumed(spark, d)[0])


@query(f"""WITH {SYMBOLS_SQL} SELECT DISTINCT path, d.symbol, coalesce(display_name, '') AS display_name, coalesce(kind, '') AS kind, d.symbol NOT LIKE 'local %' AND coalesce(display_name, '') <> '' AND coalesce(kind, '') IN ('Class', 'Method', 'Variable', 'Interface') AS addressable
FROM defs d LEFT JOIN info USING (symbol) WHERE node_id IS NULL""")
def scip_orphans(spark, d):
    defined, info = _consumed(spark, d)
    return symbols.orphans(defined, info).withColumn("kind", F.coalesce("kind", F.lit("")))


@query(f"""WITH {SYMBOLS_SQL}, pts AS (SELECT DISTINCT path, line, symbol FROM occ WHERE NOT def), foreign_ AS (SELECT 's' || (s_suppkey % 97) AS symbol, 'repo_' || (s_suppkey % 3) AS repo, 'x:' || s_suppkey AS node_id, s_suppkey AS ord FROM supplier),
f AS (SELECT symbol, arg_min(node_id, ord) AS fid, arg_min(repo, ord) AS frepo FROM foreign_ WHERE repo <> 'repo_0' GROUP BY 1),
w AS (SELECT p.*, c.node_id, row_number() OVER (PARTITION BY p.path, line, symbol ORDER BY NOT (line BETWEEN start_line AND end_line), CASE WHEN line BETWEEN start_line AND end_line THEN end_line - start_line ELSE abs(start_line - line) + abs(end_line - line) END, start_col, c.node_id) AS k FROM pts p LEFT JOIN code c ON c.path = p.path),
x AS (SELECT w.*, fid, frepo, w.symbol NOT IN (SELECT symbol FROM names) AND fid IS NOT NULL AND node_id IS NOT NULL AS foreign_hit FROM w LEFT JOIN f USING (symbol) WHERE k = 1)
SELECT DISTINCT coalesce(node_id, 'repo://repo_0/' || path) AS source_id, CASE WHEN foreign_hit THEN fid ELSE symbol END AS target_id, CASE WHEN foreign_hit THEN 'CROSS_REFERENCE' ELSE 'REFERENCES' END AS edge_type, CASE WHEN foreign_hit THEN frepo ELSE '' END AS target_repo,
  CASE WHEN node_id IS NULL THEN 'scip_file_fallback' WHEN foreign_hit THEN 'scip_cross_repo' ELSE 'scip_reference_code' END AS provenance FROM x""")
def scip_references(spark, d):
    defined, _ = _consumed(spark, d)
    k = F.col("s_suppkey")
    foreign = A.table(spark, d, "supplier").select(F.concat(F.lit("s"), (k % 97).cast("string")).alias("symbol"), F.concat(F.lit("repo_"), (k % 3).cast("string")).alias("repo"), F.concat(F.lit("x:"), k.cast("string")).alias("node_id"), k.alias("ord"))
    known = symbols.resolved(defined).select("symbol").distinct()
    return symbols.references(_occurrences(spark, d), _code(spark, d), known, foreign, "repo_0").withColumn("target_repo", F.coalesce("target_repo", F.lit("")))


@query(f"WITH {SYMBOLS_SQL} SELECT path, count(*) AS occurrences, count(*) FILTER (def) AS definitions, count(*) FILTER (NOT def) AS references, count(DISTINCT symbol) AS symbols FROM occ GROUP BY 1".replace("AS references", 'AS "references"'))
def scip_documents(spark, d):
    return symbols.document_counts(_occurrences(spark, d))


# the same in the wire format of indexes: lines of orders as documents by supplier, written and read again


def _index(spark, d) -> str:
    """Where an index of all lines is: a document a supplier, an occurrence a line, on the line of its number."""
    line = A.table(spark, d, "lineitem")
    at = F.col("l_linenumber").cast("int")
    span = F.when(at % 2 == 0, F.array(F.col("l_quantity").cast("int"), at, at + 4)).otherwise(F.array(F.col("l_quantity").cast("int"), at, F.col("l_quantity").cast("int") + at, F.lit(0)))
    symbol = F.concat(F.lit("pkg `s"), F.col("l_partkey").cast("string"), F.lit("`#"))
    one = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.struct(span.alias("range"), symbol.alias("symbol"), (at % 9).alias("roles"), F.array().cast("array<int>").alias("enclosing_range")).alias("o"))
    docs = line.groupBy("l_suppkey").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["o"]).alias("occurrences"))
    k = F.col("l_suppkey")
    relation = F.struct(F.concat(F.lit("base"), (k % 7).cast("string")).alias("symbol"), (k % 2 == 0).alias("is_reference"), (k % 3 == 0).alias("is_implementation"), F.lit(False).alias("is_type_definition"), (k % 5 == 0).alias("is_definition"))
    known = F.array(F.struct(F.concat(F.lit("sup"), k.cast("string")).alias("symbol"), F.concat(F.lit("n"), (k % 70).cast("string")).alias("display_name"), A._turn(("Class", "Method", "Variable"), k).alias("kind"), F.array(F.lit("d")).alias("documentation"), F.array(relation).alias("relationships")))
    docs = docs.select(F.concat(F.lit("./src/p"), k.cast("string"), F.lit(".ts")).alias("relative_path"), F.lit("typescript").alias("language"), F.repeat(F.lit("ab n1 cd\n"), 60).alias("text"), F.lit("UTF8").alias("encoding"), "occurrences", known.alias("symbols"))
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    scip_index.write_index(docs, path, projectroot="file:///src")
    return path


@query("""SELECT './src/p' || l_suppkey || '.ts' AS relative_path, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS INT) AS ord, 'pkg `s' || l_partkey || '`#' AS symbol, CAST(l_linenumber % 9 AS INT) AS roles,
  CAST(l_quantity AS INT) || ',' || l_linenumber || ',' || CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber + 4 AS VARCHAR) ELSE (CAST(l_quantity AS INT) + l_linenumber) || ',0' END AS range FROM lineitem""")
def scip_scan(spark, d):
    found = scip_index.index_table(spark, _index(spark, d), "occurrences", split=1 << 16)
    return found.select("relative_path", "ord", "symbol", "roles", F.array_join("range", ",").alias("range"))


@query("""SELECT DISTINCT 'src/p' || l_suppkey || '.ts' AS path, 'sup' || l_suppkey AS symbol, 'n' || l_suppkey % 70 AS display_name, ['Class', 'Method', 'Variable'][CAST(l_suppkey % 3 + 1 AS INT)] AS kind, 'base' || l_suppkey % 7 AS target,
  l_suppkey % 2 = 0 AS is_reference, l_suppkey % 3 = 0 AS is_implementation, l_suppkey % 5 = 0 AS is_definition FROM lineitem""")
def scip_symbols(spark, d):
    found = scip_index.index_table(spark, _index(spark, d), "symbols", split=1 << 16)
    return found.select(ids.normalize_relative_path("relative_path").alias("path"), "symbol", "display_name", "kind", F.explode("relationships").alias("r")).select("path", "symbol", "display_name", "kind", F.col("r.symbol").alias("target"), "r.is_reference", "r.is_implementation", "r.is_definition")


def _canonical(spark, d):
    nodes, edges = A.nodes(spark, d), A.edges(spark, d)
    texts, assigned, found = A.text_nodes(spark, d), A.text_assignments(spark, d), cut(_entities(spark, d))  # a few rows, used three times
    files = _files(spark, d)
    tests = correlate.test_files(files).select(F.concat(F.lit("test:"), "path").alias("node_id"), F.lit("test").alias("kind"), "path")
    code = texts.select("node_id", F.lit("code").alias("layer"), "kind", "label", "file_path", F.lit("docs").alias("repo_name"), F.lit("scip").alias("symbol_source"))
    return canonical.canonical([
        canonical.project(nodes, "docs"),
        canonical.structure(nodes.withColumn("symbol_source", F.lit("tree_sitter")), edges.withColumn("repo_name", F.lit("docs"))),
        canonical.structure(code, edges.limit(0).withColumn("repo_name", F.lit("docs"))),
        canonical.summaries(texts.select("node_id", F.lit("code_node").alias("summary_type")).unionByName(texts.limit(1).select(F.lit("lost").alias("node_id"), F.lit("project").alias("summary_type"))), "docs"),
        canonical.blocks(assigned, "docs"),
        canonical.entities(found, semantic.actions(texts, assigned, found), "docs"),
        canonical.others(tests, correlate.tests_to_sources(files), "docs"),
        canonical.snapshots(A.changes(spark, d).select(F.col("day").alias("sha")).distinct().withColumn("subject", F.lit(None).cast("string")), "docs"),
    ])


CANONICAL_SQL = f"""{ENTITIES_SQL}, {A.NODES_SQL}, {A.EDGES_SQL}, {A.CHANGES_SQL}, {FILES_SQL},
acts AS (SELECT n.node_id, e.entity_id, lower(label || ' ' || file_path || ' ' || substr(content, 1, 2000)) AS low, row_number() OVER (PARTITION BY n.node_id ORDER BY list_contains(names, e.name) DESC, e.n DESC, e.name) AS k FROM named n JOIN text_assign a USING (node_id) JOIN ents e ON e.category = a.primary_block),
tests AS (SELECT DISTINCT path, regexp_replace(path, '(\\.test|\\.spec)\\.ts$', '.ts') AS plain FROM files WHERE path LIKE '%.test.ts' OR path LIKE '%.spec.ts'),
src AS (SELECT DISTINCT path, regexp_replace(split_part(path, '/', -1), '\\.ts$', '') AS stem FROM files WHERE path NOT LIKE '%.test.%' AND path NOT LIKE '%.spec.%'),
beside AS (SELECT t.path, plain AS target FROM tests t WHERE plain IN (SELECT path FROM files)),
guess AS (SELECT t.path, min(s.path) AS target FROM tests t JOIN src s ON s.stem = regexp_replace(split_part(plain, '/', -1), '\\.ts$', '') WHERE t.path NOT IN (SELECT path FROM beside) GROUP BY 1),
all_nodes AS (SELECT 0 AS w, 'system:local' AS node_id, 'system' AS layer, 'system' AS kind UNION ALL SELECT 0, 'project:docs', 'project', 'project' UNION ALL SELECT 1, node_id, layer, kind FROM nodes UNION ALL SELECT 2, node_id, 'code', kind FROM text_nodes
  UNION ALL SELECT 3, 'summary:code_node:' || node_id, 'semantic', 'code_node_summary' FROM text_nodes UNION ALL SELECT 3, 'summary:project:lost', 'semantic', 'project_summary'
  UNION ALL SELECT 4, 'semantic:' || node_id || ':' || primary_block, 'semantic', 'block_assignment' FROM text_assign UNION ALL SELECT 4, 'semantic:' || node_id || ':' || second, 'semantic', 'secondary_block_assignment' FROM text_assign WHERE second IS NOT NULL
  UNION ALL SELECT 5, entity_id, 'semantic', 'entity' FROM ents UNION ALL SELECT 6, 'test:' || path, 'test', 'test' FROM tests UNION ALL SELECT 7, 'temporal-snapshot:' || day, 'temporal', 'graph_snapshot' FROM (SELECT DISTINCT day FROM changes)),
cn AS (SELECT node_id, arg_max(layer, (w, kind)) AS layer, arg_max(kind, (w, kind)) AS kind FROM all_nodes GROUP BY 1),
ce AS (SELECT DISTINCT * FROM (SELECT 'system:local' AS source_id, 'project:docs' AS target_id, 'CONTAINS' AS edge_type UNION ALL SELECT * FROM edges UNION ALL SELECT 'summary:code_node:' || node_id, node_id, 'SUMMARIZES' FROM text_nodes
  UNION ALL SELECT 'semantic:' || node_id || ':' || primary_block, node_id, 'DESCRIBES' FROM text_assign UNION ALL SELECT 'semantic:' || node_id || ':' || second, node_id, 'SECONDARY_DESCRIBES' FROM text_assign WHERE second IS NOT NULL
  UNION ALL SELECT entity_id, 'project:docs', 'RELATES_TO' FROM ents UNION ALL SELECT node_id, entity_id, CASE {_ACTION} ELSE 'REPRESENT' END FROM acts WHERE k = 1
  UNION ALL SELECT 'test:' || path, 'codefile:' || target, 'TESTS' FROM beside UNION ALL SELECT 'test:' || path, 'codefile:' || target, 'TESTS_HEURISTIC' FROM guess))"""


@query(f"WITH {CANONICAL_SQL} SELECT * FROM cn")
def canonical_nodes(spark, d):
    return _canonical(spark, d)[0].select("node_id", "layer", "kind")


@query(f"WITH {CANONICAL_SQL} SELECT * FROM ce")
def canonical_edges(spark, d):
    return _canonical(spark, d)[1].select("source_id", "target_id", "edge_type")


@query(f"""WITH {CANONICAL_SQL} SELECT (SELECT count(*) FROM cn) AS node_count, (SELECT string_agg(DISTINCT layer, ',' ORDER BY layer) FROM cn) AS layers, (SELECT count(*) FROM ce) AS edge_count,
(SELECT count(*) FROM ce WHERE source_id NOT IN (SELECT node_id FROM cn)) + (SELECT count(*) FROM ce WHERE target_id NOT IN (SELECT node_id FROM cn)) AS dangling_edge_count, (SELECT count(*) FROM ce WHERE target_id NOT IN (SELECT node_id FROM cn) AND edge_type = 'IMPORTS_MODULE') AS external_edge_count""")
def canonical_summary(spark, d):
    return canonical.summary(*_canonical(spark, d))


# ingest, evaluation


_LANGUAGES = {
    "typescript": ("ts", "/*", "*/", "class C# {\n  m#(a) { return '}'; }\n}\nfunction f#() {\n  const x = 1;\n}\nexport const v# = { a: 1 };\nrouter.get('/r#', async (x) => x)\n", (("C#", "class", 1, 3), ("m#", "method", 2, 2), ("f#", "function", 4, 6), ("v#", "variable", 7, 7), ("route_r#", "route_handler", 8, 8))),
    "python": ("py", "'''", "'''", "class C#:\n    def m#(self):\n        return '}'\n\ndef f#(): pass\n", (("C#", "class", 1, 3), ("m#", "method", 2, 3), ("f#", "function", 5, 5))),
    "go": ("go", "/*", "*/", "func f#(a int) {\n  b := `}`\n}\nfunc (s S) m#() {\n}\ntype I# interface {\n}\n", (("f#", "function", 1, 3), ("m#", "method", 4, 5), ("I#", "interface", 6, 7))),
    "java": ("java", "/*", "*/", "class C# {\n  C#() { }\n  void m#(int a) {\n    f('}');\n  }\n}\n", (("C#", "class", 1, 6), ("C#", "method", 2, 2), ("m#", "method", 3, 5))),
    "prisma": ("prisma", "//", "", "model M# { id Int }\nmodel N# {\n  x Int\n  }\n", (("M#", "db_model", 1, 1), ("N#", "db_model", 2, 4))),
}


def _sources(spark, d):
    """Documents as source files of five languages in turn: the text as a comment, then declarations."""
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")
    pick = lambda k: A._turn(tuple(x[k] for x in _LANGUAGES.values()), i)
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[*'\\\\]", "-")
    text = F.when(i % 5 == 4, F.translate(text, "\n{}", " ")).otherwise(text)
    content = F.concat(pick(1), text, pick(2), F.lit("\n"), F.replace(pick(3), F.lit("#"), n))
    path = F.concat(F.lit("src/p"), (i % 7).cast("string"), F.lit("/x"), n, F.lit("."), pick(0))
    return A.table(spark, d, "documents").select(F.lit("org/app").alias("repo_name"), path.alias("path"), A._turn(tuple(_LANGUAGES), i).alias("language"), content.alias("content"))


_FEEDS = "CASE WHEN doc_id % 5 = 4 THEN 0 ELSE len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) END + 1"
_SUFFIX = A._turn_sql(tuple(x[0] for x in _LANGUAGES.values()), "doc_id")
_DECLARED = ", ".join(f"({turn}, '{name}', '{kind}', {first}, {last})" for turn, x in enumerate(_LANGUAGES.values()) for name, kind, first, last in x[4])
SOURCES_SQL = f"""sources AS (SELECT doc_id, 'src/p' || doc_id % 7 || '/x' || doc_id || '.' || {_SUFFIX} AS path, {_FEEDS} AS feeds FROM documents),
declared AS (SELECT path, replace(name, '#', CAST(doc_id AS VARCHAR)) AS name, kind, CAST(feeds + first AS INTEGER) AS start_line, CAST(feeds + last AS INTEGER) AS end_line FROM sources JOIN (VALUES {_DECLARED}) t(turn, name, kind, first, last) ON doc_id % 5 = turn)"""


@query(f"WITH {SOURCES_SQL} SELECT 'repo://org/app/' || path || '#' || name || ':' || kind || ':' || start_line AS node_id, name AS label, kind, path, start_line, end_line FROM declared")
def code_symbols(spark, d):
    return files.code_symbols(_sources(spark, d)).select("node_id", "label", "kind", "path", "start_line", "end_line")


@query(f"""WITH {SOURCES_SQL}, n AS (SELECT path, 'codefile:' || path AS id FROM sources UNION ALL SELECT path, 'repo://org/app/' || path || '#' || name || ':' || kind || ':' || start_line FROM declared)
SELECT 'repo://org/app/' || path AS source_id, id AS target_id, 'CONTAINS' AS edge_type FROM n UNION ALL SELECT 'project:org_app', 'repo://org/app/' || path, 'CONTAINS' FROM sources""")
def ingest_edges(spark, d):
    return files.ingest(_sources(spark, d))[1].select("source_id", "target_id", "edge_type")


@query(f"WITH {SOURCES_SQL} SELECT 'codefile:' || path AS node_id, split_part(path, '/', -1) AS label, path, CAST(feeds + 1 + [8, 5, 7, 6, 4][CAST(doc_id % 5 + 1 AS INT)] AS INT) AS end_line FROM sources")
def file_surfaces(spark, d):
    return files.file_surfaces(_sources(spark, d)).select("node_id", "label", "path", "end_line")


@query(f"WITH {SOURCES_SQL} SELECT path, name AS label, start_line FROM declared WHERE kind = 'route_handler'")
def route_handlers(spark, d):
    return files.route_handlers(_sources(spark, d)).select("path", "label", "start_line")


@query(f"WITH {SOURCES_SQL} SELECT path, name, start_line, end_line FROM declared WHERE kind = 'db_model'")
def schema_models(spark, d):
    return files.schema_models(_sources(spark, d)).select("path", "name", "start_line", "end_line")


def _configured(spark, d):
    """Documents as files of configuration, if their text has a word of one."""
    i = F.col("doc_id")
    content = F.concat(F.coalesce("text", F.lit("")), F.lit("\nexport default "), F.when(i % 2 == 0, "{}").otherwise("config"))
    return A.table(spark, d, "documents").select(F.lit("org/app").alias("repo_name"), F.concat(F.when(i % 3 == 0, "src/").otherwise("config/"), F.lit("app-"), i.cast("string"), F.lit(".config.ts")).alias("path"), F.lit("typescript").alias("language"), content.alias("content"))


@query(r"""SELECT CASE WHEN doc_id % 3 = 0 THEN 'src/' ELSE 'config/' END || 'app-' || doc_id || '.config.ts' AS path, 'app_' || doc_id || '_config' AS name FROM documents
WHERE doc_id % 2 = 1 OR regexp_matches(lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g')), '\b(defineconfig|config|env|schema|database|datasource)\b')""")
def config_boundaries(spark, d):
    return files.config_boundaries(_configured(spark, d)).select("path", "name")


@query(f"""WITH {SOURCES_SQL} SELECT 'project:org_app' AS source_id, 'repo://org/app/' || path AS target_id FROM sources UNION ALL SELECT 'repo://org/app/' || path, 'codefile:' || path FROM sources""")
def contains_edges(spark, d):
    some = _sources(spark, d)
    return files.contains_edges(some, files.file_surfaces(some)).select("source_id", "target_id")


@query("""WITH n AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'useUser' WHEN 1 THEN 'roleGuard' WHEN 2 THEN 'appConfig' WHEN 3 THEN 'mailClient' WHEN 4 THEN 'plain' ELSE 'Box' END AS name, CASE doc_id % 4 WHEN 0 THEN 'src/middleware/a.ts' WHEN 1 THEN 'src/services/b.ts' WHEN 2 THEN 'src/x.py' ELSE 'src/config/c.ts' END AS path, CASE WHEN doc_id % 5 = 0 THEN 'class' ELSE 'function' END AS kind FROM documents)
SELECT doc_id, CASE WHEN name = 'useUser' AND path LIKE '%.ts' THEN 'react_hook' WHEN (name = 'roleGuard' OR kind = 'function') AND path LIKE '%middleware%' THEN 'middleware'
  WHEN (name = 'appConfig' AND kind = 'function') OR (path LIKE '%/config%' AND kind = 'function') THEN 'config_object' WHEN name = 'mailClient' OR path LIKE '%/services/%' THEN 'service_boundary' ELSE kind END AS kind FROM n""")
def refined_kinds(spark, d):
    i = F.col("doc_id")
    name = A._turn(("useUser", "roleGuard", "appConfig", "mailClient", "plain", "Box"), i)
    path = A._turn(("src/middleware/a.ts", "src/services/b.ts", "src/x.py", "src/config/c.ts"), i)
    return A.table(spark, d, "documents").select("doc_id", files.refined_kind(name, F.when(i % 5 == 0, "class").otherwise("function"), path, F.lit("")).alias("kind"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'own/p' || page_id WHEN 1 THEN 'own/q' || page_id WHEN 2 THEN 'a/b.c' ELSE '' END AS repo FROM pages")
def repo_names(spark, d):
    i = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(" https://GitHub.com/own/p"), i, F.lit(".git "))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("git@github.com:own/q"), i)).when(F.col("page_id") % 4 == 2, "a/b.c").otherwise(F.col("url"))
    return A.table(spark, d, "pages").select("page_id", F.coalesce(ids.repo_name_of(url), F.lit("")).alias("repo"))


@query(f"""WITH {A.TEXT_SQL}, t AS (SELECT n.*, lower(label || ' ' || file_path || ' ' || substr(content, 1, 500)) AS low FROM text_nodes n)
SELECT count(*) AS nodes, count(DISTINCT file_path) AS files, count(*) FILTER (regexp_matches(low, 'auth|login|session|password|token|profile')) AS auth, count(*) FILTER (regexp_matches(low, 'prisma|schema|db|database|profile|query|seed')) AS data, count(*) FILTER (doc_id % 9 = 0) AS loose, 'fail' AS status FROM t""")
def graph_smoke(spark, d):
    nodes = A.text_nodes(spark, d)
    held = A.table(spark, d, "documents").where("doc_id % 9 <> 0").select(F.lit("f").alias("source_id"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("target_id"), F.lit("CONTAINS").alias("edge_type"))
    return evaluation.smoke(nodes, held)


@query(f"WITH {A.NODES_SQL} SELECT layer, count(*) AS n FROM nodes GROUP BY 1")
def layer_counts(spark, d):
    return evaluation.layer_counts(A.nodes(spark, d))


@query("SELECT c_mktsegment AS language, count(*) AS repos, count(*) FILTER (c_acctbal >= 0) AS ok, CAST(sum(c_custkey % 50) AS BIGINT) AS nodes, arg_max(c_name, (c_custkey % 50, c_name)) AS largest FROM customer GROUP BY 1")
def corpus_summary(spark, d):
    return evaluation.corpus_summary(A.table(spark, d, "customer").select(F.col("c_name").alias("repo"), F.col("c_mktsegment").alias("language"), F.when(F.col("c_acctbal") >= 0, "ok").otherwise("failed").alias("status"), (F.col("c_custkey") % 50).alias("node_count")))


@query(f"""WITH {A.TEXT_SQL}, a AS (SELECT 'q' || (doc_id % 50) AS id, file_path, list_filter([primary_block, second], lambda x: x IS NOT NULL) AS blocks FROM text_nodes JOIN text_assign USING (node_id) WHERE doc_id % 50 % 7 <> 6),
q AS (SELECT DISTINCT 'q' || k AS id, k FROM (SELECT doc_id % 50 AS k FROM documents)),
g AS (SELECT id, list_distinct(flatten(list(blocks))) AS seen, list(DISTINCT file_path) AS files FROM a GROUP BY 1),
j AS (SELECT q.id, k, k % 7 >= 5 AS unsupported, g.id IS NOT NULL AS has, CASE WHEN k % 2 = 0 THEN list_contains(seen, 'Network Edge') ELSE true END AS block, CASE WHEN k % 3 = 0 THEN len(list_filter(files, lambda f: f GLOB '1*/src/*')) > 0 WHEN k % 3 = 1 THEN list_contains(files, k || '/README.ts') ELSE true END AS file FROM q LEFT JOIN g USING (id)),
s AS (SELECT *, CASE WHEN unsupported THEN NOT has ELSE has AND block AND file END AS hit FROM j)
SELECT count(*) AS scored, count(*) FILTER (hit) AS correct, count(*) FILTER (unsupported) AS unsupported, count(*) FILTER (unsupported AND hit) AS unsupported_correct, count(*) FILTER (unsupported AND has) AS hallucinated, count(*) FILTER (NOT has AND NOT unsupported) AS missing,
CAST(count(*) FILTER (hit) AS DOUBLE) / count(*) AS accuracy, CAST(count(*) FILTER (unsupported AND has) AS DOUBLE) / count(*) FILTER (unsupported) AS hallucination_rate FROM s""")
def evidence_benchmark(spark, d):
    i = F.expr("cast(substring(node_id, 5) AS bigint)")
    rows = A.text_nodes(spark, d).join(A.text_assignments(spark, d), "node_id")
    answers = rows.where(i % 50 % 7 != 6).select(F.concat(F.lit("q"), (i % 50).cast("string")).alias("id"), "file_path", F.concat(F.array("primary_block"), F.transform("secondary", lambda s: s["block"])).alias("blocks"))
    k = F.col("k")
    some = lambda when, what: F.when(when, F.array(what)).otherwise(F.array().cast("array<string>"))
    asked = A.table(spark, d, "documents").select((F.col("doc_id") % 50).alias("k")).distinct()
    asked = asked.select(F.concat(F.lit("q"), k.cast("string")).alias("id"), some(k % 2 == 0, F.lit("Network Edge")).alias("expected_blocks"), some(k % 3 == 1, F.concat(k.cast("string"), F.lit("/README.ts"))).alias("expected_files"), some(k % 3 == 0, F.lit("1*/src/*")).alias("expected_globs"), (k % 7 >= 5).alias("unsupported"))
    return evaluation.evidence_report(evaluation.evidence_scores(asked, answers))


@query(f"WITH {A.NODES_SQL} SELECT node_id, kind, label FROM nodes ORDER BY coalesce(file_path, ''), kind, label, node_id LIMIT 80")
def review_nodes(spark, d):
    return evaluation.review_packet(A.nodes(spark, d), A.edges(spark, d))[0].select("node_id", "kind", "label")


@query(f"WITH {A.EDGES_SQL.replace('edges AS (', f'{A.NODES_SQL}, edges AS (', 1)} SELECT DISTINCT target_id AS node_id FROM edges WHERE edge_type = 'IMPORTS_MODULE'")
def external_modules(spark, d):
    return store.modules(A.edges(spark, d))
