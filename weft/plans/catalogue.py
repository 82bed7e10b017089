"""Queries over the driver's tables, one or more for each operator, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import ids
from weft.operators import answers, classify, enrichment, evaluation, evidence, graph, integrity, phases, regret, retrieval, simulate, temporal
from weft.plans import adapters as A
from weft.plans import project  # noqa: F401  (registers its queries)
from weft.plans.registry import ORACLE_SQL, QUERIES, query
from weft.session import shared_folder
from weft.sources import files, graph_store, history, store

NODES, EDGES, CHANGES, ASSIGN = A.NODES_SQL, A.EDGES_SQL, A.CHANGES_SQL, A.ASSIGN_SQL
SNAPS = """snaps AS (SELECT DISTINCT repo, day, path, block FROM changes),
pairs AS (SELECT * FROM (SELECT repo, lag(day) OVER (PARTITION BY repo ORDER BY day) AS before, day AS after FROM (SELECT DISTINCT repo, day FROM snaps)) WHERE before IS NOT NULL),
sides AS (SELECT p.*, path, block, true AS new FROM snaps s JOIN pairs p ON s.repo = p.repo AND day = after UNION ALL SELECT p.*, path, block, false FROM snaps s JOIN pairs p ON s.repo = p.repo AND day = before)"""
DIFFS = """sets AS (SELECT repo, before, after, path, coalesce(string_agg(DISTINCT block, ',' ORDER BY block) FILTER (NOT new), '') AS before_blocks, coalesce(string_agg(DISTINCT block, ',' ORDER BY block) FILTER (new), '') AS after_blocks FROM sides GROUP BY ALL),
diffs AS (SELECT *, CASE WHEN before_blocks = '' THEN 'A' WHEN after_blocks = '' THEN 'D' ELSE 'M' END AS status FROM sets WHERE before_blocks <> after_blocks)"""


# lookups, filters, joins


@query(f"WITH {NODES} SELECT * FROM nodes WHERE node_id = 'customer:7'")
def node_lookup(spark, d):
    return graph.node_lookup(A.nodes(spark, d), "customer:7")


@query(f"WITH {NODES}, {EDGES} SELECT * FROM edges WHERE source_id = 'customer:7' UNION ALL SELECT * FROM edges WHERE target_id = 'customer:7'")
def incident_edges_both(spark, d):
    return graph.incident_edges(A.edges(spark, d), "customer:7", limit=10_000)


@query(f"WITH {NODES}, {EDGES} SELECT count(*) FILTER (source_id = 'supplier:3') + count(*) FILTER (target_id = 'supplier:3') AS n FROM edges")
def incident_count(spark, d):
    return graph.incident_count(A.edges(spark, d), "supplier:3")


@query(f"WITH {ASSIGN} SELECT * FROM assign WHERE block = 'BUILDING' AND confidence >= 0.5")
def block_filter_conf(spark, d):
    return graph.assigned(A.assignments(spark, d), "BUILDING", 0.5)


@query(f"WITH {NODES}, {ASSIGN} SELECT DISTINCT file_path FROM assign JOIN nodes USING (node_id) WHERE block = 'BUILDING' AND confidence >= 0.9 ORDER BY 1")
def files_for_block(spark, d):
    return graph.files_for_block(A.nodes(spark, d), A.assignments(spark, d), "BUILDING", 0.9)


@query(f"WITH {NODES}, {ASSIGN} SELECT node_id, block, confidence, label, file_path FROM assign LEFT JOIN nodes USING (node_id)")
def block_nodes_left_join(spark, d):
    return graph.assigned_nodes(A.nodes(spark, d), A.assignments(spark, d))


@query("SELECT c_custkey AS entity_id, c_name AS name, count(o_orderkey) AS n_actions FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def group_join_entities(spark, d):
    acts = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return A.table(spark, d, "customer").join(acts, "c_custkey", "left").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n_actions"))


@query(f"WITH {NODES}, {EDGES} SELECT source_id, target_id, edge_type, s.file_path AS source_path, t.file_path AS target_path FROM edges LEFT JOIN nodes s ON s.node_id = source_id LEFT JOIN nodes t ON t.node_id = target_id")
def endpoint_paths(spark, d):
    return graph.endpoint_paths(A.nodes(spark, d), A.edges(spark, d))


@query(f"""WITH {NODES}, {EDGES}, {ASSIGN}, blocks AS (SELECT node_id, block FROM assign UNION ALL SELECT 'order:' || o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT source_id, target_id, edge_type FROM edges JOIN blocks s ON s.node_id = source_id JOIN blocks t ON t.node_id = target_id WHERE s.block = t.block""")
def same_block_edges(spark, d):
    return graph.same_block_edges(A.edges(spark, d), _blocks(spark, d))


def _blocks(spark, d):
    orders = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return A.assignments(spark, d).select("node_id", "block").unionByName(orders.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("node_id"), F.col("c_mktsegment").alias("block")))


@query("""WITH spans AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS span_id, CAST(l_quantity AS BIGINT) AS low, CAST(l_quantity AS BIGINT) + l_linenumber * 3 AS high FROM lineitem),
points AS (SELECT p_partkey AS k, p_partkey AS point_id, CAST(p_size AS BIGINT) AS "at" FROM part),
r AS (SELECT points.k, point_id, points."at", span_id, points."at" BETWEEN low AND high AS inside,
  row_number() OVER (PARTITION BY points.k, point_id ORDER BY NOT (points."at" BETWEEN low AND high), CASE WHEN points."at" BETWEEN low AND high THEN high - low ELSE least(abs(points."at" - low), abs(points."at" - high)) END, span_id) AS rn
  FROM points JOIN spans USING (k))
SELECT k, point_id, "at", span_id, inside FROM r WHERE rn = 1""")
def containment_join(spark, d):
    q = F.col("l_quantity").cast("long")
    spans = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_id"), q.alias("low"), (q + F.col("l_linenumber") * 3).alias("high"))
    points = A.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").alias("point_id"), F.col("p_size").cast("long").alias("at"))
    return graph.containment_join(points, spans, "k")


@query(f"WITH {NODES}, {EDGES} SELECT node_id, kind FROM nodes WHERE node_id NOT IN (SELECT target_id FROM edges WHERE edge_type IN ('CONTAINS', 'CALLS')) AND node_id NOT IN (SELECT source_id FROM edges WHERE edge_type IN ('CONTAINS', 'CALLS'))")
def orphans_anti_join(spark, d):
    return graph.orphans(A.nodes(spark, d), A.edges(spark, d), ["CONTAINS", "CALLS"]).select("node_id", "kind")


@query("SELECT p_brand AS symbol, min(s_name) AS first_foreign FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> 0 GROUP BY 1")
def cross_repo_first(spark, d):
    joined = A.table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(A.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(A.table(spark, d, "supplier").where("s_nationkey <> 0"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("p_brand").alias("symbol")).agg(F.min("s_name").alias("first_foreign"))


@query(f"""WITH {NODES}, {EDGES}, renamed AS (SELECT 'customer:' || c_custkey AS old_id, c_name AS new_id FROM customer WHERE c_custkey % 2 = 0)
SELECT source_id, coalesce(new_id, target_id) AS target_id, edge_type FROM edges LEFT JOIN renamed ON target_id = old_id""")
def id_rewrite(spark, d):
    renamed = A.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("old_id"), F.col("c_name").alias("new_id"))
    return graph.rewrite_targets(A.edges(spark, d), renamed)


@query("""WITH code AS (SELECT 'supplier:' || s_suppkey AS node_id, s_nationkey AS file_id FROM supplier),
fe AS (SELECT DISTINCT s_nationkey AS source_id, c_nationkey AS target_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
i AS (SELECT source_id AS file_id, string_agg(DISTINCT CAST(target_id AS VARCHAR), ',' ORDER BY CAST(target_id AS VARCHAR)) AS imports FROM fe GROUP BY 1),
b AS (SELECT target_id AS file_id, string_agg(DISTINCT CAST(source_id AS VARCHAR), ',' ORDER BY CAST(source_id AS VARCHAR)) AS imported_by FROM fe GROUP BY 1)
SELECT c.node_id, coalesce(imports, '') AS imports, coalesce(imported_by, '') AS imported_by, coalesce((SELECT string_agg(o.node_id, ',' ORDER BY o.node_id) FROM code o WHERE o.file_id = c.file_id AND o.node_id <> c.node_id), '') AS same_file
FROM code c LEFT JOIN i USING (file_id) LEFT JOIN b USING (file_id)""")
def neighborhoods(spark, d):
    return _neighborhoods(spark, d, A.table(spark, d, "lineitem"))


def _neighborhoods(spark, d, lines):
    supplier = A.table(spark, d, "supplier")
    code = supplier.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node_id"), F.col("s_nationkey").cast("string").alias("file_id"))
    line = lines.select("l_orderkey", "l_suppkey")
    fe = line.join(A.table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(A.table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    fe = fe.select(F.col("s_nationkey").cast("string").alias("source_id"), F.col("c_nationkey").cast("string").alias("target_id")).distinct()
    out = graph.neighborhoods(code, fe)
    return out.select("node_id", *(F.array_join(c, ",").alias(c) for c in ("imports", "imported_by", "same_file")))


@query(f"""WITH {NODES}, {EDGES}, known AS (SELECT * FROM nodes WHERE kind <> 'supplier')
SELECT source_id, target_id, edge_type, 'source' AS side FROM edges WHERE source_id NOT IN (SELECT node_id FROM known)
UNION ALL SELECT source_id, target_id, edge_type, 'target' FROM edges WHERE target_id NOT IN (SELECT node_id FROM known) AND NOT (edge_type = 'IMPORTS_MODULE' AND target_id LIKE 'module:%')""")
def dangling_edges(spark, d):
    return graph.dangling_edges(A.nodes(spark, d).where("kind <> 'supplier'"), A.edges(spark, d))


@query(f"WITH {NODES}, {EDGES} SELECT source_id, target_id, edge_type FROM edges WHERE target_id NOT IN (SELECT node_id FROM nodes) AND edge_type = 'IMPORTS_MODULE' AND target_id LIKE 'module:%'")
def external_endpoints(spark, d):
    return graph.external_endpoints(A.nodes(spark, d), A.edges(spark, d))


@query(f"WITH {NODES}, {EDGES} SELECT * FROM nodes WHERE layer = 'code' AND node_id NOT IN (SELECT target_id FROM edges WHERE edge_type = 'CONTAINS')")
def missing_containment(spark, d):
    return graph.missing_containment(A.nodes(spark, d), A.edges(spark, d)).select("node_id", "layer", "kind", "label", "repo_name", "file_path")


@query(f"WITH {NODES}, {EDGES} SELECT node_id, layer, kind FROM nodes WHERE node_id IN (SELECT src FROM both_ways WHERE dst IN (SELECT node_id FROM nodes))")
def derived_evidence_semi(spark, d):
    return graph.connected_to_known(A.nodes(spark, d), A.edges(spark, d)).select("node_id", "layer", "kind")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def stale_targets(spark, d):
    orders = A.table(spark, d, "orders")
    retired = orders.join(A.table(spark, d, "customer").where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return retired.join(A.table(spark, d, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT l_partkey AS target, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS labels FROM lineitem GROUP BY 1")
def labels_by_target(spark, d):
    return A.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("target")).agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("labels"))


@query(f"WITH {NODES}, {EDGES} SELECT source_id, target_id, edge_type, s.label AS source_label, t.label AS target_label FROM edges LEFT JOIN nodes s ON s.node_id = source_id LEFT JOIN nodes t ON t.node_id = target_id WHERE edge_type = 'CALLS'")
def edge_enrichment(spark, d):
    return graph.with_labels(A.nodes(spark, d), A.edges(spark, d).where("edge_type = 'CALLS'"))


@query("""WITH rows AS (SELECT l_partkey AS node_id, l_orderkey * 10 + l_linenumber AS ord, l_returnflag AS kind, l_linestatus AS label FROM lineitem)
SELECT node_id, ord, kind, label FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ord DESC) AS rn FROM rows) WHERE rn = 1""")
def nodes_union_last_wins(spark, d):
    line = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("node_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("label"))
    return graph.last_written(line, ["node_id"], "ord")


@query("""WITH rows AS (SELECT l_suppkey AS node_id, l_orderkey * 10 + l_linenumber AS ord, l_returnflag AS kind FROM lineitem)
SELECT node_id, ord, kind FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ord) AS rn FROM rows) WHERE rn = 1""")
def first_dedupe(spark, d):
    line = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_returnflag").alias("kind"))
    return graph.first_seen(line, ["node_id"], "ord")


@query("SELECT DISTINCT 'order:' || l_orderkey AS source_id, 'part:' || l_partkey AS target_id, l_returnflag AS edge_type FROM lineitem")
def edge_distinct(spark, d):
    line = A.table(spark, d, "lineitem")
    return line.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target_id"), F.col("l_returnflag").alias("edge_type")).dropDuplicates()


@query("""WITH e AS (SELECT user_id, list_distinct(list(event_type)) AS have FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_intersect(have, ['click', 'purchase', 'refund'])), ',') AS hit, array_to_string(list_sort(list_filter(['click', 'purchase', 'refund'], lambda x: NOT list_contains(have, x))), ',') AS missing FROM e""")
def array_set_ops(spark, d):
    want = F.array(*(F.lit(x) for x in ("click", "purchase", "refund")))
    have = A.table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    join = lambda x: F.array_join(F.sort_array(x), ",")
    return have.select("user_id", join(F.array_intersect(want, "have")).alias("hit"), join(F.array_except(want, "have")).alias("missing"))


@query("SELECT p_brand AS symbol, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS nodes FROM part GROUP BY 1")
def symbol_multimap(spark, d):
    return A.table(spark, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",").alias("nodes"))


# aggregates


@query(f"WITH {NODES}, {EDGES} SELECT edge_type, count(*) AS n FROM edges GROUP BY 1")
def edge_type_counts(spark, d):
    return A.edges(spark, d).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NODES}, {EDGES} SELECT src AS node_id, count(*) AS degree FROM both_ways GROUP BY 1")
def degree(spark, d):
    return graph.degrees(A.edges(spark, d))


@query(f"""WITH {NODES}, t AS (SELECT file_path, count(*) AS n FROM nodes WHERE file_path IS NOT NULL GROUP BY 1 ORDER BY n DESC, file_path LIMIT 10),
r AS (SELECT file_path, label, row_number() OVER (PARTITION BY file_path ORDER BY node_id) AS r FROM nodes)
SELECT file_path, any_value(n) AS n, string_agg(label, ',' ORDER BY r) AS names FROM t JOIN r USING (file_path) WHERE r <= 5 GROUP BY 1""")
def top_files(spark, d):
    return evaluation.top_files(A.nodes(spark, d))


@query("SELECT o_orderpriority AS grp, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS ratio FROM orders GROUP BY 1")
def ratios(spark, d):
    return A.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(ids.ratio(F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1))).alias("ratio"))


@query(f"WITH {CHANGES} SELECT path, count(*) AS n FROM changes GROUP BY 1 HAVING count(*) >= 12")
def dense_having(spark, d):
    return A.changes(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")


@query("SELECT c_mktsegment AS block, count(*) AS n, count(DISTINCT c_nationkey) AS files, CAST(count(*) FILTER (c_acctbal > 5000) AS DOUBLE) / count(*) AS coverage FROM customer GROUP BY 1")
def block_coverage(spark, d):
    return A.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("files"), ids.ratio(F.count_if(F.col("c_acctbal") > 5000), F.count(F.lit(1))).alias("coverage"))


@query("SELECT l_suppkey AS grp, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS total, max(l_linenumber) AS top FROM lineitem GROUP BY 1")
def group_totals(spark, d):
    return A.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("total"), F.max("l_linenumber").alias("top"))


# classification

SIGNALS = [("articles", "(^| )the( |$)", 1.5), ("articles", "(^| )des( |$)", 1.0), ("links", "(^| )and( |$)", 2.0), ("links", "(^| )und( |$)", 2.0), ("licence", "licensed under", 3.0)]
PATHS = [("View", "view"), ("Money", "purchase|click"), ("Faults", "error"), ("Entry", "signup")]
ACTIONS = [("AUTHORIZE", "building|auth"), ("PERSIST", "house|store"), ("CONNECT", "auto|net")]


def _signals_sql() -> str:
    cases = ", ".join(f"{{'block': '{b}', 'ord': {i}, 'score': " + " + ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN {w}::DOUBLE ELSE 0::DOUBLE END" for bb, p, w in SIGNALS if bb == b) + "}" for i, b in enumerate(dict.fromkeys(b for b, _, _ in SIGNALS)))
    return f"WITH low AS (SELECT doc_id, lower(substr(coalesce(text, ''), 1, 2000)) AS low FROM documents), s AS (SELECT doc_id, unnest([{cases}]) AS s FROM low), scores AS (SELECT doc_id, s.block AS block, s.score AS score, s.ord AS ord FROM s WHERE s.score > 0)"


@query(_signals_sql() + " SELECT doc_id, block, score FROM scores")
def classify_signals(spark, d):
    return classify.signal_scores(A.table(spark, d, "documents"), SIGNALS).select("doc_id", "block", "score")


@query(_signals_sql() + ", r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM scores WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, ord)) SELECT doc_id, block AS primary_block, score, score - coalesce(nxt, 0) AS margin FROM r WHERE rn = 1")
def primary_block(spark, d):
    return classify.primary_block(classify.signal_scores(A.table(spark, d, "documents"), SIGNALS).select("doc_id", "block", "score", F.col("ord")))


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x = 'the')) AS BIGINT) AS n_the FROM documents")
def barrel_counts(spark, d):
    return classify.barrel_counts(A.table(spark, d, "documents"), ["the"])


def _classified_sql() -> str:
    """The classifier's rules as one list of weights a node; letters outside ASCII count as letters."""
    like = lambda c, p: f"regexp_matches({c}, '(?is){p}')"
    n = lambda w: f"len(regexp_extract_all(c, '\\b({w})\\b'))"
    rules = [(b, f"kind = '{k}'", w) for k, (b, w, _) in classify.KIND_PRIORS.items()]
    rules += [(b, like("p", x), w) for b, x, w, _ in classify.PATH_PRIORS]
    rules += [(b, like("low", x), w) for b, x, w, _ in classify.SIGNALS]
    database = like("low", r"\b(prisma|database|postgres|schema|migration)\b")
    rules += [
        ("Data Persistence", f"kind = 'config_object' AND {database}", 2.0),
        ("Security Ops", f"kind = 'config_object' AND NOT {database} AND " + like("low", r"\b(secret|key|token|env)\b"), 1.5),
        ("Identity UI", "kind = 'react_hook' AND " + like("low", r"\b(auth|session|user|profile)\b"), 1.7),
        ("Search Architecture", "kind = 'file_surface' AND (" + like("p", r"/index\.(ts|tsx|js|jsx)$") + " OR p LIKE '%index.ts')", f"2.0::DOUBLE + least({n('export')}, 4) * 0.25::DOUBLE"),
        ("Global Interface", "kind = 'file_surface' AND " + like("p", r"(^|/)(config|env|settings|drizzle|prisma)(/|\.)"), 1.6),
        ("Connectivity Layer", f"kind = 'file_surface' AND {n('import')} >= 2 AND {n('export')} >= 1", 0.8),
    ]
    weights = ", ".join(f"CASE WHEN {c} THEN CAST({w} AS DOUBLE) ELSE 0 END" for _, c, w in rules)
    blocks = []
    for block in dict.fromkeys(b for b, _, _ in rules):
        at = [i + 1 for i, r in enumerate(rules) if r[0] == block]
        first = "coalesce(" + ", ".join(f"CASE WHEN w[{i}] > 0 THEN {i} END" for i in at) + ")"
        blocks.append(f"{{'s': -({' + '.join(f'w[{i}]' for i in at)}), 'o': {first}, 'block': '{block}'}}")
    ascii_ = "regexp_replace(lower({}), '[^\\x00-\\x7F]', 'x', 'g')"
    return f"""WITH {A.TEXT_SQL}, h AS (SELECT node_id, kind, file_path AS p, {ascii_.format("file_path || ' ' || label || ' ' || substr(content, 1, 2000)")} AS low, {ascii_.format("content")} AS c FROM text_nodes),
ws AS (SELECT node_id, [{weights}] AS w FROM h), rs AS (SELECT node_id, list_sort(list_filter([{", ".join(blocks)}], lambda x: x.s < 0))[1:4] AS r FROM ws),
t AS (SELECT node_id, r, -r[1].s AS top, -r[1].s - coalesce(-r[2].s, 0::DOUBLE) AS margin FROM rs)
SELECT node_id, coalesce(r[1].block, 'Identity UI') AS primary_block, CASE WHEN len(r) = 0 THEN 0.1::DOUBLE ELSE least(0.42::DOUBLE + 0.08::DOUBLE * top + 0.06::DOUBLE * margin, 0.95::DOUBLE, CASE WHEN margin < 0.75 THEN 0.66::DOUBLE ELSE 1.0 END) END AS confidence,
array_to_string(list_transform(list_filter(r[2:4], lambda x: -x.s >= greatest(1.5::DOUBLE, top * 0.45::DOUBLE)), lambda x: x.block), ',') AS secondary FROM t"""


@query(_classified_sql())
def classify_full(spark, d):
    made = classify.classify_nodes(A.text_nodes(spark, d))
    return made.select("node_id", "primary_block", "confidence", F.array_join(F.transform("secondary", lambda x: x["block"]), ",").alias("secondary"))


@query("SELECT event_id, event_type AS path, CASE WHEN event_type LIKE '%view%' THEN 'View' WHEN regexp_matches(event_type, 'purchase|click') THEN 'Money' WHEN event_type LIKE '%error%' THEN 'Faults' WHEN event_type LIKE '%signup%' THEN 'Entry' ELSE 'Unclassified' END AS blocks FROM events")
def path_blocks(spark, d):
    return classify.path_blocks(A.table(spark, d, "events").select("event_id", F.col("event_type").alias("path")), PATHS)


@query("""WITH h AS (SELECT lower(substr(coalesce(text, ''), 1, 800)) AS low FROM documents),
p AS (SELECT 'english' AS pattern_id, (CASE WHEN contains(low, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(low, 'and') THEN 1 ELSE 0 END) AS n FROM h
  UNION ALL SELECT 'german', (CASE WHEN contains(low, 'und') THEN 1 ELSE 0 END + CASE WHEN contains(low, 'der') THEN 1 ELSE 0 END) FROM h)
SELECT pattern_id, CAST(sum(n) AS BIGINT) AS hits, count(*) AS n_nodes FROM p WHERE n > 0 GROUP BY 1""")
def keyword_patterns(spark, d):
    return classify.keyword_patterns(A.table(spark, d, "documents"), {"english": ("the", "and"), "german": ("und", "der")})


@query("SELECT c_custkey, c_mktsegment AS name, CASE WHEN regexp_matches(lower(c_mktsegment), 'building|auth') THEN 'AUTHORIZE' WHEN regexp_matches(lower(c_mktsegment), 'house|store') THEN 'PERSIST' WHEN regexp_matches(lower(c_mktsegment), 'auto|net') THEN 'CONNECT' ELSE 'REPRESENT' END AS action FROM customer")
def actions_infer(spark, d):
    return classify.infer_actions(A.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("name")), ACTIONS)


@query("SELECT p_type AS category, p_brand AS name, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, category, name LIMIT 200")
def entities_top200(spark, d):
    return classify.count_entities(A.table(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("name")))


# retrieval

QUESTION = "where is the retitioning and onding text"


@query("""WITH s AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
k AS (SELECT doc_id, (CASE WHEN contains(t, 'retitioning') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN contains(t, 'onding') THEN 1.0 ELSE 0 END + CASE WHEN contains(t, 'text') THEN 1.0 ELSE 0 END + CASE WHEN contains(t, 'where is the retitioning and onding text') THEN 3.0 ELSE 0 END) AS score FROM s)
SELECT * FROM k WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def lexical_rank(spark, d):
    return retrieval.lexical_rank(A.table(spark, d, "documents"), QUESTION)


@query("""WITH n AS (SELECT l_suppkey AS s, count(*) AS n_actions FROM lineitem GROUP BY 1),
k AS (SELECT s_suppkey AS entity_id, s_name AS name, coalesce(n_actions, 0) AS n_actions, (CASE WHEN contains(lower(s_name), 'supplier') THEN 1.0::DOUBLE ELSE 0 END) + 0.2 * least(coalesce(n_actions, 0), 5) AS score FROM supplier LEFT JOIN n ON s = s_suppkey)
SELECT * FROM k ORDER BY score DESC, name LIMIT 20""")
def entity_rank(spark, d):
    return _entity_rank(spark, d, A.table(spark, d, "lineitem"))


def _entity_rank(spark, d, lines):
    entities = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"))
    acts = lines.select(F.col("l_suppkey").alias("entity_id"))
    return retrieval.entity_rank(entities, acts, "which supplier")


STEPS = [("RENDER", "view"), ("PROCESS", "click"), ("PERSIST", "purchase"), ("CREATE", "signup"), ("OBSERVE", "error")]


@query("""WITH a AS (SELECT CASE WHEN event_type LIKE '%view%' THEN 'RENDER' WHEN event_type LIKE '%click%' THEN 'PROCESS' WHEN event_type LIKE '%purchase%' THEN 'PERSIST' WHEN event_type LIKE '%signup%' THEN 'CREATE' WHEN event_type LIKE '%error%' THEN 'OBSERVE' ELSE 'REPRESENT' END AS action FROM events UNION ALL SELECT o_orderpriority FROM orders)
SELECT action, CAST(CASE action WHEN 'CREATE' THEN 3 WHEN 'PROCESS' THEN 5 WHEN 'PERSIST' THEN 6 WHEN 'OBSERVE' THEN 7 WHEN 'RENDER' THEN 8 WHEN 'REPRESENT' THEN 9 ELSE 50 END AS INTEGER) AS rank, count(*) AS n FROM a GROUP BY 1, 2""")
def workflow_order(spark, d):
    named = classify.infer_actions(A.table(spark, d, "events").select("event_type"), STEPS, "event_type").select("action")
    every = named.union(A.table(spark, d, "orders").select("o_orderpriority"))
    return every.groupBy("action").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", retrieval.workflow_rank(F.col("action")))


@query(f"""WITH {ASSIGN}, k AS (SELECT node_id, 3.0::DOUBLE * (CASE WHEN block = 'BUILDING' THEN 1 ELSE 0 END + CASE WHEN node_id LIKE '%3' THEN 1 ELSE 0 END) + 3.0::DOUBLE * confidence + 0.9::DOUBLE * least(length(node_id) * 7 % 8, 5)
  - CASE WHEN node_id LIKE '%0' THEN 0.25::DOUBLE ELSE 0.0 END - CASE WHEN node_id LIKE '%7' THEN 1.5::DOUBLE ELSE 0.0 END - CASE WHEN length(node_id) * 7 % 8 = 0 THEN 2.0::DOUBLE ELSE 0.0 END - CASE WHEN length(node_id) * 7 % 8 = 0 AND confidence < 0.35 THEN 2.5::DOUBLE ELSE 0.0 END AS raw FROM
  (SELECT repeat('x', CAST(replace(node_id, 'customer:', '') AS INTEGER) % 9) || node_id AS node_id, block, confidence FROM assign))
SELECT node_id, CAST(floor(raw * 1000 + 0.5) AS BIGINT) AS score FROM k""")
def candidate_score(spark, d):
    a = A.assignments(spark, d)
    a = a.withColumn("node_id", F.concat(F.expr("repeat('x', cast(replace(node_id, 'customer:', '') AS int) % 9)"), "node_id"))
    matched = F.when(F.col("block") == "BUILDING", 1).otherwise(0) + F.when(F.col("node_id").endswith("3"), 1).otherwise(0)
    score = retrieval.candidate_score(matched, F.col("confidence"), F.length("node_id") * 7 % 8, F.col("node_id").endswith("0"), F.col("node_id").endswith("7"))
    return a.select("node_id", F.floor(score * 1000 + 0.5).cast("long").alias("score"))


def _balanced_sql(blocks: list[str], order: str, most: int = 4) -> str:
    """The balanced choice from a table cand, block by block."""
    ctes, before = [], ""
    for i, block in enumerate(blocks):
        left = f" AND node_id NOT IN ({before})" if before else ""
        ctes.append(f"c{i} AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY {order}) AS rf FROM cand WHERE block = '{block}'{left})")
        ctes.append(f"t{i} AS (SELECT *, row_number() OVER (ORDER BY {order}) AS k FROM c{i} WHERE rf = 1 QUALIFY row_number() OVER (ORDER BY {order}) <= {most})")
        before += (" UNION ALL " if before else "") + f"SELECT node_id FROM t{i}"
    rows = " UNION ALL ".join(f"SELECT {i} AS b, k, block, node_id, file_path, score FROM t{i}" for i in range(len(blocks)))
    return ", ".join(ctes) + f", chosen AS (SELECT CAST(row_number() OVER (ORDER BY b, k) - 1 AS INTEGER) AS ord, block, node_id, file_path, score FROM ({rows}))"


@query(f"""WITH {NODES}, {ASSIGN}, own AS (SELECT node_id, file_path, block, confidence AS score FROM assign JOIN nodes USING (node_id)),
cand AS (SELECT * FROM own UNION ALL SELECT node_id, file_path, 'MACHINERY', score * 0.99::DOUBLE FROM own WHERE block = 'BUILDING' UNION ALL SELECT node_id, file_path, 'FURNITURE', score * 0.98::DOUBLE FROM own WHERE block <> 'FURNITURE'),
{_balanced_sql(["BUILDING", "MACHINERY", "FURNITURE"], "score DESC, node_id")} SELECT * FROM chosen""")
def balanced_topk(spark, d):
    own = A.assignments(spark, d).join(A.nodes(spark, d).select("node_id", "file_path"), "node_id").select("node_id", "file_path", "block", F.col("confidence").alias("score"))
    second = own.where("block = 'BUILDING'").select("node_id", "file_path", F.lit("MACHINERY"), F.col("score") * 0.99)
    third = own.where("block <> 'FURNITURE'").select("node_id", "file_path", F.lit("FURNITURE"), F.col("score") * 0.98)
    return retrieval.balanced_top(own.union(second).union(third), ["BUILDING", "MACHINERY", "FURNITURE"])


ASKED = "how does the auth guard check a session token before the database store is read"


def _ranked_sql(asked: str) -> str:
    intent = evidence.plan_question(asked)
    flag = {b: f"list_contains(blocks, '{b}')" for b in intent.blocks}
    words = dict.fromkeys(w for b in intent.blocks for w in evidence.BLOCK_KEYWORDS[b])
    hits = " + ".join(f"CASE WHEN contains(text, '{w}') AND ({' OR '.join(flag[b] for b in intent.blocks if w in evidence.BLOCK_KEYWORDS[b])}) THEN 1 ELSE 0 END" for w in words)
    matched = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in flag.values())
    one = lambda w: f"CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END"
    fits = " UNION ALL ".join(
        f"SELECT node_id, file_path, '{b}' AS block, (CASE WHEN primary_block = '{b}' THEN confidence WHEN second = '{b}' THEN second_confidence ELSE 0.0::DOUBLE END) * 4.0::DOUBLE + least({' + '.join(map(one, evidence.BLOCK_KEYWORDS[b]))}, 5) * 1.2::DOUBLE - CASE WHEN is_test THEN 2.0::DOUBLE ELSE 0 END AS score, is_test, overall FROM ranked WHERE {c}"
        for b, c in flag.items()
    )
    return f"""WITH {A.TEXT_SQL}, joined AS (SELECT n.*, a.primary_block, a.confidence, a.second, a.second_confidence, list_distinct(list_filter([primary_block, second], lambda x: x IS NOT NULL)) AS blocks, lower(file_path || ' ' || label || ' ' || kind || '  ' || content) AS text,
  regexp_matches(file_path, '(?i)(^|/)(tests?|__tests__)/|_test\\.|\\.test\\.|\\.spec\\.') AS is_test FROM text_nodes n JOIN text_assign a USING (node_id)),
hit AS (SELECT *, {hits} AS hits, {matched} AS matched FROM joined),
every AS (SELECT *, 3.0::DOUBLE * matched + 3.0::DOUBLE * confidence + 0.9::DOUBLE * least(hits, 5) - CASE WHEN kind = 'file_surface' THEN 0.25::DOUBLE ELSE 0 END - CASE WHEN is_test THEN 1.5::DOUBLE ELSE 0 END - CASE WHEN hits = 0 THEN 2.0::DOUBLE ELSE 0 END - CASE WHEN hits = 0 AND confidence < 0.35::DOUBLE THEN 2.5::DOUBLE ELSE 0 END AS overall FROM hit WHERE matched > 0),
ranked AS (SELECT * FROM every WHERE overall > 0),
cand AS ({fits}), """


def _answer_sql(asked: str = ASKED) -> str:
    blocks = list(evidence.plan_question(asked).blocks)
    return _ranked_sql(asked) + _balanced_sql(blocks, "score DESC, is_test, overall DESC, file_path, node_id")


@query(_answer_sql() + " SELECT ord, c.block, c.node_id, c.file_path, r.kind, r.overall AS score FROM chosen c JOIN ranked r USING (node_id)")
def answer_evidence(spark, d):
    return evidence.answer(A.text_nodes(spark, d), A.text_assignments(spark, d), ASKED).select("ord", "block", "node_id", "file_path", "kind", "score")


#: Questions that pages ask in turn.
QUESTIONS = (ASKED, "where is the environment config of a rendered component", "what does the queue worker cache", "which login page shows a profile", "log a secret hash for each request")


def _asked(spark, d):
    return A.table(spark, d, "pages").select(F.col("page_id").alias("id"), A._turn(QUESTIONS, F.col("page_id")).alias("question"))


_EACH = " UNION ALL ".join(f"SELECT {i} AS turn, * FROM ({_answer_sql(q)} SELECT ord, c.block, c.node_id, c.file_path, r.kind, round(r.overall, 9) AS score FROM chosen c JOIN ranked r USING (node_id))" for i, q in enumerate(QUESTIONS))


@query(f"SELECT page_id AS id, ord, block, node_id, file_path, kind, score FROM pages JOIN ({_EACH}) ON page_id % {len(QUESTIONS)} = turn")
def answer_many(spark, d):
    found = answers.block_answers(A.text_nodes(spark, d), A.text_assignments(spark, d), _asked(spark, d))
    return found.select("id", "ord", "block", "node_id", "file_path", "kind", F.round("score", 9).alias("score"))


_STOPS = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
_TERMS = f"terms AS (SELECT id, question, list_filter(regexp_extract_all(lower(question), '[a-zA-Z][a-zA-Z0-9_]{{2,}}'), lambda t: t NOT IN ({_STOPS})) AS terms FROM asked)"
_SCORE = "list_sum(list_transform(terms, lambda t: CASE WHEN contains(low, t) THEN 1.0::DOUBLE ELSE 0 END)) + CASE WHEN contains(low, trim(lower(question))) THEN 3 ELSE 0 END"
_STEPS = ", ".join(f"'{w}'" for w in retrieval.WORKFLOW)
WORKFLOW_SQL = f"""WITH asked AS (SELECT n_nationkey AS id, 'trace what supplier' || n_nationkey % 7 || ' and the workflow of ' || n_name || ' produce' AS question FROM nation), {_TERMS},
entities AS (SELECT s_suppkey AS entity_id, s_name AS name, lower(s_name || ' ' || n_name || ' supplier' || s_suppkey % 9) AS low FROM supplier JOIN nation ON s_nationkey = n_nationkey),
acts AS (SELECT DISTINCT l_suppkey AS entity_id, 'order:' || l_orderkey AS node_id, {A._turn_sql(retrieval.WORKFLOW, "l_linenumber")} AS action FROM lineitem), n AS (SELECT entity_id, count(*) AS n FROM acts GROUP BY 1),
s AS (SELECT id, entity_id, name, {_SCORE} AS lexical FROM terms, entities),
h AS (SELECT id, entity_id, row_number() OVER (PARTITION BY id ORDER BY lexical + 0.2::DOUBLE * least(coalesce(n, 0), 5) DESC, name, entity_id) AS place FROM s LEFT JOIN n USING (entity_id) WHERE lexical > 0 QUALIFY place <= 30),
few AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY node_id, action) AS k FROM acts QUALIFY k <= 3),
p AS (SELECT id, h.entity_id, node_id, action FROM h JOIN few USING (entity_id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, k) <= 30),
steps AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY list_position([{_STEPS}], action), node_id, entity_id, action) - 1 AS INTEGER) AS ord, node_id, entity_id, action FROM p)"""


def _workflow(spark, d):
    k = F.col("n_nationkey")
    nation = A.table(spark, d, "nation")
    asked = nation.select(k.alias("id"), F.concat(F.lit("trace what supplier"), (k % 7).cast("string"), F.lit(" and the workflow of "), "n_name", F.lit(" produce")).alias("question"))
    entities = A.table(spark, d, "supplier").join(nation, F.col("s_nationkey") == k).select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.col("n_name").alias("category"), F.concat(F.lit("supplier"), (F.col("s_suppkey") % 9).cast("string")).alias("description"))
    acts = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("node_id"), A._turn(retrieval.WORKFLOW, F.col("l_linenumber")).alias("action")).distinct()
    return answers.workflow_answers(entities, acts, asked)


@query(WORKFLOW_SQL + " SELECT * FROM steps")
def workflow_answer(spark, d):
    return _workflow(spark, d)[0]


@query(WORKFLOW_SQL + """, c AS (SELECT id, count(*) AS steps FROM steps GROUP BY 1), a AS (SELECT id, count(*) AS acts FROM h JOIN acts USING (entity_id) GROUP BY 1)
SELECT id, CASE WHEN steps IS NULL THEN 'No semantic entities matched query: ' || question ELSE 'Workflow evidence for ''' || question || ''' spans ' || steps || ' semantic action edge(s).' END AS claim, CASE WHEN steps IS NULL THEN 0.2::DOUBLE ELSE round(least(0.55::DOUBLE + 0.05::DOUBLE * least(acts, 5), 0.85), 9) END AS confidence
FROM asked LEFT JOIN c USING (id) LEFT JOIN a USING (id)""")
def workflow_bundles(spark, d):
    return _workflow(spark, d)[1].withColumn("confidence", F.round("confidence", 9))


PROJECT_SQL = f"""WITH {A.TEXT_SQL}, asked AS (SELECT r_regionkey AS id, 'which service of project ' || r_name || ' has a logger metric' AS question FROM region UNION ALL SELECT 900, 'xq zzqj' UNION ALL SELECT 901, 'qqzx component'), {_TERMS},
texts AS (SELECT node_id, file_path, lower(file_path || ' ' || label || ' ' || kind || ' ' || content) AS low, regexp_matches(file_path, '(?i)(^|/)(tests?|__tests__)/|_test\\.|\\.test\\.|\\.spec\\.') AS is_test FROM text_nodes),
s AS (SELECT id, node_id, file_path, is_test, {_SCORE} AS score FROM terms, texts WHERE len(terms) > 0),
found AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, is_test, file_path, node_id) - 1 AS INTEGER) AS ord, node_id, file_path, score FROM s WHERE score > 0 QUALIFY ord < 20)"""


def _projects(spark, d):
    region = A.table(spark, d, "region")
    asked = region.select(F.col("r_regionkey").cast("int").alias("id"), F.concat(F.lit("which service of project "), "r_name", F.lit(" has a logger metric")).alias("question"))
    asked = asked.unionByName(spark.createDataFrame([(900, "xq zzqj"), (901, "qqzx component")], "id int, question string"))
    projects = region.select(ids.project_id("r_name").alias("project_id"), F.col("r_name").alias("name"), F.col("r_name").alias("repo_name"), F.lit("a project of services").alias("text"))
    return answers.project_answers(projects, A.text_nodes(spark, d), asked)


@query(PROJECT_SQL + " SELECT * FROM found")
def project_answer(spark, d):
    return _projects(spark, d)[0]


@query(PROJECT_SQL + f""", named AS (SELECT 'project:' || regexp_replace(r_name, '[^a-zA-Z0-9_.-]+', '_', 'g') AS project_id, r_name AS name, lower(r_name || ' ' || r_name || ' a project of services') AS low FROM region),
m AS (SELECT id, project_id, name, {_SCORE} AS lexical FROM terms, named WHERE len(terms) > 0), hit AS (SELECT * FROM m WHERE lexical > 0), n AS (SELECT id, count(*) AS n FROM found GROUP BY 1)
SELECT a.id, project_id, CASE WHEN coalesce(lexical, 0) + coalesce(n, 0) = 0 THEN 'No project evidence matched query: ' || question ELSE 'Project ' || coalesce(name, '(none)') || ' matched ''' || question || ''' with ' || coalesce(n, 0) || ' supporting node(s).' END AS claim,
  CASE WHEN coalesce(lexical, 0) + coalesce(n, 0) = 0 THEN 0.2::DOUBLE ELSE round(least(0.55::DOUBLE + 0.05::DOUBLE * coalesce(lexical, 0) + 0.03::DOUBLE * least(coalesce(n, 0), 5), 0.85), 9) END AS confidence
FROM asked a LEFT JOIN hit USING (id) LEFT JOIN n ON n.id = a.id""")
def project_bundles(spark, d):
    return _projects(spark, d)[1].withColumn("confidence", F.round("confidence", 9))


@query(_answer_sql() + """ SELECT 'answer_with_evidence' AS query_type, count(*) AS n_nodes, 'Access Control,Data Persistence,Security Ops' AS covered, '' AS missing,
round(least(0.25 + 0.45 * 1 + 0.3 * avg(CASE WHEN ord < 8 THEN r.confidence END), 0.95), 9) AS confidence FROM chosen c JOIN ranked r USING (node_id)""")
def answer_summary(spark, d):
    found = evidence.answer(A.text_nodes(spark, d), A.text_assignments(spark, d), ASKED)
    return evidence.summary(found, ASKED).drop("claim").withColumn("confidence", F.round("confidence", 9))


@query(f"WITH {A.TEXT_SQL} SELECT n.file_path, count(*) AS n_nodes, string_agg(DISTINCT primary_block, ', ' ORDER BY primary_block) AS blocks, 0.7::DOUBLE AS confidence FROM text_nodes n JOIN text_assign USING (node_id) GROUP BY 1")
def explain_file(spark, d):
    return evidence.explain_files(A.text_nodes(spark, d), A.text_assignments(spark, d))


@query(f"WITH {A.TEXT_SQL} SELECT n.node_id, n.file_path FROM text_nodes n JOIN text_assign USING (node_id) WHERE primary_block = 'Network Edge' OR second = 'Network Edge'")
def find_block(spark, d):
    return evidence.find_block(A.text_nodes(spark, d), A.text_assignments(spark, d), "Network Edge").select("node_id", "file_path")


@query(f"""WITH {A.TEXT_SQL}, k AS (SELECT node_id, file_path, lower(file_path || ' ' || label || ' ' || kind || ' ' || content) AS t FROM text_nodes),
s AS (SELECT node_id, file_path, (CASE WHEN contains(t, 'prisma') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN contains(t, 'tests') THEN 1.0 ELSE 0 END + CASE WHEN contains(t, 'query') THEN 1.0 ELSE 0 END + CASE WHEN contains(t, 'prisma or tests query') THEN 3.0 ELSE 0 END) AS score FROM k)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, regexp_matches(file_path, '(?i)(^|/)(tests?|__tests__)/|_test\\.|\\.test\\.|\\.spec\\.'), file_path, node_id LIMIT 20""")
def rank_nodes(spark, d):
    return evidence.rank_nodes(A.text_nodes(spark, d), "prisma or tests query")


@query(f"WITH {NODES}, {EDGES} SELECT 'customer:7' AS node_id, 'customer:7 is a ' || kind || ' surface in ' || file_path || '.' AS claim, 0.75::DOUBLE AS confidence, (SELECT count(*) FROM both_ways WHERE src = 'customer:7') AS incident FROM nodes WHERE node_id = 'customer:7'")
def explain_node(spark, d):
    return evidence.explain_node(A.nodes(spark, d), A.edges(spark, d), "customer:7")


def _planned_sql() -> str:
    blocks = ", ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN '{b}' END" for b, p, _ in evidence.INTENTS)
    return f"""WITH k AS (SELECT i.item_id, lower(i.question) AS q FROM (SELECT page_id AS item_id, split_part(url, '?', 1) || CASE page_id % 5 WHEN 0 THEN ' which service' WHEN 1 THEN ' login flow' WHEN 2 THEN ' delete entity' ELSE '' END AS question FROM pages) i),
p AS (SELECT item_id, q, list_filter([{blocks}], lambda x: x IS NOT NULL) AS b, regexp_matches(q, '{evidence.TRACE}') AS trace FROM k)
SELECT item_id, array_to_string(b, ',') AS blocks, trace, CASE WHEN len(b) > 0 THEN 'answer_with_evidence' WHEN regexp_matches(q, '{evidence.WORKFLOW}') THEN 'trace_entity_workflow' WHEN regexp_matches(q, '{evidence.PROJECT}') THEN 'query_projects' ELSE 'unsupported' END AS route FROM p"""


@query(_planned_sql())
def question_routes(spark, d):
    i = F.col("page_id") % 5
    tail = F.when(i == 0, " which service").when(i == 1, " login flow").when(i == 2, " delete entity").otherwise("")
    asked = A.table(spark, d, "pages").select(F.col("page_id").alias("item_id"), F.concat(F.substring_index("url", "?", 1), tail).alias("question"))
    return evidence.planned(asked).select("item_id", F.array_join("intent_blocks", ",").alias("blocks"), "trace", "route")


@query("WITH RECURSIVE " + _answer_sql().removeprefix("WITH ") + """, e AS (SELECT DISTINCT 'doc:' || doc_id AS source_id, 'doc:' || (doc_id * m + 1) % 1000 AS target_id FROM documents, (VALUES (3), (7), (11), (13), (17), (19)) t(m)),
pairs AS (SELECT * FROM (SELECT ord AS pair, node_id AS s, lead(node_id) OVER (ORDER BY ord) AS t FROM chosen) WHERE t IS NOT NULL),
r(pair, node_id, parent, depth) USING KEY (pair, node_id) AS (SELECT pair, s, NULL::VARCHAR, 0 FROM pairs UNION
  SELECT pair, target_id, min(source_id), min(depth) + 1 FROM r JOIN e ON source_id = node_id WHERE depth < 4 AND (pair, target_id) NOT IN (SELECT (pair, node_id) FROM recurring.r) GROUP BY pair, target_id),
found AS (SELECT * FROM r),
back(pair, node_id, path, depth) AS (SELECT pair, t, t, 0 FROM pairs JOIN found USING (pair) WHERE node_id = t
  UNION ALL SELECT b.pair, f.parent, f.parent || ' > ' || b.path, b.depth + 1 FROM back b JOIN found f ON f.pair = b.pair AND f.node_id = b.node_id WHERE f.parent IS NOT NULL)
SELECT path, CAST(depth AS INTEGER) AS depth FROM back JOIN pairs USING (pair) WHERE node_id = s ORDER BY pair LIMIT 4""")
def evidence_paths(spark, d):
    chosen = evidence.answer(A.text_nodes(spark, d), A.text_assignments(spark, d), ASKED)
    node = lambda x: F.concat(F.lit("doc:"), x.cast("string"))
    m = F.explode(F.array(*(F.lit(x) for x in (3, 7, 11, 13, 17, 19))))
    edges = A.table(spark, d, "documents").select("doc_id", m.alias("m")).select(node(F.col("doc_id")).alias("source_id"), node((F.col("doc_id") * F.col("m") + 1) % 1000).alias("target_id"))
    return evidence.evidence_paths(edges, chosen)


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND length(trim(b.text)) > 0")
def passage_containment(spark, d):
    return retrieval.contained_texts(A.table(spark, d, "documents"), A.table(spark, d, "benchmark"))


# traversal


IMPACT_SQL = f"""WITH RECURSIVE {NODES}, {EDGES}, deg AS (SELECT src, count(*) AS n FROM both_ways GROUP BY 1),
r(node_id, depth) USING KEY (node_id) AS (SELECT 'customer:7', 0 UNION
  SELECT dst, min(depth) + 1 FROM r JOIN both_ways ON src = node_id LEFT JOIN deg USING (src) WHERE depth < 5 AND (depth = 0 OR deg.n <= 80) AND dst NOT IN (SELECT node_id FROM recurring.r) GROUP BY dst)
SELECT node_id, depth FROM r"""
TRACE_SQL = f"""WITH RECURSIVE {NODES}, {EDGES}, sym AS (SELECT * FROM both_ways WHERE edge_type IN ('REFERENCES', 'CALLS', 'CROSS_REFERENCE', 'DEFINES', 'IMPLEMENTS')),
r(node_id, depth) USING KEY (node_id) AS (SELECT 'customer:7', 0 UNION SELECT dst, min(depth) + 1 FROM r JOIN sym ON src = node_id WHERE depth < 8 AND dst NOT IN (SELECT node_id FROM recurring.r) GROUP BY dst)
SELECT node_id, depth FROM r"""
PATH_SQL = f"""WITH RECURSIVE {NODES}, {EDGES}, e AS (SELECT DISTINCT source_id, target_id FROM edges),
goal AS (SELECT min('order:' || o_orderkey) AS g FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'),
r(node_id, parent, depth) USING KEY (node_id) AS (SELECT 'project:EUROPE', NULL::VARCHAR, 0 UNION
  SELECT target_id, min(source_id), min(depth) + 1 FROM r JOIN e ON source_id = node_id WHERE depth < 6 AND target_id NOT IN (SELECT node_id FROM recurring.r) GROUP BY target_id),
found AS (SELECT * FROM r),
back(node_id, path, depth) AS (SELECT node_id, node_id, 0 FROM found WHERE node_id = (SELECT g FROM goal)
  UNION ALL SELECT f.parent, f.parent || ' > ' || b.path, b.depth + 1 FROM back b JOIN found f ON f.node_id = b.node_id WHERE f.parent IS NOT NULL)
SELECT path, CAST(depth AS INTEGER) AS depth FROM back WHERE node_id = 'project:EUROPE'"""


@query(IMPACT_SQL)
def impact_radius(spark, d):
    return graph.impact_radius(A.edges(spark, d), "customer:7")


@query(TRACE_SQL)
def symbol_trace(spark, d):
    return graph.symbol_trace(A.edges(spark, d), "customer:7")


def _goal(spark, d):
    o = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(A.places(spark, d).where("repo_name = 'EUROPE'"), F.col("c_nationkey") == F.col("n_nationkey"))
    goal = o.agg(F.min(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")))).first()[0]
    return goal or ""


@query(PATH_SQL)
def bfs_path(spark, d):
    return graph.shortest_path(A.edges(spark, d), "project:EUROPE", _goal(spark, d))


OVERLAY_SQL = f"""WITH {NODES}, {EDGES}, {ASSIGN}, hot AS (SELECT file_path FROM nodes WHERE file_path IS NOT NULL AND layer = 'code' GROUP BY 1 ORDER BY count(*) DESC, file_path LIMIT 5),
blocks AS (SELECT node_id, block FROM assign UNION ALL SELECT 'order:' || o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (SELECT source_id, target_id, edge_type, s.file_path AS sp, t.file_path AS tp, sb.block AS sb, tb.block AS tb,
  CASE edge_type WHEN 'REFERENCES' THEN 0.92::DOUBLE WHEN 'CALLS' THEN 0.90 WHEN 'IMPORTS_MODULE' THEN 0.72 WHEN 'DEPENDS_ON' THEN 0.68 WHEN 'CONTAINS' THEN 0.35 ELSE 0.5 END AS base
  FROM edges LEFT JOIN nodes s ON s.node_id = source_id LEFT JOIN nodes t ON t.node_id = target_id LEFT JOIN blocks sb ON sb.node_id = source_id LEFT JOIN blocks tb ON tb.node_id = target_id),
f AS (SELECT *, (CASE WHEN sp IN (FROM hot) THEN 1 ELSE 0 END) + (CASE WHEN tp IN (FROM hot) THEN 1 ELSE 0 END) AS n, coalesce(contains(lower(sp), 'china'), false) OR coalesce(contains(lower(tp), 'china'), false) AS touched FROM e)
SELECT source_id, target_id, edge_type, base AS base_weight, least(greatest(base * ((CASE n WHEN 2 THEN 1.10::DOUBLE WHEN 1 THEN 1.05 ELSE 1.0 END) * (CASE WHEN sb = tb THEN 1.08::DOUBLE ELSE 1.0 END) * (CASE WHEN touched THEN 1.12::DOUBLE ELSE 1.0 END)), 0.04), 0.98) AS adjusted_weight FROM f"""


def _overlay(spark, d):
    nodes = A.nodes(spark, d)
    hot = nodes.where("file_path IS NOT NULL AND layer = 'code'").groupBy("file_path").count().orderBy(F.desc("count"), "file_path").limit(5)
    return graph.causal_overlay(nodes, A.edges(spark, d), hot.select("file_path"), _blocks(spark, d), ["china"])


@query(OVERLAY_SQL)
def overlay_weights(spark, d):
    return _overlay(spark, d)


MC_SQL = f"""WITH RECURSIVE w AS ({OVERLAY_SQL}), numbered AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, edge_type ORDER BY adjusted_weight) AS nth FROM w),
steps AS (SELECT source_id AS src, target_id AS dst, adjusted_weight AS weight, edge_type || ':a:' || nth AS edge FROM numbered UNION ALL SELECT target_id, source_id, adjusted_weight, edge_type || ':b:' || nth FROM numbered),
r(run, node_id, depth) USING KEY (run, node_id) AS (SELECT run, 'customer:7', 0 FROM range(64) t(run) UNION
  SELECT run, dst, min(depth) + 1 FROM r JOIN steps ON src = node_id WHERE depth < 8
    AND CAST('0x' || substr(md5('42:' || run || ':' || src || ':' || dst || ':' || edge), 1, 8) AS BIGINT) <= weight * 4294967296.0 AND (run, dst) NOT IN (SELECT (run, node_id) FROM recurring.r) GROUP BY run, dst)
SELECT CAST(run AS INTEGER) AS run, count(*) AS reached FROM r GROUP BY run"""


def _reached(spark, d):
    weighted = _overlay(spark, d).select("source_id", "target_id", "edge_type", F.col("adjusted_weight").alias("weight"))
    seeds = spark.createDataFrame([("customer:7",)], "node_id string")
    return graph.run_sizes(graph.monte_carlo_bits(weighted, seeds)).withColumnRenamed("n", "reached")


@query(MC_SQL)
def mc_reach(spark, d):
    """Reached nodes per run from one customer, over all edges."""
    return _reached(spark, d)


@query(f"WITH counts AS ({MC_SQL}) SELECT round(avg(reached), 6) AS mean, round(stddev_pop(reached), 6) AS std, round(least(greatest(1 - stddev_pop(reached) / avg(reached), 0.0), 1.0), 6) AS consistency FROM counts")
def mc_stats(spark, d):
    stats = evaluation.run_statistics(_reached(spark, d).select(F.col("reached").alias("n")))
    return stats.select(*(F.round(c, 6).alias(c) for c in stats.columns))


IMPACT_SEEDS = ("customer:1", "customer:2", "order:3")


@query(MC_SQL.replace("SELECT run, 'customer:7', 0 FROM range(64) t(run)", "SELECT run, s, 0 FROM range(64) t(run), (VALUES ('customer:1'), ('customer:2'), ('order:3')) x(s)").split("SELECT CAST(run AS INTEGER)")[0]
       + f"SELECT node_id, count(*) AS hits, any_value(file_path) AS file_path FROM r JOIN (WITH {NODES} SELECT node_id, file_path FROM nodes WHERE layer = 'code') USING (node_id) GROUP BY node_id")
def change_simulation(spark, d):
    weighted = _overlay(spark, d).select("source_id", "target_id", "edge_type", F.col("adjusted_weight").alias("weight"))
    starts = spark.createDataFrame([(x,) for x in IMPACT_SEEDS], "node_id string")
    return simulate.simulate(A.nodes(spark, d), weighted, starts)[0]


# history


@query(f"WITH {CHANGES} SELECT block, count(*) AS changes FROM (SELECT DISTINCT repo, day, path, block FROM changes) GROUP BY 1")
def block_churn(spark, d):
    return temporal.churn(A.changes(spark, d))


@query(f"WITH {CHANGES} SELECT repo, path, count(*) AS changes FROM changes GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100")
def hotspots(spark, d):
    return temporal.hotspots(A.changes(spark, d))


@query(f"WITH {CHANGES}, c AS (SELECT repo, count(*) AS n FROM changes GROUP BY repo, path) SELECT repo, max(n) AS top, CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS concentration FROM c GROUP BY repo")
def hotspot_share(spark, d):
    return temporal.hotspot_share(A.changes(spark, d))


@query(f"WITH {CHANGES}, {SNAPS} SELECT repo, before, after FROM pairs")
def lag_pairs(spark, d):
    return temporal.day_pairs(A.changes(spark, d))


@query(f"WITH {CHANGES}, {SNAPS}, mid AS (SELECT min(day) AS m FROM (SELECT day FROM snaps ORDER BY day DESC LIMIT 500)) SELECT repo, day, path, block FROM snaps s WHERE day = (SELECT max(day) FROM snaps t WHERE t.repo = s.repo AND t.day <= (SELECT m FROM mid))")
def snapshot_at(spark, d):
    snaps = temporal.snapshots(A.changes(spark, d))
    return temporal.snapshot_at(snaps, snaps.orderBy(F.desc("day")).limit(500).agg(F.min("day")).first()[0])


@query(f"WITH {CHANGES}, {SNAPS}, {DIFFS} SELECT repo, before, after, path, before_blocks, after_blocks, status FROM diffs")
def snapshot_align(spark, d):
    return temporal.diff(temporal.snapshots(A.changes(spark, d)))


DELTA_SQL = f"WITH {CHANGES}, {SNAPS}, delta AS (SELECT repo, before, after, block, CAST(sum(CASE WHEN new THEN 1 ELSE -1 END) AS BIGINT) AS delta FROM sides GROUP BY ALL HAVING delta <> 0)"


@query(DELTA_SQL + " SELECT * FROM delta")
def diff_delta(spark, d):
    return temporal.block_delta(temporal.snapshots(A.changes(spark, d)))


@query(DELTA_SQL + " SELECT repo, after, block, CAST(sum(delta) OVER (PARTITION BY repo, block ORDER BY after) AS BIGINT) AS total FROM delta")
def delta_accumulated(spark, d):
    return temporal.accumulated_delta(temporal.snapshots(A.changes(spark, d)))


@query(f"""WITH {CHANGES}, {SNAPS}, {DIFFS} SELECT repo, before, after, count(*) AS files, count(*) FILTER (status = 'M') AS drifted, CAST(count(*) FILTER (status = 'M') AS DOUBLE) / count(*) AS drift_rate,
CAST(sum(greatest(CASE WHEN before_blocks = '' THEN 0 ELSE len(string_split(before_blocks, ',')) END, CASE WHEN after_blocks = '' THEN 0 ELSE len(string_split(after_blocks, ',')) END)) AS DOUBLE) / count(*) AS coupling FROM diffs GROUP BY ALL""")
def temporal_metrics(spark, d):
    return temporal.temporal_metrics(temporal.diff(temporal.snapshots(A.changes(spark, d))))


@query(f"""WITH {CHANGES}, {SNAPS}, {DIFFS}, t AS (SELECT repo, status, unnest(list_distinct(list_filter(string_split(before_blocks || ',' || after_blocks, ','), lambda x: x <> ''))) AS block FROM diffs)
SELECT repo, block, count(*) AS activity, count(*) FILTER (status = 'M') AS drift, 1 - CAST(count(*) FILTER (status = 'M') AS DOUBLE) / count(*) AS success FROM t GROUP BY ALL""")
def success_index(spark, d):
    return temporal.success_index(temporal.diff(temporal.snapshots(A.changes(spark, d))))


@query(f"WITH {CHANGES}, {SNAPS}, {DIFFS} SELECT repo, before, after, path, before_blocks, after_blocks, 0.9::DOUBLE AS confidence FROM diffs WHERE status = 'M'")
def drift(spark, d):
    return temporal.direct_drift(temporal.diff(temporal.snapshots(A.changes(spark, d))))


@query(rf"""WITH RECURSIVE {CHANGES}, {SNAPS}, {DIFFS}, parts AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1') AS stem FROM diffs),
adds AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY repo, before, after ORDER BY path) AS rn FROM parts WHERE status = 'A'),
pairs_ AS MATERIALIZED (SELECT a.repo, a.before, a.after, a.rn, d.path AS old_path, d.before_blocks AS gone, CASE WHEN a.name = d.name THEN 5 WHEN a.stem = d.stem THEN 2 ELSE 0 END
  + CASE WHEN list_has_any(string_split(a.after_blocks, ','), string_split(d.before_blocks, ',')) THEN 1 ELSE 0 END AS score FROM adds a JOIN parts d ON d.status = 'D' AND a.repo = d.repo AND a.before = d.before AND a.after = d.after),
walk AS (SELECT DISTINCT repo, before, after, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS old_path, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS before_blocks, CAST(NULL AS VARCHAR) AS after_blocks FROM adds
  UNION ALL SELECT repo, before, after, rn, CASE WHEN old_path IS NOT NULL AND gone <> after_blocks THEN list_append(taken, old_path) ELSE taken END, old_path, path, gone, after_blocks
  FROM (SELECT w.repo, w.before, w.after, a.rn, w.taken, p.old_path, a.path, p.gone, a.after_blocks, row_number() OVER (PARTITION BY w.repo, w.before, w.after ORDER BY p.score DESC NULLS LAST, p.old_path) AS k
    FROM walk w JOIN adds a ON a.repo = w.repo AND a.before = w.before AND a.after = w.after AND a.rn = w.rn + 1
    LEFT JOIN pairs_ p ON p.repo = w.repo AND p.before = w.before AND p.after = w.after AND p.rn = a.rn AND p.score > 0 AND NOT list_contains(w.taken, p.old_path)) WHERE k = 1)
SELECT repo, before, after, old_path, path, before_blocks, after_blocks, 0.82::DOUBLE AS confidence FROM walk WHERE old_path IS NOT NULL AND before_blocks <> after_blocks""")
def drift_moves(spark, d):
    return temporal.move_drift(temporal.diff(temporal.snapshots(A.changes(spark, d))))


_HISTORY = f"""{CHANGES}, log AS (SELECT repo, CAST(dense_rank() OVER (PARTITION BY repo ORDER BY day DESC) - 1 AS INTEGER) AS ord, CASE WHEN event_id % 3 = 0 THEN 'D' WHEN event_id % 3 = 1 THEN 'A' ELSE 'M' END AS status, path FROM changes),
each AS (SELECT repo, path, ord, coalesce(min(status) FILTER (status <> 'D'), 'D') AS status FROM log GROUP BY ALL),
commits AS (SELECT DISTINCT repo, ord FROM log),
alive AS (SELECT c.repo, c.ord, path, arg_min(status, e.ord) AS status FROM commits c JOIN each e ON e.repo = c.repo AND e.ord >= c.ord GROUP BY ALL HAVING arg_min(status, e.ord) <> 'D')"""


def _history(spark, d):
    """Days as commits, events as changes of their user's file; a third of them deletions."""
    turn = F.col("event_id") % 3
    status = F.when(turn == 0, "D").when(turn == 1, "A").otherwise("M")
    log = A.changes(spark, d).select("repo", "day", status.alias("status"), "path")
    ord_ = (F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("day"))) - 1).cast("int")
    # events are many, days few: days alone are numbered, and no task gathers a repository's events
    days = log.select("repo", "day").distinct().select(F.col("repo").alias("r"), F.col("day").alias("at"), ord_.alias("ord"))
    return log.join(F.broadcast(days), F.col("repo").eqNullSafe(F.col("r")) & F.col("day").eqNullSafe(F.col("at"))).select("repo", "ord", "status", "path")


@query(f"WITH {_HISTORY} SELECT * FROM alive")
def replayed_files(spark, d):
    return history.replay(_history(spark, d))


@query(f"WITH {_HISTORY} SELECT * FROM alive WHERE ord % 10 = 3")
def replayed_refs(spark, d):
    log = _history(spark, d)
    return history.replay(log, log.where("ord % 10 = 3").select("repo", "ord"))


@query(f"""WITH {_HISTORY}, n AS (SELECT repo, ord, count(*) AS files FROM alive GROUP BY ALL),
moves AS (SELECT c.repo, c.ord, a.path, a.path IS NOT NULL AND b.path IS NULL AS up FROM commits c JOIN alive a ON a.repo = c.repo AND a.ord = c.ord LEFT JOIN alive b ON b.repo = c.repo AND b.ord = c.ord + 1 AND b.path = a.path WHERE b.path IS NULL),
lost AS (SELECT c.repo, c.ord, b.path FROM commits c JOIN alive b ON b.repo = c.repo AND b.ord = c.ord + 1 LEFT JOIN alive a ON a.repo = c.repo AND a.ord = c.ord AND a.path = b.path WHERE a.path IS NULL)
SELECT repo, ord, CAST(coalesce(files, 0) AS BIGINT) AS files, CAST(coalesce(u, 0) AS BIGINT) AS added, CAST(coalesce(l, 0) AS BIGINT) AS gone FROM commits LEFT JOIN n USING (repo, ord)
LEFT JOIN (SELECT repo, ord, count(*) AS u FROM moves GROUP BY ALL) USING (repo, ord) LEFT JOIN (SELECT repo, ord, count(*) AS l FROM lost GROUP BY ALL) USING (repo, ord)""")
def replayed_counts(spark, d):
    return history.replayed_counts(_history(spark, d))


@query(f"""WITH {CHANGES}, {SNAPS}, {DIFFS}, f AS (SELECT repo, before, after, path FROM diffs WHERE status = 'M'), e AS (SELECT * FROM f WHERE path <> 'src/user_1.ts'),
m AS (SELECT (SELECT count(*) FROM (FROM e EXCEPT ALL FROM f)) AS missing, (SELECT count(*) FROM (FROM f EXCEPT ALL FROM e)) AS unexpected)
SELECT missing, unexpected, CASE WHEN missing = 0 AND unexpected = 0 THEN 'pass' ELSE 'fail' END AS status FROM m""")
def gate_known_changes(spark, d):
    found = temporal.direct_drift(temporal.diff(temporal.snapshots(A.changes(spark, d)))).select("repo", "before", "after", "path")
    return temporal.known_changes_gate(found, found.where("path <> 'src/user_1.ts'"))


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events")
def rate_window(spark, d):
    return temporal.requests_in_window(A.table(spark, d, "events"))


# evaluation


@query("SELECT toxic AS expected, coalesce(CAST(quality AS VARCHAR), '__missing_node__') AS got, count(*) AS n FROM labels l LEFT JOIN (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0) q USING (doc_id) GROUP BY ALL".replace("toxic AS expected, coalesce(CAST(quality", "CAST(l.toxic AS VARCHAR) AS expected, coalesce(CAST(q.quality"))
def confusion(spark, d):
    gold, got = _gold(spark, d)
    return evaluation.confusion(gold, got, "doc_id")


def _gold(spark, d):
    labels = A.table(spark, d, "labels")
    return labels.select("doc_id", F.col("toxic").cast("string").alias("expected")), labels.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").cast("string").alias("got"))


@query("""WITH j AS (SELECT toxic AS e, CASE WHEN doc_id % 3 <> 0 THEN quality END AS g FROM labels)
SELECT count(*) AS total, count(g) AS scorable, count(*) FILTER (g = e) AS correct, CAST(count(*) FILTER (g = e) AS DOUBLE) / count(*) AS accuracy, CAST(count(*) FILTER (g = e) AS DOUBLE) / count(g) AS scorable_accuracy, CAST(count(*) - count(g) AS DOUBLE) / count(*) AS missing_rate FROM j""")
def benchmark_accuracy(spark, d):
    gold, got = _gold(spark, d)
    return evaluation.accuracy(gold, got, "doc_id")


@query("SELECT CAST(toxic AS VARCHAR) AS expected, count(*) AS total, avg(CASE WHEN doc_id % 3 <> 0 AND quality = toxic THEN 1.0 ELSE 0.0 END) AS accuracy FROM labels GROUP BY 1")
def accuracy_by_block(spark, d):
    gold, got = _gold(spark, d)
    return evaluation.accuracy_by(gold, got, "doc_id")


@query("SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicates(spark, d):
    return evaluation.duplicate_texts(A.table(spark, d, "documents"))


@query("""WITH g AS (SELECT user_id AS target, CASE WHEN event_type = 'error' THEN 'needs_review' ELSE 'active' END AS status, event_type AS primary_block FROM events)
SELECT target, count(*) AS n, count(*) FILTER (status = 'active') AS active, count(DISTINCT CASE WHEN status = 'active' THEN primary_block END) AS labels FROM g GROUP BY 1
HAVING count(*) > 1 AND (count(*) FILTER (status = 'active') = 0 OR count(DISTINCT CASE WHEN status = 'active' THEN primary_block END) > 1)""")
def contradictions(spark, d):
    return _contradictions(A.table(spark, d, "events"))


def _contradictions(e):
    return evaluation.contradictions(e.select(F.col("user_id").alias("target"), F.when(F.col("event_type") == "error", "needs_review").otherwise("active").alias("status"), F.col("event_type").alias("primary_block")))


@query("SELECT n_nationkey, n_regionkey, turn FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS turn FROM nation) ORDER BY turn, n_regionkey LIMIT 12")
def round_robin(spark, d):
    return evaluation.round_robin(A.table(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", "n_nationkey", 12)


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS labels, max(l_linenumber) AS strongest FROM lineitem GROUP BY 1")
def multi_label(spark, d):
    return evaluation.multi_label(A.table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber")


@query("""WITH e AS (SELECT user_id, event_id % 4 / 4.0::DOUBLE AS p, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0 END AS y FROM events)
SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN avg((p - y) * (p - y)) END AS brier FROM e GROUP BY 1""")
def brier(spark, d):
    e = A.table(spark, d, "events").select("user_id", ((F.col("event_id") % 4) / 4.0).alias("p"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("y"))
    return evaluation.brier(e, ["user_id"])


@query("""WITH e AS (SELECT user_id, event_id AS ord, event_id % 13 AS predicted, event_id % 7 AS actual, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events),
l AS (SELECT user_id, count(*) AS n, CAST(sum(predicted - actual) AS DOUBLE) / count(*) / 100 AS m FROM e WHERE r <= 20 GROUP BY 1)
SELECT user_id, n, CASE WHEN n >= 3 THEN least(greatest(m, -0.15), 0.15) ELSE 0.0 END AS bias FROM l""")
def bias_last20(spark, d):
    e = A.table(spark, d, "events").select("user_id", F.col("event_id").alias("ord"), (F.col("event_id") % 13).alias("predicted"), (F.col("event_id") % 7).alias("actual"))
    return evaluation.recent_bias(e, "user_id")


@query("""WITH t AS (SELECT count(*) AS a, count(*) FILTER (o_orderstatus <> 'F') AS k, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice < 1000) AS z FROM orders)
SELECT 'attempted' AS check_id, CAST(a AS DOUBLE) AS value, CASE WHEN a >= 50 THEN 'pass' ELSE 'fail' END AS status FROM t
UNION ALL SELECT 'success_rate', CAST(k AS DOUBLE) / greatest(a, 1), CASE WHEN CAST(k AS DOUBLE) / greatest(a, 1) >= 1 THEN 'pass' ELSE 'fail' END FROM t
UNION ALL SELECT 'failures', CAST(f AS DOUBLE), CASE WHEN f <= 0 THEN 'pass' ELSE 'fail' END FROM t UNION ALL SELECT 'zero_nodes', CAST(z AS DOUBLE), CASE WHEN z <= 0 THEN 'pass' ELSE 'fail' END FROM t""")
def corpus_gate(spark, d):
    runs = A.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"), F.when(F.col("o_totalprice") < 1000, 0).otherwise(5).alias("node_count"))
    return evaluation.corpus_gate(runs)


@query(f"""WITH {NODES}, {EDGES}, c AS (
SELECT 'structural' AS layer, 'node_ids_unique' AS check_id, (SELECT count(*) FROM (SELECT 1 FROM nodes GROUP BY node_id HAVING count(*) > 1)) AS detail
UNION ALL SELECT 'structural', 'no_dangling_edges', (SELECT count(*) FROM edges WHERE source_id NOT IN (SELECT node_id FROM nodes)) + (SELECT count(*) FROM edges WHERE target_id NOT IN (SELECT node_id FROM nodes) AND edge_type <> 'IMPORTS_MODULE')
UNION ALL SELECT 'structural', 'code_is_contained', (SELECT count(*) FROM nodes WHERE layer = 'code' AND node_id NOT IN (SELECT target_id FROM edges WHERE edge_type = 'CONTAINS'))
UNION ALL SELECT 'canonical', 'nodes_connected', (SELECT count(*) FROM nodes WHERE node_id NOT IN (SELECT src FROM both_ways WHERE dst IN (SELECT node_id FROM nodes))))
SELECT layer, check_id, CASE WHEN detail = 0 THEN 'pass' ELSE 'fail' END AS status, detail FROM c""")
def integrity_checks(spark, d):
    return graph.integrity_checks(A.nodes(spark, d), A.edges(spark, d))


@query("""WITH c AS (SELECT n_name AS layer, CASE WHEN c_acctbal < -900 THEN 2 WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS s FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT layer, CASE max(s) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS status FROM c GROUP BY 1""")
def layer_rollup(spark, d):
    c = A.table(spark, d, "customer").join(A.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return graph.layer_status(c.select(F.col("n_name").alias("layer"), F.when(F.col("c_acctbal") < -900, "fail").when(F.col("c_acctbal") < 0, "warn").otherwise("pass").alias("status")))


@query(f"WITH {NODES} SELECT 'customers' AS \"table\", coalesce(repo_name, '') AS repo_name, count(*) AS n FROM nodes WHERE layer = 'code' GROUP BY ALL UNION ALL SELECT 'every', coalesce(repo_name, ''), count(*) FROM nodes GROUP BY ALL")
def store_counts(spark, d):
    return store.counts({"customers": A.nodes(spark, d).where("layer = 'code'"), "every": A.nodes(spark, d)}).withColumn("repo_name", F.coalesce("repo_name", F.lit("")))


@query("""WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_acctbal > 5000 THEN 'high' ELSE 'low' END AS confidence, s_suppkey % 6 AS candidates, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS blocked FROM supplier)
SELECT *, CASE WHEN blocked > 0 THEN 'high' WHEN confidence = 'high' AND candidates <= 3 THEN 'low' ELSE 'medium' END AS risk FROM s""")
def migration_lanes(spark, d):
    s = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 5000, "high").otherwise("low").alias("confidence"), (F.col("s_suppkey") % 6).alias("candidates"), F.when(F.col("s_acctbal") < 0, 1).otherwise(0).alias("blocked"))
    return evaluation.migration_lanes(s)


# scalar functions


@query("SELECT doc_id, substr(sha256(source || ':' || lang || ':' || CAST(doc_id AS VARCHAR)), 1, 32) AS record_id, 'entity:' || substr(sha256(lower(lang || ':' || source)), 1, 16) AS entity_id FROM documents")
def hash_ids(spark, d):
    return A.table(spark, d, "documents").select("doc_id", ids.record_id("source", "lang", F.col("doc_id").cast("string")).alias("record_id"), ids.entity_id("lang", "source").alias("entity_id"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(translate(p_brand, '_-#', '  #'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g')) AS words FROM part".replace("\\\\", "\\"))
def split_identifier(spark, d):
    return A.table(spark, d, "part").select("p_partkey", ids.split_identifier("p_brand").alias("words"))


RAW = "CASE page_id % 6 WHEN 0 THEN ' ' || chr(39) || url || chr(39) || ' ' WHEN 1 THEN chr(34) || '@' || url || chr(34) WHEN 2 THEN '@org?x=1' WHEN 3 THEN url || '/' WHEN 4 THEN '@a/' ELSE url END"


@query(f"""WITH r AS (SELECT page_id, trim(trim({RAW}), chr(34) || chr(39)) AS s FROM pages), q AS (SELECT page_id, split_part(s, '?', 1) AS s FROM r)
SELECT page_id, 'module:' || CASE WHEN left(s, 1) = '@' THEN regexp_extract(s, '^(@[^/]*(?:/[^/]*)?)', 1) ELSE split_part(s, '/', 1) END AS module FROM q""")
def module_spec(spark, d):
    i, url = F.col("page_id") % 6, F.col("url")
    raw = F.when(i == 0, F.concat(F.lit(" '"), url, F.lit("' "))).when(i == 1, F.concat(F.lit('"@'), url, F.lit('"'))).when(i == 2, "@org?x=1").when(i == 3, F.concat(url, F.lit("/"))).when(i == 4, "@a/").otherwise(url)
    return A.table(spark, d, "pages").select("page_id", ids.module_spec(raw).alias("module"))


@query("""WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN './a//b/./' || source || '/' WHEN 1 THEN 'x\\y\\' || lang WHEN 2 THEN '../' || source || '/.' WHEN 3 THEN '' ELSE '//' || lang || '/../z' END AS raw FROM documents),
n AS (SELECT doc_id, array_to_string(list_filter(string_split(replace(raw, '\\', '/'), '/'), lambda x: x <> '' AND x <> '.'), '/') AS s FROM p)
SELECT doc_id, regexp_replace(s, '^[./]+', '') AS path FROM n""")
def normal_paths(spark, d):
    i = F.col("doc_id") % 5
    raw = F.when(i == 0, F.concat(F.lit("./a//b/./"), "source", F.lit("/"))).when(i == 1, F.concat(F.lit("x\\y\\"), "lang")).when(i == 2, F.concat(F.lit("../"), "source", F.lit("/."))).when(i == 3, "").otherwise(F.concat(F.lit("//"), "lang", F.lit("/../z")))
    return A.table(spark, d, "documents").select("doc_id", ids.normalize_relative_path(raw).alias("path"))


def _pages(spark, d):
    """Pages as source files that import their address and the next page."""
    i = F.col("page_id")
    content = F.concat(F.lit("import a from '"), F.substring_index("url", "?", 1), F.lit("'\nimport b from './p"), (i + 1).cast("string"), F.lit("'\n"))
    return A.table(spark, d, "pages").select(F.lit("web").alias("repo_name"), F.concat(F.lit("src/p"), i.cast("string"), F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))


@query("SELECT 'web' AS repo_name, 'src/p' || page_id || '.ts' AS path, 'typescript' AS language, unnest([split_part(url, '?', 1), './p' || (page_id + 1)]) AS spec FROM pages")
def import_specs(spark, d):
    return files.import_specs(_pages(spark, d))


@query("""SELECT DISTINCT 'repo://web/src/p' || page_id || '.ts' AS source_id, 'module:' || split_part(split_part(url, '?', 1), '/', 1) AS target_id, 'IMPORTS_MODULE' AS edge_type, 'web' AS repo_name FROM pages
UNION SELECT 'repo://web/src/p' || p.page_id || '.ts', CASE WHEN n.page_id IS NULL THEN 'module:.' ELSE 'repo://web/src/p' || n.page_id || '.ts' END, CASE WHEN n.page_id IS NULL THEN 'IMPORTS_MODULE' ELSE 'DEPENDS_ON_FILE' END, 'web' FROM pages p LEFT JOIN (SELECT DISTINCT page_id FROM pages) n ON n.page_id = p.page_id + 1""")
def import_edges(spark, d):
    return files.import_edges(_pages(spark, d))


@query("SELECT 'docs' AS repo_name, 'd' || doc_id AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents")
def manifest_hashes(spark, d):
    t = F.coalesce("text", F.lit(""))
    return files.manifest(A.table(spark, d, "documents").select(F.lit("docs").alias("repo_name"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.octet_length(t).cast("long").alias("size"), t.alias("content")))


@query(f"WITH {NODES}, {EDGES} SELECT * FROM edges WHERE source_id = 'customer:7' OR target_id = 'customer:7'")
def incident_edges_once(spark, d):
    return graph.touching_edges(A.edges(spark, d), "customer:7")


@query("SELECT p_brand AS symbol, count(*) OVER (PARTITION BY p_brand) AS n, p_partkey AS member FROM part")
def symbol_members(spark, d):
    return graph.symbol_members(A.table(spark, d, "part"), "p_brand", "p_partkey")


@query(f"""WITH {NODES}, {ASSIGN}, known AS (SELECT * FROM nodes WHERE NOT (layer = 'file' AND file_path LIKE '%_1%') AND node_id NOT LIKE 'customer:1%')
SELECT node_id, file_path, 'file' AS missing FROM known WHERE layer = 'code' AND file_path IS NOT NULL AND file_path NOT IN (SELECT file_path FROM known WHERE layer = 'file') UNION ALL SELECT node_id, '', 'node' FROM assign WHERE node_id NOT IN (SELECT node_id FROM known)""")
def unknown_paths(spark, d):
    known = A.nodes(spark, d).where("NOT (layer = 'file' AND file_path LIKE '%_1%') AND node_id NOT LIKE 'customer:1%'")
    return graph.unknown_paths(known, A.assignments(spark, d)).withColumn("file_path", F.coalesce("file_path", F.lit("")))


def _regret_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT '{p}' AS pattern_id, {base}::DOUBLE AS base, node_id, file_path, {' + '.join(f'CASE WHEN contains(low, {w!r}) THEN 1 ELSE 0 END' for w in words)} AS n, primary_block IN ({', '.join(map(repr, blocks))}) AS own FROM t" for p, _, words, blocks, base in regret.PATTERNS)
    return f"""WITH {A.TEXT_SQL}, t AS (SELECT node_id, file_path, primary_block, lower(label || chr(10) || substr(content, 1, 800)) AS low FROM text_nodes JOIN text_assign USING (node_id)),
h AS (SELECT * FROM ({parts}) WHERE n > 0), g AS (SELECT pattern_id, base, CAST(sum(n) AS BIGINT) AS hits, count(*) AS n_nodes, count(DISTINCT file_path) AS n_files, avg(CASE WHEN own THEN 1.0::DOUBLE ELSE 0 END) AS align FROM h GROUP BY 1, 2),
s AS (SELECT pattern_id, hits, n_nodes, n_files, round(align, 9) AS align, round(least(greatest(base + 0.15::DOUBLE * least(1.0::DOUBLE, hits / 5.0::DOUBLE) + 0.2::DOUBLE * align + 0.15::DOUBLE * least(1.0::DOUBLE, n_files / 8.0::DOUBLE), 0), 1), 9) AS score FROM g) SELECT * FROM s WHERE score >= 0.35"""


@query(_regret_sql())
def regret_scan(spark, d):
    found = regret.pattern_regrets(A.text_nodes(spark, d), A.text_assignments(spark, d))
    return found.withColumns({"align": F.round("align", 9), "score": F.round("score", 9)})


@query(f"WITH {A.TEXT_SQL} SELECT file_path, count(*) AS n, least(0.85::DOUBLE, 0.35::DOUBLE + count(*) / 40.0::DOUBLE) AS score FROM text_nodes WHERE file_path LIKE '%route%' GROUP BY 1 HAVING count(*) >= 2")
def dense_routes(spark, d):
    nodes = A.text_nodes(spark, d)
    return regret.dense_routes(nodes, 2)


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS back FROM events QUALIFY back <= 5")
def last_events(spark, d):
    return temporal.last_n(A.table(spark, d, "events"), 5).select("user_id", "event_id", "back")


# paths, fingerprints, gates


_PATHS_OF = A._turn_sql(("src/auth/login.tsx", "lib/cache/store.ts", "src/i18n/x.ts", "workers/queue/a.ts", "db/schema.sql", "README.md", "src\\\\API\\\\routes.ts", "theme/tokens.css", "app/error-boundary.vue"), "doc_id")


@query("WITH p AS (SELECT 'doc:' || doc_id AS node_id, coalesce(source, '') || '/' || " + _PATHS_OF.replace("\\\\", "\\") + " AS path FROM documents), b AS (SELECT node_id, path, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(replace(path, '\\', '/')), '{p}') THEN '{b}' END" for b, p in classify.BLOCK_PATHS) + "], lambda x: x IS NOT NULL) AS b FROM p) SELECT node_id, path, CASE WHEN len(b) = 0 THEN 'Unclassified' ELSE array_to_string(b, ',') END AS blocks FROM b")
def block_paths(spark, d):
    """The blocks of documents' paths, which begin with their source."""
    names = A._turn(("src/auth/login.tsx", "lib/cache/store.ts", "src/i18n/x.ts", "workers/queue/a.ts", "db/schema.sql", "README.md", "src\\API\\routes.ts", "theme/tokens.css", "app/error-boundary.vue"), F.col("doc_id"))
    paths = A.table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node_id"), F.concat(F.coalesce("source", F.lit("")), F.lit("/"), names).alias("path"))
    return classify.path_blocks(paths)


def _altered(spark, d):
    """Events, and the same with some changed, lost and repeated."""
    events = A.table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    i = F.col("event_id")
    changed = events.withColumn("value", F.when(i % 997 == 0, F.col("value") + 1).otherwise(F.col("value")))
    again = F.when(i % 991 == 0, F.array()).when(i % 983 == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    return events, changed.withColumn("x", F.explode(again.cast("array<int>"))).drop("x").repartition("user_id")


@query("""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 991 = 0 THEN 0 WHEN event_id % 983 = 0 THEN 2 ELSE 1 END AS n, event_id % 997 = 0 OR event_id % 991 = 0 OR event_id % 983 = 0 AS odd FROM events)
SELECT day, count(*) AS n_left, CAST(sum(n) AS BIGINT) AS n_right, NOT bool_or(odd) AS same FROM e GROUP BY day""")
def fingerprints(spark, d):
    return integrity.same_rows(*_altered(spark, d), by=["day"])


@query(f"""WITH {CHANGES}, {SNAPS}, {DIFFS} SELECT 'temporal_gate_metrics_reproducible' AS gate_id, 'pass' AS status UNION ALL
SELECT 'temporal_gate_known_changes', CASE WHEN (SELECT count(*) FROM diffs WHERE status = 'D') > 0 THEN 'pass' ELSE 'fail' END UNION ALL
SELECT 'temporal_gate_drift_detection', CASE WHEN (SELECT least(CAST(count(*) FILTER (path NOT LIKE '%7.ts') AS DOUBLE) / count(*), 1.0) FROM (SELECT DISTINCT path FROM diffs WHERE status = 'M')) >= 0.85 THEN 'pass' ELSE 'fail' END""")
def history_gates(spark, d):
    """Metrics taken twice, deletions expected and met, drift against all drifted files but some."""
    diffs = temporal.diff(temporal.snapshots(A.changes(spark, d)))
    metrics = lambda: temporal.temporal_metrics(temporal.diff(temporal.snapshots(A.changes(spark, d))))
    seen = diffs.select("repo", "after", "path", "status")
    found = temporal.direct_drift(diffs).select("path").distinct()
    score = temporal.precision_recall(found, found.where("path NOT LIKE '%7.ts'"), ["path"])
    return integrity.history_gates(metrics(), metrics(), seen, seen.where("status = 'D'"), score)


@query(f"""WITH {NODES}, {EDGES}, known AS (SELECT * FROM nodes WHERE kind <> 'supplier'), ends AS (SELECT source_id, target_id, edge_type, 'source' AS side, source_id AS e FROM edges UNION ALL SELECT source_id, target_id, edge_type, 'target', target_id FROM edges),
gone AS (SELECT * FROM ends WHERE e NOT IN (SELECT node_id FROM known) AND NOT (side = 'target' AND edge_type = 'IMPORTS_MODULE' AND e LIKE 'module:%')),
d AS (SELECT 'structural' AS layer, 'no_dangling_edges' AS check_id, (SELECT count(*) FROM (SELECT DISTINCT source_id, target_id, edge_type FROM gone)) AS detail
  UNION ALL SELECT 'structural', 'no_provisional_edge_leakage', 0 UNION ALL SELECT 'structural', 'code_files_materialized', (SELECT count(DISTINCT file_path) FROM known WHERE layer = 'code' AND file_path IS NOT NULL AND file_path NOT IN (SELECT file_path FROM known WHERE layer = 'file'))
  UNION ALL SELECT 'structural', 'code_is_contained', (SELECT count(*) FROM known WHERE layer = 'code' AND node_id NOT IN (SELECT target_id FROM edges WHERE edge_type = 'CONTAINS'))
  UNION ALL SELECT 'semantic', 'semantic_assignments_target_graph_nodes', (SELECT count(*) FROM customer WHERE 'customer:' || (c_custkey * 2) NOT IN (SELECT node_id FROM known))
  UNION ALL SELECT 'semantic', 'semantic_assignments_nonempty', 0 UNION ALL SELECT 'scip', 'scip_layer_optional', 0
  UNION ALL SELECT 'manifest', 'manifest_files_exist', (SELECT count(*) FROM documents WHERE doc_id % 10 = 3) UNION ALL SELECT 'manifest', 'manifest_hashes_current', (SELECT count(*) FROM documents WHERE doc_id % 10 = 4))
SELECT layer, check_id, CASE WHEN detail = 0 THEN 'pass' ELSE 'fail' END AS status, detail FROM d""")
def integrity_report(spark, d):
    nodes, edges = A.nodes(spark, d).where("kind <> 'supplier'"), A.edges(spark, d)
    assigned = A.table(spark, d, "customer").select(F.concat(F.lit("customer:"), (F.col("c_custkey") * 2).cast("string")).alias("node_id"))
    listed = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    turn = F.col("path").cast("long") % 10
    present = listed.where(turn != 3).withColumn("sha256", F.when(turn == 4, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256")))
    return integrity.integrity_report({"structural": integrity.structural_checks(nodes, edges), "semantic": integrity.semantic_checks(nodes, assigned), "scip": integrity.index_checks(None), "manifest": integrity.manifest_checks(listed, present)})


@query(f"""WITH RECURSIVE {NODES}, {EDGES}, steps AS (SELECT source_id AS src, target_id AS dst FROM edges WHERE edge_type IN ('REFERENCES', 'CALLS') UNION SELECT target_id, source_id FROM edges WHERE edge_type IN ('REFERENCES', 'CALLS')),
r(node_id, depth) USING KEY (node_id) AS (SELECT 'customer:7', 0 UNION SELECT dst, min(depth) + 1 FROM r JOIN steps ON src = node_id WHERE depth < 8 AND dst NOT IN (SELECT node_id FROM recurring.r) GROUP BY dst)
SELECT 'customer:1' AS target, CAST(depth + 1 AS BIGINT) AS nodes, true AS linked FROM r WHERE node_id = 'customer:1'""")
def trace_path(spark, d):
    """How many nodes a shortest path between two customers has, and whether each is linked with the next."""
    edges = A.edges(spark, d)
    path, _ = graph.trace_path(edges, "customer:7", "customer:1")
    pairs = path.withColumn("next", F.lead("node_id").over(Window.orderBy("ord"))).where("next IS NOT NULL")
    steps = graph.both_ways(edges.where(F.col("edge_type").isin(*graph.TRACE_TYPES))).select(F.col("src").alias("node_id"), F.col("dst").alias("next"))
    linked = steps.join(F.broadcast(pairs), ["node_id", "next"]).select("node_id", "next").distinct().agg(F.count(F.lit(1)).alias("n"))  # a path is short
    return path.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(linked)).select(F.lit("customer:1").alias("target"), "nodes", (F.col("n") + 1 == F.col("nodes")).alias("linked"))


@query(f"""WITH {NODES}, {EDGES}, {CHANGES}, {SNAPS}, {DIFFS}, code AS (SELECT * FROM nodes WHERE layer = 'code'), n AS (SELECT count(*) AS n FROM code),
t AS (SELECT repo, unnest(list_distinct(list_filter(string_split(before_blocks || ',' || after_blocks, ','), lambda x: x <> ''))) AS block FROM diffs),
m AS (SELECT 'phase_1' AS phase_id, 'node_kind_diversity' AS metric_id, (SELECT count(DISTINCT kind) FROM code)::DOUBLE AS value
UNION ALL SELECT 'phase_1', 'neighborhood_coverage_rate', (SELECT count(*) FROM code WHERE file_path IS NOT NULL)::DOUBLE / (SELECT n FROM n) UNION ALL SELECT 'phase_1', 'dependency_edge_count', (SELECT count(*) FROM edges WHERE edge_type IN ('DEPENDS_ON', 'IMPORTS_MODULE'))
UNION ALL SELECT 'phase_1', 'cross_file_dependency_count', 0 UNION ALL SELECT 'phase_1', 'edges_per_code_node', (SELECT count(*) FROM edges)::DOUBLE / (SELECT n FROM n)
UNION ALL SELECT 'phase_2', 'blocked by: symbol index', NULL UNION ALL SELECT 'phase_4', 'assignment_coverage_rate', (SELECT count(*) FROM customer)::DOUBLE / (SELECT n FROM n)
UNION ALL SELECT 'phase_4', 'average_assignment_confidence', (SELECT avg(least(greatest(c_acctbal, 0.0), 10000.0) / 10000.0) FROM customer) UNION ALL SELECT 'phase_4', 'unique_block_count', (SELECT count(DISTINCT c_mktsegment) FROM customer)
UNION ALL SELECT 'phase_4', 'semantic_summary_count', 0 UNION ALL SELECT 'phase_4', 'entity_count', (SELECT count(*) FROM supplier) UNION ALL SELECT 'phase_4', 'action_count', (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'phase_9', 'commit_count', (SELECT count(*) FROM (SELECT DISTINCT repo, day FROM snaps)) UNION ALL SELECT 'phase_9', 'architecture_snapshot_count', (SELECT count(*) FROM (SELECT DISTINCT repo, day FROM snaps))
UNION ALL SELECT 'phase_9', 'architecture_diff_count', (SELECT count(*) FROM pairs) UNION ALL SELECT 'phase_9', 'non_empty_diff_count', (SELECT count(*) FROM (SELECT DISTINCT repo, before, after FROM diffs))
UNION ALL SELECT 'phase_9', 'tracked_block_count', (SELECT count(DISTINCT block) FROM snaps) UNION ALL SELECT 'phase_9', 'file_hotspot_count', (SELECT count(*) FROM (SELECT DISTINCT repo, path FROM snaps))
UNION ALL SELECT 'phase_9', 'drift_candidate_count', (SELECT count(*) FROM diffs) UNION ALL SELECT 'phase_9', 'architectural_drift_candidate_rate', 1 UNION ALL SELECT 'phase_9', 'pattern_success_index_block_count', (SELECT count(DISTINCT block) FROM t) UNION ALL SELECT 'phase_9', 'metrics_reproducible', 1)
SELECT phase_id, metric_id, round(value, 9) AS value FROM m""")
def phase_report(spark, d):
    nodes, edges = A.nodes(spark, d).where("layer = 'code'"), A.edges(spark, d)
    assigned = A.assignments(spark, d).withColumnRenamed("block", "primary_block")
    made = phases.report(
        phases.structure(nodes, edges, nodes.where("file_path IS NOT NULL")), phases.references(nodes, None), phases.semantics(nodes, assigned, None, A.table(spark, d, "supplier"), A.table(spark, d, "lineitem")),
        phases.history(nodes, A.changes(spark, d)),
    )
    return made.withColumn("value", F.round("value", 9))


@query(f"""WITH {CHANGES}, {SNAPS}, {DIFFS}, signed AS (SELECT repo, block, sum(CASE WHEN new THEN 1 ELSE -1 END) AS delta FROM sides GROUP BY repo, before, after, block), n AS (SELECT repo, count(*) AS pairs FROM pairs GROUP BY 1),
net AS (SELECT repo, block, sum(delta) AS total FROM signed WHERE delta <> 0 GROUP BY 1, 2), c AS (SELECT repo, path, count(*) AS n FROM diffs GROUP BY 1, 2), s AS (SELECT repo, sum(n) AS files, max(n) AS top FROM c GROUP BY 1)
SELECT repo, 'block_delta_total' AS metric, block AS key, round(total::DOUBLE, 4) AS value FROM net UNION ALL SELECT repo, 'block_churn_rate', block, round(abs(total)::DOUBLE / pairs, 4) FROM net JOIN n USING (repo)
UNION ALL SELECT repo, 'architectural_drift_candidate_rate', '', 1 FROM s UNION ALL SELECT repo, 'hotspot_concentration', '', round(top::DOUBLE / files, 4) FROM s UNION ALL SELECT repo, 'regret_accumulation_score', '', 1 FROM s""")
def history_report(spark, d):
    return temporal.history_report(temporal.snapshots(A.changes(spark, d)))


@query(f"""WITH {A.TEXT_SQL}, n AS (SELECT primary_block AS b, count(*) AS n FROM text_assign GROUP BY 1), t AS (SELECT string_agg(b, ', ' ORDER BY n DESC, b) AS top FROM (SELECT * FROM n ORDER BY n DESC, b LIMIT 5)),
p AS (SELECT 'Project docs represents repository org/docs. Its strongest observed responsibilities are ' || top || '. The summary is derived from ' || (SELECT count(*) FROM text_assign) || ' code-node semantic summaries.' AS text FROM t)
SELECT 'project' AS kind, text FROM p UNION ALL SELECT 'system', 'System org/docs currently contains 1 project graph(s). It exposes cross-cutting architecture evidence through structural code nodes, semantic entities, project summaries, and action edges. ' || substr(text, 1, 500) FROM p""")
def project_summaries(spark, d):
    project = enrichment.project_text(A.text_assignments(spark, d), "docs", "org/docs")
    return project.select(F.lit("project").alias("kind"), "text").unionByName(enrichment.system_text(project, "org/docs").select(F.lit("system").alias("kind"), "text"))


@query(f"""WITH {A.TEXT_SQL}, r AS (SELECT node_id, label, kind, file_path, primary_block, confidence FROM text_nodes JOIN text_assign USING (node_id))
SELECT 'sure' AS list, * FROM (SELECT * FROM r WHERE confidence >= 0.7 ORDER BY primary_block, file_path, node_id LIMIT 25) UNION ALL SELECT 'start', * FROM (SELECT * FROM r ORDER BY kind, file_path, node_id LIMIT 15)""")
def demo_candidates(spark, d):
    sure, starts = enrichment.candidates(A.text_nodes(spark, d), A.text_assignments(spark, d))
    return sure.select(F.lit("sure").alias("list"), "*").unionByName(starts.select(F.lit("start").alias("list"), "*"))


@query(f"""WITH {NODES} SELECT coalesce(repo_name, 'none') AS repo_name, node_id, kind FROM nodes WHERE layer = 'code' AND (coalesce(repo_name, 'none') <> 'ASIA' OR kind = 'supplier') AND NOT (coalesce(repo_name, 'none') = 'EUROPE' AND node_id LIKE '%7')""")
def stored_nodes(spark, d):
    """Code of all repositories in the store, one of them replaced, rows of another deleted, and all compacted."""
    code = A.nodes(spark, d).where("layer = 'code'").withColumn("repo_name", F.coalesce("repo_name", F.lit("none")))
    kept = graph_store.GraphStore(spark, f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}")
    kept.write({"code": code})
    kept.write({"code": code.where("repo_name = 'ASIA' AND kind = 'supplier'")}, cleared=("ASIA",))
    kept.delete("code", code.where("repo_name = 'EUROPE' AND node_id LIKE '%7'"))
    kept.compact()
    return kept.read("code").select("repo_name", "node_id", "kind")



# The names in _whole once told the whole job from a smaller one; both do the whole job now.
for _name in ("impact_radius", "symbol_trace", "bfs_path", "barrel_counts", "contradictions", "neighborhoods", "entity_rank"):
    QUERIES[f"{_name}_whole"], ORACLE_SQL[f"{_name}_whole"] = QUERIES[_name], ORACLE_SQL[_name]
