"""Rule-based multi-label classification as column expressions compiled from rule lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of the ontology, in order (fixed values).
BLOCKS = (
    "Identity UI", "State Management", "Core Rendering", "Interaction Design", "Asset Delivery", "Global Interface", "Edge Support", "Experimentation", "User Observability", "Error Boundaries",
    "Persistence Strategy", "Visual Systems", "Access Control", "System Telemetry", "Data Persistence", "Background Processing", "Traffic Control", "Network Edge", "Search Architecture", "Security Ops",
    "Connectivity Layer", "Resiliency", "Data Sovereignty", "Analytical Intelligence",
)
#: Priors by kind of node: block, weight, reason (fixed values).
KIND_PRIORS = {
    "route_handler": ("Network Edge", 2.5, "route handler seam"),
    "middleware": ("Network Edge", 2.0, "middleware seam"),
    "db_model": ("Data Persistence", 3.0, "database model seam"),
    "react_hook": ("State Management", 1.6, "custom hook seam"),
    "config_object": ("Security Ops", 0.4, "configuration seam"),
    "service_boundary": ("Connectivity Layer", 1.1, "service/client boundary"),
    "file_surface": ("Search Architecture", 0.8, "file-level architecture surface"),
}
#: Blocks of a path, in order: block, pattern (fixed values).
BLOCK_PATHS = (
    ("Access Control", r"(^|/)(auth|session|password|permission|rbac|guard|login|signup)"),
    ("System Telemetry", r"(^|/)(log|logger|telemetry|trace|metrics?|observability)"),
    ("Data Persistence", r"(^|/)(prisma|db|database|schema|model|migration)|\.(sql|prisma)$"),
    ("Background Processing", r"(^|/)(worker|job|queue|cron|schedule|task|script)s?(/|$)"),
    ("Traffic Control", r"(^|/)(rate|throttle|proxy|cors|gateway)"),
    ("Network Edge", r"(^|/)(route|router|api|server|controller)s?(/|\.|$)"),
    ("Search Architecture", r"(^|/)(search|index|elastic|opensearch|typesense)"),
    ("Security Ops", r"(^|/)(security|secret|csrf|crypto|encrypt|policy)"),
    ("Connectivity Layer", r"(^|/)(client|adapter|provider|service|gateway)s?(/|\.|$)"),
    ("Resiliency", r"(^|/)(backup|retry|fallback|circuit|restore)"),
    ("Data Sovereignty", r"(^|/)(privacy|gdpr|retention|archive|cookie|consent)"),
    ("Analytical Intelligence", r"(^|/)(analytics|warehouse|etl|report|segment|amplitude)"),
    ("Identity UI", r"(^|/)(login|signup|profile|account|avatar).*\.(tsx|jsx|vue|svelte)$"),
    ("State Management", r"(^|/)(store|state|context|reducer|hook)s?(/|\.)"),
    ("Core Rendering", r"\.(tsx|jsx|vue|svelte)$|(^|/)(page|component|view)s?(/|\.)"),
    ("Interaction Design", r"(^|/)(form|button|input|interaction|navigation)s?(/|\.)"),
    ("Asset Delivery", r"(^|/)(assets?|public|static|styles?|css|vite|webpack|rollup)"),
    ("Global Interface", r"(^|/)(i18n|locale|a11y|accessibility|translation)s?(/|\\.)"),
    ("Edge Support", r"(^|/)(support|chat|help|intercom|zendesk)"),
    ("Experimentation", r"(^|/)(experiment|feature-flag|ab-test|growth)s?(/|\.)"),
    ("User Observability", r"(^|/)(analytics|session-replay|web-vitals|client-metrics?)"),
    ("Error Boundaries", r"(^|/)(error-boundary|fallback|crash|exception)s?(/|\.)"),
    ("Persistence Strategy", r"(^|/)(cookie|localstorage|storage|cache|persist)"),
    ("Visual Systems", r"(^|/)(theme|design|tokens|typography|storybook|style)s?(/|\.)"),
)

#: Rules on paths, then rules on texts: block, pattern, weight, reason (fixed values).
PATH_PRIORS = (
    ("Data Persistence", r"(^|/)prisma(/|\.config)|(^|/)schema\.prisma$|(^|/)lib/prisma\.", 2.3, "persistence path"),
    ("Persistence Strategy", r"(^|/)(libs?/)?cache(/|\.)|(^|/)cache\.", 4.2, "cache/persistence strategy path"),
    ("Background Processing", r"(^|/)(bull|queues?|workers?)(/|\.)|(^|/).*(queue|worker)[^/]*\.", 3.2, "queue/worker path"),
    ("Global Interface", r"(^|/)(env|environment)\.config\.|(^|/)config/(env|environment)\.", 2.6, "environment interface path"),
    ("System Telemetry", r"(^|/)(logger|telemetry|tracing)\.", 2.0, "telemetry path"),
    ("Access Control", r"(^|/)(auth|passwords?|sessions?|permissions?)[^/]*\.", 1.7, "access-control path"),
    ("Access Control", r"(^|/)utils/(auth|docs-guard)\.", 1.7, "auth utility path"),
    ("Security Ops", r"(^|/)utils/security\.", 2.2, "security utility path"),
    ("Network Edge", r"(^|/)routes?/", 1.8, "route path"),
    ("Core Rendering", r"(^|/)emails?/.*\.(tsx|jsx)$", 2.4, "rendered email component path"),
    ("Background Processing", r"(^|/)(scripts|workers|jobs)/", 1.6, "worker/script path"),
    ("Connectivity Layer", r"(^|/)(services?|adapters|providers)/", 0.9, "service layer path"),
    ("Search Architecture", r"(^|/)(index|config/index|database/index|middlewares/index|modules/index|modules/[^/]+/index)\.(ts|tsx|js|jsx)$", 2.4, "architectural index path"),
)
SIGNALS = (
    ("Access Control", r"\b(auth|session|password|jwt|bearer|rbac|permission|role|guard)\b", 2.0, "auth/session token"),
    ("Access Control", r"\b(currentUser|signIn|signOut|login|signup|user_metadata|app_metadata)\b", 1.5, "identity operation"),
    ("Data Persistence", r"\b(prisma|database|postgres|sqlite|mysql|mongodb|schema|migration|model|supabase|drizzle|redis)\b", 2.0, "database/schema token"),
    ("Data Persistence", r"\b(upsert|insert|update|delete|select|query|findMany|findUnique|createClient)\b", 1.3, "persistence operation"),
    ("Network Edge", r"\b(elysia|express|hono|fastify|router|route|middleware|request|response)\b", 1.6, "http framework"),
    ("Network Edge", r"\b(fetch|axios|http\.|webhook|endpoint)\b", 1.2, "network call"),
    ("System Telemetry", r"\b(telemetry|logger?|log\.|tracer|metric|sentry|otel|opentelemetry)\b", 1.8, "observability token"),
    ("Security Ops", r"\b(secret|api[_-]?key|encrypt|decrypt|hash|salt|csrf|cors|helmet)\b", 1.5, "security token"),
    ("Traffic Control", r"\b(rate[_-]?limit|throttle|quota|cors|load balanc|proxy)\b", 1.4, "traffic control token"),
    ("Background Processing", r"\b(queue|worker|job|task|schedule|cron|bullmq)\b", 1.6, "async processing token"),
    ("Search Architecture", r"\b(search|index|meilisearch|typesense|elastic|opensearch)\b", 1.6, "search token"),
    ("Analytical Intelligence", r"\b(warehouse|etl|analytics|segment|amplitude|mixpanel|report)\b", 1.5, "analytics token"),
    ("Data Sovereignty", r"\b(gdpr|privacy|retention|archive|pii|cookie|consent)\b", 1.4, "privacy token"),
    ("Resiliency", r"\b(retry|fallback|circuit|backup|restore|catch|try\s*\{)\b", 1.2, "resilience token"),
    ("Identity UI", r"\b(login|signup|profile|avatar|account|auth form)\b", 1.6, "identity ui token"),
    ("State Management", r"\b(zustand|redux|context|useReducer|store|atom|signal)\b", 1.5, "state token"),
    ("Core Rendering", r"(</|className|jsx|tsx|render|component|return\s*\()", 1.3, "render token"),
    ("Interaction Design", r"\b(onClick|onSubmit|form|button|input|navigate|router\.push)\b", 1.3, "interaction token"),
    ("Asset Delivery", r"\b(vite|webpack|rollup|bundle|asset|image|font|css|tailwind)\b", 1.2, "asset/build token"),
    ("User Observability", r"\b(session replay|client analytics|browser metric|web vitals)\b", 1.5, "client observability token"),
    ("Error Boundaries", r"\b(error boundary|fallback ui|componentDidCatch|useErrorBoundary)\b", 1.7, "frontend fault boundary"),
)


def _rules(low: Column, content: Column, path: Column, kind: Column) -> list[tuple[str, Column, Column, str]]:
    """(block, whether it fires, weight, reason) of every rule in the order that they add up."""
    like = lambda c, pattern: c.rlike("(?isU)" + pattern)
    count = lambda word: F.size(F.regexp_extract_all(content, F.lit(rf"(?U)\b({word})\b"), F.lit(1)))
    out = [(block, kind == k, F.lit(w), why) for k, (block, w, why) in KIND_PRIORS.items()]
    out += [(block, like(path, pattern), F.lit(w), why) for block, pattern, w, why in PATH_PRIORS]
    out += [(block, like(low, pattern), F.lit(w), why) for block, pattern, w, why in SIGNALS]
    config, surface, p = kind == "config_object", kind == "file_surface", F.lower(path)
    database = like(low, r"\b(prisma|database|postgres|schema|migration)\b")
    index = p.rlike(r"/index\.(ts|tsx|js|jsx)$") | p.endswith("index.ts")
    return [
        *out,
        ("Data Persistence", config & database, F.lit(2.0), "database configuration"),
        ("Security Ops", config & ~database & like(low, r"\b(secret|key|token|env)\b"), F.lit(1.5), "secret/env configuration"),
        ("Identity UI", (kind == "react_hook") & like(low, r"\b(auth|session|user|profile)\b"), F.lit(1.7), "identity hook"),
        ("Search Architecture", surface & index, 2.0 + F.least(count("export"), F.lit(4)) * 0.25, "file surface is an index/barrel module"),
        ("Global Interface", surface & p.rlike(r"(^|/)(config|env|settings|drizzle|prisma)(/|\.)"), F.lit(1.6), "file surface exposes configuration boundary"),
        ("Connectivity Layer", surface & (count("import") >= 2) & (count("export") >= 1), F.lit(0.8), "file surface bridges imports and exports"),
    ]


def classify_nodes(nodes: DataFrame, neighbors: DataFrame | None = None) -> DataFrame:
    """(node_id, primary_block, confidence, reasoning, secondary) of every node by weighted signals.

    nodes: node_id, kind, label, file_path, content. neighbors: node_id, imports, same_file (arrays);
    their names count as text. All rules are column expressions over one row; nothing shuffles but the
    join with neighbors. Texts are read to 2,000 characters, the classifier's definition; ties between
    blocks go to the one whose first rule comes first.
    """
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (F.col("file_path"), F.col("label"), F.substring("content", 1, 2000))))
    if neighbors is not None:
        nodes = nodes.join(neighbors.select("node_id", "imports", "same_file"), "node_id", "left")
        near = [F.array_join(F.col("imports"), " "), F.array_join(F.slice("same_file", 1, 20), " ")]
        text = F.concat_ws(" ", text, *near)
    rows = nodes.select("node_id", F.lower(text).alias("low"), F.lower(F.coalesce("content", F.lit(""))).alias("c"), F.coalesce("file_path", F.lit("")).alias("p"), "kind")
    rules = _rules(F.col("low"), F.col("c"), F.col("p"), F.col("kind"))
    rows = rows.select("node_id", F.array(*(F.when(fires, weight.cast("double")).otherwise(0.0) for _, fires, weight, _ in rules)).alias("w"))
    made = []
    for block in dict.fromkeys(r[0] for r in rules):
        at = [i for i, r in enumerate(rules) if r[0] == block]
        score = F.col("w")[at[0]]
        for i in at[1:]:
            score = score + F.col("w")[i]
        first = F.coalesce(*(F.when(F.col("w")[i] > 0, F.lit(i)) for i in at))
        why = F.array_compact(F.array(*(F.when(F.col("w")[i] > 0, F.lit(rules[i][3])) for i in at)))
        made.append(F.struct((-score).alias("s"), first.alias("o"), F.lit(block).alias("block"), why.alias("why")))
    ranked = F.slice(F.array_sort(F.filter(F.array(*made), lambda x: x["s"] < 0)), 1, 4)
    rows = rows.select("node_id", ranked.alias("r")).withColumn("top", -F.get("r", F.lit(0))["s"])
    margin = F.col("top") - F.coalesce(-F.get("r", F.lit(1))["s"], F.lit(0.0))
    sure = F.least(0.42 + 0.08 * F.col("top") + 0.06 * margin, F.lit(0.95))
    confidence = F.when(F.size("r") == 0, 0.1).when(margin < 0.75, F.least(sure, F.lit(0.66))).otherwise(sure)
    reasons = F.when(F.size("r") == 0, F.array(F.lit("no matching deterministic signals"))).otherwise(F.slice(F.get("r", F.lit(0))["why"], 1, 5))
    rest = F.when(F.size("r") > 1, F.filter(F.slice("r", 2, 3), lambda x: -x["s"] >= F.greatest(F.lit(1.5), F.col("top") * 0.45))).otherwise(F.slice("r", 1, 0))
    second = F.transform(rest, lambda x: F.struct(x["block"].alias("block"), F.least(0.35 + 0.08 * -x["s"], F.lit(0.9)).alias("confidence")))
    return rows.select(
        "node_id", F.coalesce(F.get("r", F.lit(0))["block"], F.lit(BLOCKS[0])).alias("primary_block"), confidence.alias("confidence"),
        F.concat(F.lit("heuristic: weighted block signals: "), F.array_join(reasons, ", ")).alias("reasoning"), second.alias("secondary"),
    )


def signal_scores(docs: DataFrame, rules: Sequence[tuple[str, str, float]], text: str = "text", key: str = "doc_id", window: int = 2000) -> DataFrame:
    """(key, block, score): summed weights of the rules (block, pattern, weight) whose pattern is in
    the first ``window`` characters of the lower-cased text; blocks without a hit are left out.

    All rules of a block are one expression, so a row is read once whatever the number of rules, and
    nothing shuffles. The window is the classifier's definition.
    """
    low = F.lower(F.substring(F.coalesce(F.col(text), F.lit("")), 1, window))
    blocks: dict[str, Column] = {}
    for block, pattern, weight in rules:
        hit = F.when(low.rlike(pattern), F.lit(weight)).otherwise(F.lit(0.0))
        blocks[block] = blocks[block] + hit if block in blocks else hit
    made = F.array(*(F.struct(F.lit(b).alias("block"), s.alias("score"), F.lit(i).alias("ord")) for i, (b, s) in enumerate(blocks.items())))
    return docs.select(key, F.inline(made)).where("score > 0")


def primary_block(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, primary_block, score, margin): the best block by score, ties by rule order, and its lead."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "ord")
    ranked = scores.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    return ranked.where("rank = 1").select(key, F.col("block").alias("primary_block"), "score", (F.col("score") - F.coalesce("next", F.lit(0.0))).alias("margin"))


def path_blocks(paths: DataFrame, rules: Sequence[tuple[str, str]] = BLOCK_PATHS, path: str = "path") -> DataFrame:
    """paths with blocks: every matching rule's block in rule order, joined by commas, or Unclassified."""
    low = F.lower(F.translate(F.col(path), "\\", "/"))
    hits = F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(b)) for b, p in rules)))
    return paths.withColumn("blocks", F.when(F.size(hits) == 0, "Unclassified").otherwise(F.array_join(hits, ",")))


def keyword_patterns(docs: DataFrame, patterns: dict[str, Sequence[str]], text: str = "text", key: str = "doc_id", window: int = 800) -> DataFrame:
    """(pattern_id, hits, n_nodes): for each pattern how many of its keywords hit, over all nodes, and
    how many nodes have a hit, within the first ``window`` characters (the detector's definition).
    """
    low = F.lower(F.substring(F.coalesce(F.col(text), F.lit("")), 1, window))
    count = lambda words: sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    made = F.array(*(F.struct(F.lit(p).alias("pattern_id"), count(ws).alias("n")) for p, ws in patterns.items()))
    return docs.select(key, F.inline(made)).where("n > 0").groupBy("pattern_id").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("n_nodes"))


def regret_score(base: Column, keywords: Column, align: Column, files: Column) -> Column:
    raw = base + 0.15 * F.least(F.lit(1.0), keywords / 5) + 0.2 * align + 0.15 * F.least(F.lit(1.0), files / 8)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def barrel_counts(docs: DataFrame, words: Sequence[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_<word>...): occurrences of whole ASCII words."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    return docs.select(key, *(F.size(F.regexp_extract_all(t, F.lit(f"(?:^|[^a-z])({w})(?=[^a-z]|$)"), F.lit(1))).cast("long").alias(f"n_{w}") for w in words))


def infer_actions(names: DataFrame, rules: Sequence[tuple[str, str]], name: str = "name") -> DataFrame:
    """names with action: the first rule (action, pattern) that matches, else REPRESENT."""
    chain = F.coalesce(*(F.when(F.lower(F.col(name)).rlike(p), F.lit(a)) for a, p in rules), F.lit("REPRESENT"))
    return names.withColumn("action", chain)


def count_entities(candidates: DataFrame, top: int = 200) -> DataFrame:
    """The most frequent (category, name): count, ordered by count, category and name."""
    counts = candidates.groupBy("category", "name").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "category", "name").limit(top)
