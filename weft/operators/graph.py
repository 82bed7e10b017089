"""Property-graph operators: lookups, joins, integrity checks, degrees, bounded traversal.

nodes: node_id, layer, kind, label, repo_name, file_path. edges: source_id, target_id, edge_type,
repo_name. Traversals deal edges out by their source once and cache them; a level joins them with the
nodes found last, which are broadcast if counted to be few, and is checkpointed, so plans stay short.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import draws
from weft.operators.draws import BITS, DRAWN  # noqa: F401
from weft.session import cut

#: Edge types that a symbol trace follows, and weights of influence along edges (fixed values).
TRACE_TYPES = ("REFERENCES", "CALLS", "CROSS_REFERENCE", "DEFINES", "IMPLEMENTS")
PROPAGATION = {"REFERENCES": 0.92, "CALLS": 0.90, "IMPLEMENTS": 0.88, "DEFINES": 0.85, "CROSS_REFERENCE": 0.80, "IMPORTS_MODULE": 0.72, "DEPENDS_ON": 0.68, "DEPENDS_ON_FILE": 0.55, "CONTAINS": 0.35}


def node_lookup(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id).limit(1)


def incident_edges(edges: DataFrame, node_id: str, direction: str = "both", limit: int = 200) -> DataFrame:
    """Edges out of, into, or both out of and into a node, ``limit`` (1 to 10000) per direction; in
    "both", a loop comes twice."""
    n = max(1, min(limit, 10_000))
    out = edges.where(F.col("source_id") == node_id).orderBy("edge_type", "target_id").limit(n)
    into = edges.where(F.col("target_id") == node_id).orderBy("edge_type", "source_id").limit(n)
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def touching_edges(edges: DataFrame, node_id: str) -> DataFrame:
    """Edges with the node at either end, a loop once."""
    return edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id))


def assigned(assignments: DataFrame, block: str, least: float = 0.0) -> DataFrame:
    return assignments.where((F.col("block") == block) & (F.col("confidence") >= least))


def files_for_block(nodes: DataFrame, assignments: DataFrame, block: str, least: float = 0.0) -> DataFrame:
    """(file_path): the files of nodes with the block, in order."""
    return assigned(assignments, block, least).join(nodes, "node_id").select("file_path").distinct().orderBy("file_path")


def assigned_nodes(nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    """assignments with the label and file of their node, null where the node is unknown."""
    return assignments.join(nodes.select("node_id", "label", "file_path"), "node_id", "left")


def same_block_edges(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges whose ends have the same block. blocks: node_id, block."""
    of = lambda side: blocks.select(F.col("node_id").alias(f"{side}_id"), F.col("block").alias(f"{side}_block"))
    return edges.join(of("source"), "source_id").join(of("target"), "target_id").where("source_block = target_block").drop("source_block", "target_block")


def with_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with the labels of both ends."""
    at = lambda side: nodes.select(F.col("node_id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"))
    return edges.join(at("source"), "source_id", "left").join(at("target"), "target_id", "left")


def unknown_paths(nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    """(node_id, file_path, missing): code whose file is no node, and assignments to nodes that don't exist."""
    files = nodes.where("layer = 'file'").select("file_path").distinct()
    lost = nodes.where("layer = 'code' AND file_path IS NOT NULL").join(files, "file_path", "left_anti").select("node_id", "file_path", F.lit("file").alias("missing"))
    loose = assignments.join(nodes.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(None).cast("string").alias("file_path"), F.lit("node").alias("missing"))
    return lost.unionByName(loose)


def symbol_members(nodes: DataFrame, symbol: str, member: str) -> DataFrame:
    """(symbol, n, member): which nodes go by a symbol, a row each, with how many they are."""
    n = F.count(F.lit(1)).over(Window.partitionBy(symbol))
    return nodes.select(F.col(symbol).alias("symbol"), n.alias("n"), F.col(member).alias("member"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type): every edge in both directions, multi-edges kept."""
    ends = F.array(F.struct(F.col("source_id").alias("src"), F.col("target_id").alias("dst")), F.struct(F.col("target_id").alias("src"), F.col("source_id").alias("dst")))
    return edges.select("edge_type", F.explode(ends).alias("e")).select("e.src", "e.dst", "edge_type")


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree), both directions; a loop counts twice."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def incident_count(edges: DataFrame, node_id: str) -> DataFrame:
    side = lambda c: F.count_if(F.col(c) == node_id)
    return edges.agg((side("source_id") + side("target_id")).alias("n"))


def is_external(side: str, edge_type: Column, target: Column) -> Column:
    """Whether an endpoint may lie outside the graph: targets only, modules and foreign symbols."""
    if side != "target":
        return F.lit(False)
    foreign = target.startswith("scip-typescript npm ") | target.startswith("local ")
    return ((edge_type == "IMPORTS_MODULE") & target.startswith("module:")) | (edge_type.isin("REFERENCES", "IMPLEMENTS") & foreign)


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an endpoint that no node has, and which side; allowed external targets left out."""
    known = nodes.select("node_id")
    found = []
    for side in ("source", "target"):
        lost = edges.join(known, edges[f"{side}_id"] == known["node_id"], "left_anti")
        found.append(lost.where(~is_external(side, F.col("edge_type"), F.col("target_id"))).withColumn("side", F.lit(side)))
    return found[0].unionByName(found[1])


def external_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target lies outside and may."""
    lost = edges.join(nodes.select("node_id"), edges["target_id"] == F.col("node_id"), "left_anti")
    return lost.where(is_external("target", F.col("edge_type"), F.col("target_id")))


def missing_containment(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    held = edges.where("edge_type = 'CONTAINS'").select(F.col("target_id").alias("node_id")).distinct()
    return nodes.where("layer = 'code'").join(held, "node_id", "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """Nodes that no edge of the given types touches."""
    some = edges.where(F.col("edge_type").isin(*types))
    return nodes.join(some.select(F.explode(F.array("source_id", "target_id")).alias("node_id")), "node_id", "left_anti")


def connected_to_known(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with at least one edge whose other end is a node too.

    Such an edge has both ends among nodes, so edges are dealt out once for each end, and what is left gives the
    nodes. These are inner joins: Spark would push semi-joins into every part of a union and work the other
    side out for each.
    """
    known = nodes.select("node_id").distinct()
    of = lambda side: known.select(F.col("node_id").alias(f"{side}_id"))
    met = edges.select("source_id", "target_id").join(of("target"), "target_id").join(of("source"), "source_id")
    return nodes.join(met.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct(), "node_id")


def endpoint_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with the file paths of both ends; null where an end is unknown."""
    at = lambda side: nodes.select(F.col("node_id").alias(f"{side}_id"), F.col("file_path").alias(f"{side}_path"))
    return edges.join(at("source"), "source_id", "left").join(at("target"), "target_id", "left")


def last_written(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key, the one written last."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def first_seen(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def rewrite_targets(edges: DataFrame, renamed: DataFrame) -> DataFrame:
    """edges with targets replaced through renamed (old_id, new_id)."""
    joined = edges.join(renamed, edges["target_id"] == renamed["old_id"], "left")
    return joined.withColumn("target_id", F.coalesce("new_id", "target_id")).drop("old_id", "new_id")


def neighborhoods(code: DataFrame, file_edges: DataFrame) -> DataFrame:
    """Per code node: sorted imports and importers of its file, and the other nodes of its file.

    file_edges: source_id, target_id over files and modules.
    """
    sets = lambda by, of, name: file_edges.groupBy(F.col(by).alias("file_id")).agg(F.sort_array(F.collect_set(of)).alias(name))
    inside = code.groupBy("file_id").agg(F.sort_array(F.collect_set("node_id")).alias("all_ids"))
    out = code.join(sets("source_id", "target_id", "imports"), "file_id", "left").join(sets("target_id", "source_id", "imported_by"), "file_id", "left").join(inside, "file_id", "left")
    none = F.array().cast("array<string>")
    return out.select("node_id", "file_id", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"), F.array_remove(F.coalesce("all_ids", none), F.col("node_id")).alias("same_file"))


def containment_join(points: DataFrame, spans: DataFrame, on: str) -> DataFrame:
    """Each point (on, point_id, at) with the narrowest span (on, span_id, low, high) that holds it,
    else the nearest one of the same key; ties by span_id.

    Spans are dealt by length into levels whose bins are about as long as they, so each is in a few bins and a
    point meets, level by level, only spans around it. Of the spans beside a point the one before that ends
    last and the one behind that starts first are nearest: a running value over a key each way.
    """
    key = [on, "point_id", "at"]
    sized = spans.select(on, "span_id", "low", "high", F.floor(F.log2((F.col("high") - F.col("low") + 1).cast("double"))).cast("int").alias("level"))
    levels = sorted(r["level"] for r in sized.select("level").distinct().collect() if r["level"] is not None)  # 63 at most
    size = F.pow(F.lit(2.0), F.col("level")).cast("long")
    bins = lambda c: F.floor(F.col(c) / size)
    binned = sized.withColumn("bin", F.explode(F.sequence(bins("low"), bins("high"))))
    probes = points.select(*key).distinct().withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("bin", bins("at"))
    met = probes.join(binned, [on, "level", "bin"]).where("at BETWEEN low AND high")
    inside = met.groupBy(*key).agg(F.min(F.struct((F.col("high") - F.col("low")).alias("w"), F.col("span_id").alias("i")))["i"].alias("span_id"))
    lost = points.select(*key).distinct().join(inside, key, "left_anti")
    for side, place, sign in (("before", "high", -1), ("behind", "low", 1)):
        mark = F.struct((sign * F.col(place)).alias("w"), F.col("span_id").alias("i"))
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in lost.schema if f.name != on]
        marks = spans.select(on, F.col(place).cast("long").alias("__at"), mark.alias("__r"), *none)
        rows = marks.unionByName(lost.withColumns({"__at": F.col("at").cast("long"), "__r": F.lit(None).cast(marks.schema["__r"].dataType)}))
        order = F.col("__at").asc() if side == "before" else F.col("__at").desc()
        w = Window.partitionBy(on).orderBy(order, F.col("__r").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        lost = rows.withColumn(f"__{side}", F.min("__r").over(w)).where("point_id IS NOT NULL").drop("__at", "__r")
    off = lambda side, sign: F.when(F.col(side).isNotNull(), F.struct((F.col(f"{side}.w") + sign * F.col("at")).alias("w"), F.col(f"{side}.i").alias("i")))
    beside = lost.select(*key, F.least(off("__before", 1), off("__behind", -1))["i"].alias("span_id")).where("span_id IS NOT NULL")
    return inside.withColumn("inside", F.lit(True)).unionByName(beside.withColumn("inside", F.lit(False))).select(*key, "span_id", "inside")


#: Nodes that a level's broadcast may hold (about 10 MB).
FEW = 100_000
#: Of how many nodes one has its steps counted.
SOME = 64


def _dealt(steps: DataFrame) -> DataFrame:
    """steps (src, dst, ...) dealt out by src and cached; what is lost with an executor is made again."""
    return steps.repartition("src").persist(StorageLevel.MEMORY_AND_DISK)


def _from(steps: DataFrame, frontier: DataFrame) -> DataFrame:
    """steps that leave the nodes of frontier (node_id as src, ...), which has been cut."""
    return steps.join(F.broadcast(frontier) if frontier.count() <= FEW else frontier, "src")


def reach(steps: DataFrame, start: DataFrame, depth: int, hub: int | None = None) -> DataFrame:
    """(node_id, depth): what can be reached from start (node_id) along steps (src, dst) in at most
    ``depth`` levels, each node at its least depth. Nodes that more than ``hub`` steps leave are reached
    but not left, unless they are in start. Ends early once a level finds nothing new.
    """
    dealt = _dealt(steps.select("src", "dst"))
    hubs = None if hub is None else cut(dealt.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub).select("src"))
    new = cut(start.select("node_id", F.lit(0).alias("depth")).distinct())
    seen = new
    for level in range(1, depth + 1):
        frontier = new.select(F.col("node_id").alias("src"))
        if hubs is not None and level > 1:
            frontier = frontier.join(hubs, "src", "left_anti")
        found = _from(dealt, frontier).select(F.col("dst").alias("node_id")).distinct()
        new = cut(found.join(seen, "node_id", "left_anti").withColumn("depth", F.lit(level)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    dealt.unpersist()
    return seen


def impact_radius(edges: DataFrame, node_id: str, depth: int = 4, hub: int = 80) -> DataFrame:
    """(node_id, depth): the undirected surroundings of a node; nodes of a degree above ``hub`` are
    not expanded (the start is). As nodes at the last depth still add their neighbours, results lie
    up to depth + 1 away; depth is held within 0 to 32.
    """
    start = edges.sparkSession.createDataFrame([(node_id,)], "node_id string")
    return reach(both_ways(edges), start, max(0, min(depth, 32)) + 1, hub)


def impact_subgraph(edges: DataFrame, node_id: str, depth: int = 4, most: int = 200, hub: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, pruned) around a node: node_id and depth of the ``most`` nearest nodes, ties by id; the edges
    between nodes that were expanded and what these lead to, at most four for each of ``most``; and the
    nodes that were reached but not expanded for their degree, with it. ``most`` is held within 1 to 5,000."""
    most = max(1, min(most, 5000))
    found = impact_radius(edges, node_id, depth, hub)
    kept = cut(found.orderBy("depth", "node_id").limit(most))
    degrees = _degrees(edges, kept)
    pruned = degrees.where((F.col("incident_edges") > hub) & (F.col("node_id") != node_id)).select("node_id", "incident_edges")
    inner = kept.where(F.col("depth") <= max(0, min(depth, 32))).join(pruned, "node_id", "left_anti").select("node_id")
    one = edges.join(inner.select(F.col("node_id").alias("source_id")), "source_id", "left_semi").select(edges.columns)
    other = edges.join(inner.select(F.col("node_id").alias("target_id")), "target_id", "left_semi").select(edges.columns)
    touched = one.unionByName(other).distinct().orderBy("source_id", "target_id", "edge_type").limit(4 * most)
    return kept, touched, pruned


def _degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, incident_edges) of some nodes."""
    ends = F.array_distinct(F.array("source_id", "target_id"))
    return edges.select(F.explode(ends).alias("node_id")).join(nodes.select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.count(F.lit(1)).alias("incident_edges"))


def trace_path(edges: DataFrame, start: str, end: str, depth: int = 8) -> tuple[DataFrame, dict[str, int]]:
    """(path, counts): a shortest path along symbol edges in both directions as rows (ord, node_id), none if there
    is none within ``depth`` (held within 1 to 64); counts: nodes reached from each end.

    The search goes on from whichever end has reached fewer nodes last, each node keeping its least
    parent, until both have met; far fewer nodes are reached than from one end alone.
    """
    spark = edges.sparkSession
    dealt = _dealt(both_ways(edges.where(F.col("edge_type").isin(*TRACE_TYPES))).select("src", "dst"))
    first = lambda node: [cut(spark.createDataFrame([(node, None)], "node_id string, parent string"))]
    levels = {"start": first(start), "end": first(end)}
    seen, counts, width = {k: v[0] for k, v in levels.items()}, {"start": 1, "end": 1}, {"start": 1, "end": 1}
    meet = start if start == end else None
    for _ in range(max(1, min(depth, 64))):
        if meet is not None or not all(width.values()):
            break
        side = min(width, key=width.get)
        other = "end" if side == "start" else "start"
        found = _from(dealt, levels[side][-1].select(F.col("node_id").alias("src"))).groupBy(F.col("dst").alias("node_id")).agg(F.min("src").alias("parent"))
        new = cut(found.join(seen[side].select("node_id"), "node_id", "left_anti"))
        levels[side].append(new)
        width[side] = new.count()
        counts[side] += width[side]
        seen[side] = seen[side].unionByName(new)
        meet = new.join(seen[other].select("node_id"), "node_id", "left_semi").agg(F.min("node_id")).first()[0]
    dealt.unpersist()
    path: list[str] = []
    if meet is not None:
        back = {}
        for side in levels:
            back[side], at = [], meet
            for level in reversed(levels[side]):  # one row a level
                row = level.where(F.col("node_id") == at).first()
                if row is not None and row["parent"] is not None:
                    back[side].append(row["parent"])
                    at = row["parent"]
        path = [*reversed(back["start"]), meet, *back["end"]]
    return spark.createDataFrame(list(enumerate(path)), "ord int, node_id string"), counts


def symbol_trace(edges: DataFrame, node_id: str, depth: int = 8) -> DataFrame:
    """(node_id, depth) along symbol edges in both directions; depth is held within 1 to 64."""
    start = edges.sparkSession.createDataFrame([(node_id,)], "node_id string")
    return reach(both_ways(edges.where(F.col("edge_type").isin(*TRACE_TYPES))), start, max(1, min(depth, 64)))


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 6) -> DataFrame:
    """(pair, path, depth): for each of pairs (pair, start, end) one directed path of fewest edges, its
    nodes the least ones going back from the end; no row for pairs without one within ``depth`` edges.

    Each level keeps a node's least parent; paths are put together at the end, level by level.
    """
    dealt = _dealt(edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")))
    pairs = cut(pairs.select("pair", "start", "end"))
    levels = [cut(pairs.select("pair", F.col("start").alias("node_id"), F.lit(None).cast("string").alias("parent")))]
    seen, goals, n = levels[0].select("pair", "node_id"), pairs.select("pair", F.col("end").alias("node_id")), pairs.count()
    for _ in range(depth):
        if seen.join(goals, ["pair", "node_id"], "left_semi").count() >= n:
            break
        found = _from(dealt, levels[-1].select("pair", F.col("node_id").alias("src"))).groupBy("pair", F.col("dst").alias("node_id")).agg(F.min("src").alias("parent"))
        levels.append(cut(found.join(seen, ["pair", "node_id"], "left_anti")))
        if levels[-1].isEmpty():
            break
        seen = seen.union(levels[-1].select("pair", "node_id"))
    dealt.unpersist()
    back = pairs.select("pair", "start", F.col("end").alias("at"), F.array("end").alias("path"))
    for level in levels[:0:-1]:
        back = back.join(level.select("pair", F.col("node_id").alias("at"), "parent"), ["pair", "at"], "left")
        back = back.select("pair", "start", F.coalesce("parent", "at").alias("at"), F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.array("parent"), "path")).alias("path"))
    return back.where("at = start").select("pair", F.array_join("path", " > ").alias("path"), (F.size("path") - 1).alias("depth"))


def shortest_path(edges: DataFrame, start: str, end: str, depth: int = 6) -> DataFrame:
    """(path, depth) of one pair; no row if there is no path."""
    return shortest_paths(edges, edges.sparkSession.createDataFrame([(0, start, end)], "pair int, start string, end string"), depth).drop("pair")


def propagation_weight(edge_type: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in PROPAGATION.items() for x in pair))
    return F.coalesce(known[edge_type], F.lit(0.5))


def causal_overlay(nodes: DataFrame, edges: DataFrame, hot_files: DataFrame, blocks: DataFrame, tokens: list[str]) -> DataFrame:
    """edges with base_weight and adjusted_weight.

    A weight by type grows by 1.10 if both ends lie in hot files (1.05: one of them), 1.08 if both
    have the same block, 1.12 if a change token is part of either path; held within 0.04 to 0.98.
    hot_files: file_path. blocks: node_id, block. What a node adds is worked out once a node, so edges
    are dealt out once for each end.
    """
    hot = hot_files.select("file_path", F.lit(1).alias("hot")).distinct()
    touched = reduce(lambda a, b: a | b, (F.coalesce(F.lower("file_path").contains(t.lower()), F.lit(False)) for t in tokens if len(t) >= 3), F.lit(False))
    known = nodes.select("node_id", "file_path").join(hot, "file_path", "left").select("node_id", F.coalesce("hot", F.lit(0)).alias("hot"), touched.alias("touched"))
    known = known.join(blocks.select("node_id", "block"), "node_id", "full")
    of = lambda side: known.select(F.col("node_id").alias(f"{side}_id"), F.col("hot").alias(f"{side}_hot"), F.col("touched").alias(f"{side}_touched"), F.col("block").alias(f"{side}_block"))
    e = edges.select("source_id", "target_id", "edge_type").join(of("target"), "target_id", "left").join(of("source"), "source_id", "left")
    n = F.coalesce("source_hot", F.lit(0)) + F.coalesce("target_hot", F.lit(0))
    touch = F.coalesce("source_touched", F.lit(False)) | F.coalesce("target_touched", F.lit(False))
    base = propagation_weight(F.col("edge_type"))
    factor = F.when(n == 2, 1.10).when(n == 1, 1.05).otherwise(1.0) * F.when(F.col("source_block") == F.col("target_block"), 1.08).otherwise(1.0) * F.when(touch, 1.12).otherwise(1.0)
    return e.select("source_id", "target_id", "edge_type", base.alias("base_weight"), F.least(F.greatest(base * factor, F.lit(0.04)), F.lit(0.98)).alias("adjusted_weight"))


def monte_carlo_reach(weighted: DataFrame, seeds: DataFrame, runs: int = 64, depth: int = 8, seed: int = 42) -> DataFrame:
    """(run, node_id): what a change at seeds (node_id) reaches in each run, from monte_carlo_bits."""
    bits = monte_carlo_bits(weighted, seeds, runs, depth, seed)
    return bits.select(F.explode(_runs_of(F.col("runs"), F.col("bunch"))).alias("run"), "node_id")


def _runs_of(bits: Column, bunch: Column) -> Column:
    each = F.sequence(F.lit(0), F.lit(BITS - 1))
    return F.transform(F.filter(each, lambda r: _bit(bits, r) == 1), lambda r: bunch * BITS + r)


def run_sizes(bits: DataFrame) -> DataFrame:
    """(run, n): how many nodes each run of monte_carlo_bits reaches, from a sum for each bit."""
    sums = bits.groupBy("bunch").agg(F.array(*(F.sum(_bit(F.col("runs"), F.lit(i))) for i in range(BITS))).alias("sums"))
    return sums.select("bunch", F.posexplode("sums").alias("i", "n")).where("n > 0").select((F.col("bunch") * BITS + F.col("i")).alias("run"), "n")


def _bit(bits: Column, i: Column) -> Column:
    return F.call_function("shiftright", bits, i).bitwiseAND(F.lit(1).cast("long"))


def monte_carlo_bits(weighted: DataFrame, seeds: DataFrame, runs: int = 64, depth: int = 8, seed: int = 42) -> DataFrame:
    """(node_id, bunch, runs): the runs, as bits of a long, in which a change at seeds (node_id) reaches a node;
    bit i of bunch b is run 64 b + i.

    weighted: source_id, target_id, weight, and perhaps edge_type. In a run every edge passes on with its
    weight as chance, by an MD5 of seed, run, ends, type, direction and its number among edges that are
    equal in these (by weight), so runs repeat exactly, parallel edges are tried one by one, and every
    level is one join. An edge is tried once a run from each of its ends.

    All runs of a bunch move as one row, and the steps into a node are drawn one after another (many nodes at once), each
    only for the runs that haven't reached it, so draws grow with nodes and runs rather than edges and runs. A level takes
    the steps out of the nodes that were reached last or, where these are fewer, those into the nodes that some run
    hasn't reached: as steps go both ways, these are known from the steps out of them.
    """
    kind = F.col("edge_type") if "edge_type" in weighted.columns else F.lit("")
    typed = weighted.select("source_id", "target_id", kind.alias("edge_type"), "weight")
    nth = F.row_number().over(Window.partitionBy("source_id", "target_id", "edge_type").orderBy("weight"))
    # a draw, of 32 bits, passes if it is at most the bar
    bar = F.when(F.col("weight") >= 1, float(1 << 32)).when(F.col("weight") >= 0, F.floor(F.col("weight") * float(1 << 32))).otherwise(-1).cast("long")
    numbered = typed.select("source_id", "target_id", "edge_type", nth.alias("nth"), bar.alias("bar"))
    end = lambda src, dst, way: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(way).alias("way"))
    both = numbered.select("edge_type", "nth", "bar", F.explode(F.array(end("source_id", "target_id", "a"), end("target_id", "source_id", "b"))).alias("e"))
    # sorted once: a level with many nodes would sort all steps for its join
    dealt = both.select("e.src", "e.dst", "e.way", "edge_type", "nth", "bar").repartition("src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)
    # steps are counted of one node in SOME, or fewer, for a choice that changes no result
    degree = cut(dealt.where(F.pmod(F.xxhash64("src"), F.lit(SOME)) == 0).groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n")))
    every = SOME * max(1, -(-degree.count() // (2 * FEW)))
    degree = degree.where(F.pmod(F.xxhash64("node_id"), F.lit(every)) == 0)
    n_steps = degree.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    last = -(-runs // BITS) - 1
    full = lambda b: -1 if b < last or runs % BITS == 0 else (1 << runs % BITS) - 1
    bunches = F.array(*(F.struct(F.lit(b).alias("bunch"), F.lit(full(b)).cast("long").alias("new")) for b in range(last + 1)))
    state = cut(seeds.select("node_id").distinct().select("node_id", F.inline(bunches)).withColumn("runs", F.col("new")))
    done = F.col("runs") == F.when(F.col("bunch") == last, F.lit(full(last)).cast("long")).otherwise(F.lit(-1).cast("long"))
    of = weighted.schema["target_id"].dataType.simpleString()

    for _ in range(depth):
        frontier = state.where("new <> 0").select("node_id", "bunch", "new")
        if frontier.isEmpty():
            break
        some = state.where(F.pmod(F.xxhash64("node_id"), F.lit(every)) == 0).join(F.broadcast(degree), "node_id")
        n = some.agg(F.sum(F.when(F.col("new") != 0, F.col("n"))).alias("new"), F.sum(F.when(done, F.col("n"))).alias("done")).first()
        if 2 * ((last + 1) * n_steps - (n["done"] or 0)) < (n["new"] or 0):  # into the others, each of which is dealt out twice
            whole = state.where(done).groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == last + 1)
            steps = dealt.join(whole.select(F.col("node_id").alias("src")), "src", "left_anti").join(frontier.withColumnRenamed("node_id", "dst"), "dst")
            src, dst, way = "dst", "src", F.when(F.col("way") == "a", "b").otherwise("a")
        else:
            steps = _from(dealt, frontier.withColumnRenamed("node_id", "src"))
            src, dst, way = "src", "dst", F.col("way")
        said = F.concat_ws(":", src, dst, "edge_type", way, F.col("nth").cast("string"))
        tried = steps.select(F.col(dst).alias("node_id"), "bunch", "new", "bar", said.alias("said"))
        known = state.select("node_id", "bunch", F.col("runs").alias("known"))
        tried = tried.join(known.hint("merge"), ["node_id", "bunch"], "left")  # sorted by node
        left = F.col("new").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        found = tried.select("node_id", "bunch", left.alias("runs"), "bar", "said").where("runs <> 0").mapInArrow(draws.passing(seed), f"node_id {of}, bunch int, runs bigint")
        none = F.lit(0).cast("long")
        rows = state.select("node_id", "bunch", none.alias("new"), "runs").unionByName(found.select("node_id", "bunch", F.col("runs").alias("new"), none.alias("runs")))
        merged = rows.groupBy("node_id", "bunch").agg(F.bit_or("new").alias("new"), F.bit_or("runs").alias("runs"))
        state = cut(merged.select("node_id", "bunch", F.col("new").bitwiseAND(F.bitwise_not("runs")).alias("new"), F.col("new").bitwiseOR(F.col("runs")).alias("runs")))
    dealt.unpersist()
    return state.select("node_id", "bunch", "runs")


def layer_status(checks: DataFrame) -> DataFrame:
    """(layer, status) of checks (layer, check_id, status): fail before warn before pass."""
    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    return checks.groupBy("layer").agg(F.max_by("status", rank).alias("status"))


def integrity_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(layer, check_id, status, detail): each structural check with the number of offenders.

    Edges are dealt out once for each end to learn which ends are nodes, and their ends once more by node; all
    four checks are sums over these, and edges that have been found so are kept for both.
    """
    known = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("layer") == "code").alias("code"))
    of = lambda side: known.select(F.col("node_id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_known"))
    met = edges.select("source_id", "target_id", "edge_type").join(of("target"), "target_id", "left").join(of("source"), "source_id", "left")
    met = met.withColumns({f"{side}_known": F.coalesce(f"{side}_known", F.lit(False)) for side in ("source", "target")}).persist(StorageLevel.MEMORY_AND_DISK)
    lost = lambda side: F.count_if(~F.col(f"{side}_known") & ~is_external(side, F.col("edge_type"), F.col("target_id")))
    dangling = met.agg((lost("source") + lost("target")).alias("dangling"))
    end = lambda side, other, held: F.struct(F.col(f"{side}_id").alias("node_id"), F.col(f"{other}_known").alias("linked"), held.alias("held"))
    ends = met.select(F.inline(F.array(end("source", "target", F.lit(False)), end("target", "source", F.coalesce(F.col("edge_type") == "CONTAINS", F.lit(False))))))
    ends = ends.where("node_id IS NOT NULL AND (linked OR held)").select("node_id", "linked", "held", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("code"))
    each = ends.unionByName(known.select("node_id", F.lit(False).alias("linked"), F.lit(False).alias("held"), "n", "code")).groupBy("node_id").agg(F.max("linked").alias("linked"), F.max("held").alias("held"), F.sum("n").alias("n"), F.sum("code").alias("code"))
    some = lambda of, n: F.coalesce(F.sum(F.when(~F.col(of), F.col(n))), F.lit(0))
    sums = each.agg(F.count_if(F.col("n") > 1).alias("repeated"), some("held", "code").alias("loose"), some("linked", "n").alias("alone")).crossJoin(dangling)
    checks = (("structural", "node_ids_unique", "repeated"), ("structural", "no_dangling_edges", "dangling"), ("structural", "code_is_contained", "loose"), ("canonical", "nodes_connected", "alone"))
    rows = F.array(*(F.struct(F.lit(layer).alias("layer"), F.lit(check).alias("check_id"), F.when(F.col(c) == 0, "pass").otherwise("fail").alias("status"), F.col(c).alias("detail")) for layer, check, c in checks))
    out = cut(sums.select(F.inline(rows)))
    met.unpersist()
    return out


def phase_metrics(nodes: DataFrame, edges: DataFrame, assignments: DataFrame, changes: DataFrame) -> DataFrame:
    """(phase, metric, value) of a project, one row a metric; each table is read once. assignments:
    node_id, block, confidence; changes: path."""
    of = lambda df, phase, **metrics: df.agg(F.array(*(F.struct(F.lit(phase).alias("phase"), F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metrics.items())).alias("x")).select(F.inline("x"))
    every = F.count(F.lit(1))
    code = nodes.where("layer = 'code'").agg(every.alias("n_code"))
    parts = [
        of(nodes, "ingest", nodes=every, files=F.count_if(F.col("layer") == "file")),
        of(edges, "graph", edges=every, edge_types=F.count_distinct("edge_type")),
        of(dangling_edges(nodes, edges), "graph", dangling=every),
        of(assignments.join(F.broadcast(code)), "classify", assigned=every, blocks=F.count_distinct("block"), coverage=every / F.max("n_code"), confidence=F.round(F.avg("confidence"), 9)),
        of(changes, "history", changes=every, paths=F.count_distinct("path")),
    ]
    return reduce(DataFrame.unionByName, parts)


def ranked(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
