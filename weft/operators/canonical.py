"""One graph of all that is known about a project: producers of nodes and edges, and their union.

Nodes: node_id, layer, kind, label, file_path, repo_name, provenance. Edges: source_id, target_id,
edge_type, repo_name, provenance, target_repo. Producers are kept in order; of nodes with one id the
last producer's stays, of equal edges one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import ids
from weft.operators import graph
from weft.session import cut

NODE, EDGE = ("node_id", "layer", "kind", "label", "file_path", "repo_name", "provenance"), ("source_id", "target_id", "edge_type", "repo_name", "provenance", "target_repo")
#: Kinds of other files whose layer is their kind (fixed values).
OWN_LAYER = ("test", "openapi", "infra", "codefile")


def _row(df: DataFrame, names: tuple[str, ...], **columns: Column | str | None) -> DataFrame:
    return df.select(*((c if isinstance(c, Column) else F.lit(c).cast("string")).alias(n) for n, c in ((n, columns.get(n)) for n in names)))


def project(nodes: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """The system and the project, and that the one contains the other."""
    one = nodes.sparkSession.range(1)
    pid = ids.project_id(F.lit(repo))
    system = _row(one, NODE, node_id="system:local", layer="system", kind="system", label=repo, repo_name=repo, provenance="canonical_graph")
    made = _row(one, NODE, node_id=pid, layer="project", kind="project", label=repo, repo_name=repo, provenance="tree_sitter")
    return system.unionByName(made), _row(one, EDGE, source_id="system:local", target_id=pid, edge_type="CONTAINS", repo_name=repo, provenance="canonical_graph")


def structure(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and code with their own edges. nodes: node_id, layer, kind, label, file_path, repo_name and
    symbol_source; edges may have a provenance."""
    source = F.when(F.col("symbol_source") == "scip", "scip").otherwise("tree_sitter")
    given = F.col("provenance") if "provenance" in edges.columns else F.lit(None).cast("string")
    return (
        _row(nodes, NODE, **{c: F.col(c) for c in NODE[:6]}, provenance=source),
        _row(edges, EDGE, source_id=F.col("source_id"), target_id=F.col("target_id"), edge_type=F.col("edge_type"), repo_name=F.col("repo_name"), provenance=F.coalesce(given, ids.infer_edge_provenance("edge_type")), target_repo=F.col("target_repo") if "target_repo" in edges.columns else None),
    )


def summaries(rows: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """rows: node_id, summary_type."""
    sid = F.concat(F.lit("summary:"), "summary_type", F.lit(":"), "node_id")
    made = _row(rows, NODE, node_id=sid, layer="semantic", kind=F.concat("summary_type", F.lit("_summary")), label=F.col("summary_type"), repo_name=repo, provenance="semantic_enrichment")
    return made, _row(rows, EDGE, source_id=sid, target_id=F.col("node_id"), edge_type="SUMMARIZES", repo_name=repo, provenance="semantic_enrichment")


def blocks(assignments: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """assignments: node_id, primary_block, secondary."""
    main = assignments.select("node_id", F.col("primary_block").alias("block"), F.lit("block_assignment").alias("kind"), F.lit("DESCRIBES").alias("edge"))
    more = assignments.select("node_id", F.explode("secondary").alias("s")).select("node_id", F.col("s.block").alias("block"), F.lit("secondary_block_assignment").alias("kind"), F.lit("SECONDARY_DESCRIBES").alias("edge"))
    rows = main.unionByName(more)
    sid = F.concat(F.lit("semantic:"), "node_id", F.lit(":"), "block")
    made = _row(rows, NODE, node_id=sid, layer="semantic", kind=F.col("kind"), label=F.col("block"), provenance="semantic_classifier")
    return made, _row(rows, EDGE, source_id=sid, target_id=F.col("node_id"), edge_type=F.col("edge"), repo_name=repo, provenance="semantic_classifier")


def entities(found: DataFrame, actions: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """found: entity_id, name; actions: node_id, entity_id, action."""
    made = _row(found, NODE, node_id=F.col("entity_id"), layer="semantic", kind="entity", label=F.col("name"), repo_name=repo, provenance="semantic_enrichment")
    relates = _row(found, EDGE, source_id=F.col("entity_id"), target_id=ids.project_id(F.lit(repo)), edge_type="RELATES_TO", repo_name=repo, provenance="semantic_enrichment")
    acts = _row(actions, EDGE, source_id=F.col("node_id"), target_id=F.col("entity_id"), edge_type=F.col("action"), repo_name=repo, provenance="semantic_enrichment")
    return made, relates.unionByName(acts)


def documents(paths: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """paths: path of every document of a symbol index."""
    did = F.concat(F.lit("scip-document:"), "path")
    made = _row(paths, NODE, node_id=did, layer="scip", kind="document", label=F.col("path"), file_path=F.col("path"), repo_name=repo, provenance="scip")
    return made, _row(paths, EDGE, source_id=did, target_id=F.concat(F.lit(f"repo://{repo}/"), "path"), edge_type="DESCRIBES_FILE", repo_name=repo, provenance="scip")


def others(nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Tests, interfaces and such: nodes (node_id, kind, path), edges (source_id, target_id, edge_kind)."""
    layer = F.when(F.col("kind").isin(*OWN_LAYER), F.col("kind")).otherwise("multimodal")
    made = _row(nodes, NODE, node_id=F.col("node_id"), layer=layer, kind=F.col("kind"), label=F.col("path"), file_path=F.col("path"), provenance=F.concat("kind", F.lit("_parser")))
    return made, _row(edges, EDGE, source_id=F.col("source_id"), target_id=F.col("target_id"), edge_type=F.col("edge_kind"), repo_name=repo, provenance="multimodal_correlation")


def snapshots(commits: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """commits: sha, subject."""
    made = _row(commits, NODE, node_id=F.concat(F.lit("temporal-snapshot:"), "sha"), layer="temporal", kind="graph_snapshot", label=F.coalesce("subject", F.substring("sha", 1, 12)), repo_name=repo, provenance="temporal_replay")
    return made, _row(commits.limit(0), EDGE)


def regrets(found: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """found: regret_id, title, node_ids (array, at most 40 a regret)."""
    rid = F.concat(F.lit("regret:"), "regret_id")
    made = _row(found, NODE, node_id=rid, layer="regret", kind="regret_surface", label=F.col("title"), repo_name=repo, provenance="regret_detector")
    return made, _row(found.withColumn("n", F.explode("node_ids")), EDGE, source_id=rid, target_id=F.col("n"), edge_type="EVIDENCED_BY", repo_name=repo, provenance="regret_detector")


def canonical(producers: list[tuple[DataFrame, DataFrame]], where_known: tuple[str, ...] = ("SUMMARIZES", "DESCRIBES_FILE")) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all producers; edges of the types in where_known stay only if their target is a node."""
    ordered = [n.withColumn("write_ord", F.lit(i)) for i, (n, _) in enumerate(producers)]
    nodes = reduce(DataFrame.unionByName, ordered)
    rest = [c for c in NODE if c != "node_id"]
    nodes = nodes.groupBy("node_id").agg(F.max_by(F.struct(*rest), F.struct("write_ord", *rest)).alias("r")).select("node_id", "r.*")
    edges = reduce(DataFrame.unionByName, (e for _, e in producers))
    weak = F.col("edge_type").isin(*where_known)
    # nodes are unique: an inner join, as a semi-join would be pushed into every producer and work nodes out for each
    known = edges.where(weak).join(nodes.select(F.col("node_id").alias("target_id")), "target_id")
    return nodes, edges.where(~weak).unionByName(known).distinct()


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node and edge counts, layers, dangling ends, and external targets among them. Nodes and edges are
    worked out once, edges dealt out once for each end."""
    own = cut(nodes.select("node_id", "layer"))
    n = own.agg(F.count(F.lit(1)).alias("node_count"), F.array_join(F.sort_array(F.collect_set("layer")), ",").alias("layers"))
    of = lambda side: own.where("node_id IS NOT NULL").select(F.col("node_id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_known")).distinct()
    met = edges.select("source_id", "target_id", "edge_type").join(of("target"), "target_id", "left").join(of("source"), "source_id", "left")
    lost = lambda side: F.col(f"{side}_known").isNull()
    outside = graph.is_external("target", F.col("edge_type"), F.col("target_id"))
    e = met.agg(F.count(F.lit(1)).alias("edge_count"), (F.count_if(lost("source")) + F.count_if(lost("target"))).alias("dangling_edge_count"), F.count_if(lost("target") & outside).alias("external_edge_count"))
    return n.join(F.broadcast(e))  # one row each
