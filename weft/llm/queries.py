"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm._shared import table
from weft.llm.byte_bpe import bpe_report
from weft.llm.centroid_clusters import CLUSTERS_SQL, cluster_vectors
from weft.llm.embedding_dedup import EMBEDDING_SQL, embedding_groups
from weft.llm.exact_dedup import EXACT_SQL, exact_report
from weft.llm.hard_negatives import NEGATIVES_SQL, hard_negatives
from weft.llm.jaccard_join import JACCARD_SQL, jaccard_report
from weft.llm.line_dedup import line_report
from weft.llm.mixing import MIX_SQL, mix_report
from weft.llm.pii import pii_report
from weft.llm.sharding import shard_report
from weft.llm.substring_dedup import PASSAGES_SQL, passage_report
from weft.llm.token_counts import token_report
from weft.llm.toxicity import toxicity_report


def _over_documents(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": _over_documents(pii_report),
    "op2_exact_dedup": _over_documents(exact_report),
    "op3_embedding_dedup": lambda spark, sf_dir: embedding_groups(table(spark, sf_dir, "embeddings")),
    "op4_line_dedup": _over_documents(line_report),
    "op5_jaccard_join": _over_documents(jaccard_report),
    "op6_sharding": _over_documents(shard_report),
    "op7_token_counts": _over_documents(token_report),
    "op8_toxicity": lambda spark, sf_dir: toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_byte_bpe": _over_documents(bpe_report),
    "op10_mixing": _over_documents(mix_report),
    "op11_substring_dedup": _over_documents(passage_report),
    "op12_hard_negatives": lambda spark, sf_dir: hard_negatives(table(spark, sf_dir, "embeddings")),
    "op13_centroid_clusters": lambda spark, sf_dir: cluster_vectors(table(spark, sf_dir, "embeddings")),
}
ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": EXACT_SQL,
    "op3_embedding_dedup": EMBEDDING_SQL,
    "op5_jaccard_join": JACCARD_SQL,
    "op10_mixing": MIX_SQL,
    "op11_substring_dedup": PASSAGES_SQL,
    "op12_hard_negatives": NEGATIVES_SQL,
    "op13_centroid_clusters": CLUSTERS_SQL,
}
