"""A corpus from documents: toxic ones out, repeated lines out, near copies out, mixed, tokenised.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as
Parquet and read again before the next. All but the last return the columns of documents.

Defined cases, of every stage: an empty table gives an empty table; null texts count as empty and stay
null until the last stage; rows with a null doc_id go if they are toxic, but lose no lines and aren't copies; further columns of documents are left out; very
long texts are read whole; of ties the least doc_id stays. Rows that repeat a doc_id are scored one by
one, lose the same lines, stay or go together as copies, and are mixed as often as the one taken most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm._shared import releasing, shared_folder, table
from weft.llm.byte_bpe import encode
from weft.llm.jaccard_join import keep_one_per_group
from weft.llm.line_dedup import drop_repeated_lines
from weft.llm.mixing import mix
from weft.llm.toxicity import score, train_by_contract

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Rows that go to Python at once, unless the session says otherwise: a batch of texts is held by the executor and by its worker.
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's own
        spark.conf.set(name, BATCH_ROWS)


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is trained on the labelled ones of its input."""
    _small_batches(spark)
    model = train_by_contract(docs, table(spark, sf_dir, "labels"))
    return _documents(score(docs, model).where("predicted = 0"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-equal lines one occurrence stays; every document stays."""
    _small_batches(spark)
    cleaned = drop_repeated_lines(docs)
    return _documents(cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 0.8 stays."""
    _small_batches(spark)
    return _documents(keep_one_per_group(docs, k=5, percent=80))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated as often as the mix takes the block of their first word; those that it
    doesn't take go, and so do documents without words."""
    taken = mix(docs, whole=True).where("taken > 0").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("__times"))
    repeated = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("__id")))
    return _documents(repeated.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    _small_batches(spark)
    coded = encode(docs.select("doc_id", "source", "lang", "text"))
    return coded.select("doc_id", "source", "lang", "n_tokens", "token_ids", "ids_sha256", "round_trip")


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", near_copies), ("mixing", mixing), ("byte-level BPE", tokens)]

#: SQL can't express the classifier, fuzzy lines or BPE; tests/llm compares the operators that the stages
#: call with brute force, and the pipeline with plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        with releasing(spark):
            kept.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:  # what the stage before wrote has been read
            used = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            used.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(used, True)
    return docs
