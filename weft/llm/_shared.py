"""What the operators share: reading tables, cutting lineage, hashing column types."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; where it names none, a temporary one if all runs on
    this machine, else an error, as executors don't see each other's folders."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return context.getCheckpointDir()


#: Whether Spark deletes a query's shuffle files as soon as it is done; the mode is taken when a DataFrame is made.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """What queries made within shuffle is deleted as soon as they are done, and not when the driver collects its garbage."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder. What was shuffled for it is
    deleted at once, since nothing reads it after the checkpoint."""
    shared_folder(df.sparkSession)
    with releasing(df.sparkSession):
        released = df.select("*")
    return released.checkpoint()


#: Ids that a broadcast may hold (about 10 MB).
BROADCAST_IDS = 200_000


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (distinct longs), which are broadcast if counted to be few."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), key, "left_semi")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder beside the checkpoints, which is deleted if what uses it fails."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield folder
    except BaseException:
        discard(spark, folder)
        raise


def written(df: DataFrame, path: str) -> DataFrame:
    """df by way of a Parquet table, of which later reads take only the columns they need. What was shuffled for it is deleted at once."""
    with releasing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
