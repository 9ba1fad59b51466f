"""Where tables are stored, and the scratch folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsense.functions.names import field

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only for a local session."""
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"Set {CHECKPOINT_SETTING} to a folder shared by all executors.")
    folder = tempfile.mkdtemp(prefix="gridsense-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared folder, so both later reads agree."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def store(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table, replacing what is there, and return it as read back."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def store_vectors(df: DataFrame, path: str, id_column: str, text_column: str, vector_column: str) -> DataFrame:
    """Write an index of texts and their vectors as ``(id, text, embedding)``."""
    index = df.select(
        field(id_column).alias("id"),
        field(text_column).alias("text"),
        F.col(f"`{vector_column}`").cast("array<float>").alias("embedding"),
    )
    return store(index, path)


def register(name: str, df: DataFrame) -> DataFrame:
    """Make a table known to SQL under a name."""
    df.createOrReplaceTempView(name)
    return df
