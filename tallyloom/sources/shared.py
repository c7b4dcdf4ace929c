"""Tables that later steps read several times, written in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or of SparkContext.setCheckpointDir; else, of a local session, a new one, and of a cluster one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows, computed once and kept where the loss of an executor does not reach them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """The same rows, which a join deals out by key and never sends whole to every task: Spark takes what explode makes of a table for as small as the table."""
    return df.hint("merge")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The same rows by key in as many tasks as a shuffle has: rows that each become many are few and small, and Spark would put them all into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
