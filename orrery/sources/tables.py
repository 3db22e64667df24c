"""Tables that a plan settles on: written once, read by all that follows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` where it is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def settled(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that plans over it stay small and survive lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/orrery/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """``df`` for the right side of a join that shuffles both sides.

    Spark guesses the size of rows that were exploded or counted from the file they come from, and of
    repeated values from how small they are on disk, so it would broadcast tables that the driver cannot hold.
    """
    return df.hint("merge")


def tasks(spark: SparkSession) -> int:
    """Partitions for rows that grow after they are dealt, which the size of a shuffle does not tell."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
