"""Evidence that accumulates as observations arrive: a Structured Streaming extension.

Each observation of an entity adds its score to the mass for and the rest to the
mass against; the masses add up, so the aggregate merges in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def evidence(observations: DataFrame) -> DataFrame:
    """``entity, support, against, n, belief``: the Beta mean of an entity's observations, batch or stream."""
    mass = observations.groupBy("entity").agg(F.sum("score").alias("support"), F.sum(1 - F.col("score")).alias("against"), F.count(F.lit(1)).alias("n"))
    return mass.withColumn("belief", (F.col("support") + 1) / (F.col("support") + F.col("against") + 2))


def windowed(observations: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Evidence by entity and event-time window; rows later than the watermark are dropped."""
    kept = observations.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", width), "entity").agg(F.sum("score").alias("support"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "entity", "support", "n")


def run_once(spark: SparkSession, source: str, schema: str, name: str, checkpoint: str, pattern: str = "events*.parquet") -> DataFrame:
    """Drive the accumulator over all files of a folder and return its table."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)
    seen = stream.select(F.col("user_id").alias("entity"), F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("score"))
    query = evidence(seen).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
