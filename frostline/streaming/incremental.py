"""Streaming forms of two batch operators, over a stream of interactions; not part of the batch surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def running_degrees(events: DataFrame, entity: str = "user_id") -> DataFrame:
    """Interactions so far of each entity; for the output modes update and complete."""
    return events.groupBy(entity).agg(F.count("*").alias("degree"))


def first_seen_pairs(events: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each (user, item) once within the time that late rows may take."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).dropDuplicatesWithinWatermark(["user_id", "item_id"])
