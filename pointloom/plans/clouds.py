"""Point views of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _seconds(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column}) / 1e6")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: quantity, discount and price as place; no row order."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("X"), (F.col("l_discount") * 1000).alias("Y"), F.col("l_extendedprice").alias("Z"), F.col("l_linenumber").alias("Classification"),
        F.col("l_suppkey").alias("Intensity"), _seconds("l_shipdate").alias("GpsTime"), F.col("l_linenumber").alias("ReturnNumber"), F.lit(7).alias("NumberOfReturns"),
    )


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: user, hour and value as place; ordered by event."""
    kind = F.array_position(F.lit(list(EVENT_TYPES)), F.col("event_type")).cast("int")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("pid"), F.col("user_id").cast("double").alias("X"), F.hour("ts").cast("double").alias("Y"), F.col("value").alias("Z"), kind.alias("Classification"), _seconds("ts").alias("GpsTime"))


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: the first three components as place."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("XYZ")], F.col("label").alias("Classification"))


LINE = """(SELECT l_quantity AS X, l_discount * 1000 AS Y, l_extendedprice AS Z, l_linenumber AS Classification, l_suppkey AS Intensity, epoch(l_shipdate) AS GpsTime, l_linenumber AS ReturnNumber, 7 AS NumberOfReturns FROM lineitem)"""
EVENT = """(SELECT event_id AS pid, user_id::DOUBLE AS X, hour(ts)::DOUBLE AS Y, value AS Z, list_position(['click','error','purchase','signup','view'], event_type)::INTEGER AS Classification, epoch(ts) AS GpsTime FROM events)"""
VECTOR = """(SELECT vec_id AS pid, embedding[1]::DOUBLE AS X, embedding[2]::DOUBLE AS Y, embedding[3]::DOUBLE AS Z, label AS Classification FROM embeddings)"""
