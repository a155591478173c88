"""Structured Streaming: the row-wise operators work on streams as they are; here are those that need state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr

#: Operators of the engine that take a streaming DataFrame unchanged.
STATELESS = ("assign", "ferry", "transformation", "range", "expression", "mongo", "crop", "geomdistance", "colorinterp", "reprojection", "projpipeline", "straighten", "returns", "splitter", "merge", "streamcallback")


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Points of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_event_time(df: DataFrame, epoch_seconds: str = "GpsTime", watermark: str = "10 minutes") -> DataFrame:
    """``event_time`` from a column of seconds, with a watermark for late rows."""
    return df.withColumn("event_time", F.timestamp_micros((F.col(epoch_seconds) * 1e6).cast("long"))).withWatermark("event_time", watermark)


def windowed_stats(df: DataFrame, dimension: str = "Z", length: str = "1 hour", slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, bounds and averages in tumbling or sliding windows of event time."""
    w = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    c = F.col(dimension)
    return df.groupBy(w.alias("window"), *by).agg(F.count("*").alias("count"), F.min(c).alias("minimum"), F.max(c).alias("maximum"), F.avg(c).alias("average"))


def sessions(df: DataFrame, key: str, gap: str = "5 minutes") -> DataFrame:
    """Runs of rows of a key without a gap."""
    return df.groupBy(F.session_window("event_time", gap).alias("session"), key).agg(F.count("*").alias("count"))


def voxel_first(df: DataFrame, cell: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """One row of each voxel within the watermark."""
    keys = {f"__k{c}": F.floor((F.col(c) - o) / cell) for c, o in zip("XYZ", origin, strict=True)}
    return df.withColumns(keys).dropDuplicatesWithinWatermark(list(keys)).drop(*keys)


def _counted(df: DataFrame, keep: Callable[[pd.Series], pd.Series], key: str) -> DataFrame:
    """Rows of a key whose running number (over all batches) passes ``keep``."""
    schema = df.schema

    def run(k, frames, state):
        n = state.get[0] if state.exists else 0
        for f in frames:
            f = f.sort_values("pid") if "pid" in f else f
            number = pd.Series(range(n, n + len(f)), index=f.index)
            n += len(f)
            yield f[keep(number)]
        state.update((n,))

    return df.groupBy(key).applyInPandasWithState(run, schema, "n long", "append", "NoTimeout")


def head(df: DataFrame, count: int, key: str) -> DataFrame:
    """The first rows of each key, counted over all batches."""
    return _counted(df, lambda n: n < count, key)


def decimation(df: DataFrame, step: int, key: str, offset: int = 0) -> DataFrame:
    """Every step-th row of each key, counted over all batches."""
    return _counted(df, lambda n: (n >= offset) & ((n - offset) % step == 0), key)


def expression_counts(df: DataFrame, expressions: list[str], dimension: str) -> DataFrame:
    """Running value counts per expression."""
    matched = F.array_compact(F.array(*[F.when(expr.condition(df, e), F.lit(e)) for e in expressions]))
    return df.select(F.explode(matched).alias("expression"), F.col(dimension).alias("value")).groupBy("expression", "value").count()


def run_batches(df: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Any operator of the engine on each micro-batch: the callback sink."""
    return df.writeStream.foreachBatch(lambda batch, i: sink(operator(batch), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
