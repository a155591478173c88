"""Helpers shared by the corpus operators: table access, scratch tables, Arrow loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..ship import ship

#: Rows that a function gets at once. Spark bounds its Arrow batches by rows and bytes (64 MB unless the session says
#: otherwise); a worker holds one of them, and what is derived from so many of its texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where a session on one machine (tests) has no such setting, a folder of
    this process is made and set; on a cluster that is an error.
    """
    return scratch.scratch_dir(spark)


#: Bytes of a file that ``materialize`` aims at: small tables become few files, whatever the number of tasks that made them.
FILE_BYTES = 32 << 20


def store(df: DataFrame, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as it is partitioned to a scratch table and read it back: cuts the lineage, survives lost executors."""
    path = path or scratch_dir(df.sparkSession)
    df.write.option("compression", codec).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, path: str | None = None, sort: tuple[str, ...] = ()) -> DataFrame:
    """``store``, in files of about ``FILE_BYTES``: the rows are made at full width and held on executors' disks while they are counted and written."""
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        held.count()
        size = int(held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        few = held.coalesce(max(1, -(-size // FILE_BYTES)))
        return store(few.sortWithinPartitions(*sort) if sort else few, path)
    finally:
        held.unpersist()


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns of any name cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def texts_of(column: pa.Array) -> pa.Array:
    """A string column with nulls as empty texts."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int | None = None) -> DataFrame:
    """``mapInArrow``, the function getting at most ``rows`` (``BATCH_ROWS``) rows at once; the session's settings stay as they are."""
    ship(df.sparkSession)
    most = rows or BATCH_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.slice(at, most) for b in batches for at in range(0, b.num_rows, most))

    return df.mapInArrow(run, schema)


def rows_batch(names: list[str], columns: list, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
