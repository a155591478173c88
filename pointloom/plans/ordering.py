"""Global row order without a single task: ranks, running sums and previous rows.

Row order is a column (``pid``, or any columns). Up to ``SINGLE_TASK_ROWS`` rows
(counted) a plain window is used. Beyond it, rows are range-partitioned and
sorted, numbered inside partitions, written, and shifted by the sizes of the partitions
before; running sums and neighbours then work on blocks of ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

SINGLE_TASK_ROWS = 1_000_000
BLOCK = 1_000_000


def views(df: DataFrame) -> list[str]:
    return ["view"] if "view" in df.columns else []


def with_rank(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """``df`` with the 0-based place of each row in ``order``, inside its view."""
    order = order or ("pid",)
    if views(df) or df.count() <= SINGLE_TASK_ROWS:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*views(df)).orderBy(*order)) - 1).cast("long"))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    joined = placed.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(starts), "__part")
    return joined.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__at", "__start")


def running_sum(df: DataFrame, value: Column, name: str, rank: str = "rank", inclusive: bool = True) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to each (or before it), by rank inside the view."""
    end = 0 if inclusive else -1
    blocked = df.withColumn("__v", value).withColumn("__block", F.floor(F.col(rank) / BLOCK))
    inside = F.coalesce(F.sum("__v").over(Window.partitionBy(*views(df), "__block").orderBy(rank).rowsBetween(Window.unboundedPreceding, end)), F.lit(0))
    totals = blocked.groupBy(*views(df), "__block").agg(F.sum("__v").alias("__total"))
    before = Window.partitionBy(*views(df)).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    return blocked.withColumn("__inside", inside).join(totals, [*views(df), "__block"]).withColumn(name, F.col("__inside") + F.col("__before")).drop("__v", "__block", "__inside", "__before")


def previous(df: DataFrame, columns: list[str], rank: str = "rank", prefix: str = "prev_") -> DataFrame:
    """``df`` with the values of the row before each, by rank inside the view: blocks get the last row of the block before."""
    blocked = df.withColumn("__block", F.floor(F.col(rank) / BLOCK)).withColumn("__halo", F.lit(False))
    halo = df.where((F.col(rank) + 1) % BLOCK == 0).withColumn("__block", F.floor(F.col(rank) / BLOCK) + 1).withColumn("__halo", F.lit(True))
    w = Window.partitionBy(*views(df), "__block").orderBy(rank)
    both = blocked.unionByName(halo)
    for c in columns:
        both = both.withColumn(prefix + c, F.lag(f"`{c}`").over(w))
    return both.where(~F.col("__halo")).drop("__block", "__halo")
