"""Applications over whole clouds: comparison, evaluation, tiling, indexing, translation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators import aggregate, neighbors, order, partition, select, terrain
from ..schema import round_away
from . import pipeline


def _nearest(source: DataFrame, candidate: DataFrame) -> DataFrame:
    return neighbors.knn(source, candidate, 1)


def chamfer(source: DataFrame, candidate: DataFrame) -> DataFrame:
    """The sum of squared nearest distances, both ways."""
    both = _nearest(source, candidate).unionByName(_nearest(candidate, source))
    return both.agg(F.sum("d2").alias("chamfer"))


def hausdorff(source: DataFrame, candidate: DataFrame) -> DataFrame:
    """The larger of the directed largest nearest distances, and of the directed means (modified)."""
    there = _nearest(source, candidate).agg(F.sqrt(F.max("d2")).alias("a"), F.avg(F.sqrt("d2")).alias("m"))
    back = _nearest(candidate, source).agg(F.sqrt(F.max("d2")).alias("b"), F.avg(F.sqrt("d2")).alias("n"))
    return there.crossJoin(F.broadcast(back)).select(F.greatest("a", "b").alias("hausdorff"), F.greatest("m", "n").alias("modified"))  # a row each


def delta(source: DataFrame, candidate: DataFrame, detail: bool = False, dimensions: tuple[str, ...] = ("X", "Y", "Z")) -> DataFrame:
    """Each dimension less that of the nearest candidate: rows, or least, greatest and mean."""
    near = neighbors.knn(source, candidate, 1, keep=tuple(dimensions)).join(source.select("pid", *dimensions), "pid")
    rows = near.select("pid", *[(F.col(f"n_{d}") - F.col(d)).alias(d) for d in dimensions])
    if detail:
        return rows
    return rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("v")) for d in dimensions])).alias("x")).groupBy("x.dimension").agg(F.min("x.v").alias("min"), F.max("x.v").alias("max"), F.avg("x.v").alias("mean"))


def evaluate(predicted: DataFrame, truth: DataFrame, labels: list[int], prediction_dim: str = "Classification", truth_dim: str = "Classification") -> tuple[DataFrame, DataFrame]:
    """A row per label (support, intersection over union, F1, sensitivity, specificity, precision, accuracy) and one of means.

    Each predicted row is judged by the truth nearest to it; labels not listed share one more; 0 / 0 is 0.
    """
    known = F.lit(labels)
    label = lambda c: F.when(F.array_contains(known, round_away(c.cast("double")).cast("int")), round_away(c.cast("double")).cast("int"))
    near = neighbors.knn(predicted, truth.withColumn("__t", F.col(truth_dim)), 1, keep=("__t",)).join(predicted.select("pid", F.col(prediction_dim).alias("__p")), "pid")
    counts = near.groupBy(label(F.col("n___t")).alias("t"), label(F.col("__p")).alias("p")).agg(F.count("*").alias("n"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    names = predicted.sparkSession.createDataFrame([(x,) for x in [*labels, None]], "label int")
    pick = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("double")
    t_is, p_is = F.col("t").eqNullSafe(F.col("label")), F.col("p").eqNullSafe(F.col("label"))
    # a row per label and cell of the confusion matrix: (labels + 1) cubed at most
    rows = F.broadcast(names).crossJoin(counts).groupBy("label").agg(pick(t_is & p_is).alias("tp"), pick(~t_is & p_is).alias("fp"), pick(t_is & ~p_is).alias("fn"), pick(~t_is & ~p_is).alias("tn"))
    c = F.col
    iou = ratio(c("tp"), c("tp") + c("fp") + c("fn"))
    per = rows.select("label", (c("tp") + c("fn")).cast("long").alias("support"), iou.alias("iou"), (2 * iou / (1 + iou)).alias("f1"), ratio(c("tp"), c("tp") + c("fn")).alias("sensitivity"), ratio(c("tn"), c("tn") + c("fp")).alias("specificity"), ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")).alias("accuracy"), "tp")
    overall = per.agg(F.avg(F.when(c("label").isNotNull(), c("iou"))).alias("mean_iou"), ratio(F.sum("tp"), F.sum("support")).alias("overall_accuracy"))
    return per.where("label IS NOT NULL").drop("tp"), overall


def ground(df: DataFrame, reset: bool = True, denoise: bool = True, extract: bool = False, **smrf) -> DataFrame:
    """Reset classes, label outliers, classify ground, and keep the ground alone if asked."""
    if reset:
        df = df.withColumn("Classification", F.lit(0))
    if denoise:
        df = neighbors.outlier(df)
        smrf.setdefault("ignore", "Classification[7:7]")
    out = terrain.smrf(df, **smrf)
    return select.range_filter(out, "Classification[2:2]") if extract else out


def density(df: DataFrame, **options) -> DataFrame:
    return aggregate.hexbin(df, **options)


def info(df: DataFrame) -> dict[str, DataFrame]:
    """Summary, statistics and schema."""
    schema = df.sparkSession.createDataFrame(df.dtypes, "name string, type string")
    return {"summary": aggregate.info(df), "stats": aggregate.stats(df), "schema": schema}


def stac_item(df: DataFrame, name: str) -> dict:
    """A catalogue item of a cloud: its box, count and statistics."""
    s = aggregate.info(df).first()
    box = [s.minx, s.miny, s.minz, s.maxx, s.maxy, s.maxz]
    ring = [[s.minx, s.miny], [s.maxx, s.miny], [s.maxx, s.maxy], [s.minx, s.maxy], [s.minx, s.miny]]
    statistics = [r.asDict() for r in aggregate.stats(df).collect()]
    return {"type": "Feature", "stac_version": "1.0.0", "id": name, "bbox": box, "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"pc:count": s["count"], "pc:type": "lidar", "pc:statistics": statistics}, "assets": {}, "links": []}


def translate(spark: SparkSession, source: str, target: str, filters: list[str | dict] = (), **options) -> pipeline.Result:
    """A file through filters into another."""
    stages = [{"type": f"filters.{f.removeprefix('filters.')}"} if isinstance(f, str) else f for f in filters]
    return pipeline.run(spark, [source, *stages, {"filename": target, "type": sources.driver_of(target, "writers"), **options}])


def merge(spark: SparkSession, files: list[str], target: str) -> pipeline.Result:
    return pipeline.run(spark, [*[{"filename": f, "type": sources.driver_of(f, "readers")} for f in files], {"type": "filters.merge"}, target])


def sort(df: DataFrame) -> DataFrame:
    return order.mortonorder(df)


def split(df: DataFrame, target: str, length: float | None = None, capacity: int | None = None, **options) -> None:
    """A folder for each tile, or for each chip."""
    if length:
        partition.splitter(df, length, **options).write.mode("overwrite").partitionBy("tile_x", "tile_y").parquet(target)
    else:
        partition.chipper(df, capacity or 100_000).write.mode("overwrite").partitionBy("view").parquet(target)


def tile(spark: SparkSession, path: str | list[str], target: str, driver: str = "readers.arrow", length: float = 1000.0, buffer: float = 0.0, origin: tuple[float, float] = (0.0, 0.0)) -> None:
    """Many files into tiles of one origin: rows are dealt by tile, so each tile has one file a task."""
    tiled = partition.splitter(sources.READERS[driver](spark, path), length, *origin, buffer=buffer)
    tiled.repartition("tile_x", "tile_y").write.mode("overwrite").partitionBy("tile_x", "tile_y").parquet(target)


def tindex(spark: SparkSession, path: str | list[str], driver: str = "readers.arrow") -> DataFrame:
    return sources.catalogs.tindex_create(spark, path, driver)


def random(spark: SparkSession, target: str, count: int, bounds: str, distribution: str = "uniform", **options) -> None:
    mode = {"uniform": "uniform", "random": "uniform", "normal": "normal"}[distribution]
    sources.write(sources.synthetic.faux(spark, mode, count, bounds, **options), target)


KERNELS = {"chamfer": chamfer, "delta": delta, "density": density, "eval": evaluate, "ground": ground, "hausdorff": hausdorff, "info": info, "merge": merge, "pipeline": pipeline.run, "random": random, "sort": sort, "split": split, "tile": tile, "tindex": tindex, "translate": translate}
