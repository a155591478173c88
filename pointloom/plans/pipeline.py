"""Pipelines in JSON: readers, filters and writers wired into one lazy DataFrame.

A pipeline is a list, or an object with a list under ``pipeline``. An element is a file name or an
object with ``type``, ``filename``, ``tag``, ``inputs`` and options. Files before the end
are readers, a file at the end is a writer. Readers pile up; any other stage takes all that is
pending, unless ``inputs`` names tags. ``where`` routes rows around a filter, and
``where_merge`` says whether the others come back.
"""

from __future__ import annotations

import glob
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import expr
from ..operators import aggregate, cluster, mesh, neighbors, order, partition, pointwise, select, terrain, udf, voxel
from ..schema import standard_name

#: Filters by stage name, and the names that JSON gives to options which differ from ours.
FILTERS: dict[str, tuple[Callable, dict[str, str]]] = {
    "approximatecoplanar": (neighbors.approximatecoplanar, {"knn": "knn_"}), "assign": (pointwise.assign, {}), "chipper": (partition.chipper, {}), "cluster": (cluster.cluster, {}),
    "colorinterp": (pointwise.colorinterp, {}), "covariancefeatures": (neighbors.covariancefeatures, {"knn": "knn_"}), "crop": (select.crop, {}), "csf": (terrain.csf, {}), "dbscan": (cluster.dbscan, {}),
    "decimation": (select.decimation, {}), "divider": (partition.divider, {}), "eigenvalues": (neighbors.eigenvalues, {"knn": "knn_"}), "elm": (terrain.elm, {"class": "class_"}),
    "estimaterank": (neighbors.estimaterank, {"knn": "knn_"}), "expression": (select.expression, {}), "ferry": (pointwise.ferry, {}), "fps": (voxel.fps, {}), "geomdistance": (select.geomdistance, {"geometry": "geometry_text"}),
    "gpstimeconvert": (pointwise.gpstimeconvert, {}), "gridDecimation": (aggregate.grid_decimation, {}), "groupby": (partition.groupby, {}), "hag_delaunay": (terrain.hag_delaunay, {"class": "class_"}), "hag_nn": (neighbors.hag_nn, {"class": "class_"}),
    "head": (select.head, {}), "iqr": (select.iqr, {}), "label_duplicates": (order.label_duplicates, {}), "litree": (cluster.litree, {}), "lloydkmeans": (cluster.lloydkmeans, {}), "locate": (select.locate, {}), "lof": (neighbors.lof, {}),
    "mad": (select.mad, {}), "miniball": (neighbors.miniball, {"knn": "knn_"}), "mongo": (select.mongo_filter, {}), "mortonorder": (order.mortonorder, {}), "neighborclassifier": (neighbors.neighborclassifier, {}), "nndistance": (neighbors.nndistance, {}),
    "normal": (neighbors.normal, {"knn": "knn_"}), "optimalneighborhood": (neighbors.optimalneighborhood, {}), "outlier": (neighbors.outlier, {"class": "class_"}), "overlay": (select.overlay, {}), "planefit": (neighbors.planefit, {"knn": "knn_"}),
    "pmf": (terrain.pmf, {}), "projpipeline": (pointwise.projpipeline, {}), "radialdensity": (neighbors.radialdensity, {}), "radiusassign": (neighbors.radiusassign, {}), "randomize": (order.randomize, {}), "range": (select.range_filter, {}),
    "reciprocity": (neighbors.reciprocity, {"knn": "knn_"}), "relaxationdartthrowing": (voxel.relaxationdartthrowing, {}), "reprojection": (pointwise.reprojection, {}), "returns": (partition.returns, {}), "sample": (voxel.sample, {}),
    "separatescanline": (partition.separatescanline, {}), "skewnessbalancing": (terrain.skewnessbalancing, {}), "smrf": (terrain.smrf, {}), "sort": (order.sort, {}), "sparsesurface": (terrain.sparsesurface, {}), "splitter": (partition.splitter, {}),
    "straighten": (pointwise.straighten, {}), "streamcallback": (select.streamcallback, {}), "supervoxel": (cluster.supervoxel, {"knn": "knn_"}), "tail": (select.tail, {}), "trajectory": (terrain.trajectory, {}), "transformation": (pointwise.transformation, {}),
    "voxelcenternearestneighbor": (voxel.voxelcenternearestneighbor, {}), "voxelcentroidnearestneighbor": (voxel.voxelcentroidnearestneighbor, {}), "voxeldownsize": (voxel.voxeldownsize, {}), "zsmooth": (neighbors.zsmooth, {}),
    "colorization": (pointwise.colorization, {}), "dem": (select.dem, {}), "hag_dem": (terrain.hag_dem, {"class": "class_"}), "georeference": (pointwise.georeference, {}), "h3": (udf.h3, {}), "python": (udf.python, {}),
}
#: Filters that leave the rows as they are and add an answer to the pipeline's metadata.
REPORTS: dict[str, Callable[..., DataFrame]] = {"stats": aggregate.stats, "info": aggregate.info, "expressionstats": aggregate.expressionstats, "hexbin": aggregate.hexbin, "delaunay": mesh.delaunay, "greedyprojection": mesh.greedyprojection}
#: Filters whose libraries are not available, or that run foreign code.
UNAVAILABLE = {n: "its library is not available" for n in ("teaser", "poisson", "matlab", "julia")} | {"shell": "running commands is left to the caller"}
#: Filters of several inputs, or of none of their own.
SEVERAL = ("merge", "icp", "m3c2", "cpd", "faceraster")
SAME_ROWS = {"assign", "ferry", "colorinterp", "transformation", "outlier", "elm", "smrf", "pmf", "csf", "label_duplicates", "normal", "nndistance", "radialdensity", "hag_nn", "cluster", "dbscan"}


class PipelineError(ValueError):
    pass


@dataclass
class Result:
    """The last stage's points, reports by stage, and what was written."""

    points: DataFrame | None = None
    reports: dict[str, DataFrame] = field(default_factory=dict)
    written: list[str] = field(default_factory=list)


def parse(text: str | list | dict) -> list[dict]:
    doc = json.loads(text) if isinstance(text, str) else text
    stages = doc.get("pipeline") if isinstance(doc, dict) else doc
    if not isinstance(stages, list) or not stages:
        raise PipelineError("a pipeline is a list of stages")
    out = []
    for i, s in enumerate(stages):
        s = {"filename": s} if isinstance(s, str) else dict(s)
        if "type" not in s:
            if "filename" not in s:
                raise PipelineError(f"stage {i} has neither type nor filename")
            last = i == len(stages) - 1 and i > 0
            s["type"] = sources.driver_of(s["filename"], "writers" if last else "readers")
        kind = s["type"].partition(".")[0]
        if kind not in ("readers", "filters", "writers"):
            raise PipelineError(f"unknown stage type {s['type']!r}")
        out.append(s)
    tags = [s["tag"] for s in out if "tag" in s]
    if len(set(tags)) < len(tags):
        raise PipelineError("a tag is used twice")
    return out


def validate(text: str | list | dict) -> list[str]:
    """The stage names, or an error for what cannot run."""
    stages = parse(text)
    if not stages[0]["type"].startswith("readers."):
        raise PipelineError("the first stage is a reader")
    for s in stages:
        kind, _, name = s["type"].partition(".")
        if kind == "filters" and name not in FILTERS and name not in REPORTS and name not in SEVERAL:
            raise PipelineError(f"{s['type']}: {UNAVAILABLE.get(name, 'unknown')}")
        if kind != "filters" and s["type"] not in sources.READERS and s["type"] not in sources.WRITERS:
            raise PipelineError(f"{s['type']}: {sources.UNAVAILABLE.get(s['type'], 'unknown')}")
    return [s["type"] for s in stages]


def run_filter(df: DataFrame, name: str, options: dict, where: str | None = None, where_merge: str = "auto") -> DataFrame:
    """One filter, with rows that do not meet ``where`` left out of it."""
    if name == "merge":
        return df.drop("view")
    fn, renames = FILTERS[name]
    known = {renames.get(k, k): v for k, v in options.items()}
    if where is None:
        return fn(df, **known)
    c = F.coalesce(expr.condition(df, where), F.lit(False))  # a null condition is not met
    done = fn(df.where(c), **known)
    back = where_merge is True or str(where_merge).lower() == "true" or (str(where_merge).lower() == "auto" and name in SAME_ROWS)
    rest = df.where(~c)
    if not back:
        rest = rest.withColumn("view", F.lit(-1)) if "view" in done.columns else rest
    return done.unionByName(rest, allowMissingColumns=True)


def run(spark: SparkSession, text: str | list | dict, tables: dict[str, DataFrame] | None = None) -> Result:
    """Build the pipeline and run its writers. ``tables`` are DataFrames that options may name by ``@name``."""
    tables = tables or {}
    pending: list[DataFrame] = []
    tagged: dict[str, DataFrame] = {}
    result = Result()
    for s in parse(text):
        s = dict(s)
        kind, _, name = s.pop("type").partition(".")
        tag, inputs = s.pop("tag", None), s.pop("inputs", None)
        options = {k: tables[v[1:]] if isinstance(v, str) and v.startswith("@") and v[1:] in tables else v for k, v in s.items()}
        if kind == "readers":
            filename = options.pop("filename", None)
            if isinstance(filename, str) and any(c in filename for c in "*?[") and "://" not in filename:
                filename = sorted(glob.glob(filename)) or filename
            df = sources.read(spark, filename, f"readers.{name}", **options)
            pending.append(df)
        else:
            if inputs:
                taken = [tagged[t] for t in ([inputs] if isinstance(inputs, str) else inputs)]
            else:
                taken, pending = pending, []
            if not taken:
                raise PipelineError(f"{kind}.{name} has no input")
            df = taken[0] if len(taken) == 1 else partition.merge(*taken)
            if kind == "filters":
                if name in REPORTS:
                    result.reports[tag or name] = REPORTS[name](df, **options)
                elif name == "faceraster":  # of the last mesh made, else of a Delaunay mesh
                    made = [v for v in result.reports.values() if {"a", "b", "c", "tri_id"} <= set(v.columns)]
                    result.reports[tag or name] = mesh.faceraster(df, made[-1] if made else mesh.delaunay(df), **options)
                elif name in ("icp", "cpd"):
                    if len(taken) != 2:
                        raise PipelineError(f"filters.{name} takes a fixed and a moving input")
                    df, found = getattr(cluster, name)(taken[0], taken[1], **options)
                    result.reports[tag or name] = spark.createDataFrame([(found["transform"],)], "transform array<double>")
                elif name == "m3c2":
                    df = neighbors.m3c2(*taken[:3], **options)
                else:
                    if name not in FILTERS and name not in SEVERAL:
                        raise PipelineError(f"filters.{name}: {UNAVAILABLE.get(name, 'unknown')}")
                    df = run_filter(df, name, options, options.pop("where", None), options.pop("where_merge", "auto"))
            else:
                where = options.pop("where", None)
                filename = options.pop("filename", "")
                sources.write(df if where is None else df.where(expr.condition(df, where)), filename, f"writers.{name}", **options)
                result.written.append(filename)
            pending.append(df)
        if tag:
            tagged[tag] = df
    result.points = pending[-1] if len(pending) == 1 else partition.merge(*pending)
    return result


__all__ = ["FILTERS", "PipelineError", "REPORTS", "Result", "parse", "run", "run_filter", "standard_name", "validate"]
