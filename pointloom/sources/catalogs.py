"""Readers that choose files by a catalogue, so that only what is asked for is read."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geometry import parse_bounds
from ..operators.select import crop


def tindex_create(spark: SparkSession, path: str | list[str], driver: str = "readers.arrow", **options) -> DataFrame:
    """location and bounds of every file: one aggregate over all of them."""
    from . import READERS

    df = READERS[driver](spark, path, **options).withColumn("location", F.input_file_name())
    return df.groupBy("location").agg(F.min("X").alias("minx"), F.max("X").alias("maxx"), F.min("Y").alias("miny"), F.max("Y").alias("maxy"), F.count("*").alias("count"))


def read_tindex(spark: SparkSession, index: str | DataFrame, bounds: str | None = None, where: str | None = None, driver: str = "readers.arrow", **options) -> DataFrame:
    """The points of the files whose boxes meet the bounds, cropped to them. The chosen paths come to the driver, as any file listing does."""
    from . import READERS

    table = index if isinstance(index, DataFrame) else spark.read.parquet(index)
    chosen = table.where(where) if where else table
    if bounds:
        (x0, x1), (y0, y1) = parse_bounds(bounds)[:2]
        chosen = chosen.where((F.col("maxx") >= x0) & (F.col("minx") <= x1) & (F.col("maxy") >= y0) & (F.col("miny") <= y1))
    paths = [r.location for r in chosen.select("location").orderBy("location").toLocalIterator()]
    if not paths:
        raise ValueError("no file meets the bounds")
    df = READERS[driver](spark, paths, **options)
    return crop(df, bounds) if bounds else df


def read_stac(spark: SparkSession, path: str, items: list[str] | None = None, bounds: str | None = None, date_ranges: list[tuple[str, str]] | None = None, properties: dict | None = None, asset_names: tuple[str, ...] = ("data",), driver: str | None = None, **options) -> DataFrame:
    """The points of a catalogue's items: features (an item collection, or items a file each) filtered by id, box, date and properties."""
    from . import READERS, driver_of

    docs = [json.loads(r.value) for r in spark.read.text(path, wholetext=True).toLocalIterator()]
    features = [f for d in docs for f in (d["features"] if d.get("type") == "FeatureCollection" else [d])]
    if bounds:
        (x0, x1), (y0, y1) = parse_bounds(bounds)[:2]

    def wanted(f: dict) -> bool:
        p, b = f.get("properties", {}), f.get("bbox")
        if items and f.get("id") not in items:
            return False
        if bounds and b:
            h = len(b) // 2
            if b[h] < x0 or b[0] > x1 or b[h + 1] < y0 or b[1] > y1:
                return False
        if date_ranges and not any(a <= p.get("datetime", "") <= z for a, z in date_ranges):
            return False
        return all(p.get(k) in (v if isinstance(v, list) else [v]) for k, v in (properties or {}).items())

    paths = [f["assets"][a]["href"] for f in features if wanted(f) for a in asset_names if a in f.get("assets", {})]
    if not paths:
        raise ValueError("no item is left")
    return READERS[driver or driver_of(paths[0], "readers")](spark, paths, **options)


_EPT = {"signed": "i", "unsigned": "u", "float": "f"}


def read_ept(spark: SparkSession, path: str, bounds: str | None = None, resolution: float | None = None, **_) -> DataFrame:
    """An octree of binary tiles: the hierarchy chooses the nodes whose boxes meet the bounds, down to the resolution."""
    root = path.removesuffix("ept.json").rstrip("/")
    text = lambda p: json.loads("\n".join(r.value for r in spark.read.text(p, wholetext=True).collect()))
    info = text(f"{root}/ept.json")
    if info["dataType"] not in ("binary", "zstandard"):
        raise NotImplementedError("compressed tiles need a codec that is not available")
    box = info["bounds"]
    span = box[3] - box[0]
    want = parse_bounds(bounds) if bounds else None
    deepest = None if resolution is None else max(0, int(np.ceil(np.log2(span / info["span"] / resolution))))
    nodes, todo = [], [(0, 0, 0, 0)]
    known = text(f"{root}/ept-hierarchy/0-0-0-0.json")
    while todo:
        d, x, y, z = todo.pop()
        key = f"{d}-{x}-{y}-{z}"
        if known.get(key) == -1:
            known |= text(f"{root}/ept-hierarchy/{key}.json")
        if known.get(key, 0) <= 0 or deepest is not None and d > deepest:
            continue
        size = span / 2**d
        low = [box[i] + v * size for i, v in enumerate((x, y, z))]
        if want and any(low[i] > hi or low[i] + size < lo for i, (lo, hi) in enumerate(want)):
            continue
        nodes.append(key)
        todo += [(d + 1, 2 * x + i, 2 * y + j, 2 * z + k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    kind = np.dtype([(s["name"], f"<{_EPT[s['type']]}{s['size']}") for s in info["schema"]])
    scaled = {s["name"]: (s.get("scale", 1.0), s.get("offset", 0.0)) for s in info["schema"] if "scale" in s}
    packed = info["dataType"] == "zstandard"

    def decode(data: bytes) -> pd.DataFrame:
        if packed:
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        p = np.frombuffer(data, kind)
        f = pd.DataFrame({n: (p[n] * scaled[n][0] + scaled[n][1] if n in scaled else p[n]).astype(float) for n in kind.names})
        f.insert(0, "pid", np.arange(len(f)))
        return f

    from .text import _whole

    files = [f"{root}/ept-data/{n}.{'zst' if packed else 'bin'}" for n in nodes]
    df = _whole(spark, files, decode, "pid long, " + ", ".join(f"`{n}` double" for n in kind.names))
    return crop(df, bounds) if bounds else df


def read_jdbc(spark: SparkSession, connection: str, table: str, where: str | None = None, **options: str) -> DataFrame:
    """Rows of a database table; the condition is pushed down by Spark."""
    df = spark.read.jdbc(connection, table, properties=options)
    return df.where(where) if where else df
