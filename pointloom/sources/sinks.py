"""Writers. Text and Parquet are Spark's own; binary formats are encoded a view at a time and put in place by the driver."""

from __future__ import annotations

import base64
import gzip
import json
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import rasterize
from ..operators.order import with_morton
from ..ship import ship
from .binary import LAS_FORMATS, SBET, SBET_ANGLES


def _order(df: DataFrame, order: str | None, keep_unspecified: bool = True) -> list[str]:
    own = [c for c in df.columns if c not in ("pid", "view")]
    named = [c.strip() for c in order.split(",")] if order else []
    return named + ([c for c in own if c not in named] if keep_unspecified else []) if named else own


def write_null(df: DataFrame, filename: str = "", **_) -> None:
    df.write.format("noop").mode("overwrite").save()


def write_text(df: DataFrame, filename: str, format: str = "csv", order: str | None = None, keep_unspecified: bool = True, precision: int = 3, delimiter: str = ",", write_header: bool = True, quote_header: bool = True) -> None:
    """CSV (a folder of parts in row order) with rounded numbers, or GeoJSON lines."""
    names = _order(df, order, keep_unspecified)
    kinds = dict(df.dtypes)
    ordered = df.orderBy("pid") if "pid" in df.columns else df
    if format.lower() == "geojson":
        return write_geojson(df, filename, names)
    shown = [(F.format_string(f"%.{precision}f", F.col(f"`{c}`")) if kinds[c] in ("float", "double") else F.col(f"`{c}`").cast("string")).alias(c) for c in names]
    ordered.select(*shown).write.mode("overwrite").option("header", write_header).option("sep", delimiter).option("quoteAll", False).csv(filename)


def write_geojson(df: DataFrame, filename: str, attr_dims: list[str] | None = None, **_) -> None:
    """A point feature a line."""
    names = [c for c in (attr_dims or _order(df, None)) if c not in ("X", "Y", "Z")]
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(*[F.col(c).cast("double") for c in "XYZ"]).alias("coordinates")).alias("geometry"),
        (F.struct(*names) if names else F.create_map()).alias("properties"),
    )
    df.select(F.to_json(feature)).write.mode("overwrite").text(filename)


def write_parquet(df: DataFrame, filename: str, partition_by: list[str] | None = None, **_) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(filename)


def write_sorted_parquet(df: DataFrame, filename: str, **_) -> None:
    """Parquet in order of the Morton code, so that bounds on X and Y skip row groups as an octree's would."""
    coded = with_morton(df)
    coded.repartitionByRange("morton").sortWithinPartitions("morton").write.mode("overwrite").parquet(filename)


def write_ept_addon(df: DataFrame, filename: str, addons: list[str] = (), **_) -> None:
    """Extra dimensions by pid, as a table beside the points."""
    df.select("pid", *addons).write.mode("overwrite").parquet(filename)


def write_jdbc(df: DataFrame, filename: str, table: str, **options: str) -> None:
    df.write.jdbc(filename, table, properties=options)


def write_cells(df: DataFrame, filename: str, **_) -> None:
    df.write.mode("overwrite").parquet(filename)


def write_raster(df: DataFrame, filename: str, resolution: float, format: str = "parquet", nodata: float = -9999.0, **options) -> None:
    """Cells as Parquet, or one band as an ASCII grid (made by the driver; its size is checked)."""
    cells = rasterize(df, resolution, **options)
    if format == "parquet" and not filename.endswith(".asc"):
        cells.write.mode("overwrite").parquet(filename)
        return
    low = df.agg(F.min("X").alias("x"), F.min("Y").alias("y")).first()
    x0, y0 = options.get("origin") or (low.x, low.y)
    b = cells.agg(F.max("col").alias("c"), F.max("row").alias("r")).first()
    cols, rows = b.c + 1, b.r + 1
    if cols * rows > 25_000_000:
        raise ValueError("too many cells for a text grid; write Parquet")
    band = next(c for c in cells.columns if c not in ("col", "row"))
    grid = np.full((rows, cols), nodata)
    for r in cells.select("col", "row", band).toLocalIterator():
        grid[rows - 1 - r["row"], r["col"]] = r[band]
    head = f"ncols {cols}\nnrows {rows}\nxllcorner {x0}\nyllcorner {y0}\ncellsize {resolution}\nnodata_value {nodata}\n"
    _put(df, filename, (head + "\n".join(" ".join(f"{v:g}" for v in r) for r in grid) + "\n").encode())


def _put(df: DataFrame, filename: str, data: bytes) -> None:
    """Write bytes to any file system that Spark knows."""
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(filename)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()


def encode_views(df: DataFrame, encode) -> DataFrame:
    """view and content: ``encode`` (a pandas frame in row order to bytes) of each view, a task each."""
    ship(df.sparkSession)
    keyed = df.withColumn("view", F.col("view").cast("string") if "view" in df.columns else F.lit(""))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        view = f["view"].iloc[0]
        f = f.drop(columns=["view"])
        f = f.sort_values("pid") if "pid" in f else f
        return pd.DataFrame({"view": [view], "content": [encode(f.drop(columns=[c for c in ("pid",) if c in f]))]})

    return keyed.groupBy("view").applyInPandas(run, "view string, content binary")


def _write_views(df: DataFrame, filename: str, encode) -> None:
    """A file for each view: ``#`` in the name becomes the view's number, ``#uuid#`` a unique id."""
    name = filename.replace("#uuid#", uuid.uuid4().hex)
    several = "#" in name
    for k, r in enumerate(encode_views(df if several or "view" not in df.columns else df.drop("view"), encode).orderBy("view").toLocalIterator()):
        _put(df, name.replace("#", str(k + 1)) if several else name, bytes(r.content))


def encode_las(f: pd.DataFrame, format: int | None = None, scale: float = 0.01, minor: int = 4) -> bytes:
    """LAS 1.2 to 1.4; the format is the smallest that has the frame's dimensions."""
    colour, time = "Red" in f, "GpsTime" in f
    fmt = format if format is not None else (7 if colour else 6) if minor >= 4 else 2 * colour + time
    fields = LAS_FORMATS[fmt]
    p = np.zeros(len(f), np.dtype(fields))
    xyz = f[["X", "Y", "Z"]].to_numpy(float)
    shift = np.floor(xyz.min(0)) if len(f) else np.zeros(3)
    for i, c in enumerate("xyz"):
        p[c] = np.round((xyz[:, i] - shift[i]) / scale)

    def col(c: str, default: int = 0):
        return f[c].to_numpy() if c in f else np.full(len(f), default)

    r, n = col("ReturnNumber").astype(int), col("NumberOfReturns").astype(int)
    d, e = col("ScanDirectionFlag").astype(int), col("EdgeOfFlightLine").astype(int)
    if fmt < 6:
        p["bits"] = (r & 7) | (n & 7) << 3 | (d & 1) << 6 | (e & 1) << 7
        p["class"] = (col("Classification").astype(int) & 31) | (col("ClassFlags").astype(int) & 7) << 5
        p["angle"] = np.clip(np.round(col("ScanAngleRank").astype(float)), -90, 90)
    else:
        p["bits"] = (r & 15) | (n & 15) << 4
        p["flags"] = (col("ClassFlags").astype(int) & 15) | (col("ScanChannel").astype(int) & 3) << 4 | (d & 1) << 6 | (e & 1) << 7
        p["class"] = col("Classification")
        p["angle"] = np.round(col("ScanAngleRank").astype(float) / 0.006)
    for c in ("Intensity", "UserData", "PointSourceId", "GpsTime", "Red", "Green", "Blue", "Infrared"):
        if c in p.dtype.names and c in f:
            p[c] = f[c]
    size = 375 if minor >= 4 else 227
    head = bytearray(size)
    head[:4], head[24], head[25] = b"LASF", 1, minor
    head[26:58] = b"pointloom".ljust(32, b"\0")
    head[58:90] = b"pointloom".ljust(32, b"\0")
    head[94:111] = struct.pack("<HIIBHI", size, size, 0, fmt, p.dtype.itemsize, len(f) if fmt < 6 else 0)
    head[131:179] = struct.pack("<6d", scale, scale, scale, *shift)
    if len(f):
        lo, hi = xyz.min(0), xyz.max(0)
        head[179:227] = struct.pack("<6d", hi[0], lo[0], hi[1], lo[1], hi[2], lo[2])
    if minor >= 4:
        head[247:255] = struct.pack("<Q", len(f))
    return bytes(head) + p.tobytes()


def write_las(df: DataFrame, filename: str, dataformat_id: int | None = None, scale: float = 0.01, minor_version: int = 4, **_) -> None:
    _write_views(df, filename, lambda f: encode_las(f, dataformat_id, scale, minor_version))


_PLY = {"int8": "int8", "int16": "int16", "int32": "int32", "int64": "float64", "float32": "float32", "float64": "float64"}


def encode_ply(f: pd.DataFrame, storage_mode: str = "ascii", precision: int = 3, faces: list[tuple[int, int, int]] = ()) -> bytes:
    names = {"X": "x", "Y": "y", "Z": "z", "Red": "red", "Green": "green", "Blue": "blue", "NormalX": "nx", "NormalY": "ny", "NormalZ": "nz"}
    kinds = {c: _PLY.get(str(f[c].dtype), "float64") for c in f}
    head = ["ply", f"format {'ascii' if storage_mode == 'ascii' else 'binary_little_endian'} 1.0", f"element vertex {len(f)}", *[f"property {kinds[c]} {names.get(c, c)}" for c in f]]
    head += [f"element face {len(faces)}", "property list uint8 uint32 vertex_indices"] if len(faces) else []
    out = ("\n".join([*head, "end_header"]) + "\n").encode()
    if storage_mode == "ascii":
        out += "".join(" ".join(f"{v:.{precision}f}" if isinstance(v, float) else str(v) for v in row) + "\n" for row in f.itertuples(index=False)).encode()
        return out + "".join(f"3 {a} {b} {c}\n" for a, b, c in faces).encode()
    p = np.zeros(len(f), np.dtype([(c, "<" + {"int8": "i1", "int16": "i2", "int32": "i4", "float32": "f4", "float64": "f8"}[kinds[c]]) for c in f]))
    for c in f:
        p[c] = f[c]
    return out + p.tobytes() + b"".join(struct.pack("<B3I", 3, *t) for t in faces)


def write_ply(df: DataFrame, filename: str, storage_mode: str = "ascii", precision: int = 3, **_) -> None:
    _write_views(df, filename, lambda f: encode_ply(f, storage_mode, precision))


def encode_pcd(f: pd.DataFrame, compression: str = "ascii", precision: int = 2) -> bytes:
    kinds = {c: ("F", 8, "f8") if f[c].dtype.kind == "f" and f[c].dtype.itemsize == 8 else ("F", 4, "f4") if f[c].dtype.kind == "f" else ("I", f[c].dtype.itemsize, f"i{f[c].dtype.itemsize}") for c in f}
    head = ["# .PCD v0.7 - Point Cloud Data file format", "VERSION 0.7", "FIELDS " + " ".join({"X": "x", "Y": "y", "Z": "z"}.get(c, c) for c in f), "SIZE " + " ".join(str(kinds[c][1]) for c in f), "TYPE " + " ".join(kinds[c][0] for c in f), "COUNT " + " ".join("1" for _ in f), f"WIDTH {len(f)}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {len(f)}", f"DATA {'ascii' if compression == 'ascii' else 'binary'}"]
    out = ("\n".join(head) + "\n").encode()
    if compression == "ascii":
        return out + "".join(" ".join(f"{v:.{precision}f}" if isinstance(v, float) else str(v) for v in row) + "\n" for row in f.itertuples(index=False)).encode()
    p = np.zeros(len(f), np.dtype([(c, "<" + kinds[c][2]) for c in f]))
    for c in f:
        p[c] = f[c]
    return out + p.tobytes()


def write_pcd(df: DataFrame, filename: str, compression: str = "ascii", precision: int = 2, **_) -> None:
    _write_views(df, filename, lambda f: encode_pcd(f, compression, precision))


def write_sbet(df: DataFrame, filename: str, angles_are_degrees: bool = True, **_) -> None:
    def encode(f: pd.DataFrame) -> bytes:
        p = np.zeros(len(f), np.dtype([(n, "<f8") for n in SBET]))
        for n in SBET:
            if n in f:
                p[n] = np.radians(f[n]) if angles_are_degrees and n in SBET_ANGLES else f[n]
        return p.tobytes()

    _write_views(df, filename, encode)


def encode_bpf(f: pd.DataFrame) -> bytes:
    """BPF 3, a dimension after the other."""
    names = list(f)
    v = f.to_numpy(float).T
    offsets = np.array([np.floor(c.min()) if len(c) else 0.0 for c in v])
    length = 176 + 56 * len(names)
    head = struct.pack("<4s4siBBBBiiif", b"BPF!", b"0003", length, len(names), 0, 0, 0, len(f), 0, 0, 0.0)
    head += np.eye(4).astype("<f8").tobytes() + struct.pack("<dd", 0.0, 0.0)
    lows, highs = [c.min() if len(c) else 0.0 for c in v], [c.max() if len(c) else 0.0 for c in v]
    head += offsets.astype("<f8").tobytes() + np.array(lows, "<f8").tobytes() + np.array(highs, "<f8").tobytes()
    head += b"".join(n.encode()[:31].ljust(32, b"\0") for n in names)
    return head.ljust(length, b"\0") + b"".join((c - o).astype("<f4").tobytes() for c, o in zip(v, offsets, strict=True))


def write_bpf(df: DataFrame, filename: str, **_) -> None:
    _write_views(df, filename, encode_bpf)


def encode_gltf(f: pd.DataFrame, triangles: np.ndarray) -> bytes:
    """A glTF 2 document with its buffer inside."""
    xyz = f[["X", "Y", "Z"]].to_numpy("<f4")
    index = triangles.astype("<u4").ravel()
    raw = index.tobytes() + xyz.tobytes()
    lo, hi = (xyz.min(0).tolist(), xyz.max(0).tolist()) if len(xyz) else ([0.0] * 3, [0.0] * 3)
    doc = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 1}, "indices": 0, "mode": 4}]}],
        "buffers": [{"byteLength": len(raw), "uri": "data:application/octet-stream;base64," + base64.b64encode(raw).decode()}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": index.nbytes, "target": 34963}, {"buffer": 0, "byteOffset": index.nbytes, "byteLength": xyz.nbytes, "target": 34962}],
        "accessors": [{"bufferView": 0, "componentType": 5125, "count": len(index), "type": "SCALAR"}, {"bufferView": 1, "componentType": 5126, "count": len(xyz), "type": "VEC3", "min": lo, "max": hi}],
    }
    return json.dumps(doc).encode()


def write_gltf(df: DataFrame, filename: str, **_) -> None:
    """The Delaunay mesh of each view."""
    from ..operators.mesh import triangulate

    _write_views(df, filename, lambda f: encode_gltf(f, np.array(triangulate(f[["X", "Y"]].to_numpy(float)), int).reshape(-1, 3)))


def encode_spz(f: pd.DataFrame, bits: int = 12) -> bytes:
    n = len(f)
    v = np.round(f[["X", "Y", "Z"]].to_numpy(float) * (1 << bits)).astype(np.int32)
    p = np.stack([v & 255, v >> 8 & 255, v >> 16 & 255], -1).astype("u1").tobytes()
    col = lambda c, d=0.0: f[c].to_numpy(float) if c in f else np.full(n, d)
    alpha = np.clip(np.round(255 / (1 + np.exp(-col("Opacity")))), 0, 255).astype("u1").tobytes()
    colour = np.clip(np.round((np.stack([col(f"FeatureDC{i}") for i in range(3)], 1) * 0.15 + 0.5) * 255), 0, 255).astype("u1").tobytes()
    scale = np.clip(np.round((np.stack([col(f"Scale{i}") for i in range(3)], 1) + 10) * 16), 0, 255).astype("u1").tobytes()
    return gzip.compress(struct.pack("<IIIBBBB", 0x5053474E, 2, n, 0, bits, 0, 0) + p + alpha + colour + scale + b"\x80" * (3 * n), mtime=0)


def write_spz(df: DataFrame, filename: str, **_) -> None:
    _write_views(df, filename, encode_spz)


__all__ = [n for n in list(globals()) if n.startswith(("write_", "encode_"))] + ["Column"]
