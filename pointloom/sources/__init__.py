"""Readers and writers. ``read`` and ``write`` choose a driver by name or by file extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import binary, catalogs, sinks, synthetic, text

READERS = {
    "readers.text": text.read_text, "readers.pts": text.read_pts, "readers.ptx": text.read_ptx, "readers.obj": text.read_obj, "readers.ilvis2": text.read_ilvis2,
    "readers.gdal": text.read_ascii_grid, "readers.arrow": text.read_parquet, "readers.faux": synthetic.faux, "readers.buffer": synthetic.buffer, "readers.memoryview": synthetic.memoryview_,
    "readers.las": binary.read_las, "readers.ply": binary.read_ply, "readers.pcd": binary.read_pcd, "readers.sbet": binary.read_sbet, "readers.smrmsg": binary.read_smrmsg,
    "readers.qfit": binary.read_qfit, "readers.terrasolid": binary.read_terrasolid, "readers.optech": binary.read_optech, "readers.bpf": binary.read_bpf, "readers.spz": binary.read_spz,
    "readers.tindex": catalogs.read_tindex, "readers.stac": catalogs.read_stac, "readers.ept": catalogs.read_ept, "readers.pgpointcloud": catalogs.read_jdbc,
}
WRITERS = {
    "writers.text": sinks.write_text, "writers.null": sinks.write_null, "writers.arrow": sinks.write_parquet, "writers.gdal": sinks.write_raster, "writers.raster": sinks.write_cells, "writers.ogr": sinks.write_geojson,
    "writers.las": sinks.write_las, "writers.ply": sinks.write_ply, "writers.pcd": sinks.write_pcd, "writers.sbet": sinks.write_sbet, "writers.bpf": sinks.write_bpf, "writers.gltf": sinks.write_gltf, "writers.spz": sinks.write_spz,
    "writers.ept_addon": sinks.write_ept_addon, "writers.copc": sinks.write_sorted_parquet, "writers.pgpointcloud": sinks.write_jdbc,
}
#: Drivers that need codecs or services which are not part of Spark or Python.
UNAVAILABLE = {n: "its codec or service library is not available" for n in ("readers.copc", "readers.draco", "readers.e57", "readers.fbi", "readers.hdf", "readers.i3s", "readers.icebridge", "readers.matlab", "readers.mbio", "readers.nitf", "readers.osg", "readers.rdb", "readers.rxp", "readers.slpk", "readers.tiledb", "writers.draco", "writers.e57", "writers.fbi", "writers.matlab", "writers.nitf", "writers.tiledb")}

EXTENSIONS = {
    "txt": "text", "csv": "text", "xyz": "text", "pts": "pts", "ptx": "ptx", "obj": "obj", "asc": "gdal", "parquet": "arrow", "las": "las", "ply": "ply", "pcd": "pcd", "sbet": "sbet",
    "smrmsg": "smrmsg", "qi": "qfit", "bin": "terrasolid", "csd": "optech", "bpf": "bpf", "spz": "spz", "json": "stac", "geojson": "ogr", "gltf": "gltf", "glb": "gltf",
}


def driver_of(filename: str, kind: str) -> str:
    name = filename.rpartition(".")[2].lower()
    if name not in EXTENSIONS:
        raise ValueError(f"no driver for {filename!r}")
    return f"{kind}.{EXTENSIONS[name]}"


def _find(table: dict, name: str):
    if name in UNAVAILABLE:
        raise NotImplementedError(f"{name}: {UNAVAILABLE[name]}")
    if name not in table:
        raise ValueError(f"unknown driver {name!r}")
    return table[name]


def read(spark: SparkSession, filename: str | None = None, driver: str | None = None, count: int | None = None, **options) -> DataFrame:
    """Points with their order in ``pid``."""
    name = driver or driver_of(filename, "readers")
    df = _find(READERS, name)(spark, filename, **options) if filename is not None else _find(READERS, name)(spark, **options)
    return df.orderBy("pid").limit(count) if count is not None else df


def write(df: DataFrame, filename: str, driver: str | None = None, **options) -> None:
    _find(WRITERS, driver or driver_of(filename, "writers"))(df, filename, **options)


__all__ = ["READERS", "UNAVAILABLE", "WRITERS", "driver_of", "read", "write"]
