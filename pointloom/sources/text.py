"""Text readers. Line order is kept in ``pid``: the file's place among the paths, then the line."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import standard_name
from ..ship import ship


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """line and pid of every line: 2**33 a split of a file, then the place in it, so the order holds without a global count."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pid"), F.col("value").alias("line"))


def _head(spark: SparkSession, path, skip: int) -> list[str]:
    first = path if isinstance(path, str) else path[0]
    return [r.value for r in spark.read.text(first).limit(skip + 1).collect()]


def split_header(header: str, separator: str | None) -> tuple[list[str], str]:
    """Names of a header, quoted or not, and the separator: the one given, or the first that is no part of a name."""
    if header.lstrip().startswith('"'):
        names = re.findall(r'"([^"]*)"', header)
        rest = re.sub(r'"[^"]*"', "", header).strip("\r\n")
        sep = separator or (rest.strip()[:1] or " ")
    else:
        found = re.search(r"[^\w\s]|\s", header.strip())
        sep = separator or (found[0] if found else " ")
        names = re.split(r"\s+", header.strip()) if sep.isspace() else header.strip().split(sep)
    names = [standard_name(n.strip().strip('"')) for n in names if n.strip()]
    if len(set(names)) < len(names):
        raise ValueError(f"a dimension is named twice in {header!r}")
    return names, sep


def read_text(spark: SparkSession, path: str | list[str], separator: str | None = None, header: str | None = None, skip: int = 0) -> DataFrame:
    """Delimited numbers under a header line, or under a given one; runs of white space are one separator."""
    head = _head(spark, path, skip)
    names, sep = split_header(header if header is not None else head[skip], separator)
    own = header if header is not None else head[skip]
    drop = set(head[:skip]) | ({own} if header is None else set())
    parts = F.split(F.trim("line"), r"\s+") if sep.isspace() else F.split(F.col("line"), re.escape(sep))
    rows = lines(spark, path).where(~F.trim(F.regexp_replace("line", "\r", "")).isin([d.strip() for d in drop]) & (F.trim("line") != ""))
    rows = rows.withColumn("line", F.regexp_replace("line", '[\r"]', ""))
    return rows.select("pid", *[parts[i].cast("double").alias(n) for i, n in enumerate(names)])


def read_pts(spark: SparkSession, path: str) -> DataFrame:
    """A count line, then x y z [intensity [r g b]]."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = lines(spark, path).withColumn("p", parts).where(F.size("p") >= 3)
    at = lambda i: F.get("p", F.lit(i)).cast("double")
    # scanner intensities are from -2048 to 2047
    return rows.select("pid", at(0).alias("X"), at(1).alias("Y"), at(2).alias("Z"), (at(3) + 2048).cast("int").alias("Intensity"), *[at(4 + i).cast("int").alias(c) for i, c in enumerate(("Red", "Green", "Blue"))]).fillna(0)


def _whole(spark: SparkSession, path, decode, schema: str) -> DataFrame:
    """``decode`` (text to frame, with pid inside the file) of each whole file."""

    def run(frames):
        for f in frames:
            for k, content in zip(f["k"], f["content"], strict=True):
                out = decode(bytes(content))
                out["pid"] = out["pid"] + (int(k) << 40)
                yield out

    ship(spark)
    files = spark.read.format("binaryFile").load(path if isinstance(path, list) else [path])
    names = sorted(r.path for r in files.select("path").collect())
    numbered = files.withColumn("k", F.array_position(F.lit(names), F.col("path")) - 1)
    return numbered.select("k", "content").mapInPandas(run, schema)


def decode_ptx(data: bytes, discard_missing_points: bool = True) -> pd.DataFrame:
    rows = [[float(x) for x in line.split()] for line in data.decode().splitlines() if line.strip()]
    out, at = [], 0
    while at < len(rows):
        n = int(rows[at][0]) * int(rows[at + 1][0])
        matrix = np.array(rows[at + 6 : at + 10])
        block = rows[at + 10 : at + 10 + n]
        at += 10 + n
        for r in block:
            if discard_missing_points and r[0] == r[1] == r[2] == 0:
                continue
            x, y, z, _ = np.array([*r[:3], 1.0]) @ matrix
            out.append((x, y, z, int(round(r[3] * 4096)) if len(r) > 3 else 0, *(int(c) for c in (r[4:7] if len(r) > 6 else (0, 0, 0)))))
    f = pd.DataFrame(out, columns=["X", "Y", "Z", "Intensity", "Red", "Green", "Blue"])
    f.insert(0, "pid", np.arange(len(f)))
    return f


def read_ptx(spark: SparkSession, path: str, discard_missing_points: bool = True) -> DataFrame:
    return _whole(spark, path, lambda b: decode_ptx(b, discard_missing_points), "pid long, X double, Y double, Z double, Intensity int, Red int, Green int, Blue int")


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of a Wavefront file."""
    rows = lines(spark, path).where(F.col("line").rlike(r"^v\s")).withColumn("p", F.split(F.trim("line"), r"\s+"))
    return rows.select("pid", *[F.col("p")[i + 1].cast("double").alias(c) for i, c in enumerate("XYZ")])


def read_ilvis2(spark: SparkSession, path: str, mapping: str = "ALL") -> DataFrame:
    """Centroid, low and high places of each shot, as separate points."""
    p = lines(spark, path).where(~F.col("line").startswith("#")).withColumn("p", F.split(F.trim("line"), r"\s+")).where(F.size("p") >= 12)
    at = lambda i: F.col("p")[i].cast("double")
    kinds = {"CENTROID": 3, "LOW": 6, "HIGH": 9}
    wanted = kinds if mapping == "ALL" else {mapping: kinds[mapping]}
    points = F.array(*[F.struct(at(i).alias("X"), at(i + 1).alias("Y"), at(i + 2).alias("Z")) for i in wanted.values()])
    return p.select("pid", at(0).alias("LvisLfid"), at(1).alias("ShotNumber"), at(2).alias("GpsTime"), F.posexplode(points).alias("k", "q")).select((F.col("pid") * 4 + F.col("k")).alias("pid"), "LvisLfid", "ShotNumber", "GpsTime", "q.*")


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells of an ASCII grid (ncols, nrows, xllcorner, yllcorner, cellsize, nodata_value) as points at their centres, with col and row."""

    def decode(data: bytes) -> pd.DataFrame:
        rows = data.decode().split("\n")
        head, at = {}, 0
        while rows[at].split() and rows[at].split()[0][0].isalpha():
            k, v = rows[at].split()
            head[k.lower()] = float(v)
            at += 1
        z = np.array(" ".join(rows[at:]).split(), float).reshape(int(head["nrows"]), int(head["ncols"]))
        r, c = np.mgrid[: z.shape[0], : z.shape[1]]
        size = head["cellsize"]
        keep = z.ravel() != head.get("nodata_value", np.nan)
        f = pd.DataFrame({"X": head["xllcorner"] + (c.ravel() + 0.5) * size, "Y": head["yllcorner"] + (z.shape[0] - r.ravel() - 0.5) * size, "Z": z.ravel(), "band1": z.ravel(), "col": c.ravel().astype("int32"), "row": r.ravel().astype("int32")})[keep]
        f.insert(0, "pid", np.arange(len(f)))
        return f

    return _whole(spark, path, decode, "pid long, X double, Y double, Z double, band1 double, col int, row int")


def read_parquet(spark: SparkSession, path: str | list[str], order: str | None = None, **_: str) -> DataFrame:
    """Columns as dimensions; pushdown and pruning are Spark's own. ``order`` names the column that becomes ``pid``."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if "pid" in df.columns:
        return df
    return df.withColumnRenamed(order, "pid") if order else df.withColumn("pid", F.monotonically_increasing_id())
