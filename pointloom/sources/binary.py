"""Readers of binary formats: each file is decoded by numpy in a task of its own.

Files come through Spark's ``binaryFile`` source, so any store will do; a file is held
by the task that decodes it, so very large clouds should be many files.
"""

from __future__ import annotations

import gzip
import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import _whole

_SPARK = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double", "i8": "bigint", "u8": "bigint"}


def _frame(columns: dict[str, np.ndarray], schema: dict[str, str]) -> pd.DataFrame:
    kinds = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}
    n = len(next(iter(columns.values()))) if columns else 0
    out = {"pid": np.arange(n, dtype=np.int64)}
    for c, t in schema.items():
        out[c] = columns[c].astype(kinds[t]) if c in columns else np.zeros(n, kinds[t])
    return pd.DataFrame(out)


def _read(spark: SparkSession, path, decode, schema: dict[str, str]) -> DataFrame:
    return _whole(spark, path, lambda b: _frame(decode(b), schema), "pid long, " + ", ".join(f"`{c}` {t}" for c, t in schema.items()))


def _first(spark: SparkSession, path, n: int = 65536) -> bytes:
    files = spark.read.format("binaryFile").load(path if isinstance(path, list) else [path])
    return bytes(files.orderBy("path").select(F.substring("content", 1, n).alias("c")).first().c)


# Fixed values of the format: fields of LAS point formats.
LAS_OLD = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("Intensity", "<u2"), ("bits", "u1"), ("class", "u1"), ("angle", "i1"), ("UserData", "u1"), ("PointSourceId", "<u2")]
LAS_NEW = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("Intensity", "<u2"), ("bits", "u1"), ("flags", "u1"), ("class", "u1"), ("UserData", "u1"), ("angle", "<i2"), ("PointSourceId", "<u2"), ("GpsTime", "<f8")]
LAS_TIME, LAS_COLOUR, LAS_INFRARED = [("GpsTime", "<f8")], [("Red", "<u2"), ("Green", "<u2"), ("Blue", "<u2")], [("Infrared", "<u2")]
LAS_WAVE = [("WavePacketDescriptorIndex", "u1"), ("WaveformDataOffset", "<u8"), ("WaveformPacketSize", "<u4"), ("ReturnPointWaveformLocation", "<f4"), ("wx", "<f4"), ("wy", "<f4"), ("wz", "<f4")]
LAS_FORMATS = {
    0: LAS_OLD, 1: LAS_OLD + LAS_TIME, 2: LAS_OLD + LAS_COLOUR, 3: LAS_OLD + LAS_TIME + LAS_COLOUR, 4: LAS_OLD + LAS_TIME + LAS_WAVE, 5: LAS_OLD + LAS_TIME + LAS_COLOUR + LAS_WAVE,
    6: LAS_NEW, 7: LAS_NEW + LAS_COLOUR, 8: LAS_NEW + LAS_COLOUR + LAS_INFRARED, 9: LAS_NEW + LAS_WAVE, 10: LAS_NEW + LAS_COLOUR + LAS_INFRARED + LAS_WAVE,
}
LAS_SCHEMA = {
    "X": "double", "Y": "double", "Z": "double", "Intensity": "int", "ReturnNumber": "smallint", "NumberOfReturns": "smallint", "ScanDirectionFlag": "smallint", "EdgeOfFlightLine": "smallint", "Classification": "smallint",
    "ScanAngleRank": "float", "UserData": "smallint", "PointSourceId": "int", "GpsTime": "double", "ScanChannel": "smallint", "ClassFlags": "smallint", "Red": "int", "Green": "int", "Blue": "int", "Infrared": "int",
}


def las_header(data: bytes) -> dict:
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = data[24], data[25]
    size, offset, vlrs, fmt, length, count = struct.unpack("<HIIBHI", data[94:111])
    if fmt & 0xC0:
        raise NotImplementedError("compressed points need a codec that is not available")
    scale, shift = struct.unpack("<3d", data[131:155]), struct.unpack("<3d", data[155:179])
    if (major, minor) >= (1, 4):
        count = struct.unpack("<Q", data[247:255])[0] or count
    return {"version": (major, minor), "header": size, "offset": offset, "vlrs": vlrs, "format": fmt, "length": length, "count": count, "scale": scale, "shift": shift}


def decode_las(data: bytes, start: int = 0) -> dict[str, np.ndarray]:
    h = las_header(data)
    fields = LAS_FORMATS[h["format"]]
    kind = np.dtype({"names": [f for f, _ in fields], "formats": [t for _, t in fields], "itemsize": h["length"], "offsets": np.cumsum([0, *[np.dtype(t).itemsize for _, t in fields]])[:-1].tolist()})
    p = np.frombuffer(data, kind, count=min(h["count"], (len(data) - h["offset"]) // h["length"]), offset=h["offset"])[start:]
    out = {c: p[f] * s + o for c, f, s, o in zip("XYZ", "xyz", h["scale"], h["shift"], strict=True)}
    bits = p["bits"]
    if h["format"] < 6:
        out |= {"ReturnNumber": bits & 7, "NumberOfReturns": (bits >> 3) & 7, "ScanDirectionFlag": (bits >> 6) & 1, "EdgeOfFlightLine": bits >> 7, "Classification": p["class"] & 31, "ClassFlags": p["class"] >> 5, "ScanAngleRank": p["angle"]}
    else:
        f = p["flags"]
        out |= {"ReturnNumber": bits & 15, "NumberOfReturns": bits >> 4, "ClassFlags": f & 15, "ScanChannel": (f >> 4) & 3, "ScanDirectionFlag": (f >> 6) & 1, "EdgeOfFlightLine": f >> 7, "Classification": p["class"], "ScanAngleRank": p["angle"] * np.float32(0.006)}
    return out | {c: p[c] for c in ("Intensity", "UserData", "PointSourceId", "GpsTime", "Red", "Green", "Blue", "Infrared") if c in p.dtype.names}


def read_las(spark: SparkSession, path: str | list[str], start: int = 0, **_: str) -> DataFrame:
    """Uncompressed LAS 1.0 to 1.4, point formats 0 to 10."""
    return _read(spark, path, lambda b: decode_las(b, start), LAS_SCHEMA)


_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
_PLY_NAMES = {"x": "X", "y": "Y", "z": "Z", "red": "Red", "green": "Green", "blue": "Blue", "nx": "NormalX", "ny": "NormalY", "nz": "NormalZ", "intensity": "Intensity", "alpha": "Alpha"}


def ply_header(data: bytes) -> dict:
    end = data.index(b"end_header")
    begin = data.index(b"\n", end) + 1
    out = {"begin": begin, "format": "ascii", "count": 0, "fields": []}
    element = None
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            out["format"] = w[1]
        elif w[:1] == ["element"]:
            element = w[1]
            if element == "vertex":
                out["count"] = int(w[2])
        elif w[:1] == ["property"] and element == "vertex":
            if w[1] == "list":
                raise ValueError("lists on vertices are not read")
            out["fields"].append((_PLY_NAMES.get(w[2], w[2]), _PLY[w[1]]))
    return out


def decode_ply(data: bytes) -> dict[str, np.ndarray]:
    h = ply_header(data)
    names = [n for n, _ in h["fields"]]
    if h["format"] == "ascii":
        rows = data[h["begin"] :].decode().split("\n")[: h["count"]]
        table = np.array([r.split()[: len(names)] for r in rows], float).reshape(-1, len(names))
        return {n: table[:, i] for i, n in enumerate(names)}
    order = "<" if "little" in h["format"] else ">"
    p = np.frombuffer(data, np.dtype([(n, order + t) for n, t in h["fields"]]), count=h["count"], offset=h["begin"])
    return {n: p[n] for n in names}


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, decode_ply, {n: "double" if n in "XYZ" else _SPARK[t] for n, t in ply_header(_first(spark, path))["fields"]})


def pcd_header(data: bytes) -> dict:
    head, at = {}, 0
    while True:
        end = data.index(b"\n", at)
        w = data[at:end].decode("ascii", "replace").split()
        at = end + 1
        if w and not w[0].startswith("#"):
            head[w[0]] = w[1:]
        if w[:1] == ["DATA"]:
            break
    kinds = [{"F": "f", "I": "i", "U": "u"}[t] + s for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
    names = [_PLY_NAMES.get(n.lower(), n) for n in head["FIELDS"]]
    return {"begin": at, "data": head["DATA"][0], "count": int(head["POINTS"][0]), "fields": list(zip(names, kinds, strict=True))}


def _lzf(data: bytes, size: int) -> bytes:
    """Literal runs and back references of the LZF format."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c < 32:
            out += data[i : i + c + 1]
            i += c + 1
        else:
            n = c >> 5
            if n == 7:
                n += data[i]
                i += 1
            back = len(out) - ((c & 31) << 8) - data[i] - 1
            i += 1
            for k in range(n + 2):
                out.append(out[back + k])
    if len(out) != size:
        raise ValueError("a compressed block has the wrong length")
    return bytes(out)


def decode_pcd(data: bytes) -> dict[str, np.ndarray]:
    h = pcd_header(data)
    names = [n for n, _ in h["fields"]]
    if h["data"] == "ascii":
        table = np.array([r.split() for r in data[h["begin"] :].decode().split("\n")[: h["count"]]], float).reshape(-1, len(names))
        return {n: table[:, i] for i, n in enumerate(names)}
    if h["data"] == "binary":
        p = np.frombuffer(data, np.dtype([(n, "<" + t) for n, t in h["fields"]]), count=h["count"], offset=h["begin"])
        return {n: p[n] for n in names}
    packed, whole = struct.unpack("<II", data[h["begin"] : h["begin"] + 8])
    raw, out, at = _lzf(data[h["begin"] + 8 : h["begin"] + 8 + packed], whole), {}, 0
    for n, t in h["fields"]:
        out[n] = np.frombuffer(raw, "<" + t, count=h["count"], offset=at)
        at += out[n].nbytes
    return out


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, decode_pcd, {n: "double" if n in "XYZ" else _SPARK[t] for n, t in pcd_header(_first(spark, path))["fields"]})


SBET = ["GpsTime", "Y", "X", "Z", "XVelocity", "YVelocity", "ZVelocity", "Roll", "Pitch", "Azimuth", "WanderAngle", "XBodyAccel", "YBodyAccel", "ZBodyAccel", "XBodyAngRate", "YBodyAngRate", "ZBodyAngRate"]
SBET_ANGLES = ("X", "Y", "Roll", "Pitch", "Azimuth", "WanderAngle", "XBodyAngRate", "YBodyAngRate", "ZBodyAngRate")
SMRMSG = ["GpsTime", "NorthPositionRMS", "EastPositionRMS", "DownPositionRMS", "NorthVelocityRMS", "EastVelocityRMS", "DownVelocityRMS", "RollRMS", "PitchRMS", "HeadingRMS"]


def decode_sbet(data: bytes, degrees: bool = True) -> dict[str, np.ndarray]:
    p = np.frombuffer(data, np.dtype([(n, "<f8") for n in SBET]))
    return {n: np.degrees(p[n]) if degrees and n in SBET_ANGLES else p[n] for n in SBET}


def read_sbet(spark: SparkSession, path: str, angles_as_degrees: bool = True) -> DataFrame:
    return _read(spark, path, lambda b: decode_sbet(b, angles_as_degrees), dict.fromkeys(SBET, "double"))


def read_smrmsg(spark: SparkSession, path: str) -> DataFrame:
    def decode(data: bytes):
        p = np.frombuffer(data, np.dtype([(n, "<f8") for n in SMRMSG]))
        return {n: p[n] for n in SMRMSG}

    return _read(spark, path, decode, dict.fromkeys(SMRMSG, "double"))


QFIT = ["OffsetTime", "Y", "X", "Z", "StartPulse", "ReflectedPulse", "ScanAngleRank", "Pitch", "Roll"]


def decode_qfit(data: bytes, flip_coordinates: bool = True, scale_z: float = 0.001) -> dict[str, np.ndarray]:
    """Records of 4-byte words (10, 12 or 14); the first word is the record length, the second record's tells where data begin."""
    order = ">" if struct.unpack(">i", data[:4])[0] in (40, 48, 56) else "<"
    size = struct.unpack(order + "i", data[:4])[0]
    if size not in (40, 48, 56):
        raise ValueError("not a QFIT file")
    begin = struct.unpack(order + "i", data[size + 4 : size + 8])[0]
    p = np.frombuffer(data[begin : begin + (len(data) - begin) // size * size], np.dtype(order + "i4")).reshape(-1, size // 4)
    out = {n: p[:, i].astype(float) for i, n in enumerate(QFIT)}
    out["X"], out["Y"], out["Z"] = out["X"] * 1e-6, out["Y"] * 1e-6, out["Z"] * scale_z
    if flip_coordinates:
        out["X"] = np.where(out["X"] > 180, out["X"] - 360, out["X"])
    return out | {k: out[k] / 1000 for k in ("ScanAngleRank", "Pitch", "Roll")}


def read_qfit(spark: SparkSession, path: str, flip_coordinates: bool = True, scale_z: float = 0.001) -> DataFrame:
    return _read(spark, path, lambda b: decode_qfit(b, flip_coordinates, scale_z), dict.fromkeys(QFIT, "double"))


def decode_terrasolid(data: bytes) -> dict[str, np.ndarray]:
    """TerraScan formats 1 and 2."""
    size, version, _, _, count, units = struct.unpack("<iiii ii".replace(" ", ""), data[:24])
    origin = np.array(struct.unpack("<3d", data[24:48]))
    time, colour = struct.unpack("<ii", data[48:56])
    fields = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("class", "u1"), ("echo", "u1"), ("Flag", "u1"), ("Mark", "u1"), ("PointSourceId", "<u2"), ("Intensity", "<u2")] if version == 20020715 else [("class", "u1"), ("PointSourceId", "u1"), ("ie", "<u2"), ("x", "<i4"), ("y", "<i4"), ("z", "<i4")]
    fields += [("OffsetTime", "<u4")] * bool(time) + [("rgb", "u1", 4)] * bool(colour)
    p = np.frombuffer(data, np.dtype(fields), count=count, offset=size)
    out = {c: (p[f] - o) / units for c, f, o in zip("XYZ", "xyz", origin, strict=True)} | {"Classification": p["class"], "PointSourceId": p["PointSourceId"]}
    out["Intensity"] = p["Intensity"] if "Intensity" in p.dtype.names else p["ie"] & 0x3FFF
    if time:
        out["OffsetTime"] = p["OffsetTime"]
    if colour:
        out |= {c: p["rgb"][:, i] for i, c in enumerate(("Red", "Green", "Blue"))}
    return out


def read_terrasolid(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, decode_terrasolid, {"X": "double", "Y": "double", "Z": "double", "Classification": "smallint", "PointSourceId": "int", "Intensity": "int", "OffsetTime": "bigint", "Red": "int", "Green": "int", "Blue": "int"})


def _turned(angle: float, axis: int) -> np.ndarray:
    """A rotation about an axis."""
    i, j = [(1, 2), (2, 0), (0, 1)][axis]
    m = np.eye(3)
    m[i, i] = m[j, j] = math.cos(angle)
    m[i, j], m[j, i] = -math.sin(angle), math.sin(angle)
    return m


def decode_optech(data: bytes) -> dict[str, np.ndarray]:
    """CSD: each record has up to four ranges from one place; every return is a point in degrees and metres."""
    size = struct.unpack("<H", data[104:106])[0]
    kind = np.dtype([("t", "<f8"), ("n", "u1"), ("range", "<f4", 4), ("intensity", "<u2", 4), ("angle", "<f4"), ("roll", "<f4"), ("pitch", "<f4"), ("heading", "<f4"), ("lat", "<f8"), ("lon", "<f8"), ("h", "<f4")])
    p = np.frombuffer(data[size : size + (len(data) - size) // kind.itemsize * kind.itemsize], kind)
    out: dict[str, list] = {k: [] for k in ("X", "Y", "Z", "GpsTime", "ReturnNumber", "NumberOfReturns", "Intensity", "ScanAngleRank")}
    for r in p:
        for k in range(int(r["n"])):
            sight = r["range"][k] * np.array([math.sin(r["angle"]), 0.0, -math.cos(r["angle"])])
            east, north, up = _turned(-float(r["heading"]), 2) @ _turned(float(r["pitch"]), 0) @ _turned(float(r["roll"]), 1) @ sight
            lat = float(r["lat"]) + north / 6378137.0
            values = (math.degrees(float(r["lon"]) + east / (6378137.0 * math.cos(float(r["lat"])))), math.degrees(lat), float(r["h"]) + up, r["t"], k + 1, r["n"], r["intensity"][k], math.degrees(r["angle"]))
            for c, v in zip(out.values(), values, strict=True):
                c.append(float(v))
    return {k: np.array(v) for k, v in out.items()}


def read_optech(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, decode_optech, {"X": "double", "Y": "double", "Z": "double", "GpsTime": "double", "ReturnNumber": "smallint", "NumberOfReturns": "smallint", "Intensity": "int", "ScanAngleRank": "float"})


def bpf_header(data: bytes) -> dict:
    magic, version, length, dims, layout, packed, _, count, coord, zone, spacing = struct.unpack("<4s4siBBBBiiif", data[:32])
    if magic != b"BPF!" or version != b"0003":
        raise ValueError("not a BPF 3 file")
    matrix = np.frombuffer(data, "<f8", 16, 32).reshape(4, 4)
    at = 32 + 128 + 16
    offsets = np.frombuffer(data, "<f8", dims, at)
    names = [data[at + 24 * dims + 32 * i : at + 24 * dims + 32 * (i + 1)].rstrip(b"\0").decode() for i in range(dims)]
    return {"length": length, "dims": names, "layout": layout, "compressed": packed, "count": count, "matrix": matrix, "offsets": offsets}


def decode_bpf(data: bytes) -> dict[str, np.ndarray]:
    h = bpf_header(data)
    n, names = h["count"], h["dims"]
    body = data[h["length"] :]
    if h["compressed"]:
        import zlib

        out, at = b"", 0
        while at < len(body) and len(out) < 4 * n * len(names):
            _, packed = struct.unpack("<II", body[at : at + 8])
            out += zlib.decompress(body[at + 8 : at + 8 + packed])
            at += 8 + packed
        body = out
    if h["layout"] == 0:
        table = np.frombuffer(body, "<f4", n * len(names)).reshape(len(names), n)
    elif h["layout"] == 1:
        table = np.frombuffer(body, "<f4", n * len(names)).reshape(n, len(names)).T
    else:
        b = np.frombuffer(body, "u1", 4 * n * len(names)).reshape(len(names), 4, n)
        table = np.ascontiguousarray(b.transpose(0, 2, 1)).view("<f4")[..., 0]
    columns = {name: table[i].astype(float) + h["offsets"][i] for i, name in enumerate(names)}
    xyz = np.stack([columns["X"], columns["Y"], columns["Z"], np.ones(n)])
    x, y, z, w = h["matrix"] @ xyz
    return columns | {"X": x / w, "Y": y / w, "Z": z / w}


def read_bpf(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, decode_bpf, dict.fromkeys(bpf_header(_first(spark, path))["dims"], "double"))


def decode_spz(data: bytes) -> dict[str, np.ndarray]:
    """Gaussian splats: positions in 24-bit fixed point, opacities, colours, scales and rotations."""
    raw = gzip.decompress(data)
    magic, version, n, degree, bits, _, _ = struct.unpack("<IIIBBBB", raw[:16])
    if magic != 0x5053474E or version not in (2, 3):
        raise ValueError("not a splat file of version 2 or 3")
    at = 16
    p = np.frombuffer(raw, "u1", 9 * n, at).reshape(n, 3, 3).astype(np.int32)
    v = p[..., 0] | p[..., 1] << 8 | p[..., 2] << 16
    v = np.where(v & 0x800000, v - 0x1000000, v) / float(1 << bits)
    at += 9 * n
    alpha = np.frombuffer(raw, "u1", n, at) / 255.0
    colour = np.frombuffer(raw, "u1", 3 * n, at + n).reshape(n, 3)
    scale = np.frombuffer(raw, "u1", 3 * n, at + 4 * n).reshape(n, 3) / 16.0 - 10.0
    out = {c: v[:, i] for i, c in enumerate("XYZ")} | {"Opacity": np.log(np.clip(alpha, 1e-6, 1 - 1e-6) / (1 - np.clip(alpha, 1e-6, 1 - 1e-6)))}
    return out | {f"FeatureDC{i}": (colour[:, i] / 255.0 - 0.5) / 0.15 for i in range(3)} | {f"Scale{i}": scale[:, i] for i in range(3)}


def read_spz(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, decode_spz, dict.fromkeys(["X", "Y", "Z", "Opacity", *[f"FeatureDC{i}" for i in range(3)], *[f"Scale{i}" for i in range(3)]], "double"))
