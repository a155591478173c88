"""Dimensions: names, default types, widening of types, and checked conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default types of standard dimensions (everything else is a double), and short names.
UNSIGNED8 = "ReturnNumber NumberOfReturns ScanDirectionFlag EdgeOfFlightLine Classification ScanChannel UserData ClassFlags Synthetic KeyPoint Withheld Overlap Flag Mark Duplicate Coplanar Rank".split()
UNSIGNED16 = "Intensity PointSourceId Red Green Blue Infrared Alpha Density16".split()
UNSIGNED32 = "OffsetTime PulseWidth32 PassiveSignal32".split()
UNSIGNED64 = "OriginId OptimalKNN H3 PointId".split()
SIGNED32 = "ReturnWidth EchoRange32".split()
SIGNED64 = "ClusterID".split()
FLOAT = "ScanAngleRank Reflectance Deviation PulseWidth Amplitude".split()
ALIASES = {"HAG": "HeightAboveGround", "nx": "NormalX", "ny": "NormalY", "nz": "NormalZ", "cls": "Classification", "r": "Red", "g": "Green", "b": "Blue", "time": "GpsTime", "t": "GpsTime"}

#: Range of each declared type; unsigned types live in the next wider signed one.
RANGES = {
    "int8": (-(2**7), 2**7 - 1), "int16": (-(2**15), 2**15 - 1), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1),
    "uint8": (0, 2**8 - 1), "uint16": (0, 2**16 - 1), "uint32": (0, 2**32 - 1), "uint64": (0, 2**64 - 1),
}
SPARK = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float": "float", "double": "double"}
_DECLARED = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float", "double": "double", "decimal(20,0)": "uint64"}


def default_type(name: str) -> str:
    for kind, names in (("uint8", UNSIGNED8), ("uint16", UNSIGNED16), ("uint32", UNSIGNED32), ("uint64", UNSIGNED64), ("int32", SIGNED32), ("int64", SIGNED64), ("float", FLOAT)):
        if name in names:
            return kind
    return "double"


def declared_type(df: DataFrame, name: str) -> str:
    """The declared type of a column: the standard one where its Spark type fits it, else that of its Spark type."""
    spark_type = dict(df.dtypes).get(name)
    standard = default_type(name)
    return standard if spark_type is None or SPARK[standard] == spark_type else _DECLARED.get(spark_type, "double")


def resolve_type(a: str, b: str) -> str:
    """The type that holds both: the larger of a family, floating over integer, the next signed size of mixed signs."""
    if a == b:
        return a
    floating = [x for x in (a, b) if x in ("float", "double")]
    if floating:
        return "double" if "double" in floating or len(floating) == 1 and any(x.endswith(("32", "64")) for x in (a, b)) else "float"
    signed = [not x.startswith("u") for x in (a, b)]
    bits = [int(x.removeprefix("u").removeprefix("int")) for x in (a, b)]
    if signed[0] == signed[1]:
        return ("int" if signed[0] else "uint") + str(max(bits))
    size = max(bits[0] * (1 if signed[0] else 2), bits[1] * (1 if signed[1] else 2))
    return f"int{size}" if size <= 64 else "double"


def round_away(c: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.when(c < 0, F.ceil(c - 0.5)).otherwise(F.floor(c + 0.5))


def checked(value: Column, kind: str, name: str = "value") -> Column:
    """Convert a double to a declared type: integers are rounded half away from zero and must be in range, else an error names the dimension."""
    if kind in ("float", "double"):
        return value.cast(kind)
    low, high = RANGES[kind]
    rounded = F.round(value.cast("double"), 0)
    bad = F.isnan(rounded) | (rounded < float(low)) | (rounded > float(high))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(f" does not fit {kind}"))).cast(SPARK[kind])).otherwise(rounded.cast(SPARK[kind]))


def standard_name(name: str) -> str:
    return ALIASES.get(name, name)


def order_columns(df: DataFrame) -> list[str]:
    """The view column, if there is one."""
    return ["view"] if "view" in df.columns else []
