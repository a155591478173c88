"""Registered queries: each operator on a point view of the driver tables, with SQL where SQL can express it.

Derived doubles are rounded to six places in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, cluster, mesh, neighbors, order, partition, pointwise, select, terrain, voxel
from . import clouds
from .clouds import EVENT, LINE, VECTOR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

POLYGON = "POLYGON ((10 10, 40 10, 40 60, 25 90, 10 60, 10 10))"
BOX = "([10,40],[20,70])"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def r6(c: str, name: str | None = None):
    return F.round(F.col(c).cast("double"), 6).alias(name or c)


# projection and assignment


@query(f"SELECT Classification::INTEGER AS classification, count(*)::BIGINT AS n, round(sum(X), 6) AS x, round(max(W), 6) AS w FROM (SELECT CASE WHEN Z > 50000 THEN 3 ELSE Classification END AS Classification, CASE WHEN Z > 50000 THEN X * 2 + 1 ELSE X END AS X, sqrt(Z) + Y AS W FROM {LINE}) GROUP BY ALL")
def assign_where(spark, d):
    df = pointwise.assign(clouds.line(spark, d), ["X = X * 2 + 1 WHERE Z > 50000", "Classification = 3 WHERE Z > 50000", "W = sqrt(Z) + Y"])
    return df.groupBy(F.col("Classification").cast("int").alias("classification")).agg(F.count("*").alias("n"), F.round(F.sum("X"), 6).alias("x"), F.round(F.max("W"), 6).alias("w"))


@query(f"SELECT pid, X AS copy, 0.0::DOUBLE AS empty FROM {EVENT}")
def ferry(spark, d):
    return pointwise.ferry(clouds.event(spark, d), "X=>Copy, =>Empty").select("pid", F.col("Copy").alias("copy"), F.col("Empty").cast("double").alias("empty"))


@query(f"SELECT pid, round(2 * X + 1 * Y + 5, 6) AS x, round(Y * 0.5 - 1, 6) AS y, round(Z + 10, 6) AS z FROM {EVENT}")
def transformation(spark, d):
    return pointwise.transformation(clouds.event(spark, d), "2 1 0 5  0 0.5 0 -1  0 0 1 10  0 0 0 1").select("pid", r6("X", "x"), r6("Y", "y"), r6("Z", "z"))


def _ramp_sql(stops: str) -> str:
    mixed = lambda c: f"floor(a.{c} + (2 * (b.{c} - a.{c}) * (entry - a.p) + b.p - a.p) / (2.0 * (b.p - a.p)))::INTEGER"
    return f"""WITH s AS (SELECT * FROM (VALUES {stops}) v(p, r, g, b)), a AS (SELECT *, lead(p) OVER (ORDER BY p) AS q FROM s),
e AS (SELECT pid, least(floor((Z - lo) / (hi - lo) * 256), 255) AS entry FROM {EVENT}, (SELECT min(Z) AS lo, max(Z) AS hi FROM {EVENT}))
SELECT pid, {mixed('r')} AS red, {mixed('g')} AS green, {mixed('b')} AS blue FROM e JOIN a ON entry >= a.p AND (entry < a.q OR a.q = 255 AND entry = 255) JOIN s b ON b.p = a.q"""


@query(_ramp_sql("(0, 0, 106, 188), (30, 12, 114, 193), (68, 35, 127, 203), (134, 85, 157, 223), (177, 118, 177, 237), (215, 143, 192, 247), (249, 159, 202, 254), (255, 161, 203, 255)"))
def colorinterp(spark, d):
    return pointwise.colorinterp(clouds.event(spark, d), "Z", ramp="blue_hue").select("pid", F.col("Red").alias("red"), F.col("Green").alias("green"), F.col("Blue").alias("blue"))


@query(_ramp_sql("(0, 0, 88, 95), (10, 12, 96, 101), (20, 27, 107, 111), (34, 54, 126, 127), (48, 84, 148, 146), (76, 150, 195, 185), (90, 182, 215, 201), (104, 210, 231, 214), (116, 230, 240, 220), (128, 245, 243, 220), (140, 255, 240, 214), (153, 255, 230, 201), (165, 255, 216, 185), (180, 255, 195, 160), (220, 255, 129, 86), (236, 255, 107, 61), (250, 255, 92, 45), (255, 255, 89, 41)"))
def colorinterp_default(spark, d):
    return pointwise.colorinterp(clouds.event(spark, d)).select("pid", F.col("Red").alias("red"), F.col("Green").alias("green"), F.col("Blue").alias("blue"))


@query(f"""SELECT pid, round(W + 604800.0 * sum(f) OVER (ORDER BY pid), 3) AS gpstime FROM (SELECT pid, W, CASE WHEN lag(W) OVER (ORDER BY pid) - W > 1 THEN 1 ELSE 0 END AS f FROM (SELECT pid, fmod(GpsTime, 604800.0) AS W FROM {EVENT}))""")
def gps_unwrap(spark, d):
    df = clouds.event(spark, d).withColumn("GpsTime", F.expr("GpsTime % 604800.0D"))
    return pointwise.gps_unwrap(df).select("pid", F.round("GpsTime", 3).alias("gpstime"))


@query(f"SELECT pid, round(GpsTime - 315964800 - 1e9, 1) AS gst FROM {EVENT}")
def gpstime_convert(spark, d):
    df = clouds.event(spark, d).withColumn("GpsTime", F.col("GpsTime") - 315964800)
    return pointwise.gpstimeconvert(df, "gt", "gst").select("pid", F.round("GpsTime", 1).alias("gst"))


@query(f"SELECT pid, round(radians(X) * 6378137.0, 4) AS x, round(ln(tan(pi() / 4 + radians(Y) / 2)) * 6378137.0, 4) AS y FROM {EVENT}")
def reprojection_mercator(spark, d):
    return pointwise.reprojection(clouds.event(spark, d), "EPSG:4326", "EPSG:3857").select("pid", F.round("X", 4).alias("x"), F.round("Y", 4).alias("y"))


@query(f"SELECT pid, round(X / 2, 6) AS x, round(Y - 3, 6) AS y FROM {EVENT}")
def projpipeline(spark, d):
    return pointwise.projpipeline(clouds.event(spark, d), "+proj=pipeline +step +proj=affine +s11=0.5 +yoff=-3").select("pid", r6("X", "x"), r6("Y", "y"))


@query(f"SELECT pid, round(X, 6) AS along, round(Y, 6) AS across, round(Z, 6) AS up FROM {EVENT}")
def straighten(spark, d):
    df = clouds.event(spark, d)
    ends = df.agg(F.least(F.lit(0.0), F.min("X")).alias("low"), F.greatest(F.lit(1000.0), F.max("X")).alias("high")).first()
    line = [(ends.low, 0.0, 0.0, 0.0), (500.0, 0.0, 0.0, 0.0), (ends.high, 0.0, 0.0, 0.0)]
    return pointwise.straighten(df, line, offset=ends.low).select("pid", r6("X", "along"), r6("Y", "across"), r6("Z", "up"))


@query()
def georeference(spark, d):
    df = clouds.event(spark, d)
    poses = df.where("pid % 50 = 0").select("GpsTime", (F.col("X") / 1e4).alias("X"), (F.col("Y") / 1e3).alias("Y"), "Z", F.lit(0.01).alias("Roll"), F.lit(0.02).alias("Pitch"), F.lit(0.5).alias("Azimuth"), F.lit(0.0).alias("WanderAngle"))
    return pointwise.georeference(df, poses).select("pid", F.round("X", 3).alias("x"), F.round("Y", 3).alias("y"), F.round("Z", 3).alias("z"))


def _raster(spark, d) -> DataFrame:
    cells = clouds.event(spark, d).groupBy(F.floor(F.col("X") / 10).cast("int").alias("col"), F.floor((100 - F.col("Y")) / 10).cast("int").alias("row"))
    return cells.agg(F.max("Z").alias("band1"), F.min("Z").alias("band2"), F.count("*").cast("double").alias("band3"))


RASTER = f"(SELECT floor(X / 10)::INTEGER AS col, floor((100 - Y) / 10)::INTEGER AS row, max(Z) AS band1, min(Z) AS band2, count(*)::DOUBLE AS band3 FROM {EVENT} GROUP BY ALL)"
FRAME = (0.0, 100.0, 10.0, 10.0)


@query(f"SELECT pid, round(band1 * 2, 6) AS red, band3 AS blue FROM {EVENT} e JOIN {RASTER} r ON r.col = floor(X / 10) AND r.row = floor((100 - Y) / 10)")
def colorization(spark, d):
    return pointwise.colorization(clouds.event(spark, d), _raster(spark, d), FRAME, "Red:1:2.0,Blue:3:1.0").select("pid", F.round(F.col("Red"), 6).alias("red"), F.col("Blue").alias("blue"))


# selection


@query(f"SELECT count(*)::BIGINT AS n, round(sum(Z), 2) AS z FROM {LINE} WHERE (X BETWEEN 5 AND 10 OR (X > 30 AND X <= 35)) AND NOT (Classification BETWEEN 2 AND 3)")
def range_filter(spark, d):
    return select.range_filter(clouds.line(spark, d), "X[5:10],X(30:35],Classification![2:3]").agg(F.count("*").alias("n"), F.round(F.sum("Z"), 2).alias("z"))


@query(f"SELECT pid FROM {EVENT} WHERE (X > 20 AND Z < 50) OR NOT (Classification = 2 OR floor(Y / 2) = 3)")
def expression_filter(spark, d):
    return select.expression(clouds.event(spark, d), "(X > 20 && Z < 50) || !(Classification == 2 || floor(Y / 2) == 3)").select("pid")


@query(f"SELECT pid, 0 AS view FROM {EVENT} WHERE X > 20 UNION ALL SELECT pid, 1 FROM {EVENT} WHERE Z < 10")
def expression_views(spark, d):
    return select.expression(clouds.event(spark, d), ["X > 20", "Z < 10"]).select("pid", "view")


@query(f"SELECT pid FROM {EVENT} WHERE (Classification IN (1, 3) OR Z >= 90) AND NOT (X < Y)")
def mongo_filter(spark, d):
    return select.mongo_filter(clouds.event(spark, d), {"$and": [{"$or": [{"Classification": {"$in": [1, 3]}}, {"Z": {"$gte": 90}}]}, {"$nor": [{"X": {"$lt": "Y"}}]}]}).select("pid")


@query(f"SELECT count(*)::BIGINT AS n, round(sum(Z), 2) AS z FROM {LINE} WHERE X BETWEEN 10 AND 40 AND Y BETWEEN 20 AND 70")
def crop_box(spark, d):
    return select.crop(clouds.line(spark, d), BOX).agg(F.count("*").alias("n"), F.round(F.sum("Z"), 2).alias("z"))


@query(f"SELECT pid FROM {EVENT} WHERE NOT ((X - 50) * (X - 50) + (Y - 12) * (Y - 12) < 400)")
def crop_circle_outside(spark, d):
    return select.crop(clouds.event(spark, d), point=[(50.0, 12.0)], distance=20.0, outside=True).select("pid")


_EDGES = [(10, 10, 40, 10), (40, 10, 40, 60), (40, 60, 25, 90), (25, 90, 10, 60), (10, 60, 10, 10)]
_CROSS = " + ".join(f"CASE WHEN ({y1} > Y) <> ({y2} > Y) AND X < {x1} + (Y - {y1}) * ({x2} - {x1}) / {float(y2 - y1) or 1.0} THEN 1 ELSE 0 END" for x1, y1, x2, y2 in _EDGES)


@query(f"SELECT count(*)::BIGINT AS n, round(sum(Z), 2) AS z FROM {LINE} WHERE X BETWEEN 10 AND 40 AND Y BETWEEN 10 AND 90 AND ({_CROSS}) % 2 = 1")
def crop_polygon(spark, d):
    return select.crop(clouds.line(spark, d), polygon=POLYGON).agg(F.count("*").alias("n"), F.round(F.sum("Z"), 2).alias("z"))


@query(f"SELECT pid FROM {EVENT} e JOIN {RASTER} r ON r.col = floor(X / 10) AND r.row = floor((100 - Y) / 10) WHERE Z >= band1 - 20 AND Z <= band1 + 5")
def dem_filter(spark, d):
    return select.dem(clouds.event(spark, d), _raster(spark, d), FRAME, "Z[20:5]").select("pid")


_RANKED = f"(SELECT Z, row_number() OVER (ORDER BY Z) - 1 AS rn, count(*) OVER () AS n FROM {EVENT})"


@query(f"SELECT pid FROM {EVENT}, (SELECT max(Z) FILTER (rn = (n * 0.25)::BIGINT - CASE WHEN (n * 0.25)::BIGINT > n * 0.25 THEN 1 ELSE 0 END) AS q1, max(Z) FILTER (rn = floor(n * 0.75)::BIGINT) AS q3 FROM {_RANKED}) WHERE Z > q1 - 0.5 * (q3 - q1) AND Z < q3 + 0.5 * (q3 - q1)")
def iqr(spark, d):
    return select.iqr(clouds.event(spark, d), "Z", 0.5).select("pid")


@query(f"""WITH m AS (SELECT max(Z) FILTER (rn = n // 2) AS med FROM {_RANKED}), a AS (SELECT abs(Z - med) AS v, row_number() OVER (ORDER BY abs(Z - med)) - 1 AS rn, count(*) OVER () AS n FROM {EVENT}, m), s AS (SELECT max(v) FILTER (rn = n // 2) * 1.4862 AS mad FROM a)
SELECT pid FROM {EVENT}, m, s WHERE abs(Z - med) / mad < 1.5""")
def mad(spark, d):
    return select.mad(clouds.event(spark, d), "Z", 1.5).select("pid")


@query(f"SELECT pid FROM (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS rn FROM {EVENT}) WHERE rn >= 5 AND (rn - 5) % 7 = 0")
def decimate_step(spark, d):
    return select.decimation(clouds.event(spark, d), 7, 5).select("pid")


@query(f"""WITH r AS (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS rn, count(*) OVER () AS n FROM {EVENT}) SELECT pid FROM r WHERE rn IN (SELECT round(i * 4.2)::BIGINT FROM range(0, 10000000) t(i) WHERE i < (SELECT round(max(n) / 4.2) FROM r))""")
def decimate_fraction(spark, d):
    return select.decimation(clouds.event(spark, d), 4.2).select("pid")


@query(f"SELECT pid, Z AS z FROM {EVENT} ORDER BY pid LIMIT 25")
def head(spark, d):
    return select.head(clouds.event(spark, d), 25).select("pid", F.col("Z").alias("z"))


@query(f"SELECT pid FROM (SELECT pid, row_number() OVER (ORDER BY pid) AS rn FROM {EVENT}) WHERE rn > 25")
def head_invert(spark, d):
    return select.head(clouds.event(spark, d), 25, True).select("pid")


@query(f"SELECT pid, Z AS z FROM {EVENT} ORDER BY pid DESC LIMIT 25")
def tail(spark, d):
    return select.tail(clouds.event(spark, d), 25).select("pid", F.col("Z").alias("z"))


@query(f"SELECT pid, Z AS z FROM {EVENT} ORDER BY Z DESC, pid LIMIT 1")
def locate_max(spark, d):
    return select.locate(clouds.event(spark, d), "Z").select("pid", F.col("Z").alias("z"))


@query(f"SELECT pid, coalesce((SELECT min(id) FROM range(0, 25) t(id) WHERE X BETWEEN id * 4 AND id * 4 + 6 AND Y BETWEEN 2 AND 20 AND X < id * 4 + 6 AND Y < 20), -1)::INTEGER AS zone FROM {EVENT}")
def overlay(spark, d):
    nations = clouds.read(spark, d, "nation")
    box = "array(named_struct('x1', x0, 'y1', 2.0D, 'x2', x0 + 6, 'y2', 2.0D), named_struct('x1', x0 + 6, 'y1', 2.0D, 'x2', x0 + 6, 'y2', 20.0D), named_struct('x1', x0 + 6, 'y1', 20.0D, 'x2', x0, 'y2', 20.0D), named_struct('x1', x0, 'y1', 20.0D, 'x2', x0, 'y2', 2.0D))"
    polys = nations.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("value"), (F.col("n_nationkey") * 4.0).cast("double").alias("x0")).select("id", "value", F.expr(box).alias("edges"))
    df = clouds.event(spark, d).withColumn("Zone", F.lit(-1))
    return select.overlay(df, polys, "Zone").select("pid", F.col("Zone").cast("int").alias("zone"))


@query(f"SELECT pid, round(CASE WHEN X > 10 AND X < 40 AND Y > 5 AND Y < 15 THEN 0 ELSE sqrt(pow(greatest(10 - X, 0, X - 40), 2) + pow(greatest(5 - Y, 0, Y - 15), 2)) END, 6) AS distance FROM {EVENT}")
def geomdistance(spark, d):
    return select.geomdistance(clouds.event(spark, d), "POLYGON ((10 5, 40 5, 40 15, 10 15, 10 5))").select("pid", r6("distance"))


@query(f"SELECT pid FROM {EVENT} WHERE Z > 50")
def streamcallback(spark, d):
    return select.streamcallback(clouds.event(spark, d), lambda f: f["Z"] > 50).select("pid")


# partitioning


@query(f"SELECT tx::INTEGER AS tile_x, ty::INTEGER AS tile_y, count(*)::BIGINT AS n FROM (SELECT trunc((X - 25) / 10) - CASE WHEN X - 25 < 0 THEN 1 ELSE 0 END AS tx, trunc((Y - 50) / 20) - CASE WHEN Y - 50 < 0 THEN 1 ELSE 0 END AS ty FROM (SELECT X, l.Y FROM {LINE} l)) GROUP BY ALL")
def splitter_tiles(spark, d):
    df = partition.splitter(clouds.line(spark, d).withColumn("X", F.col("X")), 10.0, 25.0, 50.0)
    df = df.withColumn("tile_y", partition.tile_index(F.col("Y"), 50.0, 20.0))
    return df.groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"))


@query(f"SELECT pid, ((row_number() OVER (ORDER BY pid) - 1) % 10)::BIGINT AS view FROM {EVENT}")
def divider_round_robin(spark, d):
    return partition.divider(clouds.event(spark, d), "round_robin", count=10).select("pid", "view")


@query(f"SELECT pid, ((row_number() OVER (ORDER BY pid) - 1) // ((count(*) OVER () - 1) // 10 + 1))::BIGINT AS view FROM {EVENT}")
def divider_partition(spark, d):
    return partition.divider(clouds.event(spark, d), "partition", count=10).select("pid", "view")


@query(f"SELECT pid, sum(CASE WHEN Z > 95 THEN 1 ELSE 0 END) OVER (ORDER BY pid)::BIGINT AS view FROM {EVENT}")
def divider_expression(spark, d):
    return partition.divider(clouds.event(spark, d), "expression", expression="Z > 95").select("pid", F.col("view").cast("long").alias("view"))


@query(f"SELECT view, count(*)::BIGINT AS n FROM (SELECT dense_rank() OVER (ORDER BY f) - 1 AS view FROM (SELECT min(pid) OVER (PARTITION BY Classification) AS f FROM {EVENT})) GROUP BY view")
def groupby_views(spark, d):
    return partition.groupby(clouds.event(spark, d), "Classification").groupBy(F.col("view").cast("long").alias("view")).agg(F.count("*").alias("n"))


@query(f"SELECT Classification::BIGINT AS key, count(*)::BIGINT AS n, round(avg(Z), 6) AS z FROM {LINE} GROUP BY ALL")
def groupby_count(spark, d):
    return clouds.line(spark, d).groupBy(partition.group_key("Classification").alias("key")).agg(F.count("*").alias("n"), F.round(F.avg("Z"), 6).alias("z"))


@query(f"SELECT CASE WHEN ReturnNumber = 1 THEN 'first' WHEN ReturnNumber = 7 THEN 'last' ELSE 'intermediate' END AS view, count(*)::BIGINT AS n FROM {LINE} GROUP BY ALL")
def returns(spark, d):
    return partition.returns(clouds.line(spark, d), ["first", "intermediate", "last", "only"]).groupBy("view").agg(F.count("*").alias("n"))


@query(f"SELECT pid, (coalesce(sum(CASE WHEN Classification = 2 THEN 1 ELSE 0 END) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 3)::BIGINT AS view FROM {EVENT}")
def separatescanline(spark, d):
    df = clouds.event(spark, d).withColumn("EdgeOfFlightLine", (F.col("Classification") == 2).cast("int"))
    return partition.separatescanline(df, 3).select("pid", F.col("view").cast("long").alias("view"))


@query()
def chipper(spark, d):
    chips = partition.chipper(clouds.event(spark, d), 500)
    return chips.groupBy("view").agg(F.count("*").alias("n"), F.min("X").alias("x0"), F.max("X").alias("x1"))


@query(f"SELECT count(*)::BIGINT AS n, round(sum(x), 2) AS x FROM (SELECT X AS x FROM {EVENT} UNION ALL SELECT X FROM {VECTOR})")
def merge(spark, d):
    return partition.merge(clouds.event(spark, d), clouds.vector(spark, d)).agg(F.count("*").alias("n"), F.round(F.sum("X"), 2).alias("x"))


# aggregates


@query(" UNION ALL ".join(f"SELECT '{c}' AS dimension, count({c})::BIGINT AS count, min({c})::DOUBLE AS minimum, max({c})::DOUBLE AS maximum, round(avg({c}), 4) AS average, round(var_samp({c}), 2) AS variance, round(stddev_samp({c}), 4) AS stddev FROM {LINE}" for c in ("X", "Z", "Intensity")))
def stats_basic(spark, d):
    s = aggregate.stats(clouds.line(spark, d), "X,Z,Intensity")
    return s.select("dimension", "count", "minimum", "maximum", F.round("average", 4).alias("average"), F.round("variance", 2).alias("variance"), F.round("stddev", 4).alias("stddev"))


_MOMENTS = f"(SELECT count(*)::DOUBLE AS n, sum(pow(Z - m, 2)) AS m2, sum(pow(Z - m, 3)) AS m3, sum(pow(Z - m, 4)) AS m4 FROM {EVENT}, (SELECT avg(Z) AS m FROM {EVENT}))"


@query(f"SELECT 'Z' AS dimension, round(sqrt(n) * m3 / pow(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2), 6) AS skewness, round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * n * m4 / (m2 * m2) - 3 * (n - 1)), 6) AS kurtosis FROM {_MOMENTS}")
def stats_advanced(spark, d):
    return aggregate.stats(clouds.event(spark, d), "Z", advanced=True).select("dimension", F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))


@query(f"WITH m AS (SELECT max(Z) FILTER (rn = n // 2) AS med FROM {_RANKED}), a AS (SELECT abs(Z - med) AS v, row_number() OVER (ORDER BY abs(Z - med)) - 1 AS rn, count(*) OVER () AS n FROM {EVENT}, m) SELECT 'Z' AS dimension, round((SELECT med FROM m), 6) AS median, round(max(v) FILTER (rn = n // 2), 6) AS mad FROM a")
def stats_global(spark, d):
    return aggregate.stats(clouds.event(spark, d), "Z", global_=True).select("dimension", r6("median"), r6("mad"))


@query(f"SELECT Classification::DOUBLE AS value, count(*)::BIGINT AS count FROM {LINE} GROUP BY ALL")
def stats_count(spark, d):
    return aggregate.stats_values(clouds.line(spark, d), "Classification")


@query(f"SELECT 'Z > 50' AS expression, Classification::DOUBLE AS value, count(*)::BIGINT AS count FROM {EVENT} WHERE Z > 50 GROUP BY ALL UNION ALL SELECT 'X < 20', Classification::DOUBLE, count(*) FROM {EVENT} WHERE X < 20 GROUP BY ALL UNION ALL SELECT 'X < -1', NULL, NULL")
def expressionstats(spark, d):
    return aggregate.expressionstats(clouds.event(spark, d), "Classification", ["Z > 50", "X < 20", "X < -1"])


@query(f"SELECT count(*)::BIGINT AS count, min(X) AS minx, max(X) AS maxx, min(Y) AS miny, max(Y) AS maxy, min(Z) AS minz, max(Z) AS maxz FROM {LINE}")
def info(spark, d):
    return aggregate.info(clouds.line(spark, d))


@query(f"SELECT pid FROM (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS rn FROM {EVENT}) WHERE rn IN (0, 3, 10, 11, 12)")
def info_points(spark, d):
    return aggregate.info_points(clouds.event(spark, d), "0,3,10-12").select("pid")


@query(f"SELECT pid FROM {EVENT} ORDER BY pow(X - 50, 2) + pow(Y - 12, 2) + pow(Z - 30, 2), pid LIMIT 5")
def info_query(spark, d):
    return aggregate.info_query(clouds.event(spark, d), "50,12,30/5").select("pid")


@query(f"SELECT floor(X / 5)::INTEGER AS col, floor(Y / 25)::INTEGER AS row, min(Z) AS min, max(Z) AS max, round(avg(Z), 2) AS mean, count(*)::DOUBLE AS count, round(stddev_pop(Z), 2) AS stdev, round(quantile_cont(Z, 0.9), 4) AS p90 FROM (SELECT X, Y * 5 AS Y, Z FROM {LINE}) GROUP BY ALL".replace("floor(Y / 25)", "floor(Y / 5)"))
def gdal_bin(spark, d):
    df = clouds.line(spark, d).withColumn("Y", F.col("Y") * 5)
    r = aggregate.rasterize(df, 5.0, binmode=True, output_type=["min", "max", "mean", "count", "stdev", "p90"], origin=(0.0, 0.0))
    return r.select("col", "row", "min", "max", F.round("mean", 2).alias("mean"), "count", F.round("stdev", 2).alias("stdev"), F.round("p90", 4).alias("p90"))


@query(f"""SELECT col::INTEGER AS col, row::INTEGER AS row, count(*)::DOUBLE AS count, round(avg(Z), 6) AS mean, round(coalesce(min(CASE WHEN dd = 0 THEN Z END), sum(CASE WHEN dd > 0 THEN Z / dd END) / sum(CASE WHEN dd > 0 THEN 1 / dd END)), 6) AS idw
FROM (SELECT col, row, Z, sqrt(pow(X - (col + 0.5) * 4, 2) + pow(Y - (row + 0.5) * 4, 2)) AS dd FROM (SELECT *, unnest(range(greatest(0, floor(X / 4)::BIGINT - 2), floor(X / 4)::BIGINT + 3)) AS col FROM {EVENT}), (SELECT unnest(range(-2, 3)) AS up), LATERAL (SELECT floor(Y / 4)::BIGINT + up AS row) WHERE row >= 0) WHERE dd < 4 * sqrt(2) GROUP BY ALL""")
def gdal_radius(spark, d):
    r = aggregate.rasterize(clouds.event(spark, d), 4.0, output_type=["count", "mean", "idw"], origin=(0.0, 0.0))
    return r.select("col", "row", "count", r6("mean"), r6("idw"))


@query()
def gdal_window(spark, d):
    return aggregate.rasterize(clouds.event(spark, d), 1.0, binmode=True, output_type=["mean"], window_size=2, origin=(0.0, 0.0)).select("col", "row", F.round(F.col("mean") + 1e-7, 3).alias("mean"))


@query()
def hexbin(spark, d):
    return aggregate.hexbin(clouds.event(spark, d), edge_length=5.0)


@query(f"SELECT pid, CASE WHEN row_number() OVER (PARTITION BY floor(X / 10), floor(Y / 10) ORDER BY Z DESC, pid) = 1 THEN 9 ELSE Classification END::INTEGER AS classification FROM {EVENT}")
def grid_decimation(spark, d):
    return aggregate.grid_decimation(clouds.event(spark, d), 10.0, "max", "Classification = 9").select("pid", F.col("Classification").cast("int").alias("classification"))


# order


@query(f"SELECT pid AS old, (row_number() OVER (ORDER BY Z, Y, X, pid) - 1)::BIGINT AS place FROM {EVENT}")
def sort(spark, d):
    return order.sort(clouds.event(spark, d).withColumn("old", F.col("pid")), "X,Y,Z").select("old", F.col("pid").alias("place"))


_BITS = " | ".join(f"((((xs >> {i}) & 1) << {2 * i}) | (((ys >> {i}) & 1) << {2 * i + 1}))" for i in range(31))


@query(f"""SELECT pid AS old, (row_number() OVER (ORDER BY {_BITS}, pid) - 1)::BIGINT AS place FROM (SELECT pid, trunc((X - x0) / (x1 - x0) * 2147483647)::BIGINT AS xs, trunc((Y - y0) / (y1 - y0) * 2147483647)::BIGINT AS ys FROM {EVENT}, (SELECT min(X) AS x0, max(X) AS x1, min(Y) AS y0, max(Y) AS y1 FROM {EVENT}))""")
def mortonorder(spark, d):
    return order.mortonorder(clouds.event(spark, d).withColumn("old", F.col("pid"))).select("old", F.col("pid").alias("place"))


@query()
def randomize(spark, d):
    return order.randomize(clouds.event(spark, d).withColumn("old", F.col("pid")), 7).select("old", F.col("pid").alias("place"))


@query(f"SELECT pid, CASE WHEN X = lag(X) OVER w AND Classification = lag(Classification) OVER w THEN 1 ELSE 0 END::INTEGER AS duplicate FROM (SELECT *, row_number() OVER (ORDER BY X, Classification, pid) AS o FROM {EVENT}) WINDOW w AS (ORDER BY o)")
def label_duplicates(spark, d):
    df = order.sort(clouds.event(spark, d).withColumn("old", F.col("pid")), "Classification,X")
    return order.label_duplicates(df, "X,Classification").select(F.col("old").alias("pid"), F.col("Duplicate").cast("int").alias("duplicate"))


# voxels and sampling


@query(f"SELECT pid FROM (SELECT pid, row_number() OVER (PARTITION BY floor((X - x0) / 8), floor((Y - y0) / 8), floor((Z - z0) / 8) ORDER BY pid) AS k FROM {EVENT}, (SELECT arg_min(X, pid) - 4 AS x0, arg_min(Y, pid) - 4 AS y0, arg_min(Z, pid) - 4 AS z0 FROM {EVENT})) WHERE k = 1")
def voxel_first(spark, d):
    return voxel.voxeldownsize(clouds.event(spark, d), 8.0, "first").select("pid")


_VC = f"(SELECT pid, X, Y, Z, floor((X - x0) / 8) AS a, floor((Y - y0) / 8) AS b, floor((Z - z0) / 8) AS c, x0, y0, z0 FROM {EVENT}, (SELECT min(X) AS x0, min(Y) AS y0, min(Z) AS z0 FROM {EVENT}))"


@query(f"SELECT pid FROM (SELECT pid, row_number() OVER (PARTITION BY a, b, c ORDER BY pow(X - ((a + 0.5) * 8 + x0), 2) + pow(Y - ((b + 0.5) * 8 + y0), 2) + pow(Z - ((c + 0.5) * 8 + z0), 2), pid) AS k FROM {_VC}) WHERE k = 1")
def voxel_center_nearest(spark, d):
    return voxel.voxelcenternearestneighbor(clouds.event(spark, d), 8.0).select("pid")


@query()
def voxel_centroid_nearest(spark, d):
    return voxel.voxelcentroidnearestneighbor(clouds.event(spark, d), 8.0).select("pid")


@query()
def sample(spark, d):
    return voxel.sample(clouds.vector(spark, d), 0.06).select("pid")


@query()
def relaxation_dart_throwing(spark, d):
    return voxel.relaxationdartthrowing(clouds.vector(spark, d), 60, 0.2, 0.6).select("pid")


@query()
def farthest_point_sampling(spark, d):
    return voxel.fps(clouds.vector(spark, d), 12).select("pid")


# neighbourhoods, against a cross join of the small vector table

_PAIRS = f"(SELECT a.pid AS pid, b.pid AS nid, pow(a.X - b.X, 2) + pow(a.Y - b.Y, 2) + pow(a.Z - b.Z, 2) AS d2, b.Classification AS c, b.Z AS nz, row_number() OVER (PARTITION BY a.pid ORDER BY pow(a.X - b.X, 2) + pow(a.Y - b.Y, 2) + pow(a.Z - b.Z, 2), b.pid) AS k FROM {VECTOR} a, {VECTOR} b)"


@query(f"SELECT pid, round(sqrt(max(d2)), 6) AS kth, round(sum(sqrt(d2)) / 5, 6) AS average FROM {_PAIRS} WHERE k BETWEEN 2 AND 6 GROUP BY pid")
def nn_distance(spark, d):
    df = clouds.vector(spark, d)
    kth = neighbors.nndistance(df, "kth", 5).select("pid", r6("NNDistance", "kth"))
    return kth.join(neighbors.nndistance(df, "avg", 5).select("pid", r6("NNDistance", "average")), "pid")


@query(f"SELECT pid, round(count(*) / (4.0 / 3.0 * 3.14159 * pow(0.1, 3)), 4) AS density FROM {_PAIRS} WHERE d2 < 0.1 * 0.1 GROUP BY pid")
def radial_density(spark, d):
    return neighbors.radialdensity(clouds.vector(spark, d), 0.1).select("pid", F.round("RadialDensity", 4).alias("density"))


@query(f"""WITH e AS (SELECT * FROM {_PAIRS} WHERE k <= 6), kd AS (SELECT pid, sqrt(max(d2)) AS kd FROM e GROUP BY pid), l AS (SELECT e.pid, 1 / avg(greatest(kd.kd, sqrt(d2))) AS lrd FROM e JOIN kd ON kd.pid = e.nid GROUP BY e.pid)
SELECT e.pid AS pid, round(avg(n.lrd / o.lrd), 6) AS lof FROM e JOIN l n ON n.pid = e.nid JOIN l o ON o.pid = e.pid GROUP BY e.pid""")
def lof(spark, d):
    return neighbors.lof(clouds.vector(spark, d), 5).select("pid", r6("LocalOutlierFactor", "lof"))


@query(f"""WITH m AS (SELECT pid, sum(sqrt(d2)) / 8 AS m FROM {_PAIRS} WHERE k BETWEEN 2 AND 9 GROUP BY pid), t AS (SELECT avg(m) + 2 * stddev_samp(m) AS t FROM m)
SELECT v.pid, CASE WHEN m < t THEN v.Classification ELSE 7 END::INTEGER AS classification FROM {VECTOR} v JOIN m USING (pid), t""")
def outlier(spark, d):
    return neighbors.outlier(clouds.vector(spark, d)).select("pid", F.col("Classification").cast("int").alias("classification"))


@query(f"SELECT v.pid, CASE WHEN n > 3 THEN v.Classification ELSE 18 END::INTEGER AS classification FROM {VECTOR} v JOIN (SELECT pid, count(*) AS n FROM {_PAIRS} WHERE d2 < 0.08 * 0.08 GROUP BY pid) USING (pid)")
def outlier_radius(spark, d):
    return neighbors.outlier(clouds.vector(spark, d), "radius", min_k=3, radius=0.08, class_=18).select("pid", F.col("Classification").cast("int").alias("classification"))


@query(f"WITH e AS (SELECT pid, nid FROM {_PAIRS} WHERE k <= 9 AND pid <> nid) SELECT v.pid, coalesce(n, 0) * 100.0 / 8 AS reciprocity FROM {VECTOR} v LEFT JOIN (SELECT a.pid, count(*) AS n FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.pid = a.nid AND b.nid = a.pid) GROUP BY a.pid) USING (pid)")
def reciprocity(spark, d):
    return neighbors.reciprocity(clouds.vector(spark, d)).select("pid", F.col("Reciprocity").cast("double").alias("reciprocity"))


@query(f"SELECT v.pid, coalesce(w.c, v.Classification)::INTEGER AS classification FROM {VECTOR} v LEFT JOIN (SELECT pid, c FROM {_PAIRS} WHERE k <= 5 GROUP BY pid, c HAVING count(*) > 2.5) w USING (pid)")
def neighbor_vote(spark, d):
    return neighbors.neighborclassifier(clouds.vector(spark, d), 5).select("pid", F.col("Classification").cast("int").alias("classification"))


@query(f"SELECT v.pid, CASE WHEN v.Classification = 1 AND EXISTS (SELECT 1 FROM {VECTOR} w WHERE w.Classification = 2 AND pow(v.X - w.X, 2) + pow(v.Y - w.Y, 2) < 0.05 * 0.05) THEN 12 ELSE v.Classification END::INTEGER AS classification FROM {VECTOR} v")
def radius_assign(spark, d):
    return neighbors.radiusassign(clouds.vector(spark, d), 0.05, "Classification[1:1]", "Classification[2:2]", "Classification = 12").select("pid", F.col("Classification").cast("int").alias("classification"))


@query(f"SELECT v.pid, round(coalesce(s, v.Z), 6) AS z FROM {VECTOR} v LEFT JOIN (SELECT pid, quantile_cont(nz, 0.5) AS s FROM (SELECT a.pid, b.Z AS nz FROM {VECTOR} a, {VECTOR} b WHERE a.pid <> b.pid AND pow(a.X - b.X, 2) + pow(a.Y - b.Y, 2) < 0.1 * 0.1) GROUP BY pid) USING (pid)")
def zsmooth(spark, d):
    return neighbors.zsmooth(clouds.vector(spark, d), 0.1).select("pid", r6("Zsmooth", "z"))


@query(f"""WITH g AS (SELECT a.pid, b.Z AS z, pow(a.X - b.X, 2) + pow(a.Y - b.Y, 2) AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY pow(a.X - b.X, 2) + pow(a.Y - b.Y, 2), b.pid) AS k FROM {VECTOR} a, {VECTOR} b WHERE a.Classification <> 2 AND b.Classification = 2)
SELECT v.pid, round(CASE WHEN v.Classification = 2 THEN 0 ELSE v.Z - i END, 6) AS hag FROM {VECTOR} v LEFT JOIN (SELECT pid, sum(z / d2) / sum(1 / d2) AS i FROM g WHERE k <= 3 GROUP BY pid) USING (pid)""")
def hag_nn(spark, d):
    return neighbors.hag_nn(clouds.vector(spark, d), 3).select("pid", r6("HeightAboveGround", "hag"))


def _plain(fn, *columns: str, places: int = 5):
    def run(spark, d):
        return fn(clouds.vector(spark, d)).select("pid", *[F.round(F.col(c).cast("double"), places).alias(c.lower()) for c in columns])

    return run


for _name, _fn, _columns in (
    ("normal", neighbors.normal, ("NormalX", "NormalY", "NormalZ", "Curvature")),
    ("eigenvalues", neighbors.eigenvalues, ("Eigenvalue0", "Eigenvalue1", "Eigenvalue2")),
    ("covariance_features", neighbors.covariancefeatures, neighbors.FEATURES),
    ("approximate_coplanar", neighbors.approximatecoplanar, ("Coplanar",)),
    ("estimate_rank", neighbors.estimaterank, ("Rank",)),
    ("optimal_neighborhood", neighbors.optimalneighborhood, ("OptimalKNN", "OptimalRadius")),
    ("plane_fit", neighbors.planefit, ("PlaneFit",)),
    ("miniball", neighbors.miniball, ("Miniball",)),
):
    QUERIES[_name] = _plain(_fn, *_columns)


@query()
def m3c2(spark, d):
    df = clouds.vector(spark, d)
    out = neighbors.m3c2(df.where("pid % 2 = 0"), df.where("pid % 2 = 1"), df, 0.2, 0.15, 0.3)
    return out.select("pid", r6("m3c2_distance"), r6("m3c2_uncertainty"), "m3c2_count1", "m3c2_count2")


# ground


@query(f"""WITH c AS (SELECT pid, Classification, Z, floor(floor(X - x0) / 10) AS a, floor(floor(Y - y0) / 10) AS b FROM {EVENT}, (SELECT min(X) AS x0, min(Y) AS y0 FROM {EVENT})),
g AS (SELECT *, coalesce(lead(Z) OVER w - Z >= 0.05, false) AS far FROM c WINDOW w AS (PARTITION BY a, b ORDER BY Z, pid))
SELECT pid, CASE WHEN bool_and(far) OVER (PARTITION BY a, b ORDER BY Z, pid ROWS UNBOUNDED PRECEDING) THEN 7 ELSE Classification END::INTEGER AS classification FROM g""")
def elm(spark, d):
    return terrain.elm(clouds.event(spark, d), 10.0, 0.05).select("pid", F.col("Classification").cast("int").alias("classification"))


def _classes(fn, **options):
    def run(spark, d):
        return fn(clouds.event(spark, d), **options).select("pid", F.col("Classification").cast("int").alias("classification"))

    return run


QUERIES |= {
    "smrf": _classes(terrain.smrf, cell=5.0), "pmf": _classes(terrain.pmf, cell_size=5.0), "csf": _classes(terrain.csf, resolution=5.0, iterations=100),
    "skewness_balancing": _classes(terrain.skewnessbalancing), "sparse_surface": _classes(terrain.sparsesurface, radius=3.0),
}


@query()
def hag_delaunay(spark, d):
    return terrain.hag_delaunay(clouds.vector(spark, d), 6).select("pid", r6("HeightAboveGround", "hag"))


@query(f"SELECT pid, round(least(greatest(Z - band2, 1), 60), 6) AS hag FROM {EVENT} e JOIN {RASTER} r ON r.col = floor(X / 10) AND r.row = floor((100 - Y) / 10)")
def hag_dem(spark, d):
    return terrain.hag_dem(clouds.event(spark, d), _raster(spark, d), FRAME, band=2, zero_ground=False, min_clamp=1.0, max_clamp=60.0).select("pid", r6("HeightAboveGround", "hag"))


@query()
def sensor_trajectory(spark, d):
    df = clouds.line(spark, d).where("ReturnNumber IN (1, 7)").withColumn("Z", F.col("Z") + F.col("ReturnNumber"))
    return terrain.trajectory(df, 86400.0 * 365).select(*[F.round(c, 3).alias(c.lower()) for c in ("GpsTime", "X", "Y", "Z")])


# clusters and registration


@query(f"""WITH RECURSIVE e AS (SELECT pid, nid FROM {_PAIRS} WHERE d2 < 0.05 * 0.05), r AS (SELECT pid, pid AS root FROM {VECTOR} UNION SELECT e.nid, r.root FROM r JOIN e ON e.pid = r.pid), m AS (SELECT pid, min(root) AS root FROM r GROUP BY pid)
SELECT pid, dense_rank() OVER (ORDER BY root)::BIGINT AS clusterid FROM m""")
def euclidean_cluster(spark, d):
    return cluster.cluster(clouds.vector(spark, d), tolerance=0.05).select("pid", F.col("ClusterID").alias("clusterid"))


@query(f"""WITH RECURSIVE p AS (SELECT pid, nid FROM {_PAIRS} WHERE d2 < 0.08 * 0.08), c AS (SELECT pid FROM p GROUP BY pid HAVING count(*) >= 6), e AS (SELECT * FROM p WHERE pid IN (SELECT pid FROM c) AND nid IN (SELECT pid FROM c)),
r AS (SELECT pid, pid AS root FROM c UNION SELECT e.nid, r.root FROM r JOIN e ON e.pid = r.pid), m AS (SELECT pid, dense_rank() OVER (ORDER BY min(root)) - 1 AS k FROM r GROUP BY pid), b AS (SELECT p.pid, min(k) AS k FROM p JOIN m ON m.pid = p.nid GROUP BY p.pid)
SELECT v.pid, coalesce(m.k, b.k, -1)::BIGINT AS clusterid FROM {VECTOR} v LEFT JOIN m USING (pid) LEFT JOIN b USING (pid)""")
def dbscan(spark, d):
    return cluster.dbscan(clouds.vector(spark, d), 6, 0.08).select("pid", F.col("ClusterID").alias("clusterid"))


@query()
def lloyd_kmeans(spark, d):
    return cluster.lloydkmeans(clouds.vector(spark, d), 6, maxiters=4).select("pid", F.col("ClusterID").alias("clusterid"))


@query()
def litree(spark, d):
    df = clouds.vector(spark, d).withColumn("HeightAboveGround", F.abs("Z") * 100)
    return cluster.litree(df, 5, 3.0, 1.0).select("pid", F.col("ClusterID").alias("clusterid"))


@query()
def supervoxel(spark, d):
    return cluster.supervoxel(clouds.vector(spark, d), 12, 0.15).select("pid", F.col("ClusterID").alias("clusterid"))


@query()
def icp(spark, d):
    df = clouds.vector(spark, d)
    moved = df.withColumn("X", F.col("X") + 0.01)
    laid, _ = cluster.icp(df, moved, max_iter=8)
    return laid.select("pid", *[F.round(c, 4).alias(c.lower()) for c in "XYZ"])


@query()
def delaunay(spark, d):
    return mesh.delaunay(clouds.vector(spark, d))


@query()
def face_raster(spark, d):
    df = clouds.vector(spark, d)
    return mesh.faceraster(df, mesh.delaunay(df), 0.05, (-0.5, -0.5)).select("col", "row", r6("value"))


@query()
def greedy_projection(spark, d):
    return mesh.greedyprojection(neighbors.normal(clouds.vector(spark, d)), 0.2, num_neighbors=12)


# whole clouds against each other

from . import apps  # noqa: E402

_NEAR = f"(SELECT a.pid, min(pow(a.X - b.X, 2) + pow(a.Y - b.Y, 2) + pow(a.Z - b.Z, 2)) AS d2 FROM {VECTOR} a, {VECTOR} b WHERE a.Classification < 5 AND b.Classification >= 5 GROUP BY a.pid)"
_FAR = f"(SELECT a.pid, min(pow(a.X - b.X, 2) + pow(a.Y - b.Y, 2) + pow(a.Z - b.Z, 2)) AS d2 FROM {VECTOR} a, {VECTOR} b WHERE a.Classification >= 5 AND b.Classification < 5 GROUP BY a.pid)"


def _halves(spark, d):
    df = clouds.vector(spark, d)
    return df.where("Classification < 5"), df.where("Classification >= 5")


@query(f"SELECT round((SELECT sum(d2) FROM {_NEAR}) + (SELECT sum(d2) FROM {_FAR}), 6) AS chamfer")
def chamfer(spark, d):
    return apps.chamfer(*_halves(spark, d)).select(r6("chamfer"))


@query(f"SELECT round(greatest((SELECT sqrt(max(d2)) FROM {_NEAR}), (SELECT sqrt(max(d2)) FROM {_FAR})), 6) AS hausdorff, round(greatest((SELECT avg(sqrt(d2)) FROM {_NEAR}), (SELECT avg(sqrt(d2)) FROM {_FAR})), 6) AS modified")
def hausdorff(spark, d):
    return apps.hausdorff(*_halves(spark, d)).select(r6("hausdorff"), r6("modified"))


@query(f"""WITH n AS (SELECT a.pid, a.X AS ax, arg_min(b.X, pow(a.X - b.X, 2) + pow(a.Y - b.Y, 2) + pow(a.Z - b.Z, 2)) AS bx FROM {VECTOR} a, {VECTOR} b WHERE a.Classification < 5 AND b.Classification >= 5 GROUP BY a.pid, a.X)
SELECT 'X' AS dimension, round(min(bx - ax), 6) AS min, round(max(bx - ax), 6) AS max, round(avg(bx - ax), 6) AS mean FROM n""")
def delta(spark, d):
    return apps.delta(*_halves(spark, d), dimensions=("X", "Y", "Z")).where("dimension = 'X'").select("dimension", r6("min"), r6("max"), r6("mean"))


@query(f"""WITH n AS (SELECT a.Classification AS p, arg_min(b.Classification, pow(a.X - b.X, 2) + pow(a.Y - b.Y, 2) + pow(a.Z - b.Z, 2)) AS t FROM {VECTOR} a, {VECTOR} b WHERE a.pid % 2 = 0 AND b.pid % 2 = 1 GROUP BY a.pid, a.Classification),
l AS (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL), c AS (SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t <> label AND p = label) AS fp, count(*) FILTER (t = label AND p <> label) AS fn FROM l, n GROUP BY label)
SELECT label::INTEGER AS label, (tp + fn)::BIGINT AS support, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS iou, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision FROM c""")
def evaluation(spark, d):
    df = clouds.vector(spark, d)
    labels = sorted(r[0] for r in df.select("Classification").distinct().where("Classification IS NOT NULL").collect())
    per, _ = apps.evaluate(df.where("pid % 2 = 0"), df.where("pid % 2 = 1"), labels)
    return per.select("label", "support", r6("iou"), r6("precision"))


@query()
def ground_preset(spark, d):
    return apps.ground(clouds.vector(spark, d), cell=0.1).select("pid", F.col("Classification").cast("int").alias("classification"))


@query(f"SELECT pid, X * 2 AS x FROM {EVENT} WHERE Z > 50")
def json_pipeline(spark, d):
    from . import pipeline

    stages = [{"type": "readers.buffer", "frame": "@events"}, {"type": "filters.range", "limits": "Z(50:]"}, {"type": "filters.assign", "value": "X = X * 2"}]
    return pipeline.run(spark, stages, {"events": clouds.event(spark, d)}).points.select("pid", F.col("X").alias("x"))


@query("SELECT i::BIGINT AS pid, 10 + i * (90.0 / 999) AS x FROM range(0, 1000) t(i)")
def faux_ramp(spark, d):
    from ..sources import synthetic

    return synthetic.faux(spark, "ramp", 1000, "([10,100],[0,1],[0,1])").select("pid", F.round("X", 6).alias("x"))


SQL["faux_ramp"] = "SELECT i::BIGINT AS pid, round(10 + i * (90.0 / 999), 6)::DOUBLE AS x FROM range(0, 1000) t(i)"


SQL["gdal_window"] = f"""WITH b AS (SELECT floor(X)::INTEGER AS col, floor(Y)::INTEGER AS row, avg(Z) AS mean FROM {EVENT} GROUP BY ALL),
n AS (SELECT b.col + dc AS col, b.row + dr AS row, mean, 1.0 / greatest(abs(dc), abs(dr)) AS w FROM b, range(-2, 3) x(dc), range(-2, 3) y(dr) WHERE dc <> 0 OR dr <> 0),
f AS (SELECT col, row, sum(mean * w) / sum(w) AS mean FROM n WHERE col BETWEEN 0 AND (SELECT max(col) FROM b) AND row BETWEEN 0 AND (SELECT max(row) FROM b) AND NOT EXISTS (SELECT 1 FROM b WHERE b.col = n.col AND b.row = n.row) GROUP BY ALL)
SELECT col::INTEGER AS col, row::INTEGER AS row, round(mean + 1e-7, 3) AS mean FROM (SELECT * FROM b UNION ALL SELECT * FROM f)"""
SQL["hexbin"] = f"""WITH p AS (SELECT X - (SELECT arg_min(X, pid) FROM {EVENT}) AS x, Y - (SELECT arg_min(Y, pid) FROM {EVENT}) AS y, 5 * sqrt(3) AS h, 3 / (2 * sqrt(3)) * (5 * sqrt(3)) AS w FROM {EVENT}),
c AS (SELECT *, floor(x / w) AS col FROM p), o AS (SELECT *, (((col::BIGINT % 2) + 2) % 2) <> 0 AS odd FROM c),
r AS (SELECT *, floor((CASE WHEN odd THEN y - h / 2 ELSE y END) / h) AS row FROM o),
t AS (SELECT *, x - col * w - w * 2 / 3 AS xr, (CASE WHEN odd THEN y - h / 2 ELSE y END) - row * h AS yr, (h / 2) / (w / 3) AS s FROM r),
u AS (SELECT CASE WHEN xr > 0 AND yr - h / 2 > h / 2 - s * xr THEN col + 1 WHEN xr > 0 AND h / 2 - yr > h / 2 - s * xr THEN col + 1 ELSE col END AS hx,
  CASE WHEN xr > 0 AND yr - h / 2 > h / 2 - s * xr THEN CASE WHEN odd THEN row + 1 ELSE row END WHEN xr > 0 AND h / 2 - yr > h / 2 - s * xr THEN CASE WHEN odd THEN row ELSE row - 1 END ELSE row END AS hy FROM t)
SELECT hx::BIGINT AS hex_x, hy::BIGINT AS hex_y, count(*)::BIGINT AS count, count(*) >= 15 AS dense FROM u GROUP BY ALL"""
SQL["voxel_centroid_nearest"] = f"""WITH v AS (SELECT pid, X, Y, Z, x0, y0, z0, floor((X - x0) / 8) AS a, floor((Y - y0) / 8) AS b, floor((Z - z0) / 8) AS c FROM {EVENT}, (SELECT arg_min(X, pid) AS x0, arg_min(Y, pid) AS y0, arg_min(Z, pid) AS z0 FROM {EVENT})),
m AS (SELECT *, count(*) OVER w AS n, avg(X) OVER w AS mx, avg(Y) OVER w AS my, avg(Z) OVER w AS mz FROM v WINDOW w AS (PARTITION BY a, b, c)),
d AS (SELECT pid, a, b, c, n, CASE WHEN n = 2 THEN pow(X - ((a + 0.5) * 8 + x0), 2) + pow(Y - ((b + 0.5) * 8 + y0), 2) + pow(Z - ((c + 0.5) * 8 + z0), 2) ELSE pow(X - mx, 2) + pow(Y - my, 2) + pow(Z - mz, 2) END AS d2 FROM m)
SELECT pid FROM (SELECT pid, row_number() OVER (PARTITION BY a, b, c ORDER BY d2, CASE WHEN n = 2 THEN -pid ELSE pid END) AS k FROM d) WHERE k = 1"""
SQL["skewness_balancing"] = f"""WITH r AS (SELECT pid, Z - (SELECT avg(Z) FROM {EVENT}) AS z, row_number() OVER (ORDER BY Z, pid) AS rn FROM {EVENT}),
s AS (SELECT pid, rn, sum(z) OVER w / rn AS m, sum(z * z) OVER w / rn AS q, sum(z * z * z) OVER w / rn AS c FROM r WINDOW w AS (ORDER BY rn)),
k AS (SELECT pid, rn, CASE WHEN q - m * m > 1e-300 THEN (c - 3 * m * q + 2 * m * m * m) / pow(q - m * m, 1.5) ELSE 0 END AS skew FROM s),
x AS (SELECT max(rn) AS top FROM (SELECT rn, skew, lag(skew) OVER (ORDER BY rn) AS before FROM k) WHERE before < 0 AND skew > 0)
SELECT pid, CASE WHEN top IS NULL OR rn < top THEN 2 ELSE 1 END::INTEGER AS classification FROM k, x"""
