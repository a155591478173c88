import json

import numpy as np
import pytest

from pointloom import sources
from pointloom.plans import apps, pipeline
from pointloom.sources import binary, sinks, text


@pytest.fixture
def points(cloud):
    return cloud([(1.25, 2.5, 3.75, 100, 5), (10.5, 20.25, -3.0, 200, 6), (7.0, 8.0, 9.0, 300, 7)], "X", "Y", "Z", "Intensity", "GpsTime")


def xyz(df):
    return [(r.X, r.Y, r.Z) for r in df.orderBy("pid").collect()]


@pytest.mark.parametrize("name", ["a.las", "a.ply", "a.pcd", "a.bpf", "a.sbet", "a.spz"])
def test_round_trips(spark, points, tmp_path, name):
    path = str(tmp_path / name)
    sources.write(points, path)
    assert xyz(sources.read(spark, path)) == [pytest.approx(p, abs=0.01) for p in xyz(points)]


def test_binary_variants(spark, points, tmp_path):
    for name, options in (("b.ply", {"storage_mode": "little"}), ("b.pcd", {"compression": "binary"}), ("b.las", {"minor_version": 2})):
        sources.write(points, str(tmp_path / name), **options)
        assert xyz(sources.read(spark, str(tmp_path / name))) == [pytest.approx(p, abs=0.01) for p in xyz(points)]


def test_las_fields(spark, cloud, tmp_path):
    df = cloud([(1, 2, 3, 5, 1, 2, 2, 40000, 12.5, 7)], "X", "Y", "Z", "Classification", "ReturnNumber", "NumberOfReturns", "UserData", "Intensity", "GpsTime", "Red")
    sources.write(df, str(tmp_path / "f.las"))
    r = sources.read(spark, str(tmp_path / "f.las")).first()
    assert (r.Classification, r.ReturnNumber, r.NumberOfReturns, r.Intensity, r.GpsTime, r.Red) == (5, 1, 2, 40000, 12.5, 7)


def test_a_file_for_each_view(spark, points, tmp_path):
    from pyspark.sql import functions as F

    sources.write(points.withColumn("view", F.col("pid") % 2), str(tmp_path / "v#.las"))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["v1.las", "v2.las"]


def test_text(spark, tmp_path):
    for name, body in (("a.txt", "X Y Z\n1 2 3\n4 5 6\n"), ("b.csv", '"X","Y","Z"\r\n1,2,3\r\n4,5,6\r\n'), ("c.xyz", "junk\nX;Y;Z\n1;2;3\n4;5;6\n")):
        p = tmp_path / name
        p.write_text(body)
        assert xyz(text.read_text(spark, str(p), skip=1 if name == "c.xyz" else 0)) == [(1, 2, 3), (4, 5, 6)]
    bad = tmp_path / "bad.txt"
    bad.write_text("X Y X\n1 2 3\n")
    with pytest.raises(ValueError, match="twice"):
        text.read_text(spark, str(bad))


def test_pts_ptx_obj(spark, tmp_path):
    (tmp_path / "a.pts").write_text("2\n1 2 3 -2048 10 20 30\n4 5 6 2047 1 2 3\n")
    r = sources.read(spark, str(tmp_path / "a.pts")).orderBy("pid").collect()
    assert [(x.X, x.Intensity, x.Red) for x in r] == [(1, 0, 10), (4, 4095, 1)]
    (tmp_path / "a.ptx").write_text("1\n2\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n1 0 0 0\n0 1 0 0\n0 0 1 0\n10 0 0 1\n1 2 3 0.5\n0 0 0 0\n")
    assert xyz(sources.read(spark, str(tmp_path / "a.ptx"))) == [(11, 2, 3)]
    (tmp_path / "a.obj").write_text("v 1 2 3\nvn 0 0 1\nv 4 5 6\nf 1 2 1\n")
    assert xyz(sources.read(spark, str(tmp_path / "a.obj"))) == [(1, 2, 3), (4, 5, 6)]


def test_lzf_and_compressed_pcd():
    assert binary._lzf(bytes([2]) + b"abc" + bytes([(4 << 5) | 0, 2]), 9) == b"abcabcabc"


def test_faux(spark):
    assert sources.read(spark, driver="readers.faux", mode="grid", bounds="([0,2],[0,3],[0,1])").count() == 6
    u = sources.synthetic.faux(spark, "uniform", 1000).toPandas()
    assert 0 <= u.X.min() and u.X.max() <= 1 and abs(u.X.mean() - 0.5) < 0.05
    n = sources.synthetic.faux(spark, "normal", 2000, seed=3).toPandas()
    assert abs(n.X.mean()) < 0.1 and abs(n.X.std() - 1) < 0.1


def test_unavailable_drivers_say_so(spark):
    with pytest.raises(NotImplementedError):
        sources.read(spark, "x", "readers.e57")
    with pytest.raises(ValueError):
        sources.read(spark, "x.unknown")


def test_tile_index(spark, cloud, tmp_path):
    for i in range(3):
        cloud([(i * 10 + k, 0, 0) for k in range(5)]).write.parquet(str(tmp_path / f"t{i}"))
    index = apps.tindex(spark, [str(tmp_path / f"t{i}") for i in range(3)])
    df = sources.catalogs.read_tindex(spark, index, "([9,13],[-1,1])")
    assert sorted(r.X for r in df.collect()) == [10, 11, 12, 13]


def test_stac(spark, points, tmp_path):
    points.write.parquet(str(tmp_path / "p"))
    items = {"type": "FeatureCollection", "features": [{"id": n, "bbox": [0, 0, 30, 30], "properties": {"datetime": d}, "assets": {"data": {"href": str(tmp_path / "p")}}} for n, d in (("a", "2020"), ("b", "2021"))]}
    (tmp_path / "c.json").write_text(json.dumps(items))
    df = sources.catalogs.read_stac(spark, str(tmp_path / "c.json"), items=["a"], driver="readers.arrow")
    assert df.count() == 3
    with pytest.raises(ValueError):
        sources.catalogs.read_stac(spark, str(tmp_path / "c.json"), date_ranges=[("2030", "2031")], driver="readers.arrow")


def test_ept(spark, tmp_path):
    (tmp_path / "ept-data").mkdir()
    (tmp_path / "ept-hierarchy").mkdir()
    schema = [{"name": n, "type": "signed", "size": 4, "scale": 0.01, "offset": 0} for n in "XYZ"]
    (tmp_path / "ept.json").write_text(json.dumps({"bounds": [0, 0, 0, 8, 8, 8], "span": 2, "dataType": "binary", "schema": schema}))
    (tmp_path / "ept-hierarchy/0-0-0-0.json").write_text(json.dumps({"0-0-0-0": 1, "1-0-0-0": 1, "1-1-1-1": 1}))
    for key, p in (("0-0-0-0", (4, 4, 4)), ("1-0-0-0", (1, 1, 1)), ("1-1-1-1", (7, 7, 7))):
        (tmp_path / f"ept-data/{key}.bin").write_bytes((np.array([p]) * 100).astype("<i4").tobytes())
    assert sorted(r.X for r in sources.catalogs.read_ept(spark, str(tmp_path / "ept.json")).collect()) == [1, 4, 7]
    assert sorted(r.X for r in sources.catalogs.read_ept(spark, str(tmp_path / "ept.json"), resolution=4.0).collect()) == [4]
    assert sorted(r.X for r in sources.catalogs.read_ept(spark, str(tmp_path / "ept.json"), bounds="([0,2],[0,2],[0,2])").collect()) == [1]


def test_pipeline(spark, tmp_path):
    (tmp_path / "in.txt").write_text("X Y Z\n" + "".join(f"{i} {i} {i}\n" for i in range(20)))
    out = str(tmp_path / "out.las")
    r = pipeline.run(spark, json.dumps({"pipeline": [str(tmp_path / "in.txt"), {"type": "filters.range", "limits": "Z[5:14]"}, {"type": "filters.stats", "tag": "s", "dimensions": "Z"}, {"type": "filters.assign", "value": "Z = Z * 2", "where": "X > 9"}, out]}))
    assert r.reports["s"].first()["count"] == 10
    assert [p[2] for p in xyz(sources.read(spark, out))] == [5, 6, 7, 8, 9, 20, 22, 24, 26, 28]


def test_pipeline_errors():
    for bad in ("[]", "{}", '[{"x": 1}]', '[{"type": "odd.thing"}]', '["a.las", {"type": "filters.range", "tag": "t"}, {"type": "filters.head", "tag": "t"}]'):
        with pytest.raises(pipeline.PipelineError):
            pipeline.parse(bad)
    with pytest.raises(pipeline.PipelineError):
        pipeline.validate(["a.las", {"type": "filters.teaser"}])
    assert pipeline.validate(["a.las", {"type": "filters.head"}, "b.ply"]) == ["readers.las", "filters.head", "writers.ply"]


def test_gltf_and_geojson(spark, points, tmp_path):
    sources.write(points, str(tmp_path / "m.gltf"))
    assert json.loads((tmp_path / "m.gltf").read_text())["accessors"][1]["count"] == 3
    sources.write(points, str(tmp_path / "g.geojson"))
    lines = spark.read.text(str(tmp_path / "g.geojson")).collect()
    assert json.loads(lines[0].value)["geometry"]["type"] == "Point"


def test_raster_text_round_trip(spark, cloud, tmp_path):
    df = cloud([(0.5, 0.5, 1), (1.5, 0.5, 2), (0.5, 1.5, 3)])
    sinks.write_raster(df, str(tmp_path / "r.asc"), 1.0, binmode=True, output_type="max", origin=(0.0, 0.0))
    got = sorted((r.X, r.Y, r.Z) for r in sources.read(spark, str(tmp_path / "r.asc")).collect())
    assert got == [(0.5, 0.5, 1), (0.5, 1.5, 3), (1.5, 0.5, 2)]
