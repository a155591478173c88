from pointloom import streaming
from pointloom.operators import pointwise, select

SCHEMA = "pid long, X double, Y double, Z double, GpsTime double"


def _table(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def _stream(spark, cloud, tmp_path):
    for k in range(3):
        df = cloud([(i % 4, 0, i, k * 3600 + i) for i in range(20)], "X", "Y", "Z", "GpsTime").selectExpr(f"pid + {k * 20} as pid", "X", "Y", "Z", "GpsTime")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return streaming.read_stream(spark, str(tmp_path / "in"), SCHEMA)


def test_stateless(spark, cloud, tmp_path):
    s = _stream(spark, cloud, tmp_path)
    out = _table(spark, pointwise.assign(select.range_filter(s, "Z[5:9]"), "Z = Z * 2"), "stateless")
    assert sorted(r.Z for r in out.collect()) == sorted([10.0, 12, 14, 16, 18] * 3)


def test_voxels(spark, cloud, tmp_path):
    s = streaming.with_event_time(_stream(spark, cloud, tmp_path), watermark="10 hours")
    assert _table(spark, streaming.voxel_first(s, 1.0).select("X", "Z"), "voxels").count() == 20


def test_counted_head(spark, cloud, tmp_path):
    s = _stream(spark, cloud, tmp_path)
    out = _table(spark, streaming.head(s, 2, "X"), "heads")
    assert out.count() == 8


def test_batches(spark, cloud, tmp_path):
    got = []
    streaming.run_batches(_stream(spark, cloud, tmp_path), lambda b: select.head(b, 1), lambda b, i: got.append(b.count()), str(tmp_path / "cp")).awaitTermination(120)
    assert sum(got) == 3
