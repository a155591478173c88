import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import aggregate, cluster, mesh, neighbors, order, partition, pointwise, select, terrain, voxel
from pointloom.plans import apps, ordering


def pids(df):
    return sorted(r.pid for r in df.select("pid").collect())


def test_moments(cloud):
    df = cloud([(x, 0, 0) for x in (1, 5, 8, 25, 20, 17)])
    s = aggregate.stats(df, "X", advanced=True).first()
    assert s["average"] == pytest.approx(12.6667, abs=1e-4)
    assert s["variance"] == pytest.approx(88.2667, abs=1e-4)
    assert s["skewness"] == pytest.approx(0.07653332827)
    assert s["kurtosis"] == pytest.approx(-1.862062002)


def test_moments_of_a_constant(cloud):
    s = aggregate.stats(cloud([(55.2, 0, 0)] * 5), "X", advanced=True).first()
    assert (s["variance"], s["skewness"], s["kurtosis"]) == (0, 0, 0)


def test_chamfer_and_hausdorff(cloud):
    a, b = cloud([(0, 0, 0)]), cloud([(1, 0, 0), (0, 2, 0)])
    assert apps.chamfer(a, b).first().chamfer == 6
    assert apps.chamfer(a, cloud([(1, 0, 0), (0, 0, 3)])).first().chamfer == 11
    assert apps.hausdorff(a, b).first().hausdorff == 2


def test_divider(cloud):
    df = cloud([(i, 0, 0) for i in range(1000)])
    sizes = lambda d: [r["count"] for r in d.groupBy("view").count().orderBy("view").collect()]
    assert sizes(partition.divider(df, count=10)) == [100] * 10
    assert sizes(partition.divider(df, "round_robin", capacity=25)) == [25] * 40
    assert sizes(partition.divider(df, "expression", expression="X == 499")) == [499, 501]


def test_decimation(cloud):
    df = cloud([(i, 0, 0) for i in range(30)])
    assert pids(select.decimation(df, 10)) == [0, 10, 20]
    assert len(pids(select.decimation(df, 4.2))) == 7
    assert pids(select.decimation(df, 10, offset=40)) == []


def test_locate_skips_nan(cloud):
    df = cloud([(float("nan"), 0, 0), (2, 0, 0), (5, 0, 0), (5, 0, 0)])
    assert pids(select.locate(df, "X", "max")) == [2]
    assert pids(select.locate(df, "X", "min")) == [1]
    assert pids(select.locate(cloud([(float("nan"), 0, 0)] * 2), "X")) == [0]


def test_tiles_of_negative_multiples(cloud):
    df = cloud([(-10, 0, 0), (-5, 0, 0), (0, 0, 0), (10, 0, 0)])
    t = {r.pid: r.tile_x for r in partition.splitter(df, 10.0, 0.0, 0.0).collect()}
    assert t == {0: -2, 1: -1, 2: 0, 3: 1}


def test_buffered_tiles_copy_rows(cloud):
    df = cloud([(1, 5, 0), (5, 5, 0), (9, 9, 0)])
    n = {r.pid: r["count"] for r in partition.splitter(df, 10.0, 0.0, 0.0, buffer=2.0).groupBy("pid").count().collect()}
    assert n == {0: 2, 1: 1, 2: 4}


def test_sort_last_key_is_primary(cloud):
    df = cloud([(1, 2, 0), (2, 1, 0), (3, 1, 0)])
    out = order.sort(df.withColumn("old", F.col("pid")), "X,Y").orderBy("pid").collect()
    assert [r.old for r in out] == [1, 2, 0]


def test_iqr_and_mad(cloud):
    df = cloud([(x, 0, 0) for x in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]])
    assert 9 not in pids(select.iqr(df, "X")) and len(pids(select.iqr(df, "X"))) == 9
    assert 9 not in pids(select.mad(df, "X"))
    assert pids(select.mad(cloud([(1, 0, 0)] * 5), "X")) == []


def test_crop_regions(cloud):
    df = cloud([(x, y, 0) for x in range(5) for y in range(5)])
    assert select.crop(df, "([1,3],[1,3])").count() == 9
    assert select.crop(df, ["([1,3],[1,3])", "([0,0],[0,4])"]).count() == 14
    assert select.crop(df, point=[(2, 2)], distance=1.0).count() == 1
    assert select.crop(df, polygon="POLYGON((-0.5 -0.5, 2.5 -0.5, 2.5 2.5, -0.5 2.5, -0.5 -0.5), (0.5 0.5, 1.5 0.5, 1.5 1.5, 0.5 1.5, 0.5 0.5))").count() == 8


def test_transformation_and_inverse(cloud):
    df = cloud([(1, 2, 3)])
    m = "0 -1 0 5  1 0 0 6  0 0 2 7  0 0 0 1"
    r = pointwise.transformation(pointwise.transformation(df, m), m, invert=True).first()
    assert (r.X, r.Y, r.Z) == pytest.approx((1, 2, 3))


def test_utm_round_trip(cloud):
    df = cloud([(3.1, 48.5, 10), (2.2, -33.0, 0)])
    for zone in ("EPSG:32631", "EPSG:3857"):
        back = pointwise.reprojection(pointwise.reprojection(df, "EPSG:4326", zone), zone, "EPSG:4326").orderBy("pid").collect()
        assert [(r.X, r.Y) for r in back] == [pytest.approx((3.1, 48.5), abs=1e-8), pytest.approx((2.2, -33.0), abs=1e-8)]
    e = pointwise.reprojection(cloud([(3.0, 0.0, 0)]), "EPSG:4326", "EPSG:32631").first()
    assert (e.X, e.Y) == pytest.approx((500000, 0), abs=1e-3)


def test_gps_unwrap(cloud):
    df = cloud([(604799.5,), (0.5,), (1.5,)], "GpsTime")
    assert [r.GpsTime for r in pointwise.gps_unwrap(df).orderBy("pid").collect()] == [604799.5, 604800.5, 604801.5]


def test_skewness_balancing(cloud):
    df = cloud([(0, 0, i - 5) for i in range(11)])
    assert "Classification" in terrain.skewnessbalancing(df).columns


def test_elm_counts(cloud):
    df = cloud([(0, 0, z) for z in (0, 5, 10, 10.1, 10.2, 10.3)])
    assert terrain.elm(df).where("Classification = 7").count() == 2


def brute_knn(p, k):
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    return np.array([np.lexsort((np.arange(len(p)), row))[:k] for row in d2]), d2


@pytest.fixture(scope="module")
def scattered():
    r = np.random.default_rng(3)
    return np.round(np.vstack([r.normal(0, 1, (150, 3)), r.normal(8, 0.1, (60, 3)), [[100, 100, 100]], np.zeros((3, 3))]), 2)


def neighbours(query, reference, k):
    got = {}
    for r in neighbors.knn(query, reference, k).collect():
        got.setdefault(r.pid, {})[r["rank"]] = r.nid
    return {i: [g[j + 1] for j in range(len(g))] for i, g in got.items()}


def test_knn_matches_brute_force(cloud, scattered):
    want, _ = brute_knn(scattered, 7)
    assert neighbours(cloud(scattered.tolist()), cloud(scattered.tolist()), 7) == dict(enumerate(want.tolist()))


def test_knn_of_a_crowded_cell(cloud):
    """Half of the rows in one small place, a third of them in the very same."""
    r = np.random.default_rng(8)
    p = np.vstack([r.random((100, 3)) * 1000, r.random((60, 3)) * 0.01, np.full((50, 3), 5.0)])
    want, _ = brute_knn(p, 5)
    assert neighbours(cloud(p.tolist()), cloud(p.tolist()), 5) == dict(enumerate(want.tolist()))


def test_knn_of_far_rows(cloud, scattered):
    q = np.array([[1e7, 0, 0], [0, -5e6, 3], [9, 9, 9], [2000, 100, -40000]])
    d2 = ((q[:, None] - scattered[None]) ** 2).sum(2)
    want = [np.lexsort((np.arange(len(scattered)), row))[:6].tolist() for row in d2]
    assert neighbours(cloud(q.tolist()), cloud(scattered.tolist()), 6) == dict(enumerate(want))


def test_few_rows_have_no_kth_neighbour(cloud):
    assert [r.NNDistance for r in neighbors.nndistance(cloud([(0, 0, 0), (1, 0, 0)]), "kth", 5).collect()] == [0, 0]


def test_radius_pairs_match_brute_force(cloud, scattered):
    _, d2 = brute_knn(scattered, 1)
    want = {(i, j) for i, j in zip(*np.nonzero(d2 < 0.64), strict=True)}
    df = cloud(scattered.tolist())
    assert {(r.pid, r.nid) for r in neighbors.radius_pairs(df, df, 0.8).collect()} == want


def test_greedy_sample_is_sequential(cloud, scattered):
    kept = []
    for i, p in enumerate(scattered):
        if all(((p - scattered[j]) ** 2).sum() >= 0.49 for j in kept):
            kept.append(i)
    assert pids(voxel.sample(cloud(scattered.tolist()), 0.7)) == kept


def test_farthest_points(cloud, scattered):
    picks, d = [0], np.full(len(scattered), np.inf)
    for _ in range(7):
        d = np.minimum(d, ((scattered - scattered[picks[-1]]) ** 2).sum(1))
        picks.append(int(d.argmax()))
    assert pids(voxel.fps(cloud(scattered.tolist()), 8)) == sorted(picks)


def test_eigenvalues_match_numpy(cloud, scattered):
    want, _ = brute_knn(scattered, 8)
    for r in neighbors.eigenvalues(cloud(scattered.tolist())).collect():
        v = np.linalg.eigvalsh(np.cov(scattered[want[r.pid]].T))
        assert (r.Eigenvalue0, r.Eigenvalue1, r.Eigenvalue2) == pytest.approx(v, rel=1e-4, abs=1e-5)


def test_normals_of_a_plane(cloud):
    df = cloud([(x, y, 0) for x in range(5) for y in range(5)])
    for r in neighbors.normal(df).collect():
        assert (r.NormalX, r.NormalY, r.NormalZ, r.Curvature) == pytest.approx((0, 0, 1, 0), abs=1e-6)


def test_dbscan_and_cluster(cloud):
    df = cloud([(x * 0.1, 0, 0) for x in range(10)] + [(50 + x * 0.1, 0, 0) for x in range(10)] + [(99, 0, 0)])
    labels = {r.pid: r.ClusterID for r in cluster.dbscan(df, 3, 0.25).collect()}
    assert [labels[i] for i in (0, 10, 20)] == [0, 1, -1]
    ids = {r.pid: r.ClusterID for r in cluster.cluster(df, min_points=2, tolerance=0.25).collect()}
    assert [ids[i] for i in (0, 10, 20)] == [1, 2, 0]


def test_icp_finds_a_shift(cloud, scattered):
    a = cloud(scattered[:150].tolist())
    _, found = cluster.icp(a, cloud((scattered[:150] + [0.02, -0.01, 0.03]).tolist()), max_iter=20)
    assert np.array(found["transform"]).reshape(4, 4)[:3, 3] == pytest.approx([-0.02, 0.01, -0.03], abs=1e-3)


def test_delaunay_is_delaunay():
    p = np.random.default_rng(1).random((40, 2))
    tri = mesh.triangulate(p)
    area = sum(abs(np.cross(np.append(p[b] - p[a], 0), np.append(p[c] - p[a], 0))[2]) / 2 for a, b, c in tri)
    hull = p[list(_hull(p))]
    want = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, np.roll(hull, -1, 0), strict=True))) / 2
    assert area == pytest.approx(want, rel=1e-3)


def _hull(p):
    idx = sorted(range(len(p)), key=lambda i: tuple(p[i]))

    def half(order):
        out = []
        for i in order:
            while len(out) > 1 and np.cross(np.append(p[out[-1]] - p[out[-2]], 0), np.append(p[i] - p[out[-1]], 0))[2] <= 0:
                out.pop()
            out.append(i)
        return out[:-1]

    return half(idx) + half(idx[::-1])


def test_distributed_order(cloud, monkeypatch):
    monkeypatch.setattr(ordering, "SINGLE_TASK_ROWS", 10)
    monkeypatch.setattr(ordering, "BLOCK", 7)
    df = cloud([((i * 37) % 100, 0, 0) for i in range(100)])
    ranked = ordering.with_rank(df, "X")
    assert {r.X: r["rank"] for r in ranked.collect()} == {float(i): i for i in range(100)}
    summed = ordering.running_sum(ranked, F.col("X"), "s")
    assert {r.X: r.s for r in summed.collect()} == {float(i): i * (i + 1) / 2 for i in range(100)}
    before = ordering.previous(ranked, ["X"])
    assert {r.X: r.prev_X for r in before.collect()} == {float(i): (float(i - 1) if i else None) for i in range(100)}


def test_hexagon_counts_cover_all(cloud):
    r = np.random.default_rng(5).random((300, 2)) * 20
    df = cloud([(x, y, 0) for x, y in r])
    cells = aggregate.hexbin(df, edge_length=2.0, threshold=1, origin=(0.0, 0.0))
    assert cells.agg(F.sum("count")).first()[0] == 300
    from pointloom.operators.geometry import edges_of  # noqa: F401

    h = 2.0 * math.sqrt(3)
    for c in cells.collect():
        assert len(aggregate.hex_polygon(c.hex_x, c.hex_y, h, (0.0, 0.0))) == 6
    assert aggregate.hex_boundary(cells, h, (0.0, 0.0)).startswith("MULTIPOLYGON ((")


def test_empty_clouds(cloud):
    e = cloud([(0, 0, 0)]).where("X > 1")
    for fn in (lambda d: select.head(d, 3), lambda d: select.decimation(d, 2), lambda d: order.sort(d, "X"), lambda d: voxel.voxeldownsize(d, 1.0), lambda d: neighbors.radialdensity(d), lambda d: voxel.sample(d, 1.0), lambda d: select.iqr(d, "X")):
        assert fn(e).count() == 0


def test_user_code(cloud):
    from pointloom.operators import udf

    df = cloud([(i % 2, 0, i) for i in range(10)])
    assert udf.python(df, lambda f: f[f["Z"] > 5]).count() == 4
    assert {r.X: r.value for r in udf.aggregate(df, ["X"], lambda v: v.max() - v.min(), "Z").collect()} == {0.0: 8.0, 1.0: 8.0}
    with pytest.raises(PermissionError):
        udf.shell(df, "true")
    with pytest.raises(NotImplementedError):
        udf.h3(df, 5)


def test_skewness_of_low_rows_under_far_ones(cloud):
    """The sign of the low rows' skewness is not lost in sums about a far mean."""
    low = [0.0, 0.8, 0.9, 1.0, 1.1, 1.3, 2.0, 3.0]  # from the eighth row on their skewness is positive
    df = cloud([(0, 0, z) for z in [*low, *(1e6 + i for i in range(5))]])
    got = terrain.skewnessbalancing(df).where("Classification = 2").collect()
    assert sorted(r.Z for r in got) == low[:7]


def test_voxel_centroid_tie_takes_the_first_row(cloud):
    """Two rows are equally near to their voxel's mean, but for the rounding of its sum."""
    df = cloud([(-4, -4, -4), (2.75, 0.59, 1.53), (1.09, 3.73, 2.39), (3.82, 2.16, 1.96), (0.02, 2.16, 1.96)]).coalesce(1)
    assert sorted(r.pid for r in voxel.voxelcentroidnearestneighbor(df, 4.0).collect()) == [0, 1]


def test_delaunay_fills_the_hull():
    """A flat triangle at the hull, and 20,000 points in less time than a scan of all triangles takes."""
    import time

    assert {tuple(sorted(t)) for t in mesh.triangulate(np.array([(0.0, 0.0), (1.0, 0.0), (0.5, 1.0), (0.5, 1e-5)]))} == {(0, 1, 3), (1, 2, 3), (0, 2, 3)}
    p = np.random.default_rng(3).normal(size=(20_000, 2))
    began = time.time()
    tri = mesh.triangulate(p)
    assert len(tri) == 2 * len(p) - 2 - len(_hull(p))  # Euler
    assert time.time() - began < 60
