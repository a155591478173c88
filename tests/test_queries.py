"""Registered queries over small tables whose values go beyond those of the driver tables."""

import datetime
import math
from collections import defaultdict

import pytest

from pointloom.plans.queries import QUERIES

USERS = [0, 1, 2, 7, 100, 239, 240, 700, 1000, 1001, 1499, 1499]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with an events table, and its X, Y and Z by pid."""
    folder = str(tmp_path_factory.mktemp("events"))
    rows = [(i, u, datetime.datetime(2024, 1, 1, 2 * i % 24), float(i + 1), "click") for i, u in enumerate(USERS)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double, event_type string").write.parquet(f"{folder}/events.parquet")
    return folder, [(float(u), float(ts.hour), z) for _, u, ts, z, _ in rows]


def test_straighten_returns_every_row(spark, events):
    folder, points = events
    got = {r.pid: (r.along, r.across, r.up) for r in QUERIES["straighten"](spark, folder).collect()}
    assert got == dict(enumerate(points))


def test_gdal_radius_returns_every_cell(spark, events):
    folder, points = events
    want = defaultdict(list)
    for x, y, z in points:
        for col in range(400):
            for row in range(10):
                if math.hypot(x - (col + 0.5) * 4, y - (row + 0.5) * 4) < 4 * math.sqrt(2):
                    want[col, row].append(z)
    got = {(r.col, r.row): (r["count"], r["mean"]) for r in QUERIES["gdal_radius"](spark, folder).collect()}
    assert got == {k: (len(v), round(sum(v) / len(v), 6)) for k, v in want.items()}


def test_gdal_window_takes_every_event(spark, events):
    folder, points = events
    held = defaultdict(list)
    for x, y, z in points:
        held[int(x), int(y)].append(z)
    mean = {k: sum(v) / len(v) for k, v in held.items()}
    want = dict(mean)
    right, top = (max(k[i] for k in mean) for i in range(2))
    around = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a or b]
    for cell in {(c + a, r + b) for c, r in mean for a, b in around} - set(mean):
        if 0 <= cell[0] <= right and 0 <= cell[1] <= top:
            near = [(mean[k], 1 / max(abs(a), abs(b))) for a, b in around if (k := (cell[0] + a, cell[1] + b)) in mean]
            want[cell] = sum(m * w for m, w in near) / sum(w for _, w in near)
    got = {(r.col, r.row): r["mean"] for r in QUERIES["gdal_window"](spark, folder).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-3 for k in want)


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """A folder with an embeddings table of ten labels, the last row's null."""
    folder = str(tmp_path_factory.mktemp("vectors"))
    rows = [(i, [i // 2 * 0.01, i % 4 * 0.02, 0.0], i // 2 % 10) for i in range(60)] + [(60, [0.0, 0.0, 0.0], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_m3c2_takes_every_point_as_core(spark, vectors):
    got = QUERIES["m3c2"](spark, vectors).collect()
    assert sorted(r.pid for r in got) == list(range(61))
    assert all(r.m3c2_distance is not None for r in got)


def test_evaluation_has_every_label(spark, vectors):
    got = {r.label: r.support for r in QUERIES["evaluation"](spark, vectors).collect()}
    assert set(got) == set(range(10)) and sum(got.values()) == 31  # one for each row of an even pid
