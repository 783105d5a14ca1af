"""Keyframes, thinning, relaxation, regions and the whole way of a scan."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodegrid.operators import keyframes as K
from lodegrid.plans import rejection
from lodegrid.streaming.flows import Hooks

P = "frame_id long, point_id long, x double, y double, z double"


def test_overlap_keyframes(spark):
    cells = [["a", "b"], ["a", "b"], ["b", "c", "d"], ["x", "y"], ["x", "z"]]
    rows = spark.createDataFrame([(0, i, c) for i, c in enumerate(cells)], "seq_id long, frame_id long, cells array<string>")
    out = {r["frame_id"]: (r["is_keyframe"], r["evicted"]) for r in K.by_overlap(rows, 0.8, 0.1, 5).collect()}
    assert out == {0: (True, []), 1: (False, []), 2: (True, []), 3: (True, [0, 2]), 4: (True, [])}


def test_distance_keyframes(spark):
    rows = spark.createDataFrame([(0, i, float(x), 0.0, 0.0) for i, x in enumerate((0, 1, 2, 2.1, 9))], "seq_id long, frame_id long, ox double, oy double, oz double")
    out = [(r["frame_id"], r["evicted"]) for r in K.by_distance(rows, 4).collect()]
    assert out == [(4, 2)]  # of the crowded two, the one further from the newest


def test_entropy_keyframes(spark):
    rows = spark.createDataFrame([(0, i, e) for i, e in enumerate((2.0, 3.0, 1.0, 1.4, 1.6))], "seq_id long, frame_id long, entropy double")
    out = [(r["is_keyframe"], r["evicted"]) for r in K.by_entropy(rows, 1.0, 2).orderBy("frame_id").collect()]
    assert out == [(True, None), (False, None), (True, None), (True, 0), (False, None)]


def test_thinning(spark):
    rng = random.Random(1)
    rows = [(0, i, *[rng.uniform(0, 8) for _ in range(3)]) for i in range(300)]
    got = {r["point_id"] for r in K.thinned(spark.createDataFrame(rows, P), 4.0, 1.0, 6).collect()}
    taken = {}
    for r in rows:
        cell = taken.setdefault(tuple(int(v // 4) for v in r[2:]), [])
        if len(cell) < 6 and all(sum((a - b) ** 2 for a, b in zip(r[2:], k[2:])) >= 1 for k in cell):
            cell.append(r)
    assert got == {r[1] for c in taken.values() for r in c}


def test_relaxation_like_a_dense_solution(spark):
    rng = np.random.default_rng(3)
    true = rng.uniform(0, 5, (5, 3))
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (1, 4)]
    edges = [(i, j, *(true[j] - true[i]).tolist(), 1.0) for i, j in pairs]
    nodes = spark.createDataFrame([(i, *(true[i] if i == 0 else true[i] + 1).tolist(), i == 0) for i in range(5)], "node long, x double, y double, z double, fixed boolean")
    out = K.relaxed(nodes, spark.createDataFrame(edges, "i long, j long, dx double, dy double, dz double, weight double"), 24, 0.0)
    for r in out.collect():
        assert np.allclose([r["x"], r["y"], r["z"]], true[r["node"]], atol=0.2)


def test_chain(spark):
    turn = [0.0, -1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    rows = spark.createDataFrame([(0, i, turn) for i in range(4)], "k long, i long, m array<double>")
    last = K.chained(rows, "k", "i", "m").orderBy("i").collect()[-1]["world"]
    assert np.allclose(np.array(last).reshape(4, 4), np.linalg.matrix_power(np.array(turn).reshape(4, 4), 4))


def test_region(spark):
    pts = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in range(6)] + [(0, 9, 30.0, 0.0, 0.0)], P)
    normals = pts.select("frame_id", "point_id", F.lit(0.0).alias("nx"), (F.col("point_id") >= 3).cast("double").alias("ny"), (F.col("point_id") < 3).cast("double").alias("nz"))
    assert sorted(r["point_id"] for r in K.grown(pts, normals, 0, 1.5, 10).collect()) == [0, 1, 2]


def test_nearest_nodes_of_two_maps(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 50.0, 0.0, 0.0)], "id long, x double, y double, z double")
    b = spark.createDataFrame([(7, 90.0, 0.0, 0.0), (8, 0.0, 60.0, 0.0)], "id long, x double, y double, z double")
    assert tuple(K.closest_pair(a, b, 1.0).first()) == (2, 7, 1600.0)


def test_moving_object_is_rejected(spark):
    rng = np.random.default_rng(4)
    rows = []
    for f in range(3):
        still = np.concatenate([np.column_stack([rng.uniform(0, 20, (200, 2)), np.zeros(200)]), rng.uniform(0, 1, (60, 3)) * [1, 1, 2] + [3, 3, 1]])
        car = rng.uniform(0, 1, (80, 3)) * [1.5, 1, 1] + [8 + 1.4 * f, 12, 1]
        rows += [(f, i, *map(float, p)) for i, p in enumerate(np.concatenate([still, car]))]
    out = rejection.rejected(spark.createDataFrame(rows, P), 1.0, 0.5, 1.6, 2, 2).where("frame_id > 0").collect()
    car = [r["is_dynamic"] for r in out if r["point_id"] >= 260]
    still = [r["is_dynamic"] for r in out if r["point_id"] < 260]
    assert len(out) == 2 * 340 and sum(still) == 0 and sum(car) > 0.4 * len(car)


def test_hooks(spark):
    hooks = Hooks()
    n = hooks.add("raw", lambda df: df.where("id > 1"))
    assert hooks.apply("raw", spark.range(4)).count() == 2
    hooks.remove("raw", n)
    assert hooks.apply("raw", spark.range(4)).count() == 4
    hooks.register("m", lambda: 5)
    assert hooks.load("m") == 5
