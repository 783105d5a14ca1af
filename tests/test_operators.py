"""Operators against hand-made cases, brute force and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegrid.functions import geometry as G
from lodegrid.operators import clock, cloud, graph, ground, joins, merge, motion, moving
from lodegrid.sources import clouds

P = "frame_id long, point_id long, x double, y double, z double"


def cloud_of(spark, xyz, frame=0):
    return spark.createDataFrame([(frame, i, *map(float, p)) for i, p in enumerate(xyz)], P)


def test_range_is_strict_and_finite(spark):
    pts = cloud_of(spark, [(1, 0, 0), (2, 0, 0), (5, 0, 0), (float("nan"), 0, 0), (float("inf"), 0, 0), (3, 0, 0)])
    assert [r["point_id"] for r in cloud.range_filter(pts, 1, 5).orderBy("point_id").collect()] == [1, 5]


def test_crop_is_closed(spark):
    pts = cloud_of(spark, [(1, 1, 1), (1.01, 1, 1), (0, 0, 0)])
    assert [r["point_id"] for r in cloud.crop(pts, (0, 0, 0), (1, 1, 1)).collect()] == [1]
    with pytest.raises(ValueError):
        cloud.crop(pts, (2, 0, 0), (1, 1, 1))


def test_cells_of_negative_numbers(spark):
    assert spark.range(1).select(G.cell(F.lit(-0.1), 0.25)).first()[0] == -1


def test_rewinds(spark):
    rows = spark.createDataFrame([(0, i, int(s * 1e6)) for i, s in enumerate([1, 2, 1.5, 1.8, 2, 3])], "seq_id long, id long, us long")
    assert [r["us"] / 1e6 for r in clock.accepted(rows).where("accepted").orderBy("id").collect()] == [1, 2, 2, 3]
    assert [r["id"] for r in clock.audited(rows).where("rewinds").orderBy("id").collect()] == [2]


def test_upper_median(spark):
    rows = spark.createDataFrame([(0, float(v)) for v in (4, 1, 3, 2)], "k long, v double")
    assert clock.upper_median(rows, "k", F.col("v")).first()["median"] == 3


def test_bracket_status(spark):
    samples = spark.createDataFrame([(0, 10, 1.0), (0, 20, 3.0)], "seq_id long, us long, value double")
    at = spark.createDataFrame([(0, i, us) for i, us in enumerate((5, 10, 15, 25))], "seq_id long, id long, us long")
    got = {r["id"]: (r["status"], r["value"]) for r in clock.interpolated(clock.bracketed(at, samples, "value")).collect()}
    assert got == {0: ("failure", None), 1: ("success", 1.0), 2: ("success", 2.0), 3: ("waiting", None)}


def test_detector_box_lives_five_frames(spark):
    boxes = spark.createDataFrame([(0, 0)], "box_idx long, insert_frame long")
    frames = spark.range(10).select(F.col("id").alias("frame_id"))
    assert sorted(r["frame_id"] for r in joins.alive(boxes, frames).collect()) == [0, 1, 2, 3, 4]


def test_point_in_two_boxes_counts_for_the_first(spark):
    boxes = spark.createDataFrame([(3, *[0.0] * 3, *[2.0] * 3), (1, *[0.5] * 3, *[2.0] * 3)], "box_idx long, cx double, cy double, cz double, sx double, sy double, sz double")
    assert joins.first_box(cloud_of(spark, [(0.5, 0.5, 0.5)]), boxes).first()["box_idx"] == 1


def test_resting_box_takes_points_outside_its_corner(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    inside = lambda p: spark.range(1).select(G.in_inflated(lit(*p), lit(0, 0, 0), lit(2, 2, 2), lit(0, 0, 0))).first()[0]
    assert inside((0.99, 0.99, 0)) and inside((1.2, 0, 0)) and not inside((1.1, 1.1, 0)) and not inside((0, 0, 1.1))


def test_overlap_of_small_in_large(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    a, b = (lit(0, 0, 0), lit(1, 1, 1)), (lit(0, 0, 0), lit(10, 10, 10))
    o, i = spark.range(1).select(G.overlap(a, b), G.iou(a, b)).first()
    assert o == 1 and abs(i - 0.001) < 1e-12


def test_knn_with_too_few_points(spark):
    pts = cloud_of(spark, [(0, 0, 0), (1, 0, 0), (100, 0, 0)])
    got = sorted((r["point_id"], r["rank"], r["nbr_id"]) for r in joins.knn(pts, 5, 2.0).collect())
    assert got == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 1, 1), (1, 2, 0), (1, 3, 2), (2, 1, 2), (2, 2, 1), (2, 3, 0)]


def test_border_point_joins_the_earlier_cluster(spark):
    xyz = [(0, 0, 0), (0.5, 0, 0), (1, 0, 0), (1.9, 0, 0), (2.8, 0, 0), (3.3, 0, 0), (3.8, 0, 0), (50, 0, 0)]
    got = {r["point_id"]: r["cluster"] for r in moving.dbscan(cloud_of(spark, xyz), 1.0, 3).collect()}
    brute = {}
    near = lambda i: [j for j in range(len(xyz)) if j != i and abs(xyz[i][0] - xyz[j][0]) < 1.0]
    cores = [i for i in range(len(xyz)) if len(near(i)) >= 3]
    for c in cores:
        brute[c] = min(brute.get(c, c), *[brute[j] for j in near(c) if j in brute and j in cores] or [c])
    assert set(got) == set(brute) | {i for i in range(len(xyz)) if any(j in cores for j in near(i))}


def test_normals_like_numpy(spark):
    rng = np.random.default_rng(1)
    xyz = rng.normal(0, 1, (40, 3)) * [3, 2, 0.2] + [5, 0, 0]
    pts = cloud_of(spark, xyz)
    got = {r["point_id"]: np.array([r["nx"], r["ny"], r["nz"]]) for r in ground.normals(pts, joins.knn(pts, 8, 2.0)).collect()}
    for i, n in got.items():
        nbr = xyz[np.argsort(((xyz - xyz[i]) ** 2).sum(1), kind="stable")[:8]]
        want = np.linalg.eigh(np.cov(nbr.T, bias=True))[1][:, 0]
        assert abs(abs(want @ n) - 1) < 1e-6 and n @ xyz[i] <= 1e-9


def test_flattened_covariance(spark):
    n = np.array([0.6, 0.0, 0.8])
    got = np.array(spark.range(1).select(G.flattened(tuple(F.lit(float(v)) for v in n))).first()[0]).reshape(3, 3)
    q, _ = np.linalg.qr(np.column_stack([n, [0, 1, 0], [1, 0, 0]]))
    assert np.allclose(got, q @ np.diag([1e-3, 1, 1]) @ q.T)


def test_plane_support_by_counting(spark):
    rng = np.random.default_rng(2)
    xyz = np.concatenate([np.column_stack([rng.uniform(0, 9, (60, 2)), rng.normal(2, 0.02, 60)]), rng.uniform(0, 9, (30, 3))])
    pts = cloud_of(spark, xyz)
    best = ground.best_planes(pts, ground.hypotheses(pts, 30), 0.1).first()
    d = np.abs(xyz @ [best["nx"], best["ny"], best["nz"]] + best["d"])
    assert best["n_inliers"] == (d < 0.1).sum() >= 55
    fit = ground.refitted(pts, ground.best_planes(pts, ground.hypotheses(pts, 30), 0.1), 0.1).first()
    assert abs(abs(fit["nz"]) - 1) < 1e-2
    assert len(ground.planes_one_by_one(pts, 20, 0.1, 30, 3).collect()) == 1


def test_suppression_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(f, i, *[rng.uniform(0, 9) for _ in range(3)], *[rng.uniform(1, 5) for _ in range(3)]) for f in range(3) for i in range(25)]
    boxes = spark.createDataFrame(rows, "frame_id long, box_idx long, cx double, cy double, cz double, sx double, sy double, sz double")

    def shared(a, b):
        v = 1.0
        for c in range(2, 5):
            v *= max(0.0, min(a[c] + a[c + 3] / 2, b[c] + b[c + 3] / 2) - max(a[c] - a[c + 3] / 2, b[c] - b[c + 3] / 2))
        return v / min(math.prod(a[5:8]), math.prod(b[5:8]))

    want = set()
    for f in range(3):
        kept = []
        for b in sorted((r for r in rows if r[0] == f), key=lambda r: (-math.prod(r[5:8]), r[1])):
            if all(shared(k, b) <= 0.5 for k in kept):
                kept.append(b)
        want |= {(f, b[1]) for b in kept}
    assert {(r["frame_id"], r["box_idx"]) for r in moving.suppressed(boxes).collect()} == want


def test_tracks_follow_and_expire(spark):
    box = lambda s, f, i, x: (s, f, i, float(x), 0.0, 0.0, 2.0, 2.0, 2.0)
    rows = [box(0, f, 0, f * 0.5) for f in (0, 1, 2, 5)] + [box(0, 0, 1, 50)] + [box(0, 20, 0, 4)] + [box(7, 0, 0, 0)]
    boxes = spark.createDataFrame(rows, "seq_id long, frame_id long, box_idx long, cx double, cy double, cz double, sx double, sy double, sz double")
    got = {(r["seq_id"], r["frame_id"], r["box_idx"]): (r["track_id"], r["age"], round(r["vx"], 6)) for r in moving.tracked(boxes).collect()}
    assert got[0, 0, 0] == (0, 1, 0.0) and got[0, 0, 1] == (1, 1, 0.0) and got[0, 1, 0] == (0, 2, 2.0) and got[0, 2, 0] == (0, 3, 3.2)
    assert got[0, 5, 0][0] == 0 and got[7, 0, 0] == (0, 1, 0.0)


def test_stream_of_boxes_like_batch(spark, tmp_path):
    from lodegrid.streaming import flows

    rng = random.Random(9)
    rows = [(s, f, i, *[rng.uniform(0, 6) for _ in range(3)], 3.0, 3.0, 3.0) for s in range(3) for f in range(6) for i in range(3)]
    schema = "seq_id long, frame_id long, box_idx long, cx double, cy double, cz double, sx double, sy double, sz double"
    boxes = spark.createDataFrame(rows, schema)
    for f in range(6):  # a file for each frame, one micro-batch each
        boxes.where(F.col("frame_id") == f).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flows.tracked_boxes(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("seq_id", "frame_id", "box_idx", "track_id", "age", "vx").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(moving.tracked(boxes))


def test_scan_release_stream(spark, tmp_path):
    from lodegrid.streaming import flows

    spark.createDataFrame([(0, 1, 10.0), (0, 2, 30.0)], "seq_id long, id long, s double").select("seq_id", "id", F.col("s").cast("timestamp").alias("stamp")).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(0, 12.0), (0, 29.0)], "seq_id long, s double").select("seq_id", F.col("s").cast("timestamp").alias("stamp")).coalesce(1).write.parquet(str(tmp_path / "b"))
    a = spark.readStream.schema("seq_id long, id long, stamp timestamp").parquet(str(tmp_path / "a"))
    b = spark.readStream.schema("seq_id long, stamp timestamp").parquet(str(tmp_path / "b"))
    flows.released_scans(a, b).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o")).trigger(availableNow=True).start().awaitTermination()
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [1]


def test_hysteresis_locks(spark):
    says = [True] * 2 + [False] * 3 + [True] * 5
    rows = spark.createDataFrame([(0, i if i < 5 else i + 2, d) for i, d in enumerate(says)], "track_id long, frame_id long, is_dynamic boolean")
    out = moving.hysteresis(rows, 3).orderBy("frame_id").collect()
    assert [r["run"] for r in out] == [1, 2, 1, 2, 3, 1, 2, 3, 4, 5]
    assert [r["locked"] for r in out] == [None] * 4 + ["static"] * 6


def test_components_by_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}


def test_registration_finds_the_motion(spark):
    rng = np.random.default_rng(8)
    xyz = rng.uniform(-5, 5, (60, 3))
    turn = motion.turn_of(np.array([0.01, -0.02, 0.05]))
    source, target = cloud_of(spark, xyz), cloud_of(spark, xyz @ turn.T + [0.2, -0.1, 0.1])
    pose, error = graph.registered(source, target, 2.0, 12)
    assert np.allclose(pose[:3, :3], turn, atol=1e-3) and np.allclose(pose[:3, 3], [0.2, -0.1, 0.1], atol=1e-2) and error < 1e-3


def test_relative_poses_compose(spark):
    rng = np.random.default_rng(10)
    poses = []
    for i in range(4):
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = motion.turn_of(rng.normal(0, 1, 3)), rng.normal(0, 5, 3)
        poses.append(m)
    nodes = spark.createDataFrame([(0, i, [float(v) for v in m.ravel()]) for i, m in enumerate(poses)], "k long, i long, pose array<double>")
    for r in graph.odometry_edges(nodes, "k", "i", "pose").collect():
        assert np.allclose(poses[r["i"]] @ np.array(r["relative"]).reshape(4, 4), poses[r["j"]])


def test_integration_at_constant_speed_of_turn(spark):
    rate = 0.5
    rows = [(0, i / 100, 0.0, 0.0, 9.80665, 0.0, 0.0, rate) for i in range(201)]
    out = motion.integrated(spark.createDataFrame(rows, "seq_id long, stamp double, ax double, ay double, az double, wx double, wy double, wz double")).orderBy("stamp").collect()[-1]
    assert abs(2 * math.atan2(out["qz"], out["qw"]) - rate * 2) < 1e-6 and abs(out["x"]) + abs(out["y"]) + abs(out["z"]) < 1e-6


def test_deskew_like_numpy(spark):
    poses = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (0, 100, 2.0, 0.0, 0.0, 0.0, 0.0, math.sin(0.5), math.cos(0.5))], "seq_id long, us long, x double, y double, z double, qx double, qy double, qz double, qw double")
    pts = spark.createDataFrame([(0, i, us, 1.0, 0.0, 0.0) for i, us in enumerate((-5, 0, 25, 100, 200))], "seq_id long, id long, us long, x double, y double, z double")
    for r in motion.deskewed(pts, poses).collect():
        t = min(max(r["us"] / 100, 0), 1)
        want = motion.turn_of(np.array([0, 0, t])) @ [1, 0, 0] + [2 * t, 0, 0]
        assert np.allclose([r["dx"], r["dy"], r["dz"]], want)


def test_filter_corrects(spark):
    cols = "seq_id long, stamp double, kind string, ax double, ay double, az double, wx double, wy double, wz double, x double, y double, z double, qx double, qy double, qz double, qw double"
    rest, still = [0.0] * 6, [0.0] * 6 + [1.0]
    rows = [(0, 0.0, "pose", *rest, *still), (0, 0.01, "imu", *rest, *still), (0, 0.1, "imu", *rest, *still), (0, 0.2, "pose", *rest, 1.0, *still[1:])]
    (out,) = motion.filtered(spark.createDataFrame(rows, cols)).collect()
    assert out["shift_error"] == 1.0 and out["turn_error"] == 0.0 and 0 < out["dx"] < 1


def test_chain_of_boxes_merges(spark):
    b = lambda i, x, t=-1: {"box_idx": i, "cx": float(x), "cy": 0.0, "cz": 0.0, "sx": 1.0, "sy": 1.0, "sz": 1.0, "track_id": t}
    assert len(merge.merge_peers([b(0, 0), b(1, 1.5), b(2, 2.6)], 2.0)) == 1
    assert len(merge.merge_peers([b(0, 0, 1), b(1, 1.5, 2)], 2.0)) == 2
    cube = (np.zeros(3), np.ones(3), np.eye(3))
    assert merge.obb_iou(cube, cube) == 1 and merge.obb_iou(cube, (np.array([3.0, 0, 0]), np.ones(3), motion.turn_of(np.array([0, 0, 0.7])))) == 0


def test_walls_are_remembered_and_go(spark):
    w = lambda f, i, x: (0, f, i, float(x), 0.0, 0.0, 1.0, 5.0, 3.0, 1.0, 0.0, 0.0)
    rows = spark.createDataFrame([w(0, 0, 0), w(1, 0, 0.2), w(1, 1, 30), w(2, 0, 30), w(9, 0, 0)], "seq_id long, frame_id long, box_idx long, cx double, cy double, cz double, sx double, sy double, sz double, nx double, ny double, nz double")
    got = {(r["frame_id"], r["box_idx"]): r["wall_id"] for r in merge.remembered_walls(rows, most_missed=1).collect()}
    assert got == {(0, 0): 0, (1, 0): 0, (1, 1): 1, (2, 0): 1, (9, 0): 0}


def test_settings():
    s = clouds.Settings.parse('{ /* a */ "a": {"b": 1, "url": "http://x"}, // c\n "d": [1, 2]}')
    assert s.get("a.b") == 1 and s.get("a.z", 5) == 5 and s.get("d") == [1, 2]
    assert s.missing == {"a.z"} and s.unknown() == {"a.url"}
    with pytest.raises(KeyError):
        s.get("none")


def test_formats(spark, tmp_path):
    rows = [(1.5, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0), (0.5, 4.0, 5.0, 6.0, 0.0, 0.0, 1.0, 0.0)]
    poses = spark.createDataFrame(rows, "stamp double, x double, y double, z double, qx double, qy double, qz double, qw double")
    assert sorted(map(tuple, clouds.from_tum(clouds.tum(poses)).collect())) == sorted(rows)
    raw = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 5_000_000_000, 0x80FF4000)], "frame_id long, x double, y double, z double, t long, rgba long")
    got = clouds.decoded(raw).first()
    assert got["t"] == 5.0 and got["r"] == 1.0 and abs(got["g"] - 64 / 255) < 1e-12
    assert clouds.encoded(clouds.decoded(raw)).first()["rgba"] == 0x80FF4000
    with pytest.raises(ValueError):
        clouds.decoded(raw.withColumn("z", F.lit("no")))
    submaps = spark.createDataFrame([(0,), (1,)], "submap_id long")
    points = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, float("nan"), 0.0, 0.0)], "submap_id long, x double, y double, z double")
    edges = spark.createDataFrame([("m", 0, 1), ("m", 1, 0)], "kind string, i long, j long")
    clouds.write_map(str(tmp_path / "map"), submaps, points, edges)
    back = clouds.read_map(spark, str(tmp_path / "map"))
    assert back["points"].count() == 1 and back["edges"].count() == 1 and "num_submaps: 2" in spark.read.text(str(tmp_path / "map/graph")).first()[0]


def test_same_result_for_any_partitions(spark):
    rng = np.random.default_rng(12)
    pts = cloud_of(spark, rng.uniform(0, 10, (500, 3)))
    results = {tuple(sorted(map(tuple, cloud.voxelise(pts.repartition(n), 2.0).select("ix", "iy", "iz", "mx", "my", "mz").collect()))) for n in (1, 4, 8)}
    assert len(results) == 1


def test_frames_that_use_the_same_ids(spark):
    """Two clusters joined by a border point in one frame, two apart in the next, with some of the same ids."""
    xyz = {0: {0: 0.0, 1: 0.5, 2: 1.0}, 1: {2: 0.0, 3: 0.4, 4: 0.8, 0: 50.0, 1: 50.4, 7: 50.8}}
    pts = spark.createDataFrame([(f, i, x, 0.0, 0.0) for f, own in xyz.items() for i, x in own.items()], "frame_id long, point_id long, x double, y double, z double")
    got = {(r["frame_id"], r["point_id"]): r["cluster"] for r in moving.dbscan(pts, 1.2, 1).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 0, (1, 2): 2, (1, 3): 2, (1, 4): 2, (1, 0): 0, (1, 1): 0, (1, 7): 0}
    best = {r["frame_id"]: (r["root"], r["n"]) for r in moving.largest_part(pts, 1.2).collect()}
    assert best == {0: (0, 3), 1: (0, 3)}


def test_boxes_around_by_brute_force(spark):
    """Every containment, with boxes of a frame and without, and inflated along any speed."""
    rng = np.random.default_rng(12)
    boxes = [(int(rng.integers(0, 3)), i, *map(float, rng.uniform(-20, 20, 3)), *map(float, rng.uniform(0.5, 9, 3)), *map(float, rng.uniform(-7, 7, 2)), bool(i % 2)) for i in range(25)]
    points = [(i % 3, i, *map(float, rng.uniform(-25, 25, 3))) for i in range(400)]
    b = spark.createDataFrame(boxes, "frame_id long, box_idx long, cx double, cy double, cz double, sx double, sy double, sz double, vx double, vy double, is_dynamic boolean")
    p = spark.createDataFrame(points, "frame_id long, point_id long, x double, y double, z double")
    inside = lambda q, k: all(abs(q[2 + c] - k[2 + c]) <= k[5 + c] / 2 for c in range(3))
    got = {r["point_id"]: r["box_idx"] for r in joins.first_box(p, b.drop("frame_id")).collect()}
    assert got == {q[1]: min((k[1] for k in boxes if inside(q, k)), default=None) for q in points}
    got = {r["point_id"]: r["box_idx"] for r in joins.first_box(p, b, by_frame=True).collect()}
    assert got == {q[1]: min((k[1] for k in boxes if k[0] == q[0] and inside(q, k)), default=None) for q in points}
    from pyspark.sql import functions as F

    from lodegrid.functions.geometry import in_inflated, vec

    met = p.drop("frame_id").join(b.drop("frame_id"), in_inflated(vec("x", "y", "z"), vec("cx", "cy", "cz"), vec("sx", "sy", "sz"), (F.col("vx"), F.col("vy"), F.lit(0.0)))).groupBy("point_id").agg(F.min("box_idx").alias("b")).collect()
    got = {r["point_id"]: r["box_idx"] for r in joins.first_box(p, b.drop("frame_id"), True).collect() if r["box_idx"] is not None}
    assert got == {r["point_id"]: r["b"] for r in met} and got
