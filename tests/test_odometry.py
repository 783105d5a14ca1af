"""Inertial odometry: drift on a drive, the bounded map, batch and stream."""

import numpy as np
from pyspark.sql import functions as F

from lodegrid.operators import odometry as O
from lodegrid.operators.posegraph import exp3

MESSAGE = "seq_id long, stamp double, kind int, frame_id long, values array<double>"


def drive(seq, rate, frames=40, seed=0, noise=0.02):
    """A car on a circle of 4 m in a hall of walls, seen by 300 points a scan; 10 scans and 100 noisy samples a second; at rest at first."""
    rng = np.random.default_rng(seed)
    angle = lambda t: rate * np.maximum(t - 0.5, 0) ** 2 / 2 if t < 1.5 else rate * (0.5 + t - 1.5)
    turn = lambda t: rate * min(max(t - 0.5, 0), 1)
    at = lambda t: (exp3(np.array([[0, 0, angle(t)]]))[0], np.array([4 * np.sin(angle(t)), 4 * (1 - np.cos(angle(t))), 0]))
    rows, truth = [], {}
    for k in range(int(frames * 10)):
        t = k / 100 - 0.05
        w = turn(t)
        along = 4 * (rate if 0.5 < t < 1.5 else 0.0)
        acc = np.array([along, 4 * w * w, 9.80665]) + rng.normal(0, noise, 3)
        rows.append((seq, t, O.IMU, None, [*acc.tolist(), *rng.normal(0, noise / 10, 2).tolist(), float(w + rng.normal(0, noise / 10))]))
    for f in range(frames):
        t = f / 10
        r, p = at(t)
        wall = rng.integers(0, 5, 300)
        world = rng.uniform(-8, 9, (300, 3)) * [1, 1, 0.2]
        for k, (axis, where) in enumerate(((0, -8.3), (0, 9.4), (1, -8.6), (1, 9.7), (2, -1.3))):
            world[wall == k, axis] = where
        normal = np.eye(3)[np.array([0, 0, 1, 1, 2])[wall]]
        own = (world - p) @ r + rng.normal(0, 0.01, (300, 3))
        n = normal @ r
        cov = np.eye(3) - 0.99 * n[:, :, None] * n[:, None, :]
        rows.append((seq, t, O.SCAN, f, np.concatenate([own, cov[:, [0, 0, 0, 1, 1, 2], [0, 1, 2, 1, 2, 2]]], 1).ravel().tolist()))
        truth[seq, f] = p
    return rows, truth


def test_drift_and_map(spark):
    rows, truth = [], {}
    for seq, rate in ((0, 0.5), (4, -0.8)):
        more, true = drive(seq, rate, seed=seq)
        rows, truth = rows + more, truth | true
    table = spark.createDataFrame(rows, MESSAGE)
    out = {(r["seq_id"], r["frame_id"]): r for r in O.estimated(table.repartition(3), res=2.0).collect()}
    assert out.keys() == truth.keys()
    off = lambda found: max(np.linalg.norm([found[k]["x"] - truth[k][0], found[k]["y"] - truth[k][1], found[k]["z"] - truth[k][2]]) for k in truth)
    blind = {(r["seq_id"], r["frame_id"]): r for r in O.estimated(table, res=2.0, rounds=0).collect()}
    assert off(out) < 0.05 < off(blind), (off(out), off(blind))
    assert all(abs(np.hypot(out[s, 39]["vx"], out[s, 39]["vy"]) - 4 * abs(rate)) < 0.25 for s, rate in ((0, 0.5), (4, -0.8)))
    short = O.estimated(table, res=2.0, horizon=2).orderBy("seq_id", "frame_id").collect()
    assert max(r["n_voxels"] for r in short[10:40]) < max(out[0, f]["n_voxels"] for f in range(10, 40)) and max(r["n_voxels"] for r in short) <= 2 * 300


def test_stream_like_batch(spark, tmp_path):
    rows, _ = drive(2, 0.6, 12, seed=7)
    rows += [(2, -5.0, O.SCAN, 99, [0.0] * 9)]  # too late by the time it comes
    for k, (lo, hi) in enumerate(((-1, 0.25), (0.25, 0.7), (0.7, 9))):
        part = [r for r in rows if lo <= r[1] < hi] + ([rows[-1]] if k == 2 else [])
        spark.createDataFrame(part[::-1], MESSAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    O.estimated_stream(stream, res=2.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: [tuple(r) for r in df.orderBy("frame_id").collect()]
    told = key(O.estimated(spark.createDataFrame(rows[:-1], MESSAGE), res=2.0))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == told and len(told) == 12


def test_odd_messages(spark):
    """No samples at all, scans without points, null stamps, a scan alone."""
    rows, _ = drive(1, 0.0, 5)
    bare = [r for r in rows if r[2] == O.SCAN] + [(1, 0.6, O.SCAN, 7, []), (8, 0.0, O.SCAN, 0, []), (8, None, O.SCAN, 1, [])]
    out = {(r["seq_id"], r["frame_id"]): r for r in O.estimated(spark.createDataFrame(bare, MESSAGE)).collect()}
    assert len(out) == 7 and out[8, 0]["n_voxels"] == 0 and abs(out[1, 4]["x"]) < 0.1 and out[1, 7]["n_met"] == 0
    assert O.estimated(spark.createDataFrame([], MESSAGE)).count() == 0


def test_messages(spark):
    pts = spark.createDataFrame([(0, 5, 1.5, i, float(i), 0.0, 0.0) for i in (2, 1)], "seq_id long, frame_id long, stamp double, point_id long, x double, y double, z double").withColumns({c: F.lit(0.5) for c in O.COV})
    imu = spark.createDataFrame([(0, 1.0, *[float(k) for k in range(6)])], "seq_id long, stamp double, " + ", ".join(f"{c} double" for c in O.SAMPLE))
    got = {r["kind"]: r for r in O.messages(pts, imu).collect()}
    assert got[O.IMU]["values"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and got[O.SCAN]["values"] == [1.0, 0.0, 0.0, *[0.5] * 6, 2.0, 0.0, 0.0, *[0.5] * 6] and got[O.SCAN]["frame_id"] == 5
