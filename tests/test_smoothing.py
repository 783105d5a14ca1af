"""Trajectories at the sensor's rate against dense least squares."""

import numpy as np
import pandas as pd

from lodegrid.operators import posegraph as G
from lodegrid.operators import smoothing as S

FRAMES, IMU = "seq_id long, frame_id long, stamp double, pose array<double>, vx double, vy double, vz double", ["seq_id", "stamp", *S.SAMPLE]


def rigid(w, t):
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = G.exp3(np.array([w], float))[0], t
    return out


def dense(poses, stamps, begin, end, rounds=20):
    """All residuals and their answers as one matrix."""
    n = len(poses)
    relative = [np.linalg.inv(poses[k]) @ poses[k + 1] for k in range(n - 1)]
    for _ in range(rounds):
        rows, left = [], []
        for a, pose in ((0, begin), (n - 1, end)):
            e, _, j = G.residuals(pose[None], poses[[a]], np.eye(4)[None])
            row = np.zeros((6, 6 * n))
            row[:, 6 * a : 6 * a + 6] = j[0]
            rows.append(row / 1e-5), left.append(e[0] / 1e-5)
        for k in range(n - 1):
            sigma = (stamps[k + 1] - stamps[k]) / (stamps[-1] - stamps[0]) + 1e-2
            e, ja, jb = G.residuals(poses[[k]], poses[[k + 1]], relative[k][None])
            row = np.zeros((6, 6 * n))
            row[:, 6 * k : 6 * k + 6], row[:, 6 * k + 6 : 6 * k + 12] = ja[0], jb[0]
            rows.append(row / sigma), left.append(e[0] / sigma)
        step = -np.linalg.lstsq(np.concatenate(rows), np.concatenate(left), rcond=None)[0]
        poses = G.moved(poses, step.reshape(n, 6))
    return poses


def test_bent_like_dense():
    rng = np.random.default_rng(3)
    for n in (2, 3, 25):
        stamps = np.cumsum(rng.uniform(0.005, 0.02, n))
        way = [rigid(rng.normal(size=3), rng.normal(size=3))]
        for _ in range(n - 1):
            way.append(way[-1] @ rigid(rng.normal(0, 0.02, 3), rng.normal(0.1, 0.02, 3)))
        way = np.array(way)
        end = way[-1] @ rigid(rng.normal(0, 0.03, 3), rng.normal(0, 0.05, 3))
        got = S.bent(way, stamps, way[0], end, 20, 0.0)
        assert np.allclose(got, dense(way, stamps, way[0], end), atol=1e-6)
        assert np.allclose(got[0], way[0], atol=1e-4) and np.allclose(got[-1], end, atol=1e-4)
    assert np.allclose(S.bent(way[:1], stamps[:1], end, end), end[None])


def test_tridiagonal():
    rng = np.random.default_rng(4)
    n = 7
    m = rng.normal(size=(6 * n, 6 * n))
    m = m @ m.T + np.eye(6 * n) * 50
    for a in range(n):
        for b in range(n):
            if abs(a - b) > 1:
                m[6 * a : 6 * a + 6, 6 * b : 6 * b + 6] = 0
    m += np.eye(6 * n) * 200
    right = rng.normal(size=(n, 6))
    block = lambda a, b: m[6 * a : 6 * a + 6, 6 * b : 6 * b + 6]
    x = S.tridiagonal(np.array([block(k, k) for k in range(n)]), np.array([block(k, k + 1) for k in range(n - 1)]), right)
    assert np.allclose(x.ravel(), np.linalg.solve(m, right.ravel()))


def test_trajectories(spark):
    """A car on a circle at two speeds; samples at 100 Hz, frames at 10 Hz; against the step by step integration and dense sums."""
    frames, samples, truth = [], [], {}
    for seq, rate in ((0, 0.4), (3, -0.7)):
        radius = 5.0
        at = lambda t: rigid((0, 0, rate * t), (radius * np.sin(rate * t), radius * (1 - np.cos(rate * t)), 0))
        for f in range(6):
            t = 10.0 + 0.1 * f
            v = radius * rate * np.array([np.cos(rate * t), np.sin(rate * t), 0])
            pose = at(t) @ rigid((0, 0, 0.002 * f), (0.01 * f, 0, 0))
            frames.append((seq, f, t, pose.ravel().tolist(), *map(float, v)))
            truth[seq, f] = pose
        for k in range(70):
            samples.append((seq, 9.995 + 0.01 * k, 0.0, rate * rate * radius, 9.80665, 0.0, 0.0, rate))
    imu = spark.createDataFrame(pd.DataFrame(samples, columns=IMU))
    out = S.trajectories(spark.createDataFrame(frames, FRAMES), imu, 20).orderBy("seq_id", "frame_id", "stamp").toPandas()
    assert set(zip(out["seq_id"], out["frame_id"])) == {(s, f) for s in (0, 3) for f in range(5)}
    for (seq, f), part in out.groupby(["seq_id", "frame_id"]):
        row = next(r for r in frames if r[:2] == (seq, f))
        inside = [s for s in samples if s[0] == seq and row[2] <= s[1] < row[2] + 0.1 - 1e-9]
        before = [s for s in samples if s[0] == seq and s[1] < row[2]][-1]
        stamps = np.array([row[2], *[s[1] for s in inside], frames[frames.index(row) + 1][2]])
        way, _ = S.predicted(truth[seq, f], np.array(row[4:]), np.zeros(6), stamps, np.array([before[2:], *[s[2:] for s in inside]]))
        told = dense(way, stamps, truth[seq, f], truth[seq, f + 1])
        assert np.allclose(part["stamp"], stamps) and np.allclose(part[["x", "y", "z"]], told[:, :3, 3], atol=1e-5)
        assert np.allclose([S.quaternion(p[:3, :3]) for p in told], part[["qx", "qy", "qz", "qw"]], atol=1e-5)
    none = spark.createDataFrame([], FRAMES)
    assert S.trajectories(none, imu).count() == 0 and S.trajectories(spark.createDataFrame(frames, FRAMES), imu.limit(0)).count() == 0


def test_refreshed(spark):
    unit, other = np.eye(4).ravel().tolist(), (2 * np.eye(4)).ravel().tolist()
    frames = spark.createDataFrame([(0, 1, unit), (0, 2, unit)], "seq_id long, frame_id long, pose array<double>")
    new = spark.createDataFrame([(0, 2, other), (0, 9, other)], "seq_id long, frame_id long, pose array<double>")
    assert {r["frame_id"]: (r["pose"], r["is_refreshed"]) for r in S.refreshed(frames, new).collect()} == {1: (unit, False), 2: (other, True)}


def test_ways_of_a_length_are_solved_together(spark):
    """As each alone, to the bit; and whichever batches the rows come in."""
    rng = np.random.default_rng(8)
    for n in (1, 2, 9):
        turn = lambda: np.concatenate([np.concatenate([G.exp3(rng.normal(0, 1, (6, 3))), rng.normal(0, 1, (6, 3, 1))], 2), np.tile([[[0, 0, 0, 1.0]]], (6, 1, 1))], 1)
        pose, end, stamps, samples = turn(), turn(), np.cumsum(rng.exponential(0.1, (6, n + 1)), 1), rng.normal(0, 1, (6, n, 6))
        v, bias = rng.normal(0, 1, (6, 3)), rng.normal(0, 0.1, (6, 6))
        way, speed = S.predicted(pose, v, bias, stamps, samples)
        found = S.bent(way, stamps, pose, end)
        for k in range(6):
            alone = S.predicted(pose[k], v[k], bias[k], stamps[k], samples[k])
            assert (alone[0] == way[k]).all() and (alone[1] == speed[k]).all()
            assert (S.bent(way[k], stamps[k], pose[k], end[k]) == found[k]).all()
        assert np.allclose(S.quaternion(found[:, 0, :3, :3]), [S.quaternion(p[:3, :3]) for p in found[:, 0]])
    unit = np.eye(4).ravel().tolist()
    frames = spark.createDataFrame([(s, f, f + 0.25 * s, [*unit[:3], float(f), *unit[4:]], 1.0, 0.0, 0.0) for s in range(3) for f in range(8)], FRAMES)
    imu = spark.createDataFrame([(s, k / 7 + 0.3 * s, 0.1, 0.0, 9.8, 0.0, 0.0, k % 3 / 10) for s in range(3) for k in range(40)], IMU)
    made = []
    for size in ("5", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            made.append(S.trajectories(frames, imu).orderBy("seq_id", "frame_id", "stamp").collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made[0] == made[1] and {(r["seq_id"], r["frame_id"]) for r in made[0]} >= {(s, f) for s in range(3) for f in range(2, 5)}
