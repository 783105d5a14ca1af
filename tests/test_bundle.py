"""Plane bundle adjustment: halves of a room come back together; gradients by differences."""

import numpy as np
import pandas as pd

from lodegrid.operators import bundle as B
from lodegrid.operators.registration import turned

POSES = "pose_id long, pose array<double>, fixed boolean"


def seen(rng, poses, noise=0.003):
    """Points of five walls, some from each pose, in its frame."""
    rows = []
    for pose, true in enumerate(poses):
        for plane, (axis, where) in enumerate(((0, -3.0), (0, 4.0), (1, -2.0), (1, 3.0), (2, 0.0))):
            at = rng.uniform(-3, 4, (60, 3))
            at[:, axis] = where + rng.normal(0, noise, 60)
            inv = np.linalg.inv(true)
            rows += [(pose, plane, *map(float, p)) for p in at @ inv[:3, :3].T + inv[:3, 3]]
    return rows


def cost(rows, poses):
    total = 0.0
    for plane in {r[1] for r in rows}:
        at = np.array([poses[r[0]][:3, :3] @ r[2:] + poses[r[0]][:3, 3] for r in rows if r[1] == plane])
        total += np.linalg.eigvalsh(np.cov(at.T, bias=True))[0] * len(at)
    return total


def test_halves_of_a_room(spark):
    rng = np.random.default_rng(3)
    true = [np.eye(4), turned(np.array([0.1, -0.2, 0.7, 1.0, 0.5, 0.2]), np.eye(4)), turned(np.array([0.0, 0.1, -0.4, -1.0, 0.3, 0.1]), np.eye(4))]
    rows = seen(rng, true)
    start = [true[0], *[turned(rng.normal(0, 0.03, 6), p) for p in true[1:]]]
    poses = spark.createDataFrame([(k, p.ravel().tolist(), k == 0) for k, p in enumerate(start)] + [(7, np.eye(4).ravel().tolist(), False)], POSES)
    points = spark.createDataFrame(pd.DataFrame([*rows, (99, 0, 1.0, 1.0, 1.0)], columns=["pose_id", "plane_id", "x", "y", "z"]))
    out, left = B.adjusted(poses, points, 20, shift=1e-6)
    found = {r["pose_id"]: np.array(r["pose"]).reshape(4, 4) for r in out.collect()}
    assert all(np.abs(found[k] - true[k]).max() < 0.005 for k in range(3)) and np.allclose(found[7], np.eye(4))
    assert left < 2 * 0.003**2 and abs(left - cost(rows, found) / len(rows)) < 1e-9
    # No small step of a pose lowers the cost: its gradient, by differences, is nothing beside that at the start.
    def steepest(at):
        slopes = []
        for pose in (1, 2):
            for k in range(6):
                d = np.eye(6)[k] * 1e-4
                slopes.append((cost(rows, {**at, pose: turned(d, at[pose])}) - cost(rows, {**at, pose: turned(-d, at[pose])})) / 2e-4)
        return np.abs(slopes).max()

    assert steepest(found) < 1e-3 * steepest(dict(enumerate(start)))


def test_moments_in_the_world():
    rng = np.random.default_rng(1)
    at = rng.normal(size=(40, 3))
    pose = turned(rng.normal(size=6), np.eye(4))
    s, m = B.placed(np.array([40.0]), at.sum(0)[None], (at.T @ at)[None], pose[None])
    q = at @ pose[:3, :3].T + pose[:3, 3]
    assert np.allclose(s[0], q.sum(0)) and np.allclose(m[0], q.T @ q)


def test_nothing_to_adjust(spark):
    none = spark.createDataFrame([], "pose_id long, plane_id long, x double, y double, z double")
    poses = spark.createDataFrame([(1, np.eye(4).ravel().tolist(), False)], POSES)
    out, left = B.adjusted(poses, none)
    assert out.count() == 1 and left == 0.0
