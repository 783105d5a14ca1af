"""Covariances of voxels, and registration by distributions against numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodegrid.functions import geometry as G
from lodegrid.operators import cloud
from lodegrid.operators import registration as R
from lodegrid.operators.graph import rotation

P = "frame_id long, point_id long, x double, y double, z double"


def room(rng, n=1500):
    """Points on three walls and two boards, with the normals of what they are on."""
    side = rng.integers(0, 5, n)
    at = rng.uniform(0, 6, (n, 3))
    for k, (axis, where) in enumerate(((0, 0.33), (1, 0.4), (2, 0.3), (0, 3.1), (1, 4.5))):
        at[side == k, axis] = where
    axis = np.array([0, 1, 2, 0, 1])[side]
    return at + rng.normal(0, 0.005, at.shape), np.eye(3)[axis]


def table(spark, clouds):
    rows = [(f, i, *map(float, p), *map(float, n)) for f, (at, normals) in clouds.items() for i, (p, n) in enumerate(zip(at, normals))]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["frame_id", "point_id", "x", "y", "z", "nx", "ny", "nz"]))
    return R.with_covariances(df.select("frame_id", "point_id", "x", "y", "z"), df.select("frame_id", "point_id", "nx", "ny", "nz"), 0.01)


def discs(normals):
    return np.eye(3) - 0.99 * normals[:, :, None] * normals[:, None, :]


def by_numpy(source, normals, target, target_normals, pose, levels, rounds=60):
    """The same cost by dense Gauss-Newton on one thread."""
    covs, other = discs(normals), discs(target_normals)
    for res in levels:
        cells = {}
        for p, c in zip(target, other):
            cells.setdefault(tuple(np.floor(p * (1 / res)).astype(int)), []).append((p, c))
        cells = {k: (np.round(np.mean([np.round(p * 1e6) for p, _ in v], 0)) / 1e6, np.mean([c for _, c in v], 0)) for k, v in cells.items()}
        for _ in range(rounds):
            h, g = np.zeros((6, 6)), np.zeros(6)
            for p, c in zip(source, covs):
                q = pose[:3, :3] @ p + pose[:3, 3]
                hit = cells.get(tuple(np.floor(q * (1 / res)).astype(int)))
                if hit is None:
                    continue
                w = np.linalg.inv(pose[:3, :3] @ c @ pose[:3, :3].T + hit[1])
                j = np.hstack([-np.array([[0, -q[2], q[1]], [q[2], 0, -q[0]], [-q[1], q[0], 0]]), np.eye(3)])
                h += j.T @ w @ j
                g += j.T @ w @ (q - hit[0])
            step = -np.linalg.solve(h, g)
            pose = R.turned(step, pose)
            if np.linalg.norm(step) < 1e-10:
                break
    return pose


def moved_parts(rng, target, normals, motions, n):
    """Parts of the target, moved away by the inverse of each motion."""
    clouds, truth = {}, {}
    for frame, (w, t) in enumerate(motions):
        truth[frame] = R.turned(np.array([*w, *t]), np.eye(4))
        inv = np.linalg.inv(truth[frame])
        own = rng.permutation(len(target))[:n]
        clouds[frame] = (target[own] @ inv[:3, :3].T + inv[:3, 3], normals[own] @ inv[:3, :3].T)
    return clouds, truth


def test_aligned_like_numpy(spark):
    """Blobs in the middle of their cells, so that no point changes cells and there is one solution."""
    rng = np.random.default_rng(21)
    middle = np.array([[x, y, z] for x in (1.0, 3.0, 5.0) for y in (1.0, 3.0) for z in (1.0, 3.0)])
    target = np.repeat(middle, 40, axis=0) + rng.uniform(-0.4, 0.4, (480, 3))
    normals = rng.normal(size=(480, 3))
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    clouds, truth = moved_parts(rng, target, normals, (((0.01, -0.02, 0.02), (0.15, -0.1, 0.08)), ((0.0, 0.0, -0.03), (-0.2, 0.05, 0.0))), 300)
    clouds[5] = (np.array([[100.0, 0, 0]] * 4), np.array([[0, 0, 1.0]] * 4))
    source = table(spark, clouds).persist()
    known = table(spark, {f: (target, normals) for f in (*truth, 5)}).persist()
    found = {r["frame_id"]: r for r in R.aligned(source, known, (2.0,), 12, shift=1e-8, degrees=1e-8).collect()}
    assert found[5]["cost"] is None and found[5]["n"] == 0 and found[5]["pose"] == np.eye(4).ravel().tolist()
    for frame, true in truth.items():
        pose = np.array(found[frame]["pose"]).reshape(4, 4)
        assert np.abs(pose - by_numpy(*clouds[frame], target, normals, np.eye(4), (2.0,))).max() < 1e-6
        assert np.abs(pose - true).max() < 0.1 and found[frame]["n"] == 300
    # Given poses are where it starts: one round says that nothing is left to do.
    start = spark.createDataFrame([(f, found[f]["pose"]) for f in truth], "frame_id long, pose array<double>")
    again = {r["frame_id"]: r["pose"] for r in R.aligned(source, known, (2.0,), 1, start).collect()}
    assert all(np.allclose(again[f], found[f]["pose"], atol=1e-9) for f in truth)


def test_a_moved_room_is_found(spark):
    rng = np.random.default_rng(2)
    target, normals = room(rng)
    clouds, truth = moved_parts(rng, target, normals, (((0.02, -0.03, 0.05), (0.15, -0.1, 0.08)),), 900)
    found = R.aligned(table(spark, clouds).persist(), table(spark, {0: (target, normals)}).persist(), (2.0, 0.7), 8).first()
    assert np.abs(np.array(found["pose"]).reshape(4, 4) - truth[0]).max() < 0.03 and found["n"] > 850


def test_empty_clouds(spark):
    none = table(spark, {0: room(np.random.default_rng(0), 20)}).limit(0)
    assert R.aligned(none, none).count() == 0


def test_covariances_of_voxels(spark):
    rng = np.random.default_rng(3)
    at = np.round(rng.uniform(-3, 3, (400, 3)), 3)
    covs = rng.uniform(0, 1, (400, 6)).round(3)
    df = spark.createDataFrame(pd.DataFrame(np.hstack([at, covs]), columns=["x", "y", "z", *cloud.COV]).assign(frame_id=0, point_id=range(400)))
    parts = [cloud.voxelise(df.where(F.col("point_id") % 3 == k), 1.5, spread=True) for k in range(3)]
    merged = cloud.scatter(cloud.merged_voxels(*parts), 1.5).orderBy(*cloud.CELL).collect()
    whole = cloud.voxelise(df, 1.5, spread=True)
    assert [tuple(r[c] for c in (*cloud.CELL, "n", *cloud.PRODUCTS, *cloud.COV_SUMS)) for r in merged] == sorted(tuple(r) for r in whole.select(*cloud.CELL, "n", *cloud.PRODUCTS, *cloud.COV_SUMS).collect())
    means = {tuple(r[c] for c in cloud.CELL): r for r in whole.collect()}
    for r in merged:
        key = tuple(r[c] for c in cloud.CELL)
        own = np.all(np.floor(at / 1.5) == key, axis=1)
        told = np.cov(at[own].T, bias=True) if own.sum() > 1 else np.zeros((3, 3))
        assert np.allclose([r[c] for c in cloud.COV], told[np.triu_indices(3)], atol=1e-5)
        assert np.allclose([means[key][c] for c in cloud.COV], covs[own].mean(0), atol=1e-6)


def test_symmetric_matrices(spark):
    rng = np.random.default_rng(8)
    for _ in range(5):
        a = rng.normal(size=(3, 3))
        m, d, w = a @ a.T, rng.normal(size=3), rng.normal(size=3)
        lit = lambda v: [F.lit(float(x)) for x in v]
        six = lit(m[np.triu_indices(3)])
        pose = np.eye(4)
        pose[:3, :3] = rotation(w)
        row = spark.range(1).select(F.array(*G.inverse3(*six)), G.mahalanobis(tuple(lit(d)), six), F.array(*G.turned3(F.array(*lit(pose.ravel())), six))).first()
        assert np.allclose(row[0], np.linalg.inv(m)[np.triu_indices(3)])
        assert np.isclose(row[1], np.sqrt(d @ np.linalg.inv(m + 1e-6 * np.eye(3)) @ d))
        assert np.allclose(row[2], (rotation(w) @ m @ rotation(w).T)[np.triu_indices(3)])
    flat = [F.lit(0.0)] * 6
    assert spark.range(1).select(G.inverse3(*flat)[0]).first()[0] is None
