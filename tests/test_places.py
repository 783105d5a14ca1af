"""Registration without a first guess: features against numpy, and a motion of 120 degrees."""

import numpy as np
import pandas as pd

from lodegrid.operators import graph
from lodegrid.operators import places as P
from lodegrid.operators import registration as R


def hills(rng, n=700):
    """Points on a bumpy ground, with its normals."""
    tops = rng.uniform(-4, 4, (14, 2))
    height, width = rng.uniform(-1.5, 1.5, 14), rng.uniform(0.5, 1.2, 14)
    at = rng.uniform(-4, 4, (n, 2))
    d = at[:, None] - tops
    bump = height * np.exp(-(d**2).sum(2) / (2 * width**2))
    slope = -(bump[:, :, None] * d / width[:, None] ** 2).sum(1)
    normal = np.concatenate([-slope, np.ones((n, 1))], 1)
    return np.concatenate([at, bump.sum(1)[:, None]], 1), normal / np.linalg.norm(normal, axis=1)[:, None]


def frames(spark, clouds):
    rows = [(f, i, *map(float, p), *map(float, n)) for f, (at, normal) in clouds.items() for i, (p, n) in enumerate(zip(at, normal))]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["frame_id", "point_id", "x", "y", "z", "nx", "ny", "nz"])).persist()
    return df.select("frame_id", "point_id", "x", "y", "z"), df.select("frame_id", "point_id", "nx", "ny", "nz")


def by_hand(at, normal, radius):
    n = len(at)
    own, near = np.zeros((n, 33)), [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            line = at[j] - at[i]
            d = np.linalg.norm(line)
            if i == j or d >= radius:
                continue
            u, line = normal[i], line / d
            v = np.cross(u, line)
            v = v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-9 else v * 0
            values = v @ normal[j], u @ line, np.arctan2(np.cross(u, v) @ normal[j], u @ normal[j]) / np.pi
            for k, c in enumerate(values):
                own[i, 11 * k + min(10, max(0, int(np.floor((c + 1) / 2 * 11))))] += 1
            near[i].append((j, 1 / d))
    own /= np.maximum(own.sum(1, keepdims=True) / 3, 1)
    return {i: own[i] + sum(w * own[j] for j, w in near[i]) / sum(w for _, w in near[i]) for i in range(n) if near[i]}


def test_features_by_hand(spark):
    at, normal = hills(np.random.default_rng(1), 60)
    told = by_hand(at, normal, 1.5)
    got = {r["point_id"]: r["f"] for r in P.features(*frames(spark, {0: (at, normal)}), 1.5).collect()}
    assert got.keys() == told.keys() and all(np.allclose(got[k], told[k], atol=1e-9) for k in got)


def test_a_large_motion_is_found(spark):
    rng = np.random.default_rng(12)
    at, normal = hills(rng)
    w = np.array([0.2, -0.1, 1.0])
    true = R.turned(np.array([*(w / np.linalg.norm(w) * np.radians(120)), 3.0, -2.0, 1.0]), np.eye(4))
    back = np.linalg.inv(true)
    part = at[:, 0] < 2.5  # not all of it is seen again
    source = frames(spark, {4: ((at[part] + rng.normal(0, 0.002, (part.sum(), 3))) @ back[:3, :3].T + back[:3, 3], normal[part] @ back[:3, :3].T)})
    target = frames(spark, {4: (at, normal), 9: (at[:2], normal[:2])})
    row = P.found_motion(*source, *target, 1.2, 0.2).first()
    assert row["frame_id"] == 4 and np.abs(np.array(row["pose"]).reshape(4, 4) - true).max() < 0.05 and row["share"] > 0.4
    pose, _ = graph.registered(source[0], target[0].where("frame_id = 4"), 2.0, 6)
    assert not np.abs(pose - true).max() < 0.5  # from where it is, nearest points don't find it


def test_agreement_among_wrong_matches(spark):
    rng = np.random.default_rng(5)
    true = R.turned(np.array([0.5, 1.0, -1.5, 4.0, 5.0, 6.0]), np.eye(4))
    p = rng.uniform(-5, 5, (200, 3))
    q = p @ true[:3, :3].T + true[:3, 3] + rng.normal(0, 0.02, p.shape)
    q[:110] = rng.uniform(-9, 9, (110, 3))  # over half are wrong
    rows = [(1, *map(float, (*a, *b))) for a, b in zip(p, q)] + [(2, *[0.0] * 6)] * 2
    out = P.agreed(spark.createDataFrame(rows, "frame_id long, px double, py double, pz double, qx double, qy double, qz double"), 0.1).collect()
    assert [r["frame_id"] for r in out] == [1] and np.abs(np.array(out[0]["pose"]).reshape(4, 4) - true).max() < 0.05 and 0.35 < out[0]["share"] < 0.5
