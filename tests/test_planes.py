"""The search for planes that stops once it has drawn enough."""

import math

import numpy as np
import pandas as pd

from lodegrid.functions import geometry as G
from lodegrid.operators import ground


def test_draws_stop_when_they_suffice(spark):
    rng = np.random.default_rng(5)
    rows = []
    for frame, share in ((0, 0.95), (1, 0.4), (2, 0.0)):
        on = int(300 * share)
        flat = np.column_stack([rng.uniform(-5, 5, (on, 2)), rng.normal(0, 0.01, on) + 1.5])
        wall = np.column_stack([rng.normal(3, 0.01, 200), rng.uniform(-5, 5, (200, 2))]) if frame == 1 else np.zeros((0, 3))
        rows += [(frame, k, *map(float, p)) for k, p in enumerate(np.concatenate([flat, wall, rng.uniform(-5, 5, (300 - on, 3))]))]
    rows += [(7, 0, 0.0, 0.0, 0.0), (7, 1, 1.0, 1.0, 1.0), (8, 0, 0.0, 0.0, 0.0), (8, 1, 1.0, 1.0, 1.0), (8, 2, 2.0, 2.0, 2.0)]  # too few; on a line
    pts = spark.createDataFrame(pd.DataFrame(rows, columns=["frame_id", "point_id", "x", "y", "z"])).persist()
    out = {r["frame_id"]: r for r in ground.searched_planes(pts, 0.05, 60, count=32, most=256, is_allowed=lambda n: G.is_floor(n)).collect()}
    assert sorted(out) == [0, 1]
    for frame, r in out.items():
        at = np.array([p[2:] for p in rows if p[0] == frame])
        assert abs(abs(r["nz"]) - 1) < 1e-3 and abs(abs(r["d"]) - 1.5) < 0.02
        w = r["n_inliers"] / len(at)
        enough = math.log(0.01) / math.log(1 - w**3)
        assert r["n_draws"] % 32 == 0 and min(enough, 256) <= r["n_draws"]
        # Of planes that far from the best, none has a better hand: the fit holds nearly all of the floor.
        n = np.array([r["nx"], r["ny"], r["nz"]])
        assert (np.abs(at @ n + r["d"]) < 0.05).sum() >= 0.9 * r["n_inliers"]
    assert out[0]["n_draws"] == 32 < out[1]["n_draws"]
    walls = {r["frame_id"]: r for r in ground.searched_planes(pts, 0.05, 60, count=32, most=256, is_allowed=lambda n: G.is_wall(n)).collect()}
    assert abs(abs(walls[1]["nx"]) - 1) < 1e-2 and 0 not in walls
    assert ground.searched_planes(pts.limit(0), 0.05).count() == 0


def test_points_are_read_a_few_times_for_many_draws(spark, monkeypatch):
    """Rounds that double end where rounds of `count` would: by a plain loop over the same draws."""
    rng = np.random.default_rng(6)
    rows = [(f, k, *map(float, p)) for f, on in ((0, 170), (1, 110), (2, 60), (3, 0)) for k, p in enumerate(np.concatenate([np.column_stack([rng.uniform(-5, 5, (on, 2)), np.full(on, 1.5)]), rng.uniform(-5, 5, (200 - on, 3))]))]
    pts = spark.createDataFrame(pd.DataFrame(rows, columns=["frame_id", "point_id", "x", "y", "z"])).persist()
    seen, drawn = [], ground.drawn_planes
    monkeypatch.setattr(ground, "drawn_planes", lambda *a: seen.append(a) or drawn(*a))
    found = {r["frame_id"]: (r["n_draws"], r["n_inliers"]) for r in ground.searched_planes(pts, 0.05, 1, count=8, most=120).collect()}
    assert [a[3] for a in seen] == [8, 8, 16, 32, 56]
    known = ground.numbered(pts)
    planes = drawn(known, known.select("frame_id", "_n").distinct(), 0, 120, 0).collect()
    for f in range(4):
        at, best, n = np.array([r[2:] for r in rows if r[0] == f]), 0, 0
        while n < 120:
            n += 8
            best = max([best, *((np.abs(at @ [p["nx"], p["ny"], p["nz"]] + p["d"]) < 0.05).sum() for p in planes if p["frame_id"] == f and n - 8 <= p["h"] < n)])
            if n >= math.log(0.01) / math.log(1 - (best / 200) ** 3):
                break
        assert found[f] == (n, best)
    assert len({n for n, _ in found.values()}) >= 3
