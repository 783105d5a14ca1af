"""Queries without SQL against plain loops over the same tables, and column builders that no query uses."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodegrid.functions import geometry as G
from lodegrid.operators import cloud
from lodegrid.operators.posegraph import exp3
from lodegrid.plans import catalogue
from lodegrid.sources import adapters as A

SF = "/root/testdata/sf0.001"


def near(a, b):
    return abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))


def test_intensity_statistics(spark):
    values = np.array([r[0] for r in A.points(spark, SF).select(F.col("intensity").cast("double")).collect()])
    row = catalogue.QUERIES["intensity_statistics"](spark, SF).first()
    assert row["n"] == len(values) and all(near(a, b) for a, b in zip((row["mean"], row["std"], row["least"], row["greatest"]), (values.mean(), values.std(ddof=1), values.min(), values.max())))


def test_gravity_direction(spark):
    by = defaultdict(list)
    for r in catalogue.inertial(spark, SF).collect():
        by[r["seq_id"]].append((r["stamp"], r["ax"], r["ay"], r["az"]))
    out = {r["seq_id"]: r for r in catalogue.QUERIES["gravity_direction"](spark, SF).collect()}
    assert out.keys() == by.keys()
    for seq, rows in by.items():
        rows = np.array(rows)
        mean = rows[rows[:, 0] <= rows[:, 0].min() + 36000.0, 1:].mean(0)
        norm = np.linalg.norm(mean)
        assert all(near(out[seq][c], m) for c, m in zip(("ax", "ay", "az"), mean)) and near(out[seq]["norm"], norm) and out[seq]["plausible"] == (5 <= norm <= 15)


def test_twist_deskew(spark):
    pts = {(r["frame_id"], r["point_id"]): r for r in A.points(spark, SF).collect()}
    out = catalogue.QUERIES["twist_deskew"](spark, SF).collect()
    assert len(out) == len(pts)
    for r in out[::37]:
        p = pts[r["frame_id"], r["point_id"]]
        t = p["point_id"] % 100 / 1000
        told = exp3(np.array([[0, 0, 0.3 * t]]))[0] @ np.array([p["x"], p["y"], p["z"]], float) + np.array([1.0, 0.5, 0]) * t
        assert np.allclose([r["dx"], r["dy"], r["dz"]], told, atol=1e-9)


def plain_cells(spark):
    """(frame, sector, ring): the heights of the voxels in it."""
    out = defaultdict(list)
    for r in cloud.voxelise(A.points(spark, SF), 2.0).collect():
        x, y = r["mx"] - 25, r["my"] - 25
        if (reach := math.sqrt(x * x + y * y)) < 60.0:
            turn = math.atan2(y, x)
            turn += 2 * math.pi if turn < 0 else 0.0
            out[r["frame_id"], min(int(turn // (2 * math.pi / 36)), 35), int(reach // 4.0)].append(r["mz"])
    return out


def plain_statistics(cells, spread, flat):
    out = {}
    for key, z in cells.items():
        if len(z) >= 3:
            z = sorted(z)
            low = sum(z[:3]) / 3
            variance = sum((v - low) ** 2 for v in z) / len(z)
            score = (z[-1] - z[0] <= spread) + (low - z[0] <= flat) + (variance <= flat * flat)
            out[key] = (len(z), z[0], z[-1], low, score, score >= 2 and z[-1] - z[0] <= spread)
    return out


def test_polar_cells(spark):
    told = plain_statistics(plain_cells(spark), 4.0, 2.0)
    out = {(r["frame_id"], r["sector"], r["ring"]): r for r in catalogue.QUERIES["polar_cells"](spark, SF).collect()}
    assert out.keys() == told.keys() and any(t[5] for t in told.values()) and not all(t[5] for t in told.values())
    for key, (n, lo, hi, low, score, valid) in told.items():
        r = out[key]
        assert (r["n"], r["z_min"], r["z_max"], r["score"], r["valid"]) == (n, lo, hi, score, valid) and near(r["low_mean"], low)


def test_ground_labels(spark):
    cells = plain_cells(spark)
    valid = defaultdict(dict)
    for (f, s, ring), (*_, low, _, ok) in plain_statistics(cells, 8.0, 2.0).items():
        if ok:
            valid[f, s][ring] = low
    ground = {}
    for (f, s), rings in valid.items():
        seeds = sorted((low, ring) for ring, low in rings.items() if 1 <= ring <= 4)
        if not seeds:
            continue
        seed_low, seed = seeds[0]
        ground[f, s, seed] = seed_low
        for way in (sorted(r for r in rings if r > seed), sorted((r for r in rings if r < seed), reverse=True)):
            at, low = seed, seed_low
            for ring in way:
                if abs(rings[ring] - low) / (abs(ring - at) * 4.0) >= 0.8 or rings[ring] > seed_low + 2.0:
                    break
                at, low = ring, rings[ring]
                ground[f, s, ring] = low
    told = defaultdict(lambda: [0, 0])
    for key, z in cells.items():
        told[key[0]][0] += len(z)
        told[key[0]][1] += sum(key in ground and v <= ground[key] + 0.5 for v in z)
    out = {r["frame_id"]: [r["n"], r["n_ground"]] for r in catalogue.QUERIES["ground_labels"](spark, SF).collect()}
    assert out == dict(told) and sum(n for _, n in told.values()) > 0


def test_builders(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    row = lambda *c: tuple(spark.range(1).select(*[x.alias(f"c{k}") for k, x in enumerate(c)]).first())
    assert row(G.is_wall(lit(1, 0, 0.05)), G.is_wall(lit(0, 0.99, 0.1)), G.is_floor(lit(0, 0.1, 0.99)), G.is_floor(lit(0, 0.5, 0.86))) == (True, False, True, False)
    assert row(G.is_compact(lit(1, 2, 4)), G.is_compact(lit(11, 2, 1)), G.is_compact(lit(1, 1e-4, 1))) == (True, False, False)
    outer = lit(0, 0, 0), lit(4, 4, 4)
    assert row(G.box_in_box((lit(1, 0, 0), lit(2, 4, 1)), outer), G.box_in_box((lit(1.1, 0, 0), lit(2, 4, 1)), outer)) == (True, False)
    assert row(G.skew(lit(1, 2, 3)))[0] == [0.0, -3.0, 2.0, 3.0, 0.0, -1.0, -2.0, 1.0, 0.0]


def test_voxel_surprise(spark):
    res = 4.0
    cells = defaultdict(list)
    for r in A.points(spark, SF).collect():
        p = np.array([r["x"], r["y"], r["z"]], float)
        cells[r["frame_id"], *(int(v) for v in np.floor(p * (1 / res)))].append(p)
    told = {}
    for (f, *cell), pts in cells.items():
        old = cells.get((f - 1, *cell))
        if old:
            d = np.mean(pts, 0) - np.mean(old, 0)
            cov = np.cov(np.array(old).T, bias=True) if len(old) > 1 else np.zeros((3, 3))
            told[f, *cell] = math.sqrt(d @ np.linalg.inv(cov + 0.01 * np.eye(3)) @ d)
    out = {tuple(r[c] for c in ("frame_id", *cloud.CELL)): r["mahalanobis"] for r in catalogue.QUERIES["voxel_surprise"](spark, SF).collect()}
    assert out.keys() == told.keys() and all(abs(out[k] - told[k]) < 1e-2 * max(1, told[k]) for k in told)
