"""What a larger table costs: rows dealt out, pairs held, work a frame."""

import numpy as np
from pyspark.sql import functions as F

from lodegrid.operators import joins, moving

P = "frame_id long, point_id long, x double, y double, z double"


def cloud(spark, n, side, frames=2, seed=0):
    at = np.random.default_rng(seed).uniform(-side, side, (n, 3))
    return spark.createDataFrame([(i % frames, i, *map(float, p)) for i, p in enumerate(at)], P)


def test_thin_points_are_dealt_to_few_cells(spark, monkeypatch):
    pts, n = cloud(spark, 600, 20.0), 600
    told = sorted(map(tuple, joins.radius_pairs(pts, 2.5).collect()))
    to_others = sorted(map(tuple, joins.radius_pairs(pts.where("point_id < 90"), 2.5, pts).collect()))
    labels = sorted(map(tuple, moving.dbscan(pts, 2.5, 2).collect()))
    monkeypatch.setattr(joins, "neighbours", None)
    assert joins.dealt(pts, 10.0, 2.5).count() < 5 * n
    assert sorted(map(tuple, joins.radius_pairs(pts, 2.5, wide=4).collect())) == told != []
    assert sorted(map(tuple, joins.radius_pairs(pts.where("point_id < 90"), 2.5, pts, wide=4).collect())) == to_others != []
    assert sorted(map(tuple, moving.dbscan(pts, 2.5, 2, wide=4).collect())) == labels != []


def test_voxels_of_the_frame_before_are_dealt_to_few_blocks(spark, monkeypatch):
    """No voxel goes to 27 cells; the match is that of a plain loop, across the borders of blocks too."""
    rng = np.random.default_rng(2)
    cells = sorted({(f, *map(int, c)) for f in range(3) for c in rng.integers(-7, 7, (400, 3))})
    rows = [(*c, *map(float, np.array(c[1:]) * 2.0 + rng.uniform(0, 2, 3))) for c in cells]
    vox = spark.createDataFrame(rows, "frame_id long, ix long, iy long, iz long, mx double, my double, mz double")
    monkeypatch.setattr(joins, "neighbours", None)
    found = {(r["frame_id"], r["ix"], r["iy"], r["iz"]): (r["kind"], r["prev_ix"], r["prev_iy"], r["prev_iz"]) for r in joins.moved_cell_match(vox, vox, 2.0, (0.7, -0.6, 0.3)).collect()}
    known, kinds = {r[:4]: np.array(r[4:]) for r in rows}, set()
    for key, mean in known.items():
        at = mean + [0.7, -0.6, 0.3]
        own = tuple(np.floor(at / 2.0).astype(int).tolist())
        near = [(float(((at - known[q]) ** 2).sum()), q[1:]) for q in ((key[0] - 1, *(own[i] + s[i] for i in range(3))) for s in np.ndindex(3, 3, 3) for s in [np.array(s) - 1]) if q in known]
        near = [(d, tuple(map(int, q))) for d, q in near if d < 16.0]
        told = ("same", *own) if (key[0] - 1, *own) in known else ("near", *min(near)[1]) if near else ("none", None, None, None)
        assert found[key] == told
        kinds.add(told[0])
    assert len(found) == len(rows) and kinds == {"same", "near", "none"}


def test_frames_are_done_before_the_rounds_of_components(spark, monkeypatch):
    """Links of a frame that many tasks found are reduced to one star of the frame."""
    chain = spark.range(0, 300, 1, 8).select((F.col("id") % 3).alias("frame_id"), F.col("id").alias("a"), (F.col("id") + 3).alias("b")).repartition(8)
    seen = []
    plain = moving.components
    monkeypatch.setattr(moving, "components", lambda e: seen.append(e.select("a.point_id").distinct().count()) or plain(e))
    out = moving.framed_components(chain).collect()
    assert {(r["frame_id"], r["root"]) for r in out} == {(0, 0), (1, 1), (2, 2)} and len(out) == 303
    assert seen == [3]


def test_pairs_of_features_are_not_kept(spark, monkeypatch):
    """What is written grows with the points, not with their pairs; the nearest are those of all pairs that share a code."""
    from lodegrid.operators import places

    rng = np.random.default_rng(4)
    pts = cloud(spark, 240, 2.0)
    n = rng.normal(size=(240, 3))
    normals = spark.createDataFrame([(i % 2, i, *map(float, v / np.linalg.norm(v))) for i, v in enumerate(n)], "frame_id long, point_id long, nx double, ny double, nz double")
    plain, written = places.stored, []
    monkeypatch.setattr(places, "stored", lambda df: written.append(plain(df)) or written[-1])
    monkeypatch.setattr(places, "HELD", 50)
    feats = plain(places.features(pts, normals, 3.0))
    found = sorted(map(tuple, places.matches(feats, feats.withColumn("point_id", F.col("point_id") + 1000)).collect()))
    assert max(df.count() for df in written) <= 2 * 240 and found == [(f, i, i + 1000) for f, i in sorted((i % 2, i) for i in range(240))]
    f = {r["point_id"]: np.array(r["f"]) for r in feats.collect()}
    other = spark.createDataFrame([(i % 2, i, (f[i] + rng.normal(size=33) / 10).tolist()) for i in f], feats.schema)
    codes = lambda df: {(r["frame_id"], r["tab"], r["code"], r["point_id"]) for r in places.coded(df).collect()}
    ca, cb = codes(feats), codes(other)
    g = {r["point_id"]: np.array(r["f"]) for r in other.collect()}
    d2 = {(x[0], x[3], y[3]): float(((f[x[3]] - g[y[3]]) ** 2).sum()) for x in ca for y in cb if x[:3] == y[:3]}
    best = lambda s: {min((d, k[2 - s], k) for k, d in d2.items() if (k[0], k[1 + s]) == key)[2] for key in {(k[0], k[1 + s]) for k in d2}}
    assert set(map(tuple, places.matches(feats, other).collect())) == best(0) & best(1) != set()


def test_registry_of_walls_by_numbers(spark, monkeypatch):
    """Walls of a frame are looked at together, without one that holds() points by itself; walls that nobody asks for aren't made."""
    from lodegrid.operators import walls

    rng = np.random.default_rng(5)
    boxes = [(f % 2, f, k, *map(float, rng.uniform(0, 6, 3)), 4.0, 5.0, 3.0, None) for f in range(24) for k in range(4)]
    box = spark.createDataFrame(boxes, "seq_id long, frame_id long, box_idx long, cx double, cy double, cz double, sx double, sy double, sz double, turn array<double>")
    vox = box.select("seq_id", "frame_id", F.col("box_idx").alias("voxel_id"), (F.col("cx") + F.col("box_idx")).alias("mx"), F.col("cy").alias("my"), F.col("cz").alias("mz"), (F.col("box_idx") == 3).alias("is_wall"))
    c, s = np.cos(0.1), np.sin(0.1)
    pose = [c, -s, 0.0, 0.2, s, c, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    frames = box.select("seq_id", "frame_id").distinct().withColumn("pose", F.when(F.col("frame_id") % 3 > 0, F.array(*[F.lit(float(v)) for v in pose])))
    rows = lambda **k: sorted((tuple(r) for r in walls.registered(frames, box, vox, 2, **k).collect()), key=repr)
    both = rows()
    assert {r[2] for r in both} == {"voxel", "wall"} and {r[4] is None for r in both if r[2] == "voxel"} == {True, False}
    assert rows(left=False) == [r for r in both if r[2] == "voxel"]
    made = walls.Registry(None)
    made.begun(None)
    made.seen(walls.Wall(-1, np.zeros(3), np.ones(3), np.eye(3)))
    at = np.array([[0.0, 0, 0], [0.6, 0, 0], [0.5, 0, 0]])
    monkeypatch.setattr(walls, "AT_ONCE", 0)
    one_by_one = made.marked(at, np.array([False, False, True])).tolist()
    monkeypatch.setattr(walls, "AT_ONCE", 100)
    monkeypatch.setattr(walls.Wall, "holds", None)
    assert made.marked(at, np.array([False, False, True])).tolist() == one_by_one == [0, -1, -1]


def test_tracks_meet_boxes_within_the_gate_only(spark, monkeypatch):
    """Of a frame's tracks only those near a box along x are unpacked; rows are those of a plain loop over all pairs."""
    rng = np.random.default_rng(6)
    keys = ("cx", "cy", "cz", "sx", "sy", "sz")
    known = [{"id": i, "age": 1, "missed": 0, "vx": 0.0, "vy": 0.0, "vz": 0.0} | dict(zip(keys, [float(3 * i), 0.0, 0.0, 2.0, 2.0, 2.0])) for i in range(200)]
    reads = [0]

    class Counted(dict):
        def __getitem__(self, k):
            reads[0] += k == "cy"
            return dict.__getitem__(self, k)

    boxes = [{"box_idx": j} | dict(zip(keys, [float(30 * j + rng.uniform(-0.5, 0.5)), 0.1, 0.0, 2.0, 2.0, 2.0])) for j in range(4)]
    _, found, _ = moving.track_step([Counted(t) for t in known], boxes, 200, 1.5, 0.2, 5, 0.1)
    assert [f[:3] for f in found] == [(j, 10 * j, 2) for j in range(4)] and reads[0] < 20


def test_sums_of_a_correction_and_turns_of_a_way_at_once(monkeypatch):
    """All pairs' sums are one product; all turns of a way are found together, whatever the number of its samples."""
    from lodegrid.operators import registration, smoothing

    rng = np.random.default_rng(7)
    q, m = rng.normal(size=(2, 50, 3))
    root = rng.normal(size=(2, 50, 3, 3))
    a, b = (root @ root.transpose(0, 1, 3, 2) + 0.1 * np.eye(3))[:, :, [0, 0, 0, 1, 1, 2], [0, 1, 2, 1, 2, 2]]
    told = registration.step_sums(q, a, m, b).sum(0)
    h, g, cost = registration.total_sums(q, a, m, b)
    assert np.isclose(cost, told[27], rtol=1e-10)
    assert np.allclose([h[x, y] for x, y in registration.UPPER], told[:21], rtol=1e-10) and np.allclose(h, h.T, rtol=1e-10) and np.allclose(g, told[21:27], rtol=1e-10)
    calls, plain = [], smoothing.exp3
    monkeypatch.setattr(smoothing, "exp3", lambda w: calls.append(len(w)) or plain(w))
    samples, stamps = rng.normal(size=(40, 6)), np.cumsum(rng.uniform(0.01, 0.02, 41))
    way, speeds = smoothing.predicted(np.eye(4), np.zeros(3), np.zeros(6), stamps, samples)
    assert calls == [40, 40] and way.shape == (41, 4, 4)
    pose, v = np.eye(4), np.zeros(3)
    for s, dt in zip(samples, np.diff(stamps)):
        acc = pose[:3, :3] @ plain(s[None, 3:] * dt / 2)[0] @ s[:3] + smoothing.GRAVITY
        new = pose.copy()
        new[:3, 3] += v * dt + acc * dt * dt / 2
        new[:3, :3] = pose[:3, :3] @ plain(s[None, 3:] * dt)[0]
        pose, v = new, v + acc * dt
    assert np.allclose(way[-1], pose) and np.allclose(speeds[-1], v)


def test_candidates_of_nearest_neighbours_are_not_sorted(spark, monkeypatch):
    """Only a point's k nearest leave the task that meets the candidates; ties by id, over batches and tables of distances."""
    rng = np.random.default_rng(8)
    at = np.round(rng.normal(0, 4, (500, 3)) * 2) / 2  # many are as far, and many at one place
    at[:60] = 1.0
    at[499] = 300.0
    rows = [(i % 2, int(p), *map(float, v)) for i, (p, v) in enumerate(zip(rng.permutation(500), at))]
    pts = spark.createDataFrame(rows, P).repartition(3)
    monkeypatch.setattr(joins, "squared", None)
    monkeypatch.setattr(joins, "HELD", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = joins.knn(pts, 7, 8.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r["frame_id"], r["point_id"], r["rank"]): (r["nbr_id"], r["d2"]) for r in found}
    assert len(got) == len(found) == 500 * 7
    for f in (0, 1):
        ids, xyz = np.array([r[1] for r in rows if r[0] == f]), np.array([r[2:] for r in rows if r[0] == f])
        for i, p in zip(ids, xyz):
            d2 = ((xyz - p) ** 2).sum(1)
            told = [(int(ids[j]), float(d2[j])) for j in np.lexsort((ids, d2))[:7]]
            assert [got[f, int(i), k + 1] for k in range(7)] == told


def told_radii(rows, start, least, most, flat):
    """Plain loop over all pairs, sums in whole millionths; with the ratios that were met."""
    seen, out = [], {}
    for f in {r[0] for r in rows}:
        ids, xyz = [r[1] for r in rows if r[0] == f], np.array([r[2:] for r in rows if r[0] == f])

        def ratio(p, r):
            d = xyz - p
            d = d[d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] < r * r]
            unit = lambda v: np.floor(v * 1e6 + 0.5).astype("int64").sum() / len(d) / 1e6
            m = [unit(d[:, i]) for i in range(3)]
            low, _, high = np.linalg.eigvalsh([[unit(d[:, i] * d[:, j]) - m[i] * m[j] for j in range(3)] for i in range(3)])
            seen.append(low / high if high > 1e-9 else None)
            return len(d), seen[-1]

        for i, p in zip(ids, xyz):
            r, now = start, ratio(p, start)[1]
            for _ in range(10):
                trial = r * 0.8 if now is not None and now > flat else r * 1.1
                if not least <= trial <= most:
                    break
                n, new = ratio(p, trial)
                if n < 10 or (trial > start and new is not None and new > flat):
                    break
                r, now = trial, new
            out[f, i] = r
    return out, seen


def test_radii_look_at_the_points_of_blocks_that_they_cut(spark, monkeypatch):
    """Pairs grow by less than the square; sums by blocks and, near the limit, by points give the radii of a plain loop."""
    from lodegrid.operators import radius

    share = []
    for n in (1000, 8000):
        blocks = [(np.stack([r[f"{c}s"] for c in "xyz"], 1), [np.array([r[f"{s}{c}"] for c in "xyz"]) for s in "lh"]) for r in radius.blocks_of(cloud(spark, n, 20.0, 1)).collect()]
        assert sum(len(p) for p, _ in blocks) == n and all((p.min(0) == e[0]).all() and (p.max(0) == e[1]).all() for p, e in blocks)
        seeds = np.concatenate([p for p, _ in blocks])[::50]
        masks = [radius.reached(seeds, np.full(len(seeds), 225.0), *e) for _, e in blocks]
        share.append(sum(int((s & ~w).sum()) * len(p) for (w, s), (p, _) in zip(masks, blocks)) / len(seeds) / n)
        for exact in (False, True):
            at = blocks[0][0]
            d = at[None] - seeds[:, None]
            met = (d**2).sum(2) < 225.0
            sums = radius.added(seeds, np.full(len(seeds), 225.0), at, exact)
            assert (np.rint(sums[:, 0]) == met.sum(1)).all() and np.allclose(sums[:, 1:4] / 1e6, (d * met[..., None]).sum(1), atol=1e-3)
            assert np.allclose(sums[:, [4, 5, 9]] / 1e6, np.stack([(d[..., i] * d[..., j] * met).sum(1) for i, j in ((0, 0), (0, 1), (2, 2))], 1), rtol=1e-9, atol=1e-2)
    assert share[1] < 0.7 * share[0] < 0.7
    rng = np.random.default_rng(9)
    at = np.concatenate([rng.normal(0, 6, (250, 3)), rng.normal(0, 6, (150, 3)) * [1, 1, 0.1] + [0, 0, 30], [[500.0, 0, 0]], np.full((12, 3), -300.0)])
    rows = [(i % 2, i, *map(float, p)) for i, p in enumerate(at)]
    pts = spark.createDataFrame([*rows, (0, 9000, float("nan"), 0.0, 0.0), (1, 9001, None, 0.0, 0.0)], P)
    exact, plain = [], radius.ball_sums
    monkeypatch.setattr(radius, "ball_sums", lambda s, b, e: exact.append(s.count() if e else 0) or plain(s, b, e))
    monkeypatch.setattr(radius, "BLOCK", 16)
    monkeypatch.setattr(radius, "SEEDS", 40)
    told, seen = told_radii(rows, 9.0, 4.0, 16.0, 0.2)
    got = {(r["frame_id"], r["seed"]): r["radius"] for r in radius.settled_radii(pts.withColumnRenamed("point_id", "seed"), pts, 9.0, 4.0, 16.0, 0.2).collect()}
    assert got == told | {(0, 9000): 9.0, (1, 9001): 9.0} and len(set(told.values())) > 4 and 0 < max(exact) < 60
    near = sorted(v for v in seen if v is not None and 0.2 < v < 0.5)
    limit = near[len(near) // 2] + 1e-9  # one seed is that near: whole sums decide
    told, _ = told_radii(rows, 9.0, 4.0, 16.0, limit)
    got = {(r["frame_id"], r["seed"]): r["radius"] for r in radius.settled_radii(pts.withColumnRenamed("point_id", "seed"), pts, 9.0, 4.0, 16.0, limit).collect()}
    assert got == told | {(0, 9000): 9.0, (1, 9001): 9.0}


def test_frames_of_one_task_need_no_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    at = {f: rng.uniform(0, 12, (60, 3)) for f in range(5)}
    pts = spark.createDataFrame([(f, i, *map(float, p)) for f, c in at.items() for i, p in enumerate(c)], "frame_id long, point_id long, x double, y double, z double")

    def roots(c, reach):
        root = list(range(len(c)))
        near = np.argwhere(((c[:, None] - c[None]) ** 2).sum(2) < reach * reach)
        while True:
            new = root[:]
            for a, b in near:
                new[a] = new[b] = min(new[a], new[b])
            if new == root:
                return {i: root[i] for i in range(len(c)) if (near[near[:, 0] == i][:, 1] != i).any()}
            root = new

    want = sorted((f, i, r) for f, c in at.items() for i, r in roots(c, 2.0).items())
    plain, called = moving.components, []
    monkeypatch.setattr(moving, "components", lambda e: called.append({r[0] for r in e.where("a <> b").select("a.frame_id").collect()}) or plain(e))
    assert sorted(map(tuple, moving.framed_components(joins.radius_pairs(pts, 2.0, wide=4)).collect())) == want
    assert called == [set()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks for so few rows
    try:
        assert sorted(map(tuple, moving.framed_components(joins.radius_pairs(pts, 2.0)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 0 < len(called[1]) < 5


def test_pairs_meet_once_with_what_they_carry(spark):
    rng = np.random.default_rng(9)
    at = rng.uniform(-6, 6, (150, 3))
    ids = rng.permutation(150)
    pts = spark.createDataFrame([(0, int(i), *map(float, p), f"n{i}") for i, p in zip(ids, at)], "frame_id long, point_id long, x double, y double, z double, name string")
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    want = sorted((0, int(ids[i]), int(ids[j]), f"n{ids[i]}", f"n{ids[j]}") for i, j in np.argwhere(d2 < 4) if ids[i] < ids[j])
    for wide in (1, 2, 4):
        got = joins.radius_pairs(pts, 2.0, carried=["name"], wide=wide)
        assert sorted(map(tuple, got.drop("d2").collect())) == want != []
    rows = joins.radius_pairs(pts, 2.0, wide=4)._jdf.queryExecution().optimizedPlan().toString()
    assert ">=" in rows  # a row goes to its own cell and those after it, not to all around


def test_features_are_summed_where_points_meet(spark, monkeypatch):
    """No row a pair: the features are those of all pairs, whatever the cells; copies at the same place are no neighbours."""
    from lodegrid.operators import places

    rng = np.random.default_rng(11)
    at = rng.uniform(-5, 5, (120, 3))
    at[60:70] = at[:10]
    n = rng.normal(size=at.shape)
    n /= np.linalg.norm(n, axis=1)[:, None]
    pts = spark.createDataFrame([(7, i, *map(float, p)) for i, p in enumerate(at)], P)
    normals = spark.createDataFrame([(7, i, *map(float, v)) for i, v in enumerate(n)], "frame_id long, point_id long, nx double, ny double, nz double")
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    near = (d2 < 9) & (d2 > 0)
    h = np.zeros((120, 3, 11))
    for i, j in np.argwhere(near):
        line = (at[j] - at[i]) / np.sqrt(d2[i, j])
        v = np.cross(n[i], line)
        v /= np.linalg.norm(v)
        one = [v @ n[j], n[i] @ line, np.arctan2(np.cross(n[i], v) @ n[j], n[i] @ n[j]) / np.pi]
        for k, c in enumerate(one):
            h[i, k, min(10, int((c + 1) / 2 * 11))] += 1
    share = h.reshape(120, 33) / np.maximum(1, near.sum(1))[:, None]
    w = np.where(near, 1 / np.sqrt(np.where(near, d2, 1)), 0)
    want = share + w @ share / np.maximum(w.sum(1), 1e-300)[:, None]
    for many in (4, 1 << 10):
        monkeypatch.setattr(places, "MANY", many)
        own, around = places.celled(pts, 3.0)
        assert own.count() == 120 and (many > 4 or own.select("ix", "iy", "iz").distinct().count() > 50)
        met = places.histograms(pts, normals, 3.0)
        assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
        got = {r["point_id"]: r["f"] for r in places.features(pts, normals, 3.0).collect()}
        assert sorted(got) == np.flatnonzero(near.any(1)).tolist()
        assert all(np.allclose(got[i], want[i], atol=1e-12) for i in got)
