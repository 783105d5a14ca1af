"""Verdicts that depend on the frames before: labels of boxes, feedback, history and sequences."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodegrid.operators import feedback as K
from lodegrid.operators import moving
from lodegrid.plans import rejection


def box(i, x, side=2.0):
    return {"box_idx": i, "cx": x, "cy": 0.5, "cz": 0.5, "sx": side, "sy": side, "sz": side}


def voxel(x, before):
    """One voxel at x; before: where it was, or None."""
    old = (np.nan,) * 3 if before is None else (before, 0.5, 0.5)
    cell = lambda v: (int(np.floor(v)), 0, 0)
    return pd.DataFrame([dict(zip(("x", "y", "z", "u", "v", "w", "ix", "iy", "iz", "px", "py", "pz", "fixed", "is_wall"), (x, 0.5, 0.5, *old, *cell(x), *cell(before or 0.0), False, False)))])


def run(xs, p, start=None, dt=0.1, travel=0.0):
    state = start or {"tracks": [], "next": 0, "past": []}
    out = []
    for i, x in enumerate(xs):
        value, says = K.scan_step(state, [box(0, x)], voxel(x, xs[i - 1] if i else None), 1.0, 5, {"w_near": 0.1} | moving.SCORE, K.BOXES | p, dt, travel)
        out.append(bool(says[0]))
    return out, state


FAST = [0.5 + 1.45 * k for k in range(5)]  # -0.1 + 1.35 is over 0.4 * 3, what a voxel on its own needs


def test_what_moved_before_needs_less():
    slow = FAST[-1] + 0.4
    # On its own -0.1 + 0.3 isn't over 1.2; in a box that is known to move, 0.2 + 0.3 is over 0.4 * 0.55, and 0.5 a share of all its voxels.
    assert run([0.5, 0.9], {})[0] == [False, False]
    said, state = run([*FAST, slow], {})
    assert said == [False, True, True, True, True, True]
    assert state["tracks"][0]["run"] == 5 and state["tracks"][0].get("locked") is None
    # Not confirmed yet: it moved in the frame before, so -0.1 + 0.3 has to pass 0.4 * 0.7, and doesn't.
    assert run([*FAST, slow], {"confirm": 9})[0] == [False, True, True, True, True, False]
    assert run([*FAST, FAST[-1] + 0.6], {"confirm": 9})[0][-1]
    assert run([0.5, 1.95], {}, travel=1.0)[0] == [False, False] and run([0.5, 1.95], {})[0] == [False, True]  # 1.2 * 1.5 isn't passed


def test_a_settled_track_stays():
    rest = [0.5] * 4
    said, state = run(rest, {"permanent": 3})
    assert said == [False] * 4 and state["tracks"][0]["locked"] is False
    said, state = run([*FAST[:4], FAST[3], FAST[3]], {"permanent": 3})
    assert said == [False, True, True, True, True, True] and state["tracks"][0]["locked"] is True


def test_an_unseen_track_starts_again():
    _, state = run(FAST[:3], {})
    assert state["tracks"][0]["run"] == 2
    K.scan_step(state, [], voxel(2.7, 2.7), 1.0, 5, {"w_near": 0.1} | moving.SCORE, K.BOXES)
    assert state["tracks"][0]["run"] == 0 and state["tracks"][0]["missed"] == 1


def test_speed_is_by_the_second(spark):
    """The same places at 10 Hz and at 1 Hz: speeds in metres a second, so ten times as fast; no time, no new speed."""
    for dt in (0.1, 1.0):
        _, state = run([0.0, 1.0, 2.0], {}, dt=dt)
        assert abs(state["tracks"][0]["vx"] - (0.6 * 0.4 + 0.4) / dt) < 1e-12
    assert run([0.0, 1.0], {}, dt=0.0)[1]["tracks"][0]["vx"] == 0.0
    rows = [(1, f, t, 0, x, 0.0, 0.0, 4.0, 2.0, 2.0) for f, t, x in ((0, 10.0, 0.0), (1, 10.5, 1.0), (2, 12.5, 2.0))]
    frames = spark.createDataFrame(rows, "seq_id long, frame_id long, stamp double, box_idx long, cx double, cy double, cz double, sx double, sy double, sz double")
    assert [round(r["vx"], 9) for r in moving.tracked(frames).orderBy("frame_id").collect()] == [0.0, 0.8, 0.68]
    assert [round(r["vx"], 9) for r in moving.tracked(frames.drop("stamp")).orderBy("frame_id").collect()] == [0.0, 4.0, 6.4]


def test_two_boxes_on_a_settled_track():
    """The one that is matched takes its flags; the other becomes a new track, which moves only by its own voxels."""
    state = {"tracks": [box(0, 0.0, 4.0) | {"id": 9, "age": 20, "missed": 0, "vx": 0.0, "vy": 0.0, "vz": 0.0, "locked": True, "run": 12}], "next": 10, "past": [{}]}
    first, second = box(0, 0.0, 4.0), box(1, 1.2, 2.2) | {"cy": 2.5, "cz": 0.5}
    K.scan_step(state, [first, second], voxel(1.2, 1.2).assign(y=3.2, v=3.2), 1.0, 5, {"w_near": 0.1} | moving.SCORE, K.BOXES | {"suppress": 1.0, "peers": 0.0})
    settled, new = state["tracks"]
    assert (settled["id"], settled["age"], settled["locked"]) == (9, 21, True)
    assert new["id"] == 10 and new.get("locked") is None and new["run"] == -1


def test_a_union_keeps_what_either_knows():
    from lodegrid.operators.merge import merge_peers

    unknown, known = box(0, 0.0, 4.0) | {"track_id": -1, "moves": False}, box(1, 0.5) | {"track_id": 5, "moves": True}
    other = box(2, -0.5) | {"track_id": 7, "moves": False}
    (one,) = merge_peers([unknown, known], 2.0)
    assert (one["track_id"], one["moves"]) == (5, True)
    both = merge_peers([unknown, known, other], 2.0)
    assert sorted((b["track_id"], b["moves"]) for b in both) == [(5, True), (7, False)]
    assert len(merge_peers([unknown, known], 0.0)) == 2


def test_boxes_that_hold_a_voxel_decide_before_drawn_out_ones(spark):
    """A resting box beside a moving one that is drawn out over it; a voxel outside both; a wall."""
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0, 2.0, 0.0, True), (1, 4.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0, 0.0, False), (2, 30.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0, 0.0, True)], "box_idx long, cx double, cy double, cz double, sx double, sy double, sz double, vx double, vy double, is_dynamic boolean")
    at = {0.2: True, 0.4: True, 4.0: False, 4.2: False, 2.5: False, 7.0: True, 2.6: True}
    cells = [(0, k, 0, 0, x, 0.0, 0.0, moves, x == 2.6) for k, (x, moves) in enumerate(at.items())]
    vox = spark.createDataFrame(cells, "frame_id long, ix long, iy long, iz long, mx double, my double, mz double, is_dynamic boolean, is_wall boolean")
    out = {r["mx"]: r["is_dynamic"] for r in moving.spread_to_boxes(vox, boxes).collect()}
    assert out == {0.2: True, 0.4: True, 4.0: False, 4.2: False, 2.5: True, 7.0: False, 2.6: True}
    locked = boxes.withColumns({"locked": F.lit(True), "is_dynamic": F.col("box_idx") == 1})
    assert {r["mx"] for r in moving.spread_to_boxes(vox, locked).where("is_dynamic").collect()} == {4.0, 4.2, 2.6}
    flags = {r["mx"]: r["in_box"] for r in moving.in_dynamic_box(vox, boxes).collect()}
    assert flags == {0.2: True, 0.4: True, 4.0: True, 4.2: True, 2.5: True, 7.0: None, 2.6: True}
    p = np.array([[x, 0.0, 0.0] for x in at])
    rows = [b.asDict() for b in boxes.collect()]
    assert K.spread(p, rows, [rows[0]]).tolist() == [True, True, False, False, True, False, True]


def test_labels_and_suppression():
    tracks = [{"id": 3, "run": 3} | box(0, 0.0), {"id": 4, "locked": False, "run": 5} | box(0, 1.0)]
    far, near, between = K.labelled([box(0, 9.0), box(1, 0.1), box(2, 0.5)], tracks, K.BOXES)
    assert (far["track_id"], far["moves"]) == (-1, False) and (near["track_id"], near["moves"], near["locked"]) == (3, True, False)
    assert between["track_id"] == 3  # as much of either: the older one
    a, b = box(0, 0.0, 2.0) | {"track_id": 3}, box(1, 0.2, 1.8) | {"track_id": 4}
    assert len(K.unsuppressed([a, b], 0.5)) == 2 and [k["box_idx"] for k in K.unsuppressed([b | {"track_id": -1}, a], 0.5)] == [0]


def test_score_is_that_of_one_step(spark):
    rng = np.random.default_rng(5)
    n = 300
    rows = pd.DataFrame({"i": range(n), "n": rng.integers(1, 6, n), "in_box": rng.random(n) < 0.4, "shift2": np.where(rng.random(n) < 0.2, np.nan, rng.random(n) * 2), "n_static": rng.integers(0, 5, n), "prev_dynamic": rng.random(n) < 0.3})
    given = spark.createDataFrame(rows).withColumn("shift2", F.when(~F.isnan("shift2"), F.col("shift2")))
    want = moving.scored(given, 2.0, 3, 4).orderBy("i").toPandas()
    value, says = K.score_of((rows["n"] < 3).to_numpy(), rows["in_box"].to_numpy(), np.sqrt(rows["shift2"].to_numpy()), rows["n_static"].to_numpy() / 4, rows["prev_dynamic"].to_numpy(), 2.0, moving.SCORE)
    assert np.allclose(value, want["score"]) and (says == want["is_dynamic"]).all() and says.any()


def drawn_out(p, c, h, v):
    """A footprint by its definition: half sides seen along and across the heading, grown by the speed."""
    speed = float(np.hypot(*v))
    used = min(speed, 5.0) if speed > 0.05 else 0.0
    u = np.array(v) / speed if speed > 0.05 else np.array([1.0, 0.0])
    w = np.array([-u[1], u[0]])
    d = np.asarray(p[:2]) - np.asarray(c[:2]) - u * used * (2.5 - 0.35) / 2
    long, wide = 2**0.5 * np.abs(u) @ h[:2] + used * (2.5 + 0.35) / 2, 2**0.5 * np.abs(w) @ h[:2] + used * 0.5
    return abs(p[2] - c[2]) <= h[2] and (d @ u / long) ** 2 + (d @ w / wide) ** 2 <= 1


def test_footprints(spark):
    """Of a long box that moves across its length, one that creeps, and others; in columns and in the fold."""
    from lodegrid.functions.geometry import in_inflated, vec

    at = np.random.default_rng(6).uniform(-9, 9, (900, 3))
    pts = spark.createDataFrame(pd.DataFrame(at, columns=["x", "y", "z"])).coalesce(1)
    for size, v in (((1.0, 8.0, 3.0), (0.0, 2.0)), ((8.0, 1.0, 6.0), (0.0, 1.0)), ((3.0, 3.0, 3.0), (1.0, 2.0)), ((3.0, 2.0, 5.0), (9.0, 0.0)), ((4.0, 2.0, 5.0), (0.03, 0.03)), ((2.0, 5.0, 5.0), (-2.0, 0.5))):
        b = {"cx": 0.5, "cy": 0.5, "cz": 0.5, "sx": size[0], "sy": size[1], "sz": size[2], "vx": v[0], "vy": v[1]}
        lits = [F.lit(float(x)) for x in (0.5, 0.5, 0.5, *size, *v)]
        got = [r[0] for r in pts.select(in_inflated(vec("x", "y", "z"), tuple(lits[:3]), tuple(lits[3:6]), (lits[6], lits[7], F.lit(0.0)))).collect()]
        told = [bool(drawn_out(p, (0.5,) * 3, np.array(size) / 2, v)) for p in at]
        assert K.reached(at, b).tolist() == got == told and any(told)
        assert all(t for t, p in zip(told, at) if np.all(np.abs(p - 0.5) <= np.array(size) / 2)) or np.hypot(*v) > 0.05


def test_footprint_of_a_turned_box(spark):
    from lodegrid.functions.geometry import in_inflated

    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    quarter = F.array(*lit(0, -1, 0, 1, 0, 0, 0, 0, 1))
    inside = lambda p, v: spark.range(1).select(in_inflated(lit(*p), lit(0, 0, 0), lit(8, 1, 2), lit(*v, 0), turn=quarter)).first()[0]
    assert inside((0, 5.5, 0), (0, 0)) and not inside((5.5, 0, 0), (0, 0))
    assert inside((0, 3.9, 0), (1, 0)) and inside((2.5, 0, 0), (1, 0)) and not inside((-2.5, 0, 0), (1, 0))


def test_sequences_of_equal_frames_stay_apart(spark):
    rng = np.random.default_rng(4)
    rows = []
    for seq, speed in ((0, 1.4), (7, 0.0)):
        ground, car = np.column_stack([rng.uniform(0, 20, (200, 2)), np.zeros(200)]), rng.uniform(0, 1, (80, 3)) * [1.5, 1, 1] + [8, 12, 1]
        for f in range(3):
            rows += [(seq, f, i, *map(float, p)) for i, p in enumerate(np.concatenate([ground, car + [speed * f, 0, 0]]))]
    pts = spark.createDataFrame([*rows, (7, 1, 999, None, 1.0, 1.0)], "seq_id long, frame_id long, point_id long, x double, y double, z double")
    way = lambda p: sorted(tuple(r) for r in rejection.rejected(p, 1.0, 0.5, 1.6, 2, 2).select("seq_id", "frame_id", "point_id", "is_dynamic").collect())
    both = way(pts)
    assert len(both) == len(rows) and both == sorted(way(pts.where("seq_id = 0")) + way(pts.where("seq_id = 7")))
    assert any(r[3] for r in both if r[0] == 0) and not any(r[3] for r in both if r[0] == 7)
    assert not any(r[3] for r in both if r[1] == 0)
    assert way(pts.where("seq_id = 5")) == []
