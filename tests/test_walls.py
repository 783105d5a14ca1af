"""The registry of walls by hand-made cases and against a plain loop."""

import numpy as np
import pandas as pd

from lodegrid.operators import walls as W

FRAMES = "seq_id long, frame_id long, pose array<double>"
WALLS = "seq_id long, frame_id long, box_idx long, cx double, cy double, cz double, sx double, sy double, sz double, turn array<double>"
VOXELS = "seq_id long, frame_id long, voxel_id long, mx double, my double, mz double, is_wall boolean"


def about(degrees, shift=(0.0, 0.0, 0.0)):
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    return np.array([[c, -s, 0, shift[0]], [s, c, 0, shift[1]], [0, 0, 1, shift[2]], [0, 0, 0, 1.0]])


def wall(frame, k, centre, size=(0.2, 4.0, 2.0), turn=None, seq=0):
    return (seq, frame, k, *map(float, centre), *map(float, size), turn)


def voxel(frame, k, at, seq=0, is_wall=False):
    return (seq, frame, k, *map(float, at), is_wall)


def run(spark, frames, walls, voxels, most_missed=None):
    made = W.registered(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(walls, WALLS), spark.createDataFrame(voxels, VOXELS), most_missed).collect()
    marks = {(r["seq_id"], r["frame_id"], r["voxel_id"]): (r["wall_id"], r["is_wall"]) for r in made if r["kind"] == "voxel"}
    left = {(r["seq_id"], r["frame_id"], r["wall_id"]): r for r in made if r["kind"] == "wall"}
    assert len(marks) + len(left) == len(made)
    return marks, left


def test_boxes_move_by_the_pose_and_go_when_empty(spark):
    pose = about(90, (0, 0, 1))
    frames = [(0, 0, None), (0, 1, [*map(float, pose.ravel())]), (0, 2, None)]
    voxels = [voxel(0, 0, (5, 1, 0)), voxel(0, 1, (9, 9, 9)), voxel(1, 0, (-1, 5, 1)), voxel(1, 1, (5, 1, 0)), voxel(2, 0, (0, 0, 50)), voxel(3, 0, (-1, 5, 1))]
    marks, left = run(spark, frames, [wall(0, 0, (5, 0, 0)), wall(0, 1, (20, 0, 0))], voxels)
    assert marks[0, 0, 0] == (0, True) and marks[0, 0, 1] == (None, False)
    assert marks[0, 1, 0] == (0, True) and marks[0, 1, 1] == (None, False)
    assert set(left) == {(0, 0, 0), (0, 1, 0)}  # wall 1 held no voxel, wall 0 none in frame 2
    assert marks[0, 3, 0] == (None, False)
    assert np.allclose([left[0, 1, 0][c] for c in ("cx", "cy", "cz")], [0, 5, 1])
    assert np.allclose(np.array(left[0, 1, 0]["turn"]).reshape(3, 3), pose[:3, :3])


def test_joining_needs_a_like_normal_a_near_centre_and_overlap(spark):
    first = [wall(0, 0, (5, 0, 0)), wall(0, 1, (0, 0, 0), (0, 0, 0))]
    held = [voxel(f, 0, (5, 0.1, 0)) for f in (0, 1)]
    turned = [*map(float, about(45)[:3, :3].ravel())]
    cases = {"joined": wall(1, 0, (5, 1, 0)), "turned": wall(1, 0, (5, 0, 0), turn=turned), "apart": wall(1, 0, (5, 0, 3.0)), "far": wall(1, 0, (5, 5.5, 0), (0.2, 9.0, 2.0))}
    for name, more in cases.items():
        marks, left = run(spark, [], [*first, more], [*held, voxel(1, 1, more[3:6])])
        ids = {k[2] for k in left if k[1] == 1}
        if name == "joined":
            assert ids == {0} and np.isclose(left[0, 1, 0]["sy"], 5.0) and np.isclose(left[0, 1, 0]["cy"], 0.5)
        elif name == "turned":
            assert marks[0, 1, 1] == (0, True) and ids == {0}  # first come, first marked: the new one stays empty
        else:
            assert ids == {0, 1}


def test_missed_frames_and_earlier_marks(spark):
    voxels = [voxel(f, 0, (5, 0, 0)) for f in range(5)] + [voxel(0, 1, (5, 0, 0), is_wall=True)]
    marks, left = run(spark, [], [wall(0, 0, (5, 0, 0)), *[wall(f, 0, (50, 50, 0)) for f in range(1, 5)]], voxels, most_missed=2)
    assert marks[0, 0, 1] == (None, True)
    assert [marks[0, f, 0][0] for f in range(5)] == [0, 0, 0, None, None]
    assert left[0, 2, 0]["missed"] == 2 and (0, 3, 0) not in left
    assert run(spark, [], [], [])[0] == {}


def test_overlap_of_turned_boxes():
    one = W.Wall(0, np.zeros(3), np.array([4.0, 4, 4]), np.eye(3))
    inside = W.Wall(1, np.zeros(3), np.array([2.0, 2, 2]), np.eye(3))
    assert np.isclose(W.overlap(one, inside), 27 / (64 + 8 - 27))  # half extents add up, as defined
    assert np.isclose(W.overlap(one, one), 1.0)
    corner = W.Wall(2, np.array([3.5, 3.5, 0]), np.array([2.0, 2, 2]), about(45)[:3, :3])
    assert W.overlap(one, corner) == 0.0  # parted by the second box's own axis only


def plain(frames, walls, voxels):
    """Sequence by sequence with lists; the boxes are upright, moves are shifts."""
    marks = {}
    for s in {r[0] for r in [*walls, *voxels]}:
        known, count = [], 0
        for f in sorted({r[1] for r in [*frames, *walls, *voxels] if r[0] == s}):
            move = next((p for a, b, p in frames if (a, b) == (s, f)), None)
            if move is not None:
                for k in known:
                    k["c"] = k["c"] + np.array([move[3], move[7], move[11]])
            old = list(known)
            for r in sorted(w for w in walls if w[:2] == (s, f)):
                c, z = np.array(r[3:6]), np.array(r[6:9])
                best, found = 0.3, None
                for k in old:
                    d = np.abs(k["c"] - c)
                    part = (k["z"] + z) / 2 - d
                    if (d**2).sum() > 25 or (part <= 0).any():
                        continue
                    v = np.minimum(part, k["z"]).prod()
                    if (share := v / (k["z"].prod() + z.prod() - v + 1e-9)) > best:
                        best, found = share, k
                if found is None:
                    known.append({"id": count, "c": c, "z": z})
                    count += 1
                else:
                    lo, hi = np.minimum(found["c"] - found["z"] / 2, c - z / 2), np.maximum(found["c"] + found["z"] / 2, c + z / 2)
                    found |= {"c": (lo + hi) / 2, "z": hi - lo}
            used = set()
            for r in (v for v in voxels if v[:2] == (s, f)):
                hit = next((k["id"] for k in known if (np.abs(np.array(r[3:6]) - k["c"]) <= k["z"] / 2).all()), None)
                marks[r[:3]] = hit
                used.add(hit)
            known = [k for k in known if k["id"] in used]
    return marks


def test_like_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    frames, walls, voxels = [], [], []
    for s in range(4):
        for f in range(12):
            shift = rng.normal(0, 0.2, 3)
            frames.append((s, f, [*map(float, about(0, shift).ravel())] if f % 3 else None))
            walls += [wall(f, k, rng.uniform(-6, 6, 3), rng.uniform(1, 5, 3), seq=s) for k in range(4)]
            voxels += [voxel(f, k, rng.uniform(-6, 6, 3), seq=s) for k in range(25)]
    want = plain(frames, walls, voxels)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # frames that span batches
    try:
        marks, _ = run(spark, frames, walls, voxels)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: v[0] for k, v in marks.items()} == want
    assert len({v for v in want.values()}) > 5 and pd.Series(list(want.values())).isna().any()
