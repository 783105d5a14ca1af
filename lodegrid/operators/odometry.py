"""Inertial odometry over a local map: each scan's pose is predicted from the samples since the last one, corrected by laying
the scan's points on the map's voxels, and the scan is put into the map.

A scan depends on the one before, so a sequence is a fold over its messages (samples and scans, by stamp); sequences are
independent. The state is the last pose and speed, the samples since, and the map: voxels with a count, sums of places and
covariances, and the last frame that touched them. Voxels that no frame touched for `horizon` frames are dropped, and so
the state is bounded by what the sensor sees in that time. The same step runs over a stored table and over a stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from .cloud import COV, XYZ
from .graph import rotation
from .motion import quaternion
from .posegraph import residuals
from .registration import symmetric, total_sums, turned
from .smoothing import SAMPLE, predicted

#: Voxel size; frames after which an untouched voxel goes; full scans that begin the map, and the share of later ones' points
#: that is put in; rounds of a correction and when it ends (metres, degrees); standard deviations of the prediction (turn,
#: shift, for each second); share of a correction that the speed takes.
PARAMETERS = {"res": 1.0, "horizon": 100, "full": 5, "share": 0.5, "rounds": 10, "shift": 1e-3, "degrees": 1e-3, "turn_sigma": 0.2, "shift_sigma": 1.0, "gain": 0.5}
OUT = "seq_id long, frame_id long, stamp double, x double, y double, z double, qx double, qy double, qz double, qw double, vx double, vy double, vz double, n_met long, n_voxels long"
IMU, SCAN = 0, 1


def messages(points: DataFrame, imu: DataFrame) -> DataFrame:
    """seq_id, stamp, kind, frame_id, values: samples (six numbers) and scans, one row each. points: seq_id, frame_id, stamp (of
    the scan), point_id, x, y, z and a covariance (COV); a row holds one scan (nine numbers a point, by id)."""
    item = F.struct("point_id", F.array(*[F.col(c).cast("double") for c in (*XYZ, *COV)]).alias("v"))
    scans = points.groupBy("seq_id", "frame_id", "stamp").agg(F.sort_array(F.collect_list(item)).alias("all"))
    scans = scans.select("seq_id", "stamp", F.lit(SCAN).alias("kind"), "frame_id", F.flatten(F.transform("all", lambda p: p["v"])).alias("values"))
    return imu.select("seq_id", "stamp", F.lit(IMU).alias("kind"), F.lit(None).cast("long").alias("frame_id"), F.array(*[F.col(c).cast("double") for c in SAMPLE]).alias("values")).unionByName(scans)


def packed(place: np.ndarray, res: float) -> np.ndarray:
    """A number for each place's voxel: 21 bits an axis."""
    cell = np.floor(place / res).astype(np.int64) + (1 << 20)
    return (cell[:, 0] << 42) | (cell[:, 1] << 21) | cell[:, 2]


def fresh() -> dict:
    none = np.zeros((0, 9))
    return {"stamp": None, "pose": np.eye(4), "v": np.zeros(3), "step": np.eye(4), "frames": 0, "samples": [], "held": None, "keys": np.zeros(0, np.int64), "n": np.zeros(0), "sums": none, "last": np.zeros(0, np.int64)}


def corrected(state: dict, guess: np.ndarray, points: np.ndarray, covs: np.ndarray, dt: float, p: dict) -> tuple[np.ndarray, int]:
    """The pose near the guess that lays the points on the map's voxels, and how many met one."""
    pose, met = guess, 0
    prior = 1 / np.array([p["turn_sigma"] * max(dt, 1e-3)] * 3 + [p["shift_sigma"] * max(dt, 1e-3)] * 3) ** 2
    full = symmetric(covs).reshape(-1, 9)
    for _ in range(p["rounds"]):
        q = points @ pose[:3, :3].T + pose[:3, 3]
        at = np.searchsorted(state["keys"], key := packed(q, p["res"]))
        hit = np.flatnonzero((at < len(state["keys"])) & (state["keys"][np.minimum(at, len(state["keys"]) - 1)] == key)) if len(state["keys"]) else np.zeros(0, np.int64)
        met = len(hit)
        if met < 6:
            return guess, met
        at = at[hit]
        mean = state["sums"][at] / state["n"][at, None]
        around = full[hit] @ np.kron(pose[:3, :3], pose[:3, :3])[[0, 1, 2, 4, 5, 8]].T
        h, g, _ = total_sums(q[hit], around, mean[:, :3], mean[:, 3:])
        e, _, j = residuals(guess[None], pose[None], np.eye(4)[None])
        left = np.eye(6)  # a small turn of the world, as a turn on the pose's right and a shift
        left[:3, :3] = pose[:3, :3].T
        t = pose[:3, 3]
        left[3:, :3] = -np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]])
        j = j[0] @ left
        step = -np.linalg.solve(h + j.T @ (prior[:, None] * j) + 1e-9 * np.eye(6), g + j.T @ (prior * e[0]))
        pose = turned(step, pose)
        if np.linalg.norm(step[3:]) < p["shift"] and np.degrees(np.linalg.norm(step[:3])) < p["degrees"]:
            break
    pose = pose.copy()
    u, _, vt = np.linalg.svd(pose[:3, :3])
    pose[:3, :3] = u @ vt
    return pose, met


def remembered(state: dict, frame: int, points: np.ndarray, covs: np.ndarray, p: dict) -> None:
    """Puts the points of a scan into the map and drops what wasn't touched for long."""
    if state["frames"] >= p["full"]:  # a repeatable sample: which points is a matter of their number and the frame
        mixed = (np.arange(len(points), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(state["frames"] * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)) >> np.uint64(40)
        keep = mixed < p["share"] * (1 << 24)
        points, covs = points[keep], covs[keep]
    r = state["pose"][:3, :3]
    place = points @ r.T + state["pose"][:3, 3]
    around = (r @ symmetric(covs) @ r.T)[:, [0, 0, 0, 1, 1, 2], [0, 1, 2, 1, 2, 2]]
    keys = np.concatenate([state["keys"], packed(place, p["res"])])
    keys, of = np.unique(keys, return_inverse=True)
    n, sums, last = np.zeros(len(keys)), np.zeros((len(keys), 9)), np.zeros(len(keys), np.int64)
    old = of[: len(state["keys"])]
    n[old], sums[old], last[old] = state["n"], state["sums"], state["last"]
    new = of[len(state["keys"]) :]
    np.add.at(n, new, 1.0)
    np.add.at(sums, new, np.concatenate([place, around], 1))
    last[new] = state["frames"]
    live = last > state["frames"] - p["horizon"]
    state.update(keys=keys[live], n=n[live], sums=sums[live], last=last[live])


def advance(state: dict, stamp: float, kind: int, frame_id: int | None, values: np.ndarray, p: dict) -> tuple | None:
    """One message: samples are held, a scan gives its estimate (a row of OUT but for the sequence). Messages older than the
    last scan are passed over."""
    if state["stamp"] is not None and stamp < state["stamp"]:
        return None
    if kind == IMU:
        state["samples"].append((stamp, values))
        return None
    scan = np.asarray(values, float).reshape(-1, 9)
    points, covs = scan[:, :3], scan[:, 3:]
    if state["stamp"] is None:
        if state["samples"]:  # at rest: the mean acceleration points up
            up = np.mean([v[:3] for _, v in state["samples"]], axis=0)
            up /= max(np.linalg.norm(up), 1e-12)
            axis, cosine = np.cross(up, [0, 0, 1]), up[2]
            size = np.linalg.norm(axis)
            state["pose"][:3, :3] = rotation(axis / size * np.arctan2(size, cosine)) if size > 1e-9 else np.diag([1.0, cosine, cosine]) if abs(cosine) > 0.5 else np.eye(3)
        met = len(points)
    else:
        dt = stamp - state["stamp"]
        inside = [s for s in state["samples"] if s[0] < stamp]
        if len(inside) >= 2:
            held = inside[0][1] if state["held"] is None else state["held"]
            stamps = np.array([state["stamp"], *[t for t, _ in inside], stamp])
            way, speeds = predicted(state["pose"], state["v"], np.zeros(6), stamps, np.array([held, *[v for _, v in inside]]))
            guess, speed = way[-1], speeds[-1]
        else:  # no samples: as before
            guess, speed = state["pose"] @ state["step"], state["v"]
        pose, met = corrected(state, guess, points, covs, dt, p)
        off = (pose[:3, 3] - guess[:3, 3]) / dt if dt > 0 else 0.0
        state.update(step=np.linalg.inv(state["pose"]) @ pose, pose=pose, v=speed + p["gain"] * off)
    earlier = [v for t, v in state["samples"] if t < stamp]
    state["held"] = earlier[-1] if earlier else state["held"]
    state["samples"] = [s for s in state["samples"] if s[0] >= stamp]
    state["stamp"] = stamp
    remembered(state, frame_id, points, covs, p)
    state["frames"] += 1
    return (frame_id, stamp, *state["pose"][:3, 3], *quaternion(state["pose"][:3, :3]), *state["v"], met, len(state["keys"]))


def estimated(rows: DataFrame, **parameters: float) -> DataFrame:
    """seq_id, frame_id, stamp, the sensor's pose and speed in the world, n_met (points that met the map's voxels), n_voxels, of
    each scan among the messages. The world begins at the first scan, with the mean of the accelerations before it as up."""
    p = PARAMETERS | parameters
    names = [f.split()[0] for f in OUT.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, state = None, {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.seq_id != seq:
                    seq, state = row.seq_id, fresh()
                made = advance(state, row.stamp, row.kind, row.frame_id, row.values, p)
                if made is not None:
                    out.append((seq, int(made[0]), *made[1:]))
            yield pd.DataFrame(out, columns=names)

    given = rows.where("stamp IS NOT NULL").select("seq_id", "stamp", "kind", F.coalesce("frame_id", F.lit(-1)).alias("frame_id"), "values")
    return given.repartition("seq_id").sortWithinPartitions("seq_id", "stamp", "kind", "frame_id").mapInPandas(work, OUT)


def estimated_stream(rows: DataFrame, **parameters: float) -> DataFrame:
    """The same over a stream of messages, which arrive by stamp (within a micro-batch in any order); those that come after a
    later scan are passed over. The state of a sequence is its map and last pose."""
    p = PARAMETERS | parameters
    names = [f.split()[0] for f in OUT.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else fresh()
        rows = pd.concat(list(batches)).sort_values(["stamp", "kind", "frame_id"], kind="stable")
        made = [advance(held, r.stamp, r.kind, r.frame_id, r.values, p) for r in rows.itertuples(index=False)]
        state.update((pickle.dumps(held),))
        yield pd.DataFrame([(key[0], int(m[0]), *m[1:]) for m in made if m is not None], columns=names)

    given = rows.where("stamp IS NOT NULL").select("seq_id", "stamp", "kind", F.coalesce("frame_id", F.lit(-1)).alias("frame_id"), "values")
    return given.groupBy("seq_id").applyInPandasWithState(step, OUT, "state binary", "append", "NoTimeout")
