"""Inertial integration, deskewing, filters over poses, and what checks them. A step that depends on the one before is a fold
over one sequence's ordered rows; sequences are independent and are dealt out by their id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import expmap, lerp, moved_by, slerp, vec
from .clock import as_of, bracketed

GRAVITY = np.array([0.0, 0.0, -9.80665])


def turn_of(w: np.ndarray) -> np.ndarray:
    """Rotation matrix of a rotation vector."""
    angle = float(np.linalg.norm(w))
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if angle < 1e-10:
        return np.eye(3) + k
    return np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * (k @ k)


def quaternion(r: np.ndarray) -> np.ndarray:
    """x, y, z, w of a rotation matrix, w >= 0; or of each of a stack."""
    k, trace = np.zeros((*r.shape[:-2], 4, 4)), np.trace(r, axis1=-2, axis2=-1)
    for i in range(3):
        k[..., i, i] = 2 * r[..., i, i] - trace
    k[..., 3, 3] = trace
    for i, j in ((0, 1), (0, 2), (1, 2)):
        k[..., j, i] = r[..., i, j] + r[..., j, i]
    for i, (a, b) in enumerate(((2, 1), (0, 2), (1, 0))):
        k[..., 3, i] = r[..., a, b] - r[..., b, a]
    q = np.linalg.eigh(k / 3, "L")[1][..., -1]
    return np.where(q[..., 3:] >= 0, q, -q)


def folded(rows: DataFrame, order: str, start: Callable[[], dict], step: Callable[[dict, dict], tuple | None], schema: str) -> DataFrame:
    """seq_id and what step returns for each row, row by row in order within a sequence.

    Rows come as a stream of Arrow batches sorted by sequence: only the state of one sequence is held, however long it is."""
    names = [f.split()[0] for f in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, state = None, {}
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if row["seq_id"] != seq:
                    seq, state = row["seq_id"], start()
                made = step(state, row)
                if made is not None:
                    out.append((seq, *made))
            yield pd.DataFrame(out, columns=["seq_id", *names])

    return rows.repartition("seq_id").sortWithinPartitions("seq_id", order).mapInPandas(work, f"seq_id long, {schema}")


def integrated(imu: DataFrame, bias: tuple[float, ...] = (0.0,) * 6) -> DataFrame:
    """Pose and speed after each sample (seq_id, stamp in seconds, ax..az, wx..wz), from rest at the origin: the acceleration
    is turned to the world by the mean of the turns before and after the step."""
    ba, bw = np.asarray(bias[:3]), np.asarray(bias[3:])

    def start() -> dict:
        return {"t": None, "r": np.eye(3), "v": np.zeros(3), "p": np.zeros(3)}

    def step(s: dict, x: dict) -> tuple:
        a, w = np.array([x["ax"], x["ay"], x["az"]]) - ba, np.array([x["wx"], x["wy"], x["wz"]]) - bw
        if s["t"] is not None and (dt := x["stamp"] - s["t"]) > 0:
            half = s["r"] @ turn_of(w * dt / 2)
            acc = half @ a + GRAVITY
            s["p"] = s["p"] + s["v"] * dt + 0.5 * acc * dt * dt
            s["v"] = s["v"] + acc * dt
            s["r"] = s["r"] @ turn_of(w * dt)
        s["t"] = x["stamp"]
        return (x["stamp"], *s["p"], *quaternion(s["r"]), *s["v"])

    return folded(imu, "stamp", start, step, "stamp double, x double, y double, z double, qx double, qy double, qz double, qw double, vx double, vy double, vz double")


def filtered(rows: DataFrame, noise: tuple[float, float] = (0.1, 0.01), measured: float = 0.05) -> DataFrame:
    """Error-state filter over motion since the last pose: rows are samples (kind imu: ax..wz) and poses (kind pose: x, y, z,
    qx..qw) by stamp. A sample predicts shift, speed and turn and their 9x9 covariance; a pose corrects them and starts a
    new stretch, whose speed is 0. Returned for each pose: innovation and the trace of the covariance before it."""

    def start() -> dict:
        return {"t": None, "pose": None} | fresh()

    def fresh() -> dict:
        return {"dp": np.zeros(3), "v": np.zeros(3), "r": np.eye(3), "P": np.eye(9) * 1e-4}

    def matrix(x: dict) -> np.ndarray:
        qx, qy, qz, qw = x["qx"], x["qy"], x["qz"], x["qw"]
        out = np.eye(4)
        out[:3, :3] = [[1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy - qz * qw), 2 * (qx * qz + qy * qw)], [2 * (qx * qy + qz * qw), 1 - 2 * (qx * qx + qz * qz), 2 * (qy * qz - qx * qw)], [2 * (qx * qz - qy * qw), 2 * (qy * qz + qx * qw), 1 - 2 * (qx * qx + qy * qy)]]
        out[:3, 3] = x["x"], x["y"], x["z"]
        return out

    def step(s: dict, x: dict) -> tuple | None:
        if x["kind"] == "imu":
            dt = 0.0 if s["t"] is None else x["stamp"] - s["t"]
            s["t"] = x["stamp"]
            if dt <= 0:
                return None
            a, w = np.array([x["ax"], x["ay"], x["az"]]), np.array([x["wx"], x["wy"], x["wz"]])
            acc = s["r"] @ a
            f = np.eye(9)
            f[:3, 3:6] = np.eye(3) * dt
            f[3:6, 6:] = -s["r"] @ np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]]) * dt
            f[6:, 6:] = turn_of(-w * dt)
            s["dp"], s["v"], s["r"] = s["dp"] + s["v"] * dt + 0.5 * acc * dt * dt, s["v"] + acc * dt, s["r"] @ turn_of(w * dt)
            s["P"] = f @ s["P"] @ f.T + np.diag([0] * 3 + [noise[0] * dt] * 3 + [noise[1] * dt] * 3)
            return None
        pose, last = matrix(x), s["pose"]
        s["pose"] = pose
        if last is None:
            return None
        rel = np.linalg.inv(last) @ pose
        err = np.concatenate([rel[:3, 3] - s["dp"], quaternion(s["r"].T @ rel[:3, :3])[:3] * 2])
        h = np.zeros((6, 9))
        h[:3, :3], h[3:, 6:] = np.eye(3), np.eye(3)
        gain = s["P"] @ h.T @ np.linalg.inv(h @ s["P"] @ h.T + np.eye(6) * measured**2)
        fix = gain @ err
        out = (x["stamp"], float(np.linalg.norm(err[:3])), float(np.linalg.norm(err[3:])), float(np.trace(s["P"])), *(s["dp"] + fix[:3]).tolist())
        p = (np.eye(9) - gain @ h) @ s["P"]
        s.update(fresh() | {"P": p})
        return out

    return folded(rows, "stamp", start, step, "stamp double, shift_error double, turn_error double, uncertainty double, dx double, dy double, dz double")


def gravity_direction(imu: DataFrame, window: float = 1.0) -> DataFrame:
    """Mean acceleration over each sequence's first seconds, its norm, and whether that is plausible (5 to 15)."""
    first = F.min("stamp").over(Window.partitionBy("seq_id"))
    mean = imu.withColumn("first", first).where(F.col("stamp") <= F.col("first") + window).groupBy("seq_id").agg(*[F.avg(c).alias(c) for c in ("ax", "ay", "az")])
    norm = F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2)
    return mean.withColumn("norm", norm).withColumn("plausible", F.col("norm").between(5.0, 15.0))


def deskewed(points: DataFrame, poses: DataFrame) -> DataFrame:
    """points (seq_id, us, x, y, z, ...) under the sensor's pose at their own time: poses (seq_id, us, x..z, qx..qw) around it
    are interpolated, the shift linearly, the turn by slerp. Points before the first or after the last pose take that one."""
    held = poses.select("seq_id", "us", F.struct("x", "y", "z", "qx", "qy", "qz", "qw").alias("pose"))
    near = bracketed(points, held, "pose")
    lo, hi = F.coalesce("lo_value", "hi_value"), F.coalesce("hi_value", "lo_value")
    span = F.col("hi_us") - F.col("lo_us")
    t = F.when(span > 0, (F.col("us") - F.col("lo_us")) / span).otherwise(0.0)
    shift = [lerp(lo[c], hi[c], t) for c in "xyz"]
    q = slerp([lo[c] for c in ("qx", "qy", "qz", "qw")], [hi[c] for c in ("qx", "qy", "qz", "qw")], t)
    out = near.withColumn("_q", F.array(*q)).withColumn("_s", F.array(*shift))
    x, y, z, w = (F.col("_q")[i] for i in range(4))
    rows = [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]
    pose = [*rows[0:3], F.col("_s")[0], *rows[3:6], F.col("_s")[1], *rows[6:9], F.col("_s")[2]]
    out = out.withColumn("_pose", F.array(*pose))
    return out.withColumns(dict(zip(("dx", "dy", "dz"), moved_by(F.col("_pose"), vec("x", "y", "z"))))).drop("_pose", "_q", "_s", "lo_us", "hi_us", "lo_value", "hi_value", "status")


def deskewed_by_twist(points: DataFrame, linear: tuple[float, float, float], angular: tuple[float, float, float]) -> DataFrame:
    """The same for a constant speed and turn rate; t is each point's time since the scan's start."""
    t = F.col("t")
    turn = expmap(tuple(F.lit(float(w)) * t for w in angular))
    p = vec("x", "y", "z")
    out = [turn[3 * i] * p[0] + turn[3 * i + 1] * p[1] + turn[3 * i + 2] * p[2] + F.lit(float(linear[i])) * t for i in range(3)]
    return points.withColumns(dict(zip(("dx", "dy", "dz"), out)))


def predictor_check(rows: DataFrame, every: int = 64, limits: tuple[float, float, float] = (0.7, 0.4, 0.5)) -> DataFrame:
    """rows (seq_id, id, speed, errors of two predictors: imu_rot, imu_trans, imu_vel, cv_...): of rows of a speed of 0.1 or
    more, so far, in which share the inertial predictor was better; every 64th row, and whether each share is enough."""
    moving = rows.where(F.abs("speed") >= 0.1)
    by = Window.partitionBy("seq_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    better = {f"better_{k}": F.avg((F.col(f"imu_{k}") < F.col(f"cv_{k}")).cast("double")).over(by) for k in ("rot", "trans", "vel")}
    out = moving.withColumns(better | {"k": F.row_number().over(Window.partitionBy("seq_id").orderBy("id"))}).where(F.col("k") % every == 0)
    enough = F.lit(True)
    for k, limit in zip(("rot", "trans", "vel"), limits):
        enough = enough & (F.col(f"better_{k}") > limit)
    return out.select("seq_id", "id", "k", *better, enough.alias("valid"))


def anchored(sensor: DataFrame, odometry: DataFrame) -> DataFrame:
    """For each pose of the sensor in the world, the odometry pose at its time (seq_id, us, pose as 4x4): null before the first."""
    return as_of(sensor, odometry.select("seq_id", "us", F.col("pose").alias("odom_pose")), "odom_pose")


def world_pose(pose: Column, extrinsic: Column) -> Column:
    from ..functions.geometry import composed

    return composed(pose, extrinsic)
