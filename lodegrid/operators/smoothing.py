"""Trajectories at the rate of the inertial sensor: from each frame's state the samples are integrated up to the next frame,
and what that misses the next frame's pose by is spread over the way.

Intervals are independent of each other: they are dealt out by sequence and frame, so that one long recording is no single
task. Within one, the least squares have a block-tridiagonal matrix: one pass forward eliminates, one backward solves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .motion import GRAVITY, quaternion
from .posegraph import exp3, moved, numbers, residuals

#: Standard deviations of the ends' poses, and of a step: its share of the interval on top of STEP. Fixed values.
END, STEP = 1e-5, 1e-2
#: Rows of intervals that are solved together at most (a longer interval alone).
TOGETHER = 20_000
SAMPLE = ("ax", "ay", "az", "wx", "wy", "wz")


def predicted(pose: np.ndarray, velocity: np.ndarray, bias: np.ndarray, stamps: np.ndarray, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Poses and velocities at n + 1 stamps, from the first on, under the n samples (acceleration, turn rate) that hold between
    them: the acceleration is turned by the mean of the turns before and after the step. All may have one more dimension in
    front, of ways of the same length."""
    one = pose.ndim == 2
    if one:
        pose, velocity, bias, stamps, samples = pose[None], velocity[None], bias[None], stamps[None], samples[None]
    poses, speeds = [pose], [velocity]
    steps, felt = np.diff(stamps), samples - bias[:, None]
    by = felt[:, :, 3:] * steps[:, :, None]  # turns don't depend on the way before: all at once
    half, whole = (exp3(w.reshape(-1, 3)).reshape(*steps.shape, 3, 3) for w in (by / 2, by))
    for k in range(steps.shape[1]):
        last, dt, acc = poses[-1], steps[:, k, None], felt[:, k, :3]
        acc = (last[:, :3, :3] @ half[:, k] @ acc[:, :, None])[:, :, 0] + GRAVITY
        new = last.copy()
        new[:, :3, 3] += speeds[-1] * dt + acc * dt * dt / 2
        new[:, :3, :3] = last[:, :3, :3] @ whole[:, k]
        poses.append(new)
        speeds.append(speeds[-1] + acc * dt)
    out = np.stack(poses, 1), np.stack(speeds, 1)
    return (out[0][0], out[1][0]) if one else out


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of a x = b, for matrices or stacks of them; by least squares where one has no inverse."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0] if a.ndim == 2 else np.stack([solved(x, y) for x, y in zip(a, b)])


def tridiagonal(diagonal: np.ndarray, upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x of a symmetric block-tridiagonal system: n diagonal blocks, n - 1 above them, n right sides; or of a stack of such."""
    n = diagonal.shape[-3]
    d, r = diagonal.copy(), right[..., None].copy()
    for k in range(1, n):
        gain = np.swapaxes(solved(d[..., k - 1, :, :], upper[..., k - 1, :, :]), -1, -2)
        d[..., k, :, :] -= gain @ upper[..., k - 1, :, :]
        r[..., k, :, :] -= gain @ r[..., k - 1, :, :]
    x = np.zeros_like(r)
    x[..., -1, :, :] = solved(d[..., -1, :, :], r[..., -1, :, :])
    for k in range(n - 2, -1, -1):
        x[..., k, :, :] = solved(d[..., k, :, :], r[..., k, :, :] - upper[..., k, :, :] @ x[..., k + 1, :, :])
    return x[..., 0]


def bent(poses: np.ndarray, stamps: np.ndarray, begin: np.ndarray, end: np.ndarray, rounds: int = 5, tolerance: float = 1e-6) -> np.ndarray:
    """The poses that keep the steps between the given ones as they are as far as the ends allow; at most `rounds` steps of
    Gauss-Newton, fewer once the cost falls by less than `tolerance` (of itself). All may have one more dimension in front,
    of ways of the same length; each ends by its own cost."""
    if poses.ndim == 3:
        return bent(poses[None], stamps[None], begin[None], end[None], rounds, tolerance)[0]
    m, n = poses.shape[:2]
    if n < 2:
        return begin[:, None] if n else poses
    poses = poses.copy()
    relative = np.linalg.inv(poses[:, :-1]) @ poses[:, 1:]
    span = np.maximum(stamps[:, -1] - stamps[:, 0], 1e-12)
    weights = 1 / (np.diff(stamps) / span[:, None] + STEP) ** 2
    ends, costs, at = np.stack([begin, end], 1), np.full(m, np.nan), np.arange(6)
    going = np.arange(m)
    for _ in range(rounds):
        now, weight = poses[going], weights[going]
        g = len(going)
        e, ja, jb = (v.reshape(g, n - 1, *v.shape[1:]) for v in residuals(*[v.reshape(-1, 4, 4) for v in (now[:, :-1], now[:, 1:], relative[going])]))
        p, _, jp = (v.reshape(g, 2, *v.shape[1:]) for v in residuals(ends[going].reshape(-1, 4, 4), now[:, [0, -1]].reshape(-1, 4, 4), np.repeat(np.eye(4)[None], 2 * g, 0)))
        cost = (weight[:, :, None] * e * e).sum((1, 2)) + (p * p).sum((1, 2)) / END**2
        on = ~(costs[going] - cost <= tolerance * costs[going])
        costs[going] = cost
        if not on.any():
            break
        going, now, weight, e, ja, jb, p, jp = (v[on] for v in (going, now, weight, e, ja, jb, p, jp))
        diagonal, right = np.zeros((len(going), n, 6, 6)), np.zeros((len(going), n, 6))
        turned = jp.transpose(0, 1, 3, 2)
        for k, place in ((0, 0), (1, n - 1)):
            diagonal[:, place] += turned[:, k] @ jp[:, k] / END**2
            right[:, place] -= (turned[:, k] @ p[:, k, :, None])[:, :, 0] / END**2
        wa, wb = ((j * weight[:, :, None, None]).transpose(0, 1, 3, 2) for j in (ja, jb))
        diagonal[:, :-1] += wa @ ja
        diagonal[:, 1:] += wb @ jb
        right[:, :-1] -= (wa @ e[..., None])[..., 0]
        right[:, 1:] -= (wb @ e[..., None])[..., 0]
        diagonal[:, :, at, at] *= 1 + 1e-9  # a trace of damping, for ways so long that the numbers run out of digits
        poses[going] = moved(now.reshape(-1, 4, 4), tridiagonal(diagonal, wa @ jb, right).reshape(-1, 6)).reshape(now.shape)
    return poses


OUT = "seq_id long, frame_id long, stamp double, x double, y double, z double, qx double, qy double, qz double, qw double"


def slices(frames: DataFrame, imu: DataFrame) -> DataFrame:
    """Samples (seq_id, stamp, ax to wz) with the frame that each follows, and each frame's last sample before it, which
    holds until its first own one: frame_id, stamp, ax to wz; that sample has the frame's stamp. Samples before the first
    frame but the last of them are left out."""
    marks = frames.select("seq_id", "stamp", "frame_id", F.lit(0).alias("kind"), *[F.lit(None).cast("double").alias(c) for c in SAMPLE])
    rows = imu.select("seq_id", "stamp", F.lit(None).cast("long").alias("frame_id"), F.lit(1).alias("kind"), *[F.col(c).cast("double").alias(c) for c in SAMPLE])
    by = Window.partitionBy("seq_id").orderBy("stamp", "kind").rowsBetween(Window.unboundedPreceding, 0)
    value = F.last(F.when(F.col("kind") == 1, F.struct(*SAMPLE)), ignorenulls=True).over(by)
    held = marks.unionByName(rows).withColumns({"of": F.last("frame_id", ignorenulls=True).over(by), "_v": value})
    return held.where("of IS NOT NULL AND _v IS NOT NULL").select("seq_id", F.col("of").alias("frame_id"), "stamp", "kind", *[F.col(f"_v.{c}").alias(c) for c in SAMPLE])


def trajectories(frames: DataFrame, imu: DataFrame, rounds: int = 5) -> DataFrame:
    """seq_id, frame_id, stamp, x to z, qx to qw: the way from each frame to the next at its own stamp, each sample's and the
    next frame's. The last frame of a sequence, and frames without a sample, have none.

    frames: seq_id, frame_id, stamp (seconds, rising), pose (4x4), vx, vy, vz and, if there are any, the sensor's biases
    bias (array of six)."""
    by = Window.partitionBy("seq_id").orderBy("stamp")
    bias = F.col("bias") if "bias" in frames.columns else F.array(*[F.lit(0.0)] * 6)
    ends = frames.select("seq_id", "frame_id", F.col("stamp").alias("begin"), "pose", F.array("vx", "vy", "vz").alias("v"), bias.alias("bias"), F.lead("stamp").over(by).alias("until"), F.lead("pose").over(by).alias("next")).where("next IS NOT NULL")
    head = ends.select("seq_id", "frame_id", F.col("begin").alias("stamp"), F.lit(-1).alias("kind"), "pose", "v", "bias", "until", "next", *[F.lit(None).cast("double").alias(c) for c in SAMPLE])
    rows = head.unionByName(slices(frames, imu), allowMissingColumns=True)

    def ways(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Those of whole intervals; intervals of as many samples are solved together."""
        seq, frame, kind, stamp, until = (rows.column(c).to_numpy() for c in ("seq_id", "frame_id", "kind", "stamp", "until"))
        starts = np.flatnonzero(np.r_[True, (seq[1:] != seq[:-1]) | (frame[1:] != frame[:-1])])
        sizes = np.diff(np.r_[starts, len(seq)])
        known = (kind[starts] == -1) & (sizes > 1)
        starts, sizes = starts[known], sizes[known]
        heads = rows.take(pa.array(starts)).combine_chunks()
        state = {c: numbers(heads.column(c).combine_chunks(), *shape) for c, shape in (("pose", (4, 4)), ("next", (4, 4)), ("v", (3,)), ("bias", (6,)))} if len(starts) else {}
        sensed = np.stack([rows.column(c).to_numpy() for c in SAMPLE], 1)
        held = kind[starts + 1] == 0 if len(starts) else known[:0]  # the sample before the frame holds from there; without one, its first
        for size, mark in sorted(set(zip(sizes.tolist(), held.tolist()))):
            which = np.flatnonzero((sizes == size) & (held == mark))
            for which in np.array_split(which, -(-len(which) * size // TOGETHER)):
                own = starts[which, None] + np.arange(1, size)
                felt = sensed[own] if mark else np.concatenate([sensed[own[:, :1]], sensed[own]], 1)
                begin = starts[which]
                stamps = np.concatenate([stamp[begin, None], stamp[own[:, 1:] if mark else own], until[begin, None]], 1)
                way, _ = predicted(state["pose"][which], state["v"][which], state["bias"][which], stamps, felt)
                way = bent(way, stamps, state["pose"][which], state["next"][which], rounds)
                n = way.shape[1]
                way = way.reshape(-1, 4, 4)
                columns = [*(np.repeat(k[begin], n) for k in (seq, frame)), stamps.ravel(), *way[:, :3, 3].T, *quaternion(way[:, :3, :3]).T]
                yield pa.record_batch([pa.array(c) for c in columns], [f.split()[0] for f in OUT.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            seq, frame = (batch.column(c).to_numpy() for c in ("seq_id", "frame_id"))
            last = held[-1].slice(held[-1].num_rows - 1) if held else batch.slice(0, 1)
            new = (seq != np.r_[last.column("seq_id").to_numpy(), seq[:-1]]) | (frame != np.r_[last.column("frame_id").to_numpy(), frame[:-1]])
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if new.any():
                yield from ways(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from ways(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition("seq_id", "frame_id").sortWithinPartitions("seq_id", "frame_id", "kind", "stamp").mapInArrow(work, OUT)


def refreshed(frames: DataFrame, estimates: DataFrame) -> DataFrame:
    """frames (seq_id, frame_id, pose, ...) with the poses that a solution has (seq_id, frame_id, pose), and is_refreshed. A
    frame that the solution lacks keeps its own pose; estimates of frames that aren't there are left out."""
    new = estimates.select("seq_id", "frame_id", F.col("pose").alias("_new"))
    out = frames.join(new, ["seq_id", "frame_id"], "left")
    return out.withColumns({"pose": F.coalesce("_new", "pose"), "is_refreshed": F.col("_new").isNotNull()}).drop("_new")
