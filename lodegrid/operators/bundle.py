"""Plane bundle adjustment: poses that make planes, seen from several of them, as thin as they can be.

The cost of a plane is the least eigenvalue of the scatter of all its points in the world. Points are read once, for the
moments of each (pose, plane); whatever the number of points, a round works on these few rows. At a given plane (its
normal and middle) the cost of a pose is a square, and its gradient is that of the eigenvalue; so rounds that set the
planes by the poses and step the poses by the planes end where no pose can make a plane thinner."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import SIX
from .cloud import XYZ
from .graph import stored
from .posegraph import lists, numbers
from .registration import UPPER, symmetric, turned

MOMENTS = ["n", *[f"s{c}" for c in XYZ], *[f"m{k}" for k in SIX]]


def moments(points: DataFrame) -> DataFrame:
    """pose_id, plane_id and the sums (count, places, products) of the points that a pose sees of a plane, in its own frame."""
    sums = [F.sum(c).alias(f"s{c}") for c in XYZ] + [F.sum(F.col(k[0]) * F.col(k[1])).alias(f"m{k}") for k in SIX]
    return points.groupBy("pose_id", "plane_id").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)


def columns_of(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in names], 1)


def placed(n: np.ndarray, s: np.ndarray, m: np.ndarray, pose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second moments in the world: of k groups of n points, sums s and m (3x3), under k poses."""
    r, t = pose[:, :3, :3], pose[:, :3, 3]
    rs = (r @ s[:, :, None])[:, :, 0]
    cross = rs[:, :, None] * t[:, None, :]
    return rs + n[:, None] * t, r @ m @ r.transpose(0, 2, 1) + cross + cross.transpose(0, 2, 1) + n[:, None, None] * t[:, :, None] * t[:, None, :]


def in_world(rows: DataFrame) -> DataFrame:
    """rows (moments and pose) with the moments in the world."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = columns_of(batch, MOMENTS)
                s, m = placed(v[:, 0], v[:, 1:4], symmetric(v[:, 4:]), numbers(batch.column("pose"), 4, 4))
                yield pa.record_batch([batch.column("pose_id"), batch.column("plane_id"), pa.array(v[:, 0]), *map(pa.array, s.T), *map(pa.array, m[:, [0, 0, 0, 1, 1, 2], [0, 1, 2, 1, 2, 2]].T)], ["pose_id", "plane_id", *MOMENTS])

    return rows.select("pose_id", "plane_id", "pose", *MOMENTS).mapInArrow(work, "pose_id long, plane_id long, " + ", ".join(f"{c} double" for c in MOMENTS))


def planes_of(world: DataFrame) -> DataFrame:
    """plane_id, normal, middle, thin (its cost: points times the least eigenvalue), points of each plane."""
    sums = world.groupBy("plane_id").agg(*[F.sum(c).alias(c) for c in MOMENTS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = columns_of(batch, MOMENTS)
                middle = v[:, 1:4] / v[:, :1]
                values, vectors = np.linalg.eigh(symmetric(v[:, 4:]) / v[:, 0, None, None] - middle[:, :, None] * middle[:, None, :])
                yield pa.record_batch([batch.column("plane_id"), lists(vectors[:, :, 0]), lists(middle), pa.array(np.maximum(values[:, 0], 0) * v[:, 0]), pa.array(v[:, 0])], ["plane_id", "normal", "middle", "thin", "points"])

    return sums.mapInArrow(work, "plane_id long, normal array<double>, middle array<double>, thin double, points double")


STEP = [f"h{k}" for k in range(21)] + [f"g{k}" for k in range(6)]


def adjusted(poses: DataFrame, points: DataFrame, rounds: int = 30, shift: float = 1e-5, damping: float = 1e-6) -> tuple[DataFrame, float]:
    """poses (pose_id, pose: 4x4, fixed) after the adjustment, and the mean squared distance of all points to their planes.

    points: pose_id, plane_id, x, y, z, seen from the pose; those of unknown poses are left out. Poses that see no plane, or
    are fixed, stay. Rounds end once no pose moves by more than `shift` (metres, radians)."""
    given = stored(moments(points))
    state = stored(poses.select("pose_id", "pose", "fixed"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = columns_of(batch, MOMENTS)
                n, s, m = v[:, 0], v[:, 1:4], symmetric(v[:, 4:])
                normal, middle = numbers(batch.column("normal"), 3), numbers(batch.column("middle"), 3)
                # A small turn w and shift t of the world move a point q by w x q + t, along the normal by [q x normal, normal].
                k = np.zeros((len(n), 3, 3))
                k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = normal[:, 2], -normal[:, 1], normal[:, 0]
                k -= k.transpose(0, 2, 1)
                j = np.concatenate([k, np.zeros((len(n), 3, 3))], 1)  # of q, and its constant part
                c = np.concatenate([np.zeros_like(normal), normal], 1)
                js = (j @ s[:, :, None])[:, :, 0]
                h = j @ m @ j.transpose(0, 2, 1) + js[:, :, None] * c[:, None, :] + c[:, :, None] * js[:, None, :] + n[:, None, None] * c[:, :, None] * c[:, None, :]
                off = (normal * middle).sum(1)
                g = (j @ (m @ normal[:, :, None]))[:, :, 0] + c * (s * normal).sum(1)[:, None] - off[:, None] * (js + n[:, None] * c)
                yield pa.record_batch([batch.column("pose_id"), *map(pa.array, np.stack([h[:, a, b] for a, b in UPPER], 1).T), *map(pa.array, g.T)], ["pose_id", *STEP])

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                pose, far = np.array(r["pose"]).reshape(4, 4), 0.0
                if not r["fixed"] and r["h0"] is not None:
                    h = np.zeros((6, 6))
                    for k, (a, b) in enumerate(UPPER):
                        h[a, b] = h[b, a] = r[f"h{k}"]
                    step = -np.linalg.solve(h + damping * max(np.trace(h), 1e-12) * np.eye(6), np.array([r[f"g{k}"] for k in range(6)]))
                    pose, far = turned(step, pose), float(np.abs(step).max())
                out.append((r["pose_id"], pose.ravel().tolist(), r["fixed"], far))
            yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.list_(pa.float64()), pa.bool_(), pa.float64()))], ["pose_id", "pose", "fixed", "far"])

    for _ in range(rounds):
        world = in_world(given.join(state, "pose_id"))
        planes = planes_of(world)
        met = world.join(planes.select("plane_id", "normal", "middle"), "plane_id")
        parts = met.mapInArrow(sums, "pose_id long, " + ", ".join(f"{c} double" for c in STEP)).groupBy("pose_id").agg(*[F.sum(c).alias(c) for c in STEP])
        new = state.select("pose_id", "pose", "fixed").join(parts, "pose_id", "left").mapInArrow(stepped, "pose_id long, pose array<double>, fixed boolean, far double")
        state = stored(new)
        if (state.agg(F.max("far")).first()[0] or 0.0) < shift:
            break
    left = planes_of(in_world(given.join(state, "pose_id"))).agg((F.sum("thin") / F.sum("points")).alias("v")).first()["v"]
    return state.select("pose_id", "pose", "fixed"), left or 0.0
