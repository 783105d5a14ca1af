"""Registration of clouds by distributions: many frames at once, each with a pose of its own.

A point and the voxel that it falls in are two normal distributions; their distance is measured by the inverse of the sum
of both covariances. A round moves the points, joins them to the target's voxels by cell and adds up, in each task first, the
27 numbers of a Gauss-Newton step and the cost of each frame. The steps are solved where the frames' sums are, so nothing
passes through the driver but the number of frames that go on."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import SIX, flattened, moved_by, turned3, vec
from .cloud import CELL, COV, XYZ, voxelise, with_cell
from .graph import stored, rotation

#: Entries of a step's sums: the upper triangle of H by rows, b, the cost and the number of points.
UPPER = [(a, b) for a in range(6) for b in range(a, 6)]
SUMS = [f"h{k}" for k in range(21)] + [f"g{k}" for k in range(6)] + ["cost", "n"]


def with_covariances(points: DataFrame, normals: DataFrame, thin: float = 1e-3) -> DataFrame:
    """points with cxx to czz: discs across their normals (frame_id, point_id, nx, ny, nz), as thick as `thin`."""
    disc = flattened(vec("nx", "ny", "nz"), thin)
    known = normals.withColumn("_c", disc).select("frame_id", "point_id", *[F.col("_c")[k].alias(c) for k, c in zip((0, 1, 2, 4, 5, 8), COV)])
    return points.join(known, ["frame_id", "point_id"])


def symmetric(six: np.ndarray) -> np.ndarray:
    """n x 6 entries to n x 3 x 3."""
    return six[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)


def step_sums(q: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of a moved point (place q, covariance a) and a voxel (m, b): its part of SUMS, for a small turn w and
    shift t that make q + w x q + t of q."""
    weight = np.linalg.inv(symmetric(a) + symmetric(b))
    d = q - m
    j = np.zeros((len(q), 3, 6))
    j[:, 0, 1], j[:, 0, 2], j[:, 1, 0] = q[:, 2], -q[:, 1], -q[:, 2]
    j[:, 1, 2], j[:, 2, 0], j[:, 2, 1] = q[:, 0], q[:, 1], -q[:, 0]
    j[:, [0, 1, 2], [3, 4, 5]] = 1
    wj = weight @ j
    h = np.einsum("nka,nkb->nab", j, wj)
    g = np.einsum("nka,nk->na", wj, d)
    cost = np.einsum("nk,nkl,nl->n", d, weight, d)
    return np.concatenate([np.stack([h[:, x, y] for x, y in UPPER], 1), g, cost[:, None], np.ones((len(q), 1))], 1)


def total_sums(q: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """H (6 x 6), g and the cost of all pairs together, as step_sums has them for each: inverses in closed form, one product of matrices."""
    xx, xy, xz, yy, yz, zz = (a + b).T
    inverse = np.stack([yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy], 1)
    volume = xx * inverse[:, 0] + xy * inverse[:, 1] + xz * inverse[:, 2]
    if not volume.all():
        raise np.linalg.LinAlgError("a covariance without an inverse")
    inverse /= volume[:, None]
    j = np.zeros((len(q), 3, 6))
    j[:, 0, 1], j[:, 0, 2], j[:, 1, 0] = q[:, 2], -q[:, 1], -q[:, 2]
    j[:, 1, 2], j[:, 2, 0], j[:, 2, 1] = q[:, 0], q[:, 1], -q[:, 0]
    j[:, [0, 1, 2], [3, 4, 5]] = 1
    wj = (symmetric(inverse) @ j).reshape(-1, 6)
    d = q - m
    wd = (wj.reshape(-1, 3, 6)[:, :, 3:] @ d[:, :, None]).ravel()  # the shift's part of J is the unit matrix
    return j.reshape(-1, 6).T @ wj, j.reshape(-1, 6).T @ wd, float(d.ravel() @ wd)


def moved_sums(source: DataFrame, voxels: DataFrame, poses: DataFrame, res: float) -> DataFrame:
    """frame_id and SUMS of the points that fall into a voxel, under their frame's pose."""
    at = source.join(poses.select("frame_id", "pose"), "frame_id")
    place = moved_by(F.col("pose"), vec(*XYZ))
    cov = turned3(F.col("pose"), vec(*COV))
    moved = at.select("frame_id", *[p.alias(c) for p, c in zip(place, XYZ)], *[v.alias(c) for v, c in zip(cov, COV)])
    met = with_cell(moved, res).join(voxels, ["frame_id", *CELL])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number = lambda names: np.stack([batch.column(c).to_numpy() for c in names], 1)
                pairs = [number(XYZ), number(COV), number(("mx", "my", "mz")), number([f"b{p}" for p in SIX])]
                order = np.argsort(batch.column("frame_id").to_numpy(), kind="stable")
                frames, starts = np.unique(batch.column("frame_id").to_numpy()[order], return_index=True)
                total = np.zeros((len(frames), len(SUMS)))
                for k, own in enumerate(np.split(order, starts[1:])):
                    h, g, cost = total_sums(*[v[own] for v in pairs])
                    total[k] = [*[h[x, y] for x, y in UPPER], *g, cost, len(own)]
                yield pa.record_batch([pa.array(frames), *map(pa.array, total.T)], ["frame_id", *SUMS])

    parts = met.select("frame_id", *XYZ, *COV, "mx", "my", "mz", *[f"b{p}" for p in SIX]).mapInArrow(work, "frame_id long, " + ", ".join(f"{s} double" for s in SUMS))
    return parts.groupBy("frame_id").agg(*[F.sum(s).alias(s) for s in SUMS])


def turned(step: np.ndarray, pose: np.ndarray) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = rotation(step[:3]), step[3:]
    return out @ pose


#: A frame's state: the pose to try; the last one that was kept with its sums; damping; whether it is settled.
STATE = "frame_id long, pose array<double>, best array<double>, sums array<double>, damping double, settled boolean"


def stepped(state: dict, sums: list[float] | None, shift: float, degrees: float) -> dict:
    """The state after a round (Gauss-Newton with damping): a pose is kept unless its mean cost is over a tenth higher, and
    the damping falls tenfold; else the last one is left by a shorter step. (Weights turn with the pose, so that costs near
    the end may rise by a trifle.) It is settled once a step is short, or damping no longer helps."""
    best, kept, damping = np.array(state["best"]).reshape(4, 4), state["sums"], state["damping"]
    if sums is not None and sums[-1] >= 6 and (kept is None or sums[-2] / sums[-1] <= 1.1 * kept[-2] / kept[-1] + 1e-9):
        best, kept, damping = np.array(state["pose"]).reshape(4, 4), sums, damping / 10
    else:
        damping *= 10
    if kept is None or damping > 1e6:
        return state | {"settled": True}
    h = np.zeros((6, 6))
    for v, (a, b) in zip(kept, UPPER):
        h[a, b] = h[b, a] = v
    step = -np.linalg.solve(h + damping * np.diag(np.diag(h)) + 1e-9 * np.eye(6), np.array(kept[21:27]))
    short = np.linalg.norm(step[3:]) < shift and np.degrees(np.linalg.norm(step[:3])) < degrees
    return state | {"pose": turned(step, best).ravel().tolist(), "best": best.ravel().tolist(), "sums": kept, "damping": damping, "settled": bool(short)}


def aligned(source: DataFrame, target: DataFrame, levels: Sequence[float] = (2.0, 1.0, 0.5), rounds: int = 20, poses: DataFrame | None = None, shift: float = 1e-3, degrees: float = 1e-3) -> DataFrame:
    """frame_id, pose (4x4), cost (the mean over the points that met a voxel), n (how many) for each frame of the source: the
    motion that lays its points on the target's of the same frame.

    Points have covariances (with_covariances). Levels are voxel sizes, coarse to fine: each starts where the one before
    ended, and ends for a frame once a step is under `shift` and `degrees`; frames that are settled take no further part. poses: where to
    start (frame_id, pose), else where the points are. Frames of which fewer than six points meet a voxel keep their
    start, with a null cost."""
    unit = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    frames = source.select("frame_id").distinct()
    start = frames.withColumn("pose", unit) if poses is None else frames.join(poses.select("frame_id", F.col("pose").alias("_p")), "frame_id", "left").select("frame_id", F.coalesce("_p", unit).alias("pose"))
    none = F.lit(None).cast("array<double>")
    state = start.select("frame_id", "pose", F.col("pose").alias("best"), none.alias("sums"), F.lit(1e-5).alias("damping"), F.lit(False).alias("settled"))
    state = stored(state)
    points = source.select("frame_id", *XYZ, *COV)
    names = [f.split()[0] for f in STATE.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sums = None if row["n"] is None else [row[s] for s in SUMS]
                out.append(stepped({k: row[k] for k in names}, sums, shift, degrees))
            kinds = [pa.int64(), *[pa.list_(pa.float64())] * 3, pa.float64(), pa.bool_()]
            yield pa.record_batch([pa.array([s[k] for s in out], t) for k, t in zip(names, kinds)], names)

    for res in levels:
        voxels = voxelise(target, res).select("frame_id", *CELL, "mx", "my", "mz", *[F.col(c).alias(f"b{p}") for c, p in zip(COV, SIX)])
        voxels = stored(voxels)
        state = state.withColumns({"pose": F.col("best"), "sums": none, "damping": F.lit(1e-5), "settled": F.lit(False)})
        done = None
        for _ in range(rounds):
            sums = moved_sums(points, voxels, state, res)
            state = stored(state.join(sums, "frame_id", "left").mapInArrow(work, STATE))
            ended = state.where("settled")
            done = ended if done is None else done.unionByName(ended)
            state = state.where("NOT settled")
            if state.isEmpty():
                break
        state = done.unionByName(state)
    return state.select("frame_id", F.col("best").alias("pose"), (F.col("sums")[27] / F.col("sums")[28]).alias("cost"), F.coalesce(F.col("sums")[28].cast("long"), F.lit(0)).alias("n"))
