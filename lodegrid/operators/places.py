"""Registration of clouds without a first guess: what surrounds a point is told by histograms of angles between normals, points
of alike surroundings are matched by hashed tables, and the motion is what most matches agree on.

All steps are joins and aggregates, for any number of frames at once; a frame's cloud may be a whole map."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cloud import CELL, XYZ
from .graph import stored
from .joins import dealt

#: Bins of each of the three angles, hashed tables and bits of a table's code.
BINS, TABLES, BITS = 11, 12, 8
#: Radii of a cell's side at most, points that a cell has or so, points whose nearest a task holds at most.
WIDE, MANY, HELD = 2, 1 << 10, 1 << 18
#: Asking points and pairs that are looked at together.
ASKING, TILE = 1 << 10, 1 << 20


def asked(asking: DataFrame, others: DataFrame, keys: Sequence[str], begin: Callable, meet: Callable, tell: Callable, schema: str) -> DataFrame:
    """Rows of what `tell` and `meet` give for each group of keys with asking rows and others (the same columns): `begin` makes a
    state of a group's asking rows, `meet` takes others into account as they come by, `tell` says what was found. A task holds
    a group's asking rows, whatever the number of others; nothing is kept of pairs."""
    columns = [*keys, "asks", *[c for c in asking.columns if c not in keys]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, state = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            by = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "asks")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in by], axis=0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                here = tuple(c[i] for c in by[:-1])
                if here != key:
                    if state is not None:
                        yield from tell(key, state)
                    key, held, state = here, [], None
                part = batch.slice(i, j - i)
                if by[-1][i]:
                    held.append(part)
                elif held:
                    state = begin(pa.Table.from_batches(held).combine_chunks()) if state is None else state
                    yield from meet(key, state, part) or ()
        if state is not None:
            yield from tell(key, state)

    both = asking.withColumn("asks", F.lit(True)).unionByName(others.withColumn("asks", F.lit(False)), allowMissingColumns=True).select(*columns)
    return both.repartition(*keys).sortWithinPartitions(*keys, F.desc("asks")).mapInArrow(work, schema)


def celled(points: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """points (x, y, z) in cells of about MANY of a frame, of WIDE radii at most and half a one at least; and the same points,
    once for each cell with points that their surroundings touch."""
    spread = [F.stddev_pop(c) for c in XYZ]
    wide = [F.greatest(v, F.greatest(*spread) / 100) * 4 for v in spread]
    frames = points.groupBy("frame_id").agg(F.cbrt(wide[0] * wide[1] * wide[2] * MANY / F.count(F.lit(1))).alias("fit"))
    halved = F.when(F.col("fit") > 0, F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(WIDE * radius / F.col("fit"))).cast("double")))).otherwise(0.0)
    placed = points.join(frames.select("frame_id", (WIDE * radius / F.pow(F.lit(2.0), halved)).alias("_side")), "frame_id")
    own = placed.withColumns({i: F.floor(F.col(c) * (1.0 / F.col("_side"))).cast("long") for i, c in zip(CELL, XYZ)}).drop("_side")
    near = dealt(placed, F.col("_side"), radius).drop("_side").join(own.select("frame_id", *CELL).distinct(), ["frame_id", *CELL], "left_semi")
    return own, near


def columns_of(rows: pa.Table | pa.RecordBatch, *names: str) -> np.ndarray:
    return np.stack([np.asarray(rows.column(c).to_numpy(zero_copy_only=False), float) for c in names])


def tiles(asking: int, others: int) -> Iterator[tuple[slice, slice]]:
    step = max(1, TILE // min(ASKING, asking))
    for i in range(0, asking, ASKING):
        for j in range(0, others, step):
            yield slice(i, i + ASKING), slice(j, j + step)


def distances2(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p[:, :, None] - q[:, None, :]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def binned(p: np.ndarray, q: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
    """The bins of the three angles between points p and q (six rows: place, normal), d apart: between the normals and the line
    that joins the two points, which don't change as the cloud moves."""
    line = [(q[k] - p[k]) / d for k in range(3)]
    u, n = p[3:], q[3:]
    v = [u[1] * line[2] - u[2] * line[1], u[2] * line[0] - u[0] * line[2], u[0] * line[1] - u[1] * line[0]]
    size = np.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    size[~(size > 1e-9)] = np.inf
    v = [c / size for c in v]
    w = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    one = [dot(v, n), dot(u, line), np.arctan2(dot(w, n), dot(u, n)) / np.pi]
    return [np.clip(np.nan_to_num((c + 1) / 2 * BINS), 0, BINS - 1).astype("i8") for c in one]


def histograms(points: DataFrame, normals: DataFrame, radius: float) -> DataFrame:
    """frame_id, point_id, n, h: how many neighbours a point has that are nearer than the radius, and how many of them are in
    each bin of each angle."""
    bins, names = 3 * BINS, (*XYZ, "nx", "ny", "nz")
    known = points.select("frame_id", "point_id", *[F.col(c).cast("double").alias(c) for c in XYZ]).join(normals.select("frame_id", "point_id", "nx", "ny", "nz"), ["frame_id", "point_id"])
    own, near = celled(known.dropna(subset=list(XYZ)), radius)

    def begin(rows: pa.Table) -> tuple:
        return rows.column("point_id"), columns_of(rows, *names), np.zeros((rows.num_rows, bins), "i8")

    def meet(key: tuple, state: tuple, rows: pa.RecordBatch) -> None:
        _, p, h = state
        q = columns_of(rows, *names)
        for a, b in tiles(p.shape[1], q.shape[1]):
            d2 = distances2(p[:3, a], q[:3, b])
            i, j = np.nonzero((d2 < radius * radius) & (d2 > 0))
            if len(i):
                n = d2.shape[0]
                for k, c in enumerate(binned(p[:, a][:, i], q[:, b][:, j], np.sqrt(d2[i, j]))):
                    h[a, k * BINS : (k + 1) * BINS] += np.bincount(i * BINS + c, minlength=n * BINS).reshape(n, BINS)

    def tell(key: tuple, state: tuple) -> Iterator[pa.RecordBatch]:
        ids, _, h = state
        some = np.flatnonzero(h.any(axis=1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * bins, pa.int32()), pa.array(h[some].ravel().astype("i4")))
        yield pa.record_batch([pa.array(np.full(len(some), key[0])), ids.combine_chunks().take(pa.array(some)), pa.array(h[some, :BINS].sum(1).astype("i4")), lists], ["frame_id", "point_id", "n", "h"])

    return asked(own, near, ["frame_id", *CELL], begin, meet, tell, "frame_id long, point_id long, n int, h array<int>")


def features(points: DataFrame, normals: DataFrame, radius: float) -> DataFrame:
    """frame_id, point_id, f: 33 numbers for each point with a neighbour, its own histogram and, by nearness, its neighbours'.
    Each of the three adds up to 2, or 1 if no neighbour has one.

    Pairs grow with the square of a frame's density. They are never written: all those of a point are found in one task,
    which adds them up, and they are found again, with the neighbours' histograms (counts), for the second sum, which is a
    product of matrices (nearness times shares)."""
    bins = 3 * BINS
    own = stored(histograms(points, normals, radius))
    placed = points.select("frame_id", "point_id", *[F.col(c).cast("double").alias(c) for c in XYZ]).join(own, ["frame_id", "point_id"])
    asking, near = celled(placed, radius)

    def shares(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        h = rows.column("h").combine_chunks() if isinstance(rows, pa.Table) else rows.column("h")
        return h.flatten().to_numpy().reshape(-1, bins) / rows.column("n").to_numpy()[:, None]

    def begin(rows: pa.Table) -> tuple:
        return rows.column("point_id"), columns_of(rows, *XYZ), shares(rows), np.zeros((rows.num_rows, bins)), np.zeros(rows.num_rows)

    def meet(key: tuple, state: tuple, rows: pa.RecordBatch) -> None:
        _, p, _, r, w = state
        q, theirs = columns_of(rows, *XYZ), shares(rows)
        for a, b in tiles(p.shape[1], q.shape[1]):
            d2 = distances2(p[:, a], q[:, b])
            near = np.zeros_like(d2)
            np.divide(1.0, np.sqrt(d2), out=near, where=(d2 < radius * radius) & (d2 > 0))
            r[a] += near @ theirs[b]
            w[a] += near.sum(1)

    def tell(key: tuple, state: tuple) -> Iterator[pa.RecordBatch]:
        ids, _, own, r, w = state
        f = own + np.where(w[:, None] > 0, r / np.where(w > 0, w, 1.0)[:, None], 0.0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * bins, pa.int32()), pa.array(f.ravel()))
        yield pa.record_batch([pa.array(np.full(len(f), key[0])), ids.combine_chunks(), lists], ["frame_id", "point_id", "f"])

    return asked(asking, near, ["frame_id", *CELL], begin, meet, tell, "frame_id long, point_id long, f array<double>")


def coded(feats: DataFrame, seed: int = 1) -> DataFrame:
    """frame_id, point_id, f, tab, code: the sides of BITS random planes through the features' middle, for each table."""
    planes = np.random.default_rng(seed).normal(size=(TABLES * BITS, 3 * BINS))
    offset = planes @ np.full(3 * BINS, 2 / BINS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                f = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                sides = ((f @ planes.T - offset) > 0).reshape(n, TABLES, BITS)
                codes = (sides << np.arange(BITS)).sum(2)
                again = pa.array(np.repeat(np.arange(n), TABLES))
                yield pa.record_batch([*[batch.column(c).take(again) for c in ("frame_id", "point_id", "f")], pa.array(np.tile(np.arange(TABLES), n), pa.int32()), pa.array(codes.ravel(), pa.int32())], ["frame_id", "point_id", "f", "tab", "code"])

    return feats.select("frame_id", "point_id", "f").mapInArrow(work, "frame_id long, point_id long, f array<double>, tab int, code int")


def least_of(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of frame, side, id, d2, other (columns): those of least d2 (ties: least other) of each frame, side and id."""
    frame, side, own, d2, other = rows
    order = np.lexsort((other, d2, own, side, frame))
    frame, side, own, d2, other = (c[order] for c in rows)
    new = np.ones(len(own), bool)
    new[1:] = (frame[1:] != frame[:-1]) | (side[1:] != side[:-1]) | (own[1:] != own[:-1])
    return [c[new] for c in (frame, side, own, d2, other)]


def close(fa: np.ndarray, fb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, d2: pairs of rows of fa and fb, the nearest of each row of either among them. A product of matrices tells which may
    be nearest, up to what its rounding could change, and those are measured."""
    rough = (fa * fa).sum(1)[:, None] + (fb * fb).sum(1) - 2 * (fa @ fb.T)
    slack = 1e-11 * (1 + np.abs(rough).max())
    i, j = np.nonzero((rough <= rough.min(1)[:, None] + slack) | (rough <= rough.min(0) + slack))
    step = max(1, TILE // fa.shape[1])
    d2 = [((fa[i[k : k + step]] - fb[j[k : k + step]]) ** 2).sum(1) for k in range(0, len(i), step)]
    return i, j, np.concatenate(d2)


def nearest_coded(source: DataFrame, target: DataFrame) -> DataFrame:
    """frame_id, side (0: id is of the source, 1: of the target), id, d2, other: of points that share a code in a table, the least d2
    of each point that a task met, so that pairs are neither kept nor shuffled. A task holds the source's points of a code, and
    HELD points' nearest or so."""

    def rows_of(rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c) for c in rows], ["frame_id", "side", "id", "d2", "other"])

    def of(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        f = rows.column("f").combine_chunks() if isinstance(rows, pa.Table) else rows.column("f")
        return rows.column("point_id").to_numpy(), f.flatten().to_numpy().reshape(rows.num_rows, -1)

    def begin(rows: pa.Table) -> list:
        return [*of(rows), []]

    def meet(key: tuple, state: list, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, fa, held = state
        b, fb = of(rows)
        for s, t in tiles(len(a), len(b)):
            i, j, d2 = close(fa[s], fb[t])
            mine, theirs = a[s][i], b[t][j]
            side = np.repeat(np.arange(2, dtype="int32"), len(i))
            held.append(least_of([np.full(2 * len(i), key[0]), side, np.concatenate([mine, theirs]), np.tile(d2, 2), np.concatenate([theirs, mine])]))
        if sum(len(r[0]) for r in held) > HELD:
            held[:] = [least_of([np.concatenate(c) for c in zip(*held)])]
            if len(held[0][0]) > HELD // 2:
                yield rows_of(held.pop())

    def tell(key: tuple, state: list) -> Iterator[pa.RecordBatch]:
        if state[2]:
            yield rows_of(least_of([np.concatenate(c) for c in zip(*state[2])]))

    return asked(coded(source), coded(target), ["frame_id", "tab", "code"], begin, meet, tell, "frame_id long, side int, id long, d2 double, other long")


def matches(source: DataFrame, target: DataFrame) -> DataFrame:
    """frame_id, a, b: points of source and target (features) that are each other's nearest, by features, among those that
    share a code in a table (ties by id)."""
    best = stored(nearest_coded(source, target).groupBy("frame_id", "side", "id").agg(F.min(F.struct("d2", "other")).alias("m")))
    best_a, best_b = (best.where(f"side = {k}").select("frame_id", *[F.col(c).alias(n) for c, n in zip(("id", "m.other"), names)]) for k, names in enumerate((("a", "b"), ("b", "a"))))
    return best_a.join(best_b, ["frame_id", "a", "b"])


SUMS = ["w"] + [f"w{s}{c}" for s in "pq" for c in XYZ] + [f"m{a}{b}" for a in XYZ for b in XYZ]


def agreed(pairs: DataFrame, inlier: float, rounds: int = 40) -> DataFrame:
    """frame_id, pose (4x4), share (weighted, of the matches that agree with it), n of pairs (frame_id, px, py, pz, qx, qy, qz):
    the motion from p to q. Far matches weigh less and less (Geman-McClure) as the cost is made less convex, 1.4 times a
    round, down to what `inlier` metres apart means. A frame needs three pairs."""
    pairs = stored(pairs.select("frame_id", *[f"{s}{c}" for s in "pq" for c in XYZ]))
    unit = F.array(*[F.lit(float(k % 5 == 0)) for k in range(16)])
    state = pairs.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("frame_id", "n", unit.alias("pose"), F.lit(None).cast("double").alias("mu"), F.lit(0.0).alias("share"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                w = r["w"] or 1e-12
                p, q = (np.array([r[f"w{s}{c}"] for c in XYZ]) / w for s in "pq")
                m = np.array([[r[f"m{a}{b}"] for b in XYZ] for a in XYZ]) / w - np.outer(q, p)
                u, _, vt = np.linalg.svd(m)
                pose = np.eye(4)
                pose[:3, :3] = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
                pose[:3, 3] = q - pose[:3, :3] @ p
                mu = max(1.0, r["worst"] * 2 / inlier**2) if r["mu"] is None else max(1.0, r["mu"] / 1.4)
                out.append((r["frame_id"], r["n"], pose.ravel().tolist(), mu, w / r["n"]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64())
            yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["frame_id", "n", "pose", "mu", "share"])

    state = stored(state)
    for _ in range(rounds):
        both = pairs.join(state, "frame_id")
        off = [F.col("pose")[4 * i] * F.col("px") + F.col("pose")[4 * i + 1] * F.col("py") + F.col("pose")[4 * i + 2] * F.col("pz") + F.col("pose")[4 * i + 3] - F.col(f"q{c}") for i, c in enumerate(XYZ)]
        r2 = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
        limit = F.col("mu") * inlier * inlier
        weighed = both.withColumn("r2", r2).withColumn("w", F.when(F.col("mu").isNull(), 1.0).otherwise(F.pow(limit / (F.col("r2") + limit), F.lit(2.0))))
        sums = [F.sum("w").alias("w")] + [F.sum(F.col("w") * F.col(f"{s}{c}")).alias(f"w{s}{c}") for s in "pq" for c in XYZ] + [F.sum(F.col("w") * F.col(f"q{a}") * F.col(f"p{b}")).alias(f"m{a}{b}") for a in XYZ for b in XYZ]
        done = weighed.groupBy("frame_id").agg(F.first("n").alias("n"), F.first("mu").alias("mu"), F.max("r2").alias("worst"), *sums)
        state = stored(done.mapInArrow(work, "frame_id long, n long, pose array<double>, mu double, share double"))
        if state.where("mu > 1").isEmpty():
            break
    return state.select("frame_id", "pose", "share", "n")


def found_motion(source: DataFrame, source_normals: DataFrame, target: DataFrame, target_normals: DataFrame, radius: float, inlier: float) -> DataFrame:
    """frame_id, pose, share, n: the motion that lays the source's cloud of each frame on the target's, wherever it is."""
    pairs = matches(features(source, source_normals, radius), features(target, target_normals, radius))
    both = pairs.join(source.select("frame_id", F.col("point_id").alias("a"), *[F.col(c).alias(f"p{c}") for c in XYZ]), ["frame_id", "a"])
    both = both.join(target.select("frame_id", F.col("point_id").alias("b"), *[F.col(c).alias(f"q{c}") for c in XYZ]), ["frame_id", "b"])
    return agreed(both, inlier)
