"""Filters, sampling and aggregation of point clouds (frame_id, point_id, x, y, z, ...)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import SIX, cell, finite, in_box, lits, moved, norm2, vec

XYZ = ("x", "y", "z")
CELL = ("ix", "iy", "iz")


def attributes(points: DataFrame, *more: str) -> DataFrame:
    """Keeps ids, coordinates and the named attributes: heavy columns go before any shuffle."""
    return points.select("frame_id", "point_id", *XYZ, *more)


def range_filter(points: DataFrame, near: float, far: float) -> DataFrame:
    """Finite points whose distance is over near and under far (both strict)."""
    d2 = norm2(vec(*XYZ))
    return points.where(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")) & (d2 > near * near) & (d2 < far * far))


def crop(points: DataFrame, low: Sequence[float], high: Sequence[float], pose: Sequence[float] | None = None, inside: bool = False) -> DataFrame:
    """Drops (or keeps) points in the closed box, seen from another sensor if a pose is given."""
    if any(a > b for a, b in zip(low, high)):
        raise ValueError("the box's lower corner must not be above its upper one")
    p = vec(*XYZ) if pose is None else moved(pose, vec(*XYZ))
    within = F.lit(True)
    for c, a, b in zip(p, low, high):
        within = within & c.between(float(a), float(b))
    return points.where(within if inside else ~within)


def in_time_order(points: DataFrame) -> DataFrame:
    """place of each point in its frame by time; ties by id."""
    return points.withColumn("place", F.row_number().over(Window.partitionBy("frame_id").orderBy("t", "point_id")))


def one_shutter(points: DataFrame) -> DataFrame:
    return points.withColumn("t", F.lit(0.0))


def small_frames(points: DataFrame, least: int = 100) -> DataFrame:
    return points.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_points")).where(F.col("n_points") < least)


def with_cell(points: DataFrame, res: float) -> DataFrame:
    return points.withColumns({i: cell(F.col(c), res) for i, c in zip(CELL, XYZ)})


#: Sums of coordinates are taken in whole millionths: the same in any order, so results don't depend on partitions or retries.
UNIT = 1e6


def units(c: Column) -> Column:
    return F.floor(c * UNIT + 0.5).cast("long")


#: Names of a covariance's columns; of a voxel's sums of them, in millionths; and of its sums of products of coordinates.
COV, COV_SUMS, PRODUCTS = (tuple(f"{k}{p}" for p in SIX) for k in "cvu")


def voxelise(points: DataFrame, res: float, keys: Sequence[str] = ("frame_id",), spread: bool = False) -> DataFrame:
    """One row per frame and cell: n, sums in millionths (ux, uy, uz), mean (mx, my, mz), max_intensity, unset flags and score.
    Points with a covariance (COV) add it up, too: vxx to vzz, in millionths, and cxx to czz, the mean.

    spread: also the sums of products of coordinates, counted from the cell's lower corner (uxx to uzz, in millionths).
    Counts and sums are partial aggregates that merge, so a finished cell can take more points by adding rows up."""
    has, own = "intensity" in points.columns, all(c in points.columns for c in COV)
    celled = with_cell(points, res)
    within = {c: F.col(c) - F.col(i) * res for c, i in zip(XYZ, CELL)}
    products = [F.sum(units(within[p[0]] * within[p[1]])).alias(f"u{p}") for p in SIX] if spread else []
    covs = [F.sum(units(F.col(c))).alias(v) for c, v in zip(COV, COV_SUMS)] if own else []
    out = celled.groupBy(*keys, *CELL).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(units(F.col(c))).alias(f"u{c}") for c in XYZ], *products, *covs, *([F.max("intensity").alias("max_intensity")] if has else [])
    )
    out = with_means(out)
    return out.withColumns({k: F.lit(False) for k in ("is_dynamic", "is_wall", "is_ground", "is_outlier")} | {"score": F.lit(0.0)})


def with_means(voxels: DataFrame) -> DataFrame:
    """Voxels with the means of what they have sums of: places, and covariances if there are any."""
    means = {f"m{c}": F.col(f"u{c}") / F.col("n") / UNIT for c in XYZ}
    means |= {c: F.col(v) / F.col("n") / UNIT for c, v in zip(COV, COV_SUMS) if v in voxels.columns}
    return voxels.withColumns(means)


def scatter(voxels: DataFrame, res: float) -> DataFrame:
    """Voxels (voxelise with spread) with cxx to czz, the covariance of the places of their own points."""
    within = {c: F.col(f"u{c}") / F.col("n") / UNIT - F.col(i) * res for c, i in zip(XYZ, CELL)}
    return voxels.withColumns({f"c{p}": F.col(f"u{p}") / F.col("n") / UNIT - within[p[0]] * within[p[1]] for p in SIX})


def merged_voxels(*parts: DataFrame) -> DataFrame:
    """Voxels of several maps as one: sums of counts and sums, of covariances and products as well where all have them."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    more = [c for c in (*PRODUCTS, *COV_SUMS) if c in both.columns]
    return with_means(both.groupBy("frame_id", *CELL).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("ux", "uy", "uz", *more)]))


def members(points: DataFrame, voxels: DataFrame, res: float) -> DataFrame:
    """The points of the voxels, each with its voxel's columns."""
    return with_cell(points, res).join(voxels, ["frame_id", *CELL])


def levels(points: DataFrame, base: float, factor: int, count: int) -> DataFrame:
    """Voxel maps of several resolutions at once: level 0 has cells of base, each further one of factor times the last."""
    each = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    size = F.lit(base) * F.pow(F.lit(float(factor)), F.col("level"))
    celled = each.withColumns({i: F.floor(F.col(c) / size).cast("long") for i, c in zip(CELL, XYZ)})
    return celled.groupBy("frame_id", "level", *CELL).agg(F.count(F.lit(1)).alias("n"))


def mixed_hash(c: Column, seed: int) -> Column:
    """A repeatable number from 0 to 2 ** 31 - 1 that other engines can compute, too."""
    a = F.pmod(c * 48271 + seed * 40692 + 11, F.lit(2147483647))
    return F.pmod(a * 16807 + 7, F.lit(2147483647))


def sampled(points: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Every point by itself, by its hash: a rerun takes the same ones."""
    return points.where(mixed_hash(F.col("point_id"), seed) < int(min(rate, 1.0) * 2147483647))


def per_cell_sample(points: DataFrame, res: float, rate: float, seed: int = 0) -> DataFrame:
    """Of each frame's cell, the share `rate` (rounded up) with the least hashes."""
    by = Window.partitionBy("frame_id", *CELL)
    rank = F.row_number().over(by.orderBy(mixed_hash(F.col("point_id"), seed), "point_id"))
    ranked = with_cell(points, res).withColumns({"rank": rank, "of": F.count(F.lit(1)).over(by)})
    return ranked.where(F.col("rank") <= F.ceil(F.col("of") * F.lit(rate))).drop("rank", "of")


def target_sample(points: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """At most `target` points of each frame, those of the least hashes."""
    rank = F.row_number().over(Window.partitionBy("frame_id").orderBy(mixed_hash(F.col("point_id"), seed), "point_id"))
    return points.withColumn("rank", rank).where(F.col("rank") <= target).drop("rank")


def bounded_queue(rows: DataFrame, key: str, order: str, cap: int, drop_oldest: bool = True) -> DataFrame:
    """The newest (or oldest) `cap` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order) if drop_oldest else F.asc(order)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")


def extents(points: DataFrame, key: str, least_points: int = 1, least: float = 0.0, most: float = math.inf, most_volume: float = math.inf) -> DataFrame:
    """Axis-aligned box of each group, of those with enough points, sides within limits and not too large a volume."""
    lows, highs = [F.min(c).alias(f"lo_{c}") for c in XYZ], [F.max(c).alias(f"hi_{c}") for c in XYZ]
    out = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *lows, *highs)
    out = out.withColumns({f"s{c}": F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in XYZ} | {f"c{c}": (F.col(f"hi_{c}") + F.col(f"lo_{c}")) / 2 for c in XYZ})
    sides = F.greatest("sx", "sy", "sz")
    return out.where((F.col("n") >= least_points) & (sides >= least) & (sides <= most) & (F.col("sx") * F.col("sy") * F.col("sz") <= most_volume)).select(key, "n", *[f"c{c}" for c in XYZ], *[f"s{c}" for c in XYZ])


def turned_extents(points: DataFrame, key: str, axes: Sequence[Sequence[float]]) -> DataFrame:
    """Box of each group along three given axes: centre along the axes and sizes."""
    p = vec(*XYZ)
    along = [p[0] * float(a[0]) + p[1] * float(a[1]) + p[2] * float(a[2]) for a in axes]
    out = points.groupBy(key).agg(*[f(a).alias(f"{n}{i}") for i, a in enumerate(along) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    return out.select(key, *[((F.col(f"lo{i}") + F.col(f"hi{i}")) / 2).alias(f"c{i}") for i in range(3)], *[(F.col(f"hi{i}") - F.col(f"lo{i}")).alias(f"s{i}") for i in range(3)])


def median_range(points: DataFrame, most: int = 256, seed: int = 0) -> DataFrame:
    """Upper median of the squared distances of at most 256 points of each frame."""
    d2 = target_sample(points, most, seed).select("frame_id", norm2(vec(*XYZ)).alias("d2"))
    return d2.groupBy("frame_id").agg(F.array_sort(F.collect_list("d2")).alias("all")).select("frame_id", F.element_at("all", (F.floor(F.size("all") / 2) + 1).cast("int")).alias("median_d2"))


def adaptive_resolution(distance: Column, base: float, most: float, near: float, far: float) -> Column:
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (distance - near) / (far - near)))
    return F.lit(base) + p * (most - base)


def overlap_ratio(source: DataFrame, target: DataFrame, res: float, pose: Sequence[float] | None = None, step: int = 1) -> DataFrame:
    """For each frame of source, how many points (moved by pose) are in a cell that frame + step of target has, and of how many."""
    p = vec(*XYZ) if pose is None else moved(pose, vec(*XYZ))
    there = with_cell(target, res).select((F.col("frame_id") - step).alias("frame_id"), *CELL).distinct().withColumn("hit", F.lit(1))
    here = source.select("frame_id", *[cell(c, res).alias(i) for c, i in zip(p, CELL)])
    met = here.join(there, ["frame_id", *CELL], "left")
    return met.groupBy("frame_id").agg(F.count("hit").alias("n_hit"), F.count(F.lit(1)).alias("n"))


def selected(points: DataFrame, centre: Sequence[float], size: Sequence[float], shape: str = "box") -> DataFrame:
    """Points strictly inside a box (half sides) or ellipsoid around a centre, the editor's tools."""
    q = [(c - k) / s for c, k, s in zip(vec(*XYZ), lits(centre), lits(size))]
    if shape == "box":
        return points.where((F.abs(q[0]) < 0.5) & (F.abs(q[1]) < 0.5) & (F.abs(q[2]) < 0.5))
    return points.where(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] < 1)


def within_radius(points: DataFrame, centre: Sequence[float], radius: float, res: float | None = None) -> DataFrame:
    """Points nearer than radius (strict); with a cell index, only the cells around the centre are looked at."""
    d = [c - k for c, k in zip(vec(*XYZ), lits(centre))]
    near = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < radius * radius
    if res is not None:
        reach = math.ceil(radius / res)
        for i, k in zip(CELL, centre):
            near = near & F.col(i).between(math.floor(k / res) - reach, math.floor(k / res) + reach)
    return points.where(near)


def deleted(points: DataFrame, gone: DataFrame) -> DataFrame:
    return points.join(gone.select("frame_id", "point_id"), ["frame_id", "point_id"], "left_anti")


def memory(points: DataFrame, bytes_per_point: int = 48) -> DataFrame:
    """Bytes and share (in millionths) of each frame, and of all under a null frame."""
    per = points.rollup("frame_id").agg((F.count(F.lit(1)) * bytes_per_point).alias("bytes"), F.grouping("frame_id").alias("is_total"))
    total = per.where("is_total = 1").select(F.col("bytes").alias("all_bytes"))
    return per.join(F.broadcast(total)).select("frame_id", "bytes", F.floor(F.col("bytes") * 1000000 / F.col("all_bytes")).cast("long").alias("share"))


def in_any_box(points: DataFrame, box: tuple) -> DataFrame:
    return points.where(in_box(vec(*XYZ), lits(box[:3]), lits(box[3:])))


def statistics(points: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, least and greatest of a column."""
    c = F.col(column)
    return points.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("greatest"))
