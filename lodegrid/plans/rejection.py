"""Scans to static and moving points: the operators in the order in which a scan goes through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cloud, feedback, ground, joins, moving
from ..operators.graph import checkpointed, stored

#: Frames of a sequence, from 0 on: sequence and frame are one number, so that all operators by frame keep sequences apart.
FRAMES = 32


def rejected(points: DataFrame, res: float = 2.0, ground_height: float = 0.5, eps: float = 3.0, least: int = 2, depth: int = 5, least_points: float = 2, frames: DataFrame | None = None, **boxes: float) -> DataFrame:
    """points (frame_id from 0 to 2 ** 32 - 1, point_id, x, y, z, in world coordinates; seq_id, else all are of one
    sequence) with is_dynamic. Points without a sequence, frame or place aren't returned.

    Voxels under the lowest one plus ground_height are ground; the others are clustered, and clusters give boxes. Boxes are
    labelled by the tracks of the frames before, suppressed, merged and tracked; a voxel's score compares it with the one
    that it was in the frame before, and its verdict uses what that frame said of it and of its box (operators/feedback.py).
    The first frame of a sequence is returned as static. boxes: what differs from feedback.BOXES.

    frames (seq_id, frame_id, stamp, tx, ty, tz): when each frame was taken, in seconds, and from where; speeds are by the
    stamps, and thresholds grow with the way to the place of the frame before (a missing frame before: no way). Frames that
    aren't listed are moving.PERIOD apart, at rest."""
    whole = points if "seq_id" in points.columns else points.withColumn("seq_id", F.lit(0).cast("long"))
    keyed = whole.withColumn("frame_id", F.shiftleft(F.col("seq_id").cast("long"), FRAMES) + F.col("frame_id"))
    keyed = stored(keyed)  # points are read twice; as a table they take less than what made them
    vox = ground.lowest_ground(cloud.voxelise(keyed, res).drop("is_ground"), ground_height)
    vox = stored(vox.withColumn("voxel_id", F.xxhash64("frame_id", *cloud.CELL)))  # read five times below
    means = vox.where("NOT is_ground").select("frame_id", F.col("voxel_id").alias("point_id"), F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"))
    labels = checkpointed(moving.dbscan(means, eps, least, wide=4))
    members = means.join(labels, ["frame_id", "point_id"])
    found = cloud.extents(members, "cluster").join(labels.select("frame_id", "cluster").distinct(), "cluster")

    match = joins.moved_cell_match(vox, vox, res)
    prev = [f"prev_{c}" for c in cloud.CELL]
    before = vox.select((F.col("frame_id") + 1).alias("frame_id"), *[F.col(c).alias(p) for c, p in zip(cloud.CELL, prev)], *[F.col(m).alias(k) for m, k in zip(("mx", "my", "mz"), "uvw")])
    rows = vox.join(match, ["frame_id", *cloud.CELL]).join(before, ["frame_id", *prev], "left")
    fixed = F.col("is_ground") | F.col("is_wall") | F.col("is_outlier") | (F.col("n") < least_points)
    rows = rows.select("frame_id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("box_idx"), *cloud.CELL, *[F.col(f"m{c}").alias(c) for c in "xyz"], *"uvw", *[F.coalesce(F.col(p), F.lit(0)).alias(f"p{p[-1]}") for p in prev], fixed.alias("fixed"), "is_wall")
    none = lambda names, value: [F.lit(value).alias(c) for c in names]
    each = found.select("frame_id", F.lit(0).alias("kind"), F.col("cluster").alias("box_idx"), *[c.cast("long") for c in none(cloud.CELL, 0)], *[F.col(f"c{c}").alias(c) for c in "xyz"], *[F.col(f"s{c}").alias(k) for c, k in zip("xyz", "uvw")], *none(("px", "py", "pz"), 0), *none(("fixed", "is_wall"), False))
    low = F.col("frame_id").bitwiseAND(F.lit((1 << FRAMES) - 1).cast("long"))
    both = rows.unionByName(each).withColumn("seq_id", F.shiftright("frame_id", FRAMES))
    if frames is None:
        both = both.withColumns({"stamp": low * moving.PERIOD, "travel": F.lit(0.0)})
    else:
        by = Window.partitionBy("seq_id").orderBy("frame_id")
        way = sum(((F.col(c) - F.lag(c).over(by)) * (F.col(c) - F.lag(c).over(by)) for c in ("ty", "tz")), (F.col("tx") - F.lag("tx").over(by)) * (F.col("tx") - F.lag("tx").over(by)))
        known = frames.withColumn("travel", F.when(F.lag("frame_id").over(by) == F.col("frame_id") - 1, F.sqrt(way)))
        known = known.select((F.shiftleft(F.col("seq_id").cast("long"), FRAMES) + F.col("frame_id")).alias("frame_id"), "stamp", "travel")
        both = both.join(known, "frame_id", "left").withColumns({"stamp": F.coalesce("stamp", low * moving.PERIOD), "travel": F.coalesce("travel", F.lit(0.0))})
    state = feedback.judged(both, res, depth, boxes=boxes)
    final = state.select("frame_id", *cloud.CELL, "is_dynamic")
    out = cloud.with_cell(keyed, res).join(final, ["frame_id", *cloud.CELL]).drop(*cloud.CELL)
    out = out.withColumn("frame_id", F.col("frame_id").bitwiseAND(F.lit((1 << FRAMES) - 1).cast("long")))
    return out if "seq_id" in points.columns else out.drop("seq_id")
