"""Clusters, boxes, scores of moving voxels and tracks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import in_box, overlap, vec
from .cloud import CELL
from .graph import checkpointed, components
from .joins import around, box_of, in_drawn, neighbours, radius_pairs


#: Points of a forest that a task holds at most.
HELD = 1 << 20


def forest(pairs: DataFrame, parted: bool = False) -> DataFrame:
    """frame_id, a, b: pairs that link the same points of a frame as those given, fewer: each task replaces its own by one a
    point, so that pairs aren't shuffled. Once it holds HELD points it begins anew.

    parted: with part, another number for each task and beginning, and with pairs of each least point and itself: a frame that
    has one part only is done, a is the least point that b reaches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, dict[int, int]] = {}

        def top(tree: dict[int, int], i: int) -> int:
            while (up := tree.setdefault(i, i)) != i:
                tree[i] = tree[up]
                i = up
            return i

        def made() -> Iterator[pa.RecordBatch]:
            part = uuid.uuid4().int >> 65
            for frame, tree in above.items():
                links = [(top(tree, i), i) for i in list(tree)]
                links = np.array([k for k in links if parted or k[0] != k[1]], dtype="int64").reshape(-1, 2)
                more = [pa.array(np.full(len(links), part))] if parted else []
                yield pa.record_batch([pa.array(np.full(len(links), frame)), pa.array(links[:, 0]), pa.array(links[:, 1]), *more], columns)
            above.clear()

        for batch in batches:
            frames, a, b = (batch.column(c).to_numpy() for c in ("frame_id", "a", "b"))
            for frame in np.unique(frames):
                own, tree = frames == frame, above.setdefault(int(frame), {})
                ids, at = np.unique(np.stack([a[own], b[own]]), return_inverse=True)
                tops = np.array([top(tree, i) for i in ids.tolist()])[at.reshape(2, -1)]
                for x, y in set(zip(*tops[:, tops[0] != tops[1]].tolist())):
                    x, y = top(tree, x), top(tree, y)
                    tree[max(x, y)] = min(x, y)
            if sum(map(len, above.values())) >= HELD:
                yield from made()
        yield from made()

    columns = ["frame_id", "a", "b", *(["part"] if parted else [])]
    return pairs.select(*[F.col(c).cast("long").alias(c) for c in ("frame_id", "a", "b")]).where("frame_id IS NOT NULL").mapInArrow(work, ", ".join(f"{c} long" for c in columns))


def framed_components(pairs: DataFrame) -> DataFrame:
    """frame_id, point_id, root: the least point that each point of the pairs (frame_id, a, b; whole numbers) reaches in its
    frame; other frames may use the same ids.

    What the tasks left is dealt out once by frame and reduced again, so that frames of fewer than HELD points that one task
    got are done; of these the rounds get the least points alone, and of the others, several tasks', all links."""
    left = checkpointed(forest(pairs))
    stars = checkpointed(forest(left.repartitionByRange("frame_id", "a").sortWithinPartitions("frame_id"), parted=True))
    frames = stars.groupBy("frame_id").agg((F.min("part") != F.max("part")).alias("several"))
    told = stars.join(frames, "frame_id")
    done = told.where("NOT several").select("frame_id", F.col("b").alias("point_id"), F.col("a").alias("root"))
    node = lambda c: F.struct("frame_id", F.col(c).alias("point_id"))
    root = components(told.where("several OR a = b").select(node("a").alias("a"), node("b").alias("b")))
    return done.unionByName(root.select("node.frame_id", "node.point_id", F.col("root.point_id").alias("root")))


def dbscan(points: DataFrame, eps: float, least: int, least_size: int = 1, wide: int = 1) -> DataFrame:
    """frame_id, point_id, cluster: the smallest core point of the cluster; noise isn't returned.

    Point ids count within their frame. A core has at least `least` others nearer than eps; cores that near each other are one cluster (components of a
    distributed graph); other points near a core belong to the cluster of the smallest id. wide: as radius_pairs."""
    both = radius_pairs(points, eps, wide=wide).select("frame_id", F.explode(F.array("a", "b")).alias("a"))
    core = both.groupBy("frame_id", "a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("frame_id", "a")
    core = checkpointed(core.withColumnRenamed("a", "point_id"))
    # Points are sorted into cores and others, not pairs: of those there are many more.
    inner, outer = (points.join(core, ["frame_id", "point_id"], how) for how in ("left_semi", "left_anti"))
    cores = core.join(framed_components(radius_pairs(inner, eps, wide=wide)), ["frame_id", "point_id"], "left").select("frame_id", "point_id", F.coalesce("root", "point_id").alias("cluster"))
    # Others are dealt to the cells around, as each is near fewer than `least` points: so few pairs, and few others in a dense cloud.
    border = radius_pairs(inner, eps, outer, wide=wide).join(cores.select("frame_id", F.col("point_id").alias("a"), "cluster"), ["frame_id", "a"])
    border = border.groupBy("frame_id", F.col("b").alias("point_id")).agg(F.min("cluster").alias("cluster"))
    out = cores.unionByName(border)
    big = out.groupBy("frame_id", "cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_size)
    return out.join(big.select("frame_id", "cluster"), ["frame_id", "cluster"], "left_semi").select("frame_id", "point_id", "cluster")


def largest_part(points: DataFrame, eps: float) -> DataFrame:
    """frame_id, root, n: the largest part of each frame whose points are linked by distances under eps (ties: smallest root)."""
    root = framed_components(radius_pairs(points, eps))
    sized = points.select("frame_id", "point_id").join(root, ["frame_id", "point_id"], "left").withColumn("root", F.coalesce("root", "point_id")).groupBy("frame_id", "root").agg(F.count(F.lit(1)).alias("n"))
    best = sized.groupBy("frame_id").agg(F.max(F.struct("n", (-F.col("root")).alias("r"))).alias("b"))
    return best.select("frame_id", (-F.col("b.r")).alias("root"), F.col("b.n").alias("n"))


def suppressed(boxes: DataFrame, most: float = 0.5) -> DataFrame:
    """Boxes of each frame by falling volume; one goes if a larger one that stays overlaps it by more than `most`. Boxes of
    two different known tracks (track_id, if there is one; -1: none) don't suppress each other.

    Which stay depends on which stayed: a fold over a frame's boxes, which are few (clusters of one scan)."""
    track = F.coalesce(F.col("track_id"), F.lit(-1)) if "track_id" in boxes.columns else F.lit(-1)
    item = F.struct((-(F.col("sx") * F.col("sy") * F.col("sz"))).alias("v"), "box_idx", "cx", "cy", "cz", "sx", "sy", "sz", track.cast("long").alias("track"))
    per = boxes.groupBy("frame_id").agg(F.array_sort(F.collect_list(item)).alias("all"))

    def part(b: Column) -> tuple:
        return tuple(b[f"c{c}"] for c in "xyz"), tuple(b[f"s{c}"] for c in "xyz")

    def step(kept: Column, b: Column) -> Column:
        apart = lambda k: (k["track"] >= 0) & (b["track"] >= 0) & (k["track"] != b["track"])
        return F.when(F.exists(kept, lambda k: ~apart(k) & (overlap(part(k), part(b)) > most)), kept).otherwise(F.concat(kept, F.array(b)))

    kept = F.aggregate("all", F.slice("all", 1, 0), step)
    return per.select("frame_id", F.explode(kept).alias("b")).select("frame_id", "b.box_idx", *[f"b.{k}{c}" for k in "cs" for c in "xyz"])


def overlapping(boxes: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs of boxes of a frame whose overlap is over `least` (0 or more).

    An equi-join: boxes are dealt to the cells that they touch, of the largest side, and a pair comes from the cell that
    holds the lower corner of what they share."""
    if least < 0:
        raise ValueError("boxes that don't meet aren't looked at")
    side = boxes.agg(F.max(F.greatest("sx", "sy", "sz"))).first()[0] or 1.0
    low = {c: F.floor((F.col(f"c{c}") - F.col(f"s{c}") / 2) / side).cast("long") for c in "xyz"}
    high = {c: F.floor((F.col(f"c{c}") + F.col(f"s{c}") / 2) / side).cast("long") for c in "xyz"}
    each = boxes.withColumns({f"l{c}": v for c, v in low.items()})
    for c in "xyz":
        each = each.withColumn(f"i{c}", F.explode(F.sequence(F.col(f"l{c}"), high[c])))
    a, b = each.alias("a"), each.alias("b")
    on = (F.col("a.frame_id") == F.col("b.frame_id")) & (F.col("a.box_idx") < F.col("b.box_idx"))
    for c in "xyz":
        on = on & (F.col(f"a.i{c}") == F.col(f"b.i{c}")) & (F.greatest(f"a.l{c}", f"b.l{c}") == F.col(f"a.i{c}"))
    both = lambda k: (vec(f"{k}.cx", f"{k}.cy", f"{k}.cz"), vec(f"{k}.sx", f"{k}.sy", f"{k}.sz"))
    out = a.join(b, on).select(F.col("a.frame_id").alias("frame_id"), F.col("a.box_idx").alias("i"), F.col("b.box_idx").alias("j"), overlap(both("a"), both("b")).alias("overlap"))
    return out.where(F.col("overlap") > least)


def box_counts(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """box_idx, n, n_dynamic of the voxels inside each box; a voxel counts for all boxes that it is in."""
    near = around(voxels.select("mx", "my", "mz", "is_dynamic"), ("mx", "my", "mz"), boxes)
    hit = F.filter("_boxes", lambda b: in_box(vec("mx", "my", "mz"), *box_of(b)))
    return near.select("is_dynamic", F.explode(F.transform(hit, lambda b: b["box_idx"])).alias("box_idx")).groupBy("box_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_dynamic").alias("n_dynamic"))


def in_dynamic_box(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """voxels with in_box: in any moving box or what it is inflated to, in a resting one, or none (null); moving wins."""
    p = vec("mx", "my", "mz")

    def hit(b: Column) -> Column:
        return in_box(p, *box_of(b)) | (b["is_dynamic"] & in_drawn(p, b))

    inside = F.filter("_boxes", hit)
    some = F.coalesce(F.size(inside), F.lit(0)) > 0
    return around(voxels, ("mx", "my", "mz"), boxes, inflated=True).withColumn("in_box", F.when(some, F.exists(inside, lambda b: b["is_dynamic"]))).drop("_boxes")


#: Effective parameters of the score: fixed values. A voxel in a moving box has to pass `tier1` of the threshold, one that
#: moved before `memory` of it, and any other `free`; all grow by motion_scale for each metre that the sensor moved.
SCORE = {"threshold": 0.40, "w_cluster": 0.2, "w_history": 0.1, "w_shift": 1.0, "w_mahalanobis": 0.0, "min_shift": 0.10, "motion_scale": 0.5, "tier1": 0.55, "memory": 0.70, "free": 3.0}


def scored(rows: DataFrame, res: float, least_points: float, depth: int, speed: float | Column = 0.0, p: dict = SCORE) -> DataFrame:
    """rows (n, in_box, shift2, n_static, prev_dynamic; shift2 null: no voxel before) with score and is_dynamic.

    Labelled and thin voxels are static with 0; without a voxel before, being in a moving box decides. With a weight for
    it, rows have mahalanobis, the shift measured by the covariance of the voxel before (covariance.distance).
    speed: metres that the sensor moved since the frame before."""
    box = F.coalesce("in_box", F.lit(False))
    base = F.when(box, p["w_cluster"]).otherwise(-p["w_cluster"] / 2)
    shift = p["w_shift"] * F.greatest(F.lit(0.0), F.sqrt("shift2") - p["min_shift"]) / res
    if p["w_mahalanobis"]:
        shift = shift + p["w_mahalanobis"] * F.coalesce("mahalanobis", F.lit(0.0))
    score = base + shift - p["w_history"] * F.col("n_static") / depth
    out = F.when(F.col("n") < least_points, 0.0).when(F.col("shift2").isNull(), F.when(box, p["threshold"] + 1).otherwise(0.0)).otherwise(score)
    tier = F.when(box, p["tier1"]).when(F.coalesce("prev_dynamic", F.lit(False)), p["memory"]).otherwise(p["free"])
    limit = p["threshold"] * (1 + p["motion_scale"] * speed) * tier
    alive = (F.col("n") >= least_points) & (F.col("shift2").isNotNull() | box)
    return rows.withColumn("score", out).withColumn("is_dynamic", alive & (F.col("score") > limit))


def spread_to_neighbours(voxels: DataFrame, weight: float = 0.1, threshold: float = 0.4, scale: float = 1.0) -> DataFrame:
    """is_dynamic also for voxels that moving neighbours lift over the threshold; walls and moving ones stay as they are.

    The order of the neighbours doesn't matter, as only their number does."""
    keys = ["frame_id", *CELL]
    around = neighbours(voxels.where("is_dynamic").select(*keys), self_too=False).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_moving"))
    out = voxels.join(around, keys, "left")
    lifted = ~F.col("is_wall") & (F.col("n_moving") >= 1) & (F.col("score") + weight * F.col("n_moving") > threshold * scale)
    return out.withColumn("is_dynamic", F.col("is_dynamic") | F.coalesce(lifted, F.lit(False))).drop("n_moving")


def spread_to_boxes(voxels: DataFrame, boxes: DataFrame, ratio: float = 0.3, scale: float = 1.0) -> DataFrame:
    """Boxes of which more than `ratio` (times scale) of the voxels move are moving, and every voxel that is no wall takes
    what its boxes say. Boxes that it is in decide alone: moving if any is. What moving boxes are drawn out to counts only
    outside all boxes; what is in neither is static. A settled box (column locked, if there is one) keeps its is_dynamic;
    a box without voxels is resting. Without boxes nothing changes."""
    settled = F.col("locked") & F.col("is_dynamic") if "locked" in boxes.columns else F.lit(False)
    free = ~F.col("locked") if "locked" in boxes.columns else F.lit(True)
    counts = box_counts(voxels, boxes).withColumn("share", F.col("n_dynamic") > ratio * scale * F.col("n"))
    known = boxes.join(counts.select("box_idx", "share"), "box_idx").withColumn("is_dynamic", (free & F.col("share")) | settled)
    p = vec("mx", "my", "mz")
    near = around(voxels, ("mx", "my", "mz"), known.drop("share"), inflated=True)
    inside = F.filter("_boxes", lambda b: in_box(p, *box_of(b)))
    drawn = F.exists("_boxes", lambda b: b["is_dynamic"] & in_drawn(p, b))
    said = F.when(F.size(inside) > 0, F.exists(inside, lambda b: b["is_dynamic"])).otherwise(drawn)
    some = F.lit(bool(boxes.take(1)))
    return near.withColumn("is_dynamic", F.when(F.col("is_wall") | ~some, F.col("is_dynamic")).otherwise(F.coalesce(said, F.lit(False)))).drop("_boxes")


def hysteresis(rows: DataFrame, permanent: int = 10) -> DataFrame:
    """rows (track_id, frame_id, is_dynamic) with run, how many frames in a row without a gap say the same, and locked: the
    first state that a track held for `permanent` frames in a row."""
    by = Window.partitionBy("track_id").orderBy("frame_id")
    new = (F.lag("is_dynamic").over(by) != F.col("is_dynamic")) | (F.col("frame_id") - F.lag("frame_id").over(by) > 1)
    island = F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("island", island).withColumn("run", F.row_number().over(Window.partitionBy("track_id", "island").orderBy("frame_id")))
    lock = F.when(F.col("run") >= permanent, F.when(F.col("is_dynamic"), "dynamic").otherwise("static"))
    first = F.first(lock, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("locked", first).drop("island")


def overlap_of(a: dict, b: dict) -> float:
    """Of two boxes: what they share over the smaller one's volume."""
    shared = 1.0
    for c in "xyz":
        (p, r), (q, t) = ((k[f"c{c}"], k[f"s{c}"] / 2) for k in (a, b))
        shared *= max(0.0, min(p + r, q + t) - max(p - r, q - t))
    small = min(a["sx"] * a["sy"] * a["sz"], b["sx"] * b["sy"] * b["sz"])
    return shared / small if small > 0 else 0.0


TRACK_SCHEMA = "seq_id long, frame_id long, box_idx long, track_id long, age long, vx double, vy double, vz double"


def track_step(tracks: list[dict], boxes: list[dict], next_id: int, gate: float, least: float, most_missed: int, dt: float) -> tuple[list[dict], list[tuple], int]:
    """One frame, dt seconds after the one before: pairs of tracks and boxes within the gate, by falling overlap, each used
    once; speeds, in metres a second, are smoothed (and stay where no time went by)."""

    flat = lambda b: (b["cx"], b["cy"], b["cz"], b["sx"], b["sy"], b["sz"])
    pairs, gate2 = [], gate * gate
    for j, b in enumerate(boxes):
        bx, by, bz, bsx, bsy, bsz = flat(b)
        for i, t in [(i, t) for i, t in enumerate(tracks) if -gate <= t["cx"] - bx <= gate]:
            tx, ty, tz, tsx, tsy, tsz = flat(t)
            if (tx - bx) ** 2 + (ty - by) ** 2 + (tz - bz) ** 2 > gate2:
                continue
            shared = 1.0
            for c, r, d, q in ((tx, tsx, bx, bsx), (ty, tsy, by, bsy), (tz, tsz, bz, bsz)):
                shared *= max(0.0, min(c + r / 2, d + q / 2) - max(c - r / 2, d - q / 2))
            small = min(tsx * tsy * tsz, bsx * bsy * bsz)
            if (s := shared / small if small > 0 else 0.0) >= least:
                pairs.append((-s, t["id"], b["box_idx"], i, j))
    used_t, used_b, out = set(), {}, []
    for *_, i, j in sorted(pairs):
        if i not in used_t and j not in used_b:
            used_t.add(i)
            used_b[j] = i
    for j, b in enumerate(boxes):
        if j in used_b:
            t = tracks[used_b[j]]
            if dt > 0:
                for c in "xyz":
                    t[f"v{c}"] = 0.6 * t[f"v{c}"] + 0.4 * (b[f"c{c}"] - t[f"c{c}"]) / dt
            t |= {k: b[k] for k in ("cx", "cy", "cz", "sx", "sy", "sz")} | {"age": t["age"] + 1, "missed": 0}
        else:
            t = {k: b[k] for k in ("cx", "cy", "cz", "sx", "sy", "sz")} | {"id": next_id, "age": 1, "missed": 0, "vx": 0.0, "vy": 0.0, "vz": 0.0}
            next_id += 1
            tracks.append(t)
        out.append((b["box_idx"], t["id"], t["age"], t["vx"], t["vy"], t["vz"]))
    seen = {o[1] for o in out}
    for t in tracks:
        if t["id"] not in seen:
            t["missed"] += 1
    return [t for t in tracks if t["missed"] <= most_missed], out, next_id


#: Seconds between frames where they have no stamps.
PERIOD = 0.1


def stamped(rows: DataFrame) -> DataFrame:
    """rows with stamp, in seconds: their own, else that of frames of one PERIOD."""
    return rows if "stamp" in rows.columns else rows.withColumn("stamp", F.col("frame_id") * PERIOD)


def tracked(boxes: DataFrame, gate: float = 1.5, least: float = 0.2, most_missed: int = 5) -> DataFrame:
    """seq_id, frame_id, box_idx with the track that each box belongs to and its velocity, in metres a second by the frames'
    stamps (column stamp, in seconds; else PERIOD). A frame depends on the one before: one group per sequence, read frame
    by frame from a stream of Arrow batches, so that only the live tracks are held."""
    columns = ["seq_id", "frame_id", "stamp", "box_idx", *[f"{k}{c}" for k in "cs" for c in "xyz"]]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        held: pd.DataFrame | None = None

        def frames(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            records = [dict(zip(columns, r)) for r in zip(*(rows[c].tolist() for c in columns))]
            for (seq, frame_id), part in groupby(records, key=itemgetter("seq_id", "frame_id")):
                part = list(part)
                if state.get("seq") != seq:
                    state.update(seq=seq, tracks=[], next=0, stamp=part[0]["stamp"])
                state["tracks"], found, state["next"] = track_step(state["tracks"], part, state["next"], gate, least, most_missed, part[0]["stamp"] - state["stamp"])
                state["stamp"] = part[0]["stamp"]
                out += [(seq, frame_id, *f) for f in found]
            return pd.DataFrame(out, columns=["seq_id", "frame_id", "box_idx", "track_id", "age", "vx", "vy", "vz"])

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            last = (held["seq_id"] == held["seq_id"].iloc[-1]) & (held["frame_id"] == held["frame_id"].iloc[-1])
            if not last.all():
                yield frames(held[~last])
                held = held[last]
        if held is not None and len(held):
            yield frames(held)

    return stamped(boxes).select(*columns).repartition("seq_id").sortWithinPartitions("seq_id", "frame_id", "box_idx").mapInPandas(work, TRACK_SCHEMA)
