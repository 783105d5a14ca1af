"""Keyframes and local maps: which frames are kept, which go, and how a map stays thin."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import composed
from .cloud import CELL, XYZ, with_cell
from .motion import folded


def frame_cells(points: DataFrame, res: float) -> DataFrame:
    """seq_id, frame_id, cells: the distinct cells of each frame as sorted text, and the frame's mean place."""
    celled = with_cell(points, res).withColumn("cell", F.concat_ws(",", *CELL))
    return celled.groupBy("seq_id", "frame_id").agg(F.array_sort(F.collect_set("cell")).alias("cells"), *[F.avg(c).alias(f"o{c}") for c in XYZ])


def overlap_of(a: set, b: set) -> float:
    """Share of a's cells that b has."""
    return len(a & b) / len(a) if a else 0.0


def by_overlap(frames: DataFrame, below: float = 0.8, least: float = 0.1, most: int = 15) -> DataFrame:
    """frames of frame_cells with is_keyframe and evicted. A frame is a keyframe if it overlaps the kept ones together by less
    than `below`. Kept frames that the new one hardly overlaps (under `least`) go; if there are still too many, the one of
    the least overlap with the newest times (1 - overlap with the others) goes."""

    def step(s: dict, row: dict) -> tuple:
        cells, kept = set(row["cells"]), s["kept"]
        union = set().union(*[c for _, c in kept]) if kept else set()
        if kept and overlap_of(cells, union) >= below:
            return row["frame_id"], False, []
        gone = [f for f, c in kept if overlap_of(cells, c) < least]
        kept = [k for k in kept if k[0] not in gone] + [(row["frame_id"], cells)]
        if len(kept) > most:
            others = lambda i: set().union(*[c for j, (_, c) in enumerate(kept[:-1]) if j != i])
            worst = min(range(len(kept) - 1), key=lambda i: (overlap_of(cells, kept[i][1]) * (1 - overlap_of(kept[i][1], others(i))), i))
            gone.append(kept.pop(worst)[0])
        s["kept"] = kept
        return row["frame_id"], True, gone

    return folded(frames, "frame_id", lambda: {"kept": []}, step, "frame_id long, is_keyframe boolean, evicted array<bigint>")


def by_distance(frames: DataFrame, most: int = 10, eps: float = 1e-3) -> DataFrame:
    """frame_id, evicted: with too many kept frames, the one goes that is far from the newest and crowded by others, by the
    root of its distance times the sum of inverse distances; the two oldest and the newest never do."""

    def step(s: dict, row: dict) -> tuple:
        place = np.array([row["ox"], row["oy"], row["oz"]])
        s["kept"].append((row["frame_id"], place))
        if len(s["kept"]) <= most:
            return row["frame_id"], None
        places = np.array([p for _, p in s["kept"]])
        d = np.linalg.norm(places[:, None] - places[None], axis=2)
        inverse = 1 / (d + eps)
        np.fill_diagonal(inverse, 0)
        score = np.sqrt(d[-1]) * inverse[:, :-1].sum(1)
        score[:2] = score[-1] = -1
        gone = s["kept"].pop(int(score.argmax()))
        return row["frame_id"], gone[0]

    return folded(frames, "frame_id", lambda: {"kept": []}, step, "frame_id long, evicted long").where("evicted IS NOT NULL")


def by_entropy(rows: DataFrame, factor: float = 1.0, most: int = 10) -> DataFrame:
    """rows (seq_id, frame_id, entropy) with is_keyframe: the entropy isn't over `factor` times the running mean of keyframes';
    evicted: the oldest kept one, first in first out."""

    def step(s: dict, row: dict) -> tuple:
        mean = s["sum"] / s["n"] if s["n"] else None
        if mean is not None and row["entropy"] > mean * factor:
            return row["frame_id"], False, None
        s["n"] += 1
        s["sum"] += row["entropy"]
        s["kept"].append(row["frame_id"])
        return row["frame_id"], True, s["kept"].pop(0) if len(s["kept"]) > most else None

    return folded(rows, "frame_id", lambda: {"n": 0, "sum": 0.0, "kept": []}, step, "frame_id long, is_keyframe boolean, evicted long")


def thinned(points: DataFrame, res: float, apart: float, most: int) -> DataFrame:
    """frame_id, point_id of a map's points by id: one is taken if its cell has fewer than `most` and none nearer than `apart`.

    What is taken depends on what was: a fold over a cell, whose list of taken points is bounded by `most`."""
    item = F.struct("frame_id", "point_id", *XYZ)
    per = with_cell(points, res).groupBy(*CELL).agg(F.array_sort(F.collect_list(item)).alias("all"))

    def step(kept: Column, p: Column) -> Column:
        near = F.exists(kept, lambda k: sum(((k[c] - p[c]) * (k[c] - p[c]) for c in XYZ[1:]), (k["x"] - p["x"]) * (k["x"] - p["x"])) < apart * apart)
        return F.when((F.size(kept) >= most) | near, kept).otherwise(F.concat(kept, F.array(p)))

    kept = F.aggregate("all", F.slice("all", 1, 0), step)
    return per.select(F.explode(kept).alias("p")).select("p.frame_id", "p.point_id")


def recent_cells(points: DataFrame, res: float, horizon: int) -> DataFrame:
    """Cells touched in one of the last `horizon` frames, with the last frame that did."""
    last = with_cell(points, res).groupBy(*CELL).agg(F.max("frame_id").alias("last_frame"))
    newest = points.agg(F.max("frame_id").alias("newest"))
    return last.join(F.broadcast(newest)).where(F.col("last_frame") > F.col("newest") - horizon).drop("newest")


def chained(rows: DataFrame, key: str, order: str, pose: str) -> DataFrame:
    """rows with world: the product of the relative poses (4x4) up to each row."""
    unit = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    before = F.array_sort(F.collect_list(F.struct(order, F.col(pose).alias("m"))).over(Window.partitionBy(key).orderBy(order)))
    return rows.withColumn("world", F.aggregate(before, unit, lambda a, r: composed(a, r["m"])))


def relaxed(nodes: DataFrame, edges: DataFrame, rounds: int = 20, hold: float = 1e-3, every: int = 2) -> DataFrame:
    """Places of a graph's nodes (node, x, y, z, fixed) that agree best with its edges (i, j, dx, dy, dz, weight: j is at i's
    place plus d): each round, every node that isn't fixed goes to the weighted mean of what its edges say, and a little of
    its own place. Two joins and one aggregate a round, whatever the size; as a round
    reads the places twice, plans would double with each, so lineage is cut every second one."""
    from .graph import checkpointed

    both = edges.select(F.col("i").alias("of"), F.col("j").alias("node"), "dx", "dy", "dz", "weight").unionByName(edges.select(F.col("j").alias("of"), F.col("i").alias("node"), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"), (-F.col("dz")).alias("dz"), "weight"))
    for k in range(rounds):
        place = nodes.select(F.col("node").alias("of"), *XYZ)
        said = both.join(place, "of").groupBy("node").agg(F.sum("weight").alias("w"), *[F.sum(F.col("weight") * (F.col(c) + F.col(f"d{c}"))).alias(f"s{c}") for c in XYZ])
        new = nodes.join(said, "node", "left")
        nodes = new.select("node", *[F.when(F.col("fixed") | F.col("w").isNull(), F.col(c)).otherwise((F.col(f"s{c}") + hold * F.col(c)) / (F.col("w") + hold)).alias(c) for c in XYZ], "fixed")
        if k % every == every - 1:
            nodes = checkpointed(nodes)
    return nodes


def reanchored(nodes: DataFrame, session: int, pose: Sequence[float]) -> DataFrame:
    """Nodes (session, ..., x, y, z) of a session moved by a 4x4 pose, others as they are."""
    from ..functions.geometry import moved, vec

    new = moved(pose, vec(*XYZ))
    return nodes.withColumns({c: F.when(F.col("session") == session, v).otherwise(F.col(c)) for c, v in zip(XYZ, new)})


def grown(points: DataFrame, normals: DataFrame, seed_id: int, radius: float, degrees: float) -> DataFrame:
    """frame_id, point_id of the region around the seed of each frame that has one of this id: points linked by distances under radius and normals within the angle."""
    from .graph import checkpointed
    from .joins import radius_pairs
    from .moving import framed_components

    axes = ("nx", "ny", "nz")
    known = points.select("frame_id", "point_id", *XYZ).join(normals.select("frame_id", "point_id", *axes), ["frame_id", "point_id"])
    pairs = radius_pairs(checkpointed(known), radius, carried=axes)
    alike = F.abs(sum((F.col(f"{c}_a") * F.col(f"{c}_b") for c in axes[1:]), F.col("nx_a") * F.col("nx_b"))) > float(np.cos(np.radians(degrees)))
    root = framed_components(pairs.where(alike))
    mine = root.where(F.col("point_id") == seed_id).select("frame_id", "root")
    found = root.join(mine, ["frame_id", "root"], "left_semi").select("frame_id", "point_id")
    return points.join(found, ["frame_id", "point_id"], "left_semi").select("frame_id", "point_id")


def closest_pair(a: DataFrame, b: DataFrame, reach: float, tries: int = 20) -> DataFrame:
    """a_id, b_id, d2: the nearest pair between two maps' nodes (id, x, y, z), ties by ids. The cells double until there is a
    pair nearer than they reach, so near maps cost one join on small cells: of side reach, halved until a cell holds a place
    or so. Of nodes at one place only the least id can be of the pair."""
    from .graph import checkpointed
    from .joins import radius_pairs

    a, b = (checkpointed(m.groupBy(*XYZ).agg(F.min("id").alias("point_id")).select(F.lit(0).alias("frame_id"), "point_id", *XYZ)) for m in (a, b))
    n, *spread = a.union(b).agg(F.count(F.lit(1)), *[F.stddev_pop(c) for c in XYZ]).first()
    fit = float(np.prod([4 * max(s, max(spread) / 100) for s in spread]) / n) ** (1 / 3) if n else 0.0
    halved = max(0, int(np.ceil(np.log2(reach / fit)))) if np.isfinite(fit) and fit > 0 else 0
    reach /= 2**halved
    for _ in range(tries + halved):
        best = radius_pairs(a, reach, b).agg(F.min(F.struct("d2", "a", "b")).alias("m")).where("m IS NOT NULL")
        if not best.isEmpty():
            break
        reach *= 2
    return best.select(F.col("m.a").alias("a_id"), F.col("m.b").alias("b_id"), F.col("m.d2").alias("d2"))
