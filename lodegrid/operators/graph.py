"""Chunks of frames, map graphs and their edges, connected components, and least squares by sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import composed, inverse, moved_by, vec


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, an own one, but in local mode only: elsewhere that is an
    error, as no executor would see the driver's folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodegrid-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder as a table and read again: for rounds that join what the rounds before made. A checkpoint
    keeps the plan's estimate of its size, which a join multiplies, so that it would have twice the digits after each round."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node that each node of the edges reaches, by alternating large and small stars."""
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        e = checkpointed(large.join(least, "u").select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        seen = state


def chunks(rows: DataFrame, key: str, order: str, size: int = 15) -> DataFrame:
    """Chunks of `size` rows of each key: first, middle (of n, number n / 2) and last index, and how many."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    numbered = rows.withColumn("chunk", F.floor(k / size).cast("long"))
    out = numbered.groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.array_sort(F.collect_list(order)).alias("all"))
    return out.withColumn("origin", F.element_at("all", (F.floor(F.size("all") / 2) + 1).cast("int"))).drop("all")


def keyframes(rows: DataFrame, key: str, order: str, x: str, y: str, distance2: int) -> DataFrame:
    """Rows of each key that are further than a distance from the last keyframe (not the last row); the first one is.

    What counts depends on what counted before: a fold over the key's ordered rows, read as a stream."""
    from .motion import folded

    def step(state: dict, r: dict) -> tuple | None:
        if state and (r["x"] - state["x"]) ** 2 + (r["y"] - state["y"]) ** 2 <= distance2:
            return None
        state.update(x=r["x"], y=r["y"])
        return r["k"], r["x"], r["y"]

    named = rows.select(F.col(key).alias("seq_id"), F.col(order).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
    kinds = {f.name: f.dataType.simpleString() for f in named.schema}
    out = folded(named, "k", dict, step, ", ".join(f"{c} {kinds[c]}" for c in ("k", "x", "y")))
    return out.select(F.col("seq_id").alias(key), F.col("k").alias(order), F.col("x").alias(x), F.col("y").alias(y))


def displaced(rows: DataFrame, key: str, order: str, pose: str, shift: float, degrees: float) -> DataFrame:
    """key and order of the rows of each key (whole numbers) whose pose (4x4) is further than `shift` or turned by more than
    `degrees` from the last keyframe's (not the last row's); the first one is a keyframe. A fold, as keyframes."""
    from .motion import folded

    def step(state: dict, r: dict) -> tuple | None:
        now = np.asarray(r["pose"], float).reshape(4, 4)
        if state:
            turn = state["pose"][:3, :3].T @ now[:3, :3]
            angle = np.degrees(np.arctan2(np.linalg.norm([turn[2, 1] - turn[1, 2], turn[0, 2] - turn[2, 0], turn[1, 0] - turn[0, 1]]), np.trace(turn) - 1))
            if np.linalg.norm(now[:3, 3] - state["pose"][:3, 3]) <= shift and angle <= degrees:
                return None
        state["pose"] = now
        return (r["k"],)

    named = rows.select(F.col(key).alias("seq_id"), F.col(order).cast("long").alias("k"), F.col(pose).alias("pose"))
    return folded(named, "k", dict, step, "k long").select(F.col("seq_id").alias(key), F.col("k").alias(order))


def steps(rows: DataFrame, key: str, order: str, coords: Sequence[str]) -> DataFrame:
    """rows with step2, the squared distance to the row before (0 for the first)."""
    by = Window.partitionBy(key).orderBy(order)
    d2 = sum(((F.col(c) - F.lag(c).over(by)) * (F.col(c) - F.lag(c).over(by)) for c in coords), F.lit(0))
    return rows.withColumn("step2", F.coalesce(d2, F.lit(0)))


def travelled(rows: DataFrame, key: str, order: str, coords: Sequence[str]) -> DataFrame:
    """rows with travel: what the steps up to each row add up to, each rounded down to whole units."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps(rows, key, order, coords).withColumn("travel", F.sum(F.floor(F.sqrt("step2")).cast("long")).over(by))


def loop_candidates(rows: DataFrame, key: str, index: str, coords: Sequence[str], near: int, least_travel: int) -> DataFrame:
    """Pairs of a key that are near each other with at least so much travel between them; an exact join by cells."""
    from .joins import pairs_within

    pairs = pairs_within(travelled(rows, key, index, coords), key, index, coords, near, ["travel"])
    return pairs.select(key, "i", "j", "d2", (F.col("travel_j") - F.col("travel_i")).alias("between")).where(F.col("between") >= least_travel)


def missing_edges(nodes: DataFrame, edges: DataFrame, key: str, index: str) -> DataFrame:
    """Consecutive nodes without an edge: what a repaired graph gets."""
    after = F.lead(index).over(Window.partitionBy(key).orderBy(index))
    wanted = nodes.select(key, F.col(index).alias("i"), after.alias("j")).where("j IS NOT NULL")
    return wanted.join(edges.select(key, "i", "j"), [key, "i", "j"], "left_anti")


def odometry_edges(nodes: DataFrame, key: str, index: str, pose: str) -> DataFrame:
    """Relative pose from each node to the next: inverse(pose i) * pose j."""
    by = Window.partitionBy(key).orderBy(index)
    pairs = nodes.select(key, F.col(index).alias("i"), F.lead(index).over(by).alias("j"), F.col(pose).alias("a"), F.lead(pose).over(by).alias("b")).where("j IS NOT NULL")
    return pairs.select(key, "i", "j", composed(inverse(F.col("a")), F.col("b")).alias("relative"))


def sessions(first: DataFrame, second: DataFrame, index: str = "submap_id") -> DataFrame:
    """Two maps as one: the second's ids go on where the first's end."""
    offset = first.agg(F.coalesce(F.max(index) + 1, F.lit(0)).alias("_offset"))
    moved = second.join(F.broadcast(offset)).withColumn(index, F.col(index) + F.col("_offset")).drop("_offset")
    return first.withColumn("session", F.lit(0)).unionByName(moved.withColumn("session", F.lit(1)))


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).dropDuplicates(["i", "j"])


def edge_kinds(kind: Column) -> Column:
    """Classes of factors as an editor lists them."""
    return F.when(kind.rlike("matching|vgicp|gicp"), "matching").when(kind.rlike("between"), "between").when(kind.rlike("imu"), "imu").otherwise("other")


def in_world(points: DataFrame, poses: DataFrame, key: str = "submap_id") -> DataFrame:
    """Points of submaps under their submap's pose (a bounded table: one matrix per submap)."""
    joined = points.join(poses.select(key, F.col("pose")), key)
    return joined.withColumns(dict(zip(("wx", "wy", "wz"), moved_by(F.col("pose"), vec("x", "y", "z"))))).drop("pose")


def normal_equations(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """H, b and error of pairs (px, py, pz near qx, qy, qz) for a small turn and shift: 28 sums in one aggregate."""
    p, d = vec("px", "py", "pz"), [F.col(f"p{c}") - F.col(f"q{c}") for c in "xyz"]
    zero, one = F.lit(0.0), F.lit(1.0)
    # Rows of the Jacobian of turn x p + shift - q, three for each pair.
    j = [[zero, p[2], -p[1], one, zero, zero], [-p[2], zero, p[0], zero, one, zero], [p[1], -p[0], zero, zero, zero, one]]
    sums = [F.sum(sum((j[r][a] * j[r][b] for r in range(3)), zero)).alias(f"h{a}{b}") for a in range(6) for b in range(a, 6)]
    sums += [F.sum(sum((j[r][a] * d[r] for r in range(3)), zero)).alias(f"b{a}") for a in range(6)]
    row = pairs.agg(*sums, F.sum(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("e")).first()
    h = np.zeros((6, 6))
    for a in range(6):
        for b in range(a, 6):
            h[a, b] = h[b, a] = row[f"h{a}{b}"] or 0.0
    return h, np.array([row[f"b{a}"] or 0.0 for a in range(6)]), row["e"] or 0.0


def rotation(w: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    return np.eye(3) + k if angle < 1e-12 else np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * (k @ k)


def registered(source: DataFrame, target: DataFrame, reach: float, steps: int = 10, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """4x4 pose that lays source (frame_id, point_id, x, y, z) on target, and its mean squared error: nearest neighbours within
    reach by a join on cells, sums by Spark, six unknowns solved on the driver, until the step is under 1 mm and 0.001 degrees."""
    from .cloud import XYZ
    from .joins import nearest

    pose, error = np.eye(4) if start is None else start.copy(), float("nan")
    for _ in range(steps):
        flat = [float(v) for v in pose.ravel()]
        row = F.array(*[F.lit(v) for v in flat])
        moved = source.select("frame_id", "point_id", *[c.alias(n) for c, n in zip(moved_by(row, vec(*XYZ)), XYZ)])
        both = nearest(moved, target, reach).drop("d2").join(moved.select("frame_id", F.col("point_id").alias("a"), *[F.col(c).alias(f"p{c}") for c in XYZ]), ["frame_id", "a"])
        both = both.join(target.select("frame_id", F.col("point_id").alias("b"), *[F.col(c).alias(f"q{c}") for c in XYZ]), ["frame_id", "b"])
        n = both.count()
        if n < 3:
            return pose, float("nan")
        h, b, e = normal_equations(both)
        step = np.linalg.solve(h + 1e-9 * np.eye(6), -b)
        turn = np.eye(4)
        turn[:3, :3], turn[:3, 3] = rotation(step[:3]), step[3:]
        pose, error = turn @ pose, e / n
        if np.linalg.norm(step[3:]) < 1e-3 and np.degrees(np.linalg.norm(step[:3])) < 1e-3:
            break
    return pose, error


