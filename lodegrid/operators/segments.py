"""Objects cut out of a cloud by a least cut: maximum flow on the graph of neighbours, block by block."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import dot, vec
from .cloud import CELL, XYZ, with_cell
from .graph import stored

#: Capacities are whole numbers of this unit; a label of NEVER says that the sink can't be reached.
UNIT, HARD, NEVER = 1_000_000, 1 << 40, 1 << 40
WORK = "frame_id long, block long, kind int, u long, v long, bv long, cap long, sink long, label long, old long"


class Flow:
    """A residual graph in one task: arcs in pairs (an arc and its reverse), paths by levels (Dinic)."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def arc(self, u: int, v: int, cap: int, back: int = 0) -> int:
        self.out[u].append(len(self.to))
        self.out[v].append(len(self.to) + 1)
        self.to += [v, u]
        self.cap += [cap, back]
        return len(self.to) - 2

    def levels(self, start: int) -> list[int]:
        level, todo = [-1] * len(self.out), deque([start])
        level[start] = 0
        while todo:
            u = todo.popleft()
            for a in self.out[u]:
                if self.cap[a] > 0 and level[self.to[a]] < 0:
                    level[self.to[a]] = level[u] + 1
                    todo.append(self.to[a])
        return level

    def push(self, s: int, t: int) -> None:
        """All that can flow from s to t."""
        while (level := self.levels(s))[t] >= 0:
            at, path, u = [0] * len(self.out), [], s
            while True:
                if u == t:
                    f = min(self.cap[a] for a in path)
                    for a in path:
                        self.cap[a] -= f
                        self.cap[a ^ 1] += f
                    cut = next(i for i, a in enumerate(path) if self.cap[a] == 0)
                    u, path = self.to[path[cut] ^ 1], path[:cut]
                elif at[u] < len(self.out[u]):
                    a = self.out[u][at[u]]
                    if self.cap[a] > 0 and level[self.to[a]] == level[u] + 1:
                        path.append(a)
                        u = self.to[a]
                    else:
                        at[u] += 1
                elif path:
                    u = self.to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break

    def reaching(self, goals: list[int], n: int) -> list[int]:
        """Nodes from which residual arcs lead to one of the goals by way of the first n nodes."""
        seen, todo = set(goals), deque(goals)
        while todo:
            v = todo.popleft()
            for a in self.out[v]:
                if self.to[a] < n and self.cap[a ^ 1] > 0 and self.to[a] not in seen:
                    seen.add(self.to[a])
                    todo.append(self.to[a])
        return list(seen)


def discharged(block: pd.DataFrame) -> pd.DataFrame:
    """One block's excess goes to the sink, then over the border to nodes of rising label; its nodes' labels follow: how many
    borders the way to the sink crosses at least."""
    nodes, arcs = block[block.kind == 0].sort_values("u"), block[block.kind == 1].sort_values(["u", "v"])
    ids = {u: i for i, u in enumerate(nodes.u)}
    inner = arcs.v.isin(list(ids)).to_numpy()
    beyond = arcs[~inner].drop_duplicates("v")
    ids |= {v: len(nodes) + i for i, v in enumerate(beyond.v)}
    s, t = len(ids), len(ids) + 1
    g = Flow(len(ids) + 2)
    given = [g.arc(s, i, int(e)) for i, e in enumerate(nodes.cap)]
    drains = [g.arc(i, t, int(c)) for i, c in enumerate(nodes.sink)]
    caps = {(u, v): c for u, v, c in zip(arcs.u, arcs.v, arcs.cap)}
    made: dict[tuple, int] = {}
    for u, v, inside in zip(arcs.u, arcs.v, inner):
        if not inside:
            made[u, v] = g.arc(ids[u], ids[v], int(caps[u, v]))
        elif u < v:
            made[u, v] = g.arc(ids[u], ids[v], int(caps[u, v]), int(caps.get((v, u), 0)))
            made[v, u] = made[u, v] + 1
    g.push(s, t)
    by_label = beyond[beyond.label < NEVER].groupby("label")["v"]
    for _, part in by_label:
        for v in part:
            g.arc(ids[v], t, HARD)
        g.push(s, t)
    label = np.full(len(nodes), NEVER)
    doors = [([i for i, a in enumerate(drains) if g.cap[a] > 0], 0)]
    for name, part in by_label:
        want = {ids[v] for v in part}
        doors.append(([i for i in range(len(nodes)) if any(g.cap[a] > 0 and g.to[a] in want for a in g.out[i])], int(name) + 1))
    for goals, value in doors:
        for i in g.reaching(goals, len(nodes)):
            label[i] = min(label[i], value)
    label = np.maximum(label, nodes.label.to_numpy())
    left = nodes.assign(cap=[g.cap[a] for a in given], sink=[g.cap[a] for a in drains], old=nodes.label, label=label)
    flow = [g.cap[made[u, v]] for u, v in zip(arcs.u, arcs.v)]
    own = dict(zip(nodes.u, label))
    after = arcs.assign(sink=np.where(inner, 0, arcs.cap.to_numpy() - np.array(flow, dtype="int64")) if len(arcs) else 0, cap=np.where(inner, flow, arcs.cap) if len(arcs) else 0, label=[own[u] for u in arcs.u])
    return pd.concat([left, after])[[c.split()[0] for c in WORK.split(", ")]]


def least_cut(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """frame_id, node, is_source of the least cut of each frame: true for nodes that can't reach the sink once the flow is at
    its most (of several least cuts, the one with most nodes on the source's side).

    nodes: frame_id, node, block, source and sink (capacities, whole numbers); arcs: frame_id, u, v, cap. Blocks, which should
    be of bounded size, are discharged at the same time, each in one task that sees its neighbours' labels only. What two
    blocks send over a border is kept where the labels allow for it and handed back where not, so labels stay valid; labels
    above a gap can't reach the sink. Rounds end when no excess can move and no label changes. Null capacities are 0; arcs from
    a node to itself and to nodes that aren't there are left out."""
    n = nodes.select("frame_id", "node", "block", F.coalesce("source", F.lit(0)).cast("long").alias("excess"), F.coalesce("sink", F.lit(0)).cast("long").alias("sink"), F.lit(0).cast("long").alias("label"))
    n = stored(n)
    both = arcs.where("u <> v").select("frame_id", "u", "v", F.coalesce("cap", F.lit(0)).cast("long").alias("cap"))
    both = both.unionByName(both.select("frame_id", F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).cast("long").alias("cap")))
    e = both.groupBy("frame_id", "u", "v").agg(F.sum("cap").alias("cap"))
    ends = {k: n.select("frame_id", F.col("node").alias(k), F.col("block").alias(f"b{k}")) for k in "uv"}
    e = stored(e.join(ends["u"], ["frame_id", "u"]).join(ends["v"], ["frame_id", "v"]).select("frame_id", "u", "v", "bu", "bv", "cap"))
    zero = F.lit(0).cast("long")
    while True:
        labels = n.select("frame_id", F.col("node").alias("v"), "label")
        cross = e.where("bu <> bv").join(labels, ["frame_id", "v"])
        within = e.where("bu = bv").withColumn("label", zero)
        rows = n.select("frame_id", "block", F.lit(0).alias("kind"), F.col("node").alias("u"), zero.alias("v"), zero.alias("bv"), F.col("excess").alias("cap"), "sink", "label", zero.alias("old"))
        for part in (cross, within):
            rows = rows.unionByName(part.select("frame_id", F.col("bu").alias("block"), F.lit(1).alias("kind"), "u", "v", "bv", "cap", zero.alias("sink"), "label", zero.alias("old")))
        done = stored(rows.groupBy("frame_id", "block").applyInPandas(discharged, WORK))

        at = done.where("kind = 0").select("frame_id", F.col("u").alias("node"), "block", F.col("cap").alias("excess"), "sink", "label", "old")
        sent = done.where("kind = 1 AND block <> bv AND sink > 0").select("frame_id", "u", "v", F.col("sink").alias("f"), F.col("label").alias("lu"))
        sent = sent.join(at.select("frame_id", F.col("node").alias("v"), F.col("label").alias("lv")), ["frame_id", "v"]).withColumn("kept", F.col("lv") <= F.col("lu") + 1)
        got = sent.groupBy("frame_id", F.when(F.col("kept"), F.col("v")).otherwise(F.col("u")).alias("node")).agg(F.sum("f").alias("more"))
        moved = sent.where("kept")
        delta = moved.select("frame_id", "u", "v", (-F.col("f")).alias("d")).unionByName(moved.select("frame_id", F.col("v").alias("u"), F.col("u").alias("v"), F.col("f").alias("d")))
        delta = delta.groupBy("frame_id", "u", "v").agg(F.sum("d").alias("d"))
        e = done.where("kind = 1").select("frame_id", "u", "v", F.col("block").alias("bu"), "bv", "cap").join(delta, ["frame_id", "u", "v"], "left")
        e = stored(e.withColumn("cap", F.col("cap") + F.coalesce("d", zero)).drop("d"))

        seen = at.where(F.col("label") < NEVER).select("frame_id", "label").distinct()
        before = F.lag("label", 1, -1).over(Window.partitionBy("frame_id").orderBy("label"))
        gap = seen.withColumn("before", before).where("label > before + 1").groupBy("frame_id").agg(F.min("label").alias("gap"))
        n = at.join(got, ["frame_id", "node"], "left").join(gap, "frame_id", "left")
        n = n.withColumns({"excess": F.col("excess") + F.coalesce("more", zero), "label": F.when(F.col("label") >= F.col("gap"), NEVER).otherwise(F.col("label")).cast("long")}).drop("more", "gap")
        n = stored(n)
        left = n.agg(F.count_if((F.col("excess") > 0) & (F.col("label") < NEVER)), F.count_if(F.col("label") != F.col("old"))).first()
        if not any(left):
            return n.select("frame_id", "node", (F.col("label") >= NEVER).alias("is_source"))
        n = n.drop("old")


def in_blocks(points: DataFrame, side: float, most: int) -> DataFrame:
    """points with block: a frame of at most `most` points is one; larger ones are dealt by cells of a side, and cells of more
    points are split, so that no block is larger than about that. Blocks set who computes, not what is found."""
    at = with_cell(points, side)
    cells = at.groupBy("frame_id", *CELL).agg(F.count(F.lit(1)).alias("_n"))
    frames = cells.groupBy("frame_id").agg(F.sum("_n").alias("_all"))
    part = F.pmod(F.xxhash64("point_id"), F.ceil(F.col("_n") / most))
    dealt = at.join(cells.join(frames, "frame_id"), ["frame_id", *CELL])
    return dealt.withColumn("block", F.when(F.col("_all") <= most, F.lit(0).cast("long")).otherwise(F.xxhash64(*CELL, part))).drop("_n", "_all", *CELL)


def cut_graph(points: DataFrame, picked: DataFrame, neighbours: DataFrame, normals: DataFrame, foreground: float, background: float, weight: float, distance_sigma: float, angle_sigma: float) -> tuple[DataFrame, DataFrame]:
    """Nodes and arcs of least_cut for the object at each frame's picked point (frame_id, x, y, z). Points within the
    foreground's radius are fed with the weight, those beyond the background's are drained without limit; neighbours hold
    together by exp(-(distance / sigma)^2 - (angle of normals / sigma)^2), in both directions."""
    p = points.join(picked.select("frame_id", *[F.col(c).alias(f"p{c}") for c in XYZ]), "frame_id")
    d2 = sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in XYZ), F.lit(0.0))
    source = F.when(d2 <= foreground * foreground, round(weight * UNIT)).otherwise(0)
    sink = F.when(d2 > background * background, HARD).otherwise(0)
    nodes = p.select("frame_id", F.col("point_id").alias("node"), "block", source.cast("long").alias("source"), sink.cast("long").alias("sink"))
    n = normals.select("frame_id", F.col("point_id").alias("u"), F.struct("nx", "ny", "nz").alias("nu"))
    pairs = neighbours.where("point_id <> nbr_id").select("frame_id", F.least("point_id", "nbr_id").alias("u"), F.greatest("point_id", "nbr_id").alias("v"), "d2").distinct()
    pairs = pairs.join(n, ["frame_id", "u"]).join(n.select("frame_id", F.col("u").alias("v"), F.col("nu").alias("nv")), ["frame_id", "v"])
    alike = F.least(F.lit(1.0), F.abs(dot(vec("nu.nx", "nu.ny", "nu.nz"), vec("nv.nx", "nv.ny", "nv.nz"))))
    bend = F.coalesce(F.when(~F.isnan(alike), F.acos(alike)), F.lit(0.0)) / angle_sigma
    pairs = pairs.withColumn("cap", F.round(UNIT * F.exp(-F.col("d2") / (distance_sigma * distance_sigma) - bend * bend)).cast("long"))
    arcs = pairs.select("frame_id", "u", "v", "cap").unionByName(pairs.select("frame_id", F.col("v").alias("u"), F.col("u").alias("v"), "cap"))
    return nodes, arcs


def segmented(points: DataFrame, picked: DataFrame, foreground: float = 0.5, background: float = 5.0, weight: float = 10.0, distance_sigma: float = 0.25, angle_sigma: float = 0.17, k: int = 20, most: int = 2048) -> DataFrame:
    """frame_id, point_id of the object at each frame's picked point, among its points within the background's radius and one
    metre more. Frames without a picked point, or with nothing near it, give no rows; coordinates must not be null. Ties
    between least cuts are for the larger object."""
    from .ground import normals as normals_of
    from .joins import knn

    at = picked.select("frame_id", *[F.col(c).alias(f"p{c}") for c in XYZ])
    d2 = sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in XYZ), F.lit(0.0))
    reach = (background + 1.0) ** 2
    near = points.select("frame_id", "point_id", *XYZ).join(at, "frame_id").where(d2 < reach).select("frame_id", "point_id", *XYZ)
    near = stored(in_blocks(near, background / 2, most))
    around = stored(knn(near, k, max(distance_sigma, background / 10)))
    nodes, arcs = cut_graph(near, picked, around, normals_of(near, around), foreground, background, weight, distance_sigma, angle_sigma)
    return least_cut(nodes, arcs).where("is_source").select("frame_id", F.col("node").alias("point_id"))
