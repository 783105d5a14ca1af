"""Least cuts against a plain maximum flow, and an object cut out of a scene."""

from collections import defaultdict, deque

import numpy as np
import pandas as pd
import pytest

from lodegrid.operators import segments


def plain_cut(nodes, arcs):
    """Nodes that can't reach the sink after shortest augmenting paths, and the flow."""
    cap = defaultdict(int)
    near = defaultdict(set)
    for u, v, c in [*arcs, *[("s", n, a) for n, a, _ in nodes], *[(n, "t", b) for n, _, b in nodes]]:
        if u != v:
            cap[u, v] += c
            near[u].add(v)
            near[v].add(u)
    flow = 0
    while True:
        came, todo = {"s": None}, deque(["s"])
        while todo and "t" not in came:
            u = todo.popleft()
            for v in near[u]:
                if v not in came and cap[u, v] > 0:
                    came[v] = u
                    todo.append(v)
        if "t" not in came:
            break
        path, v = [], "t"
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        f = min(cap[a] for a in path)
        for u, v in path:
            cap[u, v] -= f
            cap[v, u] += f
        flow += f
    reach, todo = {"t"}, deque(["t"])
    while todo:
        v = todo.popleft()
        for u in near[v]:
            if u not in reach and cap[u, v] > 0:
                reach.add(u)
                todo.append(u)
    return {n for n, _, _ in nodes} - reach, flow


@pytest.mark.parametrize("blocks", [1, 7])
def test_cut_of_500_points_is_the_plain_one(spark, blocks):
    rng = np.random.default_rng(3)
    nodes, arcs, rows = {}, {}, []
    for frame, count in ((0, 500), (1, 60)):
        at = rng.uniform(0, 10, (count, 2))
        nodes[frame] = [(k, int(rng.integers(0, 30)) if x < 3 else 0, int(rng.integers(0, 30)) if x > 7 else 0) for k, (x, _) in enumerate(at)]
        rows += [(frame, k, int(at[k, 0] * blocks / 10) * 100 + int(at[k, 1] > 5) * (blocks > 1), a, b) for k, a, b in nodes[frame]]
        near = [(i, int(j)) for i in range(count) for j in np.argsort(((at - at[i]) ** 2).sum(1))[1:5]]
        arcs[frame] = [(i, j, int(rng.integers(0, 12))) for i, j in near] + [(5, 5, 9)]
    n = spark.createDataFrame(pd.DataFrame(rows, columns=["frame_id", "node", "block", "source", "sink"]))
    e = spark.createDataFrame([(f, *a) for f, part in arcs.items() for a in part] + [(0, 1, 9999, 3)], "frame_id long, u long, v long, cap long")
    got = segments.least_cut(n, e).collect()
    for frame in nodes:
        want, flow = plain_cut(nodes[frame], arcs[frame])
        assert {r["node"] for r in got if r["frame_id"] == frame and r["is_source"]} == want and flow > 0
        ends = {k: (a, b) for k, a, b in nodes[frame]}
        value = sum(c for u, v, c in arcs[frame] if u in want and v not in want) + sum(b if k in want else a for k, (a, b) in ends.items())
        assert value == flow
    assert len(got) == len(rows)


def test_nothing_to_cut(spark):
    n = spark.createDataFrame([(0, 1, 0, None, None)], "frame_id long, node long, block long, source long, sink long")
    e = spark.createDataFrame([], "frame_id long, u long, v long, cap long")
    assert [r["is_source"] for r in segments.least_cut(n, e).collect()] == [True]
    assert segments.least_cut(n.limit(0), e).count() == 0


def test_a_box_is_cut_from_the_floor(spark):
    rng = np.random.default_rng(1)
    floor = np.column_stack([rng.uniform(-3, 3, (900, 2)), rng.normal(0, 0.005, 900)])
    box = np.column_stack([rng.uniform(-0.3, 0.3, (250, 2)), rng.uniform(0.45, 0.9, 250)])
    far = rng.uniform(20, 30, (50, 3))
    rows = [(0, k, *map(float, p)) for k, p in enumerate(np.concatenate([box, floor, far]))]
    pts = spark.createDataFrame(pd.DataFrame(rows, columns=["frame_id", "point_id", "x", "y", "z"]))
    picked = spark.createDataFrame([(0, 0.0, 0.0, 0.7), (4, 0.0, 0.0, 0.0)], "frame_id long, x double, y double, z double")
    got = {r["point_id"] for r in segments.segmented(pts, picked, 0.2, 2.0, 10.0, 0.15, 0.3, 12, most=200).collect()}
    assert got == set(range(250))
    assert segments.segmented(pts.limit(0), picked).count() == 0
