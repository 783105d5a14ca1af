"""What only larger tables show: plans, chunks of a long sequence, tables of several files."""

import numpy as np
from pyspark.sql import functions as F

from lodegrid.functions.geometry import in_inflated, vec
from lodegrid.operators import graph, joins, keyframes, merge, moving
from lodegrid.plans import catalogue
from lodegrid.sources import adapters as A

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_dealt_to_cells_are_not_broadcast(spark):
    maps = spark.range(200).select((F.col("id") % 5).alias("s"), F.col("id").alias("k"), (F.col("id") * 37 % 101).alias("x"), (F.col("id") * 53 % 103).alias("y"))
    pairs = joins.pairs_within(maps, "s", "k", ("x", "y"), 25)
    assert "BroadcastHashJoin" not in plan(pairs)
    rows = [tuple(r) for r in maps.collect()]
    told = {(a[0], a[1], b[1], (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 625}
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == len(told) and set(found) == told
    pts = spark.range(100).select(F.lit(0).alias("frame_id"), F.col("id").alias("point_id"), *[(F.col("id") * k % 7).cast("double").alias(c) for k, c in zip((3, 5, 11), "xyz")])
    assert "BroadcastHashJoin" not in plan(joins.radius_pairs(pts, 2.0))


def test_footprints_are_found_once_a_box(spark):
    """No root is taken for each pair of a point and a box."""
    pts = spark.range(50).select(F.lit(0).alias("frame_id"), F.col("id").alias("point_id"), *[(F.col("id") * k % 9).cast("double").alias(c) for k, c in zip((3, 5, 2), "xyz")])
    boxes = spark.createDataFrame([(0, 4.0, 4.0, 4.0, 2.0, 3.0, 6.0, 1.0, 2.0), (1, 2.0, 7.0, 1.0, 3.0, 1.0, 4.0, 0.0, 0.0)], "box_idx long, cx double, cy double, cz double, sx double, sy double, sz double, vx double, vy double")
    found = joins.first_box(pts, boxes, True)
    lambdas = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "lambdafunction" in line]
    assert lambdas and not any("SQRT" in line.upper() for line in lambdas)
    inside = in_inflated(vec("x", "y", "z"), vec("cx", "cy", "cz"), vec("sx", "sy", "sz"), (F.col("vx"), F.col("vy"), F.lit(0.0)))
    told = pts.join(boxes, inside).groupBy("point_id").agg(F.min("box_idx").alias("b")).collect()
    assert {r[0]: r[1] for r in told} == {r["point_id"]: r["box_idx"] for r in found.where("box_idx IS NOT NULL").collect()} != {}


def test_stream_of_files_whose_sequences_come_in_chunks(spark, tmp_path):
    """A table of several files; rows of a sequence aren't in order and span Arrow batches; one has no stamp."""
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.col("user_id") % 3)
    events = events.withColumn("ts", F.when(F.col("event_id") % 50 != 7, F.when(F.col("event_id") % 9 == 0, F.expr("ts - INTERVAL 3 DAYS")).otherwise(F.col("ts"))))
    events.orderBy(F.xxhash64("event_id")).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {r["id"]: r["accepted"] for r in catalogue.QUERIES["stream_accept"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last, told = {}, {}
    for r in A.samples(spark, str(tmp_path)).orderBy("id").collect():
        told[r["id"]] = None if r["us"] is None else r["us"] >= last.get(r["seq_id"], 0)
        last[r["seq_id"]] = max(last.get(r["seq_id"], 0), r["us"] or 0)
    assert found == told and {True, False, None} == set(told.values())


def test_nearest_neighbours_of_a_dense_frame(spark, monkeypatch):
    """Candidates grow with the points, not with the square: a frame a thousand times denser than the reach says, one far point."""
    dense = spark.range(3000).select(F.lit(0).cast("long").alias("frame_id"), F.col("id").alias("point_id"), *[((F.col("id") * k % 3001) / 3001).alias(c) for k, c in zip((7, 1009, 2003), "xyz")])
    far = spark.createDataFrame([(0, 9000, 40.0, 0.0, 0.0), (1, 9001, 0.0, 0.0, 0.0), (1, 9002, 5.0, 0.0, 0.0)], dense.schema)
    pts = dense.union(far)
    met = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda d2: met.add(1) or d2, "double")
    squared = joins.squared
    monkeypatch.setattr(joins, "squared", lambda a, b: counted(squared(a, b)))
    found = joins.knn(pts, 4, 8.0)
    got = {}
    for r in found.collect():
        got.setdefault((r["frame_id"], r["point_id"]), []).append((r["rank"], r["nbr_id"]))
    assert met.value < 1_000_000  # all pairs are 9 million
    rows = [tuple(r) for r in pts.collect()]
    at = {f: (np.array([r[1] for r in rows if r[0] == f]), np.array([r[2:] for r in rows if r[0] == f])) for f in (0, 1)}
    for f, (ids, xyz) in at.items():
        for i in range(0, len(ids), 97 if f == 0 else 1):
            d2 = ((xyz - xyz[i]) ** 2).sum(1)
            told = ids[np.lexsort((ids, d2))][:4].tolist()
            assert [n for _, n in sorted(got[f, ids[i]])] == told
    assert len(got) == len(rows) and [n for _, n in sorted(got[0, 9000])][0] == 9000


def test_memory_of_walls_takes_no_turned_boxes(spark, monkeypatch):
    """Boxes along the axes are compared in plain numbers, of the same value to the bit."""
    rng = np.random.default_rng(3)
    keys = [f"{k}{c}" for k in "cs" for c in "xyz"]
    for _ in range(300):
        a, b = (dict(zip(keys, [*rng.integers(0, 6, 3).astype(float), *(rng.integers(0, 5, 3) * 0.7)])) for _ in range(2))
        old = merge.obb_iou(*[(np.array([v[k] for k in keys[:3]]), np.array([v[k] for k in keys[3:]]), np.eye(3)) for v in (a, b)])
        assert merge.aligned_iou(a, b) == old


def test_closest_pair_of_many_nodes_at_one_place(spark):
    """Nodes at one place count once; the pair is the least of all that are as near, at any density."""
    at = lambda n, off: spark.range(n).select((F.col("id") * 2 + off).alias("id"), (F.col("id") % 3 + off * 0.25).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    seen = []
    plain = joins.radius_pairs
    try:
        joins.radius_pairs = lambda a, r, b: seen.append((a.count(), b.count())) or plain(a, r, b)
        row = keyframes.closest_pair(at(600, 0), at(600, 1), 2.0).first()
    finally:
        joins.radius_pairs = plain
    assert tuple(row) == (0, 1, 0.0625) and set(seen) == {(3, 3)}
    assert keyframes.closest_pair(at(0, 0), at(5, 1), 2.0, 2).first() in (None, (None, None, None))


def test_travel_comes_with_the_pairs(spark):
    """Nothing is joined to the pairs: Spark would take a table of windows for small and send it through the driver."""
    maps = spark.range(60).select((F.col("id") % 2).alias("s"), (F.col("id") * 17 % 60).alias("k"), (F.col("id") * 37 % 41).alias("x"), (F.col("id") * 53 % 43).alias("y"))
    found = graph.loop_candidates(maps, "s", "k", ("x", "y"), 20, 50)
    assert "BroadcastHashJoin" not in plan(found)
    way, at = {}, {}
    for s, k, x, y in sorted(tuple(r) for r in maps.collect()):
        before = at.get(s)
        way[s, k] = (0 if before is None else way[s, before[0]][0] + int(np.sqrt((x - before[1]) ** 2 + (y - before[2]) ** 2)), x, y)
        at[s] = (k, x, y)
    pairs = [(s, i, j, (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, b[0] - a[0]) for (s, i), a in way.items() for (z, j), b in way.items() if s == z and i < j]
    told = {p for p in pairs if p[3] <= 400 and p[4] >= 50}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(told) > 0 and set(rows) == told


def test_registration_of_a_dense_cloud(spark, monkeypatch):
    """Candidates grow with the points, not with the square; ties go to the least id, and what is as far as the reach is none."""
    at = lambda n, off: spark.range(n).select(F.lit(0).cast("long").alias("frame_id"), F.col("id").alias("point_id"), *[((F.col("id") * k % 3001) / 3001 + off).alias(c) for k, c in zip((7, 1009, 2003), "xyz")])
    more = spark.createDataFrame([(0, 9000, 6.0, 0.0, 0.0), (0, 9001, 20.0, 0.0, 0.0), (0, 9002, 1e3, 0.0, 0.0), (1, 5, 0.0, 0.0, 0.0), (2, 5, 8.0, 0.0, 0.0), (2, 6, 0.5, 0.0, 0.0)], at(1, 0.0).schema)
    source, target = at(3000, 0.01).union(more), at(3000, 0.0).union(spark.createDataFrame([(0, 9003, 21.0, 0.0, 0.0), (0, 9004, 19.0, 0.0, 0.0), (2, 5, 0.0, 0.0, 0.0)], more.schema))
    met = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda d2: met.add(1) or d2, "double")
    squared = joins.squared
    monkeypatch.setattr(joins, "squared", lambda a, b: counted(squared(a, b)))
    found = {(r["frame_id"], r["a"]): (r["b"], r["d2"]) for r in joins.nearest(source, target, 8.0).collect()}
    assert met.value < 1_000_000  # all pairs are 9 million
    there = [tuple(r) for r in target.collect()]
    for f, i, *xyz in [r for k, r in enumerate(map(tuple, source.collect())) if k % 97 == 0 or k >= 3000]:
        off = [(r[1], *[p - q for p, q in zip(xyz, r[2:])]) for r in there if r[0] == f]
        told = min(((x * x + y * y + z * z, b) for b, x, y, z in off), default=(64.0, 0))
        assert found.get((f, i)) == (None if told[0] >= 64 else told[::-1])
    assert found[0, 9001][0] == 9003 and (0, 9002) not in found and (2, 5) not in found and (2, 6) in found
    monkeypatch.undo()
    seen = []
    plain = joins.nearest
    monkeypatch.setattr(joins, "nearest", lambda *a: seen.append(a) or plain(*a))
    pose, error = graph.registered(at(300, 0.01), at(300, 0.0), 1.0, 1)
    assert len(seen) == 1 and error < 0.01


def test_pairs_of_a_dense_frame_are_not_shuffled(spark, monkeypatch):
    """Each task sends a link a point at most, and parts are the same; ids begin again in each frame."""
    pts = spark.range(600).select((F.col("id") % 2).alias("frame_id"), F.floor(F.col("id") / 2).cast("long").alias("point_id"), *[(F.col("id") * k % 601 / 601 + F.when(F.col("id") >= 500, 4.0).otherwise(0.0)).alias(c) for k, c in zip((7, 101, 203), "xyz")])
    far = spark.createDataFrame([(0, 900, 1.9, 0.5, 0.5), (0, 901, 30.0, 0.0, 0.0), (1, 900, 30.0, 0.0, 0.0)], pts.schema)
    pts = pts.union(far)
    seen, plain = [], moving.components
    monkeypatch.setattr(moving, "components", lambda e: seen.append(e.count()) or plain(e))
    rows = [tuple(r) for r in pts.collect()]
    told = {}
    for f in (0, 1):
        ids, xyz = [r[1] for r in rows if r[0] == f], np.array([r[2:] for r in rows if r[0] == f])
        near = ((xyz[:, None] - xyz[None]) ** 2).sum(2) < 4
        core = near.sum(1) > 40
        least = np.where(core, ids, 10**6)
        for _ in ids:
            least = np.where(core, np.where(near & core, least, 10**6).min(1), 10**6)
        border = np.where(near & core, least, 10**6).min(1)
        told |= {(f, i): c for i, c in zip(ids, np.where(core, least, border).tolist()) if c < 10**6}
    assert {(r[0], r[1]): r[2] for r in moving.dbscan(pts, 2.0, 40).collect()} == told and len(set(told.values())) > 1
    assert {(0, 900)} <= told.keys() and (0, 901) not in told
    normals = pts.select("frame_id", "point_id", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    region = {tuple(r) for r in keyframes.grown(pts, normals, 0, 2.0, 10.0).collect()}
    assert {(f, i) for f, i in region if i < 250} == {(f, i) for f in (0, 1) for i in range(250)} and not {(0, 901), (1, 900)} & region
    assert len(seen) == 2 and max(seen) < 10_000  # of 60,000 pairs and more
    monkeypatch.setattr(moving, "HELD", 1)
    assert moving.framed_components(joins.radius_pairs(pts, 2.0)).groupBy("frame_id").agg(F.count(F.lit(1))).count() == 2
