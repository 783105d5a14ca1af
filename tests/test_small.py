"""Edge rows of units of time, floors, known walls and inserted boxes."""

from pyspark.sql import functions as F

from lodegrid.operators import clock, ground, joins


def test_units_of_time(spark):
    rows = [(0, 1, None), (0, 2, 0.5), (0, 2, None), (0, 3, 99.0), (1, 5, 2e18), (1, 5, 3e18), (2, 1, None), (3, 0, 10.0)]
    out = clock.time_units(spark.createDataFrame(rows, "seq_id long, frame_id long, t double")).orderBy("seq_id").collect()
    assert [tuple(r) for r in out] == [(0, True, 1.0), (1, False, 1e-9), (3, False, 1.0)]
    assert clock.time_units(spark.createDataFrame([], "seq_id long, frame_id long, t double")).count() == 0


def test_floor(spark):
    rows = [(0, i, float(i), 0.0, 0.0) for i in range(4)] + [(0, 9, 1.0, 0.4, 0.5), (0, 10, 1.0, 0.6, 0.5), (1, 0, 0.0, 0.0, 9.0)]
    vox = spark.createDataFrame(rows, "frame_id long, k long, mx double, my double, mz double")
    out = {(r["frame_id"], r["k"]): r["is_ground"] for r in ground.floor_relabelled(vox, F.col("mz") == 0, 0.5).collect()}
    assert out == {(0, 0): True, (0, 1): True, (0, 2): True, (0, 3): True, (0, 9): True, (0, 10): False, (1, 0): False}
    assert ground.floor_relabelled(vox.limit(0), F.col("mz") == 0, 0.5).count() == 0


def test_known_walls(spark):
    vox = spark.createDataFrame([(0, 0.0, 0.0, 0.0, False), (0, 5.0, 0.0, 0.0, True), (0, 9.0, 0.0, 0.0, None), (0, None, 0.0, 0.0, False)], "frame_id long, mx double, my double, mz double, is_wall boolean")
    walls = spark.createDataFrame([(4, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (2, 0.2, 0.0, 0.0, 1.0, 1.0, 1.0)], "box_idx long, cx double, cy double, cz double, sx double, sy double, sz double")
    rows = lambda w: sorted(((r["mx"], r["wall_id"], r["is_wall"]) for r in joins.wall_labels(vox, w).collect()), key=repr)
    assert rows(walls) == sorted([(0.0, 2, True), (5.0, None, True), (9.0, None, False), (None, None, False)], key=repr)
    assert [r[1] for r in rows(walls.limit(0))] == [None] * 4
    assert joins.inserted(walls, 0.5).select("sx", "sy", "sz").first() == (2.0, 2.0, 2.0)
