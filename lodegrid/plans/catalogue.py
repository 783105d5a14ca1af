"""The registered queries of the spatial and time-series operators, and the same questions in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import clock, cloud, graph, ground, joins, moving
from ..operators.graph import checkpointed
from ..sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CELL3 = "floor(x * (1.0 / {r}))::BIGINT AS ix, floor(y * (1.0 / {r}))::BIGINT AS iy, floor(z * (1.0 / {r}))::BIGINT AS iz"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def cells(res: float) -> str:
    return CELL3.format(r=f"{res}::DOUBLE")


def u(c: str) -> str:
    return f"floor({c} * 1000000.0::DOUBLE + 0.5)::BIGINT"


def voxels_sql(res: float, source: str = "pts", name: str = "vox", more: str = "") -> str:
    return f"""{name} AS (SELECT frame_id, ix, iy, iz, count(*)::BIGINT AS n, sum({u('x')})::BIGINT AS ux, sum({u('y')})::BIGINT AS uy, sum({u('z')})::BIGINT AS uz,
  (sum({u('x')})::BIGINT)::DOUBLE / count(*) / 1000000.0::DOUBLE AS mx, (sum({u('y')})::BIGINT)::DOUBLE / count(*) / 1000000.0::DOUBLE AS my, (sum({u('z')})::BIGINT)::DOUBLE / count(*) / 1000000.0::DOUBLE AS mz{more}
  FROM (SELECT *, {cells(res)} FROM {source}) GROUP BY frame_id, ix, iy, iz)"""


IN_BOX = "abs(x - cx) <= sx / 2 AND abs(y - cy) <= sy / 2 AND abs(z - cz) <= sz / 2"
MEAN_IN_BOX = "abs(mx - cx) <= sx / 2 AND abs(my - cy) <= sy / 2 AND abs(mz - cz) <= sz / 2"
RANGE = "x * x + y * y + z * z > 25 AND x * x + y * y + z * z < 3600"


# Filters


@query(f"WITH {A.POINTS} SELECT frame_id, point_id, x, y, z FROM pts WHERE {RANGE}")
def range_filter(spark, d):
    """F1, F2"""
    return cloud.range_filter(cloud.attributes(A.points(spark, d)), 5.0, 60.0)


@query(f"WITH {A.POINTS} SELECT frame_id, count(*) AS n FROM pts WHERE NOT (x BETWEEN 10 AND 30 AND y BETWEEN 5 AND 25 AND z BETWEEN 2 AND 8) GROUP BY frame_id")
def crop_box(spark, d):
    """F5"""
    return cloud.crop(A.points(spark, d), (10, 5, 2), (30, 25, 8)).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.POINTS} SELECT frame_id, count(*) AS n FROM pts WHERE NOT (0.0 * x + -1.0 * y + 0.0 * z + 1.0 BETWEEN -20 AND -5 AND 1.0 * x + 0.0 * y + 0.0 * z + 2.0 BETWEEN 10 AND 30 AND 0.0 * x + 0.0 * y + 1.0 * z + 0.5 BETWEEN 2 AND 8) GROUP BY frame_id")
def crop_box_other_sensor(spark, d):
    """F6"""
    pose = (0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 0.5)
    return cloud.crop(A.points(spark, d), (-20, 10, 2), (-5, 30, 8), pose).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.POINTS} SELECT frame_id, point_id, t, row_number() OVER (PARTITION BY frame_id ORDER BY t, point_id)::INT AS place FROM pts WHERE {RANGE}")
def sort_by_time(spark, d):
    """F3"""
    return cloud.in_time_order(cloud.range_filter(A.points(spark, d), 5.0, 60.0)).select("frame_id", "point_id", "t", "place")


@query(f"WITH {A.POINTS} SELECT frame_id, count(*) AS n_points FROM pts WHERE {RANGE} GROUP BY frame_id HAVING count(*) < 1100")
def small_frames(spark, d):
    """F8"""
    return cloud.small_frames(cloud.range_filter(A.points(spark, d), 5.0, 60.0), 1100)


@query(f"WITH {A.POINTS} SELECT frame_id, count(*) AS n FROM pts WHERE abs((x - 20.0) / 16.0) < 0.5 AND abs((y - 20.0) / 20.0) < 0.5 AND abs((z - 5.0) / 8.0) < 0.5 GROUP BY frame_id")
def box_select(spark, d):
    """E3"""
    return cloud.selected(A.points(spark, d), (20, 20, 5), (16, 20, 8)).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.POINTS} SELECT frame_id, point_id FROM pts WHERE (x - 20.0) * (x - 20.0) + (y - 20.0) * (y - 20.0) + (z - 5.0) * (z - 5.0) < 36")
def radius_select(spark, d):
    """J11, E1, E4, E8"""
    return cloud.within_radius(cloud.with_cell(A.points(spark, d), 2.0), (20, 20, 5), 6.0, 2.0).select("frame_id", "point_id")


@query(f"WITH {A.POINTS} SELECT frame_id, count(*) AS n FROM pts WHERE NOT ((x - 20.0) * (x - 20.0) + (y - 20.0) * (y - 20.0) + (z - 5.0) * (z - 5.0) < 36) GROUP BY frame_id")
def delete_selected(spark, d):
    """E6"""
    pts = A.points(spark, d)
    return cloud.deleted(pts, cloud.within_radius(pts, (20, 20, 5), 6.0)).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))


# Sampling


HASH = "((((point_id * 48271 + {s} * 40692 + 11) % 2147483647) * 16807 + 7) % 2147483647)"


@query(f"WITH {A.POINTS} SELECT frame_id, point_id FROM pts WHERE {HASH.format(s=3)} < {int(0.2 * 2147483647)}")
def random_sample(spark, d):
    """K3, K5"""
    return cloud.sampled(A.points(spark, d), 0.2, 3).select("frame_id", "point_id")


@query(f"""WITH {A.POINTS}, c AS (SELECT *, {cells(4.0)} FROM pts), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, ix, iy, iz ORDER BY {HASH.format(s=1)}, point_id) AS k, count(*) OVER (PARTITION BY frame_id, ix, iy, iz) AS n FROM c)
SELECT frame_id, point_id FROM r WHERE k <= ceil(n * 0.3::DOUBLE)""")
def random_grid_sample(spark, d):
    """K2"""
    return cloud.per_cell_sample(A.points(spark, d), 4.0, 0.3, 1).select("frame_id", "point_id")


@query(f"WITH {A.POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY {HASH.format(s=2)}, point_id) AS k FROM pts) SELECT frame_id, point_id FROM r WHERE k <= 100")
def target_size_sample(spark, d):
    """K4"""
    return cloud.target_sample(A.points(spark, d), 100, 2).select("frame_id", "point_id")


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_id FROM r WHERE k <= 5")
def bounded_queue(spark, d):
    """K10"""
    return cloud.bounded_queue(A.table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 5)


# Aggregates


def products_sql(res: float) -> str:
    within = {c: f"({c} - i{c} * {res}::DOUBLE)" for c in "xyz"}
    return "".join(f", sum({u(f'({within[p[0]]} * {within[p[1]]})')})::BIGINT AS u{p}" for p in G.SIX)


@query(f"WITH {A.POINTS}, {voxels_sql(2.0, more=', max(intensity) AS max_intensity' + products_sql(2.0))} SELECT frame_id, ix, iy, iz, n, ux, uy, uz, {', '.join(cloud.PRODUCTS)}, max_intensity + 0.0::DOUBLE AS max_intensity FROM vox")
def voxel_aggregate(spark, d):
    """A1, A2: counts, sums of places and of their products"""
    return cloud.voxelise(A.points(spark, d), 2.0, spread=True).select("frame_id", *cloud.CELL, "n", "ux", "uy", "uz", *cloud.PRODUCTS, "max_intensity")


#: Points with a covariance of their own, out of their numbers.
CARRIED = "car AS (SELECT *, x / 10 AS cxx, z / 20 AS cxy, intensity AS cxz, y / 10 AS cyy, intensity / 2 AS cyz, z / 10 AS czz FROM pts)"


def carried(spark, d) -> DataFrame:
    c = F.col
    return A.points(spark, d).withColumns({"cxx": c("x") / 10, "cxy": c("z") / 20, "cxz": c("intensity"), "cyy": c("y") / 10, "cyz": c("intensity") / 2, "czz": c("z") / 10})


@query(f"WITH {A.POINTS}, {CARRIED}, {voxels_sql(2.0, source='car', more=''.join(f', sum({u(c)})::BIGINT AS {v}' for c, v in zip(cloud.COV, cloud.COV_SUMS)))} SELECT frame_id, ix, iy, iz, n, {', '.join(cloud.COV_SUMS)} FROM vox")
def voxel_covariances(spark, d):
    """A1: sums of the points' own covariances"""
    return cloud.voxelise(carried(spark, d), 2.0).select("frame_id", *cloud.CELL, "n", *cloud.COV_SUMS)


@query(f"WITH {A.POINTS}, {CARRIED}, {voxels_sql(2.0, source='car', more=''.join(f', sum({u(c)})::BIGINT AS {v}' for c, v in zip(cloud.COV, cloud.COV_SUMS)))} SELECT frame_id, point_id, n, {', '.join(f'floor({v}::DOUBLE / n / 1000000.0::DOUBLE * 1000 + 0.5)::BIGINT AS {c}' for c, v in zip(cloud.COV, cloud.COV_SUMS))} FROM (SELECT frame_id, point_id, {cells(2.0)} FROM pts) JOIN vox USING (frame_id, ix, iy, iz)")
def voxel_member_covariances(spark, d):
    """A3: every point with its voxel's covariance, in thousandths"""
    pts = carried(spark, d)
    members = cloud.members(pts.drop(*cloud.COV), cloud.voxelise(pts, 2.0).drop("max_intensity"), 2.0)
    return members.select("frame_id", "point_id", "n", *[F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c) for c in cloud.COV])


@query(f"WITH {A.POINTS}, {voxels_sql(4.0)} SELECT frame_id, mx, my, mz FROM vox")
def voxel_downsample(spark, d):
    """K1, A4, C21"""
    return cloud.voxelise(A.points(spark, d), 4.0).select("frame_id", "mx", "my", "mz")


@query(f"WITH {A.POINTS}, {voxels_sql(2.0)} SELECT frame_id, ix, iy, iz, n, ux, uy, uz FROM vox")
def merged_voxel_maps(spark, d):
    """A1: a finished map takes more points"""
    pts = A.points(spark, d)
    even = F.col("point_id") % 2 == 0
    return cloud.merged_voxels(cloud.voxelise(pts.where(even), 2.0), cloud.voxelise(pts.where(~even), 2.0)).select("frame_id", *cloud.CELL, "n", "ux", "uy", "uz")


@query(f"WITH {A.POINTS}, {voxels_sql(2.0)} SELECT frame_id, point_id, n FROM (SELECT *, {cells(2.0)} FROM pts) JOIN vox USING (frame_id, ix, iy, iz) WHERE n >= 2")
def voxel_members(spark, d):
    """A3, A9"""
    pts = A.points(spark, d)
    return cloud.members(pts, cloud.voxelise(pts, 2.0).where("n >= 2").drop("max_intensity"), 2.0).select("frame_id", "point_id", "n")


@query(f"WITH {A.POINTS}, l AS (SELECT *, unnest([0, 1, 2]) AS level FROM pts) SELECT frame_id, level::INT AS level, floor(x / (1.0::DOUBLE * pow(2.0::DOUBLE, level)))::BIGINT AS ix, floor(y / (1.0::DOUBLE * pow(2.0::DOUBLE, level)))::BIGINT AS iy, floor(z / (1.0::DOUBLE * pow(2.0::DOUBLE, level)))::BIGINT AS iz, count(*) AS n FROM l GROUP BY ALL")
def multires_voxels(spark, d):
    """G14"""
    return cloud.levels(A.points(spark, d), 1.0, 2, 3)


@query(f"WITH {A.POINTS}, b AS (SELECT frame_id, count(*) AS n, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM pts WHERE intensity > 0.05 GROUP BY frame_id) SELECT frame_id, n, (hx + lx) / 2 AS cx, (hy + ly) / 2 AS cy, (hz + lz) / 2 AS cz, hx - lx AS sx, hy - ly AS sy, hz - lz AS sz FROM b WHERE n >= 100 AND greatest(hx - lx, hy - ly, hz - lz) <= 60")
def extents(spark, d):
    """A5, A7, A8"""
    return cloud.extents(A.points(spark, d).where("intensity > 0.05"), "frame_id", 100, 0.0, 60.0)


@query(f"WITH {A.POINTS} SELECT frame_id, (min(x * 0.6::DOUBLE + y * 0.8::DOUBLE + z * 0.0::DOUBLE) + max(x * 0.6::DOUBLE + y * 0.8::DOUBLE + z * 0.0::DOUBLE)) / 2 AS c0, (min(x * -0.8::DOUBLE + y * 0.6::DOUBLE + z * 0.0::DOUBLE) + max(x * -0.8::DOUBLE + y * 0.6::DOUBLE + z * 0.0::DOUBLE)) / 2 AS c1, (min(x * 0.0::DOUBLE + y * 0.0::DOUBLE + z * 1.0::DOUBLE) + max(x * 0.0::DOUBLE + y * 0.0::DOUBLE + z * 1.0::DOUBLE)) / 2 AS c2, max(x * 0.6::DOUBLE + y * 0.8::DOUBLE + z * 0.0::DOUBLE) - min(x * 0.6::DOUBLE + y * 0.8::DOUBLE + z * 0.0::DOUBLE) AS s0, max(x * -0.8::DOUBLE + y * 0.6::DOUBLE + z * 0.0::DOUBLE) - min(x * -0.8::DOUBLE + y * 0.6::DOUBLE + z * 0.0::DOUBLE) AS s1, max(x * 0.0::DOUBLE + y * 0.0::DOUBLE + z * 1.0::DOUBLE) - min(x * 0.0::DOUBLE + y * 0.0::DOUBLE + z * 1.0::DOUBLE) AS s2 FROM pts GROUP BY frame_id")
def oriented_box(spark, d):
    """A10, of axes that are given"""
    return cloud.turned_extents(A.points(spark, d), "frame_id", ((0.6, 0.8, 0), (-0.8, 0.6, 0), (0, 0, 1)))


@query(f"WITH {A.POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY {HASH.format(s=0)}, point_id) AS k FROM pts), m AS (SELECT frame_id, list_sort(list(x * x + y * y + z * z)) AS l FROM r WHERE k <= 256 GROUP BY frame_id) SELECT frame_id, l[len(l) // 2 + 1] AS median_d2 FROM m")
def median_range(spark, d):
    """A16"""
    return cloud.median_range(A.points(spark, d))


@query(f"WITH {A.POINTS}, t AS (SELECT DISTINCT frame_id - 1 AS frame_id, ix, iy, iz FROM (SELECT *, {cells(2.0)} FROM pts)), s AS (SELECT frame_id, {cells(2.0)} FROM (SELECT frame_id, 1.0 * x + 0.0 * y + 0.0 * z + 0.5::DOUBLE AS x, 0.0 * x + 1.0 * y + 0.0 * z + 0.0 AS y, 0.0 * x + 0.0 * y + 1.0 * z + 0.0 AS z FROM pts)) SELECT s.frame_id, count(t.ix) AS n_hit, count(*) AS n FROM s LEFT JOIN t ON s.frame_id = t.frame_id AND s.ix = t.ix AND s.iy = t.iy AND s.iz = t.iz GROUP BY s.frame_id")
def overlap_ratio(spark, d):
    """A17"""
    pts = A.points(spark, d)
    return cloud.overlap_ratio(pts, pts, 2.0, (1, 0, 0, 0.5, 0, 1, 0, 0, 0, 0, 1, 0))


@query(f"WITH {A.POINTS}, r AS (SELECT frame_id, count(*) * 48 AS bytes FROM pts GROUP BY ROLLUP (frame_id)) SELECT frame_id, bytes, floor(bytes * 1000000 / (SELECT count(*) * 48 FROM pts))::BIGINT AS share FROM r")
def rollup_memory(spark, d):
    """A20, A21, A23"""
    return cloud.memory(A.points(spark, d))


@query()
def intensity_statistics(spark, d):
    """Means of doubles depend on their order, so no SQL is compared"""
    return cloud.statistics(A.points(spark, d), "intensity")


# Boxes

#: Footprints of boxes drawn out along their velocity: the heading (hx, hy) of those over 0.05 m/s, else the x-axis; half sides as
#: seen along and across it, times the root of 2; 2.5, 0.35 and 0.5 m for each m/s (5 at most) to the front, rear and sides.
INFLATED = f"""heading AS (SELECT *, sqrt(vx * vx + vy * vy) AS v FROM boxes), h AS (SELECT *, CASE WHEN v > 0.05::DOUBLE THEN least(v, 5.0::DOUBLE) ELSE 0 END AS w, CASE WHEN v > 0.05::DOUBLE THEN vx / v ELSE 1 END AS hx, CASE WHEN v > 0.05::DOUBLE THEN vy / v ELSE 0 END AS hy FROM heading),
inf AS (SELECT *, cx + hx * (0.5::DOUBLE * w * 2.15::DOUBLE) AS ex, cy + hy * (0.5::DOUBLE * w * 2.15::DOUBLE) AS ey, (abs(hx) * (sx / 2) + abs(hy) * (sy / 2)) * {2 ** 0.5!r}::DOUBLE + 0.5::DOUBLE * w * 2.85::DOUBLE AS ra, (abs(hy) * (sx / 2) + abs(hx) * (sy / 2)) * {2 ** 0.5!r}::DOUBLE + w * 0.5::DOUBLE AS rb FROM h)"""
ELLIPSE = "(abs(mz - cz) <= sz / 2 AND (((mx - ex) * hx + (my - ey) * hy) / ra) * (((mx - ex) * hx + (my - ey) * hy) / ra) + (((my - ey) * hx - (mx - ex) * hy) / rb) * (((my - ey) * hx - (mx - ex) * hy) / rb) <= 1)"


@query(f"WITH {A.POINTS}, {A.BOXES}, p AS (SELECT * FROM pts WHERE {RANGE}), h AS (SELECT frame_id, point_id, min(box_idx) AS b FROM p JOIN boxes ON {IN_BOX} GROUP BY ALL), s AS (SELECT p.frame_id, p.point_id, h.b, {cells(2.0)} FROM p LEFT JOIN h USING (frame_id, point_id)) SELECT frame_id, count(*) AS n_points, count(DISTINCT (ix, iy, iz)) AS n_voxels, count(b) AS n_removed FROM s GROUP BY frame_id")
def static_split(spark, d):
    """The flagship: F2, F9, J6, X8, A1, A23"""
    pts = cloud.range_filter(A.points(spark, d), 5.0, 60.0)
    flagged = cloud.with_cell(joins.split(pts, A.boxes(spark).drop("is_dynamic")), 2.0)
    per = flagged.groupBy("frame_id", *cloud.CELL).agg(F.count(F.lit(1)).alias("n"), F.count("box_idx").alias("r"))
    return per.groupBy("frame_id").agg(F.sum("n").alias("n_points"), F.count(F.lit(1)).alias("n_voxels"), F.sum("r").alias("n_removed"))


@query(f"WITH {A.POINTS}, {A.BOXES}, h AS (SELECT frame_id, point_id, min(box_idx) AS box_idx FROM pts JOIN boxes ON {IN_BOX} GROUP BY ALL) SELECT box_idx, count(*) AS n FROM h GROUP BY box_idx")
def box_removed_counts(spark, d):
    """A15"""
    return joins.first_box(A.points(spark, d), A.boxes(spark)).where("box_idx IS NOT NULL").groupBy("box_idx").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.POINTS}, {A.BOXES}, {INFLATED} SELECT frame_id, count(DISTINCT point_id) AS n FROM (SELECT *, x AS mx, y AS my, z AS mz FROM pts) JOIN inf ON {ELLIPSE} GROUP BY frame_id")
def inflated_box_split(spark, d):
    """F11, J5"""
    return joins.split(A.points(spark, d), A.boxes(spark).drop("is_dynamic"), True).where("is_dynamic").groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.POINTS}, {A.BOXES} SELECT frame_id, box_idx, count(*) AS n FROM pts JOIN boxes ON frame_id >= insert_frame AND frame_id < insert_frame + 5 AND {IN_BOX} GROUP BY frame_id, box_idx")
def box_ageing(spark, d):
    """X18, X19"""
    pts = A.points(spark, d)
    near = joins.around(pts, ("x", "y", "z"), joins.alive(A.boxes(spark), pts.select("frame_id")), ["frame_id"])
    hit = F.filter("_boxes", lambda b: G.in_box(G.vec("x", "y", "z"), *joins.box_of(b)))
    return near.select("frame_id", F.explode(F.transform(hit, lambda b: b["box_idx"])).alias("box_idx")).groupBy("frame_id", "box_idx").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.POINTS}, {A.BOXES} SELECT frame_id, box_idx, count(*) AS n FROM pts JOIN boxes ON abs(x - cx) <= (sx + 1.5::DOUBLE) / 2 AND abs(y - cy) <= (sy + 1.5::DOUBLE) / 2 AND abs(z - cz) <= (sz + 1.5::DOUBLE) / 2 GROUP BY frame_id, box_idx")
def inserted_boxes(spark, d):
    """Points in boxes that were made larger when they were inserted"""
    near = joins.around(A.points(spark, d), ("x", "y", "z"), joins.inserted(A.boxes(spark), 0.75))
    hit = F.filter("_boxes", lambda b: G.in_box(G.vec("x", "y", "z"), *joins.box_of(b)))
    return near.select("frame_id", F.explode(F.transform(hit, lambda b: b["box_idx"])).alias("box_idx")).groupBy("frame_id", "box_idx").agg(F.count(F.lit(1)).alias("n"))


#: Boxes as row_boxes has them.
ROW_BOXES = "fb AS (SELECT l_orderkey AS frame_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS box_idx, l_quantity AS cx, l_extendedprice / 2000 AS cy, l_discount * 100 AS cz, 4.0::DOUBLE + l_partkey % 5 AS sx, 4.0::DOUBLE + l_suppkey % 7 AS sy, 3.0::DOUBLE AS sz FROM lineitem)"


def row_boxes(spark, d) -> DataFrame:
    """Every order line as a box: a frame is an order and a hundred orders a sequence, so both grow with the table."""
    from pyspark.sql import Window

    rows = A.table(spark, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(*[c for c in rows.columns if c != "l_orderkey"])
    return rows.select(F.floor(F.col("l_orderkey") / 100).cast("long").alias("seq_id"), F.col("l_orderkey").alias("frame_id"), F.row_number().over(order).cast("long").alias("box_idx"), F.col("l_quantity").alias("cx"), (F.col("l_extendedprice") / 2000).alias("cy"), (F.col("l_discount") * 100).alias("cz"), (4.0 + F.col("l_partkey") % 5).alias("sx"), (4.0 + F.col("l_suppkey") % 7).alias("sy"), F.lit(3.0).alias("sz"))


SIDE = "greatest(0.0::DOUBLE, least(a.c{c} + a.s{c} / 2, b.c{c} + b.s{c} / 2) - greatest(a.c{c} - a.s{c} / 2, b.c{c} - b.s{c} / 2))"
OVERLAP = f"{SIDE.format(c='x')} * {SIDE.format(c='y')} * {SIDE.format(c='z')} / least(a.sx * a.sy * a.sz, b.sx * b.sy * b.sz)"


OVERLAP_SQL = f"WITH {ROW_BOXES} SELECT a.frame_id, a.box_idx AS i, b.box_idx AS j, {OVERLAP} AS overlap FROM fb a JOIN fb b ON a.frame_id = b.frame_id AND a.box_idx < b.box_idx WHERE {OVERLAP} > {{least}}"


@query(OVERLAP_SQL.format(least=0.6))
def overlap_pairs(spark, d):
    """Every order line is a box"""
    return moving.overlapping(row_boxes(spark, d), 0.6)


@query(OVERLAP_SQL.format(least=0.0))
def overlap_pairs_all(spark, d):
    """All pairs that share any volume"""
    return moving.overlapping(row_boxes(spark, d), 0.0)


@query()
def suppressed_boxes(spark, d):
    """C11: a fold, tested against brute force"""
    return moving.suppressed(row_boxes(spark, d)).select("frame_id", "box_idx")


@query()
def tracks(spark, d):
    """A fold over frames, tested against brute force"""
    return moving.tracked(row_boxes(spark, d))


# Neighbours


@query(f"WITH {A.VECTORS} SELECT a.frame_id, a.point_id AS a, b.point_id AS b FROM vec a JOIN vec b ON a.frame_id = b.frame_id AND a.point_id < b.point_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 64")
def radius_join(spark, d):
    """J8, J9, J11, J12"""
    return joins.radius_pairs(A.vectors(spark, d), 8.0).select("frame_id", "a", "b")


D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


@query(f"WITH {A.VECTORS}, r AS (SELECT a.frame_id, a.point_id, b.point_id AS nbr_id, row_number() OVER (PARTITION BY a.frame_id, a.point_id ORDER BY {D2}, b.point_id)::INT AS rank FROM vec a JOIN vec b ON a.frame_id = b.frame_id) SELECT frame_id, point_id, rank, nbr_id FROM r WHERE rank <= 5")
def knn(spark, d):
    """N1, N2, N3"""
    return joins.knn(A.vectors(spark, d), 5, 8.0).select("frame_id", "point_id", "rank", "nbr_id")


@query(f"WITH {A.VECTORS}, r AS (SELECT a.frame_id, a.point_id, {D2} AS d2, row_number() OVER (PARTITION BY a.frame_id, a.point_id ORDER BY {D2}, b.point_id) AS rank FROM vec a JOIN vec b ON a.frame_id = b.frame_id), m AS (SELECT frame_id, point_id, avg(sqrt(d2)) AS mean_d FROM r WHERE rank BETWEEN 2 AND 5 GROUP BY ALL), l AS (SELECT frame_id, avg(mean_d) + stddev_pop(mean_d) AS most FROM m GROUP BY frame_id) SELECT frame_id, point_id FROM m JOIN l USING (frame_id) WHERE mean_d <= most")
def outlier_removal(spark, d):
    """F7, E5"""
    pts = A.vectors(spark, d)
    return joins.outliers_removed(pts, joins.knn(pts, 5, 8.0)).select("frame_id", "point_id")


def _radius_sql(start: float, least: float, most: float, flat: float) -> str:
    """Seeds go on in a recursion; a seed's radius is the last one that it took."""
    d = {c: f"(p.{c} - s.{c})" for c in "xyz"}
    near = f"{d['x']} * {d['x']} + {d['y']} * {d['y']} + {d['z']} * {d['z']} < trial * trial"
    sums = ", ".join([f"sum({u(d[c])})::BIGINT AS m{c}" for c in "xyz"] + [f"sum({u(f'({d[k[0]]} * {d[k[1]]})')})::BIGINT AS u{k}" for k in G.SIX])
    cov = ", ".join(f"u{k}::DOUBLE / n / 1000000.0::DOUBLE - (m{k[0]}::DOUBLE / n / 1000000.0::DOUBLE) * (m{k[1]}::DOUBLE / n / 1000000.0::DOUBLE) AS {k}" for k in G.SIX)

    def flatness(table: str) -> str:
        """table with n and ratio of each seed's trial, by the eigenvalues' closed form."""
        met = f"SELECT s.frame_id, s.seed, s.x, s.y, s.z, s.radius, s.trial, s.step, count(*) AS n, {sums} FROM {table} s JOIN vec p ON p.frame_id = s.frame_id AND {near} GROUP BY ALL"
        spread = f"SELECT * EXCLUDE (mx, my, mz, uxx, uxy, uxz, uyy, uyz, uzz), {cov} FROM ({met})"
        q = f"SELECT *, (xx + yy + zz) / 3 AS q, sqrt(((xx - (xx + yy + zz) / 3) ** 2 + (yy - (xx + yy + zz) / 3) ** 2 + (zz - (xx + yy + zz) / 3) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS w FROM ({spread})"
        det = f"SELECT *, CASE WHEN w > 0 THEN ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (w * w * w) ELSE 0 END AS det FROM ({q})"
        low = f"SELECT *, q + 2 * w * cos(acos(greatest(-1, least(1, det / 2))) / 3 + {2 * 3.141592653589793 / 3!r}::DOUBLE) AS lo, q + 2 * w * cos(acos(greatest(-1, least(1, det / 2))) / 3) AS hi FROM ({det})"
        return f"SELECT frame_id, seed, x, y, z, radius, trial, step, n, CASE WHEN hi > 0 THEN lo / hi END AS ratio FROM ({low})"

    next_trial = f"CASE WHEN ratio > {flat}::DOUBLE THEN trial * 0.8::DOUBLE ELSE trial * 1.1::DOUBLE END"
    tried = f"(SELECT frame_id, seed, x, y, z, trial AS radius, {next_trial} AS trial, step + 1 AS step FROM r WHERE step < 10 AND {next_trial} BETWEEN {least}::DOUBLE AND {most}::DOUBLE)"
    first = f"(SELECT frame_id, point_id AS seed, x, y, z, {start}::DOUBLE AS radius, {start}::DOUBLE AS trial, 0 AS step FROM vec)"
    return f"""WITH RECURSIVE {A.VECTORS}, r AS ({flatness(first)} UNION ALL SELECT * FROM ({flatness(tried)}) WHERE n >= 10 AND NOT coalesce(trial > {start}::DOUBLE AND ratio > {flat}::DOUBLE, false))
SELECT frame_id, seed, floor(arg_max(trial, step) * 1000000 + 0.5)::BIGINT AS radius FROM r GROUP BY frame_id, seed"""


@query(_radius_sql(20.0, 5.0, 40.0, 0.2))
def adaptive_radius(spark, d):
    """Around every point, in millionths"""
    from ..operators import radius

    pts = A.vectors(spark, d)
    found = radius.settled_radii(pts.withColumnRenamed("point_id", "seed"), pts, 20.0, 5.0, 40.0, 0.2)
    return found.select("frame_id", "seed", F.floor(F.col("radius") * 1000000 + 0.5).cast("long").alias("radius"))


@query()
def point_normals(spark, d):
    """Tested against numpy"""
    pts = A.vectors(spark, d)
    return ground.normals(pts, joins.knn(pts, 8, 8.0))


@query(f"WITH {A.VECTORS}, e AS (SELECT a.frame_id, a.point_id AS a, b.point_id AS b FROM vec a JOIN vec b ON a.frame_id = b.frame_id AND a.point_id <> b.point_id WHERE {D2} < 64), core AS (SELECT frame_id, a FROM e GROUP BY ALL HAVING count(*) >= 3), links AS (SELECT e.a, e.b FROM e JOIN core c USING (frame_id, a) JOIN core k ON k.a = e.b), reach AS (WITH RECURSIVE w(a, b) AS (SELECT a, a FROM core UNION SELECT w.a, l.b FROM w JOIN links l ON l.a = w.b) SELECT a, min(b) AS cluster FROM w GROUP BY a) SELECT frame_id, a AS point_id, cluster FROM core JOIN reach USING (a) UNION ALL SELECT e.frame_id, e.a AS point_id, min(r.cluster) AS cluster FROM e JOIN reach r ON r.a = e.b WHERE e.a NOT IN (SELECT a FROM core) GROUP BY e.frame_id, e.a")
def dbscan(spark, d):
    """C1"""
    return moving.dbscan(A.vectors(spark, d), 8.0, 3)


def renumbered(spark, d) -> DataFrame:
    """Vectors whose ids begin again in every frame."""
    from pyspark.sql import Window

    return A.vectors(spark, d).withColumn("point_id", F.row_number().over(Window.partitionBy("frame_id").orderBy("point_id")).cast("long"))


@query(f"WITH {A.VECTORS}, vn AS (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY point_id) AS point_id, x, y, z FROM vec), e AS (SELECT a.frame_id, a.point_id AS a, b.point_id AS b FROM vn a JOIN vn b ON a.frame_id = b.frame_id AND a.point_id <> b.point_id WHERE {D2} < 64), core AS (SELECT frame_id, a FROM e GROUP BY ALL HAVING count(*) >= 3), links AS (SELECT e.frame_id, e.a, e.b FROM e JOIN core c USING (frame_id, a) JOIN core k ON k.frame_id = e.frame_id AND k.a = e.b), reach AS (WITH RECURSIVE w(f, a, b) AS (SELECT frame_id, a, a FROM core UNION SELECT w.f, w.a, l.b FROM w JOIN links l ON l.frame_id = w.f AND l.a = w.b) SELECT f, a, min(b) AS cluster FROM w GROUP BY f, a) SELECT frame_id, core.a AS point_id, cluster FROM core JOIN reach ON f = frame_id AND reach.a = core.a UNION ALL SELECT e.frame_id, e.a AS point_id, min(r.cluster) AS cluster FROM e JOIN reach r ON r.f = e.frame_id AND r.a = e.b WHERE (e.frame_id, e.a) NOT IN (SELECT (frame_id, a) FROM core) GROUP BY e.frame_id, e.a")
def dbscan_by_frame(spark, d):
    """C1 where frames use the same ids"""
    return moving.dbscan(renumbered(spark, d), 8.0, 3)


@query(f"WITH {A.VECTORS}, e AS (SELECT a.point_id AS a, b.point_id AS b FROM vec a JOIN vec b ON a.frame_id = b.frame_id WHERE {D2} < 36), reach AS (WITH RECURSIVE w(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON e.a = w.b) SELECT a AS point_id, min(b) AS root FROM w GROUP BY a), s AS (SELECT frame_id, root, count(*) AS n FROM vec JOIN reach USING (point_id) GROUP BY ALL) SELECT frame_id, root, n FROM s QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, root) = 1")
def largest_component(spark, d):
    """C2"""
    return moving.largest_part(A.vectors(spark, d), 6.0)


# Voxels over time


@query(f"""WITH {A.POINTS}, {voxels_sql(4.0)}, h AS (SELECT frame_id, ix AS hx, iy AS hy, iz AS hz, mx + 0.5::DOUBLE AS x, my + 0.0::DOUBLE AS y, mz + 0.0::DOUBLE AS z FROM vox), k AS (SELECT *, {cells(4.0)} FROM h),
m AS (SELECT k.*, q.ix AS qx, q.iy AS qy, q.iz AS qz, (q.ix = k.ix AND q.iy = k.iy AND q.iz = k.iz) AS same, (k.x - q.mx) * (k.x - q.mx) + (k.y - q.my) * (k.y - q.my) + (k.z - q.mz) * (k.z - q.mz) AS d2 FROM k JOIN vox q ON q.frame_id + 1 = k.frame_id AND q.ix BETWEEN k.ix - 1 AND k.ix + 1 AND q.iy BETWEEN k.iy - 1 AND k.iy + 1 AND q.iz BETWEEN k.iz - 1 AND k.iz + 1),
b AS (SELECT * FROM m WHERE same OR d2 < 64 QUALIFY row_number() OVER (PARTITION BY frame_id, hx, hy, hz ORDER BY NOT same, CASE WHEN same THEN 0 ELSE d2 END, qx, qy, qz) = 1)
SELECT h.frame_id, h.hx AS ix, h.hy AS iy, h.hz AS iz, CASE WHEN b.hx IS NULL THEN 'none' WHEN b.same THEN 'same' ELSE 'near' END AS kind, b.qx AS prev_ix, b.qy AS prev_iy, b.qz AS prev_iz FROM h LEFT JOIN b USING (frame_id, hx, hy, hz)""")
def prev_voxel_match(spark, d):
    """J1, J2"""
    vox = cloud.voxelise(A.points(spark, d), 4.0)
    return joins.moved_cell_match(vox, vox, 4.0, (0.5, 0, 0))


def flagged(spark, d, res: float = 4.0) -> DataFrame:
    """Voxels that a rule on their cell calls moving or wall."""
    vox = cloud.voxelise(A.points(spark, d), res)
    return vox.withColumns({"is_dynamic": (F.col("ix") * 7 + F.col("iy") * 5 + F.col("iz") * 3 + F.col("frame_id")) % 4 == 0, "is_wall": F.col("ix") % 6 == 0, "score": (F.col("n") % 5) / 10.0})


FLAGGED = f"{voxels_sql(4.0)}, fl AS (SELECT *, (ix * 7 + iy * 5 + iz * 3 + frame_id) % 4 = 0 AS is_dynamic, ix % 6 = 0 AS is_wall, (n % 5) / 10.0::DOUBLE AS score FROM vox)"


@query(f"WITH {A.POINTS}, {FLAGGED} SELECT a.frame_id, a.ix, a.iy, a.iz, count(b.ix) AS n_there, (count(*) FILTER (WHERE NOT b.is_dynamic))::BIGINT AS n_static FROM fl a LEFT JOIN fl b ON a.ix = b.ix AND a.iy = b.iy AND a.iz = b.iz AND b.frame_id BETWEEN a.frame_id - 5 AND a.frame_id - 1 GROUP BY ALL")
def history_ratio(spark, d):
    """J3, W12"""
    return joins.history_hits(flagged(spark, d), 5).select("frame_id", *cloud.CELL, "n_there", F.col("n_static").cast("long").alias("n_static"))


@query(f"WITH {A.POINTS}, {voxels_sql(4.0)} SELECT a.frame_id, a.ix, a.iy, a.iz, b.ix AS nx, b.iy AS ny, b.iz AS nz FROM vox a JOIN vox b ON a.frame_id = b.frame_id AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 WHERE (a.ix, a.iy, a.iz) <> (b.ix, b.iy, b.iz)")
def voxel_adjacency(spark, d):
    """J4"""
    return joins.adjacency(cloud.voxelise(A.points(spark, d), 4.0))


@query(f"WITH {A.POINTS}, {voxels_sql(4.0)} SELECT a.frame_id, a.ix, a.iy, a.iz, count(*) AS n FROM vox a JOIN vox b ON a.frame_id = b.frame_id AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 WHERE (a.ix, a.iy, a.iz) <> (b.ix, b.iy, b.iz) GROUP BY ALL")
def voxel_adjacency_all(spark, d):
    """How many neighbours each voxel has"""
    return joins.adjacency(cloud.voxelise(A.points(spark, d), 4.0)).groupBy("frame_id", *cloud.CELL).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.POINTS}, {FLAGGED}, c AS (SELECT a.frame_id, a.ix, a.iy, a.iz, count(*) AS k FROM fl a JOIN fl b ON a.frame_id = b.frame_id AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 AND (a.ix, a.iy, a.iz) <> (b.ix, b.iy, b.iz) AND b.is_dynamic GROUP BY ALL) SELECT fl.frame_id, fl.ix, fl.iy, fl.iz, fl.is_dynamic OR coalesce(NOT is_wall AND k >= 1 AND score + 0.1::DOUBLE * k > 0.4::DOUBLE * 1.0, false) AS is_dynamic FROM fl LEFT JOIN c USING (frame_id, ix, iy, iz)")
def neighbour_propagation(spark, d):
    """X6"""
    return moving.spread_to_neighbours(flagged(spark, d)).select("frame_id", *cloud.CELL, "is_dynamic")


@query(f"WITH {A.POINTS}, {FLAGGED}, {A.BOXES} SELECT box_idx, count(*) AS n, (count(*) FILTER (WHERE fl.is_dynamic))::BIGINT AS n_dynamic FROM fl JOIN boxes ON {MEAN_IN_BOX} GROUP BY box_idx")
def cluster_ratio(spark, d):
    """A14"""
    return moving.box_counts(flagged(spark, d), A.boxes(spark))


@query(f"""WITH {A.POINTS}, {FLAGGED}, {A.BOXES}, {INFLATED}, r AS (SELECT box_idx, count(*) FILTER (WHERE fl.is_dynamic) > 0.3::DOUBLE * count(*) AS moves FROM fl JOIN boxes ON {MEAN_IN_BOX} GROUP BY box_idx),
base AS (SELECT frame_id, ix, iy, iz, bool_or(r.moves) AS moves FROM fl JOIN boxes ON {MEAN_IN_BOX} JOIN r USING (box_idx) GROUP BY ALL),
i AS (SELECT DISTINCT frame_id, ix, iy, iz FROM fl JOIN inf ON {ELLIPSE} JOIN r ON r.box_idx = inf.box_idx AND r.moves)
SELECT fl.frame_id, fl.ix, fl.iy, fl.iz, CASE WHEN is_wall THEN is_dynamic ELSE coalesce(base.moves, i.frame_id IS NOT NULL) END AS is_dynamic FROM fl LEFT JOIN base USING (frame_id, ix, iy, iz) LEFT JOIN i USING (frame_id, ix, iy, iz)""")
def cluster_propagation(spark, d):
    """Boxes that a voxel is in decide, then what moving ones are drawn out to; other voxels become static"""
    return moving.spread_to_boxes(flagged(spark, d), A.boxes(spark)).select("frame_id", *cloud.CELL, "is_dynamic")


@query(f"""WITH {A.POINTS}, {FLAGGED}, {A.BOXES}, {INFLATED}, ib AS (SELECT frame_id, ix, iy, iz, bool_or(inf.is_dynamic) AS in_box FROM fl JOIN inf ON {MEAN_IN_BOX} OR (inf.is_dynamic AND {ELLIPSE}) GROUP BY ALL),
hs AS (SELECT a.frame_id, a.ix, a.iy, a.iz, count(*) FILTER (WHERE NOT b.is_dynamic) AS n_static FROM fl a LEFT JOIN fl b ON a.ix = b.ix AND a.iy = b.iy AND a.iz = b.iz AND b.frame_id BETWEEN a.frame_id - 4 AND a.frame_id - 1 GROUP BY ALL),
p AS (SELECT a.frame_id, a.ix, a.iy, a.iz, a.n, coalesce(ib.in_box, false) AS box, hs.n_static, b.is_dynamic AS prev, (a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my) + (a.mz - b.mz) * (a.mz - b.mz) AS s2 FROM fl a JOIN hs USING (frame_id, ix, iy, iz) LEFT JOIN ib USING (frame_id, ix, iy, iz) LEFT JOIN fl b ON b.frame_id + 1 = a.frame_id AND a.ix = b.ix AND a.iy = b.iy AND a.iz = b.iz),
s AS (SELECT *, CASE WHEN n < 3 THEN 0.0::DOUBLE WHEN s2 IS NULL THEN CASE WHEN box THEN 0.4::DOUBLE + 1 ELSE 0 END ELSE CASE WHEN box THEN 0.2::DOUBLE ELSE -0.2::DOUBLE / 2 END + 1.0::DOUBLE * greatest(0.0::DOUBLE, sqrt(s2) - 0.1::DOUBLE) / 4.0::DOUBLE - 0.1::DOUBLE * n_static / 4 END AS sc FROM p)
SELECT frame_id, ix, iy, iz, floor(sc * 1000000 + 0.5)::BIGINT AS score, n >= 3 AND (s2 IS NOT NULL OR box) AND sc > 0.4::DOUBLE * 1.0 * CASE WHEN box THEN 0.55::DOUBLE WHEN coalesce(prev, false) THEN 0.7::DOUBLE ELSE 3.0::DOUBLE END AS is_dynamic FROM s""")
def voxel_scores(spark, d):
    """The score of one step, with what the frame before says about its voxels given"""
    vox = flagged(spark, d)
    rows = moving.in_dynamic_box(joins.history_hits(vox, 4), A.boxes(spark))
    before = vox.select((F.col("frame_id") + 1).alias("frame_id"), *cloud.CELL, *[F.col(m).alias(f"p{m}") for m in ("mx", "my", "mz")], F.col("is_dynamic").alias("prev_dynamic"))
    rows = rows.join(before, ["frame_id", *cloud.CELL], "left")
    shift2 = sum(((F.col(m) - F.col(f"p{m}")) * (F.col(m) - F.col(f"p{m}")) for m in ("my", "mz")), (F.col("mx") - F.col("pmx")) * (F.col("mx") - F.col("pmx")))
    out = moving.scored(rows.withColumn("shift2", shift2), 4.0, 3, 4)
    return out.select("frame_id", *cloud.CELL, F.floor(F.col("score") * 1000000 + 0.5).cast("long").alias("score"), "is_dynamic")


@query("""WITH r AS (SELECT user_id AS track_id, event_id AS frame_id, event_type IN ('click', 'view') AS is_dynamic, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
g AS (SELECT *, sum(CASE WHEN k > 1 AND lag_d = is_dynamic AND k - lag_k <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY k) AS island FROM (SELECT *, lag(is_dynamic) OVER w AS lag_d, lag(k) OVER w AS lag_k FROM r WINDOW w AS (PARTITION BY track_id ORDER BY k))),
n AS (SELECT *, row_number() OVER (PARTITION BY track_id, island ORDER BY k) AS run FROM g), f AS (SELECT track_id, min(k) AS at, arg_min(CASE WHEN is_dynamic THEN 'dynamic' ELSE 'static' END, k) AS st FROM n WHERE run >= 3 GROUP BY track_id)
SELECT n.track_id, n.k AS frame_id, n.is_dynamic, n.run::INT AS run, CASE WHEN f.at <= n.k THEN f.st END AS locked FROM n LEFT JOIN f USING (track_id)""")
def track_hysteresis(spark, d):
    """X12"""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = A.table(spark, d, "events").select(F.col("user_id").alias("track_id"), k.cast("long").alias("frame_id"), F.col("event_type").isin("click", "view").alias("is_dynamic"))
    return moving.hysteresis(rows, 3)


@query(f"WITH {A.POINTS}, {FLAGGED}, {A.BOXES}, h AS (SELECT frame_id, ix, iy, iz, min(box_idx) AS wall_id FROM fl JOIN boxes ON {MEAN_IN_BOX} GROUP BY ALL) SELECT frame_id, ix, iy, iz, wall_id, is_wall OR wall_id IS NOT NULL AS is_wall FROM fl LEFT JOIN h USING (frame_id, ix, iy, iz)")
def wall_labels(spark, d):
    """X17"""
    return joins.wall_labels(flagged(spark, d), A.boxes(spark).drop("is_dynamic")).select("frame_id", *cloud.CELL, "wall_id", "is_wall")


# Ground and planes


@query()
def polar_cells(spark, d):
    """A6"""
    vox = cloud.voxelise(A.points(spark, d), 2.0).withColumns({"mx": F.col("mx") - 25, "my": F.col("my") - 25})
    return ground.cell_statistics(ground.polar_cells(vox, 36, 4.0), 3, 4.0, 2.0)


@query()
def ground_labels(spark, d):
    """W9, C8"""
    vox = cloud.voxelise(A.points(spark, d), 2.0).withColumns({"mx": F.col("mx") - 25, "my": F.col("my") - 25}).drop("is_ground")
    cells_ = ground.polar_cells(vox, 36, 4.0)
    grown = ground.propagated(ground.cell_statistics(cells_, 3, 8.0, 2.0), 1, 4, 0.8, 4.0, 2.0)
    return ground.ground_labels(cells_, grown).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_ground").alias("n_ground"))


@query(f"WITH {A.POINTS}, {voxels_sql(4.0)} SELECT frame_id, ix, iy, iz, mz < min(mz) OVER (PARTITION BY frame_id) + 3.0::DOUBLE AS is_ground FROM vox")
def lowest_ground(spark, d):
    """A5: the plain fallback"""
    return ground.lowest_ground(cloud.voxelise(A.points(spark, d), 4.0).drop("is_ground"), 3.0).select("frame_id", *cloud.CELL, "is_ground")


@query(f"WITH {A.POINTS}, {voxels_sql(4.0)}, b AS (SELECT frame_id, min(mx) AS lx, max(mx) AS hx, min(my) AS ly, max(my) AS hy, min(mz) AS lz, max(mz) AS hz FROM vox WHERE abs(mz - 2.0) <= 0.75 AND mx < 40 GROUP BY frame_id) SELECT frame_id, ix, iy, iz, coalesce(abs(mx - (hx + lx) / 2) <= (hx - lx + 1.0) / 2 AND abs(my - (hy + ly) / 2) <= (hy - ly + 1.0) / 2 AND abs(mz - (hz + lz) / 2) <= (hz - lz + 1.0) / 2, false) AS is_ground FROM vox LEFT JOIN b USING (frame_id)")
def floor_relabelled(spark, d):
    """The inliers are those near a level plane"""
    vox = cloud.voxelise(A.points(spark, d), 4.0).drop("is_ground")
    return ground.floor_relabelled(vox, (F.abs(F.col("mz") - 2.0) <= 0.75) & (F.col("mx") < 40), 0.5).select("frame_id", *cloud.CELL, "is_ground")


@query()
def plane_hypotheses(spark, d):
    """C5, F13, and C3 with a fixed number of draws; tested by counting"""
    pts = A.vectors(spark, d)
    return ground.best_planes(pts, ground.hypotheses(pts, 20), 3.0, 5)


@query()
def floor_search(spark, d):
    """Draws until they suffice, floors only; tested by counting and on hand-made frames"""
    return ground.searched_planes(A.points(spark, d), 0.5, 30, most=256, is_allowed=lambda n: G.is_floor(n, 15.0))


@query()
def wall_search(spark, d):
    """The same for walls"""
    return ground.searched_planes(A.points(spark, d), 0.5, 30, most=256, is_allowed=lambda n: G.is_wall(n, 5.0))


@query()
def plane_extraction(spark, d):
    """C4"""
    return ground.planes_one_by_one(A.vectors(spark, d), 10, 3.0, 5, 2)


@query()
def plane_refit(spark, d):
    """A11"""
    pts = A.vectors(spark, d)
    return ground.refitted(pts, ground.best_planes(pts, ground.hypotheses(pts, 20), 3.0, 5), 3.0).select("frame_id", "n", "nx", "ny", "nz", "d")


@query(f"WITH {A.POINTS}, {voxels_sql(4.0)}, w AS (SELECT frame_id, 20.0::DOUBLE + frame_id % 20 AS wx, 25.0::DOUBLE AS wy, 10.0::DOUBLE + frame_id % 7 AS wl FROM (SELECT DISTINCT frame_id FROM pts)) SELECT frame_id, ix, iy, iz, mx > wx AND my BETWEEN wy - wl / 2 AND wy + wl / 2 AS is_outlier FROM vox JOIN w USING (frame_id)")
def behind_walls(spark, d):
    """C10"""
    pts = A.points(spark, d)
    walls = pts.select("frame_id").distinct().select("frame_id", (20.0 + F.col("frame_id") % 20).alias("wx"), F.lit(25.0).alias("wy"), (10.0 + F.col("frame_id") % 7).alias("wl"))
    return ground.behind_walls(cloud.voxelise(pts, 4.0).drop("is_outlier"), walls).select("frame_id", *cloud.CELL, "is_outlier")


# Time


@query(f"WITH {A.SAMPLES}, b AS (SELECT *, max(us) OVER (PARTITION BY seq_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM imu) SELECT seq_id, id, coalesce(us >= before, true) AND us >= 0 AS accepted, coalesce(us >= before, true) AND coalesce(us - before > 100000, false) AS has_gap FROM b")
def imu_accept(spark, d):
    """T1, T2"""
    return clock.accepted(A.samples(spark, d)).select("seq_id", "id", "accepted", "has_gap")


@query(f"WITH {A.SAMPLES} SELECT seq_id, id, coalesce(us < lag(us) OVER w, false) AS rewinds, coalesce(us - lag(us) OVER w > 100000, false) AS has_gap FROM imu WINDOW w AS (PARTITION BY seq_id ORDER BY id)")
def stream_audit(spark, d):
    """T9, T10"""
    return clock.audited(A.samples(spark, d)).select("seq_id", "id", "rewinds", "has_gap")


@query(f"WITH {A.SAMPLES}, {A.SCANS} SELECT s.seq_id, s.id, i.us AS last_us, coalesce(abs(s.us - i.us) > 1000000, false) AS is_skewed FROM scan s ASOF LEFT JOIN imu i ON s.seq_id = i.seq_id AND s.us >= i.us")
def scan_skew(spark, d):
    """T8, T10"""
    return clock.skewed(A.scans(spark, d), A.samples(spark, d)).select("seq_id", "id", "last_us", "is_skewed")


@query("WITH v AS (SELECT user_id, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY user_id) SELECT user_id, len(l)::BIGINT AS n, l[len(l) // 2 + 1] AS median FROM v")
def upper_median_value(spark, d):
    """T7"""
    return clock.upper_median(A.table(spark, d, "events"), "user_id", F.col("value"))


@query(f"WITH {A.SCANS}, g AS (SELECT seq_id, us - lag(us) OVER w AS gap, row_number() OVER w AS k FROM scan WINDOW w AS (PARTITION BY seq_id ORDER BY id)), l AS (SELECT seq_id, list_sort(list(gap)) AS l FROM g WHERE gap IS NOT NULL AND k <= 1001 GROUP BY seq_id) SELECT seq_id, len(l)::BIGINT AS n, l[len(l) // 2 + 1] AS median, CASE WHEN l[len(l) // 2 + 1] BETWEEN 10000 AND 100000000000 THEN l[len(l) // 2 + 1] ELSE -1 END AS duration FROM l")
def scan_duration(spark, d):
    """T7"""
    return clock.scan_duration(A.scans(spark, d), high=100_000_000_000)


@query(f"WITH {A.POINTS} SELECT frame_id, point_id, 0.1::DOUBLE * (row_number() OVER (PARTITION BY frame_id ORDER BY point_id) - 1) / count(*) OVER (PARTITION BY frame_id) AS t FROM pts")
def pseudo_times(spark, d):
    """T3"""
    return clock.pseudo_times(A.points(spark, d), 0.1).select("frame_id", "point_id", "t")


TIMES = "CASE l_orderkey % 3 WHEN 0 THEN epoch(l_shipdate)::BIGINT / 1e12::DOUBLE WHEN 1 THEN epoch(l_shipdate)::BIGINT * 1e9::DOUBLE ELSE (epoch(l_shipdate)::BIGINT)::DOUBLE END"


@query(f"WITH f AS (SELECT l_orderkey % 3 AS seq_id, l_orderkey AS frame_id, min({TIMES}) AS lo, max({TIMES}) AS hi FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY frame_id) AS k FROM f) SELECT seq_id, hi < 1 AS is_relative, CASE WHEN lo > 1e16 THEN 1e-9::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM r WHERE k = 1")
def time_units(spark, d):
    """T4: three streams with times of different kinds; an order is a frame"""
    seq, t = F.col("l_orderkey") % 3, A.seconds(F.col("l_shipdate"))
    times = F.when(seq == 0, t / 1e12).when(seq == 1, t * 1e9).otherwise(t.cast("double"))
    return clock.time_units(A.table(spark, d, "lineitem").select(seq.alias("seq_id"), F.col("l_orderkey").alias("frame_id"), times.alias("t")))


@query(f"WITH {A.POINTS} SELECT frame_id, point_id, t - min(t) OVER (PARTITION BY frame_id) AS t, min(t) OVER (PARTITION BY frame_id) AS stamp FROM pts")
def absolute_times(spark, d):
    """T6"""
    pts = A.points(spark, d).withColumn("stamp", F.lit(0).cast("long"))
    return clock.rebased(pts, 1).select("frame_id", "point_id", "t", "stamp")


@query(f"WITH {A.POINTS}, r AS (SELECT *, t - 880000000 AS q FROM pts) SELECT frame_id, point_id, q - least(min(q) OVER (PARTITION BY frame_id), 0) AS t, 5 + least(min(q) OVER (PARTITION BY frame_id), 0) AS stamp FROM r")
def relative_times(spark, d):
    """T5"""
    pts = A.points(spark, d).withColumns({"stamp": F.lit(5).cast("long"), "t": F.col("t") - 880000000})
    return clock.rebased(pts, 1, relative=True).select("frame_id", "point_id", "t", "stamp")


@query(f"WITH {A.SAMPLES}, {A.SCANS} SELECT s.seq_id, s.id, i.value FROM scan s ASOF LEFT JOIN imu i ON s.seq_id = i.seq_id AND s.us >= i.us")
def asof_join(spark, d):
    """J13, J14"""
    return clock.as_of(A.scans(spark, d), A.samples(spark, d), "value").select("seq_id", "id", "value")


@query(f"WITH {A.SAMPLES}, {A.SCANS}, l AS (SELECT s.*, i.us AS lo_us, i.value AS lo_value FROM scan s ASOF LEFT JOIN imu i ON s.seq_id = i.seq_id AND s.us >= i.us), b AS (SELECT l.*, i.us AS hi_us, i.value AS hi_value FROM l ASOF LEFT JOIN imu i ON l.seq_id = i.seq_id AND l.us <= i.us), s AS (SELECT *, CASE WHEN hi_us IS NULL THEN 'waiting' WHEN lo_us IS NULL THEN 'failure' ELSE 'success' END AS status FROM b) SELECT seq_id, id, lo_us, hi_us, status, CASE WHEN status = 'success' THEN lo_value + (hi_value - lo_value) * CASE WHEN hi_us > lo_us THEN (us - lo_us)::DOUBLE / (hi_us - lo_us) ELSE 0 END END AS value FROM s")
def bracket_interpolate(spark, d):
    """J13, J16"""
    return clock.interpolated(clock.bracketed(A.scans(spark, d), A.samples(spark, d), "value")).select("seq_id", "id", "lo_us", "hi_us", "status", "value")


@query(f"WITH {A.SAMPLES}, {A.SCANS}, f AS (SELECT i.seq_id, i.id, i.us, s.id AS scan_id FROM imu i ASOF JOIN scan s ON i.seq_id = s.seq_id AND i.us <= s.us) SELECT seq_id, scan_id, id, us, us - lag(us) OVER (PARTITION BY seq_id, scan_id ORDER BY us, id) AS dt FROM f")
def imu_slice(spark, d):
    """J15, J17"""
    return clock.sliced(A.scans(spark, d), A.samples(spark, d))


@query(f"WITH {A.SAMPLES}, {A.SCANS} SELECT s.seq_id, s.id, i.us AS release_us FROM scan s ASOF LEFT JOIN imu i ON s.seq_id = i.seq_id AND s.us <= i.us")
def scan_release(spark, d):
    """X1"""
    return clock.released(A.scans(spark, d), A.samples(spark, d)).select("seq_id", "id", "release_us")


@query(f"WITH {A.SAMPLES} SELECT a.seq_id, a.id, b.id AS emitted_at FROM imu a ASOF LEFT JOIN (SELECT seq_id, us - 3600000000 AS us, id FROM imu) b ON a.seq_id = b.seq_id AND a.us <= b.us")
def fixed_lag_emit(spark, d):
    """W1, W2"""
    return clock.lagged_emission(A.samples(spark, d), 3_600_000_000).select("seq_id", "id", "emitted_at")


@query(f"WITH {A.SAMPLES} SELECT seq_id, id, lead(us) OVER (PARTITION BY seq_id ORDER BY id) AS next_us FROM imu")
def one_frame_delay(spark, d):
    """W7"""
    return clock.delayed(A.samples(spark, d)).select("seq_id", "id", "next_us")


@query("WITH p AS (SELECT user_id AS seq_id, event_id AS id, floor(value / 50)::BIGINT AS priority FROM events WHERE value IS NOT NULL), t AS (SELECT *, max(priority) OVER (PARTITION BY seq_id ORDER BY id) AS top FROM p) SELECT seq_id, id, priority FROM t WHERE priority = top")
def priority_switch(spark, d):
    """W11"""
    rows = A.table(spark, d, "events").where("value IS NOT NULL").select(F.col("user_id").alias("seq_id"), F.col("event_id").alias("id"), F.floor(F.col("value") / 50).cast("long").alias("priority"))
    return clock.best_source(rows)


@query(f"WITH {A.SAMPLES}, k AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY id) AS k FROM imu) SELECT seq_id, count(*) AS n, (count(*) FILTER (WHERE abs(value) >= 0.5))::BIGINT AS n_large, min(value) AS least, max(value) AS greatest FROM k WHERE k % 4 = 0 GROUP BY seq_id")
def bias_statistics(spark, d):
    """T12"""
    return clock.sampled_statistics(A.samples(spark, d), "value", 4)


@query()
def time_table(spark, d):
    """A fold, tested against brute force"""
    return clock.time_table(A.samples(spark, d), 3_600_000_000).select("seq_id", "id", "anchor_us")


# Maps


@query(f"WITH {A.SUBMAPS}, c AS (SELECT *, (submap_id - 1) // 4 AS chunk FROM sub), l AS (SELECT session_id, chunk, list_sort(list(submap_id)) AS a FROM c GROUP BY ALL) SELECT session_id, chunk, len(a)::BIGINT AS n, a[1] AS first, a[len(a)] AS last, a[len(a) // 2 + 1] AS origin FROM l")
def keyframe_chunks(spark, d):
    """W5, W6"""
    return graph.chunks(A.submaps(spark, d), "session_id", "submap_id", 4)


@query(f"WITH RECURSIVE {A.SUBMAPS}, k(session_id, submap_id, x, y) AS (SELECT session_id, submap_id, x, y FROM sub WHERE submap_id = 1 UNION ALL (SELECT n.session_id, n.submap_id, n.x, n.y FROM (SELECT s.*, row_number() OVER (PARTITION BY s.session_id ORDER BY s.submap_id) AS r FROM k JOIN sub s ON s.session_id = k.session_id AND s.submap_id > k.submap_id AND (s.x - k.x) * (s.x - k.x) + (s.y - k.y) * (s.y - k.y) > 2500) n WHERE n.r = 1)) SELECT session_id, submap_id, x, y FROM k")
def displacement_keyframes(spark, d):
    """By distance alone"""
    return graph.keyframes(A.submaps(spark, d), "session_id", "submap_id", "x", "y", 2500)


TURN = "least((s.h - k.h + 360) % 360, (k.h - s.h + 360) % 360) > 90.5::DOUBLE"


@query(f"WITH RECURSIVE {A.SUBMAPS}, t AS (SELECT *, (7 * x + 13 * y) % 360 AS h FROM sub), k(session_id, submap_id, x, y, h) AS (SELECT session_id, submap_id, x, y, h FROM t WHERE submap_id = 1 UNION ALL (SELECT n.session_id, n.submap_id, n.x, n.y, n.h FROM (SELECT s.*, row_number() OVER (PARTITION BY s.session_id ORDER BY s.submap_id) AS r FROM k JOIN t s ON s.session_id = k.session_id AND s.submap_id > k.submap_id AND ((s.x - k.x) * (s.x - k.x) + (s.y - k.y) * (s.y - k.y) > 10000 OR {TURN})) n WHERE n.r = 1)) SELECT session_id, submap_id FROM k")
def turning_keyframes(spark, d):
    """By distance or angle"""
    h = F.radians((7 * F.col("x") + 13 * F.col("y")) % 360)
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(F.cos(h), -F.sin(h), zero, F.col("x").cast("double"), F.sin(h), F.cos(h), zero, F.col("y").cast("double"), zero, zero, one, zero, zero, zero, zero, one)
    return graph.displaced(A.submaps(spark, d).withColumn("pose", pose), "session_id", "submap_id", "pose", 100.0, 90.5)


@query(f"WITH {A.SUBMAPS}, s AS (SELECT *, coalesce((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w), 0) AS step2 FROM sub WINDOW w AS (PARTITION BY session_id ORDER BY submap_id)) SELECT session_id, submap_id, sum(floor(sqrt(step2))::BIGINT) OVER (PARTITION BY session_id ORDER BY submap_id)::BIGINT AS travel FROM s")
def travel_distance(spark, d):
    """W8"""
    return graph.travelled(A.submaps(spark, d), "session_id", "submap_id", ("x", "y")).select("session_id", "submap_id", "travel")


TRAVEL = "s AS (SELECT *, coalesce((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w), 0) AS step2 FROM sub WINDOW w AS (PARTITION BY session_id ORDER BY submap_id)), t AS (SELECT *, sum(floor(sqrt(step2))::BIGINT) OVER (PARTITION BY session_id ORDER BY submap_id)::BIGINT AS travel FROM s)"


@query(f"WITH {A.SUBMAPS}, {TRAVEL} SELECT a.session_id, a.submap_id AS i, b.submap_id AS j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, b.travel - a.travel AS between FROM t a JOIN t b ON a.session_id = b.session_id AND a.submap_id < b.submap_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900 AND b.travel - a.travel >= 100")
def loop_candidates(spark, d):
    """J10"""
    return graph.loop_candidates(A.submaps(spark, d), "session_id", "submap_id", ("x", "y"), 30, 100)


@query(f"WITH {A.SUBMAPS} SELECT a.session_id, a.submap_id AS i, b.submap_id AS j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM sub a JOIN sub b ON a.session_id = b.session_id AND a.submap_id < b.submap_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 625")
def proximity_edges(spark, d):
    """J8, J9"""
    return joins.pairs_within(A.submaps(spark, d), "session_id", "submap_id", ("x", "y"), 25)


@query(f"WITH {A.SUBMAPS}, e AS (SELECT a.session_id, a.submap_id AS i, b.submap_id AS j FROM sub a JOIN sub b ON a.session_id = b.session_id AND a.submap_id < b.submap_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 625) SELECT s.session_id, s.submap_id AS i, s.submap_id + 1 AS j FROM sub s JOIN sub n ON n.session_id = s.session_id AND n.submap_id = s.submap_id + 1 WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.session_id = s.session_id AND e.i = s.submap_id AND e.j = s.submap_id + 1)")
def missing_edges(spark, d):
    """G7, G11"""
    maps = A.submaps(spark, d)
    return graph.missing_edges(maps, joins.pairs_within(maps, "session_id", "submap_id", ("x", "y"), 25), "session_id", "submap_id")


@query(f"WITH {A.SUBMAPS}, a AS (SELECT * FROM sub WHERE session_id % 2 = 0), b AS (SELECT * FROM sub WHERE session_id % 2 = 1) SELECT 0 AS session, submap_id, x, y FROM a UNION ALL SELECT 1, submap_id + (SELECT max(submap_id) + 1 FROM a), x, y FROM b")
def session_union(spark, d):
    """S9, E9"""
    maps = A.submaps(spark, d)
    return graph.sessions(maps.where("session_id % 2 = 0"), maps.where("session_id % 2 = 1")).select("session", "submap_id", "x", "y")


@query(f"WITH {A.SUBMAPS}, e AS (SELECT a.submap_id AS i, b.submap_id AS j FROM sub a JOIN sub b ON a.session_id = b.session_id AND a.submap_id <> b.submap_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 625) SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM e")
def distinct_edges(spark, d):
    """S7"""
    pairs = joins.pairs_within(A.submaps(spark, d), "session_id", "submap_id", ("x", "y"), 25)
    return graph.distinct_edges(pairs.select("i", "j").union(pairs.select("j", "i")))


@query()
def registration(spark, d):
    """Finds the motion between the vectors of two labels moved apart; tested against numpy"""
    pts = A.vectors(spark, d).withColumn("frame_id", F.lit(0).cast("long"))
    moved = pts.withColumns({"x": F.col("x") + 1.0, "y": F.col("y") - 0.5})
    pose, error = graph.registered(moved, pts, 8.0, 5)
    return spark.createDataFrame([(*[float(v) for v in pose.ravel()], float(error))], ", ".join([f"p{i} double" for i in range(16)] + ["error double"]))


@query()
def global_motion(spark, d):
    """C20: each label's vectors, turned by 120 degrees and moved, find themselves again; tested by hand-made histograms and motions"""
    from ..operators import places

    pts = A.vectors(spark, d)
    known = checkpointed(ground.normals(pts, joins.knn(pts, 8, 8.0)))
    c, s = F.lit(-0.5), F.lit(0.75**0.5)

    def turn(x: str, y: str) -> list:
        return [c * F.col(x) - s * F.col(y), s * F.col(x) + c * F.col(y)]

    moved = pts.withColumns(dict(zip("xy", (turn("x", "y")[0] + 30, turn("x", "y")[1] - 10))))
    turned = known.withColumns(dict(zip(("nx", "ny"), turn("nx", "ny"))))
    found = places.found_motion(moved, turned, pts, known, 12.0, 1.0)
    return found.select("frame_id", "n", F.round("share", 4).alias("share"), *[F.round(F.col("pose")[k], 4).alias(f"p{k}") for k in (0, 1, 3, 4, 5, 7)])


@query()
def plane_bundle(spark, d):
    """Frames as poses, layers of height as planes; tested by gradients and a room in parts"""
    from ..operators import bundle

    pts = A.points(spark, d).select(F.col("frame_id").alias("pose_id"), F.floor(F.col("z") / 2).cast("long").alias("plane_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    unit = F.array(*[F.lit(float(k % 5 == 0)) for k in range(16)])
    poses = pts.select("pose_id").distinct().select("pose_id", unit.alias("pose"), (F.col("pose_id") == 0).alias("fixed"))
    found, _ = bundle.adjusted(poses, pts, 4)
    return found.select("pose_id", *[F.round(F.col("pose")[k], 4).alias(f"p{k}") for k in (2, 6, 11)])


@query()
def voxel_surprise(spark, d):
    """How far each voxel's mean moved since the frame before, by the covariance of what was in its cell; against numpy"""
    vox = cloud.scatter(cloud.voxelise(A.points(spark, d), 4.0, spread=True), 4.0)
    before = vox.select((F.col("frame_id") + 1).alias("frame_id"), *cloud.CELL, *[F.col(c).alias(f"p{c}") for c in ("mx", "my", "mz", *cloud.COV)])
    met = vox.join(before, ["frame_id", *cloud.CELL])
    far = G.mahalanobis(tuple(F.col(m) - F.col(f"p{m}") for m in ("mx", "my", "mz")), [F.col(f"p{c}") for c in cloud.COV], 0.01)
    return met.select("frame_id", *cloud.CELL, F.round(far, 6).alias("mahalanobis"))


@query()
def distribution_registration(spark, d):
    """Lays each label's vectors, moved apart, on themselves by covariances, coarse to fine; tested against numpy"""
    from ..operators import registration as R

    pts = A.vectors(spark, d)
    known = checkpointed(R.with_covariances(pts, ground.normals(pts, joins.knn(pts, 8, 8.0)), 0.05))
    found = R.aligned(known.withColumns({"x": F.col("x") + 0.5, "y": F.col("y") - 0.25}), known, (8.0, 4.0))
    return found.select("frame_id", "n", "cost", *[F.col("pose")[k].alias(f"p{k}") for k in range(16)])


# Motion, merges, formats and streams


def inertial(spark, d) -> DataFrame:
    """Samples of accelerations and turn rates: what events say, scaled; stamps in seconds since the first day."""
    rows = A.samples(spark, d).where("value IS NOT NULL")
    v = F.col("value")
    return rows.select("seq_id", "id", ((F.col("us") - 1704067200000000) / 1e6).alias("stamp"), (v % 3 / 10).alias("ax"), (v % 5 / 10 - 0.2).alias("ay"), (v % 7 / 10 + 9.5).alias("az"), (v % 2 / 1000).alias("wx"), (v % 4 / 2000).alias("wy"), (v % 6 / 3000).alias("wz"))


@query()
def inertial_odometry(spark, d):
    """Scans laid on a local map, from what the samples predict; tested by drift on a drive, and batch against stream"""
    from ..operators import odometry

    none, some = F.lit(0.0), F.lit(0.1)
    scans = sequences(spark, d).withColumns({"stamp": F.col("frame_id") / 10} | {c: some if c in ("cxx", "cyy", "czz") else none for c in cloud.COV})
    samples = inertial(spark, d).withColumns({"seq_id": F.col("id") % 64, "stamp": F.col("stamp") % 1})
    return odometry.estimated(odometry.messages(scans, samples), res=4.0)


@query()
def imu_trajectories(spark, d):
    """The way between scans at the samples' rate; tested against dense least squares"""
    from ..operators import smoothing

    place = (F.col("us") - 1704067200000000) / 1e10  # a day as some nine seconds
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(one, zero, zero, place, zero, one, zero, (F.col("id") % 7) / 10, zero, zero, one, zero, zero, zero, zero, one)
    frames = A.scans(spark, d).select("seq_id", F.col("id").alias("frame_id"), place.alias("stamp"), pose.alias("pose"), *[zero.alias(c) for c in ("vx", "vy", "vz")])
    way = smoothing.trajectories(frames, inertial(spark, d).withColumn("stamp", F.col("stamp") / 1e4))
    return way.groupBy("seq_id", "frame_id").agg(F.count(F.lit(1)).alias("n"), F.min("stamp").alias("first"), F.max("stamp").alias("last"), *[F.round(F.max_by(c, "stamp"), 3).alias(c) for c in "xyz"])


@query()
def imu_integration(spark, d):
    """A fold, tested against numpy"""
    from ..operators import motion

    return motion.integrated(inertial(spark, d))


@query()
def pose_filter(spark, d):
    """A fold, tested against a plain loop"""
    from ..operators import motion

    imu = inertial(spark, d)
    z, one = F.lit(0.0), F.lit(1.0)
    kinds = [c for c in imu.columns if c not in ("seq_id", "id", "stamp")]
    poses = ("x", "y", "z", "qx", "qy", "qz", "qw")
    a = imu.select("seq_id", "stamp", F.lit("imu").alias("kind"), *kinds, *[z.alias(c) for c in poses])
    p = A.scans(spark, d).select("seq_id", ((F.col("us") - 1704067200000000) / 1e6).alias("stamp"), F.lit("pose").alias("kind"), *[z.alias(c) for c in kinds], (F.col("id") % 100 / 10.0).alias("x"), (F.col("id") % 70 / 10.0).alias("y"), z.alias("z"), *[z.alias(c) for c in poses[3:6]], one.alias("qw"))
    return motion.filtered(a.unionByName(p))


@query()
def gravity_direction(spark, d):
    """Means of doubles, so no SQL is compared"""
    from ..operators import motion

    return motion.gravity_direction(inertial(spark, d), 36000.0)


@query()
def scan_deskew(spark, d):
    """Slerp between the poses around each point; tested against numpy"""
    from ..operators import motion

    half = F.lit(0.5) * (F.col("id") % 7) / 7
    poses = A.scans(spark, d).select("seq_id", "us", (F.col("id") % 10).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"))
    pts = A.samples(spark, d).select("seq_id", "id", "us", F.coalesce("value", F.lit(0.0)).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"))
    return motion.deskewed(pts, poses).select("seq_id", "id", "dx", "dy", "dz")


@query()
def twist_deskew(spark, d):
    """M4"""
    from ..operators import motion

    pts = A.points(spark, d).withColumn("t", (F.col("point_id") % 100) / 1000.0)
    return motion.deskewed_by_twist(pts, (1.0, 0.5, 0.0), (0.0, 0.0, 0.3)).select("frame_id", "point_id", "dx", "dy", "dz")


@query("WITH e AS (SELECT user_id AS seq_id, event_id AS id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE value IS NOT NULL AND abs(value - 50) >= 0.1), b AS (SELECT *, avg(CASE WHEN value % 5 < value % 7 THEN 1.0::DOUBLE ELSE 0 END) OVER w AS better_rot, avg(CASE WHEN value % 3 < value % 7 THEN 1.0::DOUBLE ELSE 0 END) OVER w AS better_trans, avg(CASE WHEN value % 2 < value % 7 THEN 1.0::DOUBLE ELSE 0 END) OVER w AS better_vel FROM e WINDOW w AS (PARTITION BY seq_id ORDER BY id)) SELECT seq_id, id, k::INT AS k, better_rot, better_trans, better_vel, better_rot > 0.6::DOUBLE AND better_trans > 0.6::DOUBLE AND better_vel > 0.6::DOUBLE AS valid FROM b WHERE k % 8 = 0")
def predictor_check(spark, d):
    """T11"""
    from ..operators import motion

    v = F.col("value")
    rows = A.table(spark, d, "events").where("value IS NOT NULL").select(F.col("user_id").alias("seq_id"), F.col("event_id").alias("id"), (v - 50).alias("speed"), (v % 5).alias("imu_rot"), (v % 3).alias("imu_trans"), (v % 2).alias("imu_vel"), *[(v % 7).alias(f"cv_{k}") for k in ("rot", "trans", "vel")])
    return motion.predictor_check(rows, 8, (0.6, 0.6, 0.6))


@query()
def merged_boxes(spark, d):
    """A fold, tested against brute force"""
    from ..operators import merge

    return merge.merged_peers(row_boxes(spark, d), 2.0)


@query()
def wall_memory(spark, d):
    """X15, C14, and a memory that forgets by missed frames: a fold, tested by hand-made cases"""
    from ..operators import merge

    walls = row_boxes(spark, d).withColumns({"nx": F.lit(1.0), "ny": F.lit(0.0), "nz": F.lit(0.0)})
    return merge.remembered_walls(walls)


@query("SELECT l_orderkey % 50 AS frame_id, l_quantity::FLOAT::DOUBLE AS x, (l_extendedprice / 2000)::FLOAT::DOUBLE AS y, (l_discount * 100)::FLOAT::DOUBLE AS z, epoch_us(l_shipdate) / 1e9::DOUBLE AS t, ((l_partkey >> 16) & 255) / 255.0::DOUBLE AS r, ((l_partkey >> 8) & 255) / 255.0::DOUBLE AS g, (l_partkey & 255) / 255.0::DOUBLE AS b, ((l_partkey >> 24) & 255) / 255.0::DOUBLE AS a FROM lineitem")
def decoded_cloud(spark, d):
    """S1"""
    from ..sources import clouds

    raw = A.table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("frame_id"), F.col("l_quantity").cast("float").alias("x"), (F.col("l_extendedprice") / 2000).cast("float").alias("y"), (F.col("l_discount") * 100).cast("float").alias("z"), A.micros(F.col("l_shipdate")).alias("timestamp"), F.col("l_partkey").alias("rgba"))
    return clouds.decoded(raw)


PLY_HEAD = "'ply' || chr(10) || 'format ascii 1.0' || chr(10) || 'element vertex ' || count(*) || chr(10) || 'property float x' || chr(10) || 'property float y' || chr(10) || 'property float z' || chr(10) || 'end_header'"
PLY_LINE = "format('{:.6f} {:.6f} {:.6f}', l_quantity, l_extendedprice / 2000, l_discount * 100)"


@query(f"SELECT l_orderkey % 50 AS part, {PLY_LINE} AS value FROM lineitem UNION ALL SELECT l_orderkey % 50 AS part, {PLY_HEAD} AS value FROM lineitem GROUP BY ALL")
def ply_lines(spark, d):
    """A file for each frame, headers too"""
    from ..sources import clouds

    return clouds.ply(A.points(spark, d).select("frame_id", "x", "y", "z"), "frame_id").select(F.col("frame_id").alias("part"), "value")


@query(f"SELECT 1 AS part, {PLY_LINE} AS value FROM lineitem UNION ALL SELECT 0 AS part, {PLY_HEAD} AS value FROM lineitem")
def ply_map(spark, d):
    """All points as one file"""
    from ..sources import clouds

    return clouds.ply(A.points(spark, d).select("x", "y", "z"))


@query(f"WITH {A.SAMPLES}, b AS (SELECT *, max(us) OVER (PARTITION BY seq_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM imu) SELECT seq_id, id, us, coalesce(us >= before, true) AND us >= 0 AS accepted FROM b")
def stream_accept(spark, d):
    """T1, S3, S4, X1 as a stream: the table is replayed, and what the stream wrote is returned"""
    import uuid

    from ..operators.graph import checkpointed
    from ..streaming import flows

    schema = A.table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a pattern, as streams take no path of a single file; the table may be a folder
    rows = rows.where(F.col("event_type").isin(*A.IMU_TYPES)).select(F.col("user_id").alias("seq_id"), F.col("event_id").alias("id"), A.micros(F.col("ts")).alias("us"))
    if not spark.sparkContext.getCheckpointDir():
        checkpointed(spark.range(1))
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    flows.accepted_stamps(rows).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


# Keyframes, local maps and the whole way of a scan


def sequences(spark, d) -> DataFrame:
    """Points of sequences of 10 frames, a frame of 300 orders: more of them in a larger table."""
    pts = A.points(spark, d)
    order = F.floor(F.col("point_id") / 1000).cast("long")
    return pts.withColumns({"seq_id": F.floor(order / 3000).cast("long"), "frame_id": F.floor(order / 300).cast("long") % 10})


@query()
def overlap_keyframes(spark, d):
    """A fold, tested by hand-made cases"""
    from ..operators import keyframes

    return keyframes.by_overlap(keyframes.frame_cells(sequences(spark, d), 4.0), 0.9, 0.05, 3)


@query()
def distance_keyframes(spark, d):
    """K7: a fold, tested by hand-made cases"""
    from ..operators import keyframes

    return keyframes.by_distance(keyframes.frame_cells(sequences(spark, d), 4.0), 4)


@query()
def entropy_keyframes(spark, d):
    """K8: a fold, tested by hand-made cases"""
    from ..operators import keyframes

    rows = A.table(spark, d, "events").where("value IS NOT NULL").select(F.col("user_id").alias("seq_id"), F.col("event_id").alias("frame_id"), F.col("value").alias("entropy"))
    return keyframes.by_entropy(rows, 1.0, 5)


@query()
def thinned_map(spark, d):
    """A fold, tested by brute force"""
    from ..operators import keyframes

    return keyframes.thinned(A.points(spark, d), 4.0, 1.0, 10)


@query(f"WITH {A.POINTS}, c AS (SELECT ix, iy, iz, max(frame_id) AS last_frame FROM (SELECT *, {cells(4.0)} FROM pts) GROUP BY ALL) SELECT * FROM c WHERE last_frame > (SELECT max(frame_id) FROM pts) - 5")
def recent_cells(spark, d):
    """C22"""
    from ..operators import keyframes

    return keyframes.recent_cells(A.points(spark, d), 4.0, 5)


@query()
def pose_graph(spark, d):
    """Turns and places of every customer's submaps from the edges between consecutive and near ones; tested
    against a dense solution"""
    from ..operators import posegraph

    maps = A.submaps(spark, d).withColumn("node", F.col("session_id") * 1000 + F.col("submap_id"))
    angle = (F.col("y") % 7) / 10
    c, s, zero, one = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)

    def pose(off: float):
        x, y = (F.col(k) / 10 + off * (F.col("submap_id") % 5) for k in ("x", "y"))
        return F.array(c, -s, zero, x, s, c, zero, y, zero, zero, one, zero, zero, zero, zero, one)

    nodes = maps.select("node", pose(0.05).alias("pose"), (F.col("submap_id") == 1).alias("fixed"), F.col("session_id").alias("block"))
    true = maps.select("session_id", "submap_id", pose(0.0).alias("true"))
    chain = graph.odometry_edges(true, "session_id", "submap_id", "true").select("session_id", "i", "j")
    near = joins.pairs_within(maps, "session_id", "submap_id", ("x", "y"), 25).select("session_id", "i", "j")
    pairs = chain.unionByName(near).distinct()
    ends = [true.select("session_id", F.col("submap_id").alias(k), F.col("true").alias(f"t{k}")).hint("merge") for k in "ij"]
    both = pairs.join(ends[0], ["session_id", "i"]).join(ends[1], ["session_id", "j"])
    ids = {k: F.col("session_id") * 1000 + F.col(k) for k in "ij"}
    edges = both.select(ids["i"].alias("i"), ids["j"].alias("j"), G.composed(G.inverse(F.col("ti")), F.col("tj")).alias("relative"), F.lit(100.0).alias("turn_weight"), F.lit(25.0).alias("shift_weight"))
    found, _ = posegraph.optimised(nodes, edges, 4)
    return found.select("node", *[F.round(F.col("pose")[k], 4).alias(f"p{k}") for k in (0, 1, 3, 4, 5, 7)])


@query()
def relaxed_graph(spark, d):
    """Places alone that agree with the edges, in a fixed number of rounds; tested against a dense solution"""
    from ..operators import keyframes

    maps = A.submaps(spark, d).withColumn("node", F.col("session_id") * 1000 + F.col("submap_id"))
    nodes = maps.select("node", *[F.col(c).cast("double").alias(c) for c in ("x", "y")], F.lit(0.0).alias("z"), (F.col("submap_id") == 1).alias("fixed"))
    pairs = joins.pairs_within(maps, "session_id", "submap_id", ("x", "y"), 25)
    edges = pairs.select((F.col("session_id") * 1000 + F.col("i")).alias("i"), (F.col("session_id") * 1000 + F.col("j")).alias("j"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"), F.lit(1.0).alias("weight"))
    return keyframes.relaxed(nodes, edges, 10)


@query()
def grown_region(spark, d):
    """C18"""
    from ..operators import keyframes

    pts = A.vectors(spark, d)
    return keyframes.grown(pts, ground.normals(pts, joins.knn(pts, 8, 8.0)), 0, 12.0, 60.0)


@query(f"WITH {A.SUBMAPS}, a AS (SELECT session_id * 1000 + submap_id AS id, x, y FROM sub WHERE session_id % 2 = 0), b AS (SELECT session_id * 1000 + submap_id AS id, x, y FROM sub WHERE session_id % 2 = 1), p AS (SELECT a.id AS a_id, b.id AS b_id, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE AS d2 FROM a JOIN b ON abs(a.x - b.x) < 100 AND abs(a.y - b.y) < 100) SELECT * FROM p ORDER BY d2, a_id, b_id LIMIT 1")
def closest_submaps(spark, d):
    """J19"""
    from ..operators import keyframes

    nodes = A.submaps(spark, d).select((F.col("session_id") * 1000 + F.col("submap_id")).alias("id"), "session_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return keyframes.closest_pair(nodes.where("session_id % 2 = 0"), nodes.where("session_id % 2 = 1"), 2.0)


@query()
def rejection(spark, d):
    """Points of the whole way, by sequence and frame; a fold, tested by hand-made cases"""
    from . import rejection as way

    out = way.rejected(sequences(spark, d).drop("intensity"))
    return out.groupBy("seq_id", "frame_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_dynamic").alias("n_dynamic"))


@query()
def cut_object(spark, d):
    """C17: the object around the least id of every frame; tested against a plain maximum flow"""
    from ..operators import segments

    pts = A.vectors(spark, d)
    first = F.min(F.struct("point_id", "x", "y", "z")).alias("p")
    picked = pts.groupBy("frame_id").agg(first).select("frame_id", "p.x", "p.y", "p.z")
    return segments.segmented(pts, picked, 6.0, 25.0, 10.0, 6.0, 0.5)


@query()
def wall_registry(spark, d):
    """Every order a frame, its lines walls and, beside them, voxels; a fold, tested against a plain loop"""
    from ..operators import walls

    found = row_boxes(spark, d)
    step = (F.col("frame_id") % 3 - 1) / 2
    one, zero = F.lit(1.0), F.lit(0.0)
    frames = found.select("seq_id", "frame_id").distinct().withColumn("pose", F.array(one, zero, zero, step, zero, one, zero, zero, zero, zero, one, zero, zero, zero, zero, one))
    voxels = found.select("seq_id", "frame_id", F.col("box_idx").alias("voxel_id"), (F.col("cx") + 1.5 * (F.col("box_idx") % 3)).alias("mx"), F.col("cy").alias("my"), F.col("cz").alias("mz"), F.lit(False).alias("is_wall"))
    out = walls.registered(frames, found.withColumn("turn", F.lit(None).cast("array<double>")), voxels, 30, left=False)
    return out.where("kind = 'voxel'").select("seq_id", "frame_id", "voxel_id", "wall_id", "is_wall")


def saved_map(spark, d) -> str:
    """Every customer a submap, its orders frames, their lines points; a map in the shared folder, packed as there are as many
    submaps as customers."""
    import uuid

    from pyspark.sql import Window

    from ..operators.graph import checkpoint_folder
    from ..sources import maps

    one, zero = F.lit(1.0), F.lit(0.0)

    def at(x):
        return F.array(one, zero, zero, x.cast("double"), zero, one, zero, zero, zero, zero, one, zero, zero, zero, zero, one)

    orders = A.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("submap_id"), "o_orderdate")
    subs = A.table(spark, d, "customer").select(F.col("c_custkey").alias("submap_id"), at(F.col("c_acctbal")).alias("world_origin"), at(zero).alias("origin_left"), at(one).alias("origin_right"), at(F.lit(0.5)).alias("lidar_imu"), F.array(*[zero] * 6).alias("imu_bias"), F.lit(1).alias("frame_kind"))
    k = (F.row_number().over(Window.partitionBy("submap_id").orderBy("o_orderdate", "o_orderkey")) - 1).alias("k")
    frames = orders.select("submap_id", k, F.col("o_orderkey").alias("id"), A.seconds(F.col("o_orderdate")).cast("double").alias("stamp"), at(F.col("o_orderkey")).alias("odom_lidar"), at(F.col("o_orderkey") / 2).alias("world_lidar"), F.array(zero, zero, zero).alias("v_world_imu"))
    pts = A.points(spark, d).withColumn("o_orderkey", F.floor(F.col("point_id") / 1000).cast("long"))
    pts = pts.join(orders.select("o_orderkey", "submap_id"), "o_orderkey").select("submap_id", "point_id", "x", "y", "z", "intensity")
    edges = A.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "gicp").otherwise("vgicp").alias("kind"), F.col("o_custkey").alias("i"), (F.col("o_orderkey") % 97).alias("j"))
    path = f"{checkpoint_folder(spark)}/map-{uuid.uuid4().hex}"
    maps.save(path, subs, frames, pts, edges.where("i <> j"), packed=True)
    return path


@query(f"""WITH {A.POINTS} SELECT o_custkey AS submap_id, row_number() OVER (PARTITION BY o_custkey ORDER BY point_id) - 1 AS point_id, x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y, z::FLOAT::DOUBLE AS z, intensity::FLOAT::DOUBLE AS intensity
FROM pts JOIN orders ON o_orderkey = point_id // 1000""")
def map_points(spark, d):
    """Points of a map that was written and read back; they are numbered by their place in the file"""
    from ..sources import maps

    got = maps.load(spark, saved_map(spark, d))["points"]
    return got.select("submap_id", "point_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "intensity")])


@query("""WITH f AS (SELECT o_custkey AS submap_id, o_orderkey AS id, epoch(o_orderdate)::BIGINT AS stamp, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders),
e AS (SELECT least(o_custkey, o_orderkey % 97) AS i, greatest(o_custkey, o_orderkey % 97) AS j, max(CASE WHEN o_orderkey % 2 = 0 THEN 'gicp' ELSE 'vgicp' END) AS kind FROM orders WHERE o_custkey <> o_orderkey % 97 GROUP BY 1, 2)
SELECT 'frame' AS what, submap_id AS i, k AS j, id || ' ' || stamp AS value FROM f UNION ALL SELECT 'edge', i, j, kind FROM e
UNION ALL SELECT 'count', (SELECT count(*) FROM customer), (SELECT count(*) FROM f), (SELECT count(*) FROM e)::VARCHAR""")
def map_graph(spark, d):
    """Frames, edges (one a pair) and counts of a map that was written and read back"""
    from ..sources import maps

    path = saved_map(spark, d)
    got = maps.load(spark, path)
    stamp = F.col("stamp").cast("long").cast("string")
    frames = got["frames"].select(F.lit("frame").alias("what"), F.col("submap_id").alias("i"), F.col("k").cast("long").alias("j"), F.concat_ws(" ", F.col("id").cast("string"), stamp).alias("value"))
    n = maps.counted(path)
    head = frames.limit(0).unionByName(spark.createDataFrame([("count", n["num_submaps"], n["num_all_frames"], str(n["num_matching_cost_factors"]))], frames.schema))
    return frames.unionByName(got["edges"].select(F.lit("edge").alias("what"), "i", "j", F.col("kind").alias("value"))).unionByName(head)
