"""The given relational tables seen as scans, inertial samples, boxes and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: Column) -> Column:
    """Whole seconds of a timestamp without zone, as UTC."""
    return F.unix_timestamp(c.cast("timestamp"))


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, point_id, x, y, z, intensity, t: order lines as points, 50 frames."""
    rows = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(*[c for c in rows.columns if c != "l_orderkey"])
    return rows.select(
        (F.col("l_orderkey") % 50).alias("frame_id"), (F.col("l_orderkey") * 1000 + F.row_number().over(order)).alias("point_id"),
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"), (F.col("l_discount") * 100).alias("z"),
        F.col("l_tax").alias("intensity"), seconds(F.col("l_shipdate")).alias("t"),
    )


#: The same in DuckDB.
POINTS = """pts AS (SELECT l_orderkey % 50 AS frame_id,
  l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS point_id,
  l_quantity AS x, l_extendedprice / 2000 AS y, l_discount * 100 AS z, l_tax AS intensity, epoch(l_shipdate)::BIGINT AS t FROM lineitem)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, point_id, x, y, z: the first three numbers of each embedding, times 100."""
    at = lambda i: (F.col("embedding")[i].cast("double") * 100)
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("frame_id"), F.col("vec_id").alias("point_id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


VECTORS = "vec AS (SELECT label::BIGINT AS frame_id, vec_id AS point_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z FROM embeddings)"

IMU_TYPES, SCAN_TYPE = ("click", "view"), "error"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, id, us, value: clicks and views as inertial samples."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin(*IMU_TYPES))
    return rows.select(F.col("user_id").alias("seq_id"), F.col("event_id").alias("id"), micros(F.col("ts")).alias("us"), "value")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, id, us: errors as scans."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == SCAN_TYPE)
    return rows.select(F.col("user_id").alias("seq_id"), F.col("event_id").alias("id"), micros(F.col("ts")).alias("us"))


SAMPLES = "imu AS (SELECT user_id AS seq_id, event_id AS id, epoch_us(ts) AS us, value FROM events WHERE event_type IN ('click', 'view'))"
SCANS = "scan AS (SELECT user_id AS seq_id, event_id AS id, epoch_us(ts) AS us FROM events WHERE event_type = 'error')"


def submaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, submap_id (order within the session), x, y: the orders of a customer as a trajectory of submaps, in
    whole numbers (so that distances are exact)."""
    rows = table(spark, sf_dir, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return rows.select(F.col("o_custkey").alias("session_id"), F.row_number().over(order).cast("long").alias("submap_id"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("x"), (F.col("o_orderkey") % 101).alias("y"))


SUBMAPS = "sub AS (SELECT o_custkey AS session_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS submap_id, floor(o_totalprice / 1000)::BIGINT AS x, o_orderkey % 101 AS y FROM orders)"

#: box_idx, centre, size, velocity (x, y), is_dynamic, first frame.
BOX_ROWS = ((0, 10.0, 10.0, 2.0, 8.0, 6.0, 4.0, 1.0, 0.0, True, 0), (1, 25.0, 20.0, 5.0, 10.0, 10.0, 6.0, 0.0, 0.0, False, 10), (2, 12.0, 12.0, 3.0, 6.0, 6.0, 6.0, 0.0, 2.0, True, 20), (3, 40.0, 30.0, 8.0, 4.0, 12.0, 3.0, 3.0, 4.0, True, 30), (4, 30.0, 25.0, 5.0, 14.0, 8.0, 9.0, 0.0, 0.0, False, 40))
BOX_COLUMNS = "box_idx long, cx double, cy double, cz double, sx double, sy double, sz double, vx double, vy double, is_dynamic boolean, insert_frame long"


def boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BOX_ROWS), BOX_COLUMNS)


def _sql_row(r: tuple) -> str:
    doubles = ", ".join(f"{v!r}::DOUBLE" for v in r[1:9])
    return f"({r[0]}::BIGINT, {doubles}, {str(r[9]).lower()}, {r[10]}::BIGINT)"


BOXES = f"boxes(box_idx, cx, cy, cz, sx, sy, sz, vx, vy, is_dynamic, insert_frame) AS (VALUES {', '.join(map(_sql_row, BOX_ROWS))})"
