"""Time: validation, normalisation, as-of lookups and release rules. Times are microseconds (us) or seconds (t)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_arrival(key: str = "seq_id", order: str = "id") -> Window:
    return Window.partitionBy(key).orderBy(order)


def accepted(rows: DataFrame, gap: int = 100_000) -> DataFrame:
    """A stamp is accepted if no accepted one before it, in order of arrival, is larger; has_gap: it follows the last
    accepted one by more than gap. As accepted stamps only grow, the last one is the running maximum."""
    before = F.max("us").over(by_arrival().rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("before", before)
    ok = F.coalesce(F.col("us") >= F.col("before"), F.lit(True)) & (F.col("us") >= 0)
    return out.withColumns({"accepted": ok, "has_gap": ok & F.coalesce(F.col("us") - F.col("before") > gap, F.lit(False))}).drop("before")


def audited(rows: DataFrame, gap: int = 100_000) -> DataFrame:
    """Against the row before, whatever it was: rewinds and has_gap."""
    last = F.lag("us").over(by_arrival())
    return rows.withColumn("rewinds", F.coalesce(F.col("us") < last, F.lit(False))).withColumn("has_gap", F.coalesce(F.col("us") - last > gap, F.lit(False)))


def skewed(scans: DataFrame, samples: DataFrame, most: int = 1_000_000) -> DataFrame:
    """scans with last_us, the latest sample that had arrived, and is_skewed: it is further off than `most`."""
    out = as_of(scans, samples.select("seq_id", "us", F.col("us").alias("last_us")), "last_us")
    return out.withColumn("is_skewed", F.coalesce(F.abs(F.col("us") - F.col("last_us")) > most, F.lit(False)))


def as_of(left: DataFrame, right: DataFrame, *values: str) -> DataFrame:
    """left (seq_id, us, ...) with the values of the last row of right at or before it.

    One shuffle by sequence: both sides in one stream, right rows first at equal times, and the last value carried on."""
    marks = left.withColumns({f"_{v}": F.lit(None).cast(right.schema[v].dataType) for v in values}).withColumn("_side", F.lit(1))
    carried = right.select("seq_id", "us", *[F.col(v).alias(f"_{v}") for v in values]).withColumn("_side", F.lit(0))
    both = marks.unionByName(carried, allowMissingColumns=True)
    upto = Window.partitionBy("seq_id").orderBy("us", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumns({v: F.last(f"_{v}", ignorenulls=True).over(upto) for v in values})
    return filled.where("_side = 1").drop("_side", *[f"_{v}" for v in values])


def bracketed(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left with the samples around it (lo_us, lo, hi_us, hi) and status: success, failure (all are newer), waiting (all are
    older, or there is none); a sample at the very time is an exact hit on both sides."""
    stamp = right.select("seq_id", "us", F.struct("us", value).alias("s"))
    marks = left.withColumn("s", F.lit(None).cast(stamp.schema["s"].dataType)).withColumn("_side", F.lit(1))
    both = marks.unionByName(stamp.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy("seq_id").orderBy("us", "_side").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("seq_id").orderBy(F.desc("us"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({"lo": F.last("s", ignorenulls=True).over(before), "hi": F.last("s", ignorenulls=True).over(after)}).where("_side = 1")
    status = F.when(F.col("hi").isNull(), "waiting").when(F.col("lo").isNull(), "failure").otherwise("success")
    out = out.withColumn("status", status).drop("s", "_side")
    return out.withColumns({"lo_us": F.col("lo.us"), "hi_us": F.col("hi.us"), "lo_value": F.col(f"lo.{value}"), "hi_value": F.col(f"hi.{value}")}).drop("lo", "hi")


def interpolated(rows: DataFrame) -> DataFrame:
    """bracketed rows with value between the two samples by time, for those that succeeded."""
    span = F.col("hi_us") - F.col("lo_us")
    p = F.when(span > 0, (F.col("us") - F.col("lo_us")) / span).otherwise(0.0)
    return rows.withColumn("value", F.when(F.col("status") == "success", F.col("lo_value") + (F.col("hi_value") - F.col("lo_value")) * p))


def sliced(scans: DataFrame, samples: DataFrame) -> DataFrame:
    """The samples in (start, stamp] of each scan, where start is the scan before: scan_id, id, dt to the sample before.

    A sample belongs to the first scan at or after it, so this is one forward as-of lookup, not a range join."""
    first = Window.partitionBy("seq_id").orderBy(F.desc("us"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    ends = scans.select("seq_id", "us", F.col("id").alias("scan_id")).withColumn("_side", F.lit(0))
    both = samples.select("seq_id", "us", "id").withColumn("_side", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    found = both.withColumn("of", F.last("scan_id", ignorenulls=True).over(first)).where("_side = 1 AND of IS NOT NULL")
    dt = F.col("us") - F.lag("us").over(Window.partitionBy("seq_id", "of").orderBy("us", "id"))
    return found.select("seq_id", F.col("of").alias("scan_id"), "id", "us").withColumnRenamed("scan_id", "of").withColumn("dt", dt).withColumnRenamed("of", "scan_id")


def upper_median(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """element n / 2 (rounded down, from 0) of each key's sorted values."""
    own = Window.partitionBy(key)
    ranked = rows.select(key, value.alias("v")).where("v IS NOT NULL").withColumns({"k": F.row_number().over(own.orderBy("v")), "n": F.count(F.lit(1)).over(own)})
    return ranked.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select(key, "n", F.col("v").alias("median"))


def scan_duration(scans: DataFrame, most_gaps: int = 1000, low: int = 10_000, high: int = 1_000_000) -> DataFrame:
    """The upper median of the first gaps between scans, or -1 if it isn't plausible."""
    gap = F.col("us") - F.lag("us").over(by_arrival())
    first = scans.withColumn("gap", gap).withColumn("k", F.row_number().over(by_arrival())).where(F.col("k") <= most_gaps + 1)
    out = upper_median(first, "seq_id", F.col("gap"))
    return out.withColumn("duration", F.when(F.col("median").between(low, high), F.col("median")).otherwise(-1))


def pseudo_times(points: DataFrame, duration: float) -> DataFrame:
    """Points without times: duration * place / n by order of ids."""
    by = Window.partitionBy("frame_id")
    return points.withColumn("t", F.lit(duration) * (F.row_number().over(by.orderBy("point_id")) - 1) / F.count(F.lit(1)).over(by))


def time_unit(first_frame: DataFrame) -> DataFrame:
    """is_relative and scale of a stream, from the times of its first scan: under 1 they are relative, over 1e16 nanoseconds."""
    lo, hi = F.min("t"), F.max("t")
    return first_frame.agg((hi < 1).alias("is_relative"), F.when(lo > 1e16, 1e-9).otherwise(1.0).alias("scale"))


def time_units(points: DataFrame) -> DataFrame:
    """seq_id, is_relative, scale of each stream, from its first frame that has times, as time_unit. Streams without any
    times aren't returned."""
    frames = points.where("t IS NOT NULL").groupBy("seq_id", "frame_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    first = frames.groupBy("seq_id").agg(F.min_by(F.struct("lo", "hi"), "frame_id").alias("f"))
    return first.select("seq_id", (F.col("f.hi") < 1).alias("is_relative"), F.when(F.col("f.lo") > 1e16, 1e-9).otherwise(1.0).alias("scale"))


def rebased(points: DataFrame, scale: float = 1.0, relative: bool = False, prefer_stamp: bool = False) -> DataFrame:
    """t from the frame's first point on; stamp moves with it, unless the frame's own is preferred.

    Relative times are only shifted where some are negative."""
    lo = F.min("t").over(Window.partitionBy("frame_id"))
    if relative:
        lo = F.least(lo, F.lit(0))
    moved = F.col("stamp") + lo * scale if relative else lo * scale
    return points.withColumn("stamp", F.col("stamp") if prefer_stamp else moved).withColumn("t", (F.col("t") - lo) * scale)


def released(scans: DataFrame, samples: DataFrame) -> DataFrame:
    """When each scan may go on: release_us, the first sample at or after its end; null: only at the end of the sequence."""
    ahead = Window.partitionBy("seq_id").orderBy(F.desc("us"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = scans.withColumns({"_s": F.lit(None).cast("long"), "_side": F.lit(1)}).unionByName(samples.select("seq_id", "us", F.col("us").alias("_s")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    return both.withColumn("release_us", F.last("_s", ignorenulls=True).over(ahead)).where("_side = 1").drop("_s", "_side")


def lagged_emission(rows: DataFrame, lag: int) -> DataFrame:
    """emitted_at: the id of the first later row that is at least `lag` newer; null: it is flushed at the end."""
    later = rows.select("seq_id", (F.col("us") - lag).alias("us"), F.col("id").alias("later"))
    ahead = Window.partitionBy("seq_id").orderBy(F.desc("us"), "_side", F.desc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumns({"later": F.lit(None).cast("long"), "_side": F.lit(1), "_tie": F.col("id")}).unionByName(later.withColumns({"_side": F.lit(0), "_tie": F.col("later")}), allowMissingColumns=True)
    return both.withColumn("emitted_at", F.last("later", ignorenulls=True).over(ahead)).where("_side = 1").drop("later", "_side", "_tie")


def delayed(rows: DataFrame) -> DataFrame:
    """next_us: each row is worked on when the next one has come."""
    return rows.withColumn("next_us", F.lead("us").over(by_arrival()))


def best_source(rows: DataFrame) -> DataFrame:
    """Rows of a stream of several priorities that aren't below the highest one so far: a better source resets the history."""
    top = F.max("priority").over(by_arrival().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("top", top).where("priority = top").drop("top")


def sampled_statistics(rows: DataFrame, value: str, every: int = 64) -> DataFrame:
    """Of every 64th row of a sequence: how many, how many of an absolute value of 0.5 or more, least, greatest."""
    k = F.row_number().over(by_arrival())
    return rows.withColumn("k", k).where(F.col("k") % every == 0).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(value) >= 0.5).alias("n_large"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def time_table(rows: DataFrame, step: int = 100) -> DataFrame:
    """anchor_us of each row: the latest entry of a table that takes a time more than `step` after its last entry.

    What follows an entry depends on it, so this is a fold over the sorted times of a sequence, read as a stream."""
    from .motion import folded

    def entry(state: dict, row: dict) -> tuple | None:
        if "last" in state and row["us"] - state["last"] <= step:
            return None
        state["last"] = row["us"]
        return (row["us"],)

    entries = folded(rows.select("seq_id", "us"), "us", dict, entry, "us long").withColumn("anchor_us", F.col("us"))
    return as_of(rows, entries, "anchor_us")
