"""The time and tracking operators as structured streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.moving import stamped, track_step

#: Rows that a step gives at once.
CHUNK = 65536

BOX = ["frame_id", "box_idx", "cx", "cy", "cz", "sx", "sy", "sz"]


def released_scans(scans: DataFrame, samples: DataFrame, late: str = "10 seconds", ahead: str = "10 seconds") -> DataFrame:
    """Scans (seq_id, id, stamp) joined to the inertial samples that come within `ahead` of them, both with watermarks: a scan
    goes on once such a sample is there. Inner join in append mode, so state is dropped as the watermark passes."""
    a = scans.withWatermark("stamp", late)
    b = samples.select(F.col("seq_id").alias("s_seq"), F.col("stamp").alias("s_stamp")).withWatermark("s_stamp", late)
    on = (F.col("seq_id") == F.col("s_seq")) & (F.col("s_stamp") >= F.col("stamp")) & (F.col("s_stamp") <= F.col("stamp") + F.expr(f"INTERVAL {ahead}"))
    return a.join(b, on).select("seq_id", "id", "stamp", F.col("s_stamp").alias("released_by"))


def accepted_stamps(rows: DataFrame) -> DataFrame:
    """seq_id, id, us, accepted: rewinds are rejected in order of arrival (by id within a micro-batch); the state is the last
    accepted stamp; without a stamp, neither. A sequence comes in chunks that aren't sorted among each other, so two numbers a row of it are held."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        ids, stamps = (np.concatenate(c) for c in zip(*[(b["id"].to_numpy(), b["us"].to_numpy()) for b in batches]))
        order = np.argsort(ids, kind="stable")
        ids, stamps = ids[order], stamps[order]
        before = np.fmax.accumulate(np.concatenate([[max(last, 0)], stamps]))
        ok = stamps >= before[:-1]
        state.update((int(before[-1]) if last >= 0 or ok.any() else last,))
        none = np.isnan(stamps.astype(float))
        ok, stamps = pd.array(np.where(none, None, ok), "boolean"), pd.array(np.where(none, None, stamps), "Int64") if none.any() else stamps
        for k in range(0, len(ids), CHUNK):
            yield pd.DataFrame({"seq_id": key[0], "id": ids[k : k + CHUNK], "us": stamps[k : k + CHUNK], "accepted": ok[k : k + CHUNK]})

    return rows.groupBy("seq_id").applyInPandasWithState(step, "seq_id long, id long, us long, accepted boolean", "last long", "append", "NoTimeout")


def tracked_boxes(boxes: DataFrame, gate: float = 1.5, least: float = 0.2, most_missed: int = 5) -> DataFrame:
    """The tracker over a stream of boxes (seq_id, frame_id, ...): the same step as in batch; the state is the live tracks."""
    names = ["id", "age", "missed", "vx", "vy", "vz", "cx", "cy", "cz", "sx", "sy", "sz"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_id, last, *held = state.get if state.exists else (0, None, *[[] for _ in names])
        tracks = [dict(zip(names, t)) for t in zip(*held)]
        for t in tracks:
            t |= {k: int(t[k]) for k in ("id", "age", "missed")}
        rows = pd.concat(list(batches))
        out = []
        for frame_id, part in rows.groupby("frame_id", sort=True):
            stamp = float(part["stamp"].iloc[0])
            tracks, found, next_id = track_step(tracks, part.sort_values("box_idx").to_dict("records"), next_id, gate, least, most_missed, 0.0 if last is None else stamp - last)
            last = stamp
            out += [(key[0], frame_id, *f) for f in found]
        state.update((int(next_id), last, *[[float(t[n]) for t in tracks] for n in names]))
        yield pd.DataFrame(out, columns=["seq_id", "frame_id", "box_idx", "track_id", "age", "vx", "vy", "vz"])

    schema = "next_id long, last double, " + ", ".join(f"{n} array<double>" for n in names)
    return stamped(boxes).select("seq_id", "stamp", *BOX).groupBy("seq_id").applyInPandasWithState(step, "seq_id long, frame_id long, box_idx long, track_id long, age long, vx double, vy double, vz double", schema, "append", "NoTimeout")


def static_counts(points: DataFrame, res: float, late: str = "10 seconds", window: str = "1 second") -> DataFrame:
    """Points per window and cell of a stream (stamp, x, y, z), emitted as the watermark passes."""
    from ..operators.cloud import CELL, with_cell

    celled = with_cell(points.withWatermark("stamp", late), res)
    return celled.groupBy(F.window("stamp", window).alias("w"), *CELL).agg(F.count(F.lit(1)).alias("n")).select("w.start", *CELL, "n")


class Hooks:
    """Functions of the user on named stages, each from a DataFrame to one; modules register under a name."""

    def __init__(self) -> None:
        self.stages: dict[str, dict[int, Callable[[DataFrame], DataFrame]]] = {}
        self.modules: dict[str, Callable] = {}
        self._next = 0

    def add(self, stage: str, f: Callable[[DataFrame], DataFrame]) -> int:
        self._next += 1
        self.stages.setdefault(stage, {})[self._next] = f
        return self._next

    def remove(self, stage: str, number: int) -> None:
        self.stages.get(stage, {}).pop(number, None)

    def apply(self, stage: str, df: DataFrame) -> DataFrame:
        for f in self.stages.get(stage, {}).values():
            df = f(df)
        return df

    def register(self, name: str, make: Callable) -> None:
        self.modules[name] = make

    def load(self, name: str, *args, **kwargs):
        if name not in self.modules:
            raise KeyError(f"no module {name}; there are {sorted(self.modules)}")
        return self.modules[name](*args, **kwargs)
