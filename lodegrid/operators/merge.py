"""Greedy merges of boxes and memories of walls: small groups with a total order, one fold each."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = ["box_idx", "cx", "cy", "cz", "sx", "sy", "sz"]


def union_box(a: dict, b: dict) -> dict:
    lo = [min(a[f"c{c}"] - a[f"s{c}"] / 2, b[f"c{c}"] - b[f"s{c}"] / 2) for c in "xyz"]
    hi = [max(a[f"c{c}"] + a[f"s{c}"] / 2, b[f"c{c}"] + b[f"s{c}"] / 2) for c in "xyz"]
    return a | {f"c{c}": (h + o) / 2 for c, o, h in zip("xyz", lo, hi)} | {f"s{c}": h - o for c, o, h in zip("xyz", lo, hi)}


def merge_peers(boxes: list[dict], distance: float) -> list[dict]:
    """Larger boxes take in others whose centres are within the distance, until nothing changes; boxes of two different
    known tracks stay apart. The union has the track that either knows (-1: none) and moves if either does."""
    while distance > 0:
        boxes = sorted(boxes, key=lambda b: (-(b["sx"] * b["sy"] * b["sz"]), b["box_idx"]))
        kept: list[dict] = []
        for b in boxes:
            for i, k in enumerate(kept):
                apart = k.get("track_id", -1) >= 0 and b.get("track_id", -1) >= 0 and k["track_id"] != b["track_id"]
                if not apart and sum((k[f"c{c}"] - b[f"c{c}"]) ** 2 for c in "xyz") <= distance * distance:
                    kept[i] = union_box(k, b) | {"track_id": max(k.get("track_id", -1), b.get("track_id", -1)), "moves": k.get("moves", False) or b.get("moves", False)}
                    break
            else:
                kept.append(b)
        if len(kept) == len(boxes):
            return kept
        boxes = kept
    return boxes


def merged_peers(boxes: DataFrame, distance: float) -> DataFrame:
    """frame_id and the merged boxes of each frame, with track_id and moves where boxes have them, read frame by frame from a
    stream of Arrow batches."""
    more = [c for c in ("track_id", "moves") if c in boxes.columns]

    def merged(rows: list[dict]) -> pd.DataFrame:
        out = [(f, *[b[k] for k in (*BOX, *more)]) for f, part in groupby(rows, key=lambda r: r["frame_id"]) for b in merge_peers(list(part), distance)]
        return pd.DataFrame(out, columns=["frame_id", *BOX, *more])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for batch in batches:
            held += batch.to_dict("records")
            last = held[-1]["frame_id"] if held else None
            cut = next((i for i in range(len(held), 0, -1) if held[i - 1]["frame_id"] != last), 0)
            if cut:
                yield merged(held[:cut])
                held = held[cut:]
        if held:
            yield merged(held)

    schema = "frame_id long, box_idx long, cx double, cy double, cz double, sx double, sy double, sz double" + "".join(f", {c} {'long' if c == 'track_id' else 'boolean'}" for c in more)
    known = boxes.withColumns({c: F.coalesce(F.col(c), F.lit(-1).cast("long") if c == "track_id" else F.lit(False)) for c in more})
    return known.select("frame_id", *BOX, *more).repartition("frame_id").sortWithinPartitions("frame_id", "box_idx").mapInPandas(work, schema)


def obb_iou(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Of turned boxes (centre, size, 3x3 turn): 0 if one of the 15 axes parts them, else shared extents along a's axes."""
    (ca, sa, ra), (cb, sb, rb) = a, b
    axes = [*ra.T, *rb.T, *[np.cross(x, y) for x in ra.T for y in rb.T]]
    for axis in axes:
        if (n := np.linalg.norm(axis)) < 1e-9:
            continue
        axis = axis / n
        if abs((cb - ca) @ axis) > np.abs(ra.T @ axis) @ (sa / 2) + np.abs(rb.T @ axis) @ (sb / 2):
            return 0.0
    shared = 1.0
    for i, axis in enumerate(ra.T):
        reach = np.abs(rb.T @ axis) @ (sb / 2)
        d = (cb - ca) @ axis
        shared *= max(0.0, min(sa[i] / 2, d + reach) - max(-sa[i] / 2, d - reach))
    union = sa.prod() + sb.prod() - shared
    return float(shared / union) if union > 0 else 0.0


def aligned_iou(a: dict, b: dict) -> float:
    """obb_iou of boxes along the axes (cx..sz), in plain numbers: the same value."""
    shared = 1.0
    for c in "xyz":
        half_a, half_b, d = a["s" + c] / 2, b["s" + c] / 2, b["c" + c] - a["c" + c]
        if abs(d) > half_a + half_b:
            return 0.0
        shared *= max(0.0, min(half_a, d + half_b) - max(-half_a, d - half_b))
    union = a["sx"] * a["sy"] * a["sz"] + b["sx"] * b["sy"] * b["sz"] - shared
    return shared / union if union > 0 else 0.0


def remembered_walls(walls: DataFrame, centre: float = 5.0, alike: float = 0.9, least: float = 0.3, most_missed: int = 5) -> DataFrame:
    """walls (seq_id, frame_id, box_idx, box, nx, ny, nz: unit normal): which remembered wall each is. A wall joins the one
    of most overlap among those of like direction near by, which grows to hold both; one that isn't seen for most_missed
    frames goes."""

    def step(state: list[dict], frame: list[dict], next_id: int) -> tuple[list[dict], list[int], int]:
        out = []
        for w in frame:
            best, found = least, None
            for k in state:
                if (k["cx"] - w["cx"]) ** 2 + (k["cy"] - w["cy"]) ** 2 + (k["cz"] - w["cz"]) ** 2 > centre * centre or abs(k["nx"] * w["nx"] + k["ny"] * w["ny"] + k["nz"] * w["nz"]) < alike:
                    continue
                if (iou := aligned_iou(k, w)) > best:
                    best, found = iou, k
            if found is None:
                found = w | {"id": next_id}
                next_id += 1
                state.append(found)
            else:
                found.update({k: v for k, v in union_box(found, w).items() if k[0] in "cs"})
            found["missed"] = -1
            out.append(found["id"])
        for k in state:
            k["missed"] += 1
        return [k for k in state if k["missed"] <= most_missed], out, next_id

    from .motion import folded

    item = F.struct("box_idx", *BOX[1:], "nx", "ny", "nz")
    frames = walls.groupBy("seq_id", "frame_id").agg(F.array_sort(F.collect_list(item)).alias("all"))

    def one(s: dict, row: dict) -> tuple:
        s["state"], ids, s["next"] = step(s["state"], [w.asDict() if hasattr(w, "asDict") else dict(w) for w in row["all"]], s["next"])
        return row["frame_id"], [int(w["box_idx"]) for w in row["all"]], ids

    out = folded(frames, "frame_id", lambda: {"state": [], "next": 0}, one, "frame_id long, boxes array<bigint>, walls array<bigint>")
    return out.select("seq_id", "frame_id", F.explode(F.arrays_zip("boxes", "walls")).alias("e")).select("seq_id", "frame_id", F.col("e.boxes").alias("box_idx"), F.col("e.walls").alias("wall_id"))
