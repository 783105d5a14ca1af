"""What a scan's verdict takes from the scans before it: boxes are known by their tracks and voxels by their past.

Neighbours, clusters and matches of voxels are joins (plans/rejection.py); only what depends on the frame before is here, a
fold over the frames of a sequence that holds one frame, the tracks, and the verdicts of the last few frames."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import DRAWN
from .merge import merge_peers
from .moving import PERIOD, SCORE, overlap_of, track_step

#: Effective parameters of boxes and tracks; frames that must say the same before a track moves or is settled for good.
#: Fixed values.
BOXES = {"gate": 1.5, "alike": 0.2, "missed": 5, "suppress": 0.5, "peers": 2.0, "ratio": 0.3, "confirm": 3, "permanent": 10}
#: Rows of the fold: boxes (kind 0: centre at x, y, z, sides u, v, w) and voxels (kind 1: cell, mean; u, v, w: mean of the
#: voxel before, which is in the cell px, py, pz; fixed: wall, ground, outlier or too few points). Of the frame: stamp, in
#: seconds, and travel, the metres that the sensor moved since the frame before.
COLUMNS = ["seq_id", "frame_id", "stamp", "travel", "kind", "box_idx", "ix", "iy", "iz", "x", "y", "z", "u", "v", "w", "px", "py", "pz", "fixed", "is_wall"]
OUT = "seq_id long, frame_id long, ix long, iy long, iz long, score double, is_dynamic boolean"
AROUND = [s for s in product((-1, 0, 1), repeat=3) if any(s)]


def moves(track: dict, confirm: int) -> bool:
    """A settled track keeps what it is; another moves once it did for `confirm` frames in a row."""
    return track["locked"] if track.get("locked") is not None else track.get("run", 0) >= confirm


def labelled(boxes: list[dict], tracks: list[dict], p: dict) -> list[dict]:
    """Boxes with track_id (-1: none), moves and locked of the track that overlaps each most, within the gate; of equal
    overlaps, the older track. Tracks aren't changed."""
    out = []
    for b in boxes:
        near = [t for t in tracks if sum((t[f"c{c}"] - b[f"c{c}"]) ** 2 for c in "xyz") <= p["gate"] ** 2 and overlap_of(t, b) >= p["alike"]]
        t = max(near, key=lambda t: (overlap_of(t, b), -t["id"]), default=None)
        known = {"track_id": -1, "moves": False, "locked": False} if t is None else {"track_id": t["id"], "moves": moves(t, p["confirm"]), "locked": t.get("locked") is not None}
        out.append(b | known)
    return out


def unsuppressed(boxes: list[dict], most: float) -> list[dict]:
    """By falling volume, boxes that no kept one overlaps by more than `most`; two known tracks don't suppress each other."""
    kept: list[dict] = []
    for b in sorted(boxes, key=lambda b: (-(b["sx"] * b["sy"] * b["sz"]), b["box_idx"])):
        other = [k for k in kept if not (k["track_id"] >= 0 and b["track_id"] >= 0 and k["track_id"] != b["track_id"])]
        if all(overlap_of(k, b) <= most for k in other):
            kept.append(b)
    return kept


def inside(at: np.ndarray, b: dict) -> np.ndarray:
    return np.all([np.abs(at[:, i] - b[f"c{c}"]) <= b[f"s{c}"] / 2 for i, c in enumerate("xyz")], axis=0)


def reached(at: np.ndarray, b: dict, front: float = DRAWN["front"], rear: float = DRAWN["rear"], side: float = DRAWN["side"], most: float = DRAWN["most"], slow: float = DRAWN["slow"]) -> np.ndarray:
    """As geometry.in_inflated: an ellipse around the footprint, drawn out along the speed of the box's track."""
    speed = float(np.sqrt(b["vx"] * b["vx"] + b["vy"] * b["vy"]))
    ux, uy = (b["vx"] / speed, b["vy"] / speed) if speed > slow else (1.0, 0.0)
    used = min(speed, most) if speed > slow else 0.0
    dx, dy = at[:, 0] - (b["cx"] + ux * 0.5 * used * (front - rear)), at[:, 1] - (b["cy"] + uy * 0.5 * used * (front - rear))
    a = max((abs(ux) * (b["sx"] / 2) + abs(uy) * (b["sy"] / 2)) * 2**0.5 + 0.5 * used * (front + rear), 1e-6)
    across = max((abs(uy) * (b["sx"] / 2) + abs(ux) * (b["sy"] / 2)) * 2**0.5 + used * side, 1e-6)
    return (np.abs(at[:, 2] - b["cz"]) <= b["sz"] / 2) & (((dx * ux + dy * uy) / a) ** 2 + ((dy * ux - dx * uy) / across) ** 2 <= 1)


def any_of(at: np.ndarray, boxes: list[dict]) -> np.ndarray:
    """Which places are in any of the moving boxes or what these are drawn out to."""
    out = np.zeros(len(at), bool)
    for b in boxes:
        out |= inside(at, b) | reached(at, b)
    return out


def spread(at: np.ndarray, boxes: list[dict], moving: list[dict]) -> np.ndarray:
    """What the boxes say of each place: those that it is in decide alone; what moving ones are drawn out to counts elsewhere."""
    base, hit, drawn = (np.zeros(len(at), bool) for _ in range(3))
    for b in boxes:
        base |= inside(at, b)
    for b in moving:
        hit |= inside(at, b)
        drawn |= reached(at, b)
    return np.where(base, hit, drawn)


def score_of(fixed: np.ndarray, in_box: np.ndarray, shift: np.ndarray, share: np.ndarray, before: np.ndarray, res: float, p: dict, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Score and verdict of each voxel, as moving.scored; shift: NaN without a voxel before; share: of the frames of the
    past in which its cell was there and static."""
    score = np.where(in_box, p["w_cluster"], -p["w_cluster"] / 2) + p["w_shift"] * np.maximum(0.0, shift - p["min_shift"]) / res - p["w_history"] * share
    score = np.where(np.isnan(shift), np.where(in_box, p["threshold"] + 1, 0.0), score)
    tier = np.where(in_box, p["tier1"], np.where(before, p["memory"], p["free"]))
    score = np.where(fixed, 0.0, score)
    return score, ~fixed & (score > p["threshold"] * scale * tier)


def scan_step(state: dict, boxes: list[dict], vox: pd.DataFrame, res: float, depth: int, score: dict, p: dict, dt: float = PERIOD, travel: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Score and verdict of a frame's voxels: boxes are labelled by the tracks, suppressed, merged and tracked; voxels are
    scored, spread to their neighbours and overruled by the boxes; what the boxes did goes back to the tracks. The first
    frame of a sequence is kept as it is. A box has the flags of the track that it was matched to, a new track none.

    dt: seconds since the frame before; travel: metres that the sensor moved, by which all thresholds grow."""
    boxes = merge_peers(unsuppressed(labelled(boxes, state["tracks"], p), p["suppress"]), p["peers"])
    state["tracks"], found, state["next"] = track_step(state["tracks"], boxes, state["next"], p["gate"], p["alike"], p["missed"], dt)
    track = {t["id"]: t for t in state["tracks"]}
    of = {box: {"id": i, "vx": vx, "vy": vy, "moves": age > 1 and moves(track[i], p["confirm"]), "locked": age > 1 and track[i].get("locked") is not None} for box, i, age, vx, vy, _ in found}
    boxes = [b | of[b["box_idx"]] for b in boxes]
    scale = 1 + score["motion_scale"] * travel
    at = vox[["x", "y", "z"]].to_numpy(float)
    cells = list(zip(*(vox[c].tolist() for c in ("ix", "iy", "iz"))))
    fixed, wall, past = vox["fixed"].to_numpy(bool), vox["is_wall"].to_numpy(bool), state["past"]
    value, moving = np.zeros(len(vox)), np.zeros(len(vox), bool)
    if past:
        shift = np.sqrt(((at - vox[["u", "v", "w"]].to_numpy(float)) ** 2).sum(1))
        matched = list(zip(*(vox[c].tolist() for c in ("px", "py", "pz"))))
        before = np.fromiter((past[-1].get(c, False) for c in matched), bool, len(vox))
        looked = past[len(past) - (min(depth, len(past)) - 1) :]
        share = np.fromiter((sum(not m.get(c, True) for m in looked) for c in cells), float, len(vox)) / max(1, len(looked))
        value, moving = score_of(fixed, any_of(at, [b for b in boxes if b["moves"]]), shift, share, before, res, score, scale)
        lift: dict[tuple, int] = {}
        for x, y, z in (c for c, m in zip(cells, moving) if m):
            for dx, dy, dz in AROUND:
                near = (x + dx, y + dy, z + dz)
                lift[near] = lift.get(near, 0) + 1
        k = np.fromiter((lift.get(c, 0) for c in cells), float, len(vox))
        moving = moving | (~wall & (k >= 1) & (value + score["w_near"] * k > score["threshold"] * scale))
        seen = []
        for b in boxes:
            hit = inside(at, b)
            if hit.any():
                if not b["locked"]:
                    b["moves"] = bool(moving[hit].sum() > p["ratio"] * scale * hit.sum())
                seen += [b] if b["moves"] else []  # one without voxels rests
        if boxes:
            moving = np.where(wall, moving, spread(at, boxes, seen))
    said = {b["id"]: b["moves"] for b in boxes}
    for t in state["tracks"]:
        if t.get("locked") is not None:
            continue
        run, says = t.get("run", 0), said.get(t["id"])
        t["run"] = 0 if says is None else max(run, 0) + 1 if says else min(run, 0) - 1
        if abs(t["run"]) >= p["permanent"]:
            t["locked"] = t["run"] > 0
    state["past"] = [*past, dict(zip(cells, moving.tolist()))][-depth:]
    return value, moving


def whole_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one frame after another, of batches sorted by sequence and frame."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for _, part in batch.groupby(["seq_id", "frame_id"], sort=False):
            if held and (held[0]["seq_id"].iloc[0], held[0]["frame_id"].iloc[0]) != (part["seq_id"].iloc[0], part["frame_id"].iloc[0]):
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def judged(rows: DataFrame, res: float, depth: int = 5, score: dict | None = None, boxes: dict | None = None) -> DataFrame:
    """Score and verdict of the voxels among the rows (COLUMNS), sequence by sequence; sequences are independent."""
    score, p = {"w_near": 0.1} | SCORE | (score or {}), BOXES | (boxes or {})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for frame in whole_frames(batches):
            seq, frame_id = frame["seq_id"].iloc[0], frame["frame_id"].iloc[0]
            stamp, travel = float(frame["stamp"].iloc[0]), float(frame["travel"].iloc[0])
            if state.get("seq") != seq:
                state = {"seq": seq, "tracks": [], "next": 0, "past": [], "stamp": stamp}
            vox = frame[frame["kind"] == 1]
            found = [{"box_idx": int(r[0])} | dict(zip(("cx", "cy", "cz", "sx", "sy", "sz"), r[1:])) for r in frame.loc[frame["kind"] == 0, ["box_idx", "x", "y", "z", "u", "v", "w"]].itertuples(index=False)]
            value, moving = scan_step(state, found, vox, res, depth, score, p, stamp - state["stamp"], travel)
            state["stamp"] = stamp
            yield pd.DataFrame({"seq_id": seq, "frame_id": frame_id, "ix": vox["ix"], "iy": vox["iy"], "iz": vox["iz"], "score": value, "is_dynamic": moving})

    given = rows.withColumns({c: v for c, v in {"stamp": F.col("frame_id") * PERIOD, "travel": F.lit(0.0)}.items() if c not in rows.columns})
    return given.select(*COLUMNS).repartition("seq_id").sortWithinPartitions("seq_id", "frame_id", "kind", "box_idx", "ix", "iy", "iz").mapInPandas(work, OUT)
