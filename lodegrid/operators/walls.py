"""A registry of walls over a recording: its boxes move by each frame's pose, grow by what is found, mark voxels, and go."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values, as the shipped settings have them.
OVERLAP, ALIKE, CENTRE = 0.3, 0.9, 5.0
POSE, WALL, VOXEL = 0, 1, 2
NEXT, LAST = [1, 2, 0], [2, 0, 1]
#: Places in boxes that are looked at at once.
AT_ONCE = 1 << 16
EYE = np.eye(3)
CORNERS = np.array(list(product((-0.5, 0.5), repeat=3)))
OUT = "seq_id long, frame_id long, kind string, voxel_id long, wall_id long, is_wall boolean, cx double, cy double, cz double, sx double, sy double, sz double, turn array<double>, missed int"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


@dataclass
class Wall:
    """A turned box: its first axis is the wall's normal."""

    id: int
    centre: np.ndarray
    size: np.ndarray
    turn: np.ndarray
    missed: int = 0
    touched: bool = False
    plain: tuple | None = None

    def moved(self, pose: np.ndarray, turns: bool = True) -> None:
        self.centre, self.turn, self.plain = (pose[:3, :3] @ self.centre if turns else self.centre) + pose[:3, 3], pose[:3, :3] @ self.turn if turns else self.turn, None

    def numbers(self) -> tuple:
        """Centre, radius and normal as plain numbers, which are compared far faster than arrays of three."""
        if self.plain is None:
            x, y, z = self.size.tolist()
            self.plain = (*self.centre.tolist(), (x * x + y * y + z * z) ** 0.5 / 2, *self.turn[:, 0].tolist())
        return self.plain

    def holds(self, points: np.ndarray) -> np.ndarray:
        return (np.abs((points - self.centre) @ self.turn) <= self.size / 2).all(axis=1)

    def grown(self, other: Wall) -> None:
        """To hold the other one too, along its own axes."""
        local = (other.centre + (CORNERS * other.size) @ other.turn.T - self.centre) @ self.turn
        lo, hi = np.minimum(local.min(axis=0), -self.size / 2), np.maximum(local.max(axis=0), self.size / 2)
        self.centre, self.size, self.plain = self.centre + self.turn @ ((lo + hi) / 2), hi - lo, None


def reach(w: Wall, axes: np.ndarray) -> np.ndarray:
    """Half of the box's extent along each of the axes (rows)."""
    return np.abs(axes @ w.turn) @ (w.size / 2)


def overlap(a: Wall, b: Wall) -> float:
    """Shared volume over joint volume. 0 if one of the 15 axes parts the boxes; the shared volume is the product of the
    overlaps along a's axes (sum of the half extents less the distance of the centres, a's extent at most)."""
    volumes = a.size.prod(), b.size.prod()
    if min(volumes) < 1e-9:
        return 0.0
    x, y = a.turn.T.repeat(3, 0), np.tile(b.turn.T, (3, 1))
    crossed = x[:, NEXT] * y[:, LAST] - x[:, LAST] * y[:, NEXT]
    length = np.sqrt((crossed * crossed).sum(1))
    axes = np.concatenate([a.turn.T, b.turn.T, crossed[length > 1e-6] / length[length > 1e-6, None]])
    shared = reach(a, axes) + reach(b, axes) - np.abs(axes @ (b.centre - a.centre))
    if (shared <= 0).any():
        return 0.0
    volume = float(np.minimum(shared[:3], a.size).prod())
    return volume / (sum(volumes) - volume + 1e-9)


class Registry:
    """The walls of one recording; a frame is moved(), seen() once a wall, marked() for any number of voxels, then ended()."""

    def __init__(self, most_missed: int | None):
        self.walls: list[Wall] = []
        self.next_id, self.most_missed = 0, most_missed
        self.old: list[Wall] = []
        self.met: set[int] = set()

    def begun(self, pose: np.ndarray | None) -> None:
        if pose is not None:
            turns = not np.array_equal(pose[:3, :3], EYE)
            for w in self.walls:
                w.moved(pose, turns)
        self.old, self.met = list(self.walls), set()
        for w in self.walls:
            w.touched = False

    def seen(self, found: Wall) -> None:
        """It joins the wall of before this frame that it overlaps most, of those with a like normal near by; else it is new."""
        if not found.size.any():
            return
        best, most = None, OVERLAP
        x, y, z, r, nx, ny, nz = found.numbers()
        for w in self.old:
            wx, wy, wz, wr, wnx, wny, wnz = w.plain or w.numbers()
            far = min(CENTRE, wr + r)
            if (wx - x) * (wx - x) + (wy - y) * (wy - y) + (wz - z) * (wz - z) > far * far or abs(wnx * nx + wny * ny + wnz * nz) < ALIKE:
                continue
            if (share := overlap(w, found)) > most:
                best, most = w, share
        if best is None:
            found.id, self.next_id = self.next_id, self.next_id + 1
            self.walls.append(found)
        else:
            best.grown(found)
            best.missed = 0
            self.met.add(best.id)

    def expired(self) -> None:
        """After the frame's walls, before its voxels: walls that weren't met for too many frames go."""
        if self.most_missed is not None:
            for w in self.old:
                w.missed += w.id not in self.met
            self.walls = [w for w in self.walls if w.missed <= self.most_missed]

    def marked(self, points: np.ndarray, is_wall: np.ndarray) -> np.ndarray:
        """The first wall that holds each point (-1: none); points that are walls already aren't looked at."""
        ids = np.full(len(points), -1)
        if 0 < len(points) * len(self.walls) <= AT_ONCE:
            centre, size, turn = (np.array([getattr(w, c) for w in self.walls]) for c in ("centre", "size", "turn"))
            hit = (np.abs((points - centre[:, None]) @ turn) <= size[:, None] / 2).all(axis=2)
            hit[:, is_wall] = False
            first = hit.argmax(axis=0)
            for k in np.flatnonzero(hit.any(axis=0)).tolist():
                w = self.walls[first[k]]
                w.touched, ids[k] = True, w.id
            return ids
        for w in self.walls:
            hit = (ids < 0) & ~is_wall & w.holds(points)
            w.touched |= bool(hit.any())
            ids[hit] = w.id
        return ids

    def ended(self) -> None:
        self.walls = [w for w in self.walls if w.touched]


def registered(frames: DataFrame, walls: DataFrame, voxels: DataFrame, most_missed: int | None = None, left: bool = True) -> DataFrame:
    """What a registry of walls does to each recording (seq_id), frame by frame.

    frames: seq_id, frame_id, pose (16 numbers row by row, that bring the frame before's coordinates to this one's; null:
    none); walls: seq_id, frame_id, box_idx, cx..sz, turn (9 numbers row by row; null: none); voxels: seq_id, frame_id,
    voxel_id, mx, my, mz, is_wall (null: false). Walls and voxels of frames that aren't listed are taken without a motion.

    In a frame the known walls move, found ones (by box_idx) join or are added, walls missed in over most_missed frames go
    (null: never), each voxel is marked by the first wall that holds it, and walls that mark none go. Returns rows of kind
    voxel (every voxel, wall_id null where none marks it) and, if asked for, of kind wall (those left after each frame). Rows come as a
    sorted stream of Arrow batches: a task holds the walls of one recording and a batch of voxels, however many there are."""
    no, nine = F.lit(None).cast("double"), F.lit(None).cast("array<double>")
    shape = ["seq_id", "frame_id", "kind", "id", "x", "y", "z", "sx", "sy", "sz", "turn", "is_wall"]

    def like(df: DataFrame, kind: int, row_id, xyz, size, turn, flag) -> DataFrame:
        values = [F.lit(kind), row_id, *xyz, *size, turn, flag]
        return df.select("seq_id", "frame_id", *[v.alias(n) for v, n in zip(values, shape[2:])])

    zero, false = F.lit(0).cast("long"), F.lit(False)
    rows = like(frames, POSE, zero, [no] * 3, [no] * 3, F.col("pose").cast("array<double>"), false)
    rows = rows.unionByName(like(walls, WALL, F.col("box_idx").cast("long"), [F.col(f"c{c}").cast("double") for c in "xyz"], [F.col(f"s{c}").cast("double") for c in "xyz"], F.col("turn").cast("array<double>"), false))
    rows = rows.unionByName(like(voxels, VOXEL, F.col("voxel_id").cast("long"), [F.col(f"m{c}").cast("double") for c in "xyz"], [no] * 3, nine, F.coalesce("is_wall", false)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq = frame = part = None
        registry = Registry(most_missed)

        def closed() -> list[tuple]:
            if frame is None:
                return []
            if part < VOXEL:
                registry.expired()
            registry.ended()
            return [] if not left else [(seq, frame, "wall", None, w.id, None, *w.centre.tolist(), *w.size.tolist(), w.turn.ravel().tolist(), w.missed) for w in registry.walls]

        def told(seen: list[tuple], ended: list[tuple]) -> pd.DataFrame:
            """Voxels (seq_id, frame_id, voxel_id, wall_id, is_wall: arrays, a part of a frame each) and walls as rows of OUT."""
            parts = []
            if seen:
                s, f, v, i, b = (np.concatenate(c) for c in zip(*seen))
                parts.append(pd.DataFrame({"seq_id": s, "frame_id": f, "kind": "voxel", "voxel_id": pd.array(v, "Int64"), "wall_id": pd.arrays.IntegerArray(i, i < 0), "is_wall": b | (i >= 0), "turn": None}))
            if ended or not seen:
                parts.append(pd.DataFrame(ended, columns=COLUMNS).astype({"voxel_id": "Int64", "wall_id": "Int64", "missed": "Int32"}))
            out = parts[0] if len(parts) == 1 else pd.concat(parts)
            return out.reindex(columns=COLUMNS)

        for batch in batches:
            seen, out = [], []
            keys = batch[["seq_id", "frame_id", "kind"]].to_numpy()
            place, sizes, was = batch[["x", "y", "z"]].to_numpy(float), batch[["sx", "sy", "sz"]].to_numpy(float), batch["is_wall"].to_numpy(bool)
            ids, turns = batch["id"].to_numpy(), batch["turn"].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                s, f, kind = keys[start].tolist()
                if (s, f) != (seq, frame):
                    out += closed()
                    if s != seq:
                        registry = Registry(most_missed)
                    seq, frame, part = s, f, POSE
                    pose = next((p for p in turns[start:end] if p is not None), None) if kind == POSE else None
                    registry.begun(None if pose is None else np.array(pose, dtype=float).reshape(4, 4))
                if kind == WALL:
                    for k in range(start, end):
                        registry.seen(Wall(-1, place[k], sizes[k], EYE if turns[k] is None else np.array(turns[k], dtype=float).reshape(3, 3)))
                elif kind == VOXEL:
                    if part < VOXEL:
                        registry.expired()
                    found = registry.marked(place[start:end], was[start:end])
                    seen.append((keys[start:end, 0], keys[start:end, 1], ids[start:end], found, was[start:end]))
                part = kind
            yield told(seen, out)
        yield told([], closed())

    sound = rows.where("seq_id IS NOT NULL AND frame_id IS NOT NULL")
    return sound.repartition("seq_id").sortWithinPartitions("seq_id", "frame_id", "kind", "id", "x", "y", "z").mapInPandas(work, OUT)
