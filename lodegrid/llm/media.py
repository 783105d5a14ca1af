"""Media columns: local image descriptors that find cropped or edited copies.

Corners at several scales, each with 256 binary tests turned to the corner's orientation, describe an image. Queries and
images meet in Hamming tables: the tests are in eight groups of 32, and a descriptor within the radius of a query's differs
from it in no more tests of some group than that group's threshold. Each threshold is 0 or 1, and queries also look up the
values of a group with one test turned. What meets and is within the radius is a match: every pair within it is found. Each match gives a scale, a turn and a shift; matches of a pair of images that agree in these are a
geometric consensus. Pixels are worked on in numpy inside tasks; tables, matches and votes are joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, read

#: Ratio of the scales' sides and least side of one; pixels of a scale for each corner that is kept; reach of a test, in pixels.
RATIO, LEAST_SIDE, AREA, REACH = 0.75, 40, 300, 9
#: Tests that two matching descriptors differ in at most; matches that agree, for a copy; queries: ids divisible by this.
RADIUS, VOTES, QUERY_EVERY = 12, 3, 50
TESTS, TURNS, TABLES = 256, 32, 8
_RNG = np.random.default_rng(256)
_FAR, _WAY = REACH * np.sqrt(_RNG.random((TESTS, 2))), 2 * np.pi * _RNG.random((TESTS, 2))
_POINTS = np.stack([_FAR * np.cos(_WAY), _FAR * np.sin(_WAY)], 2)


def _turned() -> np.ndarray:
    angle = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(angle), -np.sin(angle)], 1), np.stack([np.sin(angle), np.cos(angle)], 1)], 1)
    return np.rint(np.einsum("tij,nkj->tnki", turn, _POINTS)).astype(np.int64)  # (turn, test, end, xy)


_TURNED = _turned()


def box_mean(images: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r + 1) squared pixels, edges repeated."""
    padded = np.pad(images, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").astype(np.float64)
    total = padded.cumsum(1).cumsum(2)
    k = 2 * r + 1
    return (total[:, k:, k:] - total[:, :-k, k:] - total[:, k:, :-k] + total[:, :-k, :-k]) / k**2


def resized(images: np.ndarray, factor: float) -> np.ndarray:
    if factor == 1:
        return images
    side = [max(1, int(n * factor)) for n in images.shape[1:]]
    at = [np.clip((np.arange(m) + 0.5) / factor - 0.5, 0, n - 1) for m, n in zip(side, images.shape[1:])]
    lo = [a.astype(np.int64) for a in at]
    hi = [np.minimum(a + 1, n - 1) for a, n in zip(lo, images.shape[1:])]
    wy, wx = (at[0] - lo[0])[None, :, None], (at[1] - lo[1])[None, None, :]
    rows = images[:, lo[0]] * (1 - wy) + images[:, hi[0]] * wy
    return rows[:, :, lo[1]] * (1 - wx) + rows[:, :, hi[1]] * wx


def scales_of(height: int, width: int) -> list[float]:
    """Factors of the scales: each smaller by RATIO, down to the least side; larger images have more."""
    out = [1.0]
    while min(height, width) * out[-1] * RATIO >= LEAST_SIDE:
        out.append(out[-1] * RATIO)
    return out


def described(images: np.ndarray) -> dict[str, np.ndarray]:
    """Corners of (n, height, width) images: row, x, y, scale, angle (turns of a circle / TURNS), code (4 x 64 bits).

    The strongest corners of each scale, one for AREA of its pixels; of equally strong ones, the upper, then the left."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "x", "y", "scale", "angle", "code")}
    edge = int(REACH * 2**0.5) + 2  # a turned test reaches over the corners of its square
    for factor in scales_of(*images.shape[1:]):
        small = resized(images.astype(np.float64), factor)
        n, height, width = small.shape
        corners = max(1, height * width // AREA)
        if min(height, width) <= 2 * edge + 2:
            continue
        smooth = box_mean(small, 1)  # even areas stay even but for rounding, which the tests below leave a margin for
        dy, dx = np.gradient(smooth, axis=(1, 2))
        a, b, c = box_mean(dx * dx, 2), box_mean(dy * dy, 2), box_mean(dx * dy, 2)
        strength = a * b - c * c - 0.05 * (a + b) ** 2
        core = strength[:, edge:-edge, edge:-edge]
        peak = core > 1e-3
        for sy in (-1, 0, 1):
            for sx in (-1, 0, 1):
                if sy or sx:
                    other = strength[:, edge + sy : height - edge + sy, edge + sx : width - edge + sx]
                    peak &= core > other if (sy, sx) > (0, 0) else core >= other
        row, y, x = np.nonzero(peak)
        order = np.lexsort((x, y, -core[row, y, x], row))
        row, y, x = row[order], y[order] + edge, x[order] + edge
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, y, x = row[rank < corners], y[rank < corners], x[rank < corners]
        span = np.arange(-REACH, REACH + 1)
        oy, ox = (g.ravel() for g in np.meshgrid(span, span, indexing="ij"))
        disc = oy**2 + ox**2 <= REACH**2
        oy, ox = oy[disc], ox[disc]
        patch = smooth[row[:, None], y[:, None] + oy, x[:, None] + ox]
        turn = np.rint(np.arctan2(patch @ oy, patch @ ox) / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
        ends = _TURNED[turn]
        values = smooth[row[:, None, None], y[:, None, None] + ends[..., 1], x[:, None, None] + ends[..., 0]]
        code = np.packbits(values[:, :, 0] < values[:, :, 1] - 0.5, axis=1, bitorder="little").view(np.int64)
        for k, v in (("row", row), ("x", (x + 0.5) / factor), ("y", (y + 0.5) / factor), ("scale", np.full(len(row), 1 / factor)), ("angle", turn), ("code", code)):
            out[k].append(v)
    empty = {"code": np.zeros((0, 4), np.int64)}
    return {k: np.concatenate(v) if v else empty.get(k, np.zeros(0)) for k, v in out.items()}


def descriptors(images: DataFrame) -> DataFrame:
    """image_id, x, y, scale, angle, code: images has image_id, height, width, pixels (binary, one byte each, by rows).

    Images whose pixels don't fill their sides, nulls included, have no descriptors; an image without an id has such without."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sides = batch.column("image_id"), list(zip(batch.column("height").to_pylist(), batch.column("width").to_pylist()))
            pixels = batch.column("pixels").to_pylist()
            good = [i for i, ((h, w), p) in enumerate(zip(sides, pixels)) if h and w and p is not None and len(p) == h * w]
            for side in sorted({sides[i] for i in good}):
                same = [i for i in good if sides[i] == side]
                for at in range(0, len(same), 32):
                    part = same[at : at + 32]
                    found = described(np.stack([np.frombuffer(pixels[i], np.uint8).reshape(side) for i in part]))
                    cols = {"image_id": ids.take(pa.array(np.asarray(part)[found["row"].astype(np.int64)]))}
                    cols |= {k: pa.array(found[k].astype(np.float64)) for k in ("x", "y", "scale")} | {"angle": pa.array(found["angle"].astype(np.int32))}
                    yield pa.record_batch(cols | {"code": pa.array(list(found["code"]), pa.list_(pa.int64()))})

    return images.select("image_id", "height", "width", "pixels").mapInArrow(work, "image_id long, x double, y double, scale double, angle int, code array<long>")


def thresholds(radius: int, tables: int = TABLES) -> list[int]:
    """Each table's threshold: they add up to radius - tables + 1, so a pair within the radius is within one of them."""
    if not tables - 1 <= radius < 2 * tables:
        raise ValueError("so many tables have thresholds of 0 and 1 for a radius from tables - 1 to 2 * tables - 1 only")
    return [int(t < radius - tables + 1) for t in range(tables)]


def matches(queries: DataFrame, images: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of descriptors (q and d structs) within the radius; a pair that meets in several tables comes from the first."""
    most = thresholds(radius)
    part = lambda code, t: F.shiftright(code[t // 2], 32 * (t % 2)).bitwiseAND(F.lit(0xFFFFFFFF))

    def table(rows: DataFrame, name: str, turned: bool) -> DataFrame:
        turns = [(t, m) for t in range(TABLES) for m in (0, *(1 << b for b in range(32) if turned and most[t]))]
        lead = F.array(*[F.struct(F.lit(t).alias("t"), part(F.col("code"), t).bitwiseXOR(F.lit(m).cast("long")).alias("lead")) for t, m in turns])
        return rows.select(F.struct("image_id", "x", "y", "scale", "angle", "code").alias(name), F.explode(lead).alias("e")).select(name, F.col("e.t").alias(f"{name}_t"), F.col("e.lead").alias(f"{name}_lead"))

    apart = [F.col("q.code")[k].bitwiseXOR(F.col("d.code")[k]) for k in range(4)]
    within = [F.when(F.bit_count(part(apart, t)) <= most[t], t) for t in range(TABLES)]
    distance = sum((F.bit_count(a) for a in apart[1:]), F.bit_count(apart[0]))
    on = (F.col("q_t") == F.col("d_t")) & (F.col("q_lead") == F.col("d_lead")) & (distance <= radius) & (F.coalesce(*within) == F.col("q_t"))
    return table(queries, "q", True).join(table(images, "d", False), on).select("q", "d")


def consensus(matched: DataFrame, votes: int = VOTES) -> DataFrame:
    """query_id, image_id, votes: pairs of images of whose matches at least `votes` agree in scale, turn and shift.

    A match votes for the cell of its transform and, as it may be near a limit, for the neighbouring shifts' cells."""
    s = F.round(F.log2(F.col("q.scale") / F.col("d.scale")) * 2).cast("int")
    r = F.pmod(F.floor((F.pmod(F.col("q.angle") - F.col("d.angle"), F.lit(TURNS)) + 2) / 4).cast("int"), F.lit(TURNS // 4))
    factor, angle = F.pow(F.lit(2.0), s / 2), r * (8 * np.pi / TURNS)  # of the cell, so that its matches' shifts agree
    dx = F.col("q.x") - factor * (F.cos(angle) * F.col("d.x") - F.sin(angle) * F.col("d.y"))
    dy = F.col("q.y") - factor * (F.sin(angle) * F.col("d.x") + F.cos(angle) * F.col("d.y"))
    cell = lambda v: F.floor(v / 4).cast("long")
    seen = matched.select(F.col("q.image_id").alias("query_id"), F.col("d.image_id").alias("image_id"), F.col("d.x").alias("x"), F.col("d.y").alias("y"), s.alias("s"), r.alias("r"), cell(dx).alias("cx"), cell(dy).alias("cy"))
    # Pairs of images with too few matches at all go first; a pair has at most corners x corners of one picture, so its list is bounded by their areas.
    match = F.struct("x", "y", "s", "r", "cx", "cy")
    per = seen.groupBy("query_id", "image_id").agg(F.collect_set(match).alias("all")).where(F.size("all") >= votes)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    each = per.select("query_id", "image_id", F.explode("all").alias("m")).select("query_id", "image_id", "m.*").withColumn("o", F.explode(steps))
    each = each.select("query_id", "image_id", "s", "r", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), F.struct("x", "y").alias("corner"))
    cells = each.distinct().groupBy("query_id", "image_id", "s", "r", "cx", "cy").agg(F.count(F.lit(1)).alias("votes"))
    return cells.groupBy("query_id", "image_id").agg(F.max("votes").alias("votes")).where(F.col("votes") >= votes)


SIDE = 72


def drawn(vectors: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A picture of (n, 64) numbers: waves whose phases and strengths they give, under twelve half-transparent boxes, whose
    places, sides and shades they give."""
    raw = np.nan_to_num(vectors.astype(np.float64)) * 8
    v = 1 / (1 + np.exp(-raw[:, :60].reshape(len(vectors), 12, 5)))
    y, x = np.arange(side)[None, :, None], np.arange(side)[None, None, :]
    out = np.full((len(vectors), side, side), 128.0)
    for k in range(16):
        p, q, strength, phase = (raw[:, 4 * k + j][:, None, None] for j in range(4))
        out += 14 * strength * np.sin((x * p + y * q) * 0.35 + 3 * phase)
    for k in range(12):
        cx, cy, w, h, shade = (v[:, k, j][:, None, None] for j in range(5))
        inside = (np.abs(x - side * cx) < 3 + 9 * w) & (np.abs(y - side * cy) < 3 + 9 * h)
        out = np.where(inside, 0.5 * out + 128 * shade, out)
    return np.clip(out, 0, 255).astype(np.uint8)


def edited(images: np.ndarray) -> np.ndarray:
    """A crop, lighter and with less contrast."""
    return (images[:, 5:-7, 6:-6].astype(np.float64) * 0.8 + 30).astype(np.uint8)


def pictures(vectors: DataFrame, change: bool = False) -> DataFrame:
    """image_id, height, width, pixels of vec_id, embedding; vectors of another length than 64, or null, have null pixels."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = part.column("embedding").to_pylist()
                good = [i for i, v in enumerate(values) if v is not None and len(v) == 64 and None not in v]
                pixels: list[bytes | None] = [None] * len(values)
                shape = (0, 0)
                if good:
                    made = drawn(np.asarray([values[i] for i in good]))
                    made = edited(made) if change else made
                    shape = made.shape[1:]
                    for i, m in zip(good, made):
                        pixels[i] = m.tobytes()
                n = len(values)
                yield pa.record_batch({"image_id": part.column("image_id"), "height": pa.array([shape[0]] * n, pa.int32()), "width": pa.array([shape[1]] * n, pa.int32()), "pixels": pa.array(pixels, pa.binary())})

    return vectors.select(F.col("vec_id").alias("image_id"), "embedding").mapInArrow(work, "image_id long, height int, width int, pixels binary")


def op5_image_copies(spark, sf_dir: str) -> DataFrame:
    """Draws every vector of embeddings as a picture and looks crops of those whose id is divisible by 50 up among all.

    Equal pictures are one class, called by its smallest id. vec_id, class_id, n_corners, and for queries n_found (classes
    with a consensus), found (their ids, ascending) and votes (of its own class; 0 where it wasn't found); else nulls."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = vectors.withColumn("key", F.xxhash64("embedding"))
    of_class = rows.groupBy("key").agg(F.min("vec_id").alias("class_id"))
    reps = rows.join(of_class, (rows["key"] == of_class["key"]) & (rows["vec_id"] == of_class["class_id"]), "left_semi").dropDuplicates(["vec_id"])
    codes = checkpointed(descriptors(pictures(reps)))
    asked = F.col("vec_id") % QUERY_EVERY == 0
    found = consensus(matches(descriptors(pictures(rows.where(asked), change=True)), codes))
    corners = codes.groupBy(F.col("image_id").alias("class_id")).agg(F.count(F.lit(1)).alias("n_corners"))
    named = rows.select("vec_id", "key").join(of_class, "key").join(corners, "class_id", "left").withColumn("n_corners", F.coalesce("n_corners", F.lit(0)))
    of_query = found.groupBy(F.col("query_id")).agg(F.sort_array(F.collect_list(F.struct("image_id", "votes"))).alias("hits"))
    out = named.join(of_query, F.col("vec_id") == F.col("query_id"), "left")
    hits = F.coalesce("hits", F.array().cast("array<struct<image_id:bigint,votes:bigint>>"))
    own = F.coalesce(F.get(F.filter(hits, lambda h: h["image_id"] == F.col("class_id")), F.lit(0))["votes"], F.lit(0))
    only = lambda c: F.when(asked, c)
    return out.select("vec_id", "class_id", "n_corners", only(F.size(hits).cast("long")).alias("n_found"), only(F.transform(hits, lambda h: h["image_id"])).alias("found"), only(own).alias("votes"))
