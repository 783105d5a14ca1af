"""Ground, walls and planes."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Vec, cross, dot, eigen3, eigenvector3, in_box, minus, norm2, plane_of, vec


def polar_cells(voxels: DataFrame, sectors: int = 36, ring: float = 2.0, most: float = 60.0) -> DataFrame:
    """voxels (mx, my, mz) with sector and ring around the origin, within `most`."""
    r = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my"))
    angle = F.atan2("my", "mx")
    turn = F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)
    sector = F.least(F.floor(turn / (2 * math.pi / sectors)), F.lit(sectors - 1)).cast("long")
    return voxels.withColumns({"sector": sector, "ring": F.floor(r / ring).cast("long")}).where(r < most)


def cell_statistics(cells: DataFrame, lowest: int = 3, spread: float = 0.5, flat: float = 0.1) -> DataFrame:
    """Per frame, sector and ring with at least three voxels: n, z_min, z_max, mean of the k lowest, and score: of spread,
    mean height over the lowest and variance about the low mean, how many are small; valid: two of them, and a small spread."""
    z = F.array_sort(F.collect_list("mz"))
    per = cells.groupBy("frame_id", "sector", "ring").agg(F.count(F.lit(1)).alias("n"), z.alias("z")).where("n >= 3")
    low = F.slice("z", 1, lowest)
    per = per.withColumns({"z_min": F.col("z")[0], "z_max": F.element_at("z", -1), "low_mean": F.aggregate(low, F.lit(0.0), lambda a, v: a + v) / F.size(low)})
    variance = F.aggregate("z", F.lit(0.0), lambda a, v: a + (v - F.col("low_mean")) * (v - F.col("low_mean"))) / F.col("n")
    per = per.withColumns({"spread": F.col("z_max") - F.col("z_min"), "variance": variance})
    score = (F.col("spread") <= spread).cast("int") + (F.col("low_mean") - F.col("z_min") <= flat).cast("int") + (F.col("variance") <= flat * flat).cast("int")
    return per.drop("z").withColumns({"score": score, "valid": (score >= 2) & (F.col("spread") <= spread)})


def propagated(cells: DataFrame, first_ring: int, last_ring: int, slope: float, ring: float = 2.0, height: float = 1.0) -> DataFrame:
    """frame_id, sector, ring, low_mean of ground cells: from the lowest valid cell of the seed rings inward and outward, as
    long as the slope to the cell before stays under `slope` and the height over the seed under `height`; other cells that
    aren't valid are passed over. The first failure ends a walk, so each is a fold over the sector's rings."""
    item = F.struct("ring", "low_mean")
    per = cells.where("valid").groupBy("frame_id", "sector").agg(F.array_sort(F.collect_list(item)).alias("all"))
    in_seed = F.filter("all", lambda c: c["ring"].between(first_ring, last_ring))
    seed = F.array_min(F.transform(in_seed, lambda c: F.struct(c["low_mean"].alias("low_mean"), c["ring"].alias("ring"))))
    per = per.withColumn("seed", seed).where("seed IS NOT NULL")
    start = F.struct(F.array(F.struct(F.col("seed.ring").alias("ring"), F.col("seed.low_mean").alias("low_mean"))).alias("kept"), F.lit(True).alias("on"))

    def step(state: Column, c: Column) -> Column:
        last = F.element_at(state["kept"], -1)
        far = F.abs(c["ring"] - last["ring"]) * ring
        ok = state["on"] & (F.abs(c["low_mean"] - last["low_mean"]) / far < slope) & (c["low_mean"] <= F.col("seed.low_mean") + height)
        return F.struct(F.when(ok, F.concat(state["kept"], F.array(c))).otherwise(state["kept"]).alias("kept"), ok.alias("on"))

    out = F.aggregate(F.filter("all", lambda c: c["ring"] > F.col("seed.ring")), start, step)["kept"]
    inward = F.aggregate(F.reverse(F.filter("all", lambda c: c["ring"] < F.col("seed.ring"))), start, step)["kept"]
    return per.select("frame_id", "sector", F.explode(F.array_union(out, inward)).alias("c")).select("frame_id", "sector", "c.ring", "c.low_mean")


def ground_labels(cells: DataFrame, ground: DataFrame, height: float = 0.5) -> DataFrame:
    """cells with is_ground: in a ground cell and not over its low mean by more than height."""
    g = ground.select("frame_id", "sector", "ring", F.col("low_mean").alias("ground_z"))
    return cells.join(g, ["frame_id", "sector", "ring"], "left").withColumn("is_ground", F.coalesce(F.col("mz") <= F.col("ground_z") + height, F.lit(False))).drop("ground_z")


def lowest_ground(voxels: DataFrame, height: float) -> DataFrame:
    """The plain fallback: what is under the frame's lowest voxel plus height."""
    low = voxels.groupBy("frame_id").agg(F.min("mz").alias("low"))
    return voxels.join(low, "frame_id").withColumn("is_ground", F.col("mz") < F.col("low") + height).drop("low")


def floor_relabelled(voxels: DataFrame, is_inlier: Column, margin: float) -> DataFrame:
    """All voxels with is_ground: inside the box of their frame's inliers of the floor, larger by the margin on each side;
    without inliers none are."""
    axes = ("mx", "my", "mz")
    limits = [f(F.when(is_inlier, F.col(c))).alias(f"{k}_{c}") for c in axes for k, f in (("lo", F.min), ("hi", F.max))]
    boxed = voxels.join(voxels.groupBy("frame_id").agg(*limits), "frame_id")
    centre = tuple((F.col(f"hi_{c}") + F.col(f"lo_{c}")) / 2 for c in axes)
    size = tuple(F.col(f"hi_{c}") - F.col(f"lo_{c}") + 2 * margin for c in axes)
    out = boxed.withColumn("is_ground", F.coalesce(in_box(vec(*axes), centre, size), F.lit(False)))
    return out.drop(*[f"{k}_{c}" for c in axes for k in ("lo", "hi")])


def hypotheses(points: DataFrame, per_frame: int, seed: int = 0) -> DataFrame:
    """frame_id, h, and plane (nx, ny, nz, d) through three different points of the frame, drawn by seeded hashes.

    Draw h takes the points of the three least hashes of (h, point): any number of draws in one pass over the points."""
    each = points.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(per_frame - 1))))
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy("frame_id", "h").orderBy(F.xxhash64(F.lit(seed), "h", "point_id"), "point_id"))).where("r <= 3")
    p = [F.max(F.when(F.col("r") == k, F.struct("x", "y", "z"))).alias(f"p{k}") for k in (1, 2, 3)]
    drawn = ranked.groupBy("frame_id", "h").agg(F.count(F.lit(1)).alias("n"), *p).where("n = 3")
    normal, d = plane_of(*[vec(f"p{k}.x", f"p{k}.y", f"p{k}.z") for k in (1, 2, 3)])
    return drawn.select("frame_id", "h", *[n.alias(f"n{c}") for n, c in zip(normal, "xyz")], d.alias("d"))


def plane_support(points: DataFrame, planes: DataFrame, distance: float) -> DataFrame:
    """planes with n_inliers, the points of their frame nearer than distance. Planes per frame are few by construction."""
    near = F.abs(dot(vec("x", "y", "z"), vec("nx", "ny", "nz")) + F.col("d")) < distance
    counted = points.join(planes, "frame_id").groupBy("frame_id", "h").agg(F.count_if(near).alias("n_inliers"))
    return planes.join(counted, ["frame_id", "h"])


def best_planes(points: DataFrame, planes: DataFrame, distance: float, least: int = 30) -> DataFrame:
    """The plane of most inliers of each frame (ties: the first draw), if it has at least `least`."""
    best = F.max(F.struct("n_inliers", (-F.col("h")).alias("h_"), "h", "nx", "ny", "nz", "d")).alias("b")
    return plane_support(points, planes, distance).groupBy("frame_id").agg(best).select("frame_id", "b.n_inliers", "b.h", "b.nx", "b.ny", "b.nz", "b.d").where(F.col("n_inliers") >= least)


def refitted(points: DataFrame, planes: DataFrame, distance: float) -> DataFrame:
    """Planes through the inliers' mean along their least spread: one aggregate of sums, eigenvalues in closed form."""
    near = F.abs(dot(vec("x", "y", "z"), vec("nx", "ny", "nz")) + F.col("d")) < distance
    inliers = points.join(planes, "frame_id").where(near)
    return fitted(inliers, ["frame_id"])


def fitted(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, mean, eigenvalues l0 <= l1 <= l2 and the plane (nx, ny, nz, d) of each group of points."""
    xyz = "xyz"
    sums = [F.avg(c).alias(f"m{c}") for c in xyz] + [F.avg(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(xyz) for b in xyz[i:]]
    per = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    c = {f"{a}{b}": F.col(f"{a}{b}") - F.col(f"m{a}") * F.col(f"m{b}") for i, a in enumerate(xyz) for b in xyz[i:]}
    per = per.withColumns({f"c{k}": v for k, v in c.items()})
    parts = [F.col(f"c{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz")]
    values = eigen3(*parts)
    per = per.withColumns({f"l{i}": v for i, v in enumerate(values)})
    normal = eigenvector3(*parts, F.col("l0"))
    per = per.withColumns({f"n{k}": v for k, v in zip(xyz, normal)})
    return per.select(*keys, "n", "mx", "my", "mz", "l0", "l1", "l2", "nx", "ny", "nz", (-(F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz"))).alias("d"), *[f"c{k}" for k in ("xx", "xy", "xz", "yy", "yz", "zz")])


def planes_one_by_one(points: DataFrame, per_frame: int, distance: float, least: int, most: int = 8, seed: int = 0) -> DataFrame:
    """Up to `most` planes per frame, each without the inliers of those before: k, n_inliers and the plane."""
    from .graph import checkpointed

    left, out = points, None
    for k in range(most):  # each round reads what is left several times, so lineage is cut
        best = checkpointed(best_planes(left, hypotheses(left, per_frame, seed + k), distance, least).withColumn("k", F.lit(k)))
        if best.isEmpty() and out is not None:
            break
        out = best if out is None else out.unionByName(best)
        near = F.abs(dot(vec("x", "y", "z"), vec("nx", "ny", "nz")) + F.col("d")) < distance
        left = left.join(best.select("frame_id", "nx", "ny", "nz", "d"), "frame_id").where(~near).select(*points.columns)
        left = checkpointed(left)
    return out


def normals(points: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Normal of each point from its neighbours' covariance, turned towards the sensor at the origin: frame_id, point_id, normal."""
    nbr = points.select("frame_id", F.col("point_id").alias("nbr_id"), "x", "y", "z")
    fits = fitted(neighbours.select("frame_id", "point_id", "nbr_id").join(nbr, ["frame_id", "nbr_id"]), ["frame_id", "point_id"])
    own = points.select("frame_id", "point_id", "x", "y", "z")
    out = fits.select("frame_id", "point_id", "n", "nx", "ny", "nz").join(own, ["frame_id", "point_id"])
    flip = F.when(dot(vec("x", "y", "z"), vec("nx", "ny", "nz")) > 0, -1.0).otherwise(1.0)
    return out.select("frame_id", "point_id", "n", *[(F.col(f"n{c}") * flip).alias(f"n{c}") for c in "xyz"])


def behind_walls(voxels: DataFrame, walls: DataFrame) -> DataFrame:
    """voxels with is_outlier: further out than a wall box of their frame (along its thin side x, at wx) and within its extent in y."""
    hit = voxels.join(walls, "frame_id").where((F.col("mx") > F.col("wx")) & F.col("my").between(F.col("wy") - F.col("wl") / 2, F.col("wy") + F.col("wl") / 2))
    keys = ["frame_id", "ix", "iy", "iz"]
    return voxels.join(hit.select(*keys).distinct().withColumn("is_behind", F.lit(True)), keys, "left").withColumn("is_outlier", F.coalesce("is_behind", F.lit(False))).drop("is_behind")


def numbered(points: DataFrame) -> DataFrame:
    """points with _k, their number within the frame by id from 0, and _n, how many there are."""
    by = Window.partitionBy("frame_id")
    return points.withColumns({"_k": F.row_number().over(by.orderBy("point_id")) - 1, "_n": F.count(F.lit(1)).over(by)})


def drawn_planes(known: DataFrame, frames: DataFrame, first: int, count: int, seed: int, is_allowed: Callable[[Vec], Column] | None = None) -> DataFrame:
    """frame_id, h, nx, ny, nz, d: draws `first` to `first` + `count` - 1 of each frame (frame_id, _n), a plane through three
    points of known (numbered) whose numbers a hash tells; draws of twice the same point, of points on a line and
    planes that aren't allowed are left out. Only the drawn points are joined."""
    draws = frames.select("frame_id", "_n", F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))).alias("h"))
    at = draws.withColumns({f"_{i}": F.pmod(F.xxhash64(F.lit(seed), "frame_id", "h", F.lit(i)), F.col("_n")) for i in range(3)}).where("_0 <> _1 AND _0 <> _2 AND _1 <> _2").drop("_n")
    for i in range(3):
        at = at.join(known.select("frame_id", F.col("_k").cast("long").alias(f"_{i}"), F.struct("x", "y", "z").alias(f"p{i}")), ["frame_id", f"_{i}"])
    p = [vec(*[f"p{i}.{c}" for c in "xyz"]) for i in range(3)]
    normal, d = plane_of(*p)
    n = cross(minus(p[1], p[0]), minus(p[2], p[0]))
    out = at.where(norm2(n) > 1e-18).select("frame_id", "h", *[v.alias(f"n{c}") for v, c in zip(normal, "xyz")], d.alias("d"))
    return out if is_allowed is None else out.where(is_allowed(vec("nx", "ny", "nz")))


def searched_planes(points: DataFrame, distance: float, least: int = 30, confidence: float = 0.99, count: int = 16, most: int = 1024, seed: int = 0, is_allowed: Callable[[Vec], Column] | None = None) -> DataFrame:
    """frame_id, n_draws, n_inliers and the plane (nx, ny, nz, d; fitted to the inliers of the best draw) of each frame that has
    one with at least `least` inliers (points nearer than `distance`).

    Draws go on, `count` at a time, for the frames for which they may still help: until with the best share of inliers w
    so far, one of the draws would have been free of outliers with the given confidence, log(1 - confidence) /
    log(1 - w^3), or `most` were made. Each round makes as many draws as all before it and reads a frame's points once, for
    the planes that are allowed; what it drew after the end doesn't count. is_allowed: a condition on normals (is_floor,
    is_wall)."""
    from .graph import stored

    known = stored(numbered(points.select("frame_id", "point_id", "x", "y", "z")))
    state = known.groupBy("frame_id").agg(F.first("_n").alias("_n")).where("_n >= 3").withColumns({"n_draws": F.lit(0), "best": F.lit(None).cast("struct<n:bigint,h_:int,nx:double,ny:double,nz:double,d:double>")})
    state, done = stored(state), None
    first, most = 0, math.ceil(most / count) * count
    while first < most:
        draws = min(max(count, first), most - first)
        planes = stored(drawn_planes(known, state, first, draws, seed, is_allowed))
        counted = plane_support(known, planes, distance).withColumn("_s", F.floor((F.col("h") - first) / count).cast("int") + 1)
        new = counted.groupBy("frame_id", "_s").agg(F.max(F.struct(F.col("n_inliers").alias("n"), (-F.col("h")).alias("h_"), "nx", "ny", "nz", "d")).alias("_new"))
        parts = state.withColumn("_s", F.explode(F.sequence(F.lit(1), F.lit(draws // count)))).join(new, ["frame_id", "_s"], "left")
        so_far = F.max("_new").over(Window.partitionBy("frame_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))
        parts = parts.select("frame_id", "_n", (F.col("n_draws") + F.col("_s") * count).alias("n_draws"), F.greatest("best", so_far).alias("best"))
        share = F.coalesce(F.col("best.n"), F.lit(0)) / F.col("_n")
        enough = F.when(share >= 1, 1.0).when(share > 0, F.log(F.lit(1 - confidence)) / F.log(1 - share * share * share)).otherwise(math.inf)
        parts = parts.withColumn("_ended", F.col("n_draws") >= enough).where(F.col("_ended") | (F.col("n_draws") == first + draws))
        at = F.min_by(F.struct("_n", "n_draws", "best", "_ended"), "n_draws").alias("_at")
        state = stored(parts.groupBy("frame_id").agg(at).select("frame_id", "_at.*"))
        ended = state.where("_ended").drop("_ended")
        done = ended if done is None else done.unionByName(ended)
        state = state.where("NOT _ended").drop("_ended")
        first += draws
        if state.isEmpty():
            break
    found = done.unionByName(state).where(F.col("best.n") >= least).select("frame_id", "n_draws", F.col("best.n").alias("n_inliers"), *[f"best.{c}" for c in ("nx", "ny", "nz", "d")])
    fits = refitted(points, found, distance).select("frame_id", *[F.col(c).alias(f"_{c}") for c in ("nx", "ny", "nz", "d")])
    return found.join(fits, "frame_id").select("frame_id", "n_draws", "n_inliers", *[F.col(f"_{c}").alias(c) for c in ("nx", "ny", "nz", "d")])
