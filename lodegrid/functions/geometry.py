"""Column builders for points, boxes, planes and rigid motions. Matrices are arrays of doubles, by rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def lits(values: Sequence[float]) -> Vec:
    return tuple(F.lit(float(v)) for v in values)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def plus(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def times(a: Vec, k: Column) -> Vec:
    return a[0] * k, a[1] * k, a[2] * k


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm2(a: Vec) -> Column:
    return dot(a, a)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))


def cell(c: Column, res: float) -> Column:
    """Index of the grid cell (floor, so -0.1 at 0.25 is in -1)."""
    return F.floor(c * F.lit(1.0 / res)).cast("long")


def moved(pose: Sequence[float], p: Vec) -> Vec:
    """p under a 3x4 or 4x4 matrix of numbers."""
    rows = [pose[4 * i : 4 * i + 4] for i in range(3)]
    return tuple(F.lit(float(r[0])) * p[0] + F.lit(float(r[1])) * p[1] + F.lit(float(r[2])) * p[2] + F.lit(float(r[3])) for r in rows)


def moved_by(pose: Column, p: Vec, turn_only: bool = False) -> Vec:
    """p under a column that holds a 4x4 matrix."""
    row = lambda i: pose[4 * i] * p[0] + pose[4 * i + 1] * p[1] + pose[4 * i + 2] * p[2]
    return tuple(row(i) if turn_only else row(i) + pose[4 * i + 3] for i in range(3))


def composed(a: Column, b: Column) -> Column:
    """The product of two 4x4 matrix columns."""
    item = lambda i, j: sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j])
    return F.array(*[item(i, j) for i in range(4) for j in range(4)])


def inverse(a: Column) -> Column:
    """Of a rigid motion: the turn transposed, the shift turned back and negated."""
    shift = [-(a[i] * a[3] + a[4 + i] * a[7] + a[8 + i] * a[11]) for i in range(3)]
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(a[0], a[4], a[8], shift[0], a[1], a[5], a[9], shift[1], a[2], a[6], a[10], shift[2], zero, zero, zero, one)


def slerp(a: Sequence[Column], b: Sequence[Column], t: Column) -> list[Column]:
    """Between unit quaternions, the short way; nearly equal ones linearly."""
    d = sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])
    sign, d = F.when(d < 0, -1.0).otherwise(1.0), F.least(F.abs(d), F.lit(1.0))
    angle = F.acos(d)
    near = F.sin(angle) < 1e-6
    wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    wb = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle)) * sign
    return [wa * x + wb * y for x, y in zip(a, b)]


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def expmap(w: Vec) -> list[Column]:
    """Turn (9 numbers by rows) of a rotation vector, after Rodrigues."""
    angle2 = norm2(w)
    angle = F.sqrt(angle2)
    small = angle < 1e-8
    s = F.when(small, 1.0).otherwise(F.sin(angle) / angle)
    c = F.when(small, 0.5).otherwise((1 - F.cos(angle)) / angle2)
    x, y, z = w
    one = F.lit(1.0)
    return [one - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y, c * x * y + s * z, one - c * (x * x + z * z), c * y * z - s * x, c * x * z - s * y, c * y * z + s * x, one - c * (x * x + y * y)]


def skew(v: Vec) -> Column:
    zero = F.lit(0.0)
    return F.array(zero, -v[2], v[1], v[2], zero, -v[0], -v[1], v[0], zero)


def in_box(p: Vec, centre: Vec, size: Vec, turn: Column | None = None) -> Column:
    """Closed: |turn' (p - centre)| <= size / 2 on all axes."""
    d = minus(p, centre)
    if turn is not None:
        d = tuple(turn[i] * d[0] + turn[3 + i] * d[1] + turn[6 + i] * d[2] for i in range(3))
    return (F.abs(d[0]) <= size[0] / 2) & (F.abs(d[1]) <= size[1] / 2) & (F.abs(d[2]) <= size[2] / 2)


def box_in_box(inner: tuple[Vec, Vec], outer: tuple[Vec, Vec]) -> Column:
    """Axis-aligned (centre, size) pairs; turns aren't looked at."""
    out = F.lit(True)
    for ci, si, co, so in zip(*inner, *outer):
        out = out & (ci - si / 2 >= co - so / 2) & (ci + si / 2 <= co + so / 2)
    return out


#: How a footprint is drawn out, in metres for each metre a second: to the front, the rear and either side; the speed that
#: counts at most, and that up to which a box rests. Fixed values.
DRAWN = {"front": 2.5, "rear": 0.35, "side": 0.5, "most": 5.0, "slow": 0.05}


def footprint(centre: Vec, size: Vec, velocity: Vec, front: float = DRAWN["front"], rear: float = DRAWN["rear"], side: float = DRAWN["side"], most: float = DRAWN["most"], slow: float = DRAWN["slow"], turn: Column | None = None) -> tuple[Column, ...]:
    """Centre (x, y), direction (x, y) and half axes of the ellipse around a box's footprint, drawn out along the velocity.

    The ellipse lies along the velocity; its axes cover the footprint as seen along and across that (half sides times the
    root of 2), and grow with the speed. Its centre shifts by half of what it grows more to the front than to the rear.
    Boxes at rest lie along their own x-axis and don't grow. turn: a 3x3 matrix column, of a box that isn't axis-aligned."""
    speed = F.sqrt(velocity[0] * velocity[0] + velocity[1] * velocity[1])
    moves = speed > slow
    used = F.when(moves, F.least(speed, F.lit(most))).otherwise(0.0)
    one, none = F.lit(1.0), F.lit(0.0)
    x0, x1, y0, y1 = (one, none, none, one) if turn is None else (turn[0], turn[3], turn[1], turn[4])  # the box's axes on the ground
    ux, uy = F.when(moves, velocity[0] / speed).otherwise(x0), F.when(moves, velocity[1] / speed).otherwise(x1)
    shift = 0.5 * used * (front - rear)
    half_u = F.abs(ux * x0 + uy * x1) * (size[0] / 2) + F.abs(ux * y0 + uy * y1) * (size[1] / 2)
    half_v = F.abs(ux * x1 - uy * x0) * (size[0] / 2) + F.abs(ux * y1 - uy * y0) * (size[1] / 2)
    a = F.greatest(half_u * math.sqrt(2) + 0.5 * used * (front + rear), F.lit(1e-6))
    b = F.greatest(half_v * math.sqrt(2) + used * side, F.lit(1e-6))
    return centre[0] + ux * shift, centre[1] + uy * shift, ux, uy, a, b


def in_footprint(p: Vec, centre: Vec, size: Vec, ellipse: tuple[Column, ...]) -> Column:
    """Inside the box's height and the ellipse that footprint gave."""
    ex, ey, ux, uy, a, b = ellipse
    dx, dy = p[0] - ex, p[1] - ey
    along, across = dx * ux + dy * uy, dy * ux - dx * uy
    return (F.abs(p[2] - centre[2]) <= size[2] / 2) & ((along / a) * (along / a) + (across / b) * (across / b) <= 1)


def in_inflated(p: Vec, centre: Vec, size: Vec, velocity: Vec, front: float = DRAWN["front"], rear: float = DRAWN["rear"], side: float = DRAWN["side"], most: float = DRAWN["most"], slow: float = DRAWN["slow"], turn: Column | None = None) -> Column:
    """Inside the box's height and its footprint as drawn out. Many points of one box: footprint once, then in_footprint."""
    return in_footprint(p, centre, size, footprint(centre, size, velocity, front, rear, side, most, slow, turn))


def interval_overlap(c1: Column, r1: Column, c2: Column, r2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(c1 + r1, c2 + r2) - F.greatest(c1 - r1, c2 - r2))


def shared_volume(a: tuple[Vec, Vec], b: tuple[Vec, Vec]) -> Column:
    """Of axis-aligned boxes (centre, size)."""
    sides = [interval_overlap(ca, sa / 2, cb, sb / 2) for ca, sa, cb, sb in zip(*a, *b)]
    return sides[0] * sides[1] * sides[2]


def volume(size: Vec) -> Column:
    return size[0] * size[1] * size[2]


def overlap(a: tuple[Vec, Vec], b: tuple[Vec, Vec]) -> Column:
    """Shared volume over the smaller volume."""
    least = F.least(volume(a[1]), volume(b[1]))
    return F.when(least > 0, shared_volume(a, b) / least).otherwise(0.0)


def iou(a: tuple[Vec, Vec], b: tuple[Vec, Vec]) -> Column:
    both = shared_volume(a, b)
    union = volume(a[1]) + volume(b[1]) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def projected_radius(size: Vec, turn: Column, axis: Vec) -> Column:
    """Half the extent of a turned box along an axis."""
    return sum((size[i] / 2 * F.abs(turn[i] * axis[0] + turn[3 + i] * axis[1] + turn[6 + i] * axis[2]) for i in (1, 2)), size[0] / 2 * F.abs(turn[0] * axis[0] + turn[3] * axis[1] + turn[6] * axis[2]))


def plane_of(p0: Vec, p1: Vec, p2: Vec) -> tuple[Vec, Column]:
    """Unit normal and offset; three points on a line give the horizontal plane through the first."""
    n = cross(minus(p1, p0), minus(p2, p0))
    length = F.sqrt(norm2(n))
    flat = length < 1e-9
    unit = tuple(F.when(flat, float(i == 2)).otherwise(n[i] / length) for i in range(3))
    return unit, -dot(unit, p0)


def is_wall(normal: Vec, degrees: float = 5.0) -> Column:
    return F.abs(normal[2]) < math.sin(math.radians(degrees))


def is_floor(normal: Vec, degrees: float = 15.0) -> Column:
    return F.abs(normal[2]) > math.cos(math.radians(degrees))


def is_compact(size: Vec, thin: float = 1e-3, ratio: float = 5.0) -> Column:
    """The least side isn't too thin, and the longest isn't over `ratio` times the middle one."""
    s = F.array_sort(F.array(*size))
    return (s[0] >= thin) & (s[2] < ratio * s[1])


#: Entries of a symmetric 3x3 matrix in the order in which functions take them.
SIX = ("xx", "xy", "xz", "yy", "yz", "zz")


def inverse3(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> list[Column]:
    """The inverse of a symmetric 3x3 matrix (its six entries); nulls where its determinant is 0."""
    a, b, c = yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy
    det = xx * a + xy * b + xz * c
    return [F.when(det != 0, v / det) for v in (a, b, c, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy)]


def form3(m: Sequence[Column], d: Vec) -> Column:
    """d' M d of a symmetric 3x3 matrix."""
    return m[0] * d[0] * d[0] + m[3] * d[1] * d[1] + m[5] * d[2] * d[2] + 2 * (m[1] * d[0] * d[1] + m[2] * d[0] * d[2] + m[4] * d[1] * d[2])


def mahalanobis(d: Vec, cov: Sequence[Column], least: float = 1e-6) -> Column:
    """Length of d as measured by a covariance (its six entries), which gets `least` on its diagonal; 0 where that has no
    inverse."""
    grown = [c + least if k in ("xx", "yy", "zz") else c for k, c in zip(SIX, cov)]
    return F.coalesce(F.sqrt(F.greatest(form3(inverse3(*grown), d), F.lit(0.0))), F.lit(0.0))


def turned3(pose: Column, m: Sequence[Column]) -> list[Column]:
    """R M R' for the turn of a 4x4 matrix column and a symmetric matrix (six entries)."""
    full = [[m[0], m[1], m[2]], [m[1], m[3], m[4]], [m[2], m[4], m[5]]]
    r = [[pose[4 * i + j] for j in range(3)] for i in range(3)]
    half = [[r[i][0] * full[0][j] + r[i][1] * full[1][j] + r[i][2] * full[2][j] for j in range(3)] for i in range(3)]
    return [half[i][0] * r[j][0] + half[i][1] * r[j][1] + half[i][2] * r[j][2] for i in range(3) for j in range(i, 3)]


def eigen3(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> list[Column]:
    """Eigenvalues of a symmetric 3x3 matrix, ascending, in closed form."""
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    safe = F.when(p > 0, p).otherwise(1.0)
    a, b, c, d, e, f = (xx - q) / safe, xy / safe, xz / safe, (yy - q) / safe, yz / safe, (zz - q) / safe
    det = a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    high, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return [low, 3 * q - high - low, high]


def eigenvector3(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column, value: Column) -> Vec:
    """Unit vector to an eigenvalue: the longest cross product of two rows of the matrix less the value."""
    rows = [(xx - value, xy, xz), (xy, yy - value, yz), (xz, yz, zz - value)]
    tries = [cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])]
    best = F.array_max(F.array(*[F.struct(norm2(t).alias("n"), *[t[i].alias("xyz"[i]) for i in range(3)]) for t in tries]))
    length = F.sqrt(best["n"])
    return tuple(F.when(length > 1e-300, best["xyz"[i]] / length).otherwise(float(i == 2)) for i in range(3))


def flattened(normal: Vec, thin: float = 1e-3) -> Column:
    """The covariance of a disc: 1 - (1 - thin) n n', all that is left of one whose eigenvalues are set to (thin, 1, 1)."""
    k = 1 - thin
    return F.array(*[F.lit(float(i == j)) - F.lit(k) * normal[i] * normal[j] for i in range(3) for j in range(3)])


def as_text(columns: Sequence[Column], sep: str = " ") -> Column:
    """Numbers with six decimals."""
    return F.format_string(sep.join(["%.6f"] * len(columns)), *columns)
