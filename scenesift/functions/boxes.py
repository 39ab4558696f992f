"""7-DoF boxes (cx, cy, cz, l, w, h, yaw) as structs of doubles.

``overlap`` of rotated boxes clips one footprint rectangle with the half planes of
the other, four times per pair, for all pairs of a batch at once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX_FIELDS = ("cx", "cy", "cz", "l", "w", "h", "yaw")


def box(cx, cy, cz, l, w, h, yaw=None) -> Column:
    values = (cx, cy, cz, l, w, h, F.lit(0.0) if yaw is None else yaw)
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(BOX_FIELDS, values)])


def volume(b: Column) -> Column:
    return b["l"] * b["w"] * b["h"]


def _span(a: Column, b: Column, center: str, size: str) -> Column:
    low = F.greatest(a[center] - a[size] / 2, b[center] - b[size] / 2)
    high = F.least(a[center] + a[size] / 2, b[center] + b[size] / 2)
    return F.greatest(high - low, F.lit(0.0))


def _hull(a: Column, b: Column, center: str, size: str) -> Column:
    low = F.least(a[center] - a[size] / 2, b[center] - b[size] / 2)
    high = F.greatest(a[center] + a[size] / 2, b[center] + b[size] / 2)
    return high - low


def footprint(b: Column) -> list[tuple[Column, Column]]:
    """The four ground corners as (x, y), counter-clockwise."""
    c, s = F.cos(b["yaw"]), F.sin(b["yaw"])
    out = []
    for sx, sy in ((1, 1), (-1, 1), (-1, -1), (1, -1)):
        dx, dy = b["l"] * (0.5 * sx), b["w"] * (0.5 * sy)
        out.append((b["cx"] + c * dx - s * dy, b["cy"] + s * dx + c * dy))
    return out


def _ground(b: Column) -> list[Column]:
    """What the two measures below take of a box: centre, sides, cosine and sine of the heading."""
    return [b["cx"], b["cy"], b["l"], b["w"], F.cos(b["yaw"]), F.sin(b["yaw"])]


def _measures():
    """(overlap, hull) of two footprints as Arrow functions over columns of numbers.

    Closures, so that they travel with the query and need no installed package. Angles come as cosine and sine, and
    every sum keeps one order, so a row gives the same number wherever it is computed.
    """

    def numbers(columns):
        """(values, all there) of the twelve columns."""
        import numpy as np

        there = np.ones(len(columns[0]), dtype=bool)
        for c in columns:
            there &= np.asarray(c.is_valid())
        return [np.asarray(c.fill_null(0.0).to_numpy(zero_copy_only=False), dtype="float64") for c in columns], there

    def corners(cx, cy, l, w, c, s):
        """The four ground corners as two arrays (4, rows), counter-clockwise."""
        import numpy as np

        x, y = np.empty((4, len(cx))), np.empty((4, len(cx)))
        for n, (sx, sy) in enumerate(((1, 1), (-1, 1), (-1, -1), (1, -1))):
            dx, dy = l * (0.5 * sx), w * (0.5 * sy)
            x[n], y[n] = cx + c * dx - s * dy, cy + s * dx + c * dy
        return x, y

    def after(x, y, n):
        """The next corner of every corner; the one after the last is the first."""
        import numpy as np

        slot = np.arange(len(x))[:, None]
        follow = np.where(slot + 1 < n, slot + 1, 0)
        return np.take_along_axis(x, follow, 0), np.take_along_axis(y, follow, 0), slot < n

    def clip(x, y, n, nx, ny, limit):
        """Parts of convex polygons with ``nx x + ny y <= limit``; row ``r`` uses the first ``n[r]`` corners."""
        import numpy as np

        qx, qy, used = after(x, y, n)
        here, there = nx * x + ny * y - limit, nx * qx + ny * qy - limit
        # As Spark compares: a number that is not one is larger than all others.
        inner = used & (here <= 0)
        crosses = used & (((here < 0) & ~(there <= 0)) | (~(here <= 0) & (there < 0)))
        t = here / np.where(crosses, here - there, 1.0)
        place = np.cumsum(inner.astype("int64") + crosses, axis=0) - 1
        size = place[-1] + 1
        row = np.broadcast_to(np.arange(x.shape[1]), x.shape)
        out = np.zeros((2, max(int(size.max(initial=0)), 1), x.shape[1]))
        for axis, (p, q) in enumerate(((x, qx), (y, qy))):
            # A corner comes before the crossing that follows it.
            out[axis][(place - crosses)[inner], row[inner]] = p[inner]
            out[axis][place[crosses], row[crosses]] = (p + t * (q - p))[crosses]
        return out[0], out[1], size

    def overlap(*columns):
        """The rectangle of the first box clipped by the four sides of the second; 0 if a number is missing."""
        import numpy as np
        import pyarrow as pa

        values, there = numbers(columns)
        _, _, _, _, _, _, bx, by, bl, bw, c, s = values
        with np.errstate(all="ignore"):
            x, y = corners(*values[:6])
            n = np.where(there, 4, 0)
            for nx, ny, half in ((c, s, bl / 2), (-c, -s, bl / 2), (-s, c, bw / 2), (s, -c, bw / 2)):
                x, y, n = clip(x, y, n, nx, ny, nx * bx + ny * by + half)
            qx, qy, used = after(x, y, n)
            total = np.zeros(len(n))
            for wedge, mine in zip(x * qy - qx * y, used):
                total = np.where(mine, total + wedge, total)
            return pa.array(np.where(n >= 3, np.abs(total) / 2.0, 0.0))

    def hull(*columns):
        """Ground rectangle around both footprints; corners that miss a number do not count, null without any."""
        import numpy as np
        import pyarrow as pa

        values, valid = [], []
        for half in (columns[:6], columns[6:]):
            shared = numbers(half[2:])[1]
            valid.append([shared & numbers(half[n : n + 1])[1] for n in (0, 1)])
            values.append(numbers(half)[0])
        area, some = 1.0, True
        with np.errstate(all="ignore"):
            ends = [corners(*v) for v in values]
            for axis in (0, 1):
                has = [np.broadcast_to(v[axis], (4, len(v[axis]))) for v in valid]
                at, has = np.concatenate([e[axis] for e in ends]), np.concatenate(has)
                high = np.where(has, at, -np.inf).max(axis=0)
                area = area * (high - np.fmin.reduce(np.where(has, at, np.inf), axis=0))
                some = some & has.any(axis=0)
        return pa.array(area, mask=~some)

    return overlap, hull


def _measure(which: int, a: Column, b: Column) -> Column:
    return F.arrow_udf(_measures()[which], "double")(*_ground(a), *_ground(b))


def _rotated_overlap(a: Column, b: Column) -> Column:
    """Footprint overlap: the rectangle of ``a`` clipped by the four sides of ``b``."""
    return _measure(0, a, b)


def intersection(a: Column, b: Column, rotated: bool = True) -> Column:
    flat = _span(a, b, "cx", "l") * _span(a, b, "cy", "w")
    ground = flat
    if rotated:
        ground = F.when((a["yaw"] == 0) & (b["yaw"] == 0), flat).otherwise(_rotated_overlap(a, b))
    return ground * _span(a, b, "cz", "h")


def iou3d(a: Column, b: Column, rotated: bool = True) -> Column:
    """Shared volume over joint volume; null for two boxes without volume."""
    shared = intersection(a, b, rotated)
    return F.try_divide(shared, volume(a) + volume(b) - shared)


def _hull_area(a: Column, b: Column) -> Column:
    """Ground rectangle around both footprints."""
    return _measure(1, a, b)


def giou3d(a: Column, b: Column, rotated: bool = True) -> Column:
    """IoU minus the share of the axis-aligned enclosing box that neither box fills."""
    shared = intersection(a, b, rotated)
    union = volume(a) + volume(b) - shared
    flat = _hull(a, b, "cx", "l") * _hull(a, b, "cy", "w")
    ground = flat
    if rotated:
        ground = F.when((a["yaw"] == 0) & (b["yaw"] == 0), flat).otherwise(_hull_area(a, b))
    hull = ground * _hull(a, b, "cz", "h")
    return shared / union - (hull - union) / hull


def box_to_corners(b: Column) -> Column:
    """Array of eight structs (idx, x, y, z), ``idx = 4 z + 2 y + x``."""
    c, s = F.cos(b["yaw"]), F.sin(b["yaw"])
    out = []
    for n in range(8):
        dx = b["l"] * (0.5 if n & 1 else -0.5)
        dy = b["w"] * (0.5 if n & 2 else -0.5)
        dz = b["h"] * (0.5 if n & 4 else -0.5)
        out.append(
            F.struct(
                F.lit(n).alias("idx"),
                (b["cx"] + c * dx - s * dy).alias("x"),
                (b["cy"] + s * dx + c * dy).alias("y"),
                (b["cz"] + dz).alias("z"),
            )
        )
    return F.array(*out)


def corners_to_box(corners: Column) -> Column:
    """Inverse of :func:`box_to_corners` for an array in the same corner order."""
    at = lambda n, f: corners[n][f]
    mean = lambda f: F.aggregate(corners, F.lit(0.0), lambda acc, p: acc + p[f]) / 8.0
    ex, ey = at(1, "x") - at(0, "x"), at(1, "y") - at(0, "y")
    wx, wy = at(2, "x") - at(0, "x"), at(2, "y") - at(0, "y")
    return box(
        mean("x"), mean("y"), mean("z"),
        F.sqrt(ex * ex + ey * ey), F.sqrt(wx * wx + wy * wy), at(4, "z") - at(0, "z"),
        F.atan2(ey, ex),
    )


def box_change_frame(b: Column, matrix: Column) -> Column:
    """Box under a rigid transform: centre moved, heading re-read from the turned length axis."""
    from scenesift.functions.geometry import apply_matrix, apply_rotation

    x, y, z = apply_matrix(matrix, (b["cx"], b["cy"], b["cz"]))
    hx, hy, _ = apply_rotation(matrix, (F.cos(b["yaw"]), F.sin(b["yaw"]), F.lit(0.0)))
    return box(x, y, z, b["l"], b["w"], b["h"], F.atan2(hy, hx))
