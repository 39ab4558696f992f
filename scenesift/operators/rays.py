"""Rays through the grid as layer intervals of the columns that they cross.

A ray is sampled every half voxel. Sample s of an axis lies in voxel floor((e + d * (s * half) - o) / size); every
operation in it, rounding included, is monotone in s. So the samples in one grid column are one range of s, and as a
sample moves by at most half a voxel they fill every layer between the first and the last. A ray therefore becomes one
row for each column it crosses: the first sample of a voxel is estimated by division and set right by looking at the
samples next to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenesift.functions.geometry import cell
from scenesift.operators.points import FK
from scenesift.session import spread

#: A crossing is located within one sample while a step is longer than this share of the coordinates it is added to.
STEADY = 1e-12

SHAPE = ["gx", "gy", "gz"]


def _index(axis: str, sample: Column) -> Column:
    """Voxel index of a sample along an axis. Indices and samples are whole doubles: they need no overflow checks."""
    place = F.col("e" + axis) + F.col("d" + axis) * (sample * F.col("half"))
    return F.floor((place - F.col("o" + axis)) / F.col("voxel_size")).cast("double")


def _guess(axis: str, voxel: Column, after: Column, last: Column) -> Column:
    """Estimate of the first sample that has reached ``voxel``, which lies beyond sample ``after`` and not beyond ``last``."""
    border = F.col("o" + axis) + (voxel + F.col("_up")) * F.col("voxel_size")
    guess = F.ceil(F.try_divide(border - F.col("e" + axis), F.col("d" + axis) * F.col("half"))).cast("double")
    return F.greatest(after + 1.0, F.least(last, guess))


def _settle(axis: str, voxel: Column, guess: Column) -> Column:
    """The first sample that has reached ``voxel``: the estimate or a sample next to it."""
    reached = lambda s: (_index(axis, s) - voxel) * F.col("_turn") >= 0.0
    return F.when(reached(guess - 1.0), guess - 1.0).when(reached(guess), guess).otherwise(guess + 1.0)


def _strips(rays: DataFrame, axis: str, name: str, first: str, last: str, out: tuple[str, str]) -> DataFrame:
    """One row for each voxel index of ``axis`` between two samples, with the first and last sample in it.

    A ray that is not steady has one strip for each sample. Each step is a projection of its own and no row is
    filtered, because a filter would be pushed below the steps and repeat their expressions.
    """
    rays = rays.withColumns({"_a": _index(axis, F.col(first)), "_b": _index(axis, F.col(last))})
    crossed = F.when(F.col("steady"), F.abs(F.col("_b") - F.col("_a"))).otherwise(F.col(last) - F.col(first))
    back = F.col("_b") < F.col("_a")
    rays = rays.withColumns({"_turn": F.when(back, -1.0).otherwise(1.0), "_up": F.when(back, 1.0).otherwise(0.0), "_n": crossed})
    rays = rays.withColumn("_m", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int")))).withColumn("_m", F.col("_m").cast("double"))
    single = F.col(first) + F.col("_m")
    rays = rays.withColumn(name, F.when(F.col("steady"), F.col("_a") + F.col("_turn") * F.col("_m")).otherwise(_index(axis, single)))
    voxel = F.col(name)
    rays = rays.withColumns({"_g": _guess(axis, voxel, F.col(first), F.col(last)), "_h": _guess(axis, voxel + F.col("_turn"), F.col(first), F.col(last))})
    start = F.when(~F.col("steady") | (F.col("_m") == 0.0), single).otherwise(_settle(axis, voxel, F.col("_g")))
    end = F.when(~F.col("steady"), single).when(F.col("_m") == F.col("_n"), F.col(last)).otherwise(_settle(axis, voxel + F.col("_turn"), F.col("_h")) - 1.0)
    return rays.withColumns({out[0]: start, out[1]: end}).drop("_a", "_b", "_turn", "_up", "_n", "_m", "_g", "_h")


def sampled_rays(points: DataFrame, camera: DataFrame, grid: DataFrame) -> DataFrame:
    """Rays with their start, direction and number of samples; ``steady`` says that crossings can be located.

    Points are small and each becomes many rows, so frames are spread before they meet their grid.
    """
    eye = camera.select(*FK, *[cell(F.col("pose"), r, 3).alias("e" + a) for r, a in enumerate("xyz")])
    rays = spread(points.select(*FK, "x", "y", "z"), FK).join(grid.join(eye, FK), FK)
    delta = [F.col(a) - F.col("e" + a) for a in "xyz"]
    rays = rays.withColumn("_len", F.sqrt(delta[0] * delta[0] + delta[1] * delta[1] + delta[2] * delta[2]))
    rays = rays.filter(F.col("_len") > 0).withColumn("half", F.col("voxel_size") * 0.5)
    guess = F.ceil(F.col("_len") / F.col("half")).cast("double")
    count = F.when((guess - 1.0) * F.col("half") >= F.col("_len"), guess - 1.0).when(guess * F.col("half") < F.col("_len"), guess + 1.0).otherwise(guess)
    rays = rays.withColumns({"last": count - 1.0, "zero": F.lit(0.0), **{"d" + a: (F.col(a) - F.col("e" + a)) / F.col("_len") for a in "xyz"}})
    steady = None
    for a in "xy":
        still = _index(a, F.col("zero")) == _index(a, F.col("last"))
        firm = F.abs(F.col("d" + a)) * F.col("half") >= STEADY * (F.abs("e" + a) + F.abs("o" + a) + F.abs(a))
        steady = still | firm if steady is None else steady & (still | firm)
    return rays.withColumn("steady", steady).drop("x", "y", "z", "_len")


def walked_samples(rays: DataFrame) -> DataFrame:
    """(frame, i, j, z0, z1, shape) one row for each sample: the plain form that ``ray_intervals`` must equal."""
    return _crossed(rays.withColumn("steady", F.lit(False)))


def _crossed(rays: DataFrame) -> DataFrame:
    rows = _strips(rays, "x", "i", "zero", "last", ("_s0", "_s1"))
    rows = _strips(rows, "y", "j", "_s0", "_s1", ("_t0", "_t1"))
    index = {"i": F.col("i"), "j": F.col("j"), "z0": _index("z", F.col("_t0")), "z1": _index("z", F.col("_t1"))}
    return rows.select(*FK, *[c.cast("int").alias(n) for n, c in index.items()], *SHAPE)


def ray_intervals(points: DataFrame, camera: DataFrame, grid: DataFrame) -> DataFrame:
    """(frame, i, j, z0, z1, shape): first and last layer of every column that a ray crosses, hits not removed, not clipped.

    Rays so close to an axis that rounding decides their crossings are walked sample by sample; they cross few columns.
    """
    return _crossed(sampled_rays(points, camera, grid))
