"""Polynomials fitted to traced curves by sums, and curves at equally spaced places."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from numpy.polynomial import Chebyshev, Polynomial
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpointed

_RESULT = "degree int, coefficients array<double>, rmse double, r2 double, endpoint_error double, status string"
#: Gates of the stricter selection and of the robust one (fixed values).
PASS_R2, PASS_RELATIVE, PASS_END, FAIL_R2 = 0.995, 0.03, 0.08, 0.97
#: Points of one curve that a robust fit uses (a fixed value): an even pick of more.
MOST_POINTS = 600
#: Curves up to which their ranges and coefficients are broadcast.
CURVES = 10_000


def to_units(x: Column, y: Column, width: Column, height: Column, axes: dict, swap: bool = False) -> tuple[Column, Column]:
    """Pixels on the units of the axes; y counts downwards."""
    across = axes["x_min"] + x / (width - 1) * (axes["x_max"] - axes["x_min"])
    up = axes["y_max"] - y / (height - 1) * (axes["y_max"] - axes["y_min"])
    return (up, across) if swap else (across, up)


def choose_lowest(fits: list[dict]) -> dict:
    """The least error; in the order of errors a lower degree replaces the choice if its error is within 5 % of it."""
    fits = sorted(fits, key=lambda f: f["rmse"])
    best = fits[0]
    for fit in fits[1:]:
        near = abs(fit["rmse"] - best["rmse"]) / best["rmse"] < 0.05 if best["rmse"] else fit["rmse"] == 0
        if near and fit["degree"] < best["degree"]:
            best = fit
    return best | {"status": "pass"}


def choose_gated(fits: list[dict]) -> dict:
    """From the highest degree down the first that passes all gates; else the best by R squared; below ``FAIL_R2`` it fails."""
    best = None
    for fit in fits:
        if fit["r2"] >= PASS_R2 and fit["relative"] <= PASS_RELATIVE and fit["end"] <= PASS_END:
            return fit | {"status": "pass"}
        if best is None or (fit["r2"], -fit["relative"]) > (best["r2"], -best["relative"]):
            best = fit
    return best | {"status": "warn" if best["r2"] >= FAIL_R2 else "fail"}


def _basis(x: Column, low: Column, high: Column, most: int) -> list[Column]:
    """The Chebyshev polynomials up to a degree at x, on the range of the curve."""
    u = F.when(high > low, (2 * x - low - high) / (high - low)).otherwise(0.0)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), u)))
    return [F.cos(angle * k) for k in range(most + 1)]


def _solver(least: int, most: int) -> Callable[..., Column]:
    @F.pandas_udf("array<array<double>>")
    def solve(distinct: pd.Series, t: pd.Series, b: pd.Series) -> pd.Series:
        """The coefficients of each degree, null where there are too few different x, from the sums of the basis and of the basis times y."""
        out = []
        for n, ts, bs in zip(distinct, t, b, strict=True):
            i = np.arange(most + 1)
            # a product of two Chebyshev polynomials is the mean of those of the sum and of the difference of their degrees
            normal = (np.asarray(ts)[i[:, None] + i] + np.asarray(ts)[abs(i[:, None] - i)]) / 2
            out.append([np.linalg.lstsq(normal[: d + 1, : d + 1], np.asarray(bs)[: d + 1], rcond=None)[0].tolist() if n > d else None for d in range(least, most + 1)])
        return pd.Series(out)

    return solve


def _chooser(least: int, most: int, gated: bool) -> Callable[..., Column]:
    @F.pandas_udf(_RESULT)
    def choose(curves: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in curves.itertuples():
            fits = []
            for d in range(most, least - 1, -1):
                c, squared = r.solved[d - least], r.squared[d - least]
                if c is None or (gated and r.n < 20):
                    continue
                whole = Chebyshev(c, domain=[r.low, r.high] if r.high > r.low else [-1, 1])
                ends = abs(whole(r.low) - r.first_y), abs(whole(r.high) - r.last_y)
                plain = whole.convert(kind=Polynomial, domain=[-1, 1]).coef
                fits.append({
                    "degree": d, "coefficients": np.pad(plain, (0, d + 1 - len(plain))).tolist(), "rmse": float(np.sqrt(squared / r.n)),
                    "r2": 1 - squared / r.total if r.total > 0 else 0.0, "endpoint_error": sum(ends), "relative": r.relative[d - least], "end": max(ends),
                })
            none = dict.fromkeys(("degree", "coefficients", "rmse", "r2", "endpoint_error")) | {"status": "fail"}
            rows.append((choose_gated if gated else choose_lowest)(fits) if fits else none)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _RESULT.split(", ")]).astype({"degree": "Int32"})

    return choose


def fit(points: DataFrame, key: str, x: str = "x", y: str = "y", least: int = 1, most: int = 6, gated: bool = False) -> DataFrame:
    """A least-squares polynomial for each curve, ascending coefficients, the degree chosen by error or by gates.

    Sums are all that leaves a task, so a curve may have any number of points: its range, then the sums of Chebyshev polynomials on that
    range, alone and times y, which make the normal equations of every degree at once, then the errors of all degrees. On its
    own range that basis is nearly orthogonal, so the equations stay well conditioned. Only the few numbers of a curve go through Python.
    A point whose x or y is null or no number is left out. Curves of too few different x for a degree do not try it; a curve that allows none has
    null results and the status ``fail``. The ends of a curve are its least x with the least y there and its greatest with the greatest.
    """
    rows = points.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    known = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    point = F.struct("x", "y")
    ranges = known.groupBy(key).agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"), F.count_distinct("x").alias("distinct"), F.avg("y").alias("mean"),
        F.min(point)["y"].alias("first_y"), F.max(point)["y"].alias("last_y"),
    )
    ranges = checkpointed(ranges)
    # few curves go to their points; else points are dealt by curve, and one curve's would lie in one task
    sent = F.broadcast if ranges.count() <= CURVES else lambda one: one
    placed = known.join(sent(ranges), key).withColumns({f"t{k}": c for k, c in enumerate(_basis(F.col("x"), F.col("low"), F.col("high"), 2 * most))})
    sums = placed.groupBy(key).agg(
        F.array(*[F.sum(f"t{k}") for k in range(2 * most + 1)]).alias("t"), F.array(*[F.sum(F.col(f"t{k}") * F.col("y")) for k in range(most + 1)]).alias("b"),
    )
    solved = checkpointed(ranges.join(sums, key).withColumn("solved", _solver(least, most)("distinct", "t", "b")))
    degrees = range(least, most + 1)
    placed = known.join(sent(solved), key).withColumns({f"t{k}": c for k, c in enumerate(_basis(F.col("x"), F.col("low"), F.col("high"), most))})
    said = {f"r{d}": F.col("y") - sum((F.col("solved")[d - least][k] * F.col(f"t{k}") for k in range(d + 1)), F.lit(0.0)) for d in degrees}
    errors = placed.withColumns(said).groupBy(key).agg(
        F.array(*[F.sum(F.col(f"r{d}") * F.col(f"r{d}")) for d in degrees]).alias("squared"),
        F.array(*[F.max(F.abs(f"r{d}") / F.greatest(F.abs("y"), F.lit(1e-9))) for d in degrees]).alias("relative"),
        F.sum((F.col("y") - F.col("mean")) * (F.col("y") - F.col("mean"))).alias("total"),
    )
    curves = solved.join(errors, key).withColumn("_c", _chooser(least, most, gated)(F.struct("low", "high", "n", "first_y", "last_y", "solved", "squared", "relative", "total")))
    out = rows.select(key).distinct().join(curves.select(key, "_c.*"), key, "left")
    return out.withColumn("status", F.coalesce("status", F.lit("fail")))


def robust(px: np.ndarray, py: np.ndarray, degree: int, rounds: int = 10, most: int = MOST_POINTS) -> np.ndarray | None:
    """Ascending coefficients by iterated Huber weights of ``most`` evenly picked points; null for fewer points than 30 or ten a degree."""
    if len(px) < max(30, 10 * degree):
        return None
    if len(px) > most:
        some = np.linspace(0, len(px) - 1, most).round().astype(int)
        px, py = px[some], py[some]
    weight = np.ones(len(px))
    for _ in range(rounds):
        c = np.polyfit(px, py, degree, w=np.sqrt(weight))
        r = np.abs(py - np.polyval(c, px))
        scale = 1.345 * max(1.4826 * float(np.median(r)), 1e-12)
        weight = np.where(r <= scale, 1.0, scale / np.maximum(r, 1e-300))
    return c[::-1]


def resample(points: DataFrame, key: str, n: int = 200) -> DataFrame:
    """Each curve at ``n`` (50 at least) equally spaced x by linear interpolation: ``key, i, x, y``.

    A point belongs to the first place that it does not lie beyond. Only the outermost points of each place are kept, by a partial
    aggregation; the neighbours of a place are then the last point up to it and the first one after it.
    """
    n = max(50, n)
    ends = checkpointed(points.where("x is not null and y is not null").groupBy(key).agg(F.min("x").alias("_a"), F.max("x").alias("_b")))
    at = lambda i: F.col("_a") + (F.col("_b") - F.col("_a")) * i / (n - 1)
    near = F.when(F.col("_b") > F.col("_a"), F.ceil((F.col("x") - F.col("_a")) / (F.col("_b") - F.col("_a")) * (n - 1))).otherwise(0).cast("int")
    owned = points.where("x is not null and y is not null").join(ends, key).withColumn("_i", near)
    # rounding may be one place off
    owned = owned.withColumn("_i", F.col("_i") + F.when(at(F.col("_i")) < F.col("x"), 1).when((F.col("_i") > 0) & (at(F.col("_i") - 1) >= F.col("x")), -1).otherwise(0))
    outer = owned.groupBy(key, F.least("_i", F.lit(n - 1)).alias("i")).agg(F.min(F.struct("x", "y")).alias("_first"), F.max(F.struct("x", "y")).alias("_last"))
    grid = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("gx", at(F.col("i"))).join(outer, [key, "i"], "left")
    order = Window.partitionBy(key).orderBy("i")
    grid = grid.withColumns({"_l": F.max("_last").over(order), "_r": F.min("_first").over(order.rowsBetween(1, Window.unboundedFollowing))})
    y = F.when(F.col("_r").isNull(), F.col("_l.y")).otherwise(F.col("_l.y") + (F.col("gx") - F.col("_l.x")) / (F.col("_r.x") - F.col("_l.x")) * (F.col("_r.y") - F.col("_l.y")))
    return grid.select(key, "i", F.col("gx").alias("x"), y.alias("y"))
