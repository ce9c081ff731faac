"""Component selection: solve each catalogue row for its operating current, lay out strings, cost and rank them.

A catalogue row has ``id``, ``lm_test``, ``if_max``, ``if_start``, ``rmb`` and the ascending coefficient
arrays ``fiv``, ``fil`` (over current) and ``ftl``, ``ftv`` (over temperature).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import number, polynomial
from tessera.session import checkpointed

#: The solver's tolerance, steps and the step that it takes when it would leave the range (fixed values).
TOLERANCE, STEPS, NUDGE = 1e-4, 100, 5.0
#: Points and lowest current of a sweep (fixed values), and halvings after which a bracket of doubles is empty.
SWEEP, LOWEST, HALVINGS = 600, 0.001, 64
#: Rows that are swept at once; each holds a number for every point.
SWEPT = 512


def targets(df: DataFrame, lumen: str, efficacy: str, optical: str, power: str) -> DataFrame:
    """Targets of the bare component from those of the fixture and its optical and electrical rates in percent."""
    o, p = F.col(optical) / 100, F.col(power) / 100
    return df.withColumns({"target_lumen": F.try_divide(F.col(lumen), o), "target_efficacy": F.try_divide(F.col(efficacy), o * p)})


def intensity(current: Column, fil: Column) -> Column:
    """Relative flux at a current; exactly 0 counts as 1."""
    value = polynomial(current, fil)
    return F.when(value == 0, 1.0).otherwise(value)


def objective(current: Column, k_eta: Column, k_phi: Column, fiv: Column, fil: Column) -> Column:
    return k_eta * (current / 1000) * polynomial(current, fiv) - k_phi * intensity(current, fil)


def _poly(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for i in range(c.shape[1]):
        out = out + c[:, i] * x**i
    return out


def _slope(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for i in range(1, c.shape[1]):
        out = out + c[:, i] * i * x ** (i - 1)
    return out


def newton(k_eta: np.ndarray, k_phi: np.ndarray, if_max: np.ndarray, start: np.ndarray, fiv: np.ndarray, fil: np.ndarray):
    """Solves all rows of a batch at once; returns currents, whether they converged, and steps taken.

    A step that would leave 0..if_max is replaced by ``NUDGE``; a row whose current passes if_max is set
    to it and stops. There it still counts as converged if the objective is not above the tolerance.
    """

    def f(x: np.ndarray) -> np.ndarray:
        flux = _poly(fil, x)
        return k_eta * (x / 1000) * _poly(fiv, x) - k_phi * np.where(flux == 0, 1.0, flux)

    def slope(x: np.ndarray) -> np.ndarray:
        d = k_eta * (_poly(fiv, x) / 1000 + x / 1000 * _slope(fiv, x)) - k_phi * _slope(fil, x)
        return np.where(np.abs(d) < 1e-10, 1e-10, d)

    x = start.astype(float).copy()
    usable = (k_eta > 0) & (k_phi > 0) & (if_max > 0)
    done, steps, active = np.zeros(len(x), bool), np.zeros(len(x), int), usable.copy()
    for _ in range(STEPS):
        if not active.any():
            break
        steps[active] += 1
        value = f(x)
        hit = active & (np.abs(value) < TOLERANCE)
        done |= hit
        active &= ~hit
        step = x - value / slope(x)
        outside = (step < 0) | (step > if_max)
        x = np.where(active, np.where(outside, x + NUDGE, step), x)
        over = active & (x > if_max)
        x = np.where(over, if_max, x)
        active &= ~over
    done |= usable & ~done & (x >= if_max) & (f(if_max) <= TOLERANCE)
    return x, done, steps


def newton_bisect(f, slope, low: float, high: float, start: float) -> tuple[float, bool]:
    """Newton steps kept inside a shrinking bracket, halving it where a step would leave it.

    Without a change of sign the end with the smaller value is taken, unconverged. A step that hardly
    moves ends the search without convergence. The result is rounded to six places.
    """
    f_low, f_high = f(low), f(high)
    if f_low * f_high > 0:
        return round(low if abs(f_low) < abs(f_high) else high, 6), False
    x = min(max(start, low), high)
    for _ in range(STEPS):
        value = f(x)
        if abs(value) < TOLERANCE:
            return round(x, 6), True
        if f_low * value <= 0:
            high = x
        else:
            low, f_low = x, value
        d = slope(x)
        step = x - value / d if abs(d) > 1e-12 else (low + high) / 2
        if not low < step < high:
            step = (low + high) / 2
        if abs(step - x) < 1e-9:
            return round(step, 6), False
        x = step
    return round(x, 6), False


def _sound(value: Column, default: float) -> Column:
    """The value, or the default where there is none or it is no number."""
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(default))


def _with_factors(catalogue: DataFrame, efficacy: float, temperature: float) -> DataFrame:
    """Adds the factors of flux and voltage at a temperature, 1 where a curve is missing, and what they make of the targets."""
    at = F.lit(float(temperature))
    factor = lambda curve: _sound(polynomial(at, F.col(curve)), 1.0)
    rows = catalogue.withColumns({"lumen_factor": factor("ftl"), "vf_factor": factor("ftv"), "lm": number(F.col("lm_test"))})
    return rows.withColumns(
        {
            "k_eta": F.lit(max(float(efficacy), 0.0)) * F.col("vf_factor"),
            "k_phi": F.when(F.col("lm") > 0, F.col("lm") * F.col("lumen_factor")).otherwise(0.0),
        }
    )


def _rows(curves: pd.Series) -> np.ndarray:
    """Arrays of coefficients as the rows of a matrix, filled up with zeros; a null array is all NaN."""
    some = [c for c in curves if c is not None]
    out = np.zeros((len(curves), max(map(len, some), default=0) or 1))
    for row, c in zip(out, curves, strict=True):
        row[: None if c is None else len(c)] = np.nan if c is None else c
    return out


def _swept(k_eta: np.ndarray, k_phi: np.ndarray, top: np.ndarray, fiv: np.ndarray, fil: np.ndarray, n: int, low: float) -> pd.DataFrame:
    """The sweeps of some rows, all currents of a row in one line of a matrix."""
    k_eta, k_phi = k_eta[:, None], k_phi[:, None]

    def f(x: np.ndarray) -> np.ndarray:
        flux = _poly(fil[:, :, None], x)
        value = k_eta * (x / 1000) * _poly(fiv[:, :, None], x) - k_phi * np.where(flux == 0, 1.0, flux)
        return np.where(np.isnan(value), 0.0, value)

    rows = np.arange(len(top))
    step = (np.log10(top) - np.log10(low)) / (n - 1)
    x = np.power(10.0, np.log10(low) + np.arange(n) * step[:, None])
    value = f(x)
    signs = value[:, :-1] * value[:, 1:] <= 0
    changes, first = signs.any(axis=1), signs.argmax(axis=1)
    a, fa, b = x[rows, first][:, None], value[rows, first][:, None], x[rows, first + 1][:, None]
    for _ in range(HALVINGS):
        middle = (a + b) / 2
        at = f(middle)
        left = fa * at <= 0
        a, fa, b = np.where(left, a, middle), np.where(left, fa, at), np.where(left, middle, b)
    nearest = np.abs(value).argmin(axis=1)
    root = pd.Series(((a + b) / 2)[:, 0]).astype(object).where(changes, None)
    return pd.DataFrame({"sign_change": changes, "nearest_if": x[rows, nearest], "f_at_nearest": value[rows, nearest], "greatest_f": value.max(axis=1), "root": root})


def sweep(catalogue: DataFrame, efficacy: float, temperature: float, n: int = SWEEP, low: float = LOWEST) -> DataFrame:
    """``id, sign_change, nearest_if, f_at_nearest, greatest_f, root`` of each row with a positive greatest current.

    The objective at ``n`` currents in equal ratios from ``low`` to the greatest: whether it changes sign (or is 0) between neighbours, where it is nearest to
    0 (the first of equals) and its greatest value. The first change of sign is halved until the bracket has no number inside; ``root`` is null
    without one. A task evaluates ``SWEPT`` rows at once, whatever its batch.
    """
    rows = _with_factors(catalogue, efficacy, temperature).withColumn("top", number(F.col("if_max"))).where("top > 0")

    @F.pandas_udf("sign_change boolean, nearest_if double, f_at_nearest double, greatest_f double, root double")
    def swept(k_eta: pd.Series, k_phi: pd.Series, top: pd.Series, fiv: pd.Series, fil: pd.Series) -> pd.DataFrame:
        parts = []
        with np.errstate(all="ignore"):
            for i in range(0, len(top), SWEPT):
                some = slice(i, i + SWEPT)
                parts.append(_swept(*(s[some].to_numpy(dtype=float) for s in (k_eta, k_phi, top)), _rows(fiv[some]), _rows(fil[some]), n, low))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["sign_change", "nearest_if", "f_at_nearest", "greatest_f", "root"])

    whole = lambda curve: F.transform(curve, lambda c: F.coalesce(c.cast("double"), F.lit(0.0)))
    return rows.select("id", swept("k_eta", "k_phi", "top", whole("fiv"), whole("fil")).alias("_s")).select("id", "_s.*")


def solve(catalogue: DataFrame, efficacy: float, lumen: float, temperature: float) -> DataFrame:
    """Adds the operating point of each row: current, convergence, flux, count, voltage, power.

    Without a curve of the voltage over the current it is taken for 3.0, without one over the temperature for unchanged.
    """
    rows = _with_factors(catalogue, efficacy, temperature)

    @F.pandas_udf("target_if double, converged boolean, steps int")
    def point(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for k_eta, k_phi, if_max, start, fiv, fil in batches:
            square = lambda s: np.array([[0.0 if v is None or v != v else v for v in (() if c is None else c)] for c in s], dtype=float).reshape(len(s), -1)
            x, ok, n = newton(*(s.to_numpy(dtype=float) for s in (k_eta, k_phi, if_max, start)), square(fiv), square(fil))
            yield pd.DataFrame({"target_if": x, "converged": ok, "steps": n})

    solved = point("k_eta", "k_phi", number(F.col("if_max")), number(F.col("if_start"), 10.0), "fiv", "fil")
    rows = rows.withColumn("_s", solved).select("*", "_s.*").drop("_s")
    flux = F.when(F.col("lm") > 0, F.col("lm") * intensity(F.col("target_if"), F.col("fil")) * F.col("lumen_factor")).otherwise(0.0)
    rows = rows.withColumn("lumen_at_target", flux)
    count = F.when((F.lit(float(lumen)) > 0) & (F.col("lumen_at_target") > 0), F.ceil(F.lit(float(lumen)) / F.col("lumen_at_target"))).otherwise(0)
    volts = _sound(polynomial(F.col("target_if"), F.col("fiv")), 3.0) * F.col("vf_factor")
    rows = rows.withColumns({"led_count": count.cast("int"), "vf_at_target": volts})
    return rows.withColumn("power", F.when(F.col("vf_at_target") > 0, F.col("vf_at_target") * F.col("target_if") / 1000).otherwise(0.0))


def topologies(count: Column, vf: Column, chain_max: Column, most: int = 5) -> Column:
    """Up to ``most`` ways to wire ``count`` parts as P parallel strings of S in series under the chain voltage.

    The least P comes first; S is as small as P allows; no way has more strings than parts.
    """
    s_max = F.floor(chain_max / vf).cast("int")
    p_min = F.ceil(count / s_max).cast("int")

    def way(p: Column) -> Column:
        s = F.ceil(count / p).cast("int")
        return F.struct(p.alias("P"), s.alias("S"), (p * s - count).alias("led_add"), (s * vf).alias("V_chain"), (p * s).alias("total_leds"))

    ways = F.transform(F.sequence(p_min, F.greatest(p_min, F.least(count, p_min + most - 1))), way)
    none = F.array().cast("array<struct<P:int,S:int,led_add:int,V_chain:double,total_leds:int>>")
    return F.when((count > 0) & (vf > 0) & (F.floor(chain_max / F.when(vf > 0, vf)) >= 2), ways).otherwise(none)


def costs(total: Column, unit: Column, smt: float, rate: float) -> Column:
    """Part and assembly cost of a number of parts in both currencies."""
    rate_ = F.lit(max(float(rate), 1e-9))
    led = F.when((total > 0) & (unit > 0), total * unit).otherwise(0.0)
    mount = F.when(total > 0, total * F.lit(float(smt))).otherwise(0.0)
    return F.struct(
        led.alias("led_cost_rmb"), mount.alias("smt_cost_rmb"), (led + mount).alias("total_cost_rmb"),
        (led / rate_).alias("led_cost_usd"), (mount / rate_).alias("smt_cost_usd"), ((led + mount) / rate_).alias("total_cost_usd"),
    )


def rank(solved: DataFrame, chain_max: float, smt: float, rate: float) -> DataFrame:
    """Converged rows that can be wired, the cheapest first way first; ties in order of id."""
    # sorting samples its input first; the solver should not run for that as well
    wired = checkpointed(solved).withColumn("solutions", topologies(F.col("led_count"), F.col("vf_at_target"), F.lit(float(chain_max))))
    wired = wired.where((F.size("solutions") > 0) & F.col("converged"))
    wired = wired.withColumn("cost", costs(F.col("solutions")[0]["total_leds"], number(F.col("rmb")), smt, rate))
    return wired.orderBy("cost.total_cost_rmb", "id")


def presented(ranked: DataFrame, optical: float, efficacy: float, smt: float, rate: float, most: int = 10) -> DataFrame:
    """One row a way: the fixture's flux and power with the current, power and cost of the way."""
    rows = ranked.withColumn("_t", F.col("solutions")[0]["total_leds"])
    fixture = F.col("lumen_at_target") * F.col("_t") * optical
    rows = rows.withColumns({"fixture_lm": fixture, "input_power": F.when(F.lit(efficacy) > 0, fixture / F.lit(efficacy)).otherwise(0.0)})
    rows = rows.select("id", "fixture_lm", "input_power", "target_if", "rmb", F.posexplode(F.slice("solutions", 1, most)).alias("way", "s"))
    current = F.col("target_if") * F.col("s.P")
    return rows.select(
        "id", (F.col("way") + 1).alias("way"), "fixture_lm", "input_power", "s.*", current.alias("total_current"),
        (F.col("s.V_chain") * current / 1000).alias("power_watts"), costs(F.col("s.total_leds"), number(F.col("rmb")), smt, rate).alias("cost"),
    ).select("*", "cost.*").drop("cost")
