"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column, default: float = 0.0) -> Column:
    """The value as a double, or the default where it cannot be read as one."""
    return F.coalesce(value.try_cast("double"), F.lit(float(default)))


def polynomial(x: Column, coefficients: Column) -> Column:
    """Ascending coefficients at x; a null one counts as 0."""
    terms = F.transform(coefficients, lambda c, i: F.coalesce(c, F.lit(0.0)) * F.pow(x, i))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def derivative(x: Column, coefficients: Column) -> Column:
    terms = F.transform(coefficients, lambda c, i: F.when(i > 0, F.coalesce(c, F.lit(0.0)) * i * F.pow(x, i - 1)).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def reindexed(descending: Column, size: int = 7) -> Column:
    """Coefficients from the highest power down, as ``size`` ascending ones; missing ones are 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.get(F.reverse(descending), i), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, added up as doubles."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, t: acc + t
    )


def normalized(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: (x / F.when(n == 0, 1.0).otherwise(n)).cast("float"))


def whole_price(price: Column) -> Column:
    """The nearest whole price, halves to even."""
    return F.bround(price.cast("double"), 0)


def snap(price: Column, step: float) -> Column:
    """The nearest multiple of ``step``, halves up."""
    return F.floor(price / step + 0.5) * F.lit(step)


def gap_matches(buy: Column, sell: Column, gap: float) -> Column:
    return whole_price(sell) - whole_price(buy) == F.bround(F.lit(float(gap)), 0)


def clamp(value: Column, low: float, high: float | None = None) -> Column:
    value = F.greatest(value, F.lit(float(low)))
    return value if high is None else F.least(value, F.lit(float(high)))


def grid_bound(length: Column, item: Column, gap: Column) -> Column:
    """How many items with gaps between them fit a length; 0 for an item without extent."""
    return F.when(item <= 0, 0).otherwise(F.greatest(F.lit(0), F.floor((length + gap) / (item + gap)))).cast("int")


def thousands(value: Column, digits: int = 0) -> Column:
    """The value with separators, halves away from zero."""
    return F.format_number(F.round(value, digits), digits)


def planckian(kelvin: Column) -> Column:
    """Chromaticity (x, y) of a black body between 1667 and 25000 K by piecewise cubics (fixed coefficients); else null."""
    t = F.lit(1000.0) / kelvin
    cubic = lambda v, a, b, c, d: a * v * v * v + b * v * v + c * v + d
    x = F.when(kelvin <= 4000, cubic(t, -0.2661239, -0.2343580, 0.8776956, 0.179910)).otherwise(
        cubic(t, -3.0258469, 2.1070379, 0.2226347, 0.240390)
    )
    y = (
        F.when(kelvin <= 2222, cubic(x, -1.1063814, -1.34811020, 2.18555832, -0.20219683))
        .when(kelvin <= 4000, cubic(x, -0.9549476, -1.37418593, 2.09137015, -0.16748867))
        .otherwise(cubic(x, 3.0817580, -5.87338670, 3.75112997, -0.37001483))
    )
    inside = (kelvin >= 1667) & (kelvin <= 25000)
    return F.when(inside, F.struct(x.alias("x"), y.alias("y")))
