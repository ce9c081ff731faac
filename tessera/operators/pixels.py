"""Curves in pictures of plots: pixels as rows, filters as windows over rows and columns, stretches of dark pixels as a graph."""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpointed

#: Width of the neighbourhood of a threshold, how much darker than it a pixel must be, and the part of a picture that a grid line spans (fixed values).
BLOCK, DARKER, LINE_PART = 25, 20, 3
#: The neighbours in a burr's kernel (a fixed value): the pixel, the one above and the one to its left.
_BURR = ((0, 0), (-1, 0), (0, -1))


def _weights(size: int) -> list[float]:
    """A normal curve over ``size`` pixels that sums up to 1, as wide as pictures are commonly smoothed at that size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [w / sum(raw) for w in raw]


def _across(key: str) -> Window:
    return Window.partitionBy(key, "y").orderBy("x")


def _down(key: str) -> Window:
    return Window.partitionBy(key, "x").orderBy("y")


def _smoothed(value: Column, line: Window, size: int) -> Column:
    """The weighted mean of the pixels around each one of a line; those beyond its ends count as its ends."""
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    out = F.lit(0.0)
    for i, w in enumerate(_weights(size)):
        k = i - size // 2
        out = out + w * (F.coalesce(F.lag(value, -k).over(line), first) if k < 0 else F.coalesce(F.lead(value, k).over(line), last))
    return out


def dark(pixels: DataFrame, key: str = "image", size: int = BLOCK, darker: int = DARKER) -> DataFrame:
    """Adds ``dark``: whether a pixel's level lies ``darker`` or more below the rounded mean around it, weighted by a normal curve."""
    rows = pixels.withColumn("_h", _smoothed(F.col("level").cast("double"), _across(key), size))
    rows = rows.withColumn("_mean", F.bround(_smoothed(F.col("_h"), _down(key), size), 0))
    return rows.withColumn("dark", F.col("level") - F.col("_mean") <= -darker).drop("_h", "_mean")


def without_lines(rows: DataFrame, key: str = "image", part: int = LINE_PART) -> DataFrame:
    """Adds ``clean``: dark pixels that lie on no straight dark stretch of a third of the picture's width or height.

    Such a stretch is what an opening by a line of that length leaves, so stretches are measured instead of sliding minima and maxima.
    """
    sizes = rows.groupBy(key).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    rows = rows.join(sizes, key)

    def stretch(line: Window, name: str, rows: DataFrame) -> DataFrame:
        begins = F.col("dark") & ~F.coalesce(F.lag("dark").over(line), F.lit(False))
        rows = rows.withColumn("_run", F.sum(begins.cast("int")).over(line))
        other = "y" if name == "_across" else "x"
        return rows.withColumn(name, F.when(F.col("dark"), F.count_if("dark").over(Window.partitionBy(key, other, "_run"))).otherwise(0)).drop("_run")

    rows = stretch(_down(key), "_down", stretch(_across(key), "_across", rows))
    line = (F.col("_across") >= F.greatest(F.floor(F.col("_w") / part), F.lit(1))) | (F.col("_down") >= F.greatest(F.floor(F.col("_h") / part), F.lit(1)))
    return rows.withColumn("clean", F.col("dark") & ~line).drop("_w", "_h", "_across", "_down")


def _fold(rows: DataFrame, column: str, key: str, any_: bool) -> DataFrame:
    """A pixel becomes dark if any (or all) of itself and its neighbours in the kernel are; neighbours beyond the edge do not count."""
    at = {(0, 0): F.col(column), (-1, 0): F.lag(column).over(_down(key)), (0, -1): F.lag(column).over(_across(key))}
    values = [F.coalesce(at[d], F.lit(not any_)) for d in _BURR]
    return rows.withColumn(column, F.greatest(*values) if any_ else F.least(*values))


def healed(rows: DataFrame, key: str = "image") -> DataFrame:
    """Adds ``healed``: clean pixels with small gaps closed and then small burrs taken off."""
    rows = rows.withColumn("healed", F.col("clean"))
    for any_ in (True, False, False, True):
        rows = _fold(rows, "healed", key, any_)
    return rows


def _labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label``: the least node that edges reach. Each round takes the least label around, and then that label's own."""
    both = checkpointed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpointed(nodes.select("node", F.col("node").alias("label")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        next_ = labels.join(around, "node", "left").select("node", F.least("label", F.coalesce("_near", "label")).alias("label"), F.col("label").alias("_was"))
        jump = next_.select(F.col("node").alias("label"), F.col("label").alias("_far"))
        next_ = checkpointed(next_.join(jump, "label").select("node", F.least("label", "_far").alias("label"), "_was"))
        if not next_.where(F.col("label") != F.col("_was")).take(1):
            return next_.select("node", "label")
        labels = next_.select("node", "label")


def largest_part(rows: DataFrame, key: str = "image", column: str = "healed") -> DataFrame:
    """Adds ``mask``: the pixels of the largest connected dark part of each picture, of equal ones that with the uppermost, then leftmost pixel.

    Pixels that touch, also at a corner, are connected. Stretches of a row are the nodes of a graph, those of neighbouring rows that touch
    its edges, so the graph is much smaller than the picture.
    """
    line = _across(key)
    begins = F.col(column) & ~F.coalesce(F.lag(column).over(line), F.lit(False))
    rows = checkpointed(rows.withColumn("_run", F.sum(begins.cast("int")).over(line)))
    runs = rows.where(column).groupBy(key, "y", "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    runs = checkpointed(runs.withColumn("node", F.struct(key, "y", "x0")))
    above = runs.select(key, (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("node").alias("b"))
    edges = runs.join(above, [key, "y"]).where((F.col("u0") <= F.col("x1") + 1) & (F.col("x0") <= F.col("u1") + 1)).select(F.col("node").alias("a"), "b")
    labelled = runs.join(_labels(runs, edges), "node").withColumn("_n", F.col("x1") - F.col("x0") + 1)
    parts = labelled.groupBy(key, "label").agg(F.sum("_n").alias("_area"))
    best = parts.groupBy(key).agg(F.max_by("label", F.struct("_area", (-F.col("label.y")).alias("y"), (-F.col("label.x0")).alias("x"))).alias("label"))
    kept = labelled.join(best, [key, "label"]).select(key, "y", "_run", F.lit(True).alias("_kept"))
    return rows.join(kept, [key, "y", "_run"], "left").withColumn("mask", F.col(column) & F.coalesce("_kept", F.lit(False))).drop("_run", "_kept")


def plot_mask(pixels: DataFrame, key: str = "image") -> DataFrame:
    """``key, x, y, level, dark, clean, healed, mask`` of pictures ``key, x, y, level`` with grey levels from 0 to 255: where the curve of a plot runs.

    Dark pixels by an adaptive threshold, without the long lines of the grid, with gaps closed and burrs taken off, and of those the largest
    connected part. Pictures must be whole, x and y from 0. A line of a picture, never a picture, must fit in a task.
    """
    rows = checkpointed(without_lines(dark(pixels.select(key, "x", "y", "level"), key), key))
    return largest_part(healed(rows, key), key)
