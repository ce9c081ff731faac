"""Line dedup by winnowing over line hashes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, free_prefix, let, materialize, parted, require, screen

#: A run is repeated if it has so many lines; this is the winnowing guarantee.
GUARANTEE = 2

_HAS_WORD = r"[^\x20\x09-\x0D]"


def _units(text: Column) -> Column:
    """``(line, h)`` of each line that has a word, in order: its number from 0 and its hash."""
    unit = lambda line, i: F.when(line.rlike(_HAS_WORD), F.struct(i.alias("line"), F.xxhash64(line).alias("h")))
    return F.filter(F.transform(F.split(text, "\n"), unit), lambda u: u.isNotNull())


def _minima(units: Column, size: int) -> Column:
    """The window minima of a text: ``(h, place, start, zone)`` of each.

    Of each window of ``size`` units the least hash is selected, the leftmost of equal ones; neighbouring windows mostly select the same
    place, which counts once. ``zone`` has the hashes of all units of the windows that select it, from unit ``start`` on.
    """

    def of(hashes: Column) -> Column:
        def least(start: Column) -> Column:
            some = F.slice(hashes, start + 1, size)
            return start + F.array_position(some, F.array_min(some)).cast("int") - 1

        def selected(places: Column) -> Column:  # of each window; the places ascend
            heads = F.filter(F.transform(places, lambda p, i: F.when((i == 0) | (p != F.get(places, i - 1)), i)), lambda i: i.isNotNull())

            def mark(heads: Column) -> Column:
                def one(start: Column, k: Column) -> Column:
                    windows = F.coalesce(F.get(heads, k + 1), F.size(places)) - start
                    place = F.get(places, start)
                    return F.struct(F.get(hashes, place).alias("h"), place.alias("place"), start.alias("start"), F.slice(hashes, start + 1, windows + size - 1).alias("zone"))

                return F.transform(heads, one)

            return let(heads, mark)

        return let(F.transform(F.sequence(F.lit(0), F.size(hashes) - size), least), selected)

    return F.when(F.size(units) >= size, let(F.transform(units, lambda u: u["h"]), of))


def fingerprints(docs: DataFrame, guarantee: int = GUARANTEE) -> DataFrame:
    """``doc_id, h, place, start, zone``: the window minima of each text. Two runs of ``guarantee`` equal lines share one at least."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.explode(_minima(_units(F.col("text")), guarantee)).alias("m"))
    return rows.select("doc_id", "m.*")


def repeated_runs(docs: DataFrame, guarantee: int = GUARANTEE) -> DataFrame:
    """``doc_id, runs``: the runs of each document that also stand earlier, where there are any.

    A run ``(start, length, first_doc, first_start)`` counts units, the lines with a word, from 0; it is as long as its copy at
    ``first_start`` of ``first_doc`` matches it. Runs can overlap where their copies differ.
    """
    marks = materialize(fingerprints(docs, guarantee), "line-marks")
    at = F.struct("doc_id", "place")
    shared = marks.groupBy("h").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a != b").select("h")
    shared = materialize(shared, "shared-marks")
    # positions of a fingerprint meet; from each the match goes on to both sides, window by window
    met = screen(marks, "h", shared).join(shared, "h")
    whole = F.transform(F.sequence(F.lit(0), F.size("zone") - guarantee), lambda i: F.struct((F.col("start") + i).alias("unit"), F.xxhash64(F.slice("zone", i + 1, guarantee)).alias("whole")))
    windows = materialize(met.select("doc_id", F.inline(whole)), "line-windows")
    drop(marks, shared)
    at = F.struct("doc_id", "unit")
    first = windows.groupBy("whole").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first != last")
    first = materialize(first.select("whole", "first"), "first-windows")
    later = windows.join(first, "whole").where(at > F.col("first"))
    # windows in a row whose first copies are in a row as well make one run
    step = F.struct("unit", F.col("first.doc_id").alias("doc"), F.col("first.unit").alias("of"))
    found = later.groupBy("doc_id").agg(F.sort_array(F.collect_set(step)).alias("steps"))

    def runs(steps: Column) -> Column:
        def begins(s: Column, i: Column) -> Column:
            b = F.get(steps, i - 1)
            return (i > 0) & (b["unit"] + 1 == s["unit"]) & (b["doc"] == s["doc"]) & (b["of"] + 1 == s["of"])

        heads = F.filter(F.transform(steps, lambda s, i: F.when(F.coalesce(begins(s, i), F.lit(False)), F.lit(None).cast("int")).otherwise(i)), lambda i: i.isNotNull())

        def run(heads: Column) -> Column:
            def one(h: Column, k: Column) -> Column:
                s, n = F.get(steps, h), F.coalesce(F.get(heads, k + 1), F.size(steps)) - h
                return F.struct(s["unit"].alias("start"), (n + (guarantee - 1)).alias("length"), s["doc"].alias("first_doc"), s["of"].alias("first_start"))

            return F.transform(heads, one)

        return let(heads, run)

    out = materialize(found.select("doc_id", let(F.col("steps"), runs).alias("runs")), "line-runs")
    drop(windows, first)
    return out


def dedup_lines(docs: DataFrame, guarantee: int = GUARANTEE, prefix: str = "") -> DataFrame:
    """Deletes the later copies of repeated runs of lines; all columns stay, ``n_lines`` and ``n_removed`` are added.

    The units of a text are its lines that have a word. Winnowing selects the least hash of every window of ``guarantee`` units as a
    fingerprint, so that any run of that many units that occurs twice shares one. Places of one fingerprint are joined, the match is
    extended both ways over the windows that select it, and windows that go on where their copies do make up the maximal run. A
    line is deleted if it lies in a window that also starts earlier (at a smaller doc_id, or earlier in the same document).
    The first copy always stays, and so do lines without a word. Lines are compared by 64-bit hashes.

    Null texts and rows without an id stay as they are, with ``n_removed`` 0 (and ``n_lines`` 0 for a null text); an empty text has no
    unit and one line; a document of which nothing is left has an empty text; a text of fewer units than ``guarantee`` loses
    nothing. Rows that share a doc_id are one document: they count as one place and lose the same units, so exact
    repeats of a row do not delete each other. An empty table gives no rows. Long texts are handled in time linear in their
    lines; all lines of one text are in memory at once. Columns of the input named like the two new ones are
    replaced, unless a ``prefix`` for these keeps them apart. Fingerprints and windows that make up a large
    share of all are combined on the map side or meet in joins of two plain exchanges, which adaptive execution splits.
    """
    require(docs, ["doc_id", "text"])
    n_lines, n_removed = f"{prefix}n_lines", f"{prefix}n_removed"
    docs = docs.drop(n_lines, n_removed)
    own = free_prefix([*docs.columns, n_lines, n_removed])
    id_, gone, left = f"{own}id", f"{own}gone", f"{own}left"
    spans = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    runs = repeated_runs(docs.select("doc_id", "text"), guarantee)
    changed, whole = parted(docs, "doc_id", runs.select("doc_id"))
    changed = changed.join(runs.select(F.col("doc_id").alias(id_), F.array_distinct(spans).alias(gone)), F.col("doc_id") == F.col(id_), "left").drop(id_)
    out = changed.unionByName(whole.withColumn(gone, F.lit(None).cast("array<int>")))  # the others need no exchange

    def kept(lines: Column) -> Column:
        lost = let(_units(F.col("text")), lambda units: F.transform(gone, lambda u: F.get(units, u)["line"]))
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost), lambda i: F.get(lines, i))

    out = out.withColumn(left, F.when(F.col(gone).isNotNull(), let(F.split("text", "\n"), kept)))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    out = out.withColumn(n_lines, lines).withColumn(n_removed, F.when(F.col(left).isNull(), 0).otherwise(F.col(n_lines) - F.size(left)).cast("long"))
    return out.withColumn("text", F.when(F.col(left).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).drop(gone, left)
