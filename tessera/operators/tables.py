"""Operators over ordinary tables: statistics, runs, latest rows, lookups, upserts and ordered unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.session import checkpointed


def column_statistics(df: DataFrame, columns: Sequence[str], label: str | None = None) -> DataFrame:
    """Minimum, maximum and mean of each column in three labelled rows; cells that are no numbers are skipped.

    Rows whose ``label`` already says min, max or average are left out first. The table is read once.
    """
    if label:
        df = df.where(~F.coalesce(F.lower(F.trim(F.col(label))).isin("min", "max", "average"), F.lit(False)))
    kinds = (("min", F.min), ("max", F.max), ("average", F.avg))
    value = lambda c: F.col(c).try_cast("double")
    flat = df.agg(*[f(value(c)).alias(f"{c}__{kind}") for kind, f in kinds for c in columns])
    rows = F.array(*[F.struct(F.lit(kind).alias("stat"), *[F.col(f"{c}__{kind}").alias(c) for c in columns]) for kind, _ in kinds])
    return flat.select(F.inline(rows))


def percent_of_total(df: DataFrame, group: str, value: Column, name: str = "total") -> DataFrame:
    """Sums by group with their share of the grand total in percent. The rows are aggregated once; the total is a window over the groups."""
    return shares(df.groupBy(group).agg(F.sum(value).alias(name)), name)


def shares(sums: DataFrame, name: str) -> DataFrame:
    """Each row's share of the sum of a column, in percent; for aggregated rows, which one task holds."""
    return sums.withColumn("percent", 100.0 * F.col(name) / F.sum(name).over(Window.partitionBy(F.lit(1))))


def with_total(df: DataFrame, group: str, value: Column, unit: float = 1.0, label: str = "TOTAL") -> DataFrame:
    """Scaled sums by group and a line with the grand total."""
    sums = df.groupBy(F.col(group).cast("string").alias(group)).agg((F.sum(value) / unit).alias("amount"))
    return sums.unionByName(sums.agg(F.lit(label).alias(group), F.sum("amount").alias("amount")))


def grouped_in_order(df: DataFrame, key: str, order: Sequence[str], text: str, sep: str = "\n") -> DataFrame:
    """The texts of each group joined in order; rows without a key are left out."""
    item = F.struct(*order, F.col(text).alias("_text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["_text"]), sep)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(joined.alias(text), F.count("*").alias("n"))


def with_file_order(df: DataFrame, name: str = "place") -> DataFrame:
    """Rows of a scan with their place in the input, a struct of the file's path and the row's number in it, by which they sort."""
    return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def latest(df: DataFrame, key: str, version: str, payload: str, place: str) -> DataFrame:
    """The payload of the greatest version of each key, a number; of equal versions the first in ``place``, as ``with_file_order`` tells it.

    Rows without a version count only where a key has no other.
    """
    first = F.struct(F.col(version).isNull(), -F.col(version), F.col(place))
    best = df.groupBy(key).agg(F.min_by(F.struct(version, payload), first).alias("_best"))
    return best.select(key, f"_best.{version}", f"_best.{payload}")


def latest_dated(names: DataFrame, name: str = "name") -> DataFrame:
    """The newest ``prefix_YYMMDD.md`` of each prefix."""
    found = names.select(
        F.regexp_extract(name, r"(?i)^(.*)_\d{6}\.md$", 1).alias("prefix"), F.regexp_extract(name, r"(?i)_(\d{6})\.md$", 1).alias("datecode"), F.col(name).alias("name")
    )
    return found.where("datecode != ''").groupBy("prefix").agg(F.max(F.struct("datecode", "name")).alias("m")).select("prefix", "m.name", "m.datecode")


def numbered(df: DataFrame, key: str | None, order: Sequence[str | Column], name: str = "seq") -> DataFrame:
    """Rows numbered from 1 within their key; without a key over the whole table (``numbered_all``)."""
    if key is None:
        return numbered_all(df, order, name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def numbered_all(df: DataFrame, order: Sequence[str | Column], name: str = "seq", first: int = 1) -> DataFrame:
    """All rows numbered in order from ``first`` on, as a long, without a task that holds them all.

    Rows are dealt out by ranges of the order and sorted there, and each keeps its place in its range. The ranges are counted, and
    the sizes of those before it are added to a range's places. Sampled ranges differ from run to run, so the sorted rows are stored
    before they are counted. The order should end in a unique column: equal rows go to one range, in any order.
    """
    # a row's id tells its range in the upper bits and its place there in the lower 33
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    stored = checkpointed(dealt).withColumn("_range", F.shiftright("_id", 33))
    sizes = stored.groupBy("_range").agg(F.count("*").alias("_size")).collect()  # one row a range
    before, offsets = first, []
    for at, size in sorted(sizes):
        offsets.append((at, before))
        before += size
    place = df.sparkSession.createDataFrame(offsets, "_range long, _before long")
    return stored.join(F.broadcast(place), "_range").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_range", "_id", "_before")


def in_runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows with the number ``run`` of the stretch of neighbours with one value that they lie in, from 1."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Neighbouring rows with one value as runs: ``key, run, value, first, last, n``; runs count from 1."""
    tagged = in_runs(df, key, order, value)
    return tagged.groupBy(key, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def longest_run(df: DataFrame, key: str, number: str) -> DataFrame:
    """The longest stretch of consecutive whole numbers of each key; the first of equal ones."""
    w = Window.partitionBy(key).orderBy(number)
    distinct = df.select(key, number).distinct()
    island = distinct.withColumn("_i", F.col(number) - F.row_number().over(w))
    sized = island.groupBy(key, "_i").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return sized.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, "first", "last", "n")


def forward_fill(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Nulls take the last value before them within the key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def running_count(df: DataFrame, key: str, order: str, mark: Column, name: str = "depth") -> DataFrame:
    """How many marked rows there are up to each row."""
    return df.withColumn(name, F.count_if(mark).over(Window.partitionBy(key).orderBy(order)))


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], value: str, default: object) -> DataFrame:
    """A left join to a table of values, with a default where the key is missing."""
    return df.join(table, list(on), "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def override(df: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """Values of ``overrides(key, column)`` replace those of the rows with that key."""
    new = overrides.select(key, F.col(column).alias("_new"))
    return df.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def require_columns(left: DataFrame, right: DataFrame) -> None:
    if set(left.columns) != set(right.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with rows of equal keys replaced and the others added; the columns must be the same."""
    require_columns(table, rows)
    return table.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last in order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def clone_override(table: DataFrame, name: str, changes: dict[str, Column]) -> DataFrame:
    """Every row twice: as it is with ``_old`` behind its name, and with the changes and ``_new``."""
    old = table.withColumn(name, F.concat(F.col(name), F.lit("_old")))
    new = table.withColumns(changes).withColumn(name, F.concat(F.col(name), F.lit("_new")))
    return old.unionByName(new)


def ordered_union(frames: Sequence[DataFrame], value: str) -> DataFrame:
    """Distinct values of several frames ``(value, pos)`` in the order of their first place, ties by value: ``value, place``."""
    tagged = [f.select(F.col(value), F.lit(i).alias("_f"), "pos") for i, f in enumerate(frames)]
    first = reduce(DataFrame.unionByName, tagged).groupBy(value).agg(F.min(F.struct("_f", "pos")).alias("_at"))
    return numbered_all(first, ["_at", value], "place").drop("_at")


def options(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct combinations without nulls, in order."""
    whole = " and ".join(f"{c} is not null" for c in columns)
    return df.where(whole).select(*columns).distinct().orderBy(*columns)


def kth(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """The k-th row in order, from 1."""
    return df.orderBy(*order).offset(k - 1).limit(1)


def page(df: DataFrame, order: Sequence[str | Column], limit: int) -> DataFrame:
    """The first rows in order, each with the number of all rows and of those shown."""
    total = df.agg(F.count("*").alias("total"))  # one row
    out = df.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))
    return out.withColumn("shown", F.least(F.col("total"), F.lit(limit)))


def median_at_minimum(points: DataFrame, x: str, y: str, level: str) -> DataFrame:
    """For each x the median y of the rows at its lowest level.

    Lowest levels come from a partial aggregation and are joined back, so no task holds all rows of an x, and
    the rows above them are gone before the medians; those are counted by distinct y, also partially.
    """
    low = points.groupBy(F.col(x).alias("_x")).agg(F.min(level).alias("_low"))
    at = points.join(low, (F.col(x).eqNullSafe(F.col("_x"))) & (F.col(level) == F.col("_low")))
    return _median(at, [F.col(x)], y)


def _median(df: DataFrame, keys: Sequence[Column], y: str) -> DataFrame:
    """Medians from the counts of distinct values: equal ones are added up before they are exchanged."""
    counted = df.groupBy(*keys, F.col(y)).agg(F.count("*").alias("_n"))
    names = [c for c in counted.columns if c not in (y, "_n")]
    return counted.groupBy(*names).agg(F.expr(f"percentile(`{y}`, 0.5, _n)").alias(y))


def collapse_by_median(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One point a whole x: the median of its y."""
    return _median(points, [F.col(key), F.bround(x, 0).alias(x)], y)


def fit_metrics(df: DataFrame, key: str, x: str, y: str, predicted: Column) -> DataFrame:
    """RMSE, R squared and the errors at both ends of each group, in one pass."""
    rows = df.withColumn("_r", F.col(y) - predicted)
    ends = (F.abs(F.min_by("_r", x)) + F.abs(F.max_by("_r", x))).alias("endpoint_error")
    total = F.sum(F.col(y) * F.col(y)) - F.count("*") * F.avg(y) * F.avg(y)
    squared = F.sum(F.col("_r") * F.col("_r"))
    r2 = F.when(total > 0, 1 - squared / total).otherwise(0.0)
    return rows.groupBy(key).agg(F.sqrt(squared / F.count("*")).alias("rmse"), r2.alias("r2"), ends)


def sign_changes(df: DataFrame, key: str, x: str, f: str) -> DataFrame:
    """Of each sweep: the changes of sign, the x nearest to a root, and the greatest value."""
    w = Window.partitionBy(key).orderBy(x)
    crossed = F.coalesce(F.col(f) * F.lag(f).over(w) <= 0, F.lit(False))
    rows = df.withColumn("_c", crossed)
    return rows.groupBy(key).agg(
        F.count_if("_c").alias("changes"), F.min_by(x, F.struct(F.abs(f), F.col(x))).alias("nearest_x"), F.max(f).alias("greatest")
    )


def by_number(lines: DataFrame, line: str, order: str, pattern: str = r"bytes=(\d+)") -> DataFrame:
    """Lines of a log by the number found in them, the greatest first and equal ones as they came, stripped; lines without one are left out."""
    found = F.regexp_extract(line, pattern, 1)
    numbered = lines.where(found != "").withColumns({"number": found.try_cast("bigint"), line: strip(F.col(line))})
    return numbered.orderBy(F.desc("number"), order)


def number_totals(numbered: DataFrame) -> DataFrame:
    """One row: the sum of the numbers of ``by_number``, and as a text in units of 2^30 with three decimals; 0 of no lines."""
    total = F.coalesce(F.sum("number"), F.lit(0)).alias("total")
    return numbered.agg(total).withColumn("total_gb", F.format_string("%.3f", F.col("total") / (1 << 30)))


def by_side(orders: DataFrame, key: str, side: str) -> DataFrame:
    """How many orders of each key buy and sell."""
    low = F.lower(side)
    return orders.groupBy(key).agg(F.count_if(low == "buy").alias("buys"), F.count_if(low == "sell").alias("sells"))
