"""Board quotes: lookups with defaults, a cost rollup, and input checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import clamp

#: The laminate cost where the table has none (a fixed value).
LAMINATE = 15.0


def with_prices(inputs: DataFrame, materials: DataFrame, finishes: DataFrame, maskings: DataFrame, platings: DataFrame) -> DataFrame:
    """Adds the prices that the inputs name; a missing laminate costs ``LAMINATE``, other missing ones nothing."""
    out = inputs.join(materials.withColumnRenamed("price", "laminate"), ["material", "substrate", "copper"], "left")
    for table, key in ((finishes, "finish"), (maskings, "masking"), (platings, "plating")):
        out = out.join(table.withColumnRenamed("price", f"{key}_cost"), key, "left")
    costs = {f"{k}_cost": F.coalesce(f"{k}_cost", F.lit(0.0)) for k in ("finish", "masking", "plating")}
    return out.withColumns({"laminate": F.coalesce("laminate", F.lit(LAMINATE))} | costs)


def price(rows: DataFrame) -> DataFrame:
    """Adds the sections of the quote and its totals, unrounded.

    Boards of three or more layers pay for cores, prepreg, inner layers and stacking; drilling is shared by the
    panels of a stack; loss and margin are percentages, loss at most 100.
    """
    c = F.col
    boards, stack = F.greatest(F.coalesce(c("panel_boards"), F.lit(1)), F.lit(1)), F.greatest(F.coalesce(c("stack_qty"), F.lit(1)), F.lit(1))
    many = c("layers") >= 3
    cores = F.when(many, F.ceil(c("layers") / 2 - 1)).otherwise(1)
    extra = clamp(c("pp_cost"), 0) * F.ceil(c("layers") / 2) + clamp(c("inner_cost"), 0) * (c("layers") - 2) + clamp(c("stacking_cost"), 0)
    return (
        rows.withColumns(
            {
                "material_cost": c("laminate") * cores,
                "multi_layer_cost": F.when(many, extra).otherwise(0.0),
                "treatment_cost": c("finish_cost") + c("etching_cost") + c("masking_cost") + c("silkscreen_cost"),
                "cnc_cost": clamp(c("cnc_rate"), 0) * F.greatest(c("cnc_holes"), F.lit(0)) * boards / stack,
                "process_cost": c("plating_cost") + clamp(c("routing_length"), 0) * boards * clamp(c("routing_rate"), 0) + clamp(c("stamping_cost"), 0) + clamp(c("post_cost"), 0),
                "overhead_cost": clamp(c("water"), 0) + clamp(c("electricity"), 0) + clamp(c("labor"), 0),
            }
        )
        .withColumn("base", c("material_cost") + c("multi_layer_cost") + c("treatment_cost") + c("cnc_cost") + c("process_cost") + c("overhead_cost"))
        .withColumn("cogs", c("base") * (1 + clamp(c("loss_pct"), 0, 100) / 100))
        .withColumns({"loss_cost": c("cogs") - c("base"), "cogs_unit": c("cogs") / boards, "margin_cost": c("cogs") * clamp(c("margin_pct"), 0) / 100})
        .withColumn("price_unit", c("cogs_unit") * (1 + clamp(c("margin_pct"), 0) / 100))
    )


#: What each input must satisfy and what is said if it does not.
CHECKS = (
    ("layers between 1 and 40", "layers between 1 and 40"),
    ("panel_boards >= 1", "panel_boards at least 1"),
    ("stack_qty >= 1", "stack_qty at least 1"),
    *((f"{c} >= 0", f"{c} not negative") for c in ("cnc_holes", "routing_length", "stamping_cost", "post_cost", "labor", "pp_cost", "inner_cost", "stacking_cost")),
)


def problems() -> Column:
    """What is wrong with a row's inputs, in order; null inputs are taken as their defaults."""
    said = [F.when(~F.coalesce(F.expr(test), F.lit(True)), F.lit(text)) for test, text in CHECKS]
    return F.filter(F.array(*said), lambda s: s.isNotNull())


def line_totals(lines: DataFrame, key: str) -> DataFrame:
    """Line totals to six places and their subtotal."""
    total = F.round(F.col("qty") * F.col("unit_price"), 6)
    return lines.withColumn("total", total).groupBy(key).agg(F.round(F.sum("total"), 6).alias("subtotal"), F.count("*").alias("n_lines"))


def stack_quantity(inputs: DataFrame, table: DataFrame) -> DataFrame:
    """The boards drilled at once by thickness and hole, at least 1; null where the table has none."""
    return inputs.join(table, ["thickness", "hole"], "left").withColumn("stack_qty", F.when(F.col("stack_qty").isNotNull(), F.greatest("stack_qty", F.lit(1))))
