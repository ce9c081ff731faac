"""Panel layouts: enumerated by exploding sequences, bounded like a search, ranked and deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import grid_bound

EPS = 1e-9
#: What a board is described by.
DIMENSIONS = (
    "single_w", "single_l", "board_w", "board_l", "board_w_min", "board_l_min", "edge_w", "edge_l", "margin_w", "margin_l", "gap_single_w", "gap_single_l", "gap_board_w", "gap_board_l",
)
#: Styles that take single boards only if one side exceeds 600 (fixed values).
LARGE_STYLES = ("A5", "A6", "A7", "B5", "B6", "B7")


def gate(styles: DataFrame, sets: str, single_w: Column | float, single_l: Column | float) -> DataFrame:
    """Styles of the enabled sets; the large ones need a long single board."""
    long = [x if isinstance(x, Column) else F.lit(float(x)) for x in (single_w, single_l)]
    large = ~F.col("style").isin(*LARGE_STYLES) | (long[0] > 600) | (long[1] > 600)
    return styles.where(F.upper(F.substring("style", 1, 1)).isin(*sets) & large)


def enumerate_layouts(styles: DataFrame, cfg: dict, *key: str) -> DataFrame:
    """All layouts of ``styles(style, panel_w, panel_l, multiplier)`` that a bounded search keeps, for each ``key`` on its own.

    A dimension is that of a column of its name, where there is one, else that of ``cfg``, so a table of many boards
    with their styles is laid out at once. Boards and single boards may be turned. Nested counts explode within their bounds, in the order of
    nested loops. A search drops a group of counts if its bound is below the best count found before it in
    its style; since a dropped group can never raise that best count, it is the running maximum over all.
    """
    given = {k: f"_given_{k}" for k in DIMENSIONS if k in styles.columns}
    styles = styles.withColumnsRenamed(given)
    c, lit = F.col, lambda k: F.col(given[k]) if k in given else F.lit(float(cfg.get(k, 0.0)))
    single_w, single_l = lit("single_w"), lit("single_l")
    styles = styles.where((single_w + single_l > 49.9) & (single_w > 9.9) & (single_l > 9.9))
    turns = lambda flag: F.array(*[F.lit(x) for x in ([False, True] if cfg.get(flag) else [False])])
    either = lambda turned, a, b: F.when(turned, b).otherwise(a)
    count = lambda n: F.when(n >= 1, F.sequence(F.lit(1), n))
    rows = styles.withColumn("board_rot", F.explode(turns("rotate_board"))).withColumn("single_rot", F.explode(turns("rotate_single")))
    rows = rows.withColumns(
        {
            "_cw": either(c("board_rot"), lit("board_w"), lit("board_l")), "_cl": either(c("board_rot"), lit("board_l"), lit("board_w")),
            "_nw": either(c("board_rot"), lit("board_w_min"), lit("board_l_min")), "_nl": either(c("board_rot"), lit("board_l_min"), lit("board_w_min")),
            "_mw": either(c("board_rot"), lit("edge_w"), lit("edge_l")), "_ml": either(c("board_rot"), lit("edge_l"), lit("edge_w")),
            "_sw": either(c("single_rot"), single_w, single_l), "_sl": either(c("single_rot"), single_l, single_w),
        }
    )
    rows = rows.withColumns({"_iw": c("_cw") - 2 * c("_mw"), "_il": c("_cl") - 2 * c("_ml")}).where("_iw > 0 and _il > 0")
    rows = rows.withColumn("nw", F.explode(count(grid_bound(c("_iw"), c("_sw"), lit("gap_single_w")))))
    rows = rows.withColumn("nl", F.explode(count(grid_bound(c("_il"), c("_sl"), lit("gap_single_l")))))
    rows = rows.withColumns({"_gw": c("nw") * c("_sw") + (c("nw") - 1) * lit("gap_single_w"), "_gl": c("nl") * c("_sl") + (c("nl") - 1) * lit("gap_single_l")})
    rows = rows.where((c("_gw") <= c("_iw") + EPS) & (c("_gl") <= c("_il") + EPS))
    rows = rows.withColumns({"board_w": c("_gw") + 2 * c("_mw"), "board_l": c("_gl") + 2 * c("_ml")})
    rows = rows.where((c("board_w") + EPS >= c("_nw")) & (c("board_l") + EPS >= c("_nl")))
    rows = rows.withColumns({"_aw": c("panel_w") - 2 * lit("margin_w"), "_al": c("panel_l") - 2 * lit("margin_l")}).where("_aw > 0 and _al > 0")
    rows = rows.withColumns({"_ubw": grid_bound(c("_aw"), c("board_w"), lit("gap_board_w")), "_ubl": grid_bound(c("_al"), c("board_l"), lit("gap_board_l"))})
    rows = rows.where("_ubw > 0 and _ubl > 0").withColumn("_bound", c("_ubw") * c("_ubl") * c("nw") * c("nl") * c("multiplier"))
    rows = rows.withColumn("nbw", F.explode(count(c("_ubw")))).withColumn("nbl", F.explode(count(c("_ubl"))))
    rows = rows.withColumns(
        {"used_w": c("nbw") * c("board_w") + (c("nbw") - 1) * lit("gap_board_w") + 2 * lit("margin_w"), "used_l": c("nbl") * c("board_l") + (c("nbl") - 1) * lit("gap_board_l") + 2 * lit("margin_l")}
    )
    rows = rows.where((c("used_w") <= c("panel_w") + EPS) & (c("used_l") <= c("panel_l") + EPS))
    # the last single board must not pass the board's edge; this test has no tolerance
    last_w, last_l = c("_mw") + (c("nw") - 1) * (c("_sw") + lit("gap_single_w")), c("_ml") + (c("nl") - 1) * (c("_sl") + lit("gap_single_l"))
    rows = rows.withColumns(
        {
            "singles": c("nbw") * c("nbl") * c("nw") * c("nl"),
            "fits": (last_w + c("_sw") <= c("board_w")) & (last_l + c("_sl") <= c("board_l")),
            "unused": c("panel_w") * c("panel_l") - c("used_w") * c("used_l"),
            "uneven": F.abs(lit("margin_w") - (c("panel_w") - c("used_w"))) + F.abs(lit("margin_l") - (c("panel_l") - c("used_l"))),
            "rotations": c("board_rot").cast("int") + c("single_rot").cast("int"),
        }
    )
    rows = rows.withColumns({"per_jumbo": c("singles") * c("multiplier"), "utilization": c("singles") * single_w * single_l / (c("panel_w") * c("panel_l"))})
    # a group's rows compete with what was found before the group, not with each other
    order = F.struct("board_rot", "single_rot", "nw", "nl")
    grouped = rows.withColumn("_group", order)
    best = grouped.groupBy(*key, "style", "_group").agg(F.max(F.when(c("fits"), c("per_jumbo"))).alias("_reached"))
    before = Window.partitionBy(*key, "style").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_before", F.coalesce(F.max("_reached").over(before), F.lit(0))).drop("_reached")
    kept = grouped.join(best, [*key, "style", "_group"]).where("_bound >= _before")
    return kept.drop(*[x for x in kept.columns if x.startswith("_")])


def rank_layouts(layouts: DataFrame, *key: str) -> DataFrame:
    """Layouts of each ``key`` by boards per sheet, use of area and the further aims; of layouts that differ in turns only, the least
    turned stands at the place of the first: ``place`` from 1."""
    board = key or (F.lit(1),)  # one board's layouts are few
    order = [F.desc("per_jumbo"), F.desc("utilization"), F.desc("singles"), "unused", "uneven", "rotations", "style", "nbw", "nbl", "nw", "nl", "board_rot", "single_rot"]
    numbered = layouts.withColumn("_pos", F.row_number().over(Window.partitionBy(*board).orderBy(*order)))
    turned = F.col("board_rot").cast("int") + 2 * F.col("single_rot").cast("int")
    same = [*key, "style", "singles", "nbw", "nbl", "nw", "nl"]
    rest = F.struct(*[c for c in layouts.columns if c not in same])
    one = numbered.groupBy(*same).agg(F.min("_pos").alias("_pos"), F.min_by(rest, F.struct(turned, "_pos")).alias("r"))
    return one.select(*same, "r.*", F.row_number().over(Window.partitionBy(*board).orderBy("_pos")).alias("place"))


def overlapping(rects: DataFrame, key: str) -> DataFrame:
    """Pairs of rectangles ``(key, i, x0, y0, x1, y1)`` of one layout that overlap."""
    a, b = rects.alias("a"), rects.alias("b")
    met = (
        (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.i") < F.col("b.i"))
        & (F.col("a.x0") < F.col("b.x1") - EPS) & (F.col("b.x0") < F.col("a.x1") - EPS)
        & (F.col("a.y0") < F.col("b.y1") - EPS) & (F.col("b.y0") < F.col("a.y1") - EPS)
    )
    return a.join(b, met).select(F.col(f"a.{key}"), F.col("a.i").alias("i"), F.col("b.i").alias("j"))


def utilization(singles: Column, single_w: float, single_l: float, panel_w: Column, panel_l: Column) -> Column:
    return F.when((panel_w > 0) & (panel_l > 0), singles * single_w * single_l / (panel_w * panel_l)).otherwise(0.0)
