"""Queries over invented catalogues, curves, quotes and layouts, whose operators no table exercises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.operators import curves as C
from tessera.operators import layout as L
from tessera.operators import parts as P
from tessera.operators import quote as Q
from tessera.operators import tables as B
from tessera.session import table
from tessera.streaming import grid as G
from tessera.plans.registry import Registry

query = Registry()


@query("""SELECT p_partkey, round(1.5 + 0.25 * p_size - 0.01 * p_size * p_size, 8) AS value, round(0.25 - 0.02 * p_size, 8) AS slope FROM part""")
def poly_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.array(F.lit(1.5), F.lit(0.25), F.lit(-0.01), F.lit(None).cast("double"))
    x = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(N.polynomial(x, c), 8).alias("value"), F.round(N.derivative(x, c), 8).alias("slope"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as invented components: their size and price give a flux, a current range and curves."""
    p, s = table(spark, sf_dir, "part"), F.col("p_size").cast("double")
    arr = lambda *v: F.array(*[x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in v])
    return p.select(
        F.col("p_partkey").alias("id"), (100 + s).alias("lm_test"), (300 + 10 * s).alias("if_max"), F.lit(60.0).alias("if_start"),
        (F.col("p_retailprice") / 1000).alias("rmb"), arr(2.6, 0.0012).alias("fiv"), arr(0.02, 0.0098, -0.000004).alias("fil"),
        arr(1.0, -0.001).alias("ftl"), arr(1.01, -0.0004).alias("ftv"),
    )


def _solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.solve(catalogue(spark, sf_dir), 120.0, 20000.0, 65.0)


@query()
def newton_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solved(spark, sf_dir).select("id", F.round("target_if", 4).alias("target_if"), "converged", "led_count", F.round("power", 6).alias("power"))


@query("""WITH c AS (SELECT p_partkey AS id, 330.0::DOUBLE * (1.01 - 0.0004 * 65) AS e, (100 + p_size)::DOUBLE * (1 - 0.001 * 65) AS p, (300 + 10 * p_size)::DOUBLE AS top FROM part),
x AS (SELECT *, i, pow(10, -3 + i * (log10(top) + 3) / 599) AS x FROM c, range(600) t(i)),
f AS (SELECT *, e * (x / 1000) * (2.6 + 0.0012 * x) - p * (0.02 + 0.0098 * x - 0.000004 * x * x) AS f FROM x),
s AS (SELECT id, any_value(e) AS e, any_value(p) AS p, bool_or(f * before <= 0) AS sign_change, arg_min(x, {'a': abs(f), 'i': i}) AS nearest_if, max(f) AS greatest_f
  FROM (SELECT *, lag(f) OVER (PARTITION BY id ORDER BY i) AS before FROM f) GROUP BY id),
q AS (SELECT *, e * 0.0000012 + p * 0.000004 AS qa, e * 0.0026 - p * 0.0098 AS qb, -p * 0.02 AS qc FROM s)
SELECT id, sign_change, round(nearest_if, 4) AS nearest_if, round(greatest_f, 4) AS greatest_f, CASE WHEN sign_change THEN round((-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa), 5) END AS root FROM q""")
def current_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps of the catalogue; SQL finds the roots by the formula for quadratic equations, which these curves make of the objective."""
    out = P.sweep(catalogue(spark, sf_dir), 330.0, 65.0)
    return out.select("id", "sign_change", F.round("nearest_if", 4).alias("nearest_if"), F.round("greatest_f", 4).alias("greatest_f"), F.round("root", 5).alias("root"))


@query("""WITH c AS (SELECT p_partkey AS id, p_size AS n, 3.1::DOUBLE AS vf, floor(50 / 3.1)::INT AS smax FROM part), w AS (SELECT *, unnest(range(ceil(n / smax)::INT, (ceil(n / smax) + 5)::INT))::INT AS p FROM c WHERE n > 0)
SELECT id, p AS "P", ceil(n / p)::INT AS "S", (p * ceil(n / p) - n)::INT AS led_add, round(ceil(n / p) * vf, 6) AS v_chain, (p * ceil(n / p))::INT AS total_leds FROM w WHERE p <= n OR p = ceil(n / smax)""")
def topologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = P.topologies(F.col("p_size"), F.lit(3.1), F.lit(50.0))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(ways).alias("w")).select("id", "w.*")
    return rows.select("id", "P", "S", "led_add", F.round("V_chain", 6).alias("v_chain"), "total_leds")


@query()
def led_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = P.rank(_solved(spark, sf_dir), 50.0, 0.05, 7.2)
    return ranked.select("id", "led_count", F.round("cost.total_cost_rmb", 4).alias("cost_rmb"), F.round("cost.total_cost_usd", 4).alias("cost_usd"))


@query()
def presented_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = P.presented(P.rank(_solved(spark, sf_dir), 50.0, 0.05, 7.2), 0.85, 120.0, 0.05, 7.2)
    return shown.select("id", "way", "P", "S", "total_leds", F.round("power_watts", 4).alias("power_watts"), F.round("total_cost_usd", 4).alias("total_cost_usd"))


@query("""SELECT l_returnflag AS curve, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1""")
def polyfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A straight line for each curve, which SQL can fit as well."""
    points = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("curve"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    out = C.fit(points, "curve", least=1, most=1)
    return out.select("curve", F.round(F.col("coefficients")[1], 4).alias("slope"), F.round(F.col("coefficients")[0], 2).alias("intercept"))


@query("""WITH p AS (SELECT l_returnflag AS curve, l_quantity AS x, l_extendedprice AS y, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem),
s AS (SELECT curve, any_value(m) AS m, count(*) AS n, sum((x - m) ** 2) AS s2, sum((x - m) ** 3) AS s3, sum((x - m) ** 4) AS s4, sum(y) AS t0, sum((x - m) * y) AS t1, sum((x - m) ** 2 * y) AS t2 FROM p GROUP BY curve),
a AS (SELECT *, (t2 - s2 * t0 / n - s3 * t1 / s2) / (s4 - s2 * s2 / n - s3 * s3 / s2) AS c2 FROM s), b AS (SELECT *, (t1 - s3 * c2) / s2 AS c1, (t0 - s2 * c2) / n AS c0 FROM a)
SELECT curve, round(c0 + c1 * (10 - m) + c2 * (10 - m) ** 2, 3) AS at_10, round(c0 + c1 * (45 - m) + c2 * (45 - m) ** 2, 3) AS at_45 FROM b""")
def polyfit_parabola(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("curve"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    out = C.fit(points, "curve", least=2, most=2)
    at = lambda x: F.round(N.polynomial(F.lit(x), F.col("coefficients")), 3)
    return out.select("curve", at(10.0).alias("at_10"), at(45.0).alias("at_45"))


@query("""WITH p AS (SELECT p_type AS k, p_partkey::DOUBLE AS x, p_retailprice AS y FROM part), e AS (SELECT k, min(x) AS a, max(x) AS b FROM p GROUP BY k),
g AS (SELECT k, i::INTEGER AS i, a + (b - a) * i / 199 AS gx FROM e, range(200) t(i)),
l AS (SELECT g.k, i, gx, max(x) AS lx FROM g JOIN p ON p.k = g.k AND x <= gx GROUP BY ALL), r AS (SELECT g.k, i, min(x) AS rx FROM g JOIN p ON p.k = g.k AND x > gx GROUP BY ALL)
SELECT l.k AS curve, l.i, round(gx, 6) AS x, round(CASE WHEN rx IS NULL THEN pl.y ELSE pl.y + (gx - lx) / (rx - lx) * (pr.y - pl.y) END, 6) AS y
FROM l LEFT JOIN r USING (k, i) JOIN p pl ON pl.k = l.k AND pl.x = lx LEFT JOIN p pr ON pr.k = l.k AND pr.x = rx""")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "part").select(F.col("p_type").alias("curve"), F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return C.resample(points, "curve").select("curve", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def polyfit_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "part").select(F.col("p_brand").alias("curve"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    return C.fit(points, "curve").select("curve", "degree", F.round("rmse", 4).alias("rmse"), "status")


@query("""WITH r AS (SELECT l_returnflag AS curve, l_quantity AS x, l_extendedprice AS y, l_extendedprice - 1000 * l_quantity AS r FROM lineitem)
SELECT curve, round(sqrt(avg(r * r)), 4) AS rmse, round(1 - sum(r * r) / (sum(y * y) - count(*) * avg(y) * avg(y)), 6) AS r2 FROM r GROUP BY curve""")
def fit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("curve"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return B.fit_metrics(points, "curve", "x", "y", 1000 * F.col("x")).select("curve", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as invented boards with all inputs of a quote."""
    n, pick = F.col("p_partkey"), lambda c, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (c % len(v) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        n.alias("id"), pick(n, 1, 2, 4, 6, 7).alias("layers"), (n % 5).cast("int").alias("panel_boards"), (n % 3).cast("int").alias("stack_qty"),
        pick(n, "FR4", "AL").alias("material"), pick(n, "1.0", "1.6").alias("substrate"), pick(n, "1oz", "2oz").alias("copper"),
        pick(n, "HASL", "ENIG", "OSP").alias("finish"), pick(n, "green", "black").alias("masking"), pick(n, "none", "gold").alias("plating"),
        F.lit(3.0).alias("pp_cost"), F.lit(5.5).alias("inner_cost"), F.lit(2.0).alias("stacking_cost"), F.lit(1.5).alias("etching_cost"),
        F.lit(0.75).alias("silkscreen_cost"), (n % 200).cast("int").alias("cnc_holes"), F.lit(0.01).alias("cnc_rate"), (n % 40).cast("double").alias("routing_length"),
        F.lit(0.02).alias("routing_rate"), F.lit(0.5).alias("stamping_cost"), F.lit(0.25).alias("post_cost"), F.lit(0.3).alias("water"),
        F.lit(0.4).alias("electricity"), F.lit(4.0).alias("labor"), F.lit(5.0).alias("loss_pct"), F.lit(20.0).alias("margin_pct"),
    )


@query("""WITH q AS (SELECT p_partkey AS id, [1, 2, 4, 6, 7][p_partkey % 5 + 1] AS layers, greatest(1, p_partkey % 5) AS boards, greatest(1, p_partkey % 3) AS stack,
  CASE WHEN p_partkey % 2 = 0 THEN 12.0 ELSE 15.0 END AS laminate, [2.0, 6.0, 0.0][p_partkey % 3 + 1] AS finish, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS masking,
  CASE WHEN p_partkey % 2 = 1 THEN 8.0 ELSE 0.0 END AS plating, p_partkey % 200 AS holes, p_partkey % 40 AS routing FROM part),
b AS (SELECT id, boards, laminate * CASE WHEN layers >= 3 THEN ceil(layers / 2.0 - 1) ELSE 1 END
  + CASE WHEN layers >= 3 THEN 3.0 * ceil(layers / 2.0) + 5.5 * (layers - 2) + 2.0 ELSE 0 END
  + finish + 1.5 + masking + 0.75 + 0.01 * holes * boards / stack + plating + routing * boards * 0.02 + 0.5 + 0.25 + 0.3 + 0.4 + 4.0 AS base FROM q)
SELECT id, round(base * 1.05, 6)::DOUBLE AS cogs, round(base * 1.05 / boards * 1.2, 6)::DOUBLE AS price_unit FROM b""")
def quote_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    priced = Q.with_prices(
        quotes(spark, sf_dir), make([("FR4", "1.0", "1oz", 12.0)], "material string, substrate string, copper string, price double"),
        make([("HASL", 2.0), ("ENIG", 6.0)], "finish string, price double"), make([("green", 1.0)], "masking string, price double"), make([("gold", 8.0)], "plating string, price double"),
    )
    return Q.price(priced).select("id", F.round("cogs", 6).alias("cogs"), F.round("price_unit", 6).alias("price_unit"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 3 = 0 THEN 'panel_boards at least 1|stack_qty at least 1' WHEN p_partkey % 5 = 0 THEN 'panel_boards at least 1'
  WHEN p_partkey % 3 = 0 THEN 'stack_qty at least 1' ELSE '' END AS problems FROM part""")
def quote_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes(spark, sf_dir).select("id", F.array_join(Q.problems(), "|").alias("problems"))


@query("SELECT l_orderkey, round(sum(round(l_quantity * l_tax, 6)), 6) AS subtotal, count(*) AS n_lines FROM lineitem GROUP BY 1")
def line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("qty"), F.col("l_tax").alias("unit_price"))
    return Q.line_totals(rows, "l_orderkey")


#: An invented board and the panels that it is laid out on.
BOARD = {
    "single_w": 62.0, "single_l": 48.0, "board_w": 260.0, "board_l": 220.0, "edge_w": 5.0, "edge_l": 4.0, "margin_w": 8.0, "margin_l": 10.0,
    "gap_board_w": 2.0, "gap_board_l": 2.0, "gap_single_w": 1.6, "gap_single_l": 1.6, "rotate_board": True, "rotate_single": True,
}


@query("""WITH b AS (SELECT p_brand AS board, (60 + min(p_partkey) % 37)::DOUBLE AS w0, (80 + max(p_partkey) % 41)::DOUBLE AS l0 FROM part GROUP BY p_brand),
styles(style, pw, pl, mult) AS (VALUES ('A1', 520.0::DOUBLE, 410.0::DOUBLE, 4), ('B2', 610.0::DOUBLE, 520.0::DOUBLE, 2)),
turned AS (SELECT *, CASE WHEN br THEN 220.0 ELSE 260.0 END::DOUBLE AS cw, CASE WHEN br THEN 260.0 ELSE 220.0 END::DOUBLE AS cl, CASE WHEN br THEN 4.0 ELSE 5.0 END::DOUBLE AS mw, CASE WHEN br THEN 5.0 ELSE 4.0 END::DOUBLE AS ml,
  CASE WHEN sr THEN l0 ELSE w0 END AS sw, CASE WHEN sr THEN w0 ELSE l0 END AS sl FROM b, styles, (VALUES (false), (true)) x(br), (VALUES (false), (true)) y(sr)),
counts AS (SELECT *, unnest(range(1, floor((cw - 2 * mw + 1.6::DOUBLE) / (sw + 1.6::DOUBLE))::INT + 1))::INT AS nw FROM turned), counts2 AS (SELECT *, unnest(range(1, floor((cl - 2 * ml + 1.6::DOUBLE) / (sl + 1.6::DOUBLE))::INT + 1))::INT AS nl FROM counts),
sized AS (SELECT *, nw * sw + (nw - 1) * 1.6::DOUBLE + 2 * mw AS bw, nl * sl + (nl - 1) * 1.6::DOUBLE + 2 * ml AS bl FROM counts2),
bounded AS (SELECT *, greatest(0, floor((pw - 16 + 2) / (bw + 2)))::INT AS ubw, greatest(0, floor((pl - 20 + 2) / (bl + 2)))::INT AS ubl FROM sized),
placed AS (SELECT *, unnest(range(1, ubw + 1))::INT AS nbw FROM bounded WHERE ubw > 0 AND ubl > 0), placed2 AS (SELECT *, unnest(range(1, ubl + 1))::INT AS nbl FROM placed),
used AS (SELECT *, nbw * bw + (nbw - 1) * 2.0::DOUBLE + 16 AS uw, nbl * bl + (nbl - 1) * 2.0::DOUBLE + 20 AS ul, nbw * nbl * nw * nl AS singles, ubw * ubl * nw * nl * mult AS bound FROM placed2),
made AS (SELECT *, singles * mult AS per_jumbo, singles * w0 * l0 / (pw * pl) AS utilization, pw * pl - uw * ul AS unused, abs(8 - (pw - uw)) + abs(10 - (pl - ul)) AS uneven, {'a': br, 'b': sr, 'c': nw, 'd': nl} AS g FROM used WHERE uw <= pw + 1e-9 AND ul <= pl + 1e-9),
best AS (SELECT board, style, g, coalesce(max(max(per_jumbo)) OVER (PARTITION BY board, style ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM made GROUP BY board, style, g),
kept AS (SELECT made.*, row_number() OVER (PARTITION BY board ORDER BY per_jumbo DESC, utilization DESC, singles DESC, unused, uneven, br::INT + sr::INT, style, nbw, nbl, nw, nl, br, sr) AS pos FROM made JOIN best USING (board, style, g) WHERE bound >= before),
one AS (SELECT *, min(pos) OVER k AS first FROM kept WINDOW k AS (PARTITION BY board, style, singles, nbw, nbl, nw, nl) QUALIFY row_number() OVER (PARTITION BY board, style, singles, nbw, nbl, nw, nl ORDER BY br::INT + 2 * sr::INT, pos) = 1)
SELECT board, row_number() OVER (PARTITION BY board ORDER BY first) AS place, style, nbw, nbl, nw, nl, br AS board_rot, sr AS single_rot, per_jumbo, round(utilization, 6) AS utilization FROM one""")
def panel_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board a brand, sized by its parts, laid out on the panels of the enabled styles."""
    n = F.col("p_partkey")
    boards = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("board")).agg((60 + F.min(n) % 37).cast("double").alias("single_w"), (80 + F.max(n) % 41).cast("double").alias("single_l"))
    style = lambda *v: F.struct(*[F.lit(x).alias(c) for c, x in zip(("style", "panel_w", "panel_l", "multiplier"), v, strict=True)])
    styles = F.array(style("A1", 520.0, 410.0, 4), style("B2", 610.0, 520.0, 2), style("A5", 700.0, 600.0, 1), style("C1", 520.0, 410.0, 4))
    asked = L.gate(boards.select("*", F.inline(styles)), "AB", F.col("single_w"), F.col("single_l"))
    made = L.enumerate_layouts(asked, BOARD, "board")
    ranked = L.rank_layouts(made, "board")
    return ranked.select("board", "place", "style", "nbw", "nbl", "nw", "nl", "board_rot", "single_rot", "per_jumbo", F.round("utilization", 6).alias("utilization"))


_SNAP = """WITH o AS (SELECT event_id, user_id, event_id % 4 AS kind, 60000.0 + 500 * (user_id % 5) AS mid FROM events)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as invented snapshots of an account's orders: none, one of either side, or a pair."""
    mid = F.lit(60000.0) + 500 * (F.col("user_id") % 5)
    order = lambda side, p: F.struct(F.lit(side).alias("side"), p.alias("price"))
    buy, sell = order("BUY", mid - 500), order("SELL", mid + 500)
    kind = F.col("event_id") % 4
    none = F.array().cast("array<struct<side:string,price:double>>")
    orders = F.when(kind == 0, none).when(kind == 1, F.array(buy)).when(kind == 2, F.array(sell)).otherwise(F.array(sell, buy))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("account"), F.col("event_id").alias("seq"), orders.alias("orders"))


@query(_SNAP + """SELECT event_id AS seq, CASE kind WHEN 0 THEN 'ABNORMAL' WHEN 1 THEN 'BUY_ONLY' WHEN 2 THEN 'SELL_ONLY' ELSE 'PAIR' END AS mode,
  CASE WHEN kind IN (1, 3) THEN mid - 500 END AS buy_price, CASE WHEN kind IN (2, 3) THEN mid + 500 END AS sell_price FROM o""")
def grid_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).select("seq", G.classify(F.col("orders")).alias("c")).select("seq", "c.*")


@query(_SNAP + """, c AS (SELECT user_id::VARCHAR AS account, event_id AS seq, mid, kind, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM o)
SELECT account, seq, CASE WHEN was = 3 AND kind IN (1, 2) THEN 'rebuild' WHEN was IN (1, 2) AND kind = 0 THEN 'rebuild' WHEN was = 3 AND kind = 3 THEN 'keep' WHEN was IN (1, 2) AND kind = was THEN 'keep' ELSE 'abnormal' END AS action
FROM c WHERE was IS NOT NULL""")
def grid_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each snapshot against the one before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("account").orderBy("seq")
    s = snapshots(spark, sf_dir).withColumn("live", G.classify(F.col("orders"))).withColumn("saved", F.lag("live").over(w))
    return s.where("saved is not null").select("account", "seq", G.decide(F.col("saved"), F.col("live"), F.size("orders"))["action"].alias("action"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice / 500 + 0.5) * 500 AS snapped, round_even(l_extendedprice, 0) AS whole, greatest(0, least(100, l_quantity * 3)) AS clamped FROM lineitem""")
def price_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.snap(price, 500.0).alias("snapped"), N.whole_price(price).alias("whole"),
        N.clamp(F.col("l_quantity") * 3, 0, 100).alias("clamped"),
    )


@query("""WITH k AS (SELECT p_partkey AS id, 2000.0 + 200 * p_size AS t FROM part), x AS (SELECT id, t, CASE WHEN t <= 4000 THEN -0.2661239e9 / (t * t * t) - 0.2343580e6 / (t * t) + 0.8776956e3 / t + 0.179910
  ELSE -3.0258469e9 / (t * t * t) + 2.1070379e6 / (t * t) + 0.2226347e3 / t + 0.240390 END AS x FROM k)
SELECT id, round(x, 8) AS x, round(CASE WHEN t <= 2222 THEN -1.1063814 * x * x * x - 1.34811020 * x * x + 2.18555832 * x - 0.20219683
  WHEN t <= 4000 THEN -0.9549476 * x * x * x - 1.37418593 * x * x + 2.09137015 * x - 0.16748867 ELSE 3.0817580 * x * x * x - 5.87338670 * x * x + 3.75112997 * x - 0.37001483 END, 8) AS y FROM x""")
def planckian(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = N.planckian(2000.0 + 200 * F.col("p_size"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(at["x"], 8).alias("x"), F.round(at["y"], 8).alias("y"))
