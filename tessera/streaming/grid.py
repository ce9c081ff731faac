"""The price grid's decisions: a snapshot of orders against the last state, keyed by account."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.numbers import gap_matches, snap, whole_price

PAIR, BUY_ONLY, SELL_ONLY, ABNORMAL = "PAIR", "BUY_ONLY", "SELL_ONLY", "ABNORMAL"
#: The step of the grid, the gap of a pair in price, and the ticks after which orders are read anyway (fixed values).
STEP, GAP, REFRESH = 500.0, 1000.0, 60


def classify(orders: Column, gap: float = GAP) -> Column:
    """``mode, buy_price, sell_price`` of a snapshot ``array<struct<side, price>>``."""
    price = lambda side: F.get(F.filter(orders, lambda o: o["side"] == side), F.lit(0))["price"]
    buy, sell = price("BUY"), price("SELL")
    pair = (F.size(orders) == 2) & (buy < sell) & gap_matches(buy, sell, gap)
    one = F.size(orders) == 1
    mode = (
        F.when(F.coalesce(pair, F.lit(False)), PAIR)
        .when(one & buy.isNotNull(), BUY_ONLY)
        .when(one & sell.isNotNull(), SELL_ONLY)
        .otherwise(ABNORMAL)
    )
    return F.struct(mode.alias("mode"), F.when(mode.isin(PAIR, BUY_ONLY), buy).alias("buy_price"), F.when(mode.isin(PAIR, SELL_ONLY), sell).alias("sell_price"))


def decide(saved: Column, live: Column, n_orders: Column) -> Column:
    """``action, rebuild_price``: keep, rebuild from the filled side's price, or abnormal.

    Out of a pair, the missing side was filled. A single side may move but must not turn; once it is gone
    too, it was filled.
    """
    was, now = saved["mode"], live["mode"]
    same = (live["buy_price"] == saved["buy_price"]) & (live["sell_price"] == saved["sell_price"])
    rebuild = (
        F.when((was == PAIR) & (now == SELL_ONLY), saved["buy_price"])
        .when((was == PAIR) & (now == BUY_ONLY), saved["sell_price"])
        .when((was == BUY_ONLY) & (n_orders == 0), saved["buy_price"])
        .when((was == SELL_ONLY) & (n_orders == 0), saved["sell_price"])
    )
    keep = ((was == PAIR) & (now == PAIR) & same) | (was.isin(BUY_ONLY, SELL_ONLY) & (now == was))
    action = F.when(rebuild.isNotNull(), "rebuild").when(keep, "keep").otherwise("abnormal")
    return F.struct(action.alias("action"), rebuild.alias("rebuild_price"))


def normalized_order(side: Column, price: Column) -> Column:
    """An exchange's order with spelled sides and a whole price; an unknown side gives null."""
    return F.struct(F.when(side == "B", "BUY").when(side == "A", "SELL").alias("side"), whole_price(price.try_cast("double")).alias("price"))


def in_zone(price: Column, state: Column, zone: float) -> Column:
    """Whether a price is near an order of the state; an unknown state always is."""
    low, high = price <= state["buy_price"] + zone, price >= state["sell_price"] - zone
    mode = state["mode"]
    return F.when(mode == PAIR, low | high).when(mode == BUY_ONLY, low).when(mode == SELL_ONLY, high).otherwise(True)


def must_refresh(price: Column, tick: Column, state: Column, zone: float) -> Column:
    return price.isNull() | (tick % REFRESH == 0) | in_zone(price, state, zone)


def new_pair(price: Column, budget: float, buy_steps: float = 1, sell_steps: float = 1, step: float = STEP) -> Column:
    """A buy and a sell order around a price, sized by the budget; null if a price would not be positive."""
    buy, sell = price - buy_steps * step, price + sell_steps * step
    order = lambda side, p: F.struct(F.lit(side).alias("side"), p.alias("price"), F.round(F.lit(budget) / p, 5).alias("size"))
    return F.when((price > 0) & (buy > 0), F.array(order("BUY", buy), order("SELL", sell)))


def anchor(mid: Column, step: float = STEP) -> Column:
    return snap(mid, step)


def response(result: Column) -> Column:
    """What an exchange's JSON answer to an order says: ``ok``, ``insufficient_spot_balance`` or ``error``."""
    status = F.get_json_object(result, "$.response.data.statuses[0]")
    error = F.get_json_object(status, "$.error")
    fine = F.get_json_object(status, "$.resting").isNotNull() | F.get_json_object(status, "$.filled").isNotNull()
    return (
        F.when(F.contains(error, F.lit("Insufficient spot balance")), "insufficient_spot_balance")
        .when(error.isNotNull() | ~F.coalesce(fine, F.lit(False)), "error")
        .otherwise("ok")
    )


def reanchor(mode: Column, price: Column, mid: Column, steps: int = 2, step: float = STEP, modes: tuple[str, ...] = (BUY_ONLY,)) -> Column:
    """The new anchor of a single order that the price has left by ``steps`` grid steps or more, else null."""
    away = F.when(mode == BUY_ONLY, mid - price).when(mode == SELL_ONLY, price - mid)
    return F.when(mode.isin(*modes) & (away >= steps * step), snap(mid, step))


def poll_interval(reads: Column, base: float, every: int = 2) -> Column:
    """Seconds until the next reading, longer the more readings in a row were equal."""
    return F.lit(base) * (1 + F.floor(reads / every))


class Decider(StatefulProcessor):
    """Keeps the last state of each account and says what each snapshot asks for.

    A rebuild takes the snapshot's own pair prices around the filled price; an abnormal snapshot ends the
    account's state, and the next pair begins it anew.
    """

    def __init__(self, gap: float = GAP):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "mode string, buy_price double, sell_price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - named by Spark
        found = self.state.get() if self.state.exists() else None
        saved = tuple(found) if found else None
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            live = (r.mode, None if pd.isna(r.buy_price) else r.buy_price, None if pd.isna(r.sell_price) else r.sell_price)
            action, price = ("start", None) if saved is None else step(saved, live, r.n_orders)
            if action == "start":
                saved = live if live[0] != ABNORMAL else None
            elif action == "rebuild":
                saved = (PAIR, price - self.gap / 2, price + self.gap / 2)
            elif action == "abnormal":
                saved = None
            out.append((key[0], r.seq, action, price))
        if saved is None:
            self.state.clear()
        else:
            self.state.update(saved)
        yield pd.DataFrame(out, columns=["account", "seq", "action", "rebuild_price"]).astype({"rebuild_price": "float64"})

    def close(self) -> None:
        pass


def step(saved: tuple, live: tuple, n_orders: int) -> tuple[str, float | None]:
    """``decide`` for one snapshot in Python, for the state machine."""
    was, buy, sell = saved
    now = live[0]
    if was == PAIR:
        if now in (SELL_ONLY, BUY_ONLY):
            return "rebuild", buy if now == SELL_ONLY else sell
        return ("keep", None) if live == saved else ("abnormal", None)
    if n_orders == 0:
        return "rebuild", buy if was == BUY_ONLY else sell
    return ("keep", None) if now == was else ("abnormal", None)


def decisions(snapshots: DataFrame, gap: float = GAP) -> DataFrame:
    """``account, seq, action, rebuild_price`` of a stream or table ``account, seq, orders`` in order of seq."""
    rows = snapshots.withColumn("c", classify(F.col("orders"), gap)).select("account", "seq", "c.*", F.size("orders").alias("n_orders"))
    return rows.groupBy("account").transformWithStateInPandas(
        statefulProcessor=Decider(gap), outputStructType="account string, seq long, action string, rebuild_price double", outputMode="Append", timeMode="None"
    )
