"""Stateful streams that act on time: rounds that expire, orders read every so many ticks, files that must settle, and calls tried again later.

Streams in processing time run a batch at each trigger, whether rows come or not, so they take an interval as trigger and never end by themselves.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming import grid

#: Statuses after which a call is tried again, how often, and the seconds before the first time (fixed values).
TRANSIENT, RETRIES, DELAY = frozenset({429, 502, 503, 504}), 5, 5.0


def _now(timers) -> int:
    return timers.getCurrentProcessingTimeInMs()


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable")


class Rollover(StatefulProcessor):
    """Keeps the rounds of a series that have not ended. The round that ends first is current; a timer at its end hands over to the next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rounds = handle.getMapState("rounds", "round_id string", "end_ms long")
        self.current = handle.getValueState("current", "round_id string")

    def _roll(self, key, now: int) -> pd.DataFrame | None:
        """The row of a change of round, if there is one, with the timer of the new one set."""
        known = {k[0]: v[0] for k, v in self.rounds.iterator()}
        for name in [n for n, end in known.items() if end <= now]:
            self.rounds.removeKey((name,))
            del known[name]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        best = min(known, key=lambda n: (known[n], n), default=None)
        before = self.current.get()[0] if self.current.exists() else None
        if best is None:
            self.current.clear()
        else:
            self.current.update((best,))
            self.handle.registerTimer(known[best])
        if best == before:
            return None
        return pd.DataFrame({"series": [key[0]], "round_id": [best], "before": [before], "end_ms": pd.array([known.get(best)], dtype="Int64")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - named by Spark
        for r in pd.concat(list(rows)).itertuples():
            self.rounds.updateValue((r.round_id,), (int(r.end_ms),))
        if (out := self._roll(key, _now(timerValues))) is not None:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802 - named by Spark
        if (out := self._roll(key, _now(timerValues))) is not None:
            yield out

    def close(self) -> None:
        pass


def rounds(offers: DataFrame) -> DataFrame:
    """``series, round_id, before, end_ms``: a row each time another round becomes the current one of its series.

    ``offers(series, round_id, end_ts)`` is a stream of rounds with their ends; a round offered again takes the new end. When the
    current round ends, though no row arrives, the next one takes over, or none (a null) until one is offered. Rounds that have ended
    are forgotten.
    """
    rows = offers.where("series is not null and round_id is not null and end_ts is not null").select("series", "round_id", F.unix_millis(F.col("end_ts").cast("timestamp")).alias("end_ms"))
    return rows.groupBy("series").transformWithStateInPandas(
        statefulProcessor=Rollover(), outputStructType="series string, round_id string, before string, end_ms long", outputMode="Append", timeMode="ProcessingTime"
    )


class Ticker(StatefulProcessor):
    """Counts the ticks of an account beside the last state of its orders, which is forgotten when it is not renewed in time."""

    def __init__(self, zone: float, every: int, keep_ms: int) -> None:
        self.zone, self.every, self.keep_ms = zone, every, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ticks = handle.getValueState("ticks", "n long")
        self.state = handle.getValueState("state", "mode string, buy_price double, sell_price double", ttlDurationMs=self.keep_ms)

    def _near(self, mid: float, state: tuple | None) -> bool:
        low = lambda: mid <= state[1] + self.zone
        high = lambda: mid >= state[2] - self.zone
        if state is None or state[0] not in (grid.PAIR, grid.BUY_ONLY, grid.SELL_ONLY):
            return True
        return (state[0] != grid.SELL_ONLY and low()) or (state[0] != grid.BUY_ONLY and high())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - named by Spark
        n = self.ticks.get()[0] if self.ticks.exists() else 0
        state = tuple(self.state.get()) if self.state.exists() else None
        out, renewed = [], False
        for r in _in_order(rows, "seq").itertuples():
            why = "no price" if pd.isna(r.mid) else "due" if n % self.every == 0 else "near" if self._near(r.mid, state) else None
            out.append((key[0], r.seq, n, why))
            if why and r.mode is not None:
                state, renewed = (r.mode, *(None if pd.isna(x) else x for x in (r.buy_price, r.sell_price))), True
            n += 1
        self.ticks.update((n,))
        if renewed:
            self.state.update(state)
        yield pd.DataFrame(out, columns=["account", "seq", "tick", "refresh"])

    def close(self) -> None:
        pass


def refreshes(ticks: DataFrame, zone: float, every: int = grid.REFRESH, keep: float = 86_400.0) -> DataFrame:
    """``account, seq, tick, refresh`` for each price that comes in: how many came before it, and why orders must be read, if they must.

    ``ticks(account, seq, mid, orders)`` has the middle price and the orders that a reading would find. They are read when there is no price
    (``no price``), at each ``every``-th tick from the first (``due``), or when the price is within the zone of an order last read or none is known
    (``near``); only then do they become the state, which is kept ``keep`` seconds. The count survives a restart from the checkpoint.
    """
    rows = ticks.withColumn("c", grid.classify(F.col("orders"))).select("account", "seq", F.col("mid").cast("double").alias("mid"), "c.*")
    return rows.groupBy("account").transformWithStateInPandas(
        statefulProcessor=Ticker(zone, every, int(keep * 1000)), outputStructType="account string, seq long, tick long, refresh string", outputMode="Append", timeMode="ProcessingTime"
    )


class Settled(StatefulProcessor):
    """Remembers the last length and time at which a file was seen, until it was seen twice alike."""

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "length long, at_ms long, passed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - named by Spark
        seen = tuple(self.seen.get()) if self.seen.exists() else None
        for r in _in_order(rows, "at_ms").itertuples():
            length, at = int(r.length), int(r.at_ms)
            if seen is None or seen[0] != length:
                seen = (length, at, False)
            elif not seen[2] and at - seen[1] >= self.wait_ms:
                seen = (length, at, True)
                yield pd.DataFrame({"path": [key[0]], "length": [length]})
        self.seen.update(seen)

    def close(self) -> None:
        pass


def settled(sightings: DataFrame, wait: float = 1.0) -> DataFrame:
    """``path, length`` of the files whose length did not change for ``wait`` seconds, once for each length.

    ``sightings(path, length, seen_at)`` is a stream of listings, such as ``sight`` writes; a file that is still being written shows another
    length each time and is held back.
    """
    rows = sightings.where("path is not null and length is not null").select("path", "length", F.unix_millis(F.col("seen_at").cast("timestamp")).alias("at_ms"))
    return rows.groupBy("path").transformWithStateInPandas(
        statefulProcessor=Settled(int(wait * 1000)), outputStructType="path string, length long", outputMode="Append", timeMode="None"
    )


def sight(spark, folder: str, out: str, pattern: str = "*") -> None:
    """Adds a listing of a folder to the sightings in ``out``; only the files' names and lengths are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    files.select("path", "length", F.current_timestamp().alias("seen_at")).coalesce(1).write.mode("append").parquet(out)


class Retry(StatefulProcessor):
    """Calls once a task arrives, and again after a delay while the answer is transient; a timer stands for the delay."""

    def __init__(self, call: Callable[[str], tuple[int, str]], retries: int, delay: float, growth: float) -> None:
        self.call, self.retries, self.delay, self.growth = call, retries, delay, growth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "payload string, attempt int")

    def _attempt(self, key, payload: str, attempt: int, now: int) -> pd.DataFrame:
        status, said = self.call(payload)
        state = "done" if status < 400 else "retry" if status in TRANSIENT and attempt < self.retries else "failed"
        if state == "retry":
            self.waiting.update((payload, attempt + 1))
            # a batch's time is that of its start; the delay counts from the answer
            self.handle.registerTimer(max(now, int(time.time() * 1000)) + max(1, int(1000 * self.delay * self.growth**attempt)))
        else:
            self.waiting.clear()
        return pd.DataFrame([(key[0], attempt, status, state, said)], columns=["task_id", "attempt", "status", "state", "said"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - named by Spark
        payload = _in_order(rows, "payload")["payload"].iloc[-1]
        for t in list(self.handle.listTimers()):  # a new payload takes the place of one that waits
            self.handle.deleteTimer(t)
        yield self._attempt(key, payload, 0, _now(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802 - named by Spark
        if self.waiting.exists():
            payload, attempt = self.waiting.get()
            yield self._attempt(key, payload, attempt, _now(timerValues))

    def close(self) -> None:
        pass


def retried(tasks: DataFrame, call: Callable[[str], tuple[int, str]], retries: int = RETRIES, delay: float = DELAY, growth: float = 1.0) -> DataFrame:
    """``task_id, attempt, status, state, said``: a row for each time a task of ``tasks(task_id, payload)`` is called.

    ``call`` takes the payload and returns a status and a text. A status of ``TRANSIENT`` brings the task back after ``delay`` seconds, ``growth`` times as many
    after each further attempt, up to ``retries`` times; then, and at once for other statuses of 400 and above, its state is ``failed``.
    Waiting takes no task: the delay is a timer in the state, which survives a restart. A call may be repeated when a batch is.
    """
    rows = tasks.where("task_id is not null and payload is not null").select("task_id", "payload")
    return rows.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=Retry(call, retries, delay, growth), outputStructType="task_id string, attempt int, status int, state string, said string", outputMode="Append", timeMode="ProcessingTime"
    )
