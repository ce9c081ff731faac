"""Mailboxes on a server as a data source: ranges of message numbers as partitions, days pushed into the search, and a stream of new mail.

The connection is passed in: ``connect`` is called where it is needed, on the driver for the bounds of folders and in each task for its own range, and
returns an object with

- ``folders()``: the names of all folders,
- ``bounds(folder)``: the lowest and highest number in it, or null if it is empty,
- ``search(folder, since, before, low, high)``: the numbers from low to high of mails on or after the one day and before the other, where given,
- ``fetch(folder, uids)``: ``(uid, flags, received, raw)`` of each mail,
- ``close()``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

MAILS = "folder string, uid long, flags array<string>, received timestamp, day date, raw binary"
#: Folders that are never read, attempts at a request, and the base of the seconds between them (fixed values).
IGNORED, ATTEMPTS, BACKOFF = ("Trash", "Junk"), 4, 2.0


@dataclass
class Stretch(InputPartition):
    """Numbers of one folder, both ends included."""

    folder: str
    low: int
    high: int


def _insist(connect: Callable, request: Callable, attempts: int, backoff: float):
    """The answer to ``request(client)``; after an error of the connection a new one is made, after growing delays."""
    for attempt in range(1, attempts + 1):
        client = None
        try:
            client = connect()
            return request(client)
        except (OSError, EOFError) as e:
            if attempt == attempts:
                raise RuntimeError(f"{attempts} attempts failed: {e}") from e
            time.sleep(backoff**attempt if backoff else 0)
        finally:
            if client is not None:
                client.close()
    return None


class _Mailbox:
    """What reading once and reading on have in common."""

    def __init__(self, connect: Callable, options: dict) -> None:
        self.connect = connect
        self.attempts, self.backoff = int(options.get("attempts", ATTEMPTS)), float(options.get("backoff", BACKOFF))
        self.size, self.batch = int(options.get("partition", 10_000)), int(options.get("batch", 50))
        #: The folders that are asked for; null for all.
        self.only = set(options["folders"].split("\n")) if "folders" in options else None
        self.ignored = set(options["ignored"].split("\n")) if "ignored" in options else set(IGNORED)
        self.since: date | None = None
        self.before: date | None = None

    def bounds(self) -> dict[str, tuple[int, int]]:
        def ask(client) -> dict[str, tuple[int, int]]:
            names = set(client.folders()) if self.only is None else self.only
            return {f: b for f in sorted(names - self.ignored) if (b := client.bounds(f)) is not None}

        return _insist(self.connect, ask, self.attempts, self.backoff)

    def cut(self, folder: str, low: int, high: int) -> list[Stretch]:
        return [Stretch(folder, at, min(at + self.size - 1, high)) for at in range(low, high + 1, self.size)]

    def mails(self, part: Stretch | None) -> Iterator[tuple]:
        if part is None:  # what Spark reads where there is no partition
            return
        ask = lambda request: _insist(self.connect, request, self.attempts, self.backoff)
        uids = sorted(set(ask(lambda client: client.search(part.folder, self.since, self.before, part.low, part.high))))
        for at in range(0, len(uids), self.batch):
            some = uids[at : at + self.batch]
            for uid, flags, received, raw in ask(lambda client, some=some: list(client.fetch(part.folder, some))):
                yield part.folder, int(uid), list(flags), received, received.date(), bytes(raw)


class Reader(_Mailbox, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - named by Spark
        """Days narrow the search and names the folders; all filters are applied again to what comes back."""
        for f in filters:
            named, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if named == ("folder",) and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.only = wanted if self.only is None else self.only & wanted
            elif named == ("day",) and isinstance(value, date):
                if isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)):
                    day = value + timedelta(days=isinstance(f, GreaterThan))
                    self.since = max(day, self.since or day)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    day = value + timedelta(days=not isinstance(f, LessThan))
                    self.before = min(day, self.before or day)
            yield f

    def partitions(self) -> list[Stretch]:
        return [p for folder, (low, high) in self.bounds().items() for p in self.cut(folder, low, high)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return self.mails(partition)


class StreamReader(_Mailbox, DataSourceStreamReader):
    """Offsets are the next number of each folder; a folder that appears later is read from its start."""

    def initialOffset(self) -> dict:  # noqa: N802 - named by Spark
        return {}

    def latestOffset(self) -> dict:  # noqa: N802 - named by Spark
        return {folder: high + 1 for folder, (_, high) in self.bounds().items()}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        low = self.bounds()
        return [p for folder, stop in sorted(end.items()) for p in self.cut(folder, max(start.get(folder, 0), low.get(folder, (0, 0))[0]), stop - 1)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return self.mails(partition)

    def commit(self, end: dict) -> None:
        pass


def _register(spark: SparkSession, connect: Callable) -> str:
    class Mailbox(DataSource):
        @classmethod
        def name(cls) -> str:
            return "mailbox_range"

        def schema(self) -> str:
            return MAILS

        def reader(self, schema) -> DataSourceReader:
            return Reader(connect, self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 - named by Spark
            return StreamReader(connect, self.options)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Mailbox)
    return Mailbox.name()


def read_mails(spark: SparkSession, connect: Callable, since: date | None = None, until: date | None = None, **options: str) -> DataFrame:
    """``MAILS``: the mails of all folders but ``IGNORED``, from one day to another, both included.

    Options: ``folders`` and ``ignored`` (a name a line), ``partition`` (numbers a task), ``batch`` (mails a request), ``attempts`` and ``backoff``. A
    ``where`` on ``day`` or ``folder`` reaches the server; the days given here do so in the same way.
    """
    mails = spark.read.format(_register(spark, connect)).options(**options).load()
    if since is not None:
        mails = mails.where(F.col("day") >= F.lit(since))
    return mails if until is None else mails.where(F.col("day") < F.lit(until + timedelta(days=1)))


def stream_mails(spark: SparkSession, connect: Callable, **options: str) -> DataFrame:
    """``MAILS`` as a stream: what is there, then what arrives; the checkpoint holds the next number of each folder."""
    return spark.readStream.format(_register(spark, connect)).options(**options).load()
