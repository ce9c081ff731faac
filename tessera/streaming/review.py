"""Versioned reviews: the draft of a thread and its corrections, in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.text import strip, unquote_all

#: The lines around a draft in a review mail.
HEADER, FOOTER = r"(?m)^.*\bVERSION (\d+)\b.*$", r"(?m)^--- END OF DRAFT ---\s*$"


def last_state(body: Column) -> Column:
    """``version, draft`` of the block with the greatest version in a review mail's body; the first of equals; null without one."""
    text = unquote_all(body)
    versions = F.transform(F.regexp_extract_all(text, F.lit(HEADER), F.lit(1)), lambda v: v.cast("int"))
    drafts = F.slice(F.split(text, r"(?m)^.*\bVERSION \d+\b.*$"), 2, 1_000_000)
    whole = F.zip_with(
        F.transform(versions, lambda v, i: F.struct(v.alias("version"), (-i).alias("i"))), drafts,
        lambda v, d: F.struct(v["version"].alias("version"), v["i"].alias("i"), strip(F.split(d, FOOTER)[0]).alias("draft")),
    )
    best = F.array_max(whole)
    return F.when(F.size(versions) > 0, F.struct(best["version"].alias("version"), best["draft"].alias("draft")))


class Reviewer(StatefulProcessor):
    """Keeps version and draft of each thread: a new mail opens version 1, a reply adds one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("review", "version int, draft string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - named by Spark
        version, draft = self.state.get() if self.state.exists() else (0, "")
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            version, draft = version + 1, r.text
            out.append((key[0], r.seq, version, draft))
        self.state.update((version, draft))
        yield pd.DataFrame(out, columns=["thread_id", "seq", "version", "draft"])

    def close(self) -> None:
        pass


def reviews(stream: DataFrame) -> DataFrame:
    """``thread_id, seq, version, draft`` of a stream ``thread_id, seq, text``."""
    return stream.groupBy("thread_id").transformWithStateInPandas(
        statefulProcessor=Reviewer(), outputStructType="thread_id string, seq long, version int, draft string", outputMode="Append", timeMode="None"
    )
