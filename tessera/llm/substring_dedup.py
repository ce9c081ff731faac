"""Substring dedup by recompression: shared symbols reveal repeated windows, hashes of whole windows verify them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, drop, materialize, null_id, parted, require, screen, with_id
from .recompression import stretches
from .wordhash import hash_words, portions, window_hashes

#: Words of a window.
WINDOW = 20
#: Words of one document that are parsed at once; a longer document is parsed in overlapping parts.
PART = 400_000
#: A stretch is coded as start * CODE + count in the lists that go back to the documents; a window must be shorter.
CODE = 1 << 20


def _encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _parts(at: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of words that can be parsed alone and the number of the text of each word.

    Which symbol a window has depends on its own words only, so parts that overlap by a window less
    one word have the same symbols as the whole.
    """
    first = 0
    while first < len(at) - 1:
        if at[first + 1] - at[first] > PART:
            for a in range(int(at[first]), int(at[first + 1]), PART):
                b = min(a + PART + window - 1, int(at[first + 1]))
                yield a, b, np.full(b - a, first)
            first += 1
            continue
        last = first
        while last < len(at) - 1 and at[last + 1] - at[last] <= PART and at[last + 1] - at[first] <= PART:
            last += 1
        yield int(at[first]), int(at[last]), np.repeat(np.arange(first, last), np.diff(at[first : last + 1]))
        first = last


def _named(docs: DataFrame, window: int) -> DataFrame:
    """``symbol, content, doc_id, start, n``: the stretches of windows of each document by their symbol."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, all_texts = batch["doc_id"].to_numpy(), [_encoded(t) for t in batch["text"]]
            for a, b in portions(all_texts):
                words, at = hash_words(all_texts[a:b])
                for first, last, owner in _parts(at, window):
                    symbol, content, start, count = stretches(words[first:last], owner, window)
                    whose = owner[start]
                    yield pd.DataFrame(
                        {
                            "symbol": symbol.view(np.int64), "content": content.view(np.int64), "doc_id": ids[a + whose],
                            "start": (start + first - at[whose]).astype(np.int32), "n": count.astype(np.int32),
                        }
                    )

    return docs.mapInPandas(run, "symbol long, content long, doc_id long, start int, n int")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """``whole, doc_id, start``: the hashes of the windows that the coded stretches ``_codes`` of each document hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, codes, all_texts = batch["doc_id"].to_numpy(), batch["_codes"].to_list(), [_encoded(t) for t in batch["text"]]
            for a, b in portions(all_texts):
                words, at = hash_words(all_texts[a:b])
                hashes = window_hashes(words, window) if len(words) else words
                made: list[tuple[np.ndarray, ...]] = []
                for i in range(a, b):
                    some = np.unique(np.asarray(codes[i], dtype=np.int64))
                    start, count = some // CODE, some % CODE
                    where = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
                    where = where[where + window <= at[i - a + 1] - at[i - a]]
                    made.append((hashes[at[i - a] + where].view(np.int64), np.full(len(where), ids[i]), where.astype(np.int32)))
                whole, whose, where = (np.concatenate(parts) for parts in zip(*made, strict=True))
                yield pd.DataFrame({"whole": whole, "doc_id": whose, "start": where})

    return docs.select("doc_id", "text", "_codes").mapInPandas(run, "whole long, doc_id long, start int")


def repeated_stretches(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, _codes``: for each document the windows that also start earlier, as stretches start * CODE + count."""
    usable = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    named = materialize(_named(usable, window), "stretches")
    shared = materialize(named.groupBy("symbol").agg(F.count("*").alias("c")).where("c > 1").select("symbol"), "shared-symbols")
    rows = materialize(named.join(shared, "symbol"), "shared-stretches")
    drop(named, shared)
    # equal stretches hold equal windows: all but the first are repeats as a whole
    at = F.struct("doc_id", "start")
    firsts = rows.groupBy("symbol", "content").agg(F.min(F.struct("doc_id", "start", "n")).alias("first"), F.count("*").alias("c"))
    firsts = materialize(firsts, "first-stretches")
    again = firsts.where("c > 1").select("symbol", "content", F.struct("first.doc_id", "first.start").alias("first"))
    later = rows.join(again, ["symbol", "content"]).where(at > F.col("first"))
    code = (F.col("start").cast("long") * CODE + F.col("n")).alias("code")
    later = materialize(later.select("doc_id", code), "later-stretches")
    # unequal stretches of one symbol may still share windows: those of the firsts are compared one by one
    several = materialize(firsts.groupBy("symbol").agg(F.count("*").alias("c")).where("c > 1").select("symbol"), "varied-symbols")
    open_ = firsts.join(several, "symbol").select("first.doc_id", (F.col("first.start").cast("long") * CODE + F.col("first.n")).alias("code"))
    open_ = materialize(open_.groupBy("doc_id").agg(F.collect_list("code").alias("_codes")), "open-stretches")
    drop(rows, firsts, several)
    windows = materialize(_windows(screen(usable, "doc_id", open_).join(open_, "doc_id"), window), "windows")
    found = windows.groupBy("whole").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first != last")
    found = materialize(found.select("whole", "first"), "first-windows")
    single = windows.join(found, "whole").where(at > F.col("first")).select("doc_id", (F.col("start").cast("long") * CODE + 1).alias("code"))
    gone = materialize(later.unionByName(single).groupBy("doc_id").agg(F.collect_list("code").alias("_codes")), "gone-stretches")
    drop(later, open_, windows, found)
    return gone


def _kept(words: list[bytes], codes, window: int) -> list[bytes]:
    """The words that no coded stretch covers."""
    some = np.asarray(codes, dtype=np.int64)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    start = np.minimum(some // CODE, len(words))  # of rows that share an id, one may be shorter
    stop = np.minimum(start + some % CODE + window - 1, len(words))
    np.add.at(change, start, 1)
    np.add.at(change, stop, -1)
    stay = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(stay)]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Removes every word that lies in a window of ``window`` words which also starts earlier.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` for every row, and ``kept_text`` if asked for: the
    words that are left, joined by one blank. Words are the runs outside \\x20 and \\x09-\\x0D. Earlier means a
    smaller doc_id, or the same document and an earlier start; windows are those of the input.

    Recompression names runs and pairs of words and of names in rounds (``recompression``). A name is a hash
    of what it stands for, so it is the same in all tasks and no round needs an exchange. Each window is
    known by the name of a symbol that its own words decide, of the highest level of which there is one, and neighbours with the same
    symbol form a stretch. Shared symbols reveal repeats: only stretches whose symbol occurs twice go on. Equal stretches, told by a hash
    of their words, are settled as a whole, and unequal ones of one symbol by the hashes of their windows. This is exact but for
    collisions of 64-bit hashes.

    Null and empty texts have no words and nothing to remove; rows without an id take no part in the
    comparison and stay whole. Rows that share a doc_id are one document: they do not repeat each
    other, and what is removed from one place is removed from all. An empty table gives no rows; other
    columns are ignored. Texts longer than ``PART`` words are parsed in overlapping parts; the words of one text are in memory at once.
    """
    if not 0 < window < CODE:
        raise ValueError(f"a window has 1 to {CODE - 1} words")
    require(docs, ["doc_id", "text"])
    gone = repeated_stretches(docs, window)
    own = with_id(docs, "text").withColumn("__key", F.when(~F.col(NO_ID), F.col("doc_id")))
    keyed = gone.withColumnRenamed("doc_id", "__key")
    changed, whole = parted(own, "__key", keyed.select("__key"))
    changed = changed.join(keyed, "__key", "left")
    whole = whole.withColumn("_codes", F.lit(None).cast("array<bigint>"))  # these need no exchange
    columns = ["doc_id", NO_ID, "text", "_codes"]
    joined = changed.select(columns).unionByName(whole.select(columns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, codes in zip(batch["text"], batch["_codes"], strict=True):
                words = _encoded(text).split()
                kept = words if codes is None else _kept(words, codes, window)
                body = b" ".join(kept)
                row = (len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest())
                rows.append((*row, body.decode("utf-8", "surrogatepass")) if with_text else row)
            names = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"])
            out.insert(1, NO_ID, batch[NO_ID])
            yield out

    schema = f"doc_id long, {NO_ID} boolean, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return null_id(joined.mapInPandas(run, schema))
