"""Best-fit packing of token pieces by large-item matching, planned on the histogram of lengths."""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, materialize, null_id, require, with_id

_PIECES = f"doc_id long, {NO_ID} boolean, piece int, start long, length long, ids_crc32 long, part long, nth long"

#: The split of a text into the units that a byte-level vocabulary merges within (a fixed value of that format).
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves,
    the rest for the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts, as little-endian 32-bit bytes, equal to those of the ``tokenizers`` file without special tokens around them.

    A byte-level BPE file whose merges are in the order of their ids is run by ``tiktoken`` on the
    ranks read from that file, which takes a quarter of the time; any other file by ``tokenizers``. A text that
    holds one of the file's added tokens, which keep their own ids wherever they occur, goes through ``tokenizers`` as well.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.fast = path, None
        self.added = tuple(t["content"] for t in spec.get("added_tokens", []))
        ranks = self._ranks(spec)
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=UNITS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def own(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or spec.get("normalizer"):
            return None
        special = {t["content"] for t in spec.get("added_tokens", [])}
        byte_of, vocab = _byte_of(), model["vocab"]
        joined = [m.replace(" ", "", 1) if isinstance(m, str) else m[0] + m[1] for m in model["merges"]]
        ids = [vocab[j] for j in joined]
        if any(b <= a for a, b in zip(ids, ids[1:], strict=False)):
            return None
        return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}

    def __call__(self, text: str) -> bytes:
        fast = self.fast and not any(t in text for t in self.added)
        ids = self.fast(text) if fast else self.own.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of each document: its ids and then ``end_id``, cut into ``capacity`` tokens if it is longer.

    The first piece takes what is over, so that all others are full. ``part`` is the task that made a piece, and ``nth`` counts the
    task's pieces of one length from 0: together they number equal lengths without a sort, whatever the rows are.
    """
    require(docs, ["doc_id", "text"])
    with open(tokenizer, "rb"):  # a clear failure here rather than in a task
        pass
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, seen = Encoder(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc_id, no_id, text in zip(batch["doc_id"], batch[NO_ID], batch["text"], strict=True):
                ids = encode(text) + end if text else end
                n = len(ids) // 4
                begin, piece = 0, 0
                length = n if n <= capacity else n % capacity or capacity
                while begin < n:
                    rows.append((doc_id, no_id, piece, begin, length, zlib.crc32(ids[4 * begin : 4 * (begin + length)]), part, seen[length]))
                    seen[length] += 1
                    begin, piece, length = begin + length, piece + 1, capacity
            yield pd.DataFrame(rows, columns=["doc_id", NO_ID, "piece", "start", "length", "ids_crc32", "part", "nth"])

    return null_id(with_id(docs, "text").mapInPandas(run, _PIECES))


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Packs ``counts[length]`` pieces of each length; returns placements and the number of bins.

    A placement ``(length, first, last, each, bin, offset, stride)`` says that the pieces of that
    length ranked first..last fill bins from ``bin`` on, ``each`` to a bin, at ``offset`` and then
    every ``stride`` tokens. Equal bins form one run, so the work depends on the number of lengths,
    never on the number of pieces.

    Pieces over a third of the capacity go first: at most two share a bin, and each, from the
    longest on, takes the longest partner that still fits. Then the smaller ones, from the longest
    on, go to the bin with the smallest gap that holds them.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    placed: list[tuple[int, int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first bin, bins)
    order: list[int] = []  # gaps that have runs, ascending
    bins = 0

    def put(length: int, each: int, first_bin: int, n_bins: int, offset: int) -> None:
        n = each * n_bins
        placed.append((length, used[length], used[length] + n - 1, each, first_bin, offset, length))
        used[length] += n
        left[length] -= n

    def leave(gap: int, run: tuple[int, int]) -> None:
        if gap > 0 and run[1] > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append(run)

    large = sorted(k for k in left if 3 * k > capacity)
    for length in reversed(large):
        while left[length]:
            mates = [k for k in large if k <= min(length, capacity - length) and left[k] > (k == length)]
            if not mates:
                n = left[length]
                put(length, 1, bins, n, 0)
                leave(capacity - length, (bins, n))
            elif mates[-1] == length:
                n = left[length] // 2
                put(length, 2, bins, n, 0)
                leave(capacity - 2 * length, (bins, n))
            else:
                mate = mates[-1]
                n = min(left[length], left[mate])
                put(length, 1, bins, n, 0)
                put(mate, 1, bins, n, length)
                leave(capacity - length - mate, (bins, n))
            bins += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(order, length)
            if at == len(order):  # no gap holds it: new bins, as empty ones
                n = -(-left[length] // (capacity // length))
                leave(capacity, (bins, n))
                bins += n
                continue
            gap = order[at]
            first_bin, n_bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            most = gap // length
            whole = min(n_bins, left[length] // most)
            if whole:
                put(length, most, first_bin, whole, capacity - gap)
                leave(gap - most * length, (first_bin, whole))
            rest, some = n_bins - whole, left[length]
            if rest and some:  # the last few pieces share one bin
                put(length, some, first_bin + whole, 1, capacity - gap)
                leave(gap - some * length, (first_bin + whole, 1))
                whole += 1
            leave(gap, (first_bin + whole, n_bins - whole))
    return placed, bins


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row a piece. A null
    or empty text is one piece that holds only ``end_id``; rows without an id, repeated rows and other ties are packed as often as they
    occur, in any order among themselves; a long text is encoded whole and cut; other columns are ignored; an empty table
    gives no rows.

    Only the counts of the ``capacity`` possible lengths reach the driver, and the placements that
    come back are broadcast; both are bounded by the capacity, not by the corpus. Each task numbers its pieces of a length as it
    makes them, and the tasks' counts, a row a task and length, tell where its numbers begin.
    """
    table = materialize(pieces(docs, tokenizer, capacity, end_id), "pieces")
    sizes = materialize(table.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    placed, _ = plan(counts, capacity)
    runs = docs.sparkSession.createDataFrame(
        placed, "length long, first long, last long, each long, bin long, at long, stride long"
    )
    before = "sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding)"
    base = materialize(sizes.selectExpr("length", "part", f"coalesce({before}, 0L) as base"), "piece-bases")
    ranked = table.join(base, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("base"))
    met = ranked.join(F.broadcast(runs), "length").where("rank between first and last")
    nth = F.col("rank") - F.col("first")
    return met.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.expr("(rank - first) div each")).alias("sequence_id"),
        (F.col("at") + (nth % F.col("each")) * F.col("stride")).alias("offset"),
    )
