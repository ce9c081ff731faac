"""Cutting texts into chunks."""

from __future__ import annotations

import itertools
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.functions import text as T
from tessera.functions.fidelity import sanitize

#: Words of a chunk at most, and words up to which a block is dropped (fixed values).
MOST_WORDS, DROP_WORDS = 500, 10
#: Characters of text whose chunks a Python worker holds at once.
PART = 1 << 21

_PARAGRAPH, _SENTENCE, _SPACE = re.compile(r"\n\s*\n+"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"\s+")


def split_long(text: str | None, most: int = MOST_WORDS) -> list[str]:
    """Pieces of at most ``most`` words: along paragraphs, else sentences, else every ``most`` words.

    Neighbouring units share a piece while they fit; a unit that is too long is split by itself.
    """
    text = (text or "").strip()
    n = len(text.split())
    if n <= most:
        return [text] if text else []
    units = [u for u in (p.strip() for p in _PARAGRAPH.split(text)) if u]
    if len(units) < 2:
        units = [u for u in (s.strip() for s in _SENTENCE.split(_SPACE.sub(" ", text))) if u]
    if len(units) < 2:
        words = text.split()
        return [" ".join(words[i : i + most]) for i in range(0, n, most)]
    done: list[str] = []
    held: list[str] = []
    weight = 0
    for unit in units:
        w = len(unit.split())
        if weight and weight + w > most:
            done.append(" ".join(held))
            held, weight = [], 0
        if w > most:
            done.extend(split_long(unit, most))
        else:
            held.append(unit)
            weight += w
    if held:
        done.append(" ".join(held))
    return done


def chunk(blocks: DataFrame, text: str = "text", most: int = MOST_WORDS, drop: int = DROP_WORDS) -> DataFrame:
    """Blocks as tagged chunks: all columns, ``chunk_index``, ``chunk_total``, ``char``, ``word``, ``status``.

    Blank blocks and those of at most ``drop`` words get the status ``dropped`` and one row; blocks that stay
    whole are ``kept``, pieces of longer ones ``split``. One frame thus serves the chunks and both audits.
    """
    words = T.word_count(F.col(text))
    short = blocks.withColumn("_n", words)

    @F.pandas_udf("array<string>")
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: split_long(t, most))

    few = F.array(T.strip(F.coalesce(F.col(text), F.lit(""))))
    parts = F.when(F.col("_n") <= most, few).otherwise(pieces(F.when(F.col("_n") > most, F.col(text)).otherwise("")))
    out = short.withColumn("_parts", parts).withColumn("chunk_total", F.size("_parts"))
    others = [c for c in blocks.columns if c != text]
    out = out.select(*others, "_n", "chunk_total", F.posexplode("_parts").alias("_at", text))
    status = F.when(F.col("_n") <= drop, "dropped").when(F.col("chunk_total") > 1, "split").otherwise("kept")
    return out.select(
        *others, (F.col("_at") + 1).alias("chunk_index"), "chunk_total", T.char_count(F.col(text)).alias("char"),
        T.word_count(F.col(text)).alias("word"), status.alias("status"), text,
    )


def chunk_statistics(tagged: DataFrame) -> DataFrame:
    """Blocks dropped, kept and split, the chunks that came of them, and their share of all chunks."""
    first = F.col("chunk_index") == 1
    return tagged.agg(
        F.count_if(first & (F.col("status") == "dropped")).alias("dropped"),
        F.count_if(first & (F.col("status") == "kept")).alias("kept"),
        F.count_if(first & (F.col("status") == "split")).alias("split"),
        F.count_if(F.col("status") != "dropped").alias("chunks"),
    )


def overlap_chunks(text: Column, size: int = 2000, overlap: int = 20) -> Column:
    """Nearly equal chunks of at most about ``size`` characters, each but the last going ``overlap`` into the next."""
    length = F.char_length(text)
    n = F.greatest(F.lit(1), F.ceil(length / size)).cast("int")
    each = F.floor(length / n).cast("int")
    cut = lambda i: F.substring(text, i * each + 1, F.when(i == n - 1, length).otherwise(each + overlap))
    return F.when(n == 1, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), cut))


def fixed_chunks(text: Column, size: int) -> Column:
    """Slices of ``size`` characters; blank slices are left out."""
    n = F.greatest(F.lit(1), F.ceil(F.char_length(text) / size)).cast("int")
    cut = lambda i: T.strip(F.substring(text, i * size + 1, F.lit(size)))
    return F.filter(F.transform(F.sequence(F.lit(0), n - 1), cut), lambda s: s != "")


def recursive_split(text: str | None, size: int = 2000, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters along the coarsest separator that will do, repeating up to ``overlap`` of the piece before.

    A separator stays at the head of the part behind it. Parts of ``size`` or more go down to the finer separators and end the piece before
    them; a part for which there is none left stays whole. White space at the ends of a piece goes, and so do blank pieces.
    """
    if not text:
        return []
    mark = next((s for s in separators if s in text), separators[-1])
    finer = separators[separators.index(mark) + 1 :] if mark in text else ()
    head, *rest = text.split(mark) if mark else text
    pieces: list[str] = []
    for short, run in itertools.groupby((p for p in (head, *(mark + r for r in rest)) if p), key=lambda p: len(p) < size):
        if short:
            pieces += _filled(run, size, overlap)
        else:
            pieces += itertools.chain.from_iterable(recursive_split(p, size, overlap, finer) if finer else [p] for p in run)
    return [p for p in map(str.strip, pieces) if p]


def _filled(parts: Iterable[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring parts together while they fit; the last ones of a piece, up to ``overlap`` characters, begin the next."""
    held: deque[str] = deque()
    length = 0
    for part in parts:
        if held and length + len(part) > size:
            yield "".join(held)
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.popleft())
        held.append(part)
        length += len(part)
    yield "".join(held)


def rejoin(pieces: list[str], most: int = 1200) -> list[str]:
    """Appends a piece to the one before while that ends no sentence and is shorter than ``most``, unless the piece begins with a capital."""
    out: list[str] = []
    for piece in filter(None, map(str.strip, pieces)):
        if out and len(out[-1]) < most and out[-1][-1] not in ".!?:" and not piece[0].isupper():
            out[-1] += " " + piece
        else:
            out.append(piece)
    return out


def without_quote_marks(text: str) -> str:
    """The lines of a cleaned mail that hold more than quote marks, stripped; one that says who wrote has a blank line before it.

    Cleaning leaves a mail on a single line, so this drops a mail of quote marks alone and else changes nothing; a text that keeps its lines is
    treated line by line.
    """
    kept = []
    for line in filter(None, map(str.strip, text.splitlines())):
        if line.strip(">"):
            heads = re.match("(?:From|To|Subject|Date):", line)
            said = "@" in line and ("wrote:" in line or "said:" in line)
            kept.append("\n" + line if said and not heads else line)
    return "\n".join(kept).strip()


def mail_chunks(text: str | None, least: int = 100, size: int = 2000, overlap: int = 200) -> list[str]:
    """The chunks of a mail's text: cleaned, without quote marks, split, short pieces dropped, broken sentences joined again, and only those with words.

    A text, a piece and a chunk each need ``least`` characters, a chunk five words of two Latin letters or more.
    """
    if not text or len(text.strip()) < least:
        return []
    flat = without_quote_marks(sanitize(text))
    if len(flat) < least:
        return []
    whole = rejoin([p for p in recursive_split(flat, size, overlap) if len(p) >= least])
    return [c for c in whole if len(c) >= least and len(re.findall(r"\b[a-zA-Z]{2,}\b", c)) >= 5]


def chunk_lines(lines: DataFrame, key: str = "doc_id", at: str = "pos", line: str = "line", least: int = 100, size: int = 2000, overlap: int = 200) -> DataFrame:
    """``key, chunk, text`` from mails in lines: ``mail_chunks`` of each mail, numbered from 1.

    A table function gets the lines of one mail after another, in order; a mail, not a table, must fit in its memory. Null lines are
    blank; rows without a key are left out; mails without a chunk give no row.
    """
    kind = dict(lines.dtypes)[key]

    class Chunks:
        def __init__(self) -> None:
            self.key, self.held = None, []

        def eval(self, row: Row) -> None:
            self.key = row["key"]
            self.held.append(row["line"] or "")

        def terminate(self) -> Iterator[tuple]:
            for i, text in enumerate(mail_chunks("\n".join(self.held), least, size, overlap), 1):
                yield self.key, i, text

    made = udtf(Chunks, returnType=f"key {kind}, chunk int, text string")
    rows = lines.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(line).alias("line"))
    return made(rows.asTable().partitionBy("key").orderBy("at")).withColumnRenamed("key", key)


def markdown_sections(text: str | None, flush: int = 2000, least: int = 80) -> list[str]:
    """Sections between headings outside of code fences, flushed once long; shorter ones than ``least`` are left out."""
    out: list[str] = []
    held: list[str] = []
    fenced = False
    for line in (text or "").splitlines():
        if line.lstrip().startswith("```"):
            fenced = not fenced
        if (not fenced and re.match(r"#{1,6}\s", line) and held) or sum(map(len, held)) >= flush:
            out.append("\n".join(held).strip())
            held = []
        held.append(line)
    out.append("\n".join(held).strip())
    return [s for s in out if len(s) >= least]


def split_udf(split, *args) -> Column:
    """A Python splitter as a column function from text to an array of texts; what a batch gives goes back in parts of at most about ``PART`` characters of text."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.string())
        for texts in batches:
            held: list[list[str]] = []
            weight = 0
            for t in texts:
                text = t.as_py()
                held.append(split(text, *args))
                weight += len(text or "")
                if weight >= PART:
                    yield pa.array(held, kind)
                    held, weight = [], 0
            if held or not len(texts):
                yield pa.array(held, kind)

    return run


def split_pages(lines: DataFrame, key: str = "doc_id", at: str = "pos", line: str = "line") -> DataFrame:
    """Lines with page marks as pages: ``key, page_label, page_num, text``, the lines of a page joined by blanks.

    A mark is ``<<<PAGE_BREAK_label>>>`` on a line of its own; lines before the first mark belong to no page.
    """
    mark = F.regexp_extract(line, r"^\s*<<<PAGE_BREAK_(.+?)>>>\s*$", 1)
    w = Window.partitionBy(key).orderBy(at)
    tagged = lines.withColumn("_mark", F.when(mark != "", mark)).withColumn("_page", F.count("_mark").over(w))
    tagged = tagged.withColumn("_label", F.last("_mark", ignorenulls=True).over(w)).where("_label is not null and _mark is null")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(at).alias("p"), T.strip(F.col(line)).alias("t")))), lambda s: s["t"]), " ")
    pages = tagged.where(~T.is_blank(F.col(line))).groupBy(key, "_page", "_label").agg(T.strip(body).alias("text"))
    return pages.select(key, T.page_label(F.col("_label")).alias("page_label"), T.page_number(F.col("_label")).alias("page_num"), "text")
