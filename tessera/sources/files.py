"""Readers and writers for JSON lines, mailboxes, encoded text, CSV matrices and their ledgers.

Parsers that need other libraries (page layout, office files, recognition, speech, models) are passed in as
functions of bytes; nothing here calls a network.
"""

from __future__ import annotations

import email
import email.policy
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tessera.functions.fidelity import html_text, read_text
from tessera.operators.tables import numbered_all

#: The block that parsers make and chunkers take; keys beyond it go to ``extra`` as JSON.
_TEXTS = "doc_id block_id page part file_type attachment source subject date from to email_id thread_id text".split()
BLOCK = StructType([StructField(c, StringType()) for c in _TEXTS[:3]] + [StructField(c, IntegerType()) for c in ("char", "word")] + [StructField(c, StringType()) for c in _TEXTS[3:]])


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType = BLOCK) -> DataFrame:
    """JSON lines with a fixed schema; a line that is no JSON is kept whole in ``_corrupt``."""
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def parse_jsonl(lines: DataFrame, schema: StructType = BLOCK, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines as rows and the lines that are no JSON objects, each with a reason."""
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    parsed = lines.select(value, F.from_json(value, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r._corrupt").isNotNull() | F.col("r").isNull()
    good = parsed.where(~bad).select("r.*").drop("_corrupt")
    return good, parsed.where(bad).select(F.col(value).alias("line"), F.when(F.trim(value) == "", "empty").otherwise("invalid").alias("reason"))


def write_jsonl(df: DataFrame, path: str, last: str = "text") -> None:
    """JSON lines with one column behind all others."""
    df.select(*[c for c in df.columns if c != last], last).write.mode("overwrite").json(path)


def metadata_json(df: DataFrame, text: str = "text") -> Column:
    """All columns but the text as one JSON object; characters stay as they are."""
    return F.to_json(F.struct(*[c for c in df.columns if c != text]))


def overlay(base: Column, new: Column) -> Column:
    """Two maps as one, in which the second wins."""
    left = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(left, new)


def read_texts(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8", "gbk", "gb2312", "gb18030", "big5")) -> DataFrame:
    """Whole files as ``path, text``, each in the first encoding that reads it."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", read_text(encodings)(F.col("content")).alias("text"), F.sha1("content").alias("sha1"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of pixel levels as ``x, y, level``; rows are numbered in file order."""
    lines = spark.read.format("binaryFile").load(path).select(F.split(F.regexp_replace(F.decode("content", "UTF-8"), r"\s+\z", ""), r"\r?\n").alias("rows"))
    rows = lines.select(F.posexplode("rows").alias("y", "row"))
    return rows.select("y", F.posexplode(F.split("row", ",")).alias("x", "v")).select("x", "y", F.col("v").try_cast("double").alias("level"))


def body_of(message: email.message.EmailMessage) -> str:
    """The plain body if there is one, else the text of the HTML one."""
    part = message.get_body(preferencelist=("plain", "html"))
    if part is None:
        return ""
    try:
        content = part.get_content()
    except (LookupError, UnicodeDecodeError):
        content = (part.get_payload(decode=True) or b"").decode("utf-8", errors="replace")
    return html_text(content) if part.get_content_subtype() == "html" else content


MAIL = "message_id string, subject string, date string, sender string, recipients string, body string, attachments array<struct<name:string,content:binary>>"


@lru_cache(maxsize=1024)
def _header(name: str, value: str) -> str:
    return email.policy.default.header_fetch_parse(name, value)


class _Remembering(email.policy.EmailPolicy):
    """The default policy, which parses a header anew whenever it is asked for, with a memory for the last ones."""

    def header_fetch_parse(self, name: str, value: str) -> str:
        return value if hasattr(value, "name") else _header(name, value)


_POLICY = _Remembering()


def parsed_mail(raw: bytes) -> dict | None:
    """The fields of one mail; null without a Message-ID."""
    m = email.message_from_bytes(raw, policy=_POLICY)
    if not m["Message-ID"]:
        return None
    files = [{"name": a.get_filename() or "", "content": a.get_payload(decode=True) or b""} for a in m.iter_attachments()]
    head = lambda k: str(m[k]) if m[k] else ""
    return {
        "message_id": head("Message-ID").strip().strip("<>"), "subject": head("Subject"), "date": head("Date"),
        "sender": head("From"), "recipients": head("To"), "body": body_of(m), "attachments": files,
    }


def parse_mails(raws: DataFrame, *keep: str, raw: str = "raw", envelope: bool = False) -> DataFrame:
    """Mails as bytes, a row each, as the columns of ``MAIL`` beside those to keep; null ones and those without a Message-ID are left out.

    With ``envelope`` the first line is not the mail's and is skipped.
    """
    names = [c.split()[0] for c in MAIL.split(", ")]
    mail = (lambda data: data.partition(b"\n")[2]) if envelope else bytes

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [parsed_mail(mail(bytes(r))) for r in batch[raw]]
            some = [m is not None for m in made]
            yield pd.concat([batch.loc[some, list(keep)].reset_index(drop=True), pd.DataFrame([m for m in made if m], columns=names)], axis=1)

    kinds = dict(raws.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keep), MAIL])
    return raws.where(F.col(raw).isNotNull()).select(*keep, raw).mapInPandas(run, schema)


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``MAIL`` of the mails of all mailbox files under a path; those without a Message-ID are left out.

    A line that begins with ``From `` begins a mail, the first line of a file among them. Files are cut there by the reader of text
    files, so a large mailbox is read by many tasks.
    """
    cut = spark.read.option("lineSep", "\nFrom ").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("raw"))
    return parse_mails(cut, "path", envelope=True)


def parse_attachments(mails: DataFrame, parsers: dict[str, Callable[[bytes], list[str]]]) -> DataFrame:
    """``message_id, name, page, text, error``: attachments by the parser of their suffix. One that fails or has no
    parser gives a row with its error and does not disturb the others."""
    rows = mails.select("message_id", F.explode("attachments").alias("a")).select("message_id", "a.name", "a.content")

    def one(name: str, content: bytes) -> list[tuple[int, str | None, str | None]]:
        parse = parsers.get(os.path.splitext(name)[1].lower())
        if parse is None:
            return [(0, None, "no parser")]
        try:
            return [(i, text, None) for i, text in enumerate(parse(content), 1)]
        except Exception as e:  # noqa: BLE001 - whatever a parser raises belongs to its file
            return [(0, None, f"{type(e).__name__}: {e}"[:500])]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(m, n, *r) for m, n, c in zip(b["message_id"], b["name"], b["content"], strict=True) for r in one(n, bytes(c))]
            yield pd.DataFrame(made, columns=["message_id", "name", "page", "text", "error"])

    return rows.mapInPandas(run, "message_id string, name string, page int, text string, error string")


def imap_header(line: Column) -> Column:
    """UID, flags and date out of the head of a fetched mail."""
    flags = F.filter(F.split(F.regexp_extract(line, r"FLAGS \(([^)]*)\)", 1), " "), lambda f: f != "")
    uid = F.regexp_extract(line, r"UID (\d+)", 1)
    return F.struct(F.when(uid != "", uid).cast("long").alias("uid"), flags.alias("flags"), F.regexp_extract(line, r'INTERNALDATE "([^"]*)"', 1).alias("internaldate"))


def reading_order(spans: DataFrame, key: str = "page") -> DataFrame:
    """The text of each page with its spans from top to bottom (to a tenth) and from left to right."""
    item = F.struct(F.round("y", 1).alias("y"), "x", "text")
    return spans.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["text"]), "\n").alias("text"))


def ocr_reasons(text: Column, suspect: Column) -> Column:
    """Why a page should be recognised: it has no text, little, or suspect text that is short."""
    n = F.char_length(F.trim(F.coalesce(text, F.lit(""))))
    said = [F.when(n == 0, "empty"), F.when((n > 0) & (n < 50), "short"), F.when(suspect & (n < 100), "suspect")]
    return F.filter(F.array(*said), lambda s: s.isNotNull())


def choose_ocr(raw: Column, recognised: Column) -> Column:
    """The recognised text if there is no other, or if it is over 50 characters and half as long again."""
    a, b = F.char_length(F.trim(F.coalesce(raw, F.lit("")))), F.char_length(F.trim(F.coalesce(recognised, F.lit(""))))
    return F.when((a == 0) | ((b > 50) & (b > 1.5 * a)), F.coalesce(recognised, raw)).otherwise(raw)


def sheet_text(cells: DataFrame, key: str = "file") -> DataFrame:
    """Workbook cells ``(key, sheet, row, col, value)`` as one text: cells by tabs, rows by lines, sheets in order of name."""
    row = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("v")))), lambda c: c["v"]), "\t")
    rows = cells.groupBy(key, "sheet", "row").agg(row.alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n")
    sheets = rows.groupBy(key, "sheet").agg(F.concat(F.lit("=== Sheet: "), F.first("sheet"), F.lit(" ===\n"), body).alias("part"))
    return sheets.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sheet", "part"))), lambda s: s["part"]), "\n").alias("text"))


def append_ids(existing: DataFrame, rows: DataFrame, order: list[str], name: str = "vector_id") -> DataFrame:
    """New rows numbered on from the greatest number there is, or from 0."""
    base = existing.agg(F.max(name)).first()[0]
    return numbered_all(rows, order, name, 0 if base is None else base + 1)


def pending(work: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Work that the ledger does not know as done; failures are tried again."""
    return work.join(ledger.where("status = 'success'").select(key).distinct(), key, "left_anti")


def record(ledger: DataFrame, results: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The ledger with the results in it, the last of each key, errors cut to 500 characters.

    The last result is the one with the greatest ``order``; of equal ones, and without an order, the greatest row.
    """
    cut = results.withColumn("error", F.substring("error", 1, 500))
    by = F.struct(*([order] if order else []), *[c for c in cut.columns if c not in (key, order)])
    new = cut.groupBy(key).agg(F.max_by(F.struct(*[c for c in cut.columns if c != key]), by).alias("_r")).select(key, "_r.*")
    old = ledger.join(new.select(key), key, "left_anti")
    return old.unionByName(new.select(*ledger.columns))


def route(path: Column, include: tuple[str, ...], exclude: tuple[str, ...] = ()) -> Column:
    """Whether a path has one of the suffixes and none of those left out."""
    low = F.lower(path)
    ends = lambda suffixes: [low.endswith(s.lower()) for s in suffixes]
    ok, no = F.lit(False), F.lit(False)
    for c in ends(include):
        ok = ok | c
    for c in ends(exclude):
        no = no | c
    return ok & ~no


def artifact(names: list[str], mode: str) -> tuple[str, str]:
    """The one database and the one index of a mode; an error if there is none or more of either."""
    found = []
    for suffix in (".sqlite", ".index"):
        some = [n for n in names if os.path.basename(n).startswith(mode) and n.endswith(suffix)]
        if len(some) != 1:
            raise ValueError(f"{mode}: {len(some)} files with {suffix}, one is needed")
        found.append(some[0])
    return found[0], found[1]


def merged(base: dict, over: dict) -> dict:
    """Nested settings in which the second wins; lists and scalars are replaced whole."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def prepend_section(existing: str, section: str) -> str:
    """A note with a new section before what it held."""
    return section.rstrip("\n") + ("\n\n" + existing.lstrip("\n") if existing.strip() else "\n")


def insert_link(note: str, link: str) -> str:
    """A note with ``[[link]]`` behind its first rule, unless it has it."""
    if f"[[{link}]]" in note:
        return note
    m = re.search(r"^---\s*$", note, re.M)
    return f"{note[: m.end()]}\n[[{link}]]{note[m.end():]}" if m else f"[[{link}]]\n{note}"
