"""Mail bodies as blocks of one quote depth, by windows over numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.fidelity import flatten_quotes, needs_quotes, sanitized

#: Keys of a mail header in three languages (fixed values).
HEADER_KEYS = "From|Date|Sent|To|Subject|Cc|发件人|發件人|发送时间|發送時間|收件人|收件者|抄送|主题|主題|主旨"
HEADER = rf"(?iU)\b({HEADER_KEYS})\s*:\s*"
#: Lines that separate a forwarded or answered mail (fixed patterns).
FORWARD = (
    r"(?iU)\A\s*(?:-+\s*(?:轉寄郵件|转寄邮件)\s*-+|-+\s*Forwarded\s+Message\s*-+|Begin\s+forwarded\s+message:?"
    r"|.+?\s+於\s+.+?\s+寫道:|On\s+.+?\s+wrote:)\s*\z"
)
#: Lines that a header block is looked for in, and the different keys it needs.
AHEAD, KEYS = 6, 3


def lines(mails: DataFrame, key: str = "doc_id", body: str = "body") -> DataFrame:
    """``key, pos, line``: the lines of each body, numbered from 0; a line break at the end adds none."""
    clean = F.regexp_replace(F.coalesce(F.col(body), F.lit("")), r"\r\n?", "\n")
    return mails.where(clean != "").select(key, F.posexplode(F.split(F.regexp_replace(clean, r"\n\z", ""), "\n")).alias("pos", "line"))


def _depths(rows: DataFrame, key: str, mark: Column) -> DataFrame:
    """Every marked line and all after it lie one deeper."""
    extra = F.count_if(mark).over(Window.partitionBy(key).orderBy("pos"))
    return rows.withColumn("depth", F.col("depth") + extra)


def quote_lines(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, pos, depth, content``: quote marks, forward separators and header blocks all deepen the lines from them on.

    A header block begins at a line with a header key of which it and the next five lines hold three
    different ones; a block that follows such a line directly does not count again.
    """
    rows = rows.withColumns({"depth": T.quote_depth(F.col("line")), "content": T.unquoted(F.col("line"))})
    rows = _depths(rows, key, F.trim("content").rlike(FORWARD))
    # a deeper line is written with its marks, so that a header key is sought in all of it
    found = F.transform(F.regexp_extract_all("content", F.lit(HEADER), F.lit(1)), lambda k: F.lower(k))
    w = Window.partitionBy(key).orderBy("pos")
    keys = F.size(F.array_distinct(F.flatten(F.collect_list(found).over(w.rowsBetween(0, AHEAD - 1)))))
    rows = rows.withColumn("_header", (F.size(found) > 0) & (keys >= KEYS))
    rising = F.col("_header") & ~F.coalesce(F.lag("_header").over(w), F.lit(False))
    rows = rows.withColumn("_rising", rising)
    return _depths(rows, key, F.col("_rising")).select(key, "pos", "depth", "content")


def blocks(quoted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs of one depth in order: ``key, page, part, depth, text``; blank runs are left out.

    The part is ``body`` at depth 0, else ``quote``; the page counts the runs that hold text.
    """
    w = Window.partitionBy(key).orderBy("pos")
    new = F.when(F.col("depth").eqNullSafe(F.lag("depth").over(w)), 0).otherwise(1)
    runs = quoted.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda s: s["content"]), "\n")
    runs = runs.groupBy(key, "_run", "depth").agg(T.strip(body).alias("text")).where("text != ''")
    page = F.row_number().over(Window.partitionBy(key).orderBy("_run"))
    return runs.select(key, page.alias("page"), F.when(F.col("depth") == 0, "body").otherwise("quote").alias("part"), "depth", "text")


def raw_blocks(mails: DataFrame, key: str = "doc_id", body: str = "body") -> DataFrame:
    """The whole way from a body to its blocks: ``key, page, part, depth, text``.

    Bodies that quote by block elements become lines first; then lines are quoted, cut into runs of one depth, and cleaned. Blocks that
    cleaning leaves blank are left out, and pages keep their numbers. A body that is null or empty has no block.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    flat = mails.select(key, F.when(needs_quotes(text), flatten_quotes(text)).otherwise(text).alias("body"))
    return blocks(quote_lines(lines(flat, key), key), key).withColumn("text", sanitized(F.col("text"))).where("text != ''")


def canonical(blocks_: DataFrame, key: str = "doc_id", order: str = "page", text: str = "text") -> DataFrame:
    """Numbers the blocks that hold text and adds their measures: ``seq, char, word, block_id``."""
    kept = blocks_.where(~T.is_blank(F.col(text)))
    seq = F.row_number().over(Window.partitionBy(key).orderBy(order))
    kept = kept.withColumn("seq", seq)
    number = F.when(F.col("seq") < 100, F.lpad(F.col("seq").cast("string"), 2, "0")).otherwise(F.col("seq").cast("string"))
    return kept.withColumns({"char": T.char_count(F.col(text)), "word": T.word_count(F.col(text)), "block_id": F.concat(F.col(key).cast("string"), F.lit("_b"), number)})


def split_gain(baseline: DataFrame, enhanced: DataFrame, key: str = "doc_id") -> DataFrame:
    """Block counts and sizes of two ways to split the same mails, and the gain of the second."""

    def measures(df: DataFrame, name: str) -> DataFrame:
        n = F.char_length("text")
        return df.groupBy(key).agg(
            F.count("*").alias(f"{name}_blocks"), F.count_if(F.col("part") == "body").alias(f"{name}_body"), F.max(n).alias(f"{name}_longest"), F.count_if(n >= 1000).alias(f"{name}_large")
        )

    both = measures(baseline, "baseline").join(measures(enhanced, "enhanced"), key)
    return both.withColumn("split_gain", F.try_divide("enhanced_blocks", "baseline_blocks"))


def allowed(sender: Column, suffixes: tuple[str, ...], rejected: tuple[str, ...] = ()) -> Column:
    """Whether a sender ends with an allowed suffix and is not rejected, in any case."""
    lower, ok = F.lower(F.trim(sender)), F.lit(False)
    for s in suffixes:
        ok = ok | lower.endswith(s.lower())
    return ok & ~lower.isin(*[r.lower() for r in rejected]) if rejected else ok


def recipient_problems(to: Column, cc: Column, bcc: Column, reviewer: str, admin: str) -> Column:
    """What breaks the rule that mail goes to the reviewer alone, with a blind copy to the administrator alone."""
    is_only = lambda c, who: (F.size(c) == 1) & (F.lower(F.get(c, F.lit(0))) == who.lower())
    said = [F.when(~is_only(to, reviewer), "to"), F.when(F.coalesce(F.size(cc), F.lit(0)) > 0, "cc"), F.when(~is_only(bcc, admin), "bcc")]
    return F.filter(F.array(*said), lambda s: s.isNotNull())
