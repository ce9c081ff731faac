"""Queries that put the smaller functions and operators to work over rows made of the tables, each with SQL that computes the answer its own way."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tessera.functions import dates as D
from tessera.functions import fidelity as P
from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.operators import chunking as K
from tessera.operators import curves as C
from tessera.operators import mail as M
from tessera.operators import notes as O
from tessera.operators import parts as L
from tessera.operators import pixels as X
from tessera.operators import quote as Q
from tessera.operators import tables as B
from tessera.plans.numeric import catalogue, snapshots
from tessera.plans.registry import Registry
from tessera.session import checkpointed, table
from tessera.sources import files as S
from tessera.streaming import grid as G
from tessera.streaming import review as V

query = Registry()

def _n() -> Column:
    return F.col("p_partkey")


def _stateful(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows, in a session that can keep state: a batch finds its state's coordinator only once the streams have been asked for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _ = spark.streams.active
    return rows


def _pick(n: Column, *values: str) -> Column:
    """One of the values by a number, as ``[...][n % k + 1]`` in SQL."""
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


_HEADS = ("UL 1598", "NMX-J-307 UL 8", "CSA C22 UL 8", "ANSI x", "2020 National Electrical Code Handbook", "UL", "JUNE 3, 2019 - UL 1598", "Document Was Downloaded By X", "keep me", "NOT AUTHORIZED FOR FURTHER use", "12", "t7")


@query("""WITH l AS (SELECT p_partkey, p_partkey % 12 AS k, p_name, ['UL 1598','NMX-J-307 UL 8','CSA C22 UL 8','ANSI x','2020 National Electrical Code Handbook','UL','JUNE 3, 2019 - UL 1598','Document Was Downloaded By X','keep me','NOT AUTHORIZED FOR FURTHER use','12','t7'][p_partkey % 12 + 1] AS line FROM part)
SELECT p_partkey, k < 5 AND k <> 3 AS head, CASE WHEN k IN (6, 7, 9) THEN '' ELSE line || chr(10) END || p_name AS kept, replace(replace(line, 'UL 1598', ''), 'UL 8', '') AS unmarked,
  CASE WHEN k % 2 = 0 THEN p_partkey || 'A' ELSE 't' || p_partkey || 'A_2' END AS standard, CASE WHEN k = 10 THEN '0012' ELSE upper(line) END AS label, k % 4 AS depth, line AS said FROM l""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of standards: running heads, overlays, watermarks, numbers, labels, and quote marks."""
    line = _pick(_n(), *_HEADS)
    doc = F.concat(F.when(_n() % 2 == 0, "s").otherwise("t"), _n().cast("string"), F.lit("A_2"))
    quoted = F.concat(F.repeat(F.lit(">"), (_n() % 4).cast("int")), F.when(_n() % 4 > 0, "  ").otherwise(""), line)
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.is_standard_header(line).alias("head"), T.drop_overlay(F.concat(line, F.lit("\n"), "p_name")).alias("kept"),
        T.strip_watermark(line, (r"UL 1598", r"UL \d$")).alias("unmarked"), T.standard_number(doc).alias("standard"), T.page_label(line).alias("label"),
        T.quote_depth(quoted).alias("depth"), T.unquoted(quoted).alias("said"),
    )


@query("""SELECT p_partkey AS id, p_partkey % 13 < 9 AS dropped, CASE p_partkey % 4 WHEN 0 THEN p_name || '|' || p_size WHEN 1 THEN '' WHEN 2 THEN '' ELSE '1|2.5|true' END AS listed FROM part""")
def small_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one to thirteen words, and lists that came as JSON text."""
    words = F.array_join(F.array_repeat(F.lit("lamp"), (_n() % 13 + 1).cast("int")), " ")
    coded = F.when(_n() % 4 == 0, F.to_json(F.array("p_name", F.col("p_size").cast("string")))).when(_n() % 4 == 1, '{"a":').when(_n() % 4 == 2, "").otherwise("[1, 2.5, true]")
    return table(spark, sf_dir, "part").select(_n().alias("id"), T.too_small(words).alias("dropped"), F.array_join(T.json_list(coded), "|").alias("listed"))


_ITEM = StructType([StructField("doc_id", StringType()), StructField("word", IntegerType()), StructField("text", StringType())])


@query("""SELECT CASE WHEN item_id % 5 > 1 THEN item_id::VARCHAR END AS doc_id, CASE WHEN item_id % 5 > 1 THEN length(text)::INTEGER END AS word, CASE WHEN item_id % 5 > 1 THEN md5(text) END AS text_md5,
  CASE item_id % 5 WHEN 0 THEN '{broken ' || item_id WHEN 1 THEN ' ' END AS line, CASE item_id % 5 WHEN 0 THEN 'invalid' WHEN 1 THEN 'empty' END AS reason FROM benchmark""")
def jsonl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as JSON lines, some of them broken or blank, read back with the reasons of those that are not."""
    b, n = table(spark, sf_dir, "benchmark"), F.col("item_id")
    item = F.to_json(F.struct(n.cast("string").alias("doc_id"), F.char_length("text").alias("word"), "text"))
    lines = b.select(F.when(n % 5 == 0, F.concat(F.lit("{broken "), n.cast("string"))).when(n % 5 == 1, " ").otherwise(item).alias("value"))
    good, bad = S.parse_jsonl(lines, _ITEM)
    none = F.lit(None).cast("string")
    rows = good.select("doc_id", "word", F.md5("text").alias("text_md5"), none.alias("line"), none.alias("reason"))
    return rows.unionByName(bad.select(none.alias("doc_id"), F.lit(None).cast("int").alias("word"), none.alias("text_md5"), "line", "reason"))


@query("""SELECT 'm' || doc_id || '@x' AS message_id, 'Re: ' || coalesce(source, '') AS subject, 'é@' || coalesce(lang, '') AS sender, md5(replace(text, chr(13), chr(10)) || chr(10)) AS body_md5, CASE WHEN doc_id % 2 = 0 THEN 'n' || doc_id || '.txt' END AS name,
  CASE WHEN doc_id % 2 = 0 THEN md5('note ' || doc_id) END AS note_md5 FROM documents WHERE doc_id % 7 > 0 AND text IS NOT NULL AND text <> ''""")
def raw_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as mails in bytes, every second with an attachment and every seventh without an id, parsed, with the text of the attachments."""
    n = F.col("doc_id").cast("string")
    has = F.col("doc_id") % 2 == 0
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text", F.lit("\n"))
    note = F.concat(F.lit('\n--=q\nContent-Type: text/plain\nContent-Disposition: attachment; filename="n'), n, F.lit('.txt"\n\nnote '), n, F.lit("\n--=q--\n"))
    head = F.concat(
        F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("Message-ID: <m"), n, F.lit("@x>\n"))).otherwise(""), F.lit("Subject: Re: "), F.coalesce("source", F.lit("")),
        F.lit("\nFrom: =?utf-8?q?=C3=A9=40?="), F.coalesce("lang", F.lit("")), F.lit("\nMIME-Version: 1.0\n"),
    )
    whole = F.concat(head, F.when(has, F.concat(F.lit('Content-Type: multipart/mixed; boundary="=q"\n\n--=q\n'), plain, note)).otherwise(plain))
    d = table(spark, sf_dir, "documents").where("text is not null and text != ''")
    # stored without the bodies, for two uses of one parsing
    mails = checkpointed(S.parse_mails(d.select(whole.cast("binary").alias("raw"))).select("message_id", "subject", "sender", F.md5("body").alias("body_md5"), "attachments"))
    notes = S.parse_attachments(mails, {".txt": lambda b: [b.decode()]}).select("message_id", "name", F.md5("text").alias("note_md5"))
    told = mails.drop("attachments")
    return told.join(notes, "message_id", "left")


@query("""WITH p AS (SELECT p_partkey AS n, 'a' || md5(p_partkey::VARCHAR) AS a, 'b' || md5(p_name) AS b FROM part)
SELECT n AS id, 1 AS page, 'body' AS part, 0 AS depth, a AS text FROM p UNION ALL SELECT n, 2, 'quote', 1, CASE WHEN n % 2 = 0 THEN 'On a day someone wrote: ' || b ELSE b || ' ends. Here' END FROM p
UNION ALL SELECT n, 3, 'quote', 3, 'deep' FROM p WHERE n % 2 = 1""")
def mail_raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails that quote by block elements or by marks, the whole way to cleaned blocks."""
    n = _n().cast("string")
    a, b = F.concat(F.lit("a"), F.md5(n)), F.concat(F.lit("b"), F.md5("p_name"))
    marked = F.concat(F.lit("  "), a, F.lit("\n\n> "), b, F.lit("  x@y.com\n> ends.Here **\n>>> deep\n"))
    built = F.concat(F.lit("<div><p>"), a, F.lit("</p></div><br><br><br><br>"), F.lit("<blockquote>On a day someone wrote:<br>"), b, F.lit("</blockquote><div></div><p></p>"))
    mails = table(spark, sf_dir, "part").select(_n().alias("id"), F.when(_n() % 2 == 0, built).otherwise(marked).alias("body"))
    return M.raw_blocks(mails, "id")


def _shown(code: str) -> str:
    """Who sells, and how many in the first line, of a text of assignments."""
    found = P.assignments(code)
    return f"{found['salesperson']}|{found['order_lines'][0]['q']}"


@query("""SELECT p_partkey AS id, 'pre ' || p_name || '|<<<PAGE_BREAK_' || p_partkey || '>>>|body|<<<PAGE_BREAK_T2>>>|x' AS pages, p_name || '|' || p_partkey AS fields, 'one ' || p_name || ' two.|Three:|' || p_partkey || '|Four' AS joined,
  'a|b ' || p_name || '#On Monday X wrote:||old' AS wrote, 'l|l|l|l|l|l#' || p_name || '|From: a|To: b|Subject: c|x|y|z|z|z' AS heads, '{"a": {"b": ' || p_partkey || ', "c": 2}, "d": [2]}' AS merged, 'New ' || p_name || '||old' AS noted,
  CASE WHEN p_partkey % 2 = 0 THEN 'a|---|[[' || p_name || ']]|b' ELSE '[[' || p_name || ']]|b' END AS linked FROM part""")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page marks, assignments, joined fragments, mails cut at who wrote and at headers, nested settings, and notes with new sections and links."""
    n, name = _n().cast("string"), F.col("p_name")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    told = lambda f: (lambda c: F.replace(P.udf(f)(c), F.lit("\n"), F.lit("|")))
    pages = text("pre ", name, "\n", n, "\nUL 1598\nbody\nUL 1598\nT2\nx")
    code = text("self.salesperson='", name, "'\nself.company='b'\nself.customer='c'\nself.x_studio_customer_po_number='d'\nself.order_lines=[{'q': ", n, "}]\nother = 1")
    heads = text("l\n" * 6, name, "\nFrom: a\nTo: b\nSubject: c\nx\ny\nz\nz\nz")
    nested = text('{"a": {"b": ', n, '}, "d": [2]}')
    return table(spark, sf_dir, "part").select(
        _n().alias("id"), told(P.page_marks)(pages).alias("pages"), P.udf(_shown)(code).alias("fields"),
        told(lambda t: "|".join(K.rejoin(t.split("|"))))(text("one ", name, "| two.|Three:| ", n, "|Four")).alias("joined"),
        told(lambda t: "#".join(O.split_on_wrote(t)))(text("a\nb ", name, "\nOn Monday X wrote:\n\nold")).alias("wrote"), told(lambda t: "#".join(O.split_on_headers(t)))(heads).alias("heads"),
        P.udf(lambda t: json.dumps(S.merged({"a": {"b": 1, "c": 2}, "d": [1]}, json.loads(t))))(nested).alias("merged"),
        told(lambda t: S.prepend_section("\nold", t))(text("New ", name)).alias("noted"),
        told(lambda t: S.insert_link(*t.split("#")))(text(F.when(_n() % 2 == 0, "a\n---\nb").otherwise("b"), "#", name)).alias("linked"),
    )


@query("""SELECT p_partkey AS uid, '\\Seen,$label' || p_size AS flags, '0' || p_partkey % 9 + 1 || '-Jan-2024' AS internaldate, 'Entwürfe & ' || p_name AS folder, '{"a":"new ' || p_partkey || '","b":"old","c":"more"}' AS settings FROM part""")
def imap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of fetched mails, folder names in modified UTF-7, and settings laid over others."""
    n = _n().cast("string")
    day = F.concat(F.lit("0"), (_n() % 9 + 1).cast("string"), F.lit("-Jan-2024"))
    head = S.imap_header(F.concat(F.lit("* 7 FETCH (UID "), n, F.lit(" FLAGS (\\Seen $label"), F.col("p_size").cast("string"), F.lit(') INTERNALDATE "'), day, F.lit('" BODY[] {3}')))
    over = S.overlay(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("old")), F.create_map(F.lit("a"), F.concat(F.lit("new "), n), F.lit("c"), F.lit("more")))
    sorted_ = F.map_from_entries(F.array_sort(F.map_entries(over)))
    return table(spark, sf_dir, "part").select(
        head["uid"].alias("uid"), F.array_join(head["flags"], ",").alias("flags"), head["internaldate"].alias("internaldate"),
        P.udf(P.imap_decode)(F.concat(F.lit("Entw&APw-rfe &- "), "p_name")).alias("folder"), F.to_json(sorted_).alias("settings"),
    )


@query("""WITH s AS (SELECT p_partkey AS n, p_name, p_partkey % 5 AS k, repeat('ab', p_partkey % 14 + 1) || CASE WHEN p_partkey % 2 = 0 THEN '_P' ELSE '' END AS stem FROM part),
c AS (SELECT *, CASE WHEN n % 2 = 0 THEN stem[1:-3] ELSE stem END AS core FROM s)
SELECT n AS id, CASE k WHEN 0 THEN 'a・b' || p_name || '・c・ .x' WHEN 1 THEN 'con_' WHEN 2 THEN 'untitled' WHEN 3 THEN 'Full ' || p_name ELSE p_name || '・y' END AS named,
  CASE WHEN length(core) <= 20 THEN stem || '.txt' ELSE core[1:20] || '...' || CASE WHEN n % 2 = 0 THEN '_p' ELSE '' END || '.txt' END AS short, CASE WHEN n % 2 = 0 THEN '你' || n || '好' ELSE 'a ' || n || ' b' END AS subtitle FROM c""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable and shortened file names, and lines of subtitles."""
    n, k = _n().cast("string"), _n() % 5
    said = F.when(k == 0, F.concat(F.lit("a/b"), "p_name", F.lit(":c? .x. "))).when(k == 1, "con").when(k == 2, "...").when(k == 3, F.concat(F.lit("Ｆull\u3000"), "p_name", F.lit("\x07"))).otherwise(F.concat("p_name", F.lit("^y")))
    stem = F.concat(F.repeat(F.lit("ab"), (_n() % 14 + 1).cast("int")), F.when(_n() % 2 == 0, "_P").otherwise(""))
    line = F.when(_n() % 2 == 0, F.concat(F.lit("你 "), n, F.lit("　好"))).otherwise(F.concat(F.lit("  a \t"), n, F.lit("  b ")))
    return table(spark, sf_dir, "part").select(
        _n().alias("id"), P.udf(P.file_name)(said).alias("named"), T.short_name(F.concat(F.lit("/in/x.d/"), stem, F.lit(".txt"))).alias("short"), T.subtitle_line(line).alias("subtitle"),
    )


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 4 THEN p_name || chr(10) || 'Sent: alone' || chr(10) || 'kept' ELSE p_name END AS reply, 'a' || chr(10) || 'b ' || p_name AS bare, 'Body ' || p_name AS unframed,
  substr('x ' || p_name || chr(10) || 'y' || chr(10) || 'z', 1, 12) AS input FROM part""")
def reply_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies above what they quote, text without marks and frames, and normalised input."""
    rest = _pick(_n(), "> old\n> more", "On Monday X wrote:\nold", "-----Original Message-----\nold", "From: a\nTo: b\nold", "Sent: alone\nkept")
    return table(spark, sf_dir, "part").select(
        _n().alias("id"), T.reply_text(F.concat("p_name", F.lit("\n"), rest)).alias("reply"), T.unquote_all(F.concat(F.lit("> > a\r\n>b "), "p_name")).alias("bare"),
        T.strip_frame(F.concat(F.lit("Dear Bob,\n\nBody "), "p_name", F.lit("\n\nBest regards,\nAli")), "ali").alias("unframed"),
        T.normalize_input(F.concat(F.lit("\r\n  x "), "p_name", F.lit("\r\ny\rz \n")), 12).alias("input"),
    )


@query("""SELECT p_partkey AS id, 'A ' || p_name || '|f ' || p_partkey || '.md' AS links, p_partkey || ',' || p_name || ';c,' AS cells, 'one shared end of ' || p_name AS joined, 'one ' || p_name || chr(10) || 'two' || chr(10) AS xml FROM part""")
def markdown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and tables of notes, pieces that overlap, and the text of XML."""
    n = _n().cast("string")
    note = F.concat(F.lit("[[ A "), "p_name", F.lit("]] [t](f "), n, F.lit(".md) [[A "), "p_name", F.lit("]] [u](x.txt)"))
    grid = F.concat(F.lit("head\n|---|:-:|\n| "), n, F.lit(" | "), "p_name", F.lit(" | lost |\n|c|\nplain"))
    pieces = F.concat(F.lit("one shared end"), F.lit("\x01"), F.lit("shared end of "), "p_name")
    cells = P.udf(lambda t: ";".join(",".join(r) for r in P.markdown_rows(t, 2)))
    said = F.concat(F.lit("<tt><p>one "), "p_name", F.lit(" </p><p> two</p><p> </p></tt>"))
    return table(spark, sf_dir, "part").select(
        _n().alias("id"), F.array_join(T.markdown_links(note), "|").alias("links"), cells(grid).alias("cells"),
        P.udf(lambda t: P.merge_overlaps(t.split("\x01")))(pieces).alias("joined"), P.udf(P.xml_text)(said).alias("xml"),
    )


@query("""WITH e AS (SELECT event_id, value * 1000 AS mid, event_id % 4 AS k FROM events)
SELECT event_id, CASE WHEN k = 3 THEN 7.0 ELSE event_id::DOUBLE END AS n, CASE WHEN mid > 500 THEN round(1000.0 / (mid - 500), 5) END AS buy_size, CASE WHEN mid > 500 THEN mid + 500 END AS sell_price,
  CASE k WHEN 0 THEN mid <= 20500 OR mid >= 59500 WHEN 1 THEN mid <= 20500 WHEN 2 THEN mid >= 59500 ELSE true END AS near,
  event_id % 60 = 0 OR CASE k WHEN 0 THEN mid <= 20500 OR mid >= 59500 WHEN 1 THEN mid <= 20500 WHEN 2 THEN mid >= 59500 ELSE true END AS refresh, 5.0 * (1 + (event_id % 10) // 2) AS wait,
  CASE WHEN k = 1 AND mid - 20000 >= 1000 THEN floor(mid / 500 + 0.5) * 500 END AS anchor, floor(mid / 500 + 0.5) * 500 AS snapped,
  (event_id % 7)::VARCHAR || ',' || (event_id % 3) || ',0' AS coefficients FROM e""")
def grid_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of events as ticks of a grid: zones, refreshes, new pairs, waits and anchors; numbers and coefficients out of texts."""
    mid, n = F.col("value") * 1000, F.col("event_id")
    mode = _pick(n, G.PAIR, G.BUY_ONLY, G.SELL_ONLY, G.ABNORMAL)
    state = F.struct(mode.alias("mode"), F.lit(20000.0).alias("buy_price"), F.lit(60000.0).alias("sell_price"))
    pair = G.new_pair(mid, 1000.0)
    down = F.array((n % 3).cast("double"), (n % 7).cast("double"))
    return table(spark, sf_dir, "events").select(
        "event_id", N.number(F.when(n % 4 == 3, "n/a").otherwise(n.cast("string")), 7.0).alias("n"), pair[0]["size"].alias("buy_size"), pair[1]["price"].alias("sell_price"),
        G.in_zone(mid, state, 500.0).alias("near"), G.must_refresh(mid, n, state, 500.0).alias("refresh"), G.poll_interval(n % 10, 5.0).cast("double").alias("wait"),
        G.reanchor(mode, F.lit(20000.0), mid).alias("anchor"), G.anchor(mid).alias("snapped"),
        F.array_join(F.transform(N.reindexed(down, 3), lambda c: c.cast("int").cast("string")), ",").alias("coefficients"),
    )


@query("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 END AS stack_qty, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'to,' END || CASE WHEN p_partkey % 3 = 0 THEN 'cc,' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'bcc,' END AS problems,
  p_partkey % 4 IN (0, 1) AS taken, p_partkey % 3000 BETWEEN 1 AND 1799 AS soon, CASE WHEN p_partkey % 3 = 1 THEN repeat('r', 60) WHEN p_partkey % 3 = 0 THEN 'new' ELSE repeat('a', 50) END AS text,
  p_size / 0.8::DOUBLE AS target_lumen, p_size / (0.8::DOUBLE * 0.5) AS target_efficacy, format('{:,}', p_partkey * 1001) AS shown FROM part""")
def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks by a table, recipients, routes, expiry, recognised text, targets of a fixture and separators of thousands."""
    p = table(spark, sf_dir, "part").select(_n().alias("id"), "p_size", "p_name", (F.col("p_size") % 3).alias("thickness"), F.lit(0.3).alias("hole"))
    stacks = spark.createDataFrame([(0, 0.3, 0), (1, 0.3, 4), (2, 0.2, 9)], "thickness int, hole double, stack_qty int")
    n = F.col("id")
    to = F.when(n % 2 == 0, F.array(F.lit("R@x.y"))).otherwise(F.array(F.lit("r@x.y"), F.lit("z@x.y")))
    cc, bcc = F.when(n % 3 == 0, F.array(F.lit("c@x.y"))), F.when(n % 5 == 0, F.array(F.lit("a@x.y"))).otherwise(F.array().cast("array<string>"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    raw = F.when(n % 3 == 0, "").when(n % 3 == 1, F.repeat(F.lit("a"), F.lit(39))).otherwise(F.repeat(F.lit("a"), F.lit(50)))
    seen = F.when(n % 3 == 0, "new").otherwise(F.repeat(F.lit("r"), F.lit(60)))
    rows = Q.stack_quantity(p, stacks).withColumns({"lumen": F.col("p_size").cast("double"), "efficacy": F.col("p_size").cast("double"), "optical": F.lit(80.0), "power": F.lit(50.0)})
    rows = L.targets(rows, "lumen", "efficacy", "optical", "power")
    return rows.select(
        "id", "stack_qty", F.array_join(F.transform(M.recipient_problems(to, cc, bcc, "r@X.y", "A@x.y"), lambda x: F.concat(x, F.lit(","))), "").alias("problems"),
        S.route(_pick(n, "/in/a.PDF", "/in/b.txt", "/in/b_p.txt", "/in/c.bin"), (".pdf", ".txt"), ("_p.txt",)).alias("taken"),
        D.expires_soon(now, F.timestamp_seconds(F.unix_timestamp(now) + n % 3000)).alias("soon"), S.choose_ocr(raw, seen).alias("text"), "target_lumen", "target_efficacy", N.thousands(n * 1001).alias("shown"),
    )


@query("""WITH w AS (SELECT p_partkey AS id, p_partkey % 4 AS k, 'n' || p_partkey AS name, (p_partkey % 3)::VARCHAR AS folder FROM part)
SELECT 'link' AS kind, folder AS prefix, CASE k WHEN 0 THEN name WHEN 1 THEN upper(name) WHEN 2 THEN name || '.txt' ELSE name END AS target, CASE k WHEN 3 THEN NULL WHEN 2 THEN NULL ELSE name || '.md' END AS name FROM w
UNION ALL SELECT 'latest', p_brand, NULL, max(p_brand || '_' || (240101 + p_partkey % 20) || '.md') FROM part GROUP BY p_brand""")
def note_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links resolved to the notes of their folder, and the newest dated note of each name."""
    n, k = _n().cast("string"), _n() % 4
    name = F.concat(F.lit("n"), n)
    p = table(spark, sf_dir, "part").select((_n() % 3).cast("string").alias("folder"), name.alias("n"), k.alias("k"), "p_brand", _n())
    wanted = p.select("folder", F.when(k == 1, F.upper("n")).when(k == 2, F.concat("n", F.lit(".txt"))).otherwise(F.col("n")).alias("target"))
    files = p.where("k < 3").select("folder", F.concat("n", F.lit(".md")).alias("name"))
    dated = p.select(F.concat("p_brand", F.lit("_"), (240101 + _n() % 20).cast("string"), F.lit(".md")).alias("name"))
    links = O.resolve_links(wanted, files).select(F.lit("link").alias("kind"), F.col("folder").alias("prefix"), "target", "name")
    return links.unionByName(B.latest_dated(dated).select(F.lit("latest").alias("kind"), "prefix", F.lit(None).cast("string").alias("target"), "name"))


@query("""SELECT 'Bitcoin Up or Down ' || p_name || p_partkey AS title, 1704067200 + p_partkey AS end_ts, CASE WHEN p_partkey % 2 = 0 THEN 'u' ELSE 'd' END || p_partkey AS up_token, CASE WHEN p_partkey % 2 = 0 THEN 'd' ELSE 'u' END || p_partkey AS down_token, 'x' || p_partkey AS id,
  CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE (p_partkey // 3600) || ':' || lpad(((p_partkey // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((p_partkey % 60)::VARCHAR, 2, '0') END AS duration FROM part WHERE p_partkey BETWEEN 1 AND 1799 AND p_partkey % 5 > 0""")
def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market rounds that end within half an hour, and the entries of a channel."""
    n = _n().cast("string")
    market = F.struct(
        F.when(_n() % 5 > 0, F.concat(F.lit(" Bitcoin Up or Down "), "p_name", n)).otherwise("Other").alias("question"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("btc-15m-"), n).alias("slug"),
        F.concat(F.date_format(F.timestamp_seconds(_n() + 1704067200), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("endDate"), F.concat(F.lit('["d'), n, F.lit('","u'), n, F.lit('"]')).alias("clobTokenIds"),
        F.when(_n() % 2 == 0, '["Down","Up"]').alias("outcomes"),
    )
    p = table(spark, sf_dir, "part")
    events = p.groupBy((_n() % 10).alias("event")).agg(F.collect_list(market).alias("markets"))
    rounds = O.open_rounds(events, F.lit("2024-01-01 00:00:00").cast("timestamp"), "bitcoin up or down", "-15m-").withColumn("id", F.concat(F.lit("x"), (F.col("end_ts") - 1704067200).cast("string")))
    entries = p.select(F.concat(F.lit("x"), n).alias("id"), F.col("p_name").alias("title"), F.when(_n() % 3 > 0, _n()).alias("duration"))
    shown = O.channel(entries).select(F.substring_index("url", "=", -1).alias("id"), "duration")
    return rounds.join(shown, "id").select("title", F.col("end_ts").cast("long").alias("end_ts"), "up_token", "down_token", "id", "duration")


_CELLS = "WITH c AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '#' || p_partkey END AS label, 0.3 + p_size / 1000.0 AS x, 0.2 + (p_partkey % 50) / 1000.0 AS y FROM part WHERE p_partkey % 4 > 0)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.format_string("%.3f", 0.3 + F.col("p_size") / 1000.0), F.format_string("%.3f", 0.2 + (_n() % 50) / 1000.0)
    cell = F.when(_n() % 4 == 0, "-").otherwise(F.concat(F.lit("("), x, F.lit(" , "), y, F.lit(")")))
    rows = table(spark, sf_dir, "part").select("p_brand", _n().alias("pos"), F.when(_n() % 3 == 0, " ").otherwise(F.concat(F.lit("#"), _n().cast("string"))).alias("label"), cell.alias("cell"))
    return O.chromaticities(rows, "p_brand", "label", "cell")


@query(_CELLS + """ SELECT p_brand, CASE WHEN label <> '' THEN label ELSE 'row ' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) END AS label, round(x, 3)::DOUBLE AS x, round(y, 3)::DOUBLE AS y FROM c""")
def chromaticity_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir)


@query(_CELLS + """ SELECT p_brand, unnest(['min', 'max', 'average']) AS stat, round(unnest([min(x), max(x), avg(x)]), 6)::DOUBLE AS x, round(unnest([min(y), max(y), avg(y)]), 6)::DOUBLE AS y FROM c GROUP BY p_brand""")
def chromaticity_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.pair_statistics(_points(spark, sf_dir), "p_brand").select("p_brand", "stat", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(_CELLS + """ SELECT round(x, 4)::DOUBLE AS x, round(y, 4)::DOUBLE AS y, min(p_partkey) AS pos FROM c GROUP BY 1, 2 ORDER BY pos LIMIT 50""")
def distinct_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty points that differ, in order of place."""
    x, y = F.round(0.3 + F.col("p_size") / 1000.0, 4), F.round(0.2 + (_n() % 50) / 1000.0, 4)
    return O.distinct_points(table(spark, sf_dir, "part").where(_n() % 4 > 0).select(x.alias("x"), y.alias("y"), _n().alias("pos")))


@query("""WITH RECURSIVE px AS (SELECT (p_partkey % 40)::INT AS x, (p_partkey // 40)::INT AS y, CASE WHEN (p_partkey // 40) % 50 - 10 - (p_partkey % 40) // 2 IN (0, 1, 2) THEN 20 WHEN p_partkey % 40 % 13 = 0 THEN 60 WHEN p_size = 7 THEN 10 ELSE 240 + p_size % 10 END AS level FROM part),
size AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM px), raw AS (SELECT k, exp(-(k * k) / (2 * 4.1::DOUBLE * 4.1::DOUBLE)) AS e FROM range(-12, 13) t(k)), off AS (SELECT k, e / (SELECT sum(e) FROM raw) AS e FROM raw),
across AS (SELECT p.x, p.y, any_value(p.level) AS level, sum(e * q.level) AS v FROM px p, off, size JOIN px q ON q.y = p.y AND q.x = greatest(0, least(w - 1, p.x + k)) GROUP BY p.x, p.y),
mean AS (SELECT p.x, p.y, any_value(p.level) AS level, sum(e * q.v) AS v FROM across p, off, size JOIN across q ON q.x = p.x AND q.y = greatest(0, least(h - 1, p.y + k)) GROUP BY p.x, p.y),
dark AS (SELECT x, y, level - round_even(v, 0) <= -20 AS dark FROM mean),
runs AS (SELECT *, sum(CASE WHEN dark THEN 0 ELSE 1 END) OVER (PARTITION BY y ORDER BY x) AS ra, sum(CASE WHEN dark THEN 0 ELSE 1 END) OVER (PARTITION BY x ORDER BY y) AS rd FROM dark),
long AS (SELECT *, count(*) FILTER (dark) OVER (PARTITION BY y, ra) AS na, count(*) FILTER (dark) OVER (PARTITION BY x, rd) AS nd FROM runs),
f0 AS (SELECT x, y, dark, dark AND NOT (na >= greatest(w // 3, 1) OR nd >= greatest(h // 3, 1)) AS clean FROM long, size),
f1 AS (SELECT *, clean OR coalesce(lag(clean) OVER (PARTITION BY x ORDER BY y), false) OR coalesce(lag(clean) OVER (PARTITION BY y ORDER BY x), false) AS c1 FROM f0),
f2 AS (SELECT *, c1 AND coalesce(lag(c1) OVER (PARTITION BY x ORDER BY y), true) AND coalesce(lag(c1) OVER (PARTITION BY y ORDER BY x), true) AS c2 FROM f1),
f3 AS (SELECT *, c2 AND coalesce(lag(c2) OVER (PARTITION BY x ORDER BY y), true) AND coalesce(lag(c2) OVER (PARTITION BY y ORDER BY x), true) AS c3 FROM f2),
f4 AS (SELECT *, c3 OR coalesce(lag(c3) OVER (PARTITION BY x ORDER BY y), false) OR coalesce(lag(c3) OVER (PARTITION BY y ORDER BY x), false) AS healed FROM f3),
dots AS (SELECT x, y, y * 40 + x AS id FROM f4 WHERE healed), near AS (SELECT a.id AS a, b.id AS b FROM dots a JOIN dots b ON abs(a.x - b.x) <= 1 AND b.y BETWEEN a.y - 1 AND a.y + 1),
reach(a, b) AS (SELECT id, id FROM dots UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
parts AS (SELECT a AS id, min(b) AS part FROM reach GROUP BY a), best AS (SELECT part FROM parts GROUP BY part ORDER BY count(*) DESC, part LIMIT 1)
SELECT x, y, dark, clean, healed, healed AND y * 40 + x IN (SELECT id FROM parts JOIN best USING (part)) AS mask FROM f4""")
def plot_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the pixels of one picture, forty a line: a curve every fifty lines, some lines of a grid, and dots."""
    x, y = (_n() % 40).cast("int"), F.floor(_n() / 40).cast("int")
    curve = (y % 50 - 10 - F.floor(x / 2)).isin(0, 1, 2)
    level = F.when(curve, 20).when(x % 13 == 0, 60).when(F.col("p_size") == 7, 10).otherwise(240 + F.col("p_size") % 10)
    made = X.plot_mask(table(spark, sf_dir, "part").select(F.lit("parts").alias("image"), x.alias("x"), y.alias("y"), level.alias("level")))
    return made.select("x", "y", "dark", "clean", "healed", "mask")


@query("""WITH b AS (SELECT doc_id, n_chars AS n FROM documents WHERE n_chars > 0), e AS (SELECT doc_id, unnest(range(0, n, 500)) AS o, n FROM b)
SELECT doc_id, count(*)::BIGINT AS enhanced_blocks, max(least(500, n - o))::INTEGER AS enhanced_longest, any_value(n)::INTEGER AS baseline_longest, (any_value(n) >= 1000)::INTEGER::BIGINT AS baseline_large, count(*)::DOUBLE AS split_gain FROM e GROUP BY doc_id""")
def split_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one block each against blocks of 500 characters."""
    d = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", "text", F.lit("body").alias("part"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / 500)), lambda i: F.substring("text", (i * 500 + 1).cast("int"), F.lit(500)))
    out = M.split_gain(d, d.withColumn("text", F.explode(cut)))
    return out.select("doc_id", "enhanced_blocks", "enhanced_longest", "baseline_longest", "baseline_large", F.col("split_gain").cast("double").alias("split_gain"))


@query("""SELECT o_orderkey AS uid, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN repeat('e', 500) END AS error FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'old', 'kept' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 = 0""")
def ledger_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of every fifth order takes the results of every second, of which there are two each."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    ledger = o.where(n % 5 == 0).select(n.alias("uid"), F.lit("old").alias("status"), F.lit("kept").alias("error"))
    last = o.where(n % 2 == 0).select(n.alias("uid"), F.when(n % 3 == 0, "failed").otherwise("success").alias("status"), F.when(n % 3 == 0, F.repeat(F.lit("e"), F.lit(600))).alias("error"), F.lit(2).alias("at"))
    both = last.unionByName(last.withColumns({"status": F.lit("zero"), "error": F.lit("first"), "at": F.lit(1)}))
    return S.record(ledger, both, "uid", "at").select("uid", "status", "error")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN y ELSE x END AS x, CASE WHEN p_partkey % 2 = 0 THEN x ELSE y END AS y FROM (SELECT p_partkey, round(2 + p_size / 99.0 * 8, 6)::DOUBLE AS x, round(7 - (p_partkey % 30) / 49.0 * 6, 6)::DOUBLE AS y FROM part)""")
def axis_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels on the units of axes, every other one with the axes swapped."""
    axes = {"x_min": 2.0, "x_max": 10.0, "y_min": 1.0, "y_max": 7.0}
    to = lambda swap: C.to_units(F.col("p_size").cast("double"), (_n() % 30).cast("double"), F.lit(100.0), F.lit(50.0), axes, swap)
    (x, y), (u, v) = to(False), to(True)
    pick = lambda a, b: F.round(F.when(_n() % 2 == 0, b).otherwise(a), 6)
    return table(spark, sf_dir, "part").select(_n().alias("id"), pick(x, u).alias("x"), pick(y, v).alias("y"))


@query("""WITH RECURSIVE o AS (SELECT user_id::VARCHAR AS account, event_id AS seq, event_id % 4 AS kind, 60000.0::DOUBLE + 500 * (user_id % 5) AS mid, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r(account, i, seq, kind, buy, sell, action, price) AS (
  SELECT DISTINCT account, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, '', NULL::DOUBLE FROM o
  UNION ALL
  SELECT account, i, seq, CASE action WHEN 'rebuild' THEN 3 WHEN 'abnormal' THEN NULL WHEN 'start' THEN nullif(live, 0) ELSE kind END,
    CASE action WHEN 'rebuild' THEN price - 500 WHEN 'start' THEN live_buy WHEN 'keep' THEN buy END, CASE action WHEN 'rebuild' THEN price + 500 WHEN 'start' THEN live_sell WHEN 'keep' THEN sell END, action, price
  FROM (SELECT *, CASE WHEN kind IS NULL THEN 'start' WHEN price IS NOT NULL THEN 'rebuild' WHEN kind = live AND (kind < 3 OR (buy = live_buy AND sell = live_sell)) THEN 'keep' ELSE 'abnormal' END AS action
    FROM (SELECT o.account, o.i, o.seq, o.kind AS live, r.kind, r.buy, r.sell, CASE WHEN o.kind IN (1, 3) THEN mid - 500 END AS live_buy, CASE WHEN o.kind IN (2, 3) THEN mid + 500 END AS live_sell,
      CASE WHEN r.kind = 3 AND o.kind = 2 THEN r.buy WHEN r.kind = 3 AND o.kind = 1 THEN r.sell WHEN r.kind = 1 AND o.kind = 0 THEN r.buy WHEN r.kind = 2 AND o.kind = 0 THEN r.sell END AS price
      FROM r JOIN o ON o.account = r.account AND o.i = r.i + 1))
)
SELECT account, seq, action, price AS rebuild_price FROM r WHERE i > 0""")
def grid_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account's snapshots in order through the state machine of the grid."""
    return G.decisions(_stateful(spark, snapshots(spark, sf_dir)))


@query("""SELECT conv_id::VARCHAR AS thread_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS version, md5(text) AS draft_md5 FROM conversations WHERE conv_id IS NOT NULL""")
def review_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as review threads through the stateful reviewer: each turn is the next version's draft."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null").select(F.col("conv_id").cast("string").alias("thread_id"), F.col("turn").alias("seq"), "text")
    return V.reviews(_stateful(spark, turns)).select("thread_id", "seq", "version", F.md5("draft").alias("draft_md5"))


#: The objective of the invented catalogue is quadratic in the current, so SQL has its root by formula.
_ROOTS = """WITH c AS (SELECT p_partkey AS id, p_retailprice / 1000 AS rmb, 330.0::DOUBLE * (1.01 - 0.0004 * 65) AS e, (100 + p_size)::DOUBLE * (1 - 0.001 * 65) AS p FROM part),
q AS (SELECT *, e * 0.0000012 + p * 0.000004 AS qa, e * 0.0026 - p * 0.0098 AS qb, -p * 0.02 AS qc FROM c), r AS (SELECT *, (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS x FROM q),
s AS (SELECT *, ceil(20000 / (p * (0.02 + 0.0098 * x - 0.000004 * x * x)))::INTEGER AS n, (2.6 + 0.0012 * x) * (1.01 - 0.0004 * 65) AS vf FROM r) """


def _solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.solve(catalogue(spark, sf_dir), 330.0, 20000.0, 65.0)


@query(_ROOTS + "SELECT id, round(x, 1) AS target_if, true AS converged, n AS led_count, round(vf * x / 1000, 4) AS power FROM s")
def newton_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operating points inside the range of the currents."""
    return _solved(spark, sf_dir).select("id", F.round("target_if", 1).alias("target_if"), "converged", "led_count", F.round("power", 4).alias("power"))


@query(_ROOTS + """, t AS (SELECT *, floor(50 / vf)::INTEGER AS s_max FROM s), w AS (SELECT *, ceil(n / s_max)::INTEGER AS p_, (ceil(n / s_max) * ceil(n / ceil(n / s_max)))::INTEGER AS total FROM t)
SELECT id, n AS led_count, total AS total_leds, round(total * rmb + total * 0.05::DOUBLE, 4) AS cost_rmb, round((total * rmb + total * 0.05::DOUBLE) / 7.2::DOUBLE, 6) AS cost_usd FROM w WHERE n > 0""")
def wired_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The costs of the first way to wire each operating point, ranked."""
    ranked = L.rank(_solved(spark, sf_dir), 50.0, 0.05, 7.2)
    return ranked.select("id", "led_count", F.col("solutions")[0]["total_leds"].alias("total_leds"), F.round("cost.total_cost_rmb", 4).alias("cost_rmb"), F.round("cost.total_cost_usd", 6).alias("cost_usd"))


@query(_ROOTS + """, w AS (SELECT *, ceil(n / floor(50 / vf))::INTEGER AS p_min FROM s WHERE n > 0), y AS (SELECT *, unnest(range(p_min, greatest(p_min, least(n, p_min + 4)) + 1))::INTEGER AS ways FROM w)
SELECT id, (ways - p_min + 1)::INTEGER AS way, ways AS "P", ceil(n / ways)::INTEGER AS "S", (ways * ceil(n / ways))::INTEGER AS total_leds, round(ceil(n / ways) * vf * x * ways / 1000) AS power_watts,
  round((ways * ceil(n / ways) * rmb + ways * ceil(n / ways) * 0.05::DOUBLE) / 7.2::DOUBLE, 6) AS total_cost_usd FROM y""")
def presented_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way to wire each operating point, as it is shown."""
    shown = L.presented(L.rank(_solved(spark, sf_dir), 50.0, 0.05, 7.2), 0.85, 120.0, 0.05, 7.2)
    return shown.select("id", "way", "P", "S", "total_leds", F.round("power_watts").alias("power_watts"), F.round("total_cost_usd", 6).alias("total_cost_usd"))
