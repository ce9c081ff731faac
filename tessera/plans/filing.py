"""Queries over notes, pages, sheets, mails and answers that are made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import text as T
from tessera.operators import chunking as C
from tessera.operators import layout as L
from tessera.operators import mail as M
from tessera.operators import notes as N
from tessera.operators import tables as B
from tessera.plans.registry import Registry
from tessera.session import table
from tessera.sources import files as S
from tessera.streaming import grid as G

query = Registry()


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of a source as a note that links to the next two numbers, of which the source may have none."""
    d = table(spark, sf_dir, "documents")
    link = lambda k: F.concat(F.lit("[[n"), (F.col("doc_id") + k).cast("string"), F.lit("]]"))
    body = F.concat(F.lit("head\n"), link(20), F.lit("\n\n"), link(1), F.lit("\nend "), link(40))
    return d.select(F.col("source").alias("folder"), F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), body.alias("content"))


_LINKED = """WITH l AS (SELECT source AS folder, 'n' || doc_id || '.md' AS name, unnest([20, 1, 40]) AS k, doc_id FROM documents),
t AS (SELECT folder, name, k, 'n' || (doc_id + k) AS target FROM l), h AS (SELECT source AS folder, 'n' || doc_id AS target FROM documents)
"""


@query(_LINKED + "SELECT folder, name, target FROM t WHERE (folder, target) NOT IN (SELECT folder, target FROM h)")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.broken(_notes(spark, sf_dir)).select("folder", "name", "target")


@query(_LINKED + """, b AS (SELECT folder, name, max(CASE WHEN k = 20 AND h.target IS NULL THEN 1 ELSE 0 END) AS b20, max(CASE WHEN k = 1 AND h.target IS NULL THEN 1 ELSE 0 END) AS b1,
  max(CASE WHEN k = 40 AND h.target IS NULL THEN 1 ELSE 0 END) AS b40, any_value(t.target) FILTER (k = 20) AS t20, any_value(t.target) FILTER (k = 1) AS t1, any_value(t.target) FILTER (k = 40) AS t40
  FROM t LEFT JOIN h USING (folder, target) GROUP BY folder, name)
SELECT folder, name, b20 + b1 + b40 AS n_broken, md5('head' || chr(10) || CASE WHEN b20 = 0 THEN '[[' || t20 || ']]' || chr(10) ELSE '' END || CASE WHEN b20 = 0 AND b1 = 0 THEN chr(10) ELSE '' END
  || CASE WHEN b1 = 0 THEN '[[' || t1 || ']]' || chr(10) ELSE '' END || 'end ' || CASE WHEN b40 = 0 THEN '[[' || t40 || ']]' ELSE '' END) AS content_md5 FROM b""")
def clean_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.without_broken(_notes(spark, sf_dir)).select("folder", "name", F.col("n_broken").cast("int").alias("n_broken"), F.md5("content").alias("content_md5"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, lpad((pos // 3)::VARCHAR, 4, '0') AS page_label, (pos // 3)::INT AS page_num, md5(string_agg(trim(line), ' ' ORDER BY pos)) AS text_md5
FROM l WHERE regexp_matches(line, '\\S') GROUP BY doc_id, pos // 3""")
def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three lines of a document as a page with a mark before it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = d.select("doc_id", (F.col("pos") * 2 + 1).alias("pos"), "line")
    marks = d.where("pos % 3 = 0").select("doc_id", (F.col("pos") * 2).alias("pos"), F.format_string("<<<PAGE_BREAK_%d>>>", (F.col("pos") / 3).cast("int")).alias("line"))
    return C.split_pages(lines.unionByName(marks)).select("doc_id", "page_label", "page_num", F.md5("text").alias("text_md5"))


@query("""WITH c AS (SELECT p_type || p_size % 7 AS file, p_brand AS sheet, p_size AS row, string_agg(p_name, chr(9) ORDER BY p_partkey) AS line FROM part GROUP BY 1, 2, 3),
s AS (SELECT file, sheet, '=== Sheet: ' || sheet || ' ===' || chr(10) || string_agg(line, chr(10) ORDER BY row) AS part FROM c GROUP BY 1, 2)
SELECT file, md5(string_agg(part, chr(10) ORDER BY sheet)) AS text_md5 FROM s GROUP BY file""")
def sheet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").select(F.concat("p_type", (F.col("p_size") % 7).cast("string")).alias("file"), F.col("p_brand").alias("sheet"), F.col("p_size").alias("row"), F.col("p_partkey").alias("col"), F.col("p_name").alias("value"))
    return S.sheet_text(cells).select("file", F.md5("text").alias("text_md5"))


@query("""SELECT user_id AS page, md5(string_agg(event_type, chr(10) ORDER BY round(value, 1), event_id)) AS text_md5 FROM events GROUP BY user_id""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("x"), F.col("value").alias("y"), F.col("event_type").alias("text"))
    return S.reading_order(spans).select("page", F.md5("text").alias("text_md5"))


@query("""SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'empty|' WHEN length(trim(text)) < 50 THEN 'short|' ELSE '' END || CASE WHEN lang <> 'en' AND length(trim(coalesce(text, ''))) < 100 THEN 'suspect|' ELSE '' END AS reasons FROM documents""")
def ocr_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    why = F.transform(S.ocr_reasons(F.col("text"), F.col("lang") != "en"), lambda r: F.concat(r, F.lit("|")))
    return d.select("doc_id", F.array_join(why, "").alias("reasons"))


@query("SELECT event_id, strftime(ts, '%d %b %Y %H:%M:%S') AS date FROM events")
def mail_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0800 (HKT)"))
    return table(spark, sf_dir, "events").select("event_id", D.mail_date(said).alias("date"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'insufficient_spot_balance' ELSE 'error' END AS said FROM events""")
def order_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in ('[{"resting":{"oid":1}}]', '[{"error":"Insufficient spot balance"}]', "[]", '[{"error":"other"}]')]), (F.col("event_id") % 4 + 1).cast("int"))
    result = F.concat(F.lit('{"response":{"data":{"statuses":'), status, F.lit("}}}"))
    return table(spark, sf_dir, "events").select("event_id", G.response(result).alias("said"))


@query("""SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS key, p_size::DOUBLE AS quantity FROM part""")
def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.match_key(F.col("p_name")).alias("key"), T.quantity(F.concat(F.lit("about "), "p_size", F.lit(",000 pcs"))).alias("quantity"))


@query("""SELECT conv_id, turn, source || ' [ALI:v' || (turn + 1) || ']' AS subject FROM (SELECT conv_id, turn, 'offer ' || role AS source FROM conversations)""")
def subject_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("Re: RE:  offer  "), "role", F.lit(" [ALI:v"), F.col("turn").cast("string"), F.lit("]"))
    return c.select("conv_id", "turn", T.versioned_subject(said, F.col("turn") + 1, "ALI").alias("subject"))


@query("""SELECT c_custkey, c_name, c_mktsegment = 'BUILDING' AND c_custkey % 3 <> 0 AS allowed FROM customer""")
def allowed_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    sender = F.concat(F.lit("A@"), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, ".net").otherwise(".COM"))
    return c.select("c_custkey", "c_name", M.allowed(sender, ("@building.com",)).alias("allowed"))


@query("""WITH n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_quantity, l_extendedprice) AS i FROM lineitem)
SELECT a.l_orderkey AS k, count(*) AS pairs FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND a.i < b.i
AND a.l_quantity < b.l_quantity + 5 AND b.l_quantity < a.l_quantity + 5 AND a.l_linenumber < b.l_linenumber + 2 AND b.l_linenumber < a.l_linenumber + 2 GROUP BY 1""")
def overlapping_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.numbered(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"], "i")
    x, y = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    rects = rows.select(F.col("l_orderkey").alias("k"), "i", x.alias("x0"), (x + 5).alias("x1"), y.alias("y0"), (y + 2).alias("y1"))
    return L.overlapping(rects, "k").groupBy("k").agg(F.count("*").alias("pairs"))


@query("""WITH s AS (SELECT source, count(*) AS mails, sum(length(text)) AS chunks FROM documents GROUP BY 1)
SELECT round(sum(mails) / sum(mails * 0.5), 8)::DOUBLE AS mails_per_second, round(sum(chunks) / sum(mails * 0.5), 8)::DOUBLE AS chunks_per_second, round(avg(mails), 8)::DOUBLE AS mean_memory_mb FROM s""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("mails"), F.sum(F.length("text")).alias("chunks"))
    out = N.throughput(d.withColumn("seconds", F.col("mails") * 0.5).withColumn("memory_mb", F.col("mails").cast("double")))
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


@query()
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown in which each third line is a heading."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("# "), x)).otherwise(x))
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(line, "\n").alias("text"))
    return d.select("doc_id", F.posexplode(C.split_udf(C.markdown_sections)(F.col("text"))).alias("i", "section"))


@query("""SELECT vec_id, label, md5(array_to_string(list_transform(embedding, lambda x: format('{:.4f}', x)), ',')) AS digest FROM embeddings""")
def vector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector, with all of its components."""
    whole = F.array_join(F.transform("embedding", lambda x: F.format_string("%.4f", x.cast("double"))), ",")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.md5(whole).alias("digest"))
