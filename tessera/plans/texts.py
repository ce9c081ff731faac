"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fidelity as P
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import chunking as C
from tessera.operators import mail as M
from tessera.operators import notes as N
from tessera.operators import tables as B
from tessera.session import table
from tessera.plans.registry import Registry

query = Registry()


_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"
_STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(rf"SELECT doc_id, length({_STRIP}) AS char, {_WORDS} AS word FROM documents")
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.char_count(F.col("text")).alias("char"), T.word_count(F.col("text")).alias("word"))


@query(rf"SELECT doc_id, {_WORDS} AS word FROM documents WHERE {_WORDS} > 10")
def min_words_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("word"))
    return d.where(F.col("word") > C.DROP_WORDS)


@query(r"""WITH f AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents), w AS (SELECT *, regexp_extract_all(lower(flat), '[a-z]+(?:''[a-z]+)?') AS words FROM f)
SELECT doc_id, flat = '' OR regexp_full_match(flat, '(?i)(?:hi|hello|hey)[!. ,]*|(?:ok|okay|k|noted|received|got it|roger|ack)[!. ,]*|(?:thanks|thank you|thx|ty|many thanks)[!. ,]*|(?:best regards|kind regards|regards|br|cheers|sincerely)[!. ,]*|sent from my .+|--+')
  OR (len(words) > 0 AND len(list_filter(words, lambda x: NOT list_contains(string_split('""" + " ".join(T.STOPWORDS) + r"""', ' '), x))) = 0) OR regexp_full_match(flat, '[\d\pP\pS\pZ_ ]+') AS low_information,
  length(text) >= 100 AND len(regexp_extract_all(text, '[a-zA-Z]{2,}')) >= 5 AS quality FROM w""")
def low_info_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", T.is_low_information(F.col("text")).alias("low_information"), T.passes_chunk_quality(F.col("text")).alias("quality"))


@query(r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '\S+'), lambda w: contains(trim(w, '.,;:!?()[]<>"'''), '@') AND contains(lower(trim(w, '.,;:!?()[]<>"''')), 'com'))) AS masked FROM documents""")
def mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that disappear behind the mask, by document."""
    d = _docs(spark, sf_dir)
    gone = T.word_count(F.col("text")) - T.word_count(T.mask_mail(F.col("text")))
    return d.select("doc_id", gone.cast("long").alias("masked"))


@query(r"SELECT page_id, regexp_replace('see ' || url || ' now', 'https?://\S+', ' ', 'gi') AS text FROM pages")
def strip_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("see "), F.col("url"), F.lit(" now"))
    return table(spark, sf_dir, "pages").select("page_id", T.strip_urls(said).alias("text"))


@query()
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", P.sanitized(F.col("text")).alias("text"))


@query()
def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = C.chunk(_docs(spark, sf_dir).select("doc_id", "text"))
    return tagged.select("doc_id", "chunk_index", "chunk_total", "char", "word", "status", F.md5("text").alias("text_md5"))


@query(rf"""WITH w AS (SELECT doc_id, {_WORDS} AS n FROM documents WHERE length({_STRIP}) > 0)
SELECT count(*) FILTER (n <= 10) AS dropped, count(*) FILTER (n > 10 AND n <= 500) AS kept, count(*) FILTER (n > 500) AS split FROM w""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_statistics(C.chunk(_docs(spark, sf_dir).select("doc_id", "text"))).select("dropped", "kept", "split")


_PIECES = """WITH c AS (SELECT doc_id, text, length(text) AS n, greatest(1, ceil(length(text) / 2000.0))::INT AS k FROM documents),
p AS (SELECT *, (n // k)::INT AS each, unnest(range(0, k))::INT AS i FROM c)
"""


@query(_PIECES + "SELECT doc_id, i + 1 AS chunk_index, k AS chunk_total, md5(substr(text, i * each + 1, CASE WHEN i = k - 1 THEN n ELSE each + 20 END)) AS piece FROM p")
def overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("c", C.overlap_chunks(F.col("text"))).withColumn("chunk_total", F.size("c"))
    d = d.select("doc_id", "chunk_total", F.posexplode("c").alias("i", "piece"))
    return d.select("doc_id", (F.col("i") + 1).alias("chunk_index"), "chunk_total", F.md5("piece").alias("piece"))


@query(r"""WITH p AS (SELECT doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / 800.0))::INT)) AS i FROM documents),
s AS (SELECT doc_id, i, regexp_replace(substr(text, i * 800 + 1, 800), '^\s+|\s+$', '', 'g') AS piece FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS chunk_index, md5(piece) AS piece FROM s WHERE piece <> ''""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(C.fixed_chunks(F.col("text"), 800)).alias("i", "piece"))
    return d.select("doc_id", (F.col("i") + 1).alias("chunk_index"), F.md5("piece").alias("piece"))


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = C.split_udf(C.recursive_split)(F.col("text"))
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(parts).alias("i", "piece"))
    return d.select("doc_id", "i", F.md5("piece").alias("piece"))


@query()
def mail_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken for mails: their lines through the whole chunk generator."""
    return C.chunk_lines(_lines(spark, sf_dir)).select("doc_id", "chunk", F.md5("text").alias("text_md5"))


_LINES = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(_LINES + r"SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM l WHERE regexp_matches(line, '\S')")
def seq_in_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _lines(spark, sf_dir).where(~T.is_blank(F.col("line")))
    return B.numbered(kept, "doc_id", ["pos"]).select("doc_id", "pos", "seq")


@query(_LINES + r"""SELECT doc_id, count(*) AS n_blocks, sum(length(regexp_replace(line, '^\s+|\s+$', '', 'g')))::BIGINT AS char, arg_max(format('{}_b{:02d}', doc_id, seq), seq) AS last_id
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM l WHERE regexp_matches(line, '\S')) GROUP BY doc_id""")
def canonical_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last id is that of the greatest number, however many blocks a document has."""
    rows = M.canonical(_lines(spark, sf_dir), order="pos", text="line")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum("char").alias("char"), F.max_by("block_id", "seq").alias("last_id"))


@query(_LINES + """SELECT doc_id, pos, count(*) FILTER (contains(line, '|')) OVER (PARTITION BY doc_id ORDER BY pos) AS depth FROM l""")
def running_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.running_count(_lines(spark, sf_dir), "doc_id", "pos", F.contains("line", F.lit("|"))).select("doc_id", "pos", "depth")


@query("""WITH t AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
SELECT conv_id, run::BIGINT AS run, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY conv_id, run, role""")
def role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.runs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id")
def group_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.grouped_in_order(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text")
    return rows.select("conv_id", F.md5("text").alias("text_md5"), "n")


@query("""SELECT conv_id, turn // 2 AS version, text FROM (SELECT *, row_number() OVER () AS place FROM conversations)
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2 DESC, place) = 1""")
def argmax_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns make a version; of the last version's, the first row of the file counts."""
    c = B.with_file_order(table(spark, sf_dir, "conversations")).withColumn("version", F.floor(F.col("turn") / 2))
    return B.latest(c, "conv_id", "version", "text", "place")


@query(r"""WITH b AS (SELECT conv_id, turn, coalesce(lead(turn) OVER w, -1) AS following, md5(text) AS said, role, lag(turn) OVER w AS before FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS clause, CASE WHEN turn % 2 = 0 THEN turn ELSE NULL END AS here, CASE WHEN following % 2 = 0 THEN following END AS afterwards FROM b)
SELECT conv_id AS doc_id, clause::INTEGER AS clause, turn || '.1' AS location, role AS heading,
  'PART ' || coalesce(afterwards, last_value(here IGNORE NULLS) OVER w) AS part, NULL::VARCHAR AS supplement, CASE WHEN turn >= 3 OR following = 3 THEN 'B' END AS appendix,
  (turn + 1)::INTEGER AS page_start, (CASE WHEN following >= 0 THEN following + 1 ELSE turn + 1 END)::INTEGER AS page_end,
  md5(turn || '.1 ' || role || chr(10) || 'b' || said || chr(10) || chr(10) || 'end') AS text_md5
FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def clause_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as parsed standards: a page and a clause a turn, a part every other turn, an appendix from the fourth on."""
    n = F.col("turn").cast("string")
    said = F.concat(
        F.lit("<PARSED TEXT FOR PAGE: "), (F.col("turn") + 1).cast("string"), F.lit(" / 9>\n"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("PART "), n, F.lit("\n"))).otherwise(""),
        F.when(F.col("turn") == 3, "Appendix B of it\n").otherwise(""), n, F.lit(".1 "), "role", F.lit("\n1.1 Contents .12\nb"), F.md5("text"), F.lit("\n\nNo Text on This Page\nend"),
    )
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null and text is not null").withColumn("line", said)
    docs = B.grouped_in_order(rows, "conv_id", ["turn"], "line").select(F.col("conv_id").alias("doc_id"), F.col("line").alias("text"))
    return N.split_clauses(docs).select("*", F.md5("text").alias("text_md5")).drop("text")


@query("""SELECT page_id, md5('Answer ' || page_id || chr(10) || 'old &' || chr(10) || 'older' || chr(10) || 'back') AS level_md5, md5('Answer ' || page_id || chr(10) || '> old &' || chr(10) || '>> older' || chr(10) || 'back') AS deep_md5,
  true AS quotes FROM pages""")
def flattened_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages answered in a mail that quotes by nested block elements, flattened without and with depth."""
    body = F.concat(
        F.lit("<div><p>Answer <b>"), F.col("page_id").cast("string"), F.lit("</b></p></div><br><br/><div>"), F.lit("<blockquote type='cite'>old &amp; &lt;"), F.col("page_id").cast("string"),
        F.lit("&gt;<blockquote><p>older</p></blockquote></blockquote> back</div><div></div><p></p>"),
    )
    flat = lambda deep: F.md5(P.flatten_quotes(body, deep))
    return table(spark, sf_dir, "pages").select("page_id", flat(False).alias("level_md5"), flat(True).alias("deep_md5"), P.needs_quotes(body).alias("quotes"))


@query(r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#]+)["'']', 1)) AS link FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(U.hrefs(F.col("html"))).alias("link"))


@query(r"""WITH h AS (SELECT page_id, split_part(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), ':', 1) AS host FROM pages)
SELECT page_id, host, CASE WHEN host = 'youtube.com' OR ends_with(host, '.youtube.com') THEN 'youtube' ELSE '' END AS platform FROM h""")
def url_host_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"), U.platform(F.col("url")).alias("platform"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND split_part(lower(x), '=', 1) NOT IN ('fbclid', 'feature', 'pp', 'si', 't', 'xmt')) AS kept FROM p)
SELECT page_id, base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM k""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.clean(F.col("url")).alias("url"))


@query(r"""WITH c AS (SELECT page_id, regexp_split_to_array(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '<x>', 'g'), '<[^>]*>') AS nodes FROM pages),
n AS (SELECT page_id, unnest(nodes) AS node, generate_subscripts(nodes, 1) AS i FROM c),
t AS (SELECT page_id, i, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(node, '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS t FROM n)
SELECT page_id, md5(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '')) AS text_md5 FROM t GROUP BY page_id""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(P.udf(P.html_text)(F.col("html"))).alias("text_md5"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS n_en, 100.0 * count(*) / sum(count(*)) OVER () AS percent FROM documents GROUP BY source""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    counts = d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"))
    return B.shares(counts, "n").select("source", "n", "n_en", "percent")


@query("SELECT doc_id, sha1(text) AS digest, md5(text) AS short_digest FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha1("text").alias("digest"), F.md5("text").alias("short_digest"))


@query()
def route_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in any script; SQL has no word borders for them, so a test compares with plain Python."""
    return _docs(spark, sf_dir).select("doc_id", T.route(F.col("source"), F.col("text"), "rita").alias("route"))


@query(r"""SELECT conv_id, row_number() OVER w AS page, CASE WHEN sum((turn > 0)::INT) OVER w = 0 THEN 'body' ELSE 'quote' END AS part, (sum((turn > 0)::INT) OVER w)::INTEGER AS depth,
  regexp_replace(CASE WHEN turn > 0 THEN 'On a day someone wrote:' || chr(10) ELSE '' END || text, '^\s+|\s+$', '', 'g') AS text FROM conversations WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def quote_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as one mail each, in which turns answer each other, as blocks of one depth."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.concat(F.when(F.col("turn") > 0, F.lit("On a day someone wrote:\n")).otherwise(""), "text"))
    mails = B.grouped_in_order(turns, "conv_id", ["turn"], "text").withColumnRenamed("text", "body")
    return M.blocks(M.quote_lines(M.lines(mails, "conv_id"), "conv_id"), "conv_id")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS n_latin, regexp_matches(text, '[一-龥]') AS chinese FROM documents""")
def script_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.regexp_count("text", F.lit("[A-Za-z]+")).alias("n_latin"), T.has_chinese(F.col("text")).alias("chinese"))


@query("SELECT doc_id, md5(substr(body, 1, 200)) AS task_md5 FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '  ' WHEN doc_id % 4 = 0 THEN chr(10) || ' ' || text ELSE text END AS body FROM documents) WHERE regexp_matches(body, '\\S')")
def body_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of documents, some blank and some with white space before them, which stays."""
    body = F.when(F.col("doc_id") % 9 == 0, "  ").when(F.col("doc_id") % 4 == 0, F.concat(F.lit("\n "), "text")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", T.task_text(body, 200).alias("task")).where("task is not null").select("doc_id", F.md5("task").alias("task_md5"))


@query("""SELECT conv_id, md5(coalesce(chr(10) || rtrim(string_agg(text, chr(10) ORDER BY turn, text) FILTER (turn % 3 <> 1 AND text <> ''), ' ' || chr(10) || chr(9) || chr(13)), '')) AS text_md5 FROM conversations
WHERE conv_id IS NOT NULL GROUP BY conv_id""")
def payload_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as a JSON list of text objects, some of them empty and some in a think block, read back as lines."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null")
    said = lambda x: F.when(x["turn"] % 3 == 1, "").otherwise(x["text"])
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(said(x).alias("text")))
    listed = F.concat(F.array(F.struct(F.lit("  <think>first <think>this</think>").alias("text"))), F.array(F.struct(F.lit("then</think>").alias("text"))), listed)
    return c.groupBy("conv_id").agg(F.to_json(listed).alias("payload")).select("conv_id", F.md5(T.payload_text(F.col("payload"))).alias("text_md5"))


@query("SELECT conv_id, turn, turn % 2 = 1 AS review, role = 'user' AS defines FROM conversations")
def thread_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd turns bear the marker of a review thread; those of users define a class."""
    subject = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Re: x [ALI:v"), F.col("turn").cast("string"), F.lit("]"))).otherwise("Re: [ALI:v]")
    content = F.concat(F.when(F.col("role") == "user", "Class::").otherwise("class::"), "role")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_review_thread(subject, "ALI").alias("review"), T.is_class_row(content).alias("defines"))
