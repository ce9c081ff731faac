"""Queries over vectors and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.operators import retrieval as R
from tessera.session import table
from tessera.plans.registry import Registry

query = Registry()


#: Every vector whose id is divisible by 50 is a query, against all vectors.
_SCORED = """
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
scored AS (SELECT query_id, vec_id, label, round(list_dot_product(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS score FROM embeddings, q),
deduped AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, score, label ORDER BY vec_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM deduped)
"""


def _search(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return R.search(e, asked, "label", k)


@query(_SCORED + "SELECT query_id, vec_id, label, score, rank FROM ranked WHERE rank <= 15 AND (score >= 0.25 OR rank = 1)")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.threshold(_search(spark, sf_dir, R.KEEP), 0.25).select("query_id", "vec_id", "label", "score", "rank")


@query(_SCORED + "SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 50")
def knn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, R.FETCH).select("query_id", "vec_id", "score", "rank")


@query(_SCORED + "SELECT query_id, vec_id, score FROM ranked WHERE rank = 1")
def knn_threshold_keep1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.threshold(_search(spark, sf_dir, R.FETCH), 1.5).select("query_id", "vec_id", "score")


@query(_SCORED + """, best AS (SELECT vec_id, max(score) AS score FROM ranked WHERE rank <= 50 GROUP BY vec_id)
SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM best""")
def multi_query_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_queries(_search(spark, sf_dir, R.FETCH)).select("vec_id", "score", "rank")


@query(_SCORED + "SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 50 AND rank > 15")
def failed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _search(spark, sf_dir, R.FETCH)
    return R.failed(found, found.where(F.col("rank") <= R.KEEP)).select("query_id", "vec_id", "score", "rank")


@query(_SCORED.replace("WITH q", "WITH RECURSIVE q") + """, cand AS (SELECT r.*, embedding::DOUBLE[] AS v FROM ranked r JOIN embeddings USING (vec_id) WHERE rank <= 50),
sims AS (SELECT a.query_id, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM cand a JOIN cand b USING (query_id)),
picks(query_id, pick, chosen) AS (
  SELECT DISTINCT query_id, 0, []::BIGINT[] FROM cand
  UNION ALL
  SELECT query_id, pick + 1, list_append(chosen, best) FROM (
    SELECT p.query_id, p.pick, p.chosen, (SELECT r.vec_id FROM cand r WHERE r.query_id = p.query_id AND NOT list_contains(p.chosen, r.vec_id)
      ORDER BY CASE WHEN p.pick = 0 THEN r.score ELSE 0.5 * r.score - 0.5 * (SELECT max(s) FROM sims WHERE sims.query_id = p.query_id AND sims.a = r.vec_id AND list_contains(p.chosen, sims.b)) END DESC, r.rank LIMIT 1) AS best
    FROM picks p WHERE p.pick < 15) WHERE best IS NOT NULL
)
SELECT query_id, chosen[-1] AS vec_id, pick::INTEGER AS pick FROM picks WHERE pick > 0""")
def mmr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _search(spark, sf_dir, R.FETCH)
    return R.diverse(R.with_vectors(found, table(spark, sf_dir, "embeddings")), R.KEEP, 0.5)


@query(_SCORED + """, texts AS (
  SELECT r.query_id, r.rank, d.text, len(list_filter(regexp_split_to_array(d.text, '\\s+'), lambda w: w <> '')) AS n
  FROM ranked r JOIN documents d ON d.doc_id = r.vec_id WHERE r.rank <= 15
), used AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY rank) AS used, min(rank) OVER (PARTITION BY query_id) AS first FROM texts)
SELECT query_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS context_md5, count(*) AS n_kept FROM used WHERE used <= 2048 OR rank = first GROUP BY query_id""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and document of one number are paired; the tables have no key to each other."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = _search(spark, sf_dir, R.KEEP).join(docs, "vec_id").withColumn("n", T.word_count(F.col("text")))
    rows = rows.withColumn("rank", F.expr("row_number() over (partition by query_id order by rank)"))
    return R.context(rows, "n", 2048).select("query_id", F.md5("context").alias("context_md5"), "n_kept")


@query(_SCORED + "SELECT query_id, vec_id, format('{:.4f}', score) AS score_text, sum(label) OVER (PARTITION BY query_id) AS total_words FROM ranked WHERE rank <= 15")
def similarity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report(_search(spark, sf_dir, R.KEEP), "label").select("query_id", "vec_id", "score_text", "total_words")


@query(_SCORED + """, best AS (SELECT vec_id, max(score) AS score FROM ranked WHERE rank <= 50 GROUP BY vec_id),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM best),
kept AS (SELECT * FROM placed WHERE rank <= 15 AND score >= 0.4), notes AS (
  SELECT doc_id AS vec_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word, CASE WHEN doc_id % 3 > 0 THEN source END AS subject, doc_id % 7 AS page, lang FROM documents
), texts AS (
  SELECT rank, CASE WHEN subject IS NULL THEN '' ELSE '[TITLE] ' || subject || chr(10) END || coalesce(text, '') AS text, coalesce(word, 0) AS n FROM kept LEFT JOIN notes USING (vec_id)
), lines AS (
  SELECT p.rank, p.vec_id IN (SELECT vec_id FROM kept) AS kept, coalesce(word, 0) AS word,
    '| ' || format('{:.4f}', score) || ' | ' || coalesce(subject, 'd' || n.vec_id, 'None') || ' | None | ' || coalesce(lang, 'None') || ' | ' || coalesce(page::VARCHAR, 'None') || ' | ' || coalesce(word, 0) || ' |' AS line
  FROM placed p LEFT JOIN notes n USING (vec_id)
), head AS (SELECT '| score | doc | date | file_type | page | word |' || chr(10) || '|---:|---|---|---|---:|---:|' || chr(10) AS head),
used AS (SELECT *, sum(n) OVER (ORDER BY rank) AS used, min(rank) OVER () AS first FROM texts)
SELECT *, context || chr(10) || chr(10) || 'Question: What is sold?' AS prompt, md5(context || chr(10) || chr(10) || 'Question: What is sold?') AS answer FROM (
SELECT (SELECT string_agg(text, chr(10) || chr(10) ORDER BY rank) FROM used WHERE used <= 2048 OR rank = first) AS context, (SELECT count(*) FROM used WHERE used <= 2048 OR rank = first) AS n_kept,
  (SELECT head || string_agg(line, chr(10) ORDER BY rank) || chr(10) || 'Total word count: ' || sum(word) FROM lines, head WHERE kept GROUP BY head) || chr(10) || chr(10) || 'Failed CANDIDATE_K (not selected):' || chr(10) || chr(10)
  || (SELECT head || string_agg(line, chr(10) ORDER BY rank) || chr(10) || 'Total word count: ' || sum(word) FROM lines, head WHERE NOT kept GROUP BY head) AS report)""")
def full_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector as a way to ask one question; in place of a model, the answer is the digest of the prompt."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    n, words = F.col("doc_id"), T.word_count(F.col("text"))
    docs = table(spark, sf_dir, "documents").select(
        n.alias("vec_id"), "text", words.alias("tokens"), words.alias("word"), F.when(n % 3 > 0, F.col("source")).alias("subject"), F.concat(F.lit("d"), n).alias("doc_id"),
        F.lit(None).cast("string").alias("date"), F.col("lang").alias("file_type"), (n % 7).alias("page"),
    )
    return R.answer(e, asked, docs, " What is sold? ", F.md5, "label", 2048)


@query("""SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled vectors are normalised back to the unit length of the stored ones."""
    scaled = table(spark, sf_dir, "embeddings").withColumn("v", N.normalized(F.transform("embedding", lambda x: x * 3)))
    return scaled.select("vec_id", F.round(F.sqrt(N.dot(F.col("v"), F.col("v"))), 4).alias("norm"))


@query("""SELECT doc_id, md5('[TITLE] ' || source || chr(10) || text) AS titled, md5('Subject: ' || source || chr(10) || 'From: ' || lang || chr(10) || text) AS labelled FROM documents""")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    labelled = R.labelled_text(F.col("text"), subject=F.col("source"), from_=F.col("lang"), date=F.lit(""))
    return d.select("doc_id", F.md5(R.embedding_text(F.col("source"), F.col("text"))).alias("titled"), F.md5(labelled).alias("labelled"))


@query("""WITH b AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS base FROM benchmark)
SELECT item_id, unnest([base, base || ' vendor catalog product series', 'vendor catalog product series ' || base]) AS variant FROM b""")
def query_rewriting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.query_variants(F.col("text"), ["used", "broken"])).alias("variant"))


@query("""WITH b AS (SELECT max(vec_id) AS base FROM embeddings)
SELECT vec_id AS source_id, base + row_number() OVER (ORDER BY vec_id) AS vector_id FROM embeddings, b WHERE label = 3""")
def index_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.files import append_ids

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("vec_id").alias("source_id"), "label")
    new = e.where("label = 3").drop("vector_id")
    return append_ids(e, new, ["source_id"]).select("source_id", "vector_id")
