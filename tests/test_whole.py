"""Queries cover whole tables."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval as R
from tessera.plans import catalogue
from tests.conftest import SMALL, rows

SAFETY = re.compile(r"\b(iec|ul|nec|csa|tests?|testing|certif\w*|compl(?:y|i\w*)|standard\w*|lumin\w*?)\b")


def route(source: str, text: str) -> str:
    said = f"{source}\n{text}".lower()
    return "safety" if SAFETY.search(said) else "rita" if re.search(r"\brita\w*\b", said) else "unknown"


def test_route_all(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = rows(catalogue.QUERIES["route_text"](spark, SMALL), "doc_id")
    assert got == sorted((d["doc_id"], route(d["source"], d["text"])) for d in docs)
    assert any(not d["text"].isascii() for d in docs)
    said = ["été test", "ététest", "testé", "中文 UL 中文", "ritaé", "é rita", "complié"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i long, x string")
    assert [r[1] for r in rows(df.select("i", T.route(F.lit("s"), F.col("x"), "rita")), "i")] == [route("s", x) for x in said]


def test_every_query_is_asked(spark):
    ids = set(range(0, 500, 50))
    for name in ("knn_topk", "knn_dedup", "knn_threshold_keep1", "failed_candidates", "mmr_topk", "similarity_report"):
        assert {r["query_id"] for r in catalogue.QUERIES[name](spark, SMALL).select("query_id").distinct().collect()} == ids


def test_many_queries_go_in_blocks(spark, monkeypatch):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id < 40")
    asked = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    whole = rows(R.search(e, asked, "label", 5).drop("embedding"), "query_id", "rank")
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 9)
    assert rows(R.search(e, asked, "label", 5).drop("embedding"), "query_id", "rank") == whole and len(whole) == 200


def test_search_equals_all_pairs(spark, monkeypatch):
    """Blocks give what scoring, removing copies and ranking of all pairs give, with copies, ties, nulls, odd vectors and null ids; no vector goes along."""
    rng = np.random.default_rng(5)
    some = [[float(np.float32(x)) for x in rng.integers(-2, 3, 4) / 4] for _ in range(60)]
    near = [[1.0, 1e-7 * i, 0.0, 0.5] for i in range(40)]
    odd = [None, [1.0, None, 0.0, 0.0], [1.0], [float("nan"), 0.0, 0.0, 0.0], [1e9, 0.0, 0.0, 0.0], [0.0] * 4, []]
    e = [(i if i != 7 else None, v, i % 3 if i % 5 else None) for i, v in enumerate(some + near + [some[0]] * 50 + odd)]
    df = spark.createDataFrame(e, "vec_id long, embedding array<double>, label int")
    asked = spark.createDataFrame([(i, v) for i, v in enumerate([*some[:5], [0.0] * 4, [0.5, 3.0, 1.0], [1.0, 1.0, None, 0.0], [0.0000005, 0.5, 0.25, 1.0]])], "query_id long, query_vec array<double>")
    monkeypatch.setattr(R, "NUMBERS", 200)
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 4)
    for k in (1, 3, 7, 500):
        plain = R.top_k(R.dedup(R.score(df, asked), "label"), k).select("query_id", "vec_id", "label", "score", "rank")
        found = R.search(df, asked, "label", k)
        assert found.columns == plain.columns
        assert list(map(repr, rows(found, "query_id", "rank"))) == list(map(repr, rows(plain, "query_id", "rank")))
    assert R.search(df, asked.limit(0), "label", 3).count() == 0 and R.search(df.limit(0), asked, "label", 3).count() == 0


def test_all_rows(spark):
    n = spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert catalogue.QUERIES["repeat_reads"](spark, SMALL).count() == n


def test_more_than_99_blocks(spark):
    most = catalogue.QUERIES["canonical_blocks"](spark, "/root/testdata/sf0.01").orderBy(F.desc("n_blocks")).first()
    assert most["n_blocks"] >= 100 and most["last_id"] == f"{most['doc_id']}_b{most['n_blocks']}"
