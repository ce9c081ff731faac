"""Registered queries against their SQL, the pipeline against its stages, and the shape of what is returned."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.llm import queries as LQ
from tests.conftest import SMALL
from tests.llm.conftest import make_texts
from tests.llm.test_dedup import family_texts, line_texts
from tests.llm.test_others import ALIASES, TURNS


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(LQ.ORACLE))
def test_matches_sql(spark, duck, name):
    same(LQ.QUERIES[name](spark, SMALL), duck.execute(LQ.ORACLE[name]))


def same(df, cursor):
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    pick = lambda cols, rows: sorted(repr([r[cols.index(c)] for c in sorted(cols)]) for r in rows)
    assert pick(df.columns, df.collect()) == pick(names, cursor.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in LQ.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_line_dedup", "op3_url_filter", "op4_jaccard_join", "op5_chat"])
def test_matches_sql_on_odd_rows(spark, tmp_path, name):
    """Tables with nulls, empty and repeated texts, ties and redirect chains."""
    texts = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*make_texts(), *line_texts(), *family_texts()[:60]])]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ALIASES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    turns = [(c, t, r, x) for c, t, r, x in TURNS if c is not None and t is not None and r is not None]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    same(LQ.QUERIES[name](spark, str(tmp_path)), con.execute(LQ.ORACLE[name]))


def test_leaks_are_exact_passages(spark, duck):
    """All documents with a whole item in them are found, and those found hold nearly all of its words."""
    found = {(r["doc_id"], r["item_id"]) for r in LQ.QUERIES["op7_decontaminate"](spark, SMALL).collect()}
    holds = set(duck.execute("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall())
    assert holds <= found


def test_toxic_documents_are_found(spark):
    """On the tables of some size; the smaller ones have a few dozen toxic labels in four languages."""
    found = {r["doc_id"] for r in LQ.QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    toxic, clean = {r["doc_id"] for r in labels if r["toxic"]}, {r["doc_id"] for r in labels if not r["toxic"]}
    assert len(found & toxic) >= 0.9 * len(toxic) and len(found & clean) <= 0.02 * len(clean)
