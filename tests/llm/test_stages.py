"""The pipeline's stages: what they return for odd inputs, and each against brute force."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import quality as Q
from tests.conftest import SMALL
from tests.llm.test_dedup import WORD, brute_components, brute_lines
from tests.llm.test_others import COUNTS, brute_counts_fast, brute_leaks, gapless

#: Names that the operators use for columns of their own, in various spellings.
CLASHES = "n_words word_chars reason kept base_failed n_lines N_removed n_dup_lines component_id n_shingles class item_id n_matched piece length __own __gone __maybe __map __kept rep token text_".split()


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark")}


def clashing(docs):
    """The documents with columns of clashing names, nulls, repeated rows, and texts without words."""
    odd = docs.sparkSession.createDataFrame([(None, None), (None, "a b"), (7_000_001, None), (7_000_002, ""), (7_000_003, " \\n ")], "doc_id long, text string")
    odd = odd.select("doc_id", "text", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns[2:]])
    some = docs.unionByName(odd.select(docs.columns)).unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id < 5"))
    return some.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES])


@pytest.mark.parametrize("i", range(4))
def test_columns_of_the_caller_stay(spark, tables, i):
    """All columns come back with their own values; without the clashing ones the same rows do."""
    stage, docs = corpus_pipeline.STAGES[i][1], clashing(tables["documents"])
    left = stage(spark, docs, SMALL)
    assert left.columns == docs.columns
    rows = left.collect()
    for r in rows:
        assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for c in CLASHES)
    plain = stage(spark, docs.select(tables["documents"].columns), SMALL).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "")
    assert sorted(map(key, rows)) == sorted(map(key, plain)) and rows
    odd = {(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is None or r["doc_id"] > 7_000_000}
    assert odd == (set() if i == 0 else {(None, None), (None, "a b"), (7_000_001, None), (7_000_002, ""), (7_000_003, " \\n ")})


@pytest.mark.parametrize("i", range(5))
def test_empty_tables(spark, tables, i):
    assert corpus_pipeline.STAGES[i][1](spark, tables["documents"].where("false"), SMALL).count() == 0


def test_stages_against_brute_force(spark, tables):
    """The whole pipeline on the smallest tables, each stage computed anew in plain Python from what the one before kept."""
    from tokenizers import Tokenizer

    docs, labels = tables["documents"], tables["labels"]
    columns = docs.columns
    have = {r["doc_id"]: r["text"] for r in docs.collect()}
    step = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, wanted = have, {}
        if name == "quality rules":
            rules = Q.learn(Q.labelled_rows(docs, labels))
            features = {r["doc_id"]: r for r in Q.statistics(docs).select("doc_id", *COUNTS, *Q.FEATURES[1:]).collect()}
            for i, t in before.items():
                n, _, _, _, repeats = brute_counts_fast(t or "")
                fired = any(all((features[i][c.feature] >= c.threshold) == c.above for c in rule) for rule in rules)
                if n >= 50 and 100 * repeats <= 50 * n and not fired:
                    wanted[i] = t
        elif name == "line dedup":
            for i, (_, n, t) in brute_lines(before).items():
                if not n or WORD.search(t):
                    wanted[i] = t
        elif name == "n-gram jaccard join":
            wanted = {i: before[i] for i, (_, c) in brute_components(before, 80).items() if i == c}
        else:
            bad = {d for d, _ in brute_leaks(before, {r["item_id"]: r["text"] for r in tables["benchmark"].collect()})}
            wanted = {i: t for i, t in before.items() if i not in bad}
        step = stage(spark, step, SMALL).cache()
        assert step.columns == columns
        have = {r["doc_id"]: r["text"] for r in step.collect()}
        assert have == wanted, name
        assert all(r["n_chars"] == len(r["text"]) for r in step.collect())
        counts.append(len(have))
    assert len(docs.collect()) > counts[0] > counts[2] > 0
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, SMALL).collect()
    gapless(packed, 1024)
    parts = {}
    for r in packed:
        parts.setdefault(r["doc_id"], []).append(r)
    assert set(parts) == set(have)
    for i, rows in parts.items():
        ids = [*own.encode(have[i], add_special_tokens=False).ids, 2]
        rows.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in rows] == [0, *np.cumsum([r["length"] for r in rows])[:-1]] and sum(r["length"] for r in rows) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in rows)
    assert corpus_pipeline.ORACLE_SQL is None
