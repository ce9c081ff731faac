"""SimHash components, source divergences and filter interactions against plain Python and SQL."""

from __future__ import annotations

import random
import re
from fractions import Fraction
from itertools import combinations, permutations

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import divergence, interaction, simhash
from tessera.llm import queries as LQ
from tessera.llm.common import materialize, split_words
from tests.conftest import SMALL
from tests.llm.conftest import make_texts
from tests.llm.test_queries import same


def plain_print(text: str | None, size: int = 4) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[int], most: int) -> list[int]:
    """The least place that links reach, for each print."""
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= most:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def brute_components(rows: list[tuple], most: int = 4) -> list[tuple]:
    """Of (doc_id, text): id, fingerprint and the smallest id of the component."""
    prints = [plain_print(t) for _, t in rows]
    roots = plain_components(prints, most)
    least: dict[int, int | None] = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots, strict=True)), key=repr)


def test_fingerprints_of_odd_texts(texts):
    for t in [*texts, "A b  C\x0bd\te F", "x " * 40000, "é" * 3_000_000 + " a b c", "one"]:
        signed = simhash.fingerprint((t or "").encode())
        assert signed & ((1 << 64) - 1) == plain_print(t)


def test_words_in_pieces_are_the_words(texts):
    for t in texts:
        data = (t or "").encode()
        for most in (1, 7, 100):
            assert [w for piece in split_words(data, most=most) for w in piece] == data.lower().split()


def test_spark_hashes_alike(spark):
    """The yardstick of the tests: Spark's own xxhash64 has the seed that the contract names."""
    assert spark.range(1).select(F.xxhash64(F.lit("a b é d"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("a b é d".encode(), 42)


def test_components_of_documents(spark, docs, texts):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=repr)
    assert found == brute_components(rows)


def test_components_of_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in LQ.QUERIES["op11_simhash"](spark, SMALL).collect()), key=repr) == brute_components(rows)


def dense(rng: random.Random, n: int, flips: int) -> list[int]:
    base = rng.getrandbits(64)
    return [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips))) for _ in range(n)]


@pytest.mark.parametrize(("most", "crowd"), [(4, 128), (4, 2), (0, 128), (1, 2), (3, 3), (7, 4)])
def test_links_of_dense_groups(spark, monkeypatch, most, crowd):
    """Groups whose members differ by a few bits, chains, and prints that share a segment with many but link with none."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(most * 10 + crowd)
    prints = [*dense(rng, 150, 6), *dense(rng, 60, 3), *(rng.getrandbits(64) for _ in range(100))]
    prints += [(rng.getrandbits(43) << 21) | 12345 for _ in range(150)]
    step = rng.getrandbits(64)
    for i in range(0, 60, max(most, 1)):
        step ^= sum(1 << (i + k) for k in range(min(most, 64 - i)))
        prints.append(step)
    prints = list(dict.fromkeys(prints))
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = {r["fp"] % (1 << 64): r["component"] for r in simhash._linked(materialize(frame, "prints"), most).collect()}
    wanted = plain_components(prints, most)
    names = [found.get(p, ("own", p)) for p in prints]
    assert len(set(zip(names, wanted, strict=True))) == len(set(names)) == len(set(wanted))


def test_masks_promise_a_key():
    """Any two prints within the bound agree in a segment or on it without the one bit in which they differ, and so do their other bits."""
    rng = random.Random(4)
    meets = lambda rows, diff: [i for i, w, m in rows if not m & diff and (w < 0 or diff >> w & 1)]
    for most in range(1, 9):
        one, two = simhash._masks(list(range(64)), most), simhash._finer_masks(most)
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, most)))
            assert meets(one, diff) and all(meets([r for r in two if r[0] == i], diff) for i in meets(one, diff))


def test_simhash_of_nothing(spark, no_docs):
    assert simhash.simhash_components(no_docs).collect() == []
    assert simhash.simhash_components(no_docs).columns == ["doc_id", "fingerprint", "component_id"]
    alone = spark.createDataFrame([(None, ""), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in simhash.simhash_components(alone).collect()] == [(None, "0" * 16, None)] * 2


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls in every column, repeated rows, empty and long texts, copies across languages, labels that disagree, clashing columns."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rng = random.Random(9)
    texts = [*make_texts(), "THE END # of it", "word " * 120, " ".join(f"w{i}" for i in range(130)), "ÀÉÎ été\x00ok", "a1b2c3", *make_texts(6)]
    langs, sources = ["en", "fr", None, "", "日本"], ["s0", "s1", "s2", None, "", "é"]
    rows = [(i, t, rng.choice(langs), rng.choice(sources), 1, 2) for i, t in enumerate(texts)]
    rows += [(100 + i, t, "en", sources[i % 5], 1, 2) for i, t in enumerate(texts)] + [rows[3], rows[3], (None, texts[0], "en", "s0", 1, 2), (None, None, None, None, 1, 2)]
    rows += [(500, "42 ! 7", "xx", "alone", 1, 2), (501, None, "yy", "a", 1, 2), (502, "", "yy", "b", 1, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, value int, part int").write.parquet(f"{folder}/documents.parquet")
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 140, 3)] + [(3, 0, 1), (6, None, None), (None, 1, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["op12_divergence", "op13_interaction"])
def test_matches_sql_on_odd_rows(spark, odd, name):
    same(LQ.QUERIES[name](spark, odd[0]), odd[1].execute(LQ.ORACLE[name]))


def test_divergence_by_hand(spark):
    """Two sources and two kept terms, worked out by the definition in whole numbers."""
    rows = [("a a B", "en", "x")] * 2 + [("b", "en", "y")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    found = {tuple(r)[1:5]: r["rank"] for r in divergence.divergences(docs, least_documents=1).collect()}
    price = lambda c, n: 1 + 10**9 * (c + 2) // (n + 4)
    gap = lambda p, q: (p - q) ** 2 // (p + q)
    both = gap(price(4, 6), price(0, 1)) + gap(price(2, 6), price(1, 1))
    assert found == {
        ("x", "pair", "y", both): 1, ("y", "pair", "x", both): 1,
        ("x", "term", "a", gap(price(4, 6), price(4, 7))): 1, ("y", "term", "b", gap(price(1, 1), price(3, 7))): 1,
    }


def test_terms_of_long_texts_are_counted_once_a_document(spark):
    text = "Ab " * 900_000 + "é"
    docs = spark.createDataFrame([(text, "en", "s"), ("ab", "en", "s")], "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.term_counts(docs).collect()) == [("en", "s", "ab", 900_001, 2), ("en", "s", "é", 1, 1)]


def test_large_counts_are_priced_exactly(spark):
    row = spark.createDataFrame([(10**15 + 7, 10**16, 12345)], "c long, n long, v long")
    assert row.select(divergence._price("c", "n", "v")).first()[0] == 1 + 10**9 * (10**15 + 9) // (10**16 + 2 * 12345)


def test_removal_polynomial():
    """Corners against the masks themselves, and shares against all orders."""
    rng = random.Random(3)
    counts = {m: rng.randint(0, 10**12) for m in range(32)}
    removal = interaction.Removal(counts)
    lost = lambda s: sum(n for m, n in counts.items() if m & s)
    assert all(removal.at(s) == lost(s) for s in range(32))
    total = [0] * 5
    for order in permutations(range(5)):
        before = 0
        for i in order:
            total[i] += lost(before | 1 << i) - lost(before)
            before |= 1 << i
    assert [removal.shapley(i) * 120 for i in range(5)] == [Fraction(t) for t in total]


def test_audits_of_nothing(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.interactions(no_docs, labels).collect() == [] == divergence.divergences(no_docs).collect()
    one = spark.createDataFrame([(1, "x", None, None)], "doc_id long, text string, lang string, source string")
    assert interaction.interactions(one, labels).count() == 600 and divergence.divergences(one).count() == 0
