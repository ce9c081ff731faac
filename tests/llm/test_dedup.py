"""Substring dedup, line dedup and the Jaccard join against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import jaccard_join as J
from tessera.llm import line_dedup as LD
from tessera.llm import substring_dedup as S
from tessera.llm.common import components, materialize, screen, without
from tessera.llm.recompression import stretches
from tessera.llm.wordhash import hash_words, window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(texts: dict[int, str | None], size: int) -> dict[int, tuple[int, int, str]]:
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    seen: set[tuple[str, ...]] = set()
    out = {}
    for i in sorted(words):
        w, gone = words[i], set()
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                gone.update(range(s, s + size))
            seen.add(key)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings(docs, texts):
    wanted = brute_substrings(dict(enumerate(texts)), 20)
    found = S.dedup_substrings(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == wanted[r["doc_id"]]
        else:
            assert r["n_removed"] == 0


def test_substrings_other_window_and_text(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = brute_substrings(dict(enumerate(texts)), 3)
    for r in S.dedup_substrings(rows, 3, with_text=True).collect():
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == wanted[r["doc_id"]]
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_empty_tables(no_docs):
    assert S.dedup_substrings(no_docs).count() == 0
    assert J.jaccard_components(no_docs).count() == 0
    assert LD.dedup_lines(no_docs).count() == 0


@given(st.lists(st.text(alphabet="ab \n\u00e9", max_size=40), max_size=12))
@settings(max_examples=60, deadline=None)
def test_word_hashes(texts):
    data = [t.encode() for t in texts]
    hashes, at = hash_words(data)
    words = [WORD.findall(t) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [x for w in words for x in w]
    assert len(set(flat)) == len(set(hashes.tolist()))
    if len(flat) >= 5:
        five = window_hashes(hashes, 5)[: len(flat) - 4].tolist()
        assert len({tuple(flat[i : i + 5]) for i in range(len(flat) - 4)}) == len(set(five))


def test_long_text_in_pieces(monkeypatch):
    text = b"alpha beta gamma " * 50
    whole = hash_words([text])[0]
    monkeypatch.setattr("tessera.llm.wordhash.PIECE", 64)
    pieces, at = hash_words([b"x", text])
    assert pieces[1:].tolist() == whole.tolist() and at.tolist() == [0, 1, 151]


@given(st.lists(st.integers(0, 3), min_size=0, max_size=60), st.lists(st.integers(0, 3), max_size=10), st.lists(st.integers(0, 3), max_size=10))
@settings(max_examples=150, deadline=None)
def test_equal_windows_have_equal_symbols(core, before, after):
    """Wherever a window stands, and whatever is around it, it has one symbol."""
    words = np.array(core + [9] + before + core + after, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    doc = np.array([0] * len(core) + [1] * (1 + len(before) + len(core) + len(after)))
    symbol, _, start, count = stretches(words, doc, 6)
    of = {}
    for s, a, n in zip(symbol.tolist(), start.tolist(), count.tolist(), strict=True):
        for k in range(a, a + n):
            assert of.setdefault(tuple(words[k : k + 6].tolist()), s) == s
    assert count.sum() == sum(max(0, n - 5) for n in (len(core), 1 + len(before) + len(core) + len(after)))


def test_parts_cover_long_documents(monkeypatch):
    monkeypatch.setattr(S, "PART", 30)
    at = np.array([0, 10, 100, 120])
    starts = []
    for a, b, owner in S._parts(at, 20):
        for k in range(a, b - 19):
            if owner[k - a] == owner[k + 19 - a]:
                starts.append(k)
    assert sorted(starts) == [k for k in range(101) if any(lo <= k and k + 20 <= hi for lo, hi in ((0, 10), (10, 100), (100, 120)))]


def brute_lines(texts: dict[int, str | None], guarantee: int = 2) -> dict[int, tuple[int, int, str | None]]:
    seen, out = set(), {}
    for i in sorted(texts):
        t = texts[i]
        if t is None:
            out[i] = (0, 0, None)
            continue
        lines = t.split("\n")
        units = [(n, x) for n, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for k in range(len(units) - guarantee + 1):
            some = units[k : k + guarantee]
            key = tuple(x for _, x in some)
            if key in seen:
                gone |= {n for n, _ in some}
            seen.add(key)
        out[i] = (len(lines), len(gone), "\n".join(x for n, x in enumerate(lines) if n not in gone))
    return out


def line_texts(seed: int = 11) -> list[str | None]:
    """Texts of few different lines, so that runs repeat in many ways, with blanks, long lines and nulls."""
    rng = random.Random(seed)
    lines = [f"line {c}" for c in "abcdefgh"] + ["", "  \t", "x" * 300, "é" * 250]
    made = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    return [*made, None, "", "\n\n", made[3], "\n".join(f"only {i}" for i in range(3000)), "\n".join(["same"] * 500)]


@pytest.mark.parametrize("guarantee", [2, 3, 5])
def test_lines(spark, docs, texts, guarantee):
    for frame, said in ((docs, texts), (spark.createDataFrame(list(enumerate(line_texts())), "doc_id long, text string"), line_texts())):
        wanted = brute_lines(dict(enumerate(said)), guarantee)
        found = LD.dedup_lines(frame, guarantee).collect()
        assert len(found) == frame.count()
        for r in found:
            if r["doc_id"] is not None:
                assert (r["n_lines"], r["n_removed"], r["text"]) == wanted[r["doc_id"]]
            else:
                assert r["n_removed"] == 0
    assert set(LD.dedup_lines(docs).columns) == set(docs.columns) | {"n_lines"}


def test_fingerprints_are_the_window_minima(spark):
    said = line_texts()
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    hashed = {i: [r[0] for r in spark.createDataFrame([(x,) for x in (t or "").split("\n") if WORD.search(x)], "x string").select(F.xxhash64("x")).collect()] for i, t in list(enumerate(said))[:20]}
    for guarantee in (2, 4):
        found = LD.fingerprints(df, guarantee).collect()
        for i, h in hashed.items():
            wanted = {k + min(range(guarantee), key=lambda j: (h[k + j], j)) for k in range(len(h) - guarantee + 1)}
            own = [r for r in found if r["doc_id"] == i]
            assert sorted(r["place"] for r in own) == sorted(wanted)
            assert all(h[r["place"]] == r["h"] and h[r["start"] : r["start"] + len(r["zone"])] == r["zone"] for r in own)


def test_lines_come_through_fingerprints(spark, monkeypatch):
    """Only windows around fingerprints that occur twice are compared: without fingerprints nothing is."""
    df = spark.createDataFrame(list(enumerate(line_texts())), "doc_id long, text string")
    marks = LD.fingerprints
    assert LD.repeated_runs(df).count() > 0
    monkeypatch.setattr(LD, "fingerprints", lambda d, g: marks(d, g).where("h % 2 = 0"))
    kept = {r["doc_id"]: r["n_removed"] for r in LD.dedup_lines(df).collect()}
    assert 0 < sum(kept.values()) < sum(n for _, n, _ in brute_lines(dict(enumerate(line_texts()))).values())
    monkeypatch.setattr(LD, "fingerprints", lambda d, g: marks(d, g).where("false"))
    assert LD.repeated_runs(df).count() == 0


def test_runs_are_maximal(spark):
    a = [f"line {i}" for i in range(10)]
    rows = [(1, "\n".join(a)), (2, "\n".join(["x", *a[2:7], "y", a[8], a[9], *a[4:6]])), (3, "\n".join([a[0], "", a[1], "z", a[1], a[0]]))]
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in LD.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: [(1, 5, 1, 2), (7, 2, 1, 8), (9, 2, 1, 4)], 3: [(0, 2, 1, 0)]}


def test_line_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([(1, "a\nb", 5, 6), (2, "a\nb\nc", 7, 8)], "doc_id long, text string, n_lines int, n_removed int")
    got = LD.dedup_lines(df, prefix="own_").orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_removed"], r["own_n_lines"], r["own_n_removed"], r["text"]) for r in got] == [(5, 6, 2, 0, "a\nb"), (7, 8, 3, 2, "c")]


def shingles(text: str | None) -> frozenset:
    w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_components(texts: dict[int, str | None], percent: int) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(docs, texts):
    wanted = brute_components(dict(enumerate(texts)), 80)
    found = J.jaccard_components(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == wanted[r["doc_id"]]
    loose = {(r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is None}
    assert loose == {(wanted[0][0], 0), (0, None)}


def test_jaccard_lower_threshold_and_blocks(spark, texts, monkeypatch):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(J, "TASK_TOKENS", 300)
    for percent in (50, 80, 95):
        wanted = brute_components(dict(enumerate(texts)), percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(rows, percent).collect()}
        assert got == wanted


def test_link_is_exact():
    rng = np.random.default_rng(2)
    base = [f"t{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.integers(0, 8)):
            w[rng.integers(0, 80)] = f"e{rng.integers(0, 30)}"
        texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    sets = list(J.shingle_sets([t.encode() for t in texts]))
    members, asked = sets[::2], sets[1::2]
    told = [shingles(t) for t in texts]
    similar = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    for q, hit in zip(told[1::2], J.link(members, asked), strict=True):
        linked = [i for i, m in enumerate(told[::2]) if similar(q, m)]
        assert hit in linked if linked else hit == -1


def family_texts(seed: int = 3) -> list[str]:
    """Families of near copies with and without the text that they derive from, chains, and texts that only share passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    out, passage = [], [word() for _ in range(40)]
    for f in range(6):
        base = [word() for _ in range(120)]
        out += [" ".join(base)] * (f % 2)
        for _ in range(14):
            w = list(base)
            for _ in range(rng.choice((1, 2, 4, 8))):
                w[rng.randrange(120)] = word()
            out.append(" ".join(w))
    chain = [word() for _ in range(100)]
    for k in range(25):  # each is near the next one only
        out.append(" ".join(chain))
        chain = [*chain[4:], *(word() for _ in range(4))]
    out += [" ".join([*passage, *(word() for _ in range(rng.randrange(0, 12)))]) for _ in range(25)]
    out += [" ".join(passage[i : i + 20]) for i in range(20)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("percent", "tokens"), [(60, 400), (80, 250_000), (80, 400)])
def test_jaccard_families(spark, monkeypatch, percent, tokens):
    said = dict(enumerate(family_texts()))
    df = spark.createDataFrame(list(said.items()), "doc_id long, text string")
    wanted = brute_components(said, percent)
    assert len({c for _, c in wanted.values()}) < len(said) - 40
    monkeypatch.setattr(J, "TASK_TOKENS", tokens)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df, percent).collect()} == wanted


def test_second_round_is_complete(spark, monkeypatch):
    """Whatever the pivots link, the second round finds the rest: also if they link nothing."""
    said = dict(enumerate(family_texts()))
    df = spark.createDataFrame(list(said.items()), "doc_id long, text string")
    first = J._families
    monkeypatch.setattr(J, "_families", lambda *a: (lambda links, pivots: (links.where("false"), pivots))(*first(*a)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect()} == brute_components(said, 80)


def test_representatives(docs, texts):
    left = [r["doc_id"] for r in J.keep_representatives(docs).select("doc_id").collect()]
    wanted = brute_components(dict(enumerate(texts)), 80)
    assert {i for i in left if i is not None} == {i for i, (_, c) in wanted.items() if i == c}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60) if i % 20] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert {got[i] for i in range(1, 21)} == {1} and {got[i] for i in range(21, 41)} == {21}
    assert {got[i] for i in range(100, 160)} == {100} and got[201] == got[200] == 200
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_without(spark):
    df = spark.createDataFrame([(i, f"t{i}", 5) for i in [*range(50), None]], "doc_id long, text string, __map int")
    gone = spark.createDataFrame([(i,) for i in range(0, 50, 3)], "doc_id long")
    left = without(df, "doc_id", gone)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == sorted([(False, i) for i in range(50) if i % 3] + [(True, 0)])


def test_ids_and_nulls_come_back(spark):
    least = -(1 << 63)
    df = spark.createDataFrame([(least, "a b"), (None, "a b"), (0, "a b"), (1 << 62, None)], "doc_id long, text string")
    assert sorted(repr(r["doc_id"]) for r in S.dedup_substrings(df).collect()) == sorted(map(repr, (least, None, 0, 1 << 62)))
    assert sorted(repr(r["doc_id"]) for r in J.jaccard_components(df).collect()) == sorted(map(repr, (least, None, 0, 1 << 62)))


def test_settings_outlive_threads(spark):
    """Tables written at once by several threads leave the session as it was."""
    from concurrent.futures import ThreadPoolExecutor

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with ThreadPoolExecutor(6) as pool:
        counts = list(pool.map(lambda i: materialize(spark.range(i), "many").count(), range(12)))
    assert counts == list(range(12)) and spark.conf.get(key) == before


def test_very_long_texts(spark):
    """A text of 120,000 words and one of 30,000 lines beside short ones, whole."""
    rng = random.Random(8)
    long_ = " ".join(f"v{rng.randrange(50_000)}" for _ in range(120_000))
    middle = " ".join(long_.split()[60_000:60_050])
    said = {1: long_, 2: f"before {middle} after", 3: long_[: len(long_) // 2]}
    df = spark.createDataFrame(list(said.items()), "doc_id long, text string")
    wanted = brute_substrings(said, 20)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.dedup_substrings(df).collect()} == wanted
    assert wanted[2][1] == 50 and wanted[3][1] > 50_000
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect()} == brute_components(said, 80)
    lines = {1: "\n".join(f"l {i % 29_000}" for i in range(30_000)), 2: "\n".join(f"l {i}" for i in range(5, 400))}
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in LD.dedup_lines(spark.createDataFrame(list(lines.items()), "doc_id long, text string")).collect()}
    assert got == brute_lines(lines)


def test_rows_that_share_an_id(spark):
    """Rows of one id are one document, also where their texts and lengths differ."""
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(1, shared), (2, "x " * 40 + shared), (2, "short"), (2, "a\nb\nc"), (1, "a\nb")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(S.dedup_substrings(df).collect()) == 5
    lines = {(r["doc_id"], r["n_lines"]): r["text"] for r in LD.dedup_lines(df).collect()}
    assert lines[2, 3] == "c" and lines[1, 2] == "a\nb"


@pytest.mark.parametrize("window", [0, 1 << 20])
def test_window_bounds(docs, window):
    with pytest.raises(ValueError):
        S.dedup_substrings(docs, window)


def test_long_windows(spark):
    """Windows of more words than a thousand, whose stretches are long as well."""
    rng = random.Random(9)
    w = [f"v{rng.randrange(9)}" for _ in range(4000)]
    said = {1: " ".join(w), 2: " ".join(w[500:2600]), 3: " ".join(w[:1400])}
    df = spark.createDataFrame(list(said.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.dedup_substrings(df, 1500).collect()} == brute_substrings(said, 1500)


def test_screen(spark):
    a, b = spark.range(5000).select(F.col("id").alias("k")), spark.range(0, 5000, 50).select(F.col("id").alias("k"))
    kept = screen(a, "k", b)
    assert kept.join(b, "k").count() == b.count() and kept.count() < 200
    assert screen(a, "k", b.where("false")).count() == 0
