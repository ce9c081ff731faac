"""The other operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat as CH
from tessera.llm import decontaminate as D
from tessera.llm import packing as P
from tessera.llm import quality as Q
from tessera.llm import token_counts as TC
from tessera.llm import toxicity as T
from tessera.llm import url_filters as U
from tessera.llm.wordhash import hash_words

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- packing -----------------------------------------------------------------


@pytest.fixture(scope="module")
def own():
    """The file as it stands, run by its own library: the yardstick for ids."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    return lambda t: tokenizer.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(BPE)


SPECIAL = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "it's <|endoftext|", "<|endoftext|>", "x<|endoftext|>", "  <|endoftext|>\n\n y", "<|endof<|endoftext|>text|>", "plain"]


def test_ids_are_the_tokenizers(texts, own):
    fast = P.Encoder(BPE)
    assert fast.fast is not None and 50256 in own(SPECIAL[0])
    for t in [*texts, *SPECIAL, "it's we'll  <|endoftext|>\n\n x", "中文 １２３ 😀", "\u2028 \u00a0\ta\x00b"]:
        if t:
            assert fast(t) == np.array(own(t), "<u4").tobytes()


@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", "endoftext", " ", "\n", "it's", "été", "1234", "😀", "<", "  x"]), max_size=12))
@settings(max_examples=200, deadline=None)
def test_ids_of_joined_parts(own, encoder, parts):
    t = "".join(parts)
    assert not t or encoder(t) == np.array(own(t), "<u4").tobytes()


def test_pieces_of_special_texts(spark, own):
    df = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in P.pieces(df, BPE, 64, 2).collect()}
    ids = [[*own(t), 2] for t in SPECIAL]
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}


def test_other_files_use_their_library():
    slow = P.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert slow.fast is None and len(slow("hello there")) == 8


def gapless(rows, capacity: int) -> int:
    """The number of sequences, each of which is filled from 0 without gaps."""
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack(docs, texts, no_docs, own):
    rows = P.pack(docs, BPE, capacity=64).collect()
    bins, whole = gapless(rows, 64), {}
    for r in rows:
        whole.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*(own(t) if t else []), 2], "<u4").tobytes()
        n, parts = len(ids) // 4, sorted(whole[i], key=lambda r: (r["piece"], r["sequence_id"]))
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])
            assert r["length"] == (64 if r["piece"] else n % 64 or 64) if n > 64 else r["length"] == n
        assert sum(r["length"] for r in parts) == n * (2 if i == 0 else 1)
    total = sum(r["length"] for r in rows)
    assert bins <= 1.1 * total / 64 + 2
    assert P.pack(no_docs, BPE).count() == 0


def test_pack_repeated_rows(spark):
    """Thousands of equal rows, with and without an id, each packed once; no group of them has to be sorted together."""
    rows = [(None, "same text here")] * 3000 + [(5, "x " * 90)] * 2000 + [(100 + i, None) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    made = P.pieces(df, BPE, 64, 2)
    assert made.groupBy("length", "part", "nth").count().where("count > 1").count() == 0 and made.select("part").distinct().count() == 6
    out = P.pack(df, BPE, capacity=64)
    assert not re.search(r"Window", out._jdf.queryExecution().optimizedPlan().toString())
    got = out.collect()
    assert gapless(got, 64) <= sum(r["length"] for r in got) / 64 * 1.1 + 2
    count = {k: sum(r["doc_id"] == k and r["piece"] == 0 for r in got) for k in (None, 5)}
    assert count == {None: 3000, 5: 2000} and sum(r["length"] == 1 for r in got) == 50


def test_pack_a_long_text(spark, own):
    text = " ".join(f"word{i % 977}" for i in range(60_000))
    got = sorted(P.pack(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string"), BPE).where("doc_id = 1").collect(), key=lambda r: r["piece"])
    ids = [*own(text), 2]
    assert [r["start"] for r in got] == list(np.cumsum([0, *(r["length"] for r in got)]))[:-1] and sum(r["length"] for r in got) == len(ids)
    assert all(r["length"] == 1024 for r in got[1:]) and all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in got)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 25), max_size=25))
@settings(max_examples=150, deadline=None)
def test_plan_places_all(counts):
    placed, bins = P.plan(dict(counts), 30)
    filled, ranks = {}, {}
    for length, first, last, each, b, at, stride in placed:
        for r in range(first, last + 1):
            k = r - first
            filled.setdefault(b + k // each, []).append((at + k % each * stride, length))
            ranks.setdefault(length, []).append(r)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert len(filled) == bins
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 30 and sum(3 * length > 30 for _, length in parts) <= 2


# --- token counts --------------------------------------------------------------


def greedy(word: str, vocabulary: set[str]) -> int:
    n = i = 0
    while i < len(word):
        for j in range(len(word), i, -1):
            if word[i:j] in vocabulary:
                n, i = n + 1, j
                break
        else:
            n, i = n + TC.fallback(word[i]), i + 1
    return n


@given(st.sets(st.text(alphabet="▁abc", min_size=1, max_size=5), max_size=25), st.text(alphabet="▁abcdé", max_size=25))
@settings(max_examples=300, deadline=None)
def test_automaton_is_greedy(vocabulary, word):
    assert TC.Automaton(sorted(vocabulary)).count(word) == greedy(word, vocabulary)


def test_token_counts(docs, texts, no_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = set(TC.load_pieces(path))
    wanted = {i: (len(w := WORD.findall(t or "")), sum(greedy(TC.START + x, vocabulary) for x in w)) for i, t in enumerate(texts)}
    rows = TC.token_counts(docs, path).collect()
    assert len(rows) == docs.count()
    assert all((r["n_words"], r["n_tokens"]) == wanted[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    assert TC.token_counts(no_docs, path).count() == 0


# --- chat ----------------------------------------------------------------------

TURNS = [
    (1, 0, "user", "a]b~0"), (1, 1, "user", "[INST:x]"), (1, 2, "assistant", "</s>~1"), (1, 3, "assistant", None), (1, 4, "we]ird", "<turn>"),
    (2, 0, "assistant", "only"), (3, 0, None, "x"), (3, None, "system", "first"), (4, 0, "user", ""), (None, 0, "user", "no id"), (5, 1, "user", "same"), (5, 1, "user", "same"),
    (6, 0, "user", "b"), (6, 0, "user", "[a"), (6, 0, "user", "~"), (6, 0, "[x", "c"), (6, None, None, None), (7, 3, "assistant", ""), (7, 3, "assistant", "é😀" * 700),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, blocks int")
    made = CH.format_chat(df)
    rows = made.select("conv_id", "formatted", CH.read_turns(F.col("formatted")).alias("back"), CH.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in rows:
        own = sorted((t for t in TURNS if t[0] == r["conv_id"]), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(b["role"], b["text"]) for b in r["back"]] == [(t[2] or "", t[3] or "") for t in own]
        assert r["loss"] == "".join(t[3] or "" for t in own if t[2] == "assistant")
        n_blocks = 1 + sum(a[2] != b[2] for a, b in zip(own, own[1:], strict=False))
        assert r["formatted"].count(CH.BEGIN) == n_blocks
    assert CH.format_chat(df.where("false")).count() == 0


def test_a_long_conversation(spark):
    """20,000 turns of one conversation, in shuffled rows, come back as they are."""
    turns = [(1, i, ("user", "assistant", "assistant")[i % 3], f"t{i} " + "x[" * (i % 40)) for i in range(20_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    made = CH.format_chat(df)
    r = made.select(CH.read_turns(F.col("formatted")).alias("back"), CH.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted", "loss_spans").first()
    assert [tuple(b) for b in r["back"]] == [t[2:] for t in turns]
    assert r["loss"] == "".join(t[3] for t in turns if t[2] == "assistant")
    some = r["loss_spans"][777]
    assert r["formatted"][some["start"] : some["start"] + some["length"]].replace("~1", "[") == [t[3] for t in turns if t[2] == "assistant"][777]


@given(st.lists(st.integers(0, 9), max_size=70))
@settings(max_examples=15, deadline=None)
def test_sums_before(spark, lengths):
    got = spark.createDataFrame([(lengths,)], "x array<int>").select(CH._before(F.col("x"))).first()[0]
    assert got == [sum(lengths[:i]) for i in range(len(lengths))]


@given(st.text(alphabet="~0123[]<>/INST:turns", max_size=40))
@settings(max_examples=40, deadline=None)
def test_escape(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    coded, back = df.select(CH.escape(F.col("t")), CH.unescape(CH.escape(F.col("t")))).first()
    assert back == text and not set("[]<") & set(coded)


# --- url filters ---------------------------------------------------------------

RULES = [U.Rule("allow", "org/"), U.Rule("block", "example.org/es/"), U.Rule("block", "com/de/"), U.Rule("allow", "com/fr/")]


def test_rules(spark):
    said = ["https://A.Example.ORG/es/x?q", "http://example.org", "ftp://a.com/de/1#f", "http://b.net/x", None, "no scheme", "http://notexample.org/es/", "x://example.org/es"]
    df = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(said)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.filter_urls(df, RULES).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "", None, "allow")
    assert got[2] == ("a.com", "/de/1", "com/de/", "block")
    assert got[3] == ("b.net", "/x", None, "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("notexample.org", "/es/", "org/", "allow")
    assert got[7] == ("example.org", "/es", "org/", "allow")
    assert U.filter_urls(df.where("false"), RULES).count() == 0


LINK = '<link rel="canonical" href="{}">'.format
REFRESH = '<meta http-equiv="refresh" content="0; url={}">'.format
ALIASES = [
    (1, "http://a.net/p", LINK("https://a.com/de/p")), (2, "http://b.net/q", REFRESH("http://a.net/p")), (3, "http://c.net/r", LINK("/s")),
    (4, "http://www.c.net/s/", LINK("http://x.org/")), (5, "http://d.org/z", LINK("http://a.net/p")), (6, "http://e.net/only", ""),
    (7, "https://m.b.net/q?utm_source=1#x", None), (8, "http://b.net/q#part", None), (9, None, LINK("http://a.net/p")), (10, "no scheme", LINK("http://a.net/p")),
    (11, "http://a.com/de", None), (12, "http://a.com/de/", None), (2, "http://b.net/q", REFRESH("http://a.net/p")), (None, "http://b.net/q", "x"),
    (13, "http://f.net/d/p", LINK("../../q/./r?x=../y#z")), (14, "http://f.net/q/r?x=../y", REFRESH("//a.com/de/deep")), (15, "http://g.net/", LINK("#top")),
    (16, "http://h.net/a", LINK("http://i.com/fr/x")), (17, "http://j.net/b", LINK("http://h.net/a")), (18, "http://k.net", LINK("page")), (19, "http://k.net/page", LINK("?id=1")),
    (20, "http://k.net/page?id=1", LINK("mailto:x@y.z") + LINK("https://example.org/es/1")),
]


def test_redirects_carry_blocks(spark):
    """Blocks go on to aliases, however many links away; other spellings of an address are no aliases."""
    df = spark.createDataFrame(ALIASES, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(df.where("page_id != 5 or page_id is null"), RULES).collect()}
    blocked = {1, 2, 8, None, 12, 13, 14, 18, 19, 20}
    assert {i for i, v in got.items() if v == "block"} == blocked
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(df, RULES).collect()}
    assert {i for i, v in got.items() if v == "block"} == blocked - {1, 2, 8, None}  # an explicit allow goes first
    more = spark.createDataFrame([("http://e.net/only", "http://z.com/de/")], "src string, dst string")
    assert {r["page_id"]: r["verdict"] for r in U.filter_urls(df, RULES, more).collect()}[6] == "block"


def test_long_chains_and_pages(spark):
    """A chain of 300 redirects to a blocked address, in pages of 200,000 characters; an address of 50,000."""
    filler = "<p>" + "x" * 200_000 + "</p>"
    rows = [(i, f"http://n{i}.net/", filler * (i % 50 == 0) + REFRESH(f"http://n{i + 1}.net/")) for i in range(300)]
    rows += [(300, "http://n300.net/", LINK("http://q.com/de/x")), (301, "http://l.com/de/" + "a" * 50_000, None), (302, "http://l.net/" + "a" * 50_000, LINK("http://l.com/de/"))]
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert set(got.values()) == {"block"} and len(got) == 303


def test_relative_targets(spark):
    link = '<link rel="canonical" href="{}">'.format
    said = ["page.html", "../x", "?id=1", "./y/../z?u=http://q.net/..", "/s/./t", "mailto:a@b.c", "#top", "//d.net/e", "..", "../../../v", "/go?u=http://q.net"]
    df = spark.createDataFrame([(link(x),) for x in said] + [("none",)], "html string")
    base = "http://a.net/b/c/d?x=/1"
    got = [r[0] for r in df.select(U.page_links(F.lit(base), F.col("html"))).collect()]
    root = "http://a.net"
    assert got == [
        [f"{root}/b/c/page.html"], [f"{root}/b/x"], [f"{root}/b/c/d?id=1"], [f"{root}/b/c/z?u=http://q.net/.."], [f"{root}/s/t"], [], [],
        ["http://d.net/e"], [f"{root}/b/"], [f"{root}/v"], [f"{root}/go?u=http://q.net"], [],
    ]
    assert df.limit(1).select(U.page_links(F.lit(root), F.col("html"))).first()[0] == [f"{root}/page.html"]
    rows = [(1, "http://a.net/b/p", link("../de/q")), (2, "http://a.net/de/q", link("http://x.com/de/"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in U.filter_urls(pages, RULES).collect()} == {1: "block", 2: "block"}


# --- toxicity --------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(4)
    plain, bad, worse = [f"p{i}" for i in range(300)], ["idiot", "trash", "scum"], ["vile", "hateful"]
    rows, labels = [], []
    for i in range(1500):
        insult, severe = rng.random() < 0.2, False
        w = list(rng.choice(plain, 60))
        if insult:
            w[rng.integers(0, 60)] = f"{rng.choice(bad)}.".capitalize()
            severe = rng.random() < 0.5
            if severe:
                w[rng.integers(0, 60)] = rng.choice(worse)
        rows.append((i, " ".join(w), 0))
        labels.append((i, int(insult), int(severe)))
    docs = spark.createDataFrame([*rows, (None, "idiot", 0), (9999, None, 0), (9998, "", 0)], "doc_id long, text string, toxic int")
    known = spark.createDataFrame([r for r in labels if r[0] < 1000] + [(None, 1, 1), (5, None, 1)], "doc_id long, insult int, severe int")
    chain = T.train(docs, known, (T.Category("insult", "insult"), T.Category("severe", "severe")), most=900)
    assert chain.models[1].earlier.shape == (1,)
    got = {r["doc_id"]: (r["insult"], r["severe"]) for r in T.score(docs, chain).collect()}
    assert len(got) == 1503
    held = [r for r in labels if r[0] >= 1000]
    assert np.mean([got[i] == (bool(a), bool(b)) for i, a, b in held]) > 0.97
    assert not got[9999][0] and not got[9998][0]
    assert T.score(docs.where("false"), chain).count() == 0
    nothing = T.train(docs, known.where("false"), (T.Category("insult", "insult"),))
    assert not any(r["insult"] for r in T.score(docs.limit(20), nothing).collect())


def test_three_categories_scored_in_plain_python(spark):
    """A chain of three kinds of toxicity, the last of which follows from the two before; scores anew, word by word."""
    rng = random.Random(11)
    plain, kinds = [f"p{i}" for i in range(200)], {"insult": ["idiot", "scum"], "threat": ["hurt", "kill"]}
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(40)]
        held = {k: rng.random() < 0.3 for k in kinds}
        for k, words in kinds.items():
            if held[k]:
                w[rng.randrange(40)] = rng.choice(words).upper() + rng.choice(["", "!", "é"][:2])
        rows.append((i, " ".join(w)))
        labels.append((i, int(held["insult"]), int(held["threat"]), int(held["insult"] and held["threat"])))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "one-two IDIOT\nkill kill é")], "doc_id long, text string")
    known = spark.createDataFrame(labels[:900], "doc_id long, insult int, threat int, severe int")
    chain = T.train(docs, known, tuple(T.Category(c, c) for c in ("insult", "threat", "severe")))
    assert [len(m.earlier) for m in chain.models] == [0, 1, 2] and all(chain.models[2].earlier > 0)

    def plain_scores(text: str | None) -> list[float]:
        words = {w for w in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())}
        places = {int(hash_words([w], T._APART)[0][0] >> np.uint64(64 - T.BITS)) for w in words}
        p: list[float] = []
        for m in chain.models:
            z = sum(m.words[b] for b in places) + sum(v * q for v, q in zip(m.earlier, p, strict=True)) + m.bias
            p.append(1 / (1 + np.exp(-min(max(z, -30), 30))))
        return p

    got = {r["doc_id"]: r for r in T.score(docs, chain).collect()}
    for i, text in [*rows, (5000, None), (5001, "one-two IDIOT\nkill kill é")]:
        wanted = plain_scores(text)
        assert np.allclose([got[i][f"p_{c.name}"] for c in chain.categories], wanted, atol=1e-9)
        assert [got[i][c.name] for c in chain.categories] == [p >= m.threshold for p, m in zip([got[i][f"p_{c.name}"] for c in chain.categories], chain.models, strict=True)]
    held = labels[900:]
    assert np.mean([got[i]["severe"] == bool(s) for i, _, _, s in held]) > 0.97 and got[5001]["severe"] and not got[5000]["severe"]


def test_later_models_learn_from_out_of_fold():
    buckets, at = T.word_buckets([f"w{i % 7} v{i % 5}".encode() for i in range(200)])
    y = np.array([[i % 7 == 0, i % 7 == 0] for i in range(200)]).astype(int)
    chain = T.fit_chain(buckets, at, y, np.arange(200) % T.FOLDS, (T.Category("a", "a"), T.Category("b", "b")))
    p = T.predict(chain, buckets, at)
    assert ((p[:, 1] > 0.5) == (y[:, 1] == 1)).all() and chain.models[1].earlier[0] > 0
    # the second model sees the first one's probabilities
    second, sums = chain.models[1], T._sums(chain.models[1].words, buckets, at)
    assert np.allclose(p[:, 1], 1 / (1 + np.exp(-(sums + p[:, 0] * second.earlier[0] + second.bias))))


def test_chain_of_the_tables(spark):
    """Recall and precision of the toxic category on documents that the chain was not fitted on."""
    from tessera.llm.queries import CATEGORIES

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    whole = T.train(docs, labels, CATEGORIES).held_out[1]
    assert whole[0] >= 0.85 and whole[1] >= 0.9  # out-of-fold precision and recall
    chain = T.train(docs, labels.where("doc_id % 4 != 0"), CATEGORIES)
    judged = {r["doc_id"]: r["toxic"] for r in T.score(docs.join(labels.where("doc_id % 4 = 0").select("doc_id"), "doc_id", "left_semi"), chain).collect()}
    rest = [r for r in labels.where("doc_id % 4 = 0").collect() if r["doc_id"] in judged]
    toxic, found = [r for r in rest if r["toxic"]], [r for r in rest if judged[r["doc_id"]]]
    assert sum(judged[r["doc_id"]] for r in toxic) >= 0.88 * len(toxic)  # of three quarters of some 4,000 labels, one in twenty of them wrong
    assert sum(r["toxic"] for r in found) >= 0.88 * len(found)


def test_training_is_bounded(spark, monkeypatch):
    """Rows that repeat a labelled id reach the driver once, and words that no model may use not at all."""
    rows = [(i % 40, f"w{i % 2} common word{i}", 0) for i in range(4000)] + [(50, " ".join(f"q{j}" for j in range(60_000)), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, bad int")
    seen = {}
    fit = T.fit_chain
    monkeypatch.setattr(T, "fit_chain", lambda buckets, at, marks, folds, cats: seen.update(n=len(marks), buckets=len(buckets)) or fit(buckets, at, marks, folds, cats))
    T.train(docs, labels, (T.Category("bad", "bad"),))
    assert seen["n"] == 41 and seen["buckets"] <= 80


# --- decontamination ---------------------------------------------------------------

ITEM = "If Tom has 5 apples and Mary gives Tom 3 kg more then how many apples has Tom now in all"


def test_leaks(spark, docs, no_docs):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "too short"), (3, None), (4, "plain words that nobody says in this very order"), (5, " ")], "item_id long, text string")
    other = ITEM.replace("Tom", "Bob").replace("Mary", "Jane").replace("5", "17").replace("3 kg", "4 lb")
    rows = [
        (1, f"before it: {ITEM} and after"), (2, f"a b {other} c"), (3, other.replace("has Bob now", "has Sue now")), (4, ITEM.replace("apples", "pears")),
        (5, None), (6, ""), (None, ITEM), (7, "x " * 50), (8, ITEM[:50]),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    assert sorted((r["doc_id"], r["item_id"]) for r in D.leaks(df, bench).collect()) == [(1, 1), (2, 1)]
    left = [r["doc_id"] for r in D.decontaminate(df, bench).collect()]
    assert sorted(x or 0 for x in left) == [0, 3, 4, 5, 6, 7, 8]
    assert D.leaks(docs, bench).count() == 0 and D.leaks(no_docs, bench).count() == 0 and D.leaks(df, bench.where("false")).count() == 0


def test_items_without_windows(spark):
    """Items of a few words, of one word, and of numbers alone are looked for by their plain words."""
    bench = spark.createDataFrame([(1, "buys 3 more"), (2, "photosynthesis"), (3, "12 + 30"), (4, "1 2 3 4 5 6"), (5, "")], "item_id long, text string")
    said = ["he buys 3 more", "now he buys 9 more of it", "Photosynthesis is", "so 12 + 30 is", "so 13 + 30 is", "0 1 2 3 4 5 6 7", "1 2 3 4 6 5", "buys more", "", "photosyntheses"]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in D.leaks(df, bench).collect()) == [(0, 1), (1, 1), (2, 2), (3, 3), (5, 4)]


def brute_leaks(docs: dict[int, str | None], items: dict[int, str], share: float = 0.8) -> set[tuple[int, int]]:
    """Every document against every item, word by word, in plain Python."""
    import itertools

    import regex

    inside = regex.compile(r"\p{Lu}(?<=[\p{Ll}\d,;:] .)\p{Ll}[\p{L}\p{M}'’-]*")
    anywhere = regex.compile(r"\p{Lu}(?<![\p{L}\p{M}\d'’-].)\p{Ll}[\p{L}\p{M}'’-]*")
    spelled = regex.compile(D._SPELLED)

    def read(text: str) -> dict[str, tuple[list[str], list[str]]]:
        o = WORD.findall(text.replace("\x01", ""))
        m = regex.sub(r"\d+(?:[.,:/]\d+)*", "\x01d", " ".join(o))
        m = spelled.sub("\x01d", m)
        m = regex.sub(rf"(?i)\x01d(\x20?)(?:{D.UNITS})(?![\p{{L}}\p{{M}}\d])", "\x01d\\1\x01u", m)
        t, a, plain = (x.lower().split(" ") for x in (inside.sub("\x01n", m), anywhere.sub("\x01n", m), m))
        one, of = [], []
        for w, x in zip(a, o, strict=True) if o else ():
            if one and one[-1].endswith("\x01n") and w.startswith("\x01n"):
                one[-1] += w[2:]
                of[-1] += " " + x
            else:
                one.append(w)
                of.append(x)
        return {"t": (t, o), "a": (a, o), "l": (plain, o), "m": (one, of), "r": ([x.lower() for x in o], o)}

    literal = lambda v: sum("\x01" not in w for w in v)
    out = set()
    for item, text in items.items():
        r = read(text)
        if not r["r"][0]:
            continue
        width = min(5, len(r["t"][0]))
        cut = lambda c, q, w: tuple(c[q : q + w])
        known: dict[tuple, list] = {}
        n: dict[str, set] = {"strict": set(), "any": set(), "literal": set(), "merged": set(), "raw": set()}
        rows = []
        for q in range(len(r["t"][0]) - width + 1):
            ways = set(itertools.product(*[{r[c][0][q + j] for c in "tal"} for j in range(width)]))
            for v in ways:
                if literal(v) >= 2:
                    strict, named = v == cut(r["t"][0], q, width), v == cut(r["a"][0], q, width)
                    n["strict"] |= {q} if strict else set()
                    n["any"] |= {q} if named else set()
                    n["literal"] |= {q} if v == cut(r["l"][0], q, width) else set()
                    rows.append((q, v, strict, literal(cut(r["a"][0], q, width)) >= 2))
        size = len(n["any"]) or len(n["literal"])
        for q, v, strict, usable in rows:
            known.setdefault(("text", v), []).append((q, strict, usable or not n["any"], cut(r["t"][1], q, width)))
        wide = min(5, len(r["m"][0]))
        for q in range(len(r["m"][0]) - wide + 1):
            if literal(v := cut(r["m"][0], q, wide)) >= 2:
                n["merged"].add(q)
                known.setdefault(("merged", v), []).append((q, False, True, cut(r["m"][1], q, wide)))
        if not known:
            for q in range(len(r["r"][0]) - width + 1):
                n["raw"].add(q)
                known.setdefault(("raw", cut(r["r"][0], q, width)), []).append((q, False, True, ()))
        for doc, body in docs.items():
            found: dict[tuple, tuple[set, set]] = {}
            for reading, (said, words) in read(body or "").items():
                mode = {"m": "merged", "r": "raw"}.get(reading, "text")
                for w in {len(v) for k, v in known if k == mode}:
                    for p in range(len(said) - w + 1):
                        v = cut(said, p, w)
                        for q, strict, usable, held in known.get((mode, v), ()):
                            pairs = {(held[j].lower(), words[p + j].lower()) for j in range(w) if "\x01" in v[j]} if held else set()
                            sides = ["strict"] * (strict and reading == "t") + ["any" if mode == "text" else mode] * usable
                            for s in sides:
                                at = found.setdefault((s, p - q), (set(), set()))
                                at[0].add(q)
                                at[1].update(pairs)
            matched: dict[str, set] = {}
            for (s, _), (qs, pairs) in found.items():
                if len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
                    matched.setdefault(s, set()).update(qs)
            counts = {"strict": len(n["strict"]), "any": size, "merged": len(n["merged"]), "raw": len(n["raw"])}
            if any(len(qs) >= share * counts[s] for s, qs in matched.items()):
                out.add((doc, item))
    return out


def problems(seed: int = 6, many: int = 40) -> list[tuple[str, list[str]]]:
    """Invented word problems, each with the texts that ask it with other names, numbers, units, capitals and white space."""
    import random

    rng = random.Random(seed)
    names = "Tom Anna Weng Maria Bob Ines Carl Jane Omar Lucy Pavel Mei".split()
    things = "apples pencils marbles books stamps coins cards shells ribbons tickets".split()
    verbs = "buys finds sells wins loses borrows collects paints packs sorts".split()
    places = "market school harbour station library garden museum bakery".split()
    shapes = [
        "{A} {v} {n} {t} at the {p} and {B} gives {A} {m} more on the way home, so how many {t} does {A} have in the end",
        "Every day {A} walks {n} km to the {p}. After {m} days {A} is tired. How far did {A} walk in all that time, and was {B} with {A} then?",
        "The {p} opens for {n} hours. {A} works there for {m} dollars an hour while {B} only {v} {t}. What does {A} earn more than {B} in one such day?",
        "In the {p} there are {n} boxes with {m} {t} in each of them. {A} {v} half of all of these boxes. How many single {t} are left for {B}",
    ]

    def ask(shape, words):
        a, b = rng.sample(names, 2)
        return shape.format(A=a, B=b, n=rng.randrange(2, 90), m=rng.randrange(2, 90), **words)

    out = []
    for i in range(many):
        shape, words = shapes[i % 4], {"v": rng.choice(verbs), "t": rng.choice(things), "p": rng.choice(places)}
        item = ask(shape, words)
        other = [ask(shape, words) for _ in range(4)]
        other[1] = other[1].replace(" km", " miles").replace(" hours", " minutes").replace(" dollars", " euros")
        other[2] = re.sub(r" (?=[A-Z])", "\n", other[2]).replace(" the ", "  the\t")
        other[3] = item.lower() if i % 2 else other[3].replace(" and ", "  and ")
        out.append((item, [f"Some words go before. {x} And others follow it." for x in other]))
    return out


def test_recall_of_other_parameters(spark):
    """Of 160 re-parameterised copies nine in ten or more are found, and nothing is found that plain comparison would not find."""
    made = problems()
    items = {i: item for i, (item, _) in enumerate(made)}
    docs = {100 * i + j: x for i, (_, others) in enumerate(made) for j, x in enumerate(others)}
    clean = {-1 - i: " ".join(reversed(item.split())) for i, item in items.items()}
    df = spark.createDataFrame(list({**docs, **clean}.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(df, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert len({d for d in docs if (d, d // 100) in got}) >= 0.9 * len(docs)
    assert not any(d < 0 for d, _ in got)
    assert got == brute_leaks({**docs, **clean}, items)


def test_names_of_several_words_and_spelled_numbers(spark):
    item = "Yesterday Mary walked with five dogs through the old park and then Mary told the keeper that nobody saw them there"
    said = [item.replace("Mary", "Mary Ann"), item.replace("five", "12"), item.replace("Mary", "Anna Maria Lopez").replace("five", "twenty-two"), item.replace("told", "sold").replace("park", "lane")]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = D.leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1, 2]


def test_items_met_only_as_spelled_or_merged(spark):
    """Documents that share no window with an item but with numbers in words as numbers, or names of several words as one."""
    items = {
        1: "Mary sold nine pens so Bob paid two coins and Ann gave six more to Carl",
        2: "today Mary saw red Bob eat big Ann hit old Carl kiss mad Jane fear wet Omar",
        3: "we had three cats and five dogs and seven birds in two rooms of one house",
    }
    docs = {
        1: "Mary sold 9 pens so Bob paid 2 coins and Ann gave 6 more to Carl",
        2: "today Mary Lee saw red Bob Ray eat big Ann Poe hit old Carl Orr kiss mad Jane Fox fear wet Omar Iqbal",
        3: "we had 3 cats and 5 dogs and 7 birds in 2 rooms of 1 house",
        4: "today Mary Ann Lee saw red Bob eat big Ann-Marie Poe hit old Carl kiss mad Jane fear wet Omar/Ali Iqbal",
        5: "we had 3 cats and 3 dogs and 3 birds in 3 rooms of 3 houses",
    }
    rng = random.Random(8)
    number = {"two": "2", "nine": "9", "six": "6", "three": "3", "five": "5", "seven": "seventeen", "one": "twenty-one"}
    for i in range(60):
        words = rng.choice(list(items.values())).split()
        words = [number[w] if w in number and rng.random() < 0.6 else w for w in words]
        words = [w + rng.choice(["", " Lee", " Ray Fox", "-Jo Orr"]) if w[0].isupper() and rng.random() < 0.6 else w for w in words]
        words = [w.lower() if rng.random() < 0.02 else w for w in words]
        docs[10 + i] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(df, bench).collect()}
    assert got == brute_leaks(docs, items) and {(1, 1), (2, 2), (3, 3)} <= got


def test_a_very_long_document(spark):
    item = "Mary sold nine pens so Bob paid two coins and Ann gave six more to Carl"
    long = "the cat of Ann saw 3 dogs and Bob Lee ran " * 12_000
    df = spark.createDataFrame([(1, long + item), (2, long)], "doc_id long, text string")
    assert [r["doc_id"] for r in D.leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [1]


def test_leaks_of_the_tables(spark):
    """All pairs of the smallest tables, against plain Python."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, items).collect()}
    assert got == brute_leaks({r["doc_id"]: r["text"] for r in docs.collect()}, {r["item_id"]: r["text"] for r in items.collect()}) and got


def test_common_windows_do_not_multiply(spark):
    """A window that all items have is looked up for none that has a rarer one."""
    name = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    bench = spark.createDataFrame([(i, f"please tell me what is the value of this thing called item{name(i)} and why it is not{name(i)} today") for i in range(300)], "item_id long, text string")
    keys = D._keys(D.benchmark_windows(bench), 0.8).collect()
    assert max(len(r["items"]) for r in keys) <= D.RARE
    df = spark.createDataFrame([(i, "so please tell me what is the value of this thing called love") for i in range(50)] + [(99, f"x please tell me what is the value of this thing called item{name(7)} and why it is not{name(7)} today")], "doc_id long, text string")
    assert [tuple(r)[:2] for r in D.leaks(df, bench).collect()] == [(99, 7)]


def test_large_benchmark_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    df = spark.createDataFrame([(1, ITEM), (2, "else " * 20)], "doc_id long, text string")
    assert [r["doc_id"] for r in D.leaks(df, bench).collect()] == [1]


def test_template(spark):
    df = spark.createDataFrame([("In May 12 kg of Anna Maria and 3.5km, 7 days x. The End",)], "t string")
    assert df.select(D.template(F.col("t"))).first()[0] == "in \x01n \x01d \x01u of \x01n \x01n and \x01d\x01u, \x01d \x01u x. the \x01n"


WORDS = (
    "Weng earns 12 dollars an hour for watching small children. Weng did 50 minutes of such work just yesterday evening. "
    "Weng then went home by bus with the money. Weng wants to know how much all of this came to."
)


def test_names_wherever_they_stand(spark):
    """Names at sentence and line starts, after two blanks and without capitals, on either side, and short items."""
    many = "we asked if Tom and Mary would help, since then Tom alone had to carry it and Mary only watched"
    bench = spark.createDataFrame([(1, WORDS), (2, many), (3, "name the red planet"), (4, many.replace("asked", "said").lower())], "item_id long, text string")
    said = [
        WORDS.replace("Weng", "Maria"), many.replace(" Tom", "\nTom").replace(" Mary", "\nMary"), many.replace(" Mary", "  Mary"), many.lower(),
        "Please name the red planet now", "name a red planet", many.replace("asked", "said"), WORDS.lower(), WORDS.replace("Weng then", "Maria then").replace("Weng wants", "Bob wants"),
    ]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in D.leaks(df, bench).collect()}
    assert {(0, 1), (1, 2), (2, 2), (3, 2), (4, 3), (6, 4), (7, 1)} <= set(got)
    assert not {d for d, _ in got} & {5, 8}
    assert all(got[k]["n_matched"] == got[k]["n_windows"] for k in [(0, 1), (1, 2), (2, 2), (3, 2), (4, 3), (7, 1)])


# --- quality -------------------------------------------------------------------------


def brute_counts(t: str | None) -> tuple:
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g in grams if grams.count(g) > 1} if len(grams) < 4000 else set()
    covered = {k for i, g in enumerate(grams) if g in often for k in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics(spark, docs, texts):
    more = [*texts, "a b c a b c", "a a a a a", "a b a b a b x", "x\nx\n\n x\n|#", " ".join(f"q{i}" for i in range(150)) + " " + " ".join(f"q{i}" for i in range(150))]
    df = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in Q.statistics(df).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(more)}


def test_learned_rules(spark, no_docs):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(words, 80))
        bad = i % 4 == 0
        if bad:
            w = [x + "$$" for x in w] if i % 8 else [x.upper() for x in w]
        rows.append((i, " ".join(w), "x"))
        if i < 400:
            labels.append((i, int(not bad)))
    df = spark.createDataFrame([*rows, (None, None, "x"), (9001, "", "x")], "doc_id long, text string, kept string")
    known = spark.createDataFrame([*labels, (None, 0), (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in Q.judge(df, known).collect()}
    assert len(got) == 602 and got[None]["base_failed"] and not got[9001]["kept"]
    held = [i for i in range(400, 600)]
    assert all(got[i]["kept"] for i in held if i % 4) and sum(not got[i]["kept"] for i in held if i % 4 == 0) >= 45
    assert all((r["reason"] is None) or not r["kept"] for r in got.values())
    plain = Q.judge(df, known.where("false")).where("not base_failed and not kept")
    assert plain.count() == 0
    assert Q.judge(no_docs, known).count() == 0


def test_verdicts_in_plain_python(spark):
    """Counts, base rules and the learned list of every document of the smallest tables but one, computed anew."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = Q.learn(Q.labelled_rows(docs, labels))
    for r in Q.judge(docs, labels).select(*docs.columns, *COUNTS, "base_failed", "reason", "kept").collect():
        t = r["text"] or ""
        n_words, word_chars, n_symbols, n_dup, n_repeat = counts = brute_counts_fast(t)
        assert tuple(r[c] for c in COUNTS) == counts
        base = n_words < 50 or 100 * n_repeat > 50 * n_words
        share = lambda a, b: a / b if b else 0.0
        lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
        value = {
            "n_words": n_words, "mean_word": share(word_chars, n_words), "symbol_ratio": share(n_symbols, n_words), "dup_line_ratio": share(n_dup, lines),
            "repeat_ratio": share(n_repeat, n_words), "upper_ratio": share(len(re.findall("[A-Z]", t)), word_chars),
            "mark_ratio": share(sum(not (c.isalpha() or c.isnumeric() or c in " \t\n\x0b\x0c\r.,") for c in t), word_chars),
        }
        fired = next((rule for rule in rules if all((value[c.feature] >= c.threshold) == c.above for c in rule)), None)
        assert (r["base_failed"], r["kept"]) == (base, not base and fired is None)
        assert r["reason"] == (" and ".join(map(str, fired)) if fired else None)


def brute_counts_fast(t: str) -> tuple:
    from collections import Counter

    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {k for i, g in enumerate(grams) if often[g] > 1 for k in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_statistics_of_a_long_text(spark):
    t = " ".join(f"q{i % 3001}" for i in range(60_000)) + "\n" + "\n".join(f"z{i % 5000}" for i in range(20_000))
    got = Q.statistics(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert tuple(got[c] for c in COUNTS) == brute_counts_fast(t)


def test_repeated_labels_reach_the_driver_once(spark):
    df = spark.createDataFrame([(1, f"some words here {i}") for i in range(500)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    assert [r[-1] for r in Q.labelled_rows(df, labels)] == [True, False]


def test_rules_stop_without_evidence():
    rng = np.random.default_rng(1)
    noise = [(*rng.random(len(Q.FEATURES)), bool(rng.random() < 0.3)) for _ in range(300)]
    assert Q.learn(noise) == [] and Q.learn([]) == []
