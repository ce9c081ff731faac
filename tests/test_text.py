from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import fidelity as P
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import chunking as C
from tests.conftest import rows


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_counts_use_unicode_space(spark):
    assert apply(spark, T.word_count, ["a b　c", "", None, "  x  "]) == [3, 0, 0, 1]
    assert apply(spark, T.char_count, ["a😀b", "　x ", None]) == [3, 1, 0]


@pytest.mark.parametrize(
    ("text", "kept"),
    [("write a@b.com now", "write   now"), ("x@y.org", "x@y.org"), ("(@compute)", " "), ("a@b COM", "a@b COM"), ("<A@B.COM>, ok", "  ok")],
)
def test_mask_mail(spark, text, kept):
    assert P.without_mail(text) == kept
    assert apply(spark, T.mask_mail, [text]) == [kept]


def test_low_information(spark):
    said = ["Thanks!", "收到，谢谢", "the and of", "12.5 -- 7", "Please quote model A", "", None, "ok"]
    assert apply(spark, T.is_low_information, said) == [True, True, True, True, False, True, True, True]


def test_chunk_quality_counts_runs_of_letters(spark):
    """Runs of two Latin letters count beside other letters and digits too, as the SQL of low_info_flag has it."""
    long = " 1234567890" * 10
    said = ["éab ébc écd éde éef" + long, "1ab2bc3cd4de5ef" + long, "éab ébc écd éde" + long, "ab bc cd de ef", None]
    assert apply(spark, T.passes_chunk_quality, said) == [True, True, False, False, None]


def test_overlay_and_urls(spark):
    text = "keep\nDocument Was Downloaded By X\nJUNE 3, 2019 - UL 1598\nend"
    assert apply(spark, T.drop_overlay, [text]) == ["keep\nend"]
    assert apply(spark, T.strip_urls, ["see HTTPS://a.b/c?d now"]) == ["see   now"]


def test_page_marks():
    assert P.page_marks("12\nUL 1598\nbody\nUL 1598\nT2\nx") == "<<<PAGE_BREAK_12>>>\nbody\n<<<PAGE_BREAK_T2>>>\nx"


def test_labels(spark):
    assert apply(spark, T.page_label, ["7", "t2", "0012"]) == ["0007", "T2", "0012"]
    assert apply(spark, T.page_number, ["7", "T2"]) == [7, None]
    assert apply(spark, T.standard_number, ["s1598A_2", "other"]) == ["1598A", "other"]
    heads = ["UL 1598", "NMX-J-307 UL 8", "CSA C22 UL 8", "ANSI UL 9", "2020 National Electrical Code Handbook", "UL"]
    assert apply(spark, T.is_standard_header, heads) == [True] * 5 + [False]


def test_sanitized_columns_agree(spark):
    rng = random.Random(4)
    bits = ["null", "NUL/", "a@b.com", "<x@y.COM>", "||", "| ", "\n|\n", "  ", "--", "++", "...", "..", "__", "***", "end.Next", "http://q.r/s", "ﬁ", "Ａ", "“x”", "\u200b", "─━", "ͺͺ", "é", "\xa0", "…", "w", "\x91", "　　", "\r\n", "$1"]
    said = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, ""]
    assert apply(spark, P.sanitized, said) == [None if t is None else P.sanitize(t) for t in said]


def test_sanitize():
    assert P.sanitize("ＡＢ“x”  a@b.com  see https://q.r/s  end.Next ... -- *bold*") == "AB\"x\" see end. Next .. - bold"
    assert P.sanitize("ﬁne ​ok") == "fine ok"


def test_file_names(spark):
    assert P.file_name("a/b:c?. ") == "a・b・c・"
    assert P.file_name("con") == "con_"
    assert P.file_name("...") == "untitled"
    assert P.file_name("x" * 60, 50) == "x" * 50
    assert apply(spark, T.short_name, ["/d/abcdefghijklmnopqrstuvwxyz_p.md", "short.txt"]) == ["abcdefghijklmnopqrst..._p.md", "short.txt"]


def test_merge_overlaps():
    assert P.merge_overlaps(["the quick brown", "brown fox"]) == "the quick brown fox"
    assert P.merge_overlaps(["ab", "cd"]) == "abcd"


@given(st.text(max_size=30))
@settings(max_examples=50, deadline=None)
def test_imap_names_round_trip(name):
    assert P.imap_decode(P.imap_encode(name)) == name


def test_assignments():
    text = "self.salesperson='a'\nself.company='b'\nself.customer='c'\nself.x_studio_customer_po_number='d'\nself.order_lines=[{'q': 1}]"
    assert P.assignments(text)["order_lines"] == [{"q": 1}]
    with pytest.raises(ValueError, match="missing"):
        P.assignments("self.company='b'")


def test_html_and_xml(spark):
    assert P.html_text("<p>a<script>x</script></p><p>b &amp; c</p>") == "a\nb & c"
    assert P.xml_text("<tt><p>one</p><p> two </p></tt>") == "one\ntwo\n"
    body = "<div>a</div>" * 8 + "<blockquote>q</blockquote>"
    assert apply(spark, P.needs_quotes, [body, "> x\n" + body, "<blockquote>"]) == [True, False, False]
    assert apply(spark, P.flatten_quotes, [body, "a<br>b<i\n>c</i>&lt;u&gt;d"]) == ["a\n" * 8 + "q", "a\nbcd"]
    deep = lambda c: P.flatten_quotes(c, track_depth=True)
    assert apply(spark, deep, [body, "</blockquote>x<blockquote>y<BLOCKQUOTE a='1'> z </blockquote>\n</blockquote>w"]) == ["a\n" * 8 + "> q", "x\n> y\n>> z\nw"]


def test_routes_and_subjects(spark):
    df = spark.createDataFrame([("IEC certificate needed", ""), ("Rita request", ""), ("pricing follow-up", "")], "s string, b string")
    assert [r[0] for r in df.select(T.route(F.col("s"), F.col("b"), "rita")).collect()] == ["safety", "rita", "unknown"]
    df = spark.createDataFrame([("Re: re: offer [ALI:v2]", 3), ("", 1)], "s string, v int")
    assert [r[0] for r in df.select(T.versioned_subject(F.col("s"), F.col("v"), "ALI")).collect()] == ["offer [ALI:v3]", "[ALI:v1]"]


def test_reply_text(spark):
    said = ["ok\n> old", "fine\nOn Monday A wrote:\nx", "a\nFrom: b\nTo: c", "only\nFrom: one", "a\nForwarded message\nb"]
    assert apply(spark, T.reply_text, said) == ["ok", "fine", "a", "only\nFrom: one", "a"]


def test_strip_frame(spark):
    assert apply(spark, lambda t: T.strip_frame(t, "ali"), ["Dear Bob,\n\nBody here.\n\nBest regards,\nAli", "Body\nThanks", "Body"]) == ["Body here.", "Body", "Body"]


def test_quantities(spark):
    assert apply(spark, T.quantity, ["1,000 pcs", "about -2.5", "none"]) == [1.0, -2.5, None]
    assert apply(spark, T.match_key, ["Ab-1 é!"]) == ["ab1é"]


def test_links(spark):
    assert apply(spark, T.wikilinks, ["[[A]] ![[B]] [[C|shown]]"]) == [["A", "C"]]
    assert apply(spark, T.markdown_links, ["[[A]] [t](b.md) [[A]]"]) == [["A", "b.md"]]


def test_query_variants(spark):
    found = apply(spark, lambda q: T.query_variants(q, ["PFAS"], brand="ACME"), ["Acme  lamp", "", "x"])
    assert found[0][:2] == ["Acme lamp", "Acme lamp ACME catalog product series"]
    assert found[1] == [""]
    assert len(found[2]) == 3


@pytest.mark.parametrize(
    ("url", "platform"),
    [("x.com/a", "x/twitter"), ("youtu.be/q", "youtube"), ("www.threads.com/t", "threads"), ("HTTPS://YouTube.com:443/w", "youtube"), ("notyoutube.com/w", "")],
)
def test_platforms(spark, url, platform):
    assert apply(spark, U.platform, [url]) == [platform]


def test_clean_urls(spark):
    said = [
        "https://www.youtube.com/watch?v=abc123&utm_source=x&t=10",
        "https://example.com/path?utm_source=x&fbclid=1&keep=yes&si=no",
        "https://youtube.com/watch?feature=share",
        "",
        "a.b/c#d",
    ]
    wanted = ["https://www.youtube.com/watch?v=abc123", "https://example.com/path?keep=yes", "https://youtube.com/watch", "", "https://a.b/c"]
    assert apply(spark, U.clean, said) == wanted


def test_dates(spark):
    assert apply(spark, D.mail_date, ["Mon, 5 Feb 2024 10:00:00 +0800 (HKT)"]) == ["5 Feb 2024 10:00:00"]
    said = ["2024-02-05T10:00:00+08:00", "2/5/2024", "5-feb-2024", "x"]
    assert apply(spark, D.record_datetime, said) == ["2024-02-05 02:00:00", "2024-02-05 00:00:00", "2024-02-05 00:00:00", None]
    assert apply(spark, D.epoch, ["1970-01-01T00:01:00Z"]) == [60]


@given(st.lists(st.sampled_from(["a", "b.", "c\n\n", "dd ", "e! "]), max_size=120).map(" ".join), st.integers(3, 20))
@settings(max_examples=60, deadline=None)
def test_split_keeps_words(text, most):
    parts = C.split_long(text, most)
    assert all(len(p.split()) <= most for p in parts)
    assert " ".join(parts).split() == text.split()


def test_recursive_split_and_sections():
    parts = C.recursive_split("aa bb cc dd ee", 5, 2)
    assert all(len(p) <= 5 for p in parts) and parts[0] == "aa bb"
    assert C.recursive_split("a\n\nbb\n\n\n\nccc", 4, 0) == ["a", "bb", "ccc"]
    assert C.recursive_split("abcdefghij", 4, 2) == ["abcd", "cdef", "efgh", "ghij"]
    assert C.recursive_split("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert C.recursive_split("x abcdefgh y", 4, 0, (" ",)) == ["x", "abcdefgh", "y"]
    assert C.recursive_split("", 4) == C.recursive_split(None) == C.recursive_split(" \n ") == []
    assert C.rejoin(["one two", " three.", "", "Four", "and:", "five"]) == ["one two three.", "Four and:", "five"]
    assert C.rejoin(["a" * 1200, "b", "c"]) == ["a" * 1200, "b c"]
    md = "# A\n" + "x" * 90 + "\n# B\n" + "y" * 90 + "\n```\n# no\n```"
    assert len(C.markdown_sections(md)) == 2


def test_mail_chunks(spark):
    """Each step of the chain, and lines of mails in any order through the table function."""
    words = "the order of lamps left our plant today "
    assert C.without_quote_marks("> \n>> \na\n On x a@b.c wrote:\nFrom: a@b wrote:\n> > b") == "a\n\nOn x a@b.c wrote:\nFrom: a@b wrote:\n> > b"
    assert C.mail_chunks(words * 3) == [(words * 3).strip()]
    assert C.mail_chunks(words * 2) == C.mail_chunks(">" * 200) == C.mail_chunks("12 34 " * 60) == C.mail_chunks(None) == []
    long = C.mail_chunks(words * 30, size=400, overlap=50)
    assert all(len(c) >= 100 for c in long) and long[0].startswith("the order") and sum(map(len, long)) >= len(words) * 30 - 2
    mails = {"a": (words * 40 + "\n\n" + "New part. ") * 3, "b": "short", "c": None, "d": "x\n" * 100 + words * 4}
    lines = [(k, i, line) for k, t in mails.items() for i, line in enumerate((t or "").split("\n"))] + [(None, 0, words * 5), ("c", 1, None)]
    random.Random(1).shuffle(lines)
    df = spark.createDataFrame(lines, "doc_id string, pos int, line string").repartition(5)
    found: dict[str, list] = {}
    for r in C.chunk_lines(df, size=500, overlap=60).orderBy("doc_id", "chunk").collect():
        found.setdefault(r["doc_id"], []).append((r["chunk"], r["text"]))
    wanted = {k: list(enumerate(C.mail_chunks(t, size=500, overlap=60), 1)) for k, t in mails.items()}
    assert found == {k: v for k, v in wanted.items() if v} and len(found["a"]) > 3


def test_pages(spark):
    lines = ["pre", "<<<PAGE_BREAK_1>>>", "a", "b", "<<<PAGE_BREAK_T2>>>", "c"]
    df = spark.createDataFrame([("s1_1", i, x) for i, x in enumerate(lines)], "doc_id string, pos int, line string")
    found = sorted(tuple(r) for r in C.split_pages(df).collect())
    assert found == [("s1_1", "0001", 1, "a b"), ("s1_1", "T2", None, "c")]


def test_chunk_tags(spark):
    words = lambda n: " ".join(["w"] * n)
    df = spark.createDataFrame([(1, words(10)), (2, words(11)), (3, words(501)), (4, "")], "doc_id int, text string")
    tagged = C.chunk(df)
    found = sorted((r["doc_id"], r["chunk_index"], r["chunk_total"], r["word"], r["status"]) for r in tagged.collect())
    assert found == [(1, 1, 1, 10, "dropped"), (2, 1, 1, 11, "kept"), (3, 1, 2, 500, "split"), (3, 2, 2, 1, "split"), (4, 1, 1, 0, "dropped")]


def test_split_batches_leave_in_parts(spark, monkeypatch):
    """A worker hands over the chunks of some texts before it splits the next ones."""
    import pyarrow as pa

    monkeypatch.setattr(C, "PART", 10)
    made = []
    run = C.split_udf(lambda t: made.append(t) or (t or "").split()).func
    parts = run(iter([pa.array(["a b c d e f", "g h", None, "", "i j k l m"])]))
    assert next(parts).to_pylist() == [["a", "b", "c", "d", "e", "f"]] and len(made) == 1
    assert [p.to_pylist() for p in parts] == [[["g", "h"], [], [], ["i", "j", "k", "l", "m"]]]
    texts = ["a b c d e f", None, "g h", "", "i j k l m n"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(2)
    assert rows(df.select("i", C.split_udf(lambda t: (t or "").split())(F.col("t")).alias("s")), "i") == [(i, (t or "").split()) for i, t in enumerate(texts)]


def test_assignments_are_read_once(monkeypatch):
    from tessera.plans import cases

    seen, whole = [], P.assignments
    monkeypatch.setattr(P, "assignments", lambda t: seen.append(t) or whole(t))
    code = "self.salesperson='a'\nself.company='b'\nself.customer='c'\nself.x_studio_customer_po_number='d'\nself.order_lines=[{'q': 3}]\nother = 1"
    assert cases._shown(code) == "a|3" and len(seen) == 1
