from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as S
from tessera.streaming import grid as G
from tessera.streaming import review as V
from tessera.streaming import watch as W
from tests.conftest import rows

ORDERS = "array<struct<side:string,price:double>>"


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id": "1", "word": 2, "text": "x"}\nnot json\n', encoding="utf-8")
    df = S.read_jsonl(spark, str(tmp_path / "a.jsonl")).cache()
    assert rows(df.where("_corrupt is null").select("doc_id", "word", "text")) == [("1", 2, "x")]
    good, bad = S.parse_jsonl(spark.read.text(str(tmp_path / "a.jsonl")))
    assert good.count() == 1 and rows(bad.select("line", "reason")) == [("not json", "invalid")]
    S.write_jsonl(good.select("text", "doc_id"), str(tmp_path / "out"))
    line = next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8").strip()
    assert list(json.loads(line)) == ["doc_id", "text"]


def test_texts_and_matrix(spark, tmp_path):
    (tmp_path / "g.txt").write_bytes("中文".encode("gbk"))
    assert rows(S.read_texts(spark, str(tmp_path / "g.txt")).select("text")) == [("中文",)]
    (tmp_path / "m.csv").write_text("1,2\n3,4\n")
    assert rows(S.read_matrix(spark, str(tmp_path / "m.csv")), "y", "x") == [(0, 0, 1.0), (1, 0, 2.0), (0, 1, 3.0), (1, 1, 4.0)]


def test_mbox_and_attachments(spark, tmp_path):
    mail = (
        "From a@b Thu Jan  1 00:00:00 2024\nMessage-ID: <1@x>\nSubject: s\nFrom: a@b\nTo: c@d\nMIME-Version: 1.0\n"
        'Content-Type: multipart/mixed; boundary="q"\n\n--q\nContent-Type: text/plain\n\nhello\n--q\nContent-Type: text/plain\n'
        'Content-Disposition: attachment; filename="n.txt"\n\nnote\n--q--\n\nFrom a@b Thu Jan  1 00:00:00 2024\nSubject: no id\n\nx\n'
    )
    (tmp_path / "a.mbox").write_text(mail)
    mails = S.read_mbox(spark, str(tmp_path / "a.mbox")).cache()
    assert [(r[0], r[1].strip()) for r in mails.select("message_id", "body").collect()] == [("1@x", "hello")]
    found = rows(S.parse_attachments(mails, {".txt": lambda b: [b.decode().strip()]}).select("name", "page", "text", "error"))
    assert found == [("n.txt", 1, "note", None)]

    def broken(_):
        raise ValueError("bad")

    assert rows(S.parse_attachments(mails, {".txt": broken}).select("error")) == [("ValueError: bad",)]


def test_mailboxes_are_read_in_parts(spark, tmp_path):
    """A mailbox of many mails, with splits that fall anywhere; lines of a body that begin otherwise stay."""
    mail = "From a@b Thu Jan  1 00:00:00 2024\nMessage-ID: <{0}@x>\nSubject: s {0}\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\nhello é {0}\n>From here\n From there\n\n"
    (tmp_path / "big.mbox").write_text("".join(mail.format(i) for i in range(3000)), encoding="utf-8")
    (tmp_path / "small.mbox").write_text("From a@b\nSubject: no id\n\nx\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        mails = S.read_mbox(spark, str(tmp_path))
        assert mails.rdd.getNumPartitions() > 4
        found = mails.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(int(r["message_id"].split("@")[0]) for r in found) == list(range(3000))
    assert all(r["body"].strip() == f"hello é {r['subject'][2:]}\n>From here\n From there" and r["path"].endswith("big.mbox") for r in found)


def test_small_helpers(spark):
    df = spark.createDataFrame([('* 7 FETCH (UID 42 FLAGS (\\Seen \\Flagged) INTERNALDATE "01-Jan-2024")',)], "l string")
    got = df.select(S.imap_header(F.col("l")).alias("h")).select("h.*").first()
    assert tuple(got) == (42, ["\\Seen", "\\Flagged"], "01-Jan-2024")
    assert S.merged({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": 3}, "d": [2]}) == {"a": {"b": 3, "c": 2}, "d": [2]}
    assert S.insert_link("a\n---\nb", "L") == "a\n---\n[[L]]\nb"
    assert S.artifact(["m.sqlite", "m.index"], "m") == ("m.sqlite", "m.index")
    with pytest.raises(ValueError, match="2 files"):
        S.artifact(["m.sqlite", "m2.sqlite"], "m")
    both = df.select(S.overlay(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"))).alias("m")).first()[0]
    assert both == {"a": "2"}


def test_sheets_and_ocr(spark):
    cells = spark.createDataFrame([("f", "B", 0, 0, "x"), ("f", "A", 0, 0, "1"), ("f", "A", 0, 1, None), ("f", "A", 1, 0, "2")], "file string, sheet string, row int, col int, value string")
    assert rows(S.sheet_text(cells))[0][1] == "=== Sheet: A ===\n1\t\n2\n=== Sheet: B ===\nx"
    df = spark.createDataFrame([("", "y" * 5), ("a" * 40, "b" * 70), ("a" * 60, "b" * 70)], "raw string, ocr string")
    assert [r[0][:1] for r in df.select(S.choose_ocr(F.col("raw"), F.col("ocr"))).collect()] == ["y", "b", "a"]


def test_ledger(spark):
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "uid string")
    ledger = spark.createDataFrame([("a", "success", None), ("b", "failed", "x")], "uid string, status string, error string")
    assert rows(S.pending(work, ledger, "uid"), "uid") == [("b",), ("c",)]
    new = spark.createDataFrame([("b", "success", "e" * 600)], "uid string, status string, error string")
    after = rows(S.record(ledger, new, "uid").select("uid", "status", F.length("error")), "uid")
    assert after == [("a", "success", None), ("b", "success", 500)]


@pytest.mark.parametrize(
    ("orders", "mode"),
    [
        ([("BUY", 59500.0), ("SELL", 60500.0)], "PAIR"), ([("SELL", 60500.0), ("BUY", 59500.0)], "PAIR"), ([("BUY", 1.0)], "BUY_ONLY"),
        ([("SELL", 1.0)], "SELL_ONLY"), ([], "ABNORMAL"), ([("BUY", 1.0), ("BUY", 2.0)], "ABNORMAL"), ([("SELL", 1.0), ("SELL", 2.0)], "ABNORMAL"),
        ([("BUY", 60500.0), ("SELL", 59500.0)], "ABNORMAL"), ([("BUY", 59000.0), ("SELL", 60500.0)], "ABNORMAL"), ([("HOLD", 1.0)], "ABNORMAL"),
        ([("sell", 1.0)], "ABNORMAL"), ([("BUY", 1.0)] * 3, "ABNORMAL"),
    ],
)
def test_order_modes(spark, orders, mode):
    df = spark.createDataFrame([(orders,)], f"orders {ORDERS}")
    assert df.select(G.classify(F.col("orders"))["mode"]).first()[0] == mode


PAIR = ("PAIR", 59500.0, 60500.0)
CASES = [
    (PAIR, ("BUY_ONLY", 59500.0, None), 1, "rebuild", 60500.0), (PAIR, ("SELL_ONLY", None, 60500.0), 1, "rebuild", 59500.0), (PAIR, PAIR, 2, "keep", None),
    (PAIR, ("ABNORMAL", None, None), 0, "abnormal", None), (PAIR, ("PAIR", 60000.0, 61000.0), 2, "abnormal", None),
    (("BUY_ONLY", 59500.0, None), ("ABNORMAL", None, None), 0, "rebuild", 59500.0), (("BUY_ONLY", 59500.0, None), ("BUY_ONLY", 1.0, None), 1, "keep", None),
    (("BUY_ONLY", 59500.0, None), ("SELL_ONLY", None, 1.0), 1, "abnormal", None), (("BUY_ONLY", 59500.0, None), PAIR, 2, "abnormal", None),
    (("SELL_ONLY", None, 60500.0), ("ABNORMAL", None, None), 0, "rebuild", 60500.0), (("SELL_ONLY", None, 60500.0), ("SELL_ONLY", None, 1.0), 1, "keep", None),
    (("SELL_ONLY", None, 60500.0), ("BUY_ONLY", 1.0, None), 1, "abnormal", None), (("SELL_ONLY", None, 60500.0), PAIR, 2, "abnormal", None),
]


def test_cycle_decisions(spark):
    s = "struct<mode:string,buy_price:double,sell_price:double>"
    df = spark.createDataFrame([(i, a, b, n) for i, (a, b, n, *_) in enumerate(CASES)], f"i int, saved {s}, live {s}, n int")
    got = [tuple(r[0]) for r in df.orderBy("i").select(G.decide(F.col("saved"), F.col("live"), F.col("n"))).collect()]
    assert got == [(action, price) for *_, action, price in CASES]
    assert [G.step(a, b, n) for a, b, n, *_ in CASES] == got


def test_responses(spark):
    said = [
        '{"response": {"data": {"statuses": [{"resting": {"oid": 1}}]}}}', '{"response": {"data": {"statuses": [{"error": "Insufficient spot balance x"}]}}}',
        '{"response": {"data": {"statuses": []}}}', '"text"', '{"response": {"data": {"statuses": [{"odd": 1}]}}}',
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, r string")
    assert [r[0] for r in df.orderBy("i").select(G.response(F.col("r"))).collect()] == ["ok", "insufficient_spot_balance", "error", "error", "error"]


def test_grid_stream(spark, tmp_path):
    pair, buy, none = [("BUY", 59500.0), ("SELL", 60500.0)], [("BUY", 59500.0)], []
    df = spark.createDataFrame([("a", 1, pair), ("a", 2, pair), ("a", 3, buy), ("a", 4, none), ("b", 1, buy), ("b", 2, none)], f"account string, seq long, orders {ORDERS}")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = G.decisions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("grid").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = rows(spark.table("grid").select("account", "seq", "action", "rebuild_price"), "account", "seq")
    assert got == [("a", 1, "start", None), ("a", 2, "keep", None), ("a", 3, "rebuild", 60500.0), ("a", 4, "abnormal", None), ("b", 1, "start", None), ("b", 2, "rebuild", 59500.0)]


def test_watch_stage(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    (folder / "a_p.txt").write_text("skip")

    def once(work):
        stream = W.watch(spark, str(folder), (".txt",), ("_p.txt",))
        W.run_stage(stream, work, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)

    text = lambda df: df.select(F.decode("content", "UTF-8").alias("text"))
    once(text)
    once(text)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("text")) == [("one",)]
    (folder / "b.txt").write_text("two")
    once(lambda df: df.select(F.raise_error(F.lit("broken")).alias("text")))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_review_versions(spark):
    body = "> x VERSION 1\n> one\n> --- END OF DRAFT ---\n> x VERSION 3\n> three\n> --- END OF DRAFT ---\n> x VERSION 2\n> two"
    df = spark.createDataFrame([(body,), ("none",)], "b string")
    got = [r[0] for r in df.select(V.last_state(F.col("b"))).collect()]
    assert tuple(got[0]) == (3, "three") and got[1] is None


def test_headers_of_a_mail_are_parsed_once(monkeypatch):
    """A header is parsed once, however often it is asked for; the fields are those that the default policy gives."""
    import email.policy

    from tessera.sources import files

    seen = []
    whole = email.policy.default.header_factory
    monkeypatch.setattr(type(email.policy.default), "header_fetch_parse", lambda self, name, value: seen.append(name) or whole(name, "".join(value.splitlines())))
    raw = b'Message-ID: <once@x>\nSubject: =?utf-8?q?=C3=A9?=\n more\nFrom: a@b\nTo: c@d\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="=once"\n\n'
    raw += b'--=once\nContent-Type: text/plain; charset=utf-8; x=once\n\nbody\n--=once\nContent-Type: text/x-once\nContent-Disposition: attachment; filename="once.txt"\n\nnote\n--=once--\n'
    files._header.cache_clear() if hasattr(files, "_header") else None
    got = files.parsed_mail(raw)
    assert (got["message_id"], got["subject"], got["sender"], got["recipients"], got["body"]) == ("once@x", "é more", "a@b", "c@d", "body")
    assert [(a["name"], a["content"]) for a in got["attachments"]] == [("once.txt", b"note")]
    assert seen and max(seen.count(n) for n in ("Message-ID", "Subject", "From", "To", "Date")) == 1 and len(seen) < 12
