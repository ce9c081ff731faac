"""Literal cases of markers, payloads, forms and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import tables as B
from tests.conftest import rows


def test_payloads(spark):
    said = ['[{"text":"a"},{"text":"b"},{"other":1},{"text":""},{"text":"c"}]', " plain \n", "[not json", "", None, "[]", "<think>x</think>yes", "a<think>b<THINK c>d</think>e</think>f</think>g", "a<think>b", " <b>"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string")
    assert [r[1] for r in rows(df.select("i", T.payload_text(F.col("x"))), "i")] == ["a\nb\nc", "plain", "[not json", "", "", "", "yes", "af</think>g", "a", "<b>"]


def test_markers(spark):
    df = spark.createDataFrame([(0, "Re: x [ALI:v12] y"), (1, "[ali:v1]"), (2, "[ALI:v]"), (3, None), (4, "Class::Lamp")], "i int, x string")
    got = rows(df.select("i", T.is_review_thread(F.col("x"), "ALI"), T.is_class_row(F.col("x")), T.task_text(F.col("x"), 3)), "i")
    assert [r[1] for r in got] == [True, True, False, False, False]
    assert [r[2] for r in got] == [False, False, False, False, True]
    assert [r[3] for r in got] == ["Re:", "[al", "[AL", None, "Cla"]


def test_forms(spark):
    df = spark.createDataFrame([("1.0", "5"), (" ", "50"), (None, "x"), ("7", "-1"), (" 0 ", "nan")], "a string, b string")
    limits = {"a": T.Limits(positive=True, label="A"), "b": T.Limits(least=1, most=10)}
    got = [r[0] for r in df.select(T.form_problems({"a": F.col("a"), "b": F.col("b")}, limits)).collect()]
    assert got == [[], ["A invalid", "b must be <= 10"], ["A invalid", "b invalid"], ["b must be >= 1"], ["A must be > 0", "b invalid"]]
    odd = spark.createDataFrame([(None, -1.0)], "a double, b double")
    assert odd.select(T.form_problems({"b": F.col("b")}, {"b": T.Limits(least=-5, most=100)})).first()[0] == []


def test_log_keeps_the_order_of_equals(spark):
    df = spark.createDataFrame([(0, "bytes=9"), (1, "9 bytes"), (2, " x bytes=10 "), (3, "bytes=9 y")], "i int, line string")
    made = B.by_number(df, "line", "i")
    assert [tuple(r) for r in made.select("i", "line").collect()] == [(2, "x bytes=10"), (0, "bytes=9"), (3, "bytes=9 y")]
    assert tuple(B.number_totals(made).first()) == (28, "0.000") and tuple(B.number_totals(made.where("i > 9")).first()) == (0, "0.000")


def test_the_first_of_equal_versions(spark, tmp_path):
    data = [("a", 1, "x"), ("a", 2, "z"), ("a", 2, "b"), ("b", None, "n"), ("b", 0, None)]
    spark.createDataFrame(data, "k string, v int, t string").coalesce(1).write.parquet(str(tmp_path / "t"))
    made = B.latest(B.with_file_order(spark.read.parquet(str(tmp_path / "t"))), "k", "v", "t", "place")
    assert rows(made, "k") == [("a", 2, "z"), ("b", 0, None)]
