import math
import mimetypes
import os
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkproof.functions import numbers, text
from inkproof.functions.checks import amount_check, date_check
from tests.plain import plain_normal

EDGES = [
    0.0005, 0.005, 0.125, 2.675, 123456789.005, -0.001, -0.0, 0.0, 1e15, 1e16, 1e7, 12345678.9,
    1.5e-05, 0.0001, 9007199254740993.0, float("nan"), float("inf"), float("-inf"), -5.0, 500.0,
]


def test_numbers_agree_with_python(spark):
    r = random.Random(7)
    values = EDGES + [r.random() for _ in range(3000)] + [i / 2000 for i in range(2001)]
    values += [r.random() * 10 ** r.randint(-6, 12) for _ in range(3000)]
    x = F.col("x")
    rows = (
        spark.createDataFrame([(v,) for v in values], "x double")
        .select(
            "x",
            numbers.round_exact(x).alias("rounded"),
            numbers.fixed_text(x).alias("money"),
            numbers.float_text(x).alias("shortest"),
            numbers.percent_text(x).alias("percent"),
        )
        .collect()
    )
    for row in rows:
        finite = math.isfinite(row.x)
        assert not finite or row.rounded == round(row.x, 3)
        assert row.money == f"{row.x:.2f}"
        assert row.shortest == repr(row.x)
        assert row.percent == f"{row.x:.1%}"


def test_normal_form_agrees_with_python(spark):
    r = random.Random(3)
    letters = list(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 　{}[]^$€,.0123456789١aBÇΣ​")
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(5000)]
    texts += ["  $ 1,234,567.80\n\nX^{}[] a{b}c ", "1,2345", "{}", "$\\$ 100.00$", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in frame.select("t", text.normalize(F.col("t")).alias("n")).collect():
        assert row.n == plain_normal(row.t)


def test_normal_form_vectors(spark):
    vectors = {
        "  $ 1,234,567.80\n\nX^{}[] a{b}c ": " 1234567.80 x ab}c",
        "1,2345": "12345",
        "{}": "",
        "$\\$ 100.00$": "\\ 100.00",
    }
    frame = spark.createDataFrame([(k, v) for k, v in vectors.items()], "t string, want string")
    for row in frame.select("want", text.normalize(F.col("t")).alias("n")).collect():
        assert row.n == row.want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\xa0abcÉ.-", max_size=20), min_size=1, max_size=40))
def test_normal_form_is_stable_without_marks(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    once = text.normalize(F.col("t"))
    for row in frame.select(once.alias("a"), text.normalize(once).alias("b")).collect():
        assert row.a == row.b


def test_amount_texts(spark):
    vectors = {"-5": "5.00", ".5": "5.00", "1,234.5": "1234.50", "n/a": "n/a", "USD 7": "7.00", "": ""}
    frame = spark.createDataFrame(list(vectors.items()), "t string, want string")
    for row in frame.select("want", text.normalize_amount_text(F.col("t")).alias("n")).collect():
        assert row.n == row.want


def test_file_names(spark):
    names = [
        "a.tar.gz", ".bashrc", "a..B", "a.", "A.PDF", ".a.png", "x.TGZ", "x.pdf.gz", "x.GZ", "noext",
        "a.b/c", "d.x/e.jpeg", "..a", "...a.png", "z.svgz", "q.Z", "x.txt.bz2", "é è.PNG",
    ]
    table = mimetypes.MimeTypes(filenames=())
    name = text.file_name(F.col("p"))
    rows = (
        spark.createDataFrame([(n,) for n in names], "p string")
        .select("p", text.file_extension(name).alias("e"), text.mime_type(name).alias("m"))
        .collect()
    )
    for row in rows:
        assert row.e == os.path.splitext(os.path.basename(row.p))[1].lower().lstrip(".")
        assert row.m == (table.guess_type(row.p)[0] or "application/octet-stream")


def test_checks(spark):
    dates = [(None, True), ("", True), ("2024-99-99", True), ("2024-1-5", False), ("2024-01-05\n", True),
             ("2024-01-05\n\n", False), ("x2024-01-05", False), ("2024-01-05\r", False)]
    frame = spark.createDataFrame(dates, "d string, ok boolean")
    assert all(r.got == r.ok for r in frame.select("ok", date_check(F.col("d"))["valid"].alias("got")).collect())
    amounts = [(None, True, "No amount provided (optional)"), (0.0, True, "Valid amount: 0.0"),
               (-0.01, False, "Negative amount: -0.01"), (float("nan"), False, "Negative amount: nan"),
               (12345678.5, True, "Valid amount: 12345678.5")]
    frame = spark.createDataFrame(amounts, "a double, ok boolean, message string")
    for row in frame.select("ok", "message", amount_check(F.col("a")).alias("c")).collect():
        assert (row.c.valid, row.c.message) == (row.ok, row.message)
