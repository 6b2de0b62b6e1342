from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("function", "given", "want"),
    [
        (T.trimmed, "﻿\t  a b \n", "a b"),
        (T.without_ansi, "\x1b[31mred\x1b[0m \x1b]0;title\x07x", "red x"),
        (T.settled, "10%\r50%\r100%\r", "100%"),
        (T.settled, "\r\r", ""),
        (T.settled, "plain", "plain"),
        (T.shape, "Wrote 12 files to DEADBEEF99 in 3.5s", ["wrote", "#", "files", "to", "<h>", "in", "#", "#s"]),
        (T.outline_shape, "  abcd12 test_one two-three 45 é1234 ", "w+ # éw"),
        (T.outline_shape, "x = 10", "w = #"),
        (T.duration, 90.4, "90s"),
        (T.duration, 600.0, "10min"),
        (T.thousands, 61_400.0, "61k"),
        (T.summary_of, "# Summary\nall good\n## Details\nmore", "all good"),
        (T.summary_of, "## Details\nx\n# Summary\ny", None),
        (T.summary_of, "### 요약\n끝\n### 상세\nx", "끝"),
        (T.items_of, "1. first thing to do\n2. second thing to do\n- a bullet that is long", ["first thing to do", "second thing to do"]),
        (T.items_of, "- first thing to do\n* second thing to do", ["first thing to do", "second thing to do"]),
        (T.items_of, "\n".join(f"{i}. thing number {i} to do" for i in range(9)), []),
        (T.items_of, "nothing", []),
        (T.items_of, "• first thing to do\n- second thing to do", ["first thing to do", "second thing to do"]),
        (T.items_of, "(1) first thing to do\n② second thing to do\n123. not an item of a list", ["first thing to do", "second thing to do"]),
        (T.tokens_of, "abcdef 123 12 deadbee 가나다 x", ["abcdef", "123", "deadbee", "가나다"]),
        (T.archive_id, "a", "ca978112ca1bbdca"),
    ],
)
def test_functions(spark, function, given, want):
    assert one(spark, given, function, "double" if isinstance(given, float) else "string") == want


@pytest.mark.parametrize(("a", "b", "want"), [("a b c", "a b c", True), ("a b c d", "a b c", True), ("a b c d e f g h i j", "a b c d e f g x y z", True), ("a b c", "a x y", False), ("", "", False), ("", "a", False)])
def test_similar(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.similar(T.shape(F.col("a")), T.shape(F.col("b"))).alias("r")).first().r is want


def test_classes(spark):
    rows = [("curl -s http://x", '[{"a": 1}]', "document"), ("cat big.log", "x", "document"), ("git grep foo", "x", "search"), ("ls", "x", "search"), ("lsof", "x", "log"), ("npm test", "ok", "log")]
    df = spark.createDataFrame(rows, "c string, o string, w string")
    assert all(r.g == r.w for r in df.select("w", T.output_class(F.col("c"), F.col("o")).alias("g")).collect())


def test_kept_lines_and_inputs(spark):
    df = spark.createDataFrame([("$ run\nmore\nvalue 7", ["value 7", "$ run"])], "t string, l array<string>")
    assert df.select(T.kept_lines(F.col("t"), F.col("l"), 300).alias("r")).first().r.split("\n") == ["$ run", "[13 characters left out; lines that stood out follow]", "value 7"]
    df = spark.createDataFrame([({"a": "x" * 700, "b": "y" * 600},)], "m map<string,string>")
    got = df.select(T.shortened_input(F.col("m")).alias("r")).first().r
    assert got["b"] == "y" * 600 and got["a"].startswith("x" * 300 + "[… 400 ")


def test_scores(spark):
    df = spark.createDataFrame([("all completed",), ("quiet",), (None,)], "t string")
    assert [r.s for r in df.select(T.simulated_score(F.col("t")).alias("s")).collect()] == [0.99, 0.01, 0.01]
