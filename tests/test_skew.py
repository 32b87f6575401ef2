"""Hot keys and long groups give the same rows as the plain operators."""

import random

from pyspark.sql import functions as F

from appfacts.operators.setops import contained_in
from appfacts.operators.skew import hot_keys, number_rows, running_last, skew_join


def test_skew_join_equals_join(spark, rows):
    r = random.Random(1)
    many = spark.createDataFrame([(r.choice([0, 0, 0, 1, 2, 3]), i) for i in range(300)], "k int, a int")
    few = spark.createDataFrame([(0, "x"), (0, "y"), (1, "z"), (9, "w")], "k int, b string")
    assert hot_keys(many, ["k"], 20).count() > 0
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(skew_join(many, few, ["k"], how, hot_rows=20)) == rows(many.join(few, ["k"], how))


def test_running_last_over_chunks(spark):
    r = random.Random(2)
    data = [(g, i, r.choice([None, None, None, f"h{i}"])) for g in range(2) for i in range(500)]
    df = spark.createDataFrame(data, "g int, i bigint, v string")
    got = {(x["g"], x["i"]): x["o"] for x in running_last(df, F.col("v"), ["g"], "i", "o", chunk_rows=7).collect()}
    for g in range(2):
        last = None
        for _, i, v in [d for d in data if d[0] == g]:
            last = v or last
            assert got[(g, i)] == last


def test_number_rows_over_chunks(spark):
    df = spark.createDataFrame([(i % 3, i * 5) for i in range(200)], "g int, i bigint")
    got = {(x["g"], x["i"]): x["n"] for x in number_rows(df, ["g"], "i", "n", chunk=40).collect()}
    for g in range(3):
        ids = sorted(i for gg, i in got if gg == g)
        assert [got[(g, i)] for i in ids] == list(range(1, len(ids) + 1))


def test_contained_in_equals_brute_force(spark, rows):
    r = random.Random(3)
    needles = ["".join(r.choice("ab.") for _ in range(r.randint(1, 40))) for _ in range(60)] + ["", "é"]
    entries = ["".join(r.choice("ab.") for _ in range(r.randint(1, 60))) for _ in range(60)] + [needles[3] + "x", "caféé"]
    got = rows(
        contained_in(spark.createDataFrame([(n,) for n in needles], "n string"), "n", spark.createDataFrame([(e,) for e in entries], "e string"), "e")
    )
    assert got == sorted({(n, e) for n in needles for e in entries if n and n in e}, key=repr)
