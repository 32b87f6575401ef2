"""Patterns of all forms, ids of any length, apps with equal names, and late deliveries."""

import re

from pyspark.sql import functions as F

from appfacts.functions.text import uri_matches
from appfacts.operators import facts as P
from appfacts.operators import hierarchy as H
from appfacts.operators import taint as T
from appfacts.operators.matching import rejected_patterns, undecided_patterns
from appfacts.operators.skew import skew_join
from appfacts.streaming.ingest import ingest_apps

DATA = "struct<schemes:array<string>,authorities:array<struct<host:string,port:string>>,paths:array<string>,path_prefixes:array<string>,path_patterns:array<string>,mimes:array<string>>"
URI = "struct<scheme:string,host:string,port:string,path:string>"
LONG_PATTERN = "/(a|bc)+/x|" + "|".join(f"/y{i}(z)*" for i in range(10))
PATTERNS = ["/((a)(b))+", "(/a|/ab|b)*", "/(a|b){2,}", "/(?:[^/b]b?)*?", LONG_PATTERN, "/a", "/a|/b", "/(a|b)", "/a{2}", "^/a$", "/.*?x", "/[ab]+", "/((a)b)", "/(a(b)*)+", ".*", "/a.*b", "/(a", "[/a", "/a)(b", "*", ""]
PATHS = ["/a", "/b", "/aa", "/ab", "/x", "/aax", "/abab", "/a\n", "", "/" + "a" * 3000, "/" + "ab" * 2000, "/" + "bc" * 150 + "/x", "/" + "bca" * 5000 + "/x", "/y3" + "z" * 1500]


def test_path_patterns_equal_full_match(spark):
    rows = [((["s"], [("h", None)], [], [], [p], []), ("s", "h", None, q), p, q) for p in PATTERNS for q in PATHS]
    df = spark.createDataFrame(rows, f"data {DATA}, uri {URI}, p string, q string").select("p", "q", uri_matches("data", "uri").alias("ok"))
    for r in df.collect():
        try:
            want = re.fullmatch(r.p, r.q) is not None
        except re.error:
            want = False
        assert r.ok == want, (r.p, r.q[:20])


def test_rejected_patterns(spark, rows):
    data = [(0, "c", i, ([], [], [], [], [p], [])) for i, p in enumerate(PATTERNS)]
    df = spark.createDataFrame(data, f"app_id int, component string, filter_id int, data {DATA}")
    assert rows(rejected_patterns(df), "pattern") == sorted([("/(a",), ("[/a",), ("/a)(b",), ("*",)], key=repr)


def test_undecided_patterns(spark, rows):
    """Valid patterns that repeat groups with what no automaton has: listed, and they match nothing."""
    patterns = ["/(a)+\\\\1", "/(?=a)(a)*", "/(ab)*+", "/(a|b)+", "/(a", "/(a|(b))+?x", "/(a{1000}){1000}b?(c)+"]
    data = [(0, "c", i, ([], [], [], [], [p], [])) for i, p in enumerate(patterns)]
    df = spark.createDataFrame(data, f"app_id int, component string, filter_id int, data {DATA}")
    assert rows(undecided_patterns(df), "pattern") == sorted([("/(?=a)(a)*",), ("/(ab)*+",), ("/(a{1000}){1000}b?(c)+",)], key=repr)


def test_ids_of_any_length(spark, rows):
    reach = spark.createDataFrame([(0, f"c{i}", i) for i in range(6)], "app_id int, component string, method int")
    code = ["x 12345678901;", "x -5;", "x 5;", "x 91234567890123;", "x 1234567890;", "none"]
    code = spark.createDataFrame([(0, i, c) for i, c in enumerate(code)], "app_id int, method int, code string")
    controls = spark.createDataFrame([(0, 12345678901, True), (0, -5, True), (0, 777, False)], "app_id int, control_id bigint, is_sensitive boolean")
    assert rows(P.components_containing_controls(reach, code, controls), "component") == [("c0",), ("c1",), ("c3",)]


def test_equal_names_in_two_apps(spark, rows):
    """App 0's class is below the listed one, app 1's class of the same name is not."""
    calls = spark.createDataFrame([(0, 1, "La/X;.go:()V"), (1, 2, "La/X;.go:()V")], "app_id int, site int, callee_sig string")
    names = [(0, "a.X", "a.X"), (0, "a.X", "lib.S"), (1, "a.X", "a.X")]
    names = spark.createDataFrame(names, "app_id int, class_name string, ancestor_name string")
    listed = spark.createDataFrame([("Llib/S;.go:()V", "sink", [0], ["T"])], "signature string, role string, positions array<int>, tags array<string>")
    matches = H.match_by_subtype(calls, names, listed)
    assert rows(matches, "app_id", "site") == [(0, 1)]
    nodes = [(a, n, "call_arg", 0, "La/X;.go:()V") for a, n in ((0, 10), (1, 11))]
    nodes = spark.createDataFrame(nodes, "app_id int, node int, node_kind string, position int, callee_sig string")
    assert rows(T.api_sinks(nodes, matches), "app_id", "node") == [(0, 10)]


def test_equal_layout_ids_in_two_apps(spark, rows):
    layouts = spark.createDataFrame([(0, 1, 7), (1, 2, 7)], "app_id int, class_id int, layout_id int")
    includes = spark.createDataFrame([(0, 7, 8)], "app_id int, layout_id int, included_id int")
    handlers = spark.createDataFrame([(0, 8, "a"), (1, 7, "b"), (1, 8, "c")], "app_id int, layout_id int, method_name string")
    methods = spark.createDataFrame([(c, f"{m}:()V") for c in (1, 2) for m in "abc"], "class_id int, sub_sig string")
    above = spark.createDataFrame([(1, 1, 0), (2, 2, 0)], "class_id int, ancestor_id int, depth int")
    assert rows(H.layout_callbacks(layouts, includes, handlers, methods, above)) == [(1, "a", 1), (2, "b", 2)]


def test_other_kinds_clear_the_flag(spark, rows):
    cls = "Landroid/content/Intent;.setClass:(Landroid/content/Context;Ljava/lang/Class;)Landroid/content/Intent;"
    sites = spark.createDataFrame([(0, i, cls) for i in range(3)], "app_id int, site_id int, callee_sig string")
    args = [(0, i, 0, "object", None, 100 + i) for i in range(3)]
    args += [(0, 0, 2, "class", "a.C", None), (0, 1, 2, "string", "not.a.Class", None), (0, 2, 2, "object", None, 9)]
    args = spark.createDataFrame(args, "app_id int, site_id int, arg_idx int, kind string, value string, instance_id int")
    folded = P.fold_intent_contents(sites, args)
    assert rows(folded.attributes, "intent_id", "value") == [(100, "a.C")]
    assert rows(folded.flags, "intent_id", "precise_explicit") == [(100, True), (101, False), (102, False)]


def test_late_rows_of_a_known_app(spark, rows, tmp_path):
    def deliver(data):
        df = spark.createDataFrame(data, "app_id int, fact string")
        df.write.mode("append").parquet(f"{tmp_path}/in")
        ingest_apps(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()

    deliver([(1, "a"), (1, "a"), (2, "b")])
    deliver([(1, "a"), (1, "late"), (3, "c"), (2, None)])
    assert rows(spark.read.parquet(f"{tmp_path}/out/facts"), "app_id", "fact") == sorted([(1, "a"), (2, "b"), (1, "late"), (3, "c"), (2, None)], key=repr)


def test_skew_join_shuffles_the_large_side_once(spark):
    many = spark.range(2000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id AS a")
    few = spark.range(50).selectExpr("id AS k", "id * 2 AS b")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = skew_join(many, few, ["k"], hot_rows=100)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        # One exchange for each side; the list of hot keys is broadcast.
        assert plan.count("Exchange hashpartitioning") == 2 and "BroadcastExchange" in plan
        assert joined.groupBy().agg(F.sum("b")).first()[0] == many.join(few, "k").groupBy().agg(F.sum("b")).first()[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
