"""Files in and out, ingest, rules and models that users add."""

import zipfile

from pyspark.sql import functions as F

from appfacts.operators import facts as P
from appfacts.operators import models
from appfacts.operators import rules as R
from appfacts.operators.matching import resolve_intents
from appfacts.plans.facts import Facts
from appfacts.plans.matching import filters
from appfacts.plans.misuse import ecb_cipher
from appfacts.sinks import staged as S
from appfacts.sources.archives import scan_app_archives
from appfacts.sources.lines import read_code_units
from appfacts.sinks.staged import matrix_cells, write_frequency_matrix
from appfacts.streaming import ingest
from appfacts.streaming.ingest import ingest_apps

SF = "/root/testdata/sf0.001"


def test_archives(spark, tmp_path):
    def archive(name, *members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for m in members:
                z.writestr(m, "x")

    archive("full.apk", "AndroidManifest.xml", "classes.dex")
    archive("code.apk", "classes.dex")
    (tmp_path / "bad.apk").write_bytes(b"PK not a zip")
    got = {r["uri"].rsplit("/", 1)[1]: r for r in scan_app_archives(spark, str(tmp_path)).collect()}
    assert (got["full.apk"]["is_valid"], got["full.apk"]["is_decompilable"]) == (True, True)
    assert (got["code.apk"]["is_valid"], got["code.apk"]["is_decompilable"]) == (False, True)
    assert not got["bad.apk"]["is_valid"] and got["bad.apk"]["error"]


def test_code_tree(spark, rows, tmp_path):
    folder = tmp_path / "app_id=3" / "origin=application" / "a" / "b"
    folder.mkdir(parents=True)
    (folder / "C.code").write_text("line 1\nline 2")
    assert rows(read_code_units(spark, str(tmp_path))) == [(3, "a.b.C", "application", "line 1\nline 2")]


def test_staged_tables(spark, rows, tmp_path):
    df = spark.range(100).select(F.col("id").alias("app_id"), (F.col("id") * 2).alias("v"))
    root = str(tmp_path)
    assert not S.has_stage(spark, root, "apps")
    S.write_staged(df, root, "apps", buckets=8)
    assert S.has_stage(spark, root, "apps")
    assert rows(S.read_staged(spark, root, "apps"), "app_id", "v") == rows(df)
    some = S.staged_buckets(spark, root, "apps", [3, 70], buckets=8)
    assert rows(some, "app_id", "v") == [(3, 6), (70, 140)]
    assert "PartitionFilters: [bucket" in some._jdf.queryExecution().toString()


def test_sorted_list(spark, tmp_path):
    S.write_sorted_list(spark.range(50).withColumn("s", F.concat(F.lit("x"), F.col("id"))), "s", str(tmp_path / "o"))
    lines = [x for p in sorted((tmp_path / "o").glob("part-*")) for x in p.read_text().split()]
    assert lines == sorted(f"x{i}" for i in range(50))


def test_ingest_repeats_nothing(spark, rows, tmp_path):
    root = str(tmp_path)
    first = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "app_id int, fact string")
    second = spark.createDataFrame([(1, "late"), (2, "c")], "app_id int, fact string")

    def run():
        ingest_apps(spark, f"{root}/in", first.schema, f"{root}/out", f"{root}/cp").awaitTermination()
        return rows(spark.read.parquet(f"{root}/out/facts"), "app_id", "fact")

    first.write.mode("append").parquet(f"{root}/in")
    assert run() == [(1, "a"), (1, "b")]
    second.write.mode("append").parquet(f"{root}/in")
    assert run() == [(1, "a"), (1, "b"), (1, "late"), (2, "c")]
    assert run() == [(1, "a"), (1, "b"), (1, "late"), (2, "c")]


def test_user_rules(spark):
    f = Facts(spark, SF)
    book = R.RuleBook([])
    book.register_rule(R.ECB_RULE)
    book.register_rule(lambda call_sites, arg_values: call_sites.limit(1).select("app_id", "site_id", F.lit("mine").alias("rule"), F.lit("m").alias("message")), "mine")
    found = book.check(f["fx_call_sites"], f["fx_arg_values"])
    counts = {r["rule"]: r["count"] for r in found.groupBy("rule").count().collect()}
    assert counts == {"ecb_cipher": ecb_cipher(f).select("app_id", "site_id").distinct().count(), "mine": 1}


def test_later_findings_win(spark, rows):
    a = spark.createDataFrame([(1, 1, "r", "old"), (1, 2, "r", "keep")], "app_id int, site_id int, rule string, message string")
    b = spark.createDataFrame([(1, 1, "r", "new")], a.schema)
    assert rows(R.merge_findings(a, b), "site_id", "message") == [(1, "new"), (2, "keep")]


def test_folded_intents_can_be_resolved(spark, rows):
    """From calls to targets, with a model row added by the user."""
    sig = "Landroid/content/Intent;.setLabel:(Ljava/lang/String;)V"
    models = P.IntentModels().register_models(calls=[(sig, 1, "action", "string", "implicit")])
    sites = spark.createDataFrame([(0, 1, sig), (0, 2, "Landroid/content/Intent;.addFlags:(I)Landroid/content/Intent;")], "app_id int, site_id int, callee_sig string")
    args = spark.createDataFrame(
        [(0, 1, 0, "object", None, 7), (0, 1, 1, "string", "go", None), (0, 2, 0, "object", None, 8)],
        "app_id int, site_id int, arg_idx int, kind string, value string, instance_id int",
    )
    packed = P.pack_intents(P.fold_intent_contents(sites, args, models))
    assert rows(packed, "intent_id", "actions", "precise_implicit") == [(7, ["go"], True), (8, [], True)]
    intents = packed.withColumn("comp_type", F.lit("ACTIVITY"))
    flt = filters(Facts(spark, SF)).limit(1).select(F.lit(0).alias("app_id"), F.lit("C").alias("component"), F.lit(1).alias("filter_id"), F.array(F.lit("go")).alias("actions"), F.array().cast("array<string>").alias("categories"), F.expr("named_struct('schemes', array(), 'authorities', array(), 'paths', array(), 'path_prefixes', array(), 'path_patterns', array(), 'mimes', array())").cast(
        "struct<schemes:array<string>,authorities:array<struct<host:string,port:string>>,paths:array<string>,path_prefixes:array<string>,path_patterns:array<string>,mimes:array<string>>").alias("data"))
    assert rows(resolve_intents(intents, flt).targets, "scope", "target_type") == [("FILTER", "IMPLICIT")]


def test_rules_of_any_length_and_both_kinds(spark, rows):
    """Conditions on more than 64 positions, and a site that a whole and a sub-signature name."""
    long = R.Rule("long", "m", ("La/B;.go:(I)V",), {i: [("int", "1"), ("int", "2")] for i in range(130)})
    sub = R.Rule("sub", "m", ("go:(I)V",), {}, True)
    sites = spark.createDataFrame([(0, s, "La/B;.go:(I)V") for s in range(3)] + [(0, 9, "La/C;.go:(I)V"), (0, 10, "La/C;.no:()V")], "app_id int, site_id int, callee_sig string")
    args = [(0, 0, i, "int", str(1 + i % 2)) for i in range(130)] + [(0, 0, 5, "int", "2")]
    args += [(0, 1, i, "int", "1") for i in range(130) if i != 64] + [(0, 1, i, "int", "2") for i in range(64)]
    args = spark.createDataFrame(args, "app_id int, site_id int, arg_idx int, kind string, value string")
    found = R.check_call_rules(sites, args, [long, sub])
    assert rows(found, "site_id", "rule") == sorted([(0, "long"), (0, "sub"), (1, "sub"), (2, "sub"), (9, "sub")], key=repr)


def test_matrix_of_many_values(spark, tmp_path):
    """50,000 columns, names with commas, quotes and back slashes; every cell, and a plain CSV reader's view."""
    import csv

    names = [f"v{i:05}" for i in range(50_000)]
    names[7], names[8], names[9] = 'a,"b', "back\\slash,", '"'
    rows_ = [(f"app,{i % 3}" if i % 2 else f"app{i % 3}", n) for i, n in enumerate(names)] + [("one", names[7])] * 5
    stats = spark.createDataFrame(rows_, "app_id string, name string")
    write_frequency_matrix(stats, "name", f"{tmp_path}/m", files=4)
    got = {(r.app_id, r.value): r.n for r in matrix_cells(spark, f"{tmp_path}/m").collect()}
    want = {}
    for r in rows_:
        want[r] = want.get(r, 0) + 1
    assert got == want
    seen = set()
    csv.field_size_limit(1 << 30)
    for file in sorted((tmp_path / "m").rglob("part-*")):
        head, *lines = list(csv.reader(file.open(newline=""), escapechar="\\", doublequote=False))
        assert head[0] == "app_id" and len(head) == 50_001 and sorted(head[1:]) == sorted(names)
        for line in lines:
            assert len(line) == 50_001
            seen |= {(line[0], head[i]) for i, c in enumerate(line) if i and c}
    assert seen == want.keys()


def test_delivery_reads_its_own_buckets(spark, tmp_path):
    """A repeated delivery looks at the folders of its own apps only."""
    facts = spark.range(2000).selectExpr("id AS app_id", "concat('f', id) AS fact")
    facts.write.parquet(f"{tmp_path}/in/a")
    schema = facts.schema
    ingest_apps(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    plan = ingest.earlier(spark, f"{tmp_path}/out/facts", 1, [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "app_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    facts.where("app_id in (3, 4)").unionByName(spark.createDataFrame([(3, "late")], schema)).write.parquet(f"{tmp_path}/in/b")
    ingest_apps(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out/facts")
    assert out.count() == 2001 and out.where("batch_id = 1").count() == 1


def test_object_models_of_users(spark, rows):
    """A user's class with calls of its own, next to bundles; copies of copies; values that aren't known."""
    sites = [(0, 1, "Lmy/Box;.store:(Ljava/lang/String;Lmy/T;)V"), (0, 2, "Lmy/Box;.load:(Ljava/lang/String;)Lmy/T;"), (0, 3, "Lmy/Box;.from:(Lmy/Box;)V"),
             (0, 4, "Landroid/os/Bundle;.putAll:(Landroid/os/Bundle;)V"), (0, 5, "Landroid/os/Bundle;.getInt:(Ljava/lang/String;I)I"), (0, 6, "Lmy/Box;.load:(Ljava/lang/String;)Lmy/T;")]
    args = [(0, 1, 0, "object", None, 10), (0, 1, 1, "string", "a", None), (0, 1, 2, "object", None, 99)]
    args += [(0, 2, 0, "object", None, 12), (0, 2, 1, "string", "a", None), (0, 6, 0, "object", None, 10), (0, 6, 1, "point_string", None, None)]
    args += [(0, 3, 0, "object", None, 11), (0, 3, 1, "object", None, 10), (0, 4, 0, "object", None, 12), (0, 4, 1, "object", None, 11)]
    args += [(0, 5, 0, "object", None, 12), (0, 5, 1, "string", "a", None)]
    sites = spark.createDataFrame(sites, "app_id int, site_id int, callee_sig string")
    args = spark.createDataFrame(args, "app_id int, site_id int, arg_idx int, kind string, value string, instance_id bigint")
    own = models.ObjectModels().register_models(
        models.Model("Lmy/Box;", "store", f"{models.TEXT}{models.OBJECT}", "V", "put", 0, 1, 2),
        models.Model("Lmy/Box;", "load", models.TEXT, models.OBJECT, "get", 0, 1),
        models.Model("Lmy/Box;", "from", "Lmy/Box;", "V", "copy", 0, None, 1),
    )
    reads = models.extras_of_calls(sites, args, own).reads
    assert rows(reads, "get_id", "n_values") == [("0|2|12|string|a", 1), ("0|6|10|point_string|", 1)]
    assert models.extras_of_calls(sites, args).reads.count() == 0


def test_class_files_are_written_by_several_tasks(spark):
    """The classes come from a table of one file; writing a file for each must not be one task."""
    from pathlib import Path

    from appfacts.plans.facts import Facts
    from appfacts.plans.io import code_units, ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    root = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(root.glob("appfacts-*"))
    n = code_units(Facts(spark, SF)).count()
    (folder,) = set(root.glob("appfacts-*")) - before
    files = list(folder.rglob("part-*.txt"))
    assert len(files) == n
    assert len({f.name.split("-")[1] for f in files}) > 1


def test_class_tree_is_listed_and_read_by_few_tasks(spark, rows, tmp_path):
    """A file for each class, as Spark's writer leaves them: as many tasks as are set read them, not one for a few files."""
    classes = spark.range(300).selectExpr("id % 2 AS app_id", "'library' AS origin", "concat('p.C', id) AS class_name", "concat('code ', id) AS value")
    classes.coalesce(1).write.partitionBy("app_id", "origin", "class_name").text(str(tmp_path / "spark"))
    S.write_code_units(classes.repartition(2, "class_name"), str(tmp_path / "own"))
    (tmp_path / "own" / "app_id=0" / ".hidden").write_text("x")
    (tmp_path / "own" / "_SUCCESS").write_text("x")
    a, b = (read_code_units(spark, f"file:{tmp_path}/{d}") for d in ("spark", "own"))
    assert rows(a) == rows(b) == sorted(((i % 2, f"p.C{i}", "library", f"code {i}\n") for i in range(300)), key=repr)
    assert a.rdd.getNumPartitions() <= 4
    assert not list((tmp_path / "own").rglob("*.crc"))


def test_rows_of_a_class_are_one_file(spark, rows, tmp_path):
    lines = spark.createDataFrame([(1, "o", "p.A", "a"), (1, "o", "p.B", "b"), (1, "o", "p.A", None)], "app_id int, origin string, class_name string, value string")
    S.write_code_units(lines.coalesce(1), str(tmp_path))
    assert rows(read_code_units(spark, str(tmp_path)), "class_name", "code") in ([("p.A", "a\n\n"), ("p.B", "b\n")], [("p.A", "\na\n"), ("p.B", "b\n")])


def test_report_reads_targets_and_pairs_as_written(spark, rows):
    """The plans that make targets and findings end before the report's own."""
    from appfacts.operators import reports as R

    def made(n, schema, *values):
        return spark.createDataFrame([values], schema).join(spark.range(n).selectExpr("CAST(id AS INT) AS app_id"), "app_id")

    permissions = spark.createDataFrame([(0, "p")], "app_id int, permission string")
    components = spark.createDataFrame([(0, "c", "ACTIVITY", True, True, "p")], "app_id int, component string, comp_type string, exported boolean, enabled boolean, permission string")
    filters = spark.createDataFrame([(0, "c", 1, ["a"], ["b"], "d")], "app_id int, component string, filter_id int, actions array<string>, categories array<string>, data string")
    calls = spark.createDataFrame(
        [(0, "q", "ACTIVITY", ["c"], [], [], [], [], True, True, 1)],
        "app_id int, call_id string, comp_type string, component_names array<string>, actions array<string>, categories array<string>, uris array<string>,"
        " mimes array<string>, precise_explicit boolean, precise_implicit boolean, n_intents int",
    )
    targets = made(2, "app_id int, call_id string, scope string, target string, target_type string", 0, "q", "COMPONENT", "c", "EXPLICIT")
    nodes = spark.createDataFrame([(0, 3, "source", "API_SOURCE", "s")], "app_id int, node int, role string, category string, descriptor string")
    pairs = made(2, "app_id int, source int, sink int, problem string", 0, 3, 7, "information_theft")
    report = R.app_report(permissions, components, filters, calls, targets, nodes, pairs)
    assert "Join" not in report._jdf.queryExecution().optimizedPlan().toString()
    sections = [s for (s,) in rows(report, "section")]
    assert sections == ["component", "filter", "icc_call", "icc_target", "permission", "taint_path", "taint_source"]
