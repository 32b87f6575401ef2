"""Queries on sources, sinks, reports and ingest.

What is written goes to a new folder below the session's checkpoint folder, which all executors reach.
"""

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from appfacts.operators import reports as R
from appfacts.operators import taint as T
from appfacts.operators.matching import resolve_intents
from appfacts.plans import matching as MQ
from appfacts.plans.manifest import EFFECTIVE_SQL, components
from appfacts.plans.registry import query
from appfacts.plans.taint import _PAIR_SQL
from appfacts.session import ensure_checkpoint_dir
from appfacts.sinks import staged as S
from appfacts.sources.archives import archive_flags
from appfacts.sources.lines import read_code_units, read_source_sink_list
from appfacts.streaming.ingest import ingest_apps, stage_status, with_status


T_SQL = _PAIR_SQL.split("WITH RECURSIVE ", 1)[1]


def new_folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/appfacts-{uuid.uuid4().hex}"


def _zip_batches(batches):
    """Small archives whose members depend on the part size; every eleventh is cut short."""
    for b in batches:
        rows = []
        for uri, size in zip(b["uri"], b["p_size"]):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w") as z:
                if size % 2 == 0:
                    z.writestr("AndroidManifest.xml", "<manifest/>")
                if size % 3 > 0:
                    z.writestr("classes.dex", "dex")
                z.writestr("res/a.txt", "x" * int(size))
            rows.append((uri, buf.getvalue()[:20] if size % 11 == 0 else buf.getvalue()))
        yield pd.DataFrame(rows, columns=["uri", "content"])


@query(
    "a1_archive_flags",
    """SELECT 'app' || p_partkey || '.apk' AS uri, p_size % 11 <> 0 AND p_size % 2 = 0 AND p_size % 3 > 0 AS is_valid, p_size % 11 <> 0 AND p_size % 3 > 0 AS is_decompilable,
  p_size % 11 = 0 AS unreadable FROM part""",
)
def archives(f):
    # The table is one small file; its archives are made and read by all tasks, which a given number keeps apart.
    n = int(f.spark.conf.get("spark.sql.shuffle.partitions"))
    parts = f["part"].select(F.concat(F.lit("app"), F.col("p_partkey").cast("string"), F.lit(".apk")).alias("uri"), "p_size").repartition(n, "uri")
    files = parts.mapInPandas(_zip_batches, "uri string, content binary")
    return archive_flags(files).select("uri", "is_valid", "is_decompilable", F.col("error").isNotNull().alias("unreadable"))


@query("a5_code_units", "SELECT p_partkey % 10 AS app_id, 'p.C' || p_partkey AS class_name, CASE WHEN p_size % 3 = 0 THEN 'library' ELSE 'application' END AS origin,"
       " 'code ' || p_name AS code FROM part")
def code_units(f):
    """One text file per class."""
    folder = new_folder(f.spark)
    # The table is one small file; its classes are written by all tasks.
    n = int(f.spark.conf.get("spark.sql.shuffle.partitions"))
    S.write_code_units(
        f["part"].selectExpr(
            "p_partkey % 10 AS app_id", "CASE WHEN p_size % 3 = 0 THEN 'library' ELSE 'application' END AS origin", "concat('p.C', p_partkey) AS class_name", "concat('code ', p_name) AS value"
        ).repartition(n, "class_name"),
        folder,
    )
    return read_code_units(f.spark, folder).withColumn("code", F.rtrim(F.col("code"), F.lit("\n")))


@query(
    "a6_source_sink_list",
    """SELECT 'Lx/C' || p_partkey || ';.m:()V' AS signature, CASE p_size % 2 WHEN 0 THEN 'source' ELSE 'sink' END AS role,
  CASE p_size % 2 WHEN 0 THEN '' ELSE '0,' || p_size % 4 END AS positions, CASE p_size % 3 WHEN 0 THEN 'ANY' ELSE 'T' || p_size % 5 || ',U' END AS tags FROM part WHERE p_size % 7 > 0""",
)
def source_sink_list(f):
    folder = new_folder(f.spark)
    f["part"].selectExpr(
        "concat_ws('\t', concat('Lx/C', p_partkey, ';.m:()V'), CASE WHEN p_size % 7 = 0 THEN 'other' WHEN p_size % 2 = 0 THEN 'source' ELSE 'sink' END,"
        " CASE p_size % 2 WHEN 0 THEN '' ELSE concat('0|', p_size % 4) END, CASE p_size % 3 WHEN 0 THEN '' ELSE concat('T', p_size % 5, '|U') END) AS value"
    ).write.text(folder)
    return read_source_sink_list(f.spark, folder).select(
        "signature", "role", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), F.array_join("tags", ",").alias("tags")
    )


@query("b1_staged_components", EFFECTIVE_SQL)
def staged_components(f):
    """Components written as a staged table and read back."""
    folder = new_folder(f.spark)
    S.write_staged(components(f), folder, "components", buckets=16)
    return S.read_staged(f.spark, folder, "components").select("app_id", "component", "comp_type", "exported", "enabled", "permission")


@query("b4_graph_files", "SELECT app_id, use_node, def_node, 'edge' AS what FROM fx_dep_edges UNION ALL SELECT DISTINCT app_id, node, NULL, 'node'"
       " FROM (SELECT app_id, use_node AS node FROM fx_dep_edges UNION ALL SELECT app_id, def_node FROM fx_dep_edges)")
def graph_files(f):
    folder = new_folder(f.spark)
    e = f["fx_dep_edges"]
    ends = e.select("app_id", F.explode(F.array("use_node", "def_node")).alias("node")).distinct()
    S.write_graph(ends, e, folder)
    nodes = f.spark.read.parquet(f"{folder}/nodes").select("app_id", F.col("node").alias("use_node"), F.lit(None).cast("bigint").alias("def_node"), F.lit("node").alias("what"))
    return f.spark.read.parquet(f"{folder}/edges").withColumn("what", F.lit("edge")).unionByName(nodes)


@query("b5_sorted_list", "SELECT p_name AS value FROM part")
def sorted_list(f):
    folder = new_folder(f.spark)
    S.write_sorted_list(f["part"], "p_name", folder)
    return f.spark.read.text(folder)


@query(
    "b6_frequency_matrix",
    """SELECT CAST(c.component_id % 500 AS VARCHAR) AS app_id, c.component || CASE c.component_id % 3 WHEN 0 THEN ',"x' ELSE '' END AS value, COUNT(*) AS n
FROM fx_components c JOIN fx_components d ON d.component_id % 7 = c.component_id % 7 AND d.component_id < 21 GROUP BY 1, 2""",
)
def matrix_file(f):
    """Every filled cell of a matrix with a column for each component's name, written as CSV and read back."""
    folder = new_folder(f.spark)
    c = f["fx_components"].select("component_id", "component")
    d = c.where("component_id < 21").select(F.col("component_id").alias("d"))
    stats = c.join(d, F.col("component_id") % 7 == F.col("d") % 7).select(
        (F.col("component_id") % 500).alias("app_id"),
        F.concat("component", F.when(F.col("component_id") % 3 == 0, ',"x').otherwise("")).alias("name"),
    )
    S.write_frequency_matrix(stats, "name", folder)
    return S.matrix_cells(f.spark, folder)


def permissions(f):
    return f["fx_components"].where("permission_attr IS NOT NULL").select("app_id", F.col("permission_attr").alias("permission")).distinct()


def _json_list(c: str) -> str:
    return f"""'[' || coalesce('"' || {c} || '"', '') || ']'"""


_FILTER_JSON = f"""'"actions":' || {_json_list("x.action")} || ',"categories":' || {_json_list("x.category")} || ',"data":{{"schemes":' || {_json_list("x.scheme")}
  || ',"authorities":[' || coalesce('{{"host":"' || x.host || '"}}', '') || '],"paths":[],"path_prefixes":' || {_json_list("x.path_prefix")} || ',"path_patterns":[],"mimes":'
  || {_json_list("x.mime")} || '}}}}'"""
_CALL_JSON = f"""'{{"comp_type":"' || comp_type || '","component_names":' || {_json_list("component")} || ',"actions":' || {_json_list("action")} || ',"categories":' || {_json_list("category")}
  || ',"uris":[' || CASE WHEN uri IS NULL THEN '' ELSE '{{' || concat_ws(',', '"scheme":"' || u_scheme || '"', '"host":"' || u_host || '"', '"path":"' || u_path || '"') || '}}' END
  || '],"mimes":' || {_json_list("mime")} || ',"precise_explicit":' || precise_explicit || ',"precise_implicit":' || precise_implicit || ',"n_intents":' || n_intents || '}}'"""


@query(
    "b2_app_report",
    f"""{MQ._E2_SQL.strip().replace("WITH ", "WITH RECURSIVE ", 1)},
{T_SQL},
eff AS ({EFFECTIVE_SQL})
SELECT DISTINCT app_id, 'permission' AS section, permission_attr AS item, '{{"permission":"' || permission_attr || '"}}' AS body FROM fx_components WHERE permission_attr IS NOT NULL
UNION ALL SELECT app_id, 'component', component, '{{"component":"' || component || '","comp_type":"' || comp_type || '","exported":' || exported || ',"enabled":' || enabled
  || coalesce(',"permission":"' || permission || '"', '') || '}}' FROM eff
UNION ALL SELECT x.app_id, 'filter', x.component || '#' || filter_id, '{{"component":"' || x.component || '",' || {_FILTER_JSON} FROM xf x
UNION ALL SELECT app_id, 'icc_call', NULL, {_CALL_JSON} FROM i
UNION ALL SELECT app_id, 'icc_target', NULL, 'COMPONENT|EXPLICIT' FROM i WHERE component IS NOT NULL
UNION ALL SELECT app_id, 'icc_target', NULL, CASE WHEN NOT precise_explicit THEN 'KIND|EXPLICIT' ELSE 'KIND_WITH_FILTER|IMPLICIT' END FROM i WHERE NOT (precise_explicit AND precise_implicit)
UNION ALL SELECT app_id, 'icc_target', NULL, 'FILTER|IMPLICIT' FROM t WHERE scope = 'FILTER'
UNION ALL SELECT app_id, 'taint_' || role, CAST(node AS VARCHAR), '{{"node":' || node || ',"category":"' || category || '","descriptor":"' || descriptor || '"}}' FROM fx_taint_nodes
UNION ALL SELECT app_id, 'taint_path', source || '->' || sink || '->' || problem, '{{"source":' || source || ',"sink":' || sink || ',"problem":"' || problem || '"}}'
  FROM pairs WHERE problem IS NOT NULL""",
)
def app_report(f):
    """All rows of every app's report.  Calls are named by hashes, so their items are left out of the comparison, and
    targets are compared by scope and type here and by content in e2."""
    r = resolve_intents(MQ.intents(f), MQ.filters(f))
    pairs = T.taint_reachability(f["fx_dep_edges"], f["fx_taint_nodes"])
    report = R.app_report(permissions(f), components(f), MQ.filters(f), r.calls, r.targets, f["fx_taint_nodes"], pairs)
    target = F.concat_ws("|", F.get_json_object("body", "$.scope"), F.get_json_object("body", "$.target_type"))
    return report.select(
        "app_id",
        "section",
        F.when(~F.col("section").startswith("icc_"), F.col("item")).alias("item"),
        F.when(F.col("section") == "icc_target", target).otherwise(F.col("body")).alias("body"),
    )


@query(
    "b3_summary_report",
    f"""
WITH c AS ({EFFECTIVE_SQL}), k AS (SELECT *, CASE comp_type WHEN 'ACTIVITY' THEN 'activities' WHEN 'RECEIVER' THEN 'receivers' WHEN 'SERVICE' THEN 'services' END AS section FROM c)
SELECT app_id, 'permissions' AS section, permission_attr AS item, '{{}}' AS body FROM fx_components WHERE permission_attr IS NOT NULL GROUP BY ALL
UNION ALL SELECT app_id, section, component, '{{"exported":' || exported || coalesce(',"permission":"' || permission || '"', '') || '}}' FROM k WHERE section IS NOT NULL
UNION ALL SELECT k.app_id, section, component || '/Filter1', '{{' || {_FILTER_JSON} FROM k JOIN fx_components fc USING (app_id, component) JOIN fx_filters x ON x.component_id = fc.component_id WHERE section IS NOT NULL
UNION ALL SELECT DISTINCT app_id, 'libraries', 'com.tapjoy.', '{{}}' FROM fx_code_units WHERE class_name LIKE 'com.tapjoy.%'
UNION ALL SELECT DISTINCT app_id, 'urls', url, '{{}}' FROM fx_page_urls""",
)
def summary_report(f):
    from appfacts.operators.manifest import used_library_prefixes

    libraries = used_library_prefixes(f["fx_code_units"]).withColumnRenamed("prefix", "library")
    return R.summary_report(permissions(f), components(f), MQ.filters(f), libraries, f["fx_page_urls"])


@query(
    "l1_ingested_apps",
    """SELECT app_id, component FROM fx_components""",
)
def ingested(f):
    """Component facts that arrive in two deliveries, the second with further rows of apps of the first."""
    folder = new_folder(f.spark)
    c = f["fx_components"].select("app_id", "component")
    schema = c.schema

    def deliver(part):
        part.write.mode("append").parquet(f"{folder}/in")
        ingest_apps(f.spark, f"{folder}/in", schema, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()

    # Part of the rows of every second app, some of them twice; the rest of those apps comes later.
    first = f["fx_components"].where("app_id % 2 = 0 AND component_id % 3 = 0").select("app_id", "component")
    deliver(first.unionByName(first.where("app_id % 4 = 0")))
    deliver(c)
    return f.spark.read.parquet(f"{folder}/out/facts").select("app_id", "component")


@query(
    "l2_stage_status",
    """SELECT app_id, CASE WHEN bool_or(component_id % 19 = 0 OR enabled_attr = 'false') THEN 'failed' ELSE 'ok' END AS status,
  min(CASE WHEN component_id % 19 = 0 THEN 'bad id' WHEN enabled_attr = 'false' THEN 'disabled' END) AS error FROM fx_components GROUP BY 1""",
)
def status(f):
    ok, failed = with_status(
        f["fx_components"], {"bad id": F.col("component_id") % 19 != 0, "disabled": F.coalesce(F.col("enabled_attr") != "false", F.lit(True))}
    )
    return stage_status(ok, [failed])
