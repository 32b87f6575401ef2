"""Queries on text, URLs, signatures and hashes."""

from pyspark.sql import functions as F

from appfacts.functions import text as X
from appfacts.operators.skew import number_rows
from appfacts.plans.registry import query
from appfacts.sources import lines as L


@query(
    "d5_signature_parts",
    """SELECT callee_sig, replace(regexp_extract(callee_sig, '^L([^;]+);', 1), '/', '.') AS cls, regexp_extract(callee_sig, ';\\.([^:]+):', 1) AS name,
  regexp_extract(callee_sig, ';\\.(.+)$', 1) AS sub_sig, regexp_extract(callee_sig, '\\((.*)\\)', 1) AS params, COUNT(*) AS n FROM fx_call_sites GROUP BY ALL""",
)
def signature_parts(f):
    return f["fx_call_sites"].groupBy("callee_sig").agg(F.count(F.lit(1)).alias("n")).select(
        "callee_sig", X.signature_parts("callee_sig").alias("p"), "n"
    ).select("callee_sig", "p.cls", "p.name", "p.sub_sig", "p.params", "n")


@query(
    "a7_permission_map",
    """
WITH h AS (SELECT *, last_value(CASE WHEN line LIKE 'Permission:%' THEN substr(line, 12) END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no) AS permission FROM fx_permission_lines)
SELECT DISTINCT permission, 'L' || replace(regexp_extract(line, '^<([^:]+):', 1), '.', '/') || ';.' || regexp_extract(line, 'void (m[0-9]+)', 1) || ':(IJ)V' AS signature
FROM h WHERE line LIKE '<%'""",
)
def permission_map(f):
    return L.parse_permission_map(f["fx_permission_lines"])


@query(
    "j1_carried_headers",
    """
SELECT file_id, line_no, last_value(CASE WHEN line LIKE 'Permission:%' THEN line END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no) AS header
FROM (SELECT file_id % 3 AS file_id, line_no, line FROM fx_permission_lines)""",
)
def carried_headers(f):
    lines = f["fx_permission_lines"].withColumn("file_id", F.col("file_id") % 3)
    header = F.when(F.col("line").startswith("Permission:"), F.col("line"))
    return L.carry_header(lines, header, ["file_id"], "line_no").select("file_id", "line_no", "header")


@query(
    "a9_usage_report",
    """
WITH t AS (SELECT file_id, line_no, CASE WHEN line_no % 500 = 250 THEN 'Non Public Method List:' WHEN line_no % 3 = 0 THEN 'api.C' || line_no % 70 || ' ' || line_no % 9 ELSE 'free text here' END AS line
  FROM fx_permission_lines),
h AS (SELECT *, max(CASE WHEN line LIKE 'Non Public%' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS s FROM t)
SELECT file_id, CASE s WHEN 1 THEN 'nonpublic' ELSE 'hidden' END AS kind, split_part(line, ' ', 1) AS api, CAST(split_part(line, ' ', 2) AS BIGINT) AS n FROM h WHERE line LIKE 'api.%'""",
)
def usage_report(f):
    no = F.col("line_no")
    line = (
        F.when(no % 500 == 250, L.NON_PUBLIC_HEADER)
        .when(no % 3 == 0, F.concat(F.lit("api.C"), (no % 70).cast("string"), F.lit(" "), (no % 9).cast("string")))
        .otherwise("free text here")
    )
    return L.read_usage_report(f["fx_permission_lines"].withColumn("line", line))


@query(
    "a8_api_list",
    """SELECT DISTINCT 'hidden' AS kind, class_name, method FROM fx_framework WHERE is_public
UNION SELECT 'nonpublic', class_name, method FROM fx_framework WHERE NOT is_public""",
)
def api_list(f):
    sig = F.concat(F.lit("L"), F.translate("class_name", ".", "/"), F.lit(";."), F.col("method"), F.lit(":()V")).alias("value")
    m = f["fx_framework"]
    return L.read_api_list(m.where("is_public").select(sig), m.where("NOT is_public").select(sig))


@query(
    "d7_page_urls",
    """SELECT page_id, url FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(url || ' ' || html, '(?:https?|ftp)://[^\\s"''<>()\\[\\]{}\\\\]+')) AS url FROM pages)""",
)
def page_urls(f):
    return f["pages"].select("page_id", F.explode(X.extract_urls(F.concat_ws(" ", "url", "html"))).alias("url"))


@query("d8_url_hosts", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def url_hosts(f):
    return f["pages"].select("page_id", X.url_host("url").alias("host")).where("host IS NOT NULL")


@query(
    "d9_extracted_matches",
    "SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS found FROM documents",
)
def extracted_matches(f):
    return f["documents"].select("doc_id", F.explode(X.extract_all("text", "[A-Za-z0-9._]+@[A-Za-z0-9.]+")).alias("found"))


@query(
    "d10_substring_counts",
    "SELECT doc_id, CAST((length(text) - length(replace(text, 'the ', ''))) / 4 AS BIGINT) AS n FROM documents",
)
def substring_counts(f):
    return f["documents"].select("doc_id", X.count_substring("text", "the ").cast("bigint").alias("n"))


def _pairs(h):
    return f"rtrim(regexp_replace(upper({h}), '(..)', '\\1:', 'g'), ':')"


@query(
    "d11_fingerprints",
    f"SELECT doc_id, {_pairs('md5(text)')} AS md5, {_pairs('sha1(text)')} AS sha1, {_pairs('sha256(text)')} AS sha256 FROM documents",
)
def fingerprints(f):
    return f["documents"].select("doc_id", X.fingerprints(F.col("text").cast("binary")).alias("p")).select("doc_id", "p.*")


@query(
    "d12_literals",
    """
WITH v AS (SELECT unit_id, unnest(list_concat(['android.api.C' || CAST(regexp_extract(code, 'v0 "android.api.C([0-9]+)"', 1) AS VARCHAR), 'm' || regexp_extract(code, 'v1 "m([0-9]+)"', 1),
  'android.api.C' || regexp_extract(code, 'Landroid/api/C([0-9]+);', 1)], [])) AS value FROM fx_code_units)
SELECT DISTINCT unit_id, value, CASE WHEN contains(value, '.') THEN 'class' ELSE 'name' END AS kind FROM v""",
)
def literals(f):
    lit = f["fx_code_units"].select("unit_id", X.string_and_class_literals("code").alias("l"))
    return lit.select("unit_id", F.explode("l.classes").alias("value"), F.lit("class").alias("kind")).unionByName(
        lit.select("unit_id", F.explode("l.names").alias("value"), F.lit("name").alias("kind"))
    )


@query(
    "d13_intent_kinds",
    """SELECT intent_id, CASE WHEN component IS NOT NULL AND coalesce(action, category, uri, mime) IS NOT NULL THEN 'MIXED' WHEN component IS NOT NULL THEN 'EXPLICIT' ELSE 'IMPLICIT' END AS kind,
  coalesce(action, category, uri, mime) IS NOT NULL OR NOT precise_implicit AS implicit FROM fx_intents""",
)
def intent_kinds(f):
    from appfacts.plans.matching import intents

    sets = ("actions", "categories", "uris", "mimes")
    return intents(f).select(
        "intent_id", X.intent_kind("component_names", *sets).alias("kind"), X.is_implicit(*sets, "precise_implicit").alias("implicit")
    )


@query(
    "d14_medians_and_buckets",
    "SELECT p_brand AS brand, CAST(FLOOR(median(p_size)) AS BIGINT) AS median_size, CAST(FLOOR(SUM(p_size) / 100.0) * 100 AS BIGINT) AS size_bucket FROM part GROUP BY 1",
)
def medians_and_buckets(f):
    return f["part"].groupBy(F.col("p_brand").alias("brand")).agg(
        X.int_median("p_size").alias("median_size"), X.bucket(F.sum("p_size"), 100).alias("size_bucket")
    )


@query(
    "d15_ports",
    "SELECT p_partkey, replace('\\ ' || p_size || CASE WHEN p_size % 2 = 0 THEN '\\ ' ELSE '' END, '\\ ', '') AS port FROM part",
)
def ports(f):
    raw = F.concat(F.lit("\\ "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "\\ ").otherwise(""))
    return f["part"].select("p_partkey", X.sanitize_port(raw).alias("port"))


@query(
    "d17_sdk_versions",
    """SELECT p_partkey, greatest(p_size % 5 - 1, 1) AS min, greatest(p_size % 7, p_size % 5 - 1, 1) AS target, greatest(p_size % 11, p_size % 7, p_size % 5 - 1, 1) AS max FROM part""",
)
def sdk_versions(f):
    s = F.col("p_size")
    return f["part"].select("p_partkey", X.normalize_sdk(s % 5 - 1, s % 7, s % 11).alias("v")).select("p_partkey", "v.min", "v.target", "v.max")


_MIME_SQL = """
SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'text/*' WHEN 2 THEN 'image/png' ELSE '*/*' END AS t,
  CASE l_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'text/plain' WHEN 2 THEN 'image/*' WHEN 3 THEN '*/*' WHEN 4 THEN 'image/png' ELSE 'text' END AS m FROM lineitem"""


@query(
    "d2_mime_matches",
    f"""SELECT row_id, CASE WHEN t IS NULL THEN m IS NULL WHEN m IS NULL THEN false ELSE
  regexp_full_match(m, '[^/]+/[^/]+') AND split_part(t, '/', 1) = split_part(m, '/', 1) AND (split_part(t, '/', 2) = split_part(m, '/', 2) OR split_part(t, '/', 2) = '*' OR split_part(m, '/', 2) = '*') END AS ok
FROM ({_MIME_SQL})""",
)
def mime_matches(f):
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    t = F.when(n % 4 == 1, "text/*").when(n % 4 == 2, "image/png").when(n % 4 == 3, "*/*")
    m = F.when(o % 6 == 1, "text/plain").when(o % 6 == 2, "image/*").when(o % 6 == 3, "*/*").when(o % 6 == 4, "image/png").when(o % 6 == 5, "text")
    mimes = F.when(t.isNotNull(), F.array(t)).otherwise(F.array().cast("array<string>"))
    return f["lineitem"].select((o * 10 + n).alias("row_id"), X.mime_matches(mimes, m).alias("ok"))


# Valid patterns of all kinds, and two that do not compile.
PATTERNS = ["/a.*", "/a|/b", "(/a|/ab)", "/a{1}", "^/a$", "/.*?b", "/[ab]+", "/((a)b)", "/a{2}", "/(a", "[/a"]
BROKEN = ["/(a", "[/a"]
_PATTERNS_SQL = "CASE l_quantity % 11 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATTERNS)) + " END"
_BROKEN_SQL = "(" + ", ".join(f"'{p}'" for p in BROKEN) + ")"

_URI_SQL = f"""
SELECT l_orderkey * 10 + l_linenumber AS row_id,
  CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'http' ELSE 'content' END AS s, CASE WHEN l_partkey % 4 = 1 AND l_partkey % 3 > 0 THEN 'h' || l_partkey % 3 END AS h,
  CASE WHEN l_partkey % 6 = 1 THEN '80' END AS p, CASE l_linenumber % 4 WHEN 1 THEN '/a' END AS path, CASE l_linenumber % 4 WHEN 2 THEN '/a' END AS prefix,
  CASE l_linenumber % 4 WHEN 3 THEN {_PATTERNS_SQL} END AS pat,
  CASE l_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'content' WHEN 2 THEN 'ftp' ELSE 'http' END AS us, CASE WHEN l_orderkey % 5 > 2 THEN 'h' || l_suppkey % 3 END AS uh,
  CASE WHEN l_orderkey % 7 = 1 THEN '80' WHEN l_orderkey % 7 = 2 THEN '81' END AS up, CASE l_suppkey % 3 WHEN 0 THEN '/a' WHEN 1 THEN '/ab' END AS upath FROM lineitem"""


@query(
    "d3_uri_matches",
    f"""SELECT row_id, CASE WHEN s IS NULL THEN us IS NULL WHEN us IS DISTINCT FROM s THEN false WHEN h IS NULL THEN true
  WHEN h IS DISTINCT FROM uh OR (p IS NOT NULL AND p IS DISTINCT FROM up) THEN false WHEN coalesce(path, prefix, pat) IS NULL THEN true WHEN upath IS NULL THEN false
  ELSE coalesce(upath = path, false) OR coalesce(starts_with(upath, prefix), false) OR coalesce(CASE WHEN pat IN {_BROKEN_SQL} THEN false ELSE regexp_full_match(upath, pat) END, false) END AS ok FROM ({_URI_SQL})""",
)
def uri_matches(f):
    facts = f["lineitem"].selectExpr(
        "l_orderkey * 10 + l_linenumber AS row_id",
        "CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'http' ELSE 'content' END AS s",
        "CASE WHEN l_partkey % 4 = 1 AND l_partkey % 3 > 0 THEN concat('h', l_partkey % 3) END AS h",
        "CASE WHEN l_partkey % 6 = 1 THEN '80' END AS p",
        "CASE l_linenumber % 4 WHEN 1 THEN '/a' END AS path",
        "CASE l_linenumber % 4 WHEN 2 THEN '/a' END AS prefix",
        f"CASE l_linenumber % 4 WHEN 3 THEN {_PATTERNS_SQL} END AS pat",
        "named_struct('scheme', CASE l_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'content' WHEN 2 THEN 'ftp' ELSE 'http' END,"
        " 'host', CASE WHEN l_orderkey % 5 > 2 THEN concat('h', l_suppkey % 3) END,"
        " 'port', CASE WHEN l_orderkey % 7 = 1 THEN '80' WHEN l_orderkey % 7 = 2 THEN '81' END,"
        " 'path', CASE l_suppkey % 3 WHEN 0 THEN '/a' WHEN 1 THEN '/ab' END) AS u",
    )
    data = F.struct(
        F.array_compact(F.array("s")).alias("schemes"),
        F.when(F.col("h").isNotNull(), F.array(F.struct(F.col("h").alias("host"), F.col("p").alias("port"))))
        .otherwise(F.array().cast("array<struct<host:string,port:string>>"))
        .alias("authorities"),
        F.array_compact(F.array("path")).alias("paths"),
        F.array_compact(F.array("prefix")).alias("path_prefixes"),
        F.array_compact(F.array("pat")).alias("path_patterns"),
    )
    return facts.withColumn("data", data).select("row_id", X.uri_matches("data", "u").alias("ok"))


@query(
    "d3_rejected_patterns",
    f"SELECT pat AS pattern, COUNT(*) AS n_filters FROM (SELECT {_PATTERNS_SQL} AS pat FROM lineitem) WHERE pat IN {_BROKEN_SQL} GROUP BY 1",
)
def rejected_patterns(f):
    """Path patterns that do not compile, with the number of filters that have them."""
    from appfacts.operators.matching import rejected_patterns as rejected

    data = F.struct(F.array_compact(F.array(F.expr(_PATTERNS_SQL))).alias("path_patterns"))
    rows = f["lineitem"].select(
        F.col("l_suppkey").alias("app_id"), F.lit("c").alias("component"), F.col("l_orderkey").alias("filter_id"), data.alias("data")
    )
    return rejected(rows)


@query(
    "j3_numbered_filters",
    "SELECT filter_id, row_number() OVER (PARTITION BY app_id % 4 ORDER BY filter_id) AS filter_no FROM fx_filters JOIN fx_components USING (component_id)",
)
def numbered_filters(f):
    g = f["fx_filters"].join(f["fx_components"].select("component_id", (F.col("app_id") % 4).alias("g")), "component_id")
    return number_rows(g.select("g", "filter_id"), ["g"], "filter_id", "filter_no").select("filter_id", "filter_no")


@query(
    "d6_jvm_signatures",
    """SELECT event_id, 'La/b/C' || user_id % 30 || ';.m' || event_id % 50 || ':(' || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'I[J' WHEN 2 THEN 'Ljava/lang/String;Z' ELSE '[[Lx/Y;' END || ')'
  || CASE event_id % 3 WHEN 0 THEN 'V' WHEN 1 THEN '[B' ELSE 'Lq/R;' END AS signature FROM events""",
)
def jvm_signatures(f):
    return f["events"].selectExpr(
        "event_id",
        "concat('<a.b.C', user_id % 30, ': ', CASE event_id % 3 WHEN 0 THEN 'void' WHEN 1 THEN 'byte[]' ELSE 'q.R' END, ' m', event_id % 50, '(',"
        " CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'int,long[]' WHEN 2 THEN 'java.lang.String,boolean' ELSE 'x.Y[][]' END, ')>  (x)') AS line",
    ).select("event_id", X.java_to_jvm_signature("line").alias("signature"))


