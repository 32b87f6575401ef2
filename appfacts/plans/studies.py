"""Corpus-study queries."""

from pyspark.sql import functions as F

from appfacts import constants as K
from appfacts.operators import studies as S
from appfacts.plans.registry import query

_USAGE_SQL = """
u AS (SELECT DISTINCT u.app_id, a.kind, a.class_name || '.' || a.method AS api FROM fx_code_units u
  JOIN fx_api_list a ON (contains(u.code, '"' || a.class_name || '"') OR contains(u.code, 'L' || replace(a.class_name, '.', '/') || ';'))
    AND contains(u.code, '"' || a.method || '"'))"""


def usage(f):
    return S.hidden_api_usage(f["fx_code_units"], f["fx_api_list"])


@query("e11_hidden_api_usage", f"WITH {_USAGE_SQL.strip()} SELECT * FROM u")
def hidden_api_usage(f):
    return usage(f)


@query("f6_api_usage_counts", f"WITH {_USAGE_SQL.strip()} SELECT kind, api, COUNT(DISTINCT app_id) AS n_apps FROM u GROUP BY 1, 2")
def api_usage_counts(f):
    return S.api_usage_counts(usage(f))


_AD_KEYS = ", ".join(f"'{k}'" for k in K.AD_NETWORK_KEYS)
_AD_CLASS = """CASE class_id % 5 WHEN 0 THEN 'com.tapjoy.x.C' WHEN 1 THEN 'com.inmobi.admob.C' WHEN 2 THEN 'org.sense.C' ELSE 'com.app.C' END"""


@query(
    "f7_ad_library_counts",
    f"""SELECT k AS ad_network, COUNT(DISTINCT app_id) AS n_apps FROM (SELECT class_id // 20 AS app_id, regexp_extract({_AD_CLASS} || class_id, '^(.+)\\.[^.]+$', 1) AS package FROM fx_classes)
JOIN (SELECT unnest([{_AD_KEYS}]) AS k) ON contains(package, k) GROUP BY 1""",
)
def ad_library_counts(f):
    c = f["fx_classes"].selectExpr("class_id div 20 AS app_id", f"concat({_AD_CLASS}, class_id) AS class_name")
    return S.ad_library_counts(c)


def _probe_sql():
    parts = []
    for name, app, lib, login in K.PROVIDER_PROBES:
        a = " OR ".join(f"contains(code, '{n}')" for n in app)
        b = " OR ".join(f"contains(code, '{n}')" for n in lib)
        where = f"(origin = 'library' AND ({b})) OR (origin <> 'library' AND ({a}))"
        parts += [f"SELECT app_id, '{p}' AS probe FROM fx_code_units WHERE {where}" for p in ([name, "any"] if login else [name])]
    return " UNION ".join(parts)


@query("f8_provider_probes", f"SELECT probe, COUNT(*) AS n_apps FROM ({_probe_sql()}) GROUP BY 1")
def provider_probes(f):
    return S.provider_probe(f["fx_code_units"])


# Login texts: a phrase is put before each document's text so that every family occurs.
_PHRASE = """CASE {k} % 8 WHEN 0 THEN 'sign on with Google ' WHEN 1 THEN 'auth_token ' WHEN 2 THEN 'request token ' WHEN 3 THEN 'auth code '
  WHEN 4 THEN 'facebook login ' WHEN 5 THEN 'OAuth pincode ' ELSE '' END"""
_ORIGIN = "CASE doc_id % 3 WHEN 0 THEN 'resource' WHEN 1 THEN 'application' ELSE 'library' END"


def _login_sql():
    return " UNION ".join(
        f"SELECT '{fam}' AS family, app_id, unit_id, origin, unnest(regexp_extract_all(text, '{p}')) AS match FROM t"
        for fam, p in K.LOGIN_PATTERNS.items()
    )


@query(
    "f9_login_strings",
    f"""WITH t AS (SELECT doc_id % 10 AS app_id, doc_id AS unit_id, {_ORIGIN} AS origin, {_PHRASE.format(k='doc_id')} || text AS text FROM documents), s AS ({_login_sql()})
SELECT family, origin, COUNT(DISTINCT app_id) AS n_apps, COUNT(DISTINCT unit_id) AS n_units, COUNT(DISTINCT match) AS n_strings FROM s GROUP BY 1, 2""",
)
def login_strings(f):
    t = f["documents"].selectExpr("doc_id % 10 AS app_id", "doc_id AS unit_id", f"{_ORIGIN} AS origin", f"concat({_PHRASE.format(k='doc_id')}, text) AS text")
    return S.login_string_counts(t)


@query(
    "f10_feature_flags",
    f"""WITH own AS (SELECT * FROM fx_code_units WHERE class_name LIKE 'com.app.%')
SELECT a.app_id, coalesce(bool_or(contains(code, ';.loadClass:(Ljava/lang/String;)Ljava/lang/Class;')), false) AS dynamic_loading,
  coalesce(bool_or(contains(code, 'Ljava/lang/Class;.forName:') OR contains(code, 'java.lang.reflect.')), false) AS reflection,
  coalesce(bool_or(contains(code, 'NATIVE {{')), false) AS native_code
FROM (SELECT DISTINCT app_id FROM fx_code_units) a LEFT JOIN own USING (app_id) GROUP BY 1""".replace("{{", "{"),
)
def feature_flags(f):
    return S.feature_flags(f["fx_code_units"])


@query(
    "f11_run_summary",
    """SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE app_id % 5 <> 0) AS have_result, COUNT(*) FILTER (WHERE app_id % 5 <> 0 AND app_id % 3 > 0) AS with_path,
  CAST(SUM(CASE WHEN app_id % 5 <> 0 THEN app_id % 3 END) AS BIGINT) AS total_paths FROM fx_apps""",
)
def run_summary(f):
    a = f["fx_apps"]
    return S.run_summary(a, a.where("app_id % 5 <> 0").selectExpr("app_id", "app_id % 3 AS n_paths"))


@query(
    "f11_run_apps",
    """SELECT app_id, CASE WHEN app_id % 5 = 0 THEN 'no result' WHEN app_id % 3 > 0 THEN 'path' ELSE 'no path' END AS status,
  CASE WHEN app_id % 5 <> 0 THEN app_id % 3 END AS n_paths FROM fx_apps""",
)
def run_apps(f):
    a = f["fx_apps"]
    return S.run_apps(a, a.where("app_id % 5 <> 0").selectExpr("app_id", "app_id % 3 AS n_paths"))


_KINDS = ["ACTIVITY", "SERVICE", "RECEIVER", "PROVIDER"]


@query(
    "f4_frequency_matrix",
    "SELECT app_id, " + ", ".join(f"nullif(COUNT(*) FILTER (WHERE comp_type = '{k}'), 0) AS {k}" for k in _KINDS) + " FROM fx_components GROUP BY 1",
)
def frequency_matrix(f):
    """Components per app with one column for each kind."""
    return S.frequency_matrix(f["fx_components"], "comp_type", _KINDS)


_SUBS = [s for s, _ in K.ICC_SUBSIGS]
_HAS = " OR ".join(f"contains(code, '{s}')" for s in _SUBS)
_N = " + ".join(f"(length(code) - length(replace(code, '{s} @classDescriptor', ''))) // {len(s) + 17}" for s in _SUBS)


@query(
    "f14_icc_census",
    f"""SELECT COUNT(DISTINCT CASE WHEN {_HAS} THEN app_id END) AS n_apps_with_icc, CAST(SUM({_N}) AS BIGINT) AS n_icc_calls FROM fx_code_units""",
)
def icc_census(f):
    return S.icc_census(f["fx_code_units"])


@query(
    "f15_signer_groups",
    """SELECT rtrim(regexp_replace(upper(sha256('key' || (s_suppkey % 17))), '(..)', '\\1:', 'g'), ':') AS sha256, COUNT(*) AS n_apps FROM supplier GROUP BY 1""",
)
def signer_groups(f):
    der = F.concat(F.lit("key"), (F.col("s_suppkey") % 17).cast("string")).cast("binary")
    return S.signer_groups(f["supplier"].select(F.col("s_suppkey").alias("app_id"), der.alias("der")))
