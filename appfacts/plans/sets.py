"""Set-operation queries."""

from pyspark.sql import functions as F

from appfacts import constants as K
from appfacts.operators import manifest as M
from appfacts.operators import setops as O
from appfacts.operators import studies as S
from appfacts.plans.registry import query
from appfacts.plans.studies import _USAGE_SQL


@query(
    "i1_corpus_diff",
    f"""WITH {_USAGE_SQL.strip()},
a AS (SELECT DISTINCT kind, api FROM u JOIN fx_apps p USING (app_id) WHERE p.corpus = 'benign'), b AS (SELECT DISTINCT kind, api FROM u JOIN fx_apps p USING (app_id) WHERE p.corpus = 'malware')
SELECT 'benign' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'malware', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def corpus_diff(f):
    u = S.hidden_api_usage(f["fx_code_units"], f["fx_api_list"]).join(f["fx_apps"].select("app_id", "corpus"), "app_id")
    return O.corpus_diff(u.where("corpus = 'benign'"), u.where("corpus = 'malware'"), "benign", "malware")


_HIDDEN_SQL = """
hid AS (SELECT DISTINCT class_name, method FROM fx_framework WHERE (starts_with(class_name, 'android.') OR starts_with(class_name, 'com.android.')) AND is_public AND NOT is_abstract AND NOT is_constructor
  EXCEPT SELECT class_name, method FROM fx_sdk)"""


def hidden(f):
    return O.hidden_apis(M.candidate_api_methods(f["fx_framework"]).select("class_name", "method"), f["fx_sdk"])


@query("i2_hidden_apis", f"WITH {_HIDDEN_SQL.strip()} SELECT * FROM hid")
def hidden_apis(f):
    return hidden(f)


@query(
    "i3_service_hidden_apis",
    f"WITH {_HIDDEN_SQL.strip()} SELECT * FROM hid INTERSECT SELECT class_name, method FROM fx_framework WHERE method_id % 4 = 2",
)
def service_hidden_apis(f):
    services = f["fx_framework"].where("method_id % 4 = 2").select("class_name", "method")
    return O.service_hidden_apis(services, hidden(f))


_URL_RE = """(?:https?|ftp)://[^\\s"''<>()\\[\\]{}\\\\]+"""
_APP_URL_SQL = f"""
urls AS (SELECT DISTINCT app_id, origin, unnest(regexp_extract_all(code, '{_URL_RE}')) AS url FROM fx_code_units
  UNION SELECT app_id, origin, unnest(regexp_extract_all(value, '{_URL_RE}')) FROM fx_strings)"""


def urls(f):
    return O.app_urls(f["fx_code_units"], O.resource_strings(f["fx_strings"], f["fx_strings"]))


@query("i5_app_urls", f"WITH {_APP_URL_SQL.strip()} SELECT * FROM urls")
def app_urls(f):
    return urls(f)


@query("a4_resource_strings", "SELECT DISTINCT app_id, origin, value FROM fx_strings UNION SELECT DISTINCT app_id, 'pool', url FROM fx_page_urls")
def resource_strings(f):
    pool = f["fx_page_urls"].select("app_id", F.lit("pool").alias("origin"), F.col("url").alias("value"))
    return O.resource_strings(f["fx_strings"], pool)


@query(
    "i7_url_cascade",
    f"""SELECT host, CAST(CASE WHEN regexp_full_match(host, '{K.COMMON_SITES_PATTERN}') THEN 0 WHEN regexp_full_match(host, '{K.AD_SITES_PATTERN}') THEN 1
  WHEN regexp_full_match(host, '{K.ORG_SITES_PATTERN}') THEN 2 ELSE 3 END AS BIGINT) AS level
FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)""",
)
def url_cascade(f):
    return O.url_cascade(f["pages"])


LISTS = ["short", "long"]
_LIST_SQL = """
lists AS (SELECT DISTINCT 'short' AS list_name, 'see ' || url AS entry FROM pages WHERE page_id % 3 = 0
  UNION SELECT DISTINCT 'long', url || '/more' FROM pages WHERE page_id % 4 > 0),
au AS (SELECT DISTINCT app_id, url FROM fx_page_urls),
hit AS (SELECT DISTINCT u.url, l.list_name FROM (SELECT DISTINCT url FROM au) u JOIN lists l ON contains(l.entry, u.url)),
c AS (SELECT au.app_id, hit.list_name, COUNT(*) AS n_listed FROM au JOIN hit USING (url) GROUP BY 1, 2),
n AS (SELECT app_id, COUNT(*) AS n_urls FROM au GROUP BY 1),
perm AS (SELECT DISTINCT app_id, 'perm.' || CAST(FLOOR(component_id / 30.0) AS BIGINT) || comp_type AS permission FROM fx_components)"""


def url_lists(f):
    p = f["pages"]
    return (
        p.where("page_id % 3 = 0").selectExpr("'short' AS list_name", "concat('see ', url) AS entry")
        .unionByName(p.where("page_id % 4 > 0").selectExpr("'long' AS list_name", "concat(url, '/more') AS entry"))
        .distinct()
    )


def permissions(f):
    return f["fx_components"].selectExpr("app_id", "concat('perm.', CAST(FLOOR(component_id / 30.0) AS BIGINT), comp_type) AS permission").distinct()


@query("e19_listed_urls", f"WITH {_LIST_SQL.strip()} SELECT c.app_id, c.list_name, n.n_urls, c.n_listed FROM c JOIN n USING (app_id)")
def listed_urls(f):
    return O.url_permission_join(f["fx_page_urls"], url_lists(f))


@query(
    "i4_exclusive_permissions",
    f"""WITH {_LIST_SQL.strip()}
SELECT DISTINCT c.list_name, perm.permission FROM c JOIN perm USING (app_id)
EXCEPT SELECT l.list_name, perm.permission FROM n JOIN (SELECT DISTINCT list_name FROM lists) l ON true LEFT JOIN c ON c.app_id = n.app_id AND c.list_name = l.list_name
  JOIN perm ON perm.app_id = n.app_id WHERE coalesce(c.n_listed, 0) < n.n_urls""",
)
def exclusive_permissions(f):
    return O.exclusive_permissions(f["fx_page_urls"], permissions(f), url_lists(f), LISTS)
