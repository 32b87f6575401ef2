"""Queries on components, classes, methods and controls."""

from pyspark.sql import functions as F

from appfacts import constants as K
from appfacts.functions import text as X
from appfacts.operators import manifest as M
from appfacts.plans.registry import query
from appfacts.session import local_table
from appfacts.sources.xml import read_layouts, read_manifests


def any_prefix(col, prefixes):
    return "(" + " OR ".join(f"starts_with({col}, '{p}')" for p in prefixes) + ")"


def filters_by_component(f):
    return f["fx_filters"].join(f["fx_components"].select("component_id", "app_id", "component"), "component_id")


def components(f):
    return M.effective_component_attrs(f["fx_components"], filters_by_component(f))


NAMES_SQL = """
SELECT component_id, CASE component_id % 4 WHEN 0 THEN '.C' || component_id WHEN 1 THEN 'C' || component_id
  WHEN 2 THEN 'c' || component_id ELSE 'a.b.c' || component_id END AS name,
  CASE WHEN component_id % 5 = 0 THEN '' ELSE 'com.app' || app_id END AS package
FROM fx_components"""


@query(
    "c1_qualified_names",
    f"""
SELECT component_id, CASE WHEN starts_with(name, '.') THEN package || name
  WHEN substr(name, 1, 1) = upper(substr(name, 1, 1)) THEN package || '.' || name
  WHEN package <> '' AND NOT contains(name, '.') THEN package || '.' || name ELSE name END AS component
FROM ({NAMES_SQL})""",
)
def qualified_names(f):
    i = F.col("component_id")
    s = i.cast("string")
    name = (
        F.when(i % 4 == 0, F.concat(F.lit(".C"), s))
        .when(i % 4 == 1, F.concat(F.lit("C"), s))
        .when(i % 4 == 2, F.concat(F.lit("c"), s))
        .otherwise(F.concat(F.lit("a.b.c"), s))
    )
    package = F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("com.app"), F.col("app_id").cast("string")))
    return f["fx_components"].select("component_id", X.qualify_component_name(name, package).alias("component"))


EFFECTIVE_SQL = """
SELECT c.app_id, c.component, c.comp_type,
  CASE WHEN exported_attr IS NOT NULL THEN exported_attr <> 'false' WHEN comp_type = 'PROVIDER' THEN true
    ELSE EXISTS (SELECT 1 FROM fx_filters x WHERE x.component_id = c.component_id) END AS exported,
  coalesce(enabled_attr <> 'false', true) AS enabled, permission_attr AS permission
FROM fx_components c"""


@query("c2_effective_attributes", EFFECTIVE_SQL)
def effective_attributes(f):
    return components(f).select("app_id", "component", "comp_type", "exported", "enabled", "permission")


def _classes_with_origin(f):
    return f["fx_classes"].select(
        F.floor(F.col("class_id") / 20).alias("app_id"),
        F.concat(F.lit("com.app.C"), F.col("class_id").cast("string")).alias("class_name"),
        F.when(F.col("class_id") % 3 == 0, "library").otherwise("application").alias("origin"),
    )


@query(
    "c3_entry_points",
    f"""
SELECT app_id, component, comp_type, exported AS is_main FROM ({EFFECTIVE_SQL})
WHERE enabled AND component IN (SELECT 'com.app.C' || class_id FROM fx_classes WHERE class_id % 3 <> 0)""",
)
def entry_points(f):
    return M.entry_points(components(f), _classes_with_origin(f))


@query(
    "c4_component_kind",
    """
SELECT app_id, component, CASE min(r) WHEN 1 THEN 'ACTIVITY' WHEN 2 THEN 'SERVICE' WHEN 3 THEN 'RECEIVER' ELSE 'PROVIDER' END AS comp_type
FROM (SELECT app_id, 'n' || component_id % 7 AS component,
        CASE comp_type WHEN 'ACTIVITY' THEN 1 WHEN 'SERVICE' THEN 2 WHEN 'RECEIVER' THEN 3 ELSE 4 END AS r FROM fx_components)
GROUP BY app_id, component""",
)
def component_kind(f):
    """Names are shortened so that several kinds share one."""
    return M.component_kind(
        f["fx_components"].withColumn("component", F.concat(F.lit("n"), (F.col("component_id") % 7).cast("string")))
    )


@query(
    "c5_library_classes",
    f"SELECT class_id, class_name, {any_prefix('class_name', K.LIBRARY_PREFIXES)} AS is_library FROM fx_classes",
)
def library_classes(f):
    return f["fx_classes"].select("class_id", "class_name", X.is_library_class("class_name").alias("is_library"))


@query(
    "c6_without_third_party",
    f"SELECT unit_id, class_name FROM fx_code_units WHERE NOT {any_prefix('class_name', K.THIRD_PARTY_PREFIXES)}",
)
def without_third_party(f):
    return M.exclude_third_party(f["fx_code_units"]).select("unit_id", "class_name")


_GEN_SQL = """
SELECT p_partkey AS class_id, CAST(FLOOR(p_partkey / 20.0) AS BIGINT) AS app_id, 'com.app' || CAST(FLOOR(p_partkey / 20.0) AS BIGINT) AS package,
  CASE p_size % 8 WHEN 0 THEN 'android.support.v4.A' || p_partkey WHEN 1 THEN 'android.support.v13.A' || p_partkey
    WHEN 2 THEN 'android.support.v7.A' || p_partkey WHEN 3 THEN 'com.app' || CAST(FLOOR(p_partkey / 20.0) AS BIGINT) || '.R'
    WHEN 4 THEN 'com.app' || CAST(FLOOR(p_partkey / 20.0) AS BIGINT) || '.R$id' WHEN 5 THEN 'com.app' || CAST(FLOOR(p_partkey / 20.0) AS BIGINT) || '.Manifest$p'
    WHEN 6 THEN 'com.app' || CAST(FLOOR(p_partkey / 20.0) AS BIGINT) || '.BuildConfig' ELSE 'com.app.C' || p_partkey END AS class_name
FROM part"""


def _generated(f):
    app = F.floor(F.col("p_partkey") / 20)
    pkg = F.concat(F.lit("com.app"), app.cast("string"))
    names = {0: "android.support.v4.A", 1: "android.support.v13.A", 2: "android.support.v7.A"}
    tails = {3: ".R", 4: ".R$id", 5: ".Manifest$p", 6: ".BuildConfig"}
    key = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("com.app.C"), key)
    for k, n in names.items():
        name = F.when(F.col("p_size") % 8 == k, F.concat(F.lit(n), key)).otherwise(name)
    for k, t in tails.items():
        name = F.when(F.col("p_size") % 8 == k, F.concat(pkg, F.lit(t))).otherwise(name)
    return f["part"].select(F.col("p_partkey").alias("class_id"), app.alias("app_id"), pkg.alias("package"), name.alias("class_name"))


@query("c7_kept_classes", f"SELECT app_id, class_id, class_name FROM ({_GEN_SQL}) WHERE class_name LIKE 'com.app.C%'")
def kept_classes(f):
    return M.drop_generated_classes(_generated(f))[0].select("app_id", "class_id", "class_name")


@query(
    "c7_dependencies",
    f"""
SELECT DISTINCT app_id, CASE WHEN class_name LIKE 'android.support.v4%' THEN 'support-v4'
  WHEN class_name LIKE 'android.support.v13%' THEN 'support-v13' ELSE 'appcompat-v7' END AS dependency
FROM ({_GEN_SQL}) WHERE class_name LIKE 'android.support.%'""",
)
def dependencies(f):
    return M.drop_generated_classes(_generated(f))[1]


@query(
    "c8_scope",
    """
SELECT class_id, class_name, is_library AND package NOT IN ('android.view', 'com.google') AS bypass_include,
  is_library AND package IN ('android.view', 'com.google') AS bypass_exclude
FROM (SELECT *, class_id % 3 = 0 AS is_library, regexp_extract(class_name, '^(.+)\\.[^.]+$', 1) AS package FROM fx_classes)""",
)
def scope(f):
    classes = f["fx_classes"].withColumn("origin", F.when(F.col("class_id") % 3 == 0, "library").otherwise("application"))
    listed = local_table(f.spark, [("android.view",), ("com.google",)], "package_name string")
    once = M.in_scope(classes, listed, include=True).withColumnRenamed("bypass", "bypass_include")
    both = M.in_scope(once, listed, include=False).withColumnRenamed("bypass", "bypass_exclude")
    return both.select("class_id", "class_name", "bypass_include", "bypass_exclude")


@query(
    "c9_icc_calls",
    "SELECT app_id, site_id, owner, 'ACTIVITY' AS comp_type FROM fx_call_sites WHERE callee_sig LIKE '%.startActivity:(Landroid/content/Intent;)V'",
)
def icc_calls(f):
    return M.classify_icc_call(f["fx_call_sites"]).select("app_id", "site_id", "owner", "comp_type")


@query(
    "c10_rpc_methods",
    """
SELECT c.app_id, m.class_id, m.sub_sig FROM fx_methods m JOIN fx_components c ON c.component_id = m.class_id
WHERE c.comp_type = 'SERVICE' AND NOT m.is_constructor""",
)
def rpc_methods(f):
    methods = f["fx_methods"].select(
        F.floor(F.col("class_id") / 20).alias("app_id"),
        "class_id",
        F.concat(F.lit("com.app.C"), F.col("class_id").cast("string")).alias("class_name"),
        "sub_sig",
        "is_constructor",
    )
    return M.rpc_methods(f["fx_components"], methods).select("app_id", "class_id", "sub_sig")


@query(
    "c11_candidate_api_methods",
    """
SELECT class_name, method, is_public FROM fx_framework
WHERE (starts_with(class_name, 'android.') OR starts_with(class_name, 'com.android.')) AND NOT is_constructor
  AND ((is_public AND NOT is_abstract) OR NOT is_public)""",
)
def candidate_api_methods(f):
    m = f["fx_framework"]
    return M.candidate_api_methods(m).unionByName(M.non_public_methods(m)).select("class_name", "method", "is_public")


@query(
    "c12_sensitive_controls",
    """
SELECT app_id, control_id, view_class,
  bool_or((attr = 'android:password' AND value = 'true') OR (attr = 'android:inputType' AND contains(value, 'Password'))) AS is_sensitive
FROM fx_layout_attrs GROUP BY 1, 2, 3""",
)
def sensitive_controls(f):
    return M.sensitive_controls(f["fx_layout_attrs"])


@query(
    "c14_interesting_assignments",
    """
SELECT site_id, kind FROM (SELECT l_orderkey * 10 + l_linenumber AS site_id, CASE l_linenumber % 3 WHEN 0 THEN 'call' ELSE 'assign' END AS kind,
  CASE l_partkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'cast' ELSE 'name' END AS rhs, CASE l_partkey % 5 WHEN 0 THEN 'object' ELSE 'int' END AS assign_kind
  FROM lineitem)
WHERE kind = 'call' OR rhs IN ('new', 'cast') OR assign_kind = 'object'""",
)
def interesting_assignments(f):
    stmts = f["lineitem"].selectExpr(
        "l_orderkey * 10 + l_linenumber AS site_id",
        "CASE l_linenumber % 3 WHEN 0 THEN 'call' ELSE 'assign' END AS kind",
        "CASE l_partkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'cast' ELSE 'name' END AS rhs",
        "CASE l_partkey % 5 WHEN 0 THEN 'object' ELSE 'int' END AS assign_kind",
    )
    return M.interesting_assignments(stmts).select("site_id", "kind")


_VIEW_NAMES_SQL = """
SELECT DISTINCT p_partkey % 10 AS app_id, 'com.app' AS package, CASE WHEN p_size % 4 = 0 THEN 'com.app.C' || p_size ELSE 'C' || p_size END AS name FROM part"""


@query(
    "d18_view_classes",
    f"""
WITH n AS ({_VIEW_NAMES_SQL}),
known AS (SELECT CASE class_id % 3 WHEN 0 THEN 'android.widget.C' WHEN 1 THEN 'com.app.C' ELSE 'android.webkit.C' END || class_id AS class_name FROM fx_classes),
c AS (SELECT app_id, name, 1 AS r, name AS class_name FROM n UNION ALL SELECT app_id, name, 2, package || '.' || name FROM n
  UNION ALL SELECT app_id, name, 3, 'android.widget.' || name FROM n UNION ALL SELECT app_id, name, 4, 'android.webkit.' || name FROM n)
SELECT app_id, name, min_by(class_name, r) AS view_class FROM c WHERE class_name IN (SELECT class_name FROM known) GROUP BY app_id, name""",
)
def view_classes(f):
    names = f["part"].selectExpr(
        "p_partkey % 10 AS app_id",
        "'com.app' AS package",
        "CASE WHEN p_size % 4 = 0 THEN concat('com.app.C', p_size) ELSE concat('C', p_size) END AS name",
    )
    known = f["fx_classes"].selectExpr(
        "concat(CASE class_id % 3 WHEN 0 THEN 'android.widget.C' WHEN 1 THEN 'com.app.C' ELSE 'android.webkit.C' END, class_id) AS class_name"
    )
    return M.qualify_view_class(names, known)


@query(
    "f13_used_library_prefixes",
    "SELECT DISTINCT app_id, 'com.tapjoy.' AS prefix FROM fx_code_units WHERE class_name LIKE 'com.tapjoy.%'",
)
def used_library_prefixes(f):
    return M.used_library_prefixes(f["fx_code_units"])


def manifest_xml(f):
    """One manifest text per component, written from the component and filter columns."""
    c = f["fx_components"].join(f["fx_filters"].drop("filter_id"), "component_id", "left")

    def attr(name, col):
        return F.coalesce(F.concat(F.lit(f' android:{name}="'), col, F.lit('"')), F.lit(""))

    tag = F.lower("comp_type")
    data = F.when(
        F.coalesce("scheme", "host", "path_prefix", "mime").isNotNull(),
        F.concat(
            F.lit("<data"), attr("scheme", F.col("scheme")), attr("host", F.col("host")), attr("pathPrefix", F.col("path_prefix")),
            attr("mimeType", F.col("mime")), F.lit("/>"),
        ),
    ).otherwise("")
    body = F.when(
        F.col("action").isNotNull(),
        F.concat(
            F.lit("<intent-filter><action"), attr("name", F.col("action")), F.lit("/><category"), attr("name", F.col("category")),
            F.lit("/>"), data, F.lit("</intent-filter>"),
        ),
    ).otherwise("")
    xml = F.concat(
        F.lit('<?xml version="1.0"?><manifest xmlns:android="http://schemas.android.com/apk/res/android" package="com.app">'
              '<uses-permission android:name="perm.'), F.col("comp_type"),
        F.lit('"/><application'), F.when(F.col("component_id") % 17 == 0, ' android:enabled="false"').otherwise(""), F.lit("><"), tag,
        attr("name", F.concat(F.lit(".C"), F.col("component_id").cast("string"))), attr("exported", F.col("exported_attr")),
        attr("enabled", F.col("enabled_attr")), attr("permission", F.col("permission_attr")), F.lit(">"), body,
        F.lit("</"), tag, F.lit("></application></manifest>"),
    )
    return c.select(F.col("component_id").alias("app_id"), xml.alias("xml"))


@query(
    "a2_manifest_components",
    """
SELECT component_id AS app_id, component, comp_type, exported_attr, enabled_attr, permission_attr
FROM fx_components WHERE component_id % 17 <> 0""",
)
def manifest_components(f):
    return read_manifests(manifest_xml(f)).components.drop("app_permission")


@query(
    "a2_manifest_filters",
    """
SELECT c.component_id AS app_id, c.component, x.action, x.category, x.scheme, x.host, x.path_prefix, x.mime
FROM fx_components c JOIN fx_filters x USING (component_id) WHERE c.component_id % 17 <> 0""",
)
def manifest_filters(f):
    def first(a):
        return F.try_element_at(a, F.lit(1))

    return read_manifests(manifest_xml(f)).filters.select(
        "app_id",
        "component",
        first(F.col("actions")).alias("action"),
        first(F.col("categories")).alias("category"),
        first(F.col("data.schemes")).alias("scheme"),
        first(F.col("data.authorities"))["host"].alias("host"),
        first(F.col("data.path_prefixes")).alias("path_prefix"),
        first(F.col("data.mimes")).alias("mime"),
    )


@query("a2_manifest_permissions", "SELECT component_id AS app_id, 'perm.' || comp_type AS permission FROM fx_components")
def manifest_permissions(f):
    return read_manifests(manifest_xml(f)).permissions


def layout_xml(f):
    """One layout text per part: a sensitive or plain text field, a button with a handler, an include, a nested view."""
    xml = """concat('<LinearLayout xmlns:android="http://schemas.android.com/apk/res/android"><!-- <Old android:id="@id/no"/> -->',
      '<EditText android:id="@id/e', p_partkey, '" android:inputType="', CASE WHEN p_size % 3 = 0 THEN 'textPassword' ELSE 'text' END, '"/>',
      '<com.app.Button', p_size % 4, ' android:id="@id/b', p_partkey, '" android:onClick="m', p_size % 12, '"><TextView android:onClick="inner"/></com.app.Button', p_size % 4, '>',
      CASE WHEN p_size % 5 = 0 THEN concat('<include android:layout="@layout/l', p_size, '"/>') ELSE '' END, '</LinearLayout>')"""
    return f["part"].selectExpr("p_partkey AS app_id", "concat('res/layout/l', p_partkey, '.xml') AS file", f"{xml} AS xml")


@query(
    "a3_layout_controls",
    """
SELECT p_partkey AS app_id, '@id/e' || p_partkey AS control_id, 'EditText' AS view_class, p_size % 3 = 0 AS is_sensitive FROM part
UNION ALL SELECT p_partkey, '@id/b' || p_partkey, 'com.app.Button' || p_size % 4, false FROM part""",
)
def layout_controls(f):
    return M.sensitive_controls(read_layouts(layout_xml(f)).attrs)


@query(
    "a3_layout_callbacks",
    """
SELECT p_partkey AS app_id, 'handler' AS kind, 'm' || p_size % 12 AS value FROM part
UNION ALL SELECT p_partkey, 'include', '@layout/l' || p_size FROM part WHERE p_size % 5 = 0""",
)
def layout_callbacks(f):
    r = read_layouts(layout_xml(f))
    return r.callbacks.select("app_id", F.lit("handler").alias("kind"), F.col("method_name").alias("value")).unionByName(
        r.includes.select("app_id", F.lit("include").alias("kind"), F.col("layout_ref").alias("value"))
    )
