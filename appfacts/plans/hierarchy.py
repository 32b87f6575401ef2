"""Queries on the class hierarchy and callbacks."""

from pyspark.sql import functions as F

from appfacts import constants as K
from appfacts.operators import hierarchy as H
from appfacts.plans.registry import query
from appfacts.session import local_table


def tree(f):
    classes = f["fx_classes"]
    return classes, H.ancestors(classes, H.super_edges(classes, "super_id"))


_ANC_SQL = """
WITH RECURSIVE anc AS (
  SELECT class_id, class_id AS ancestor_id, 0 AS depth FROM fx_classes
  UNION SELECT a.class_id, c.super_id, a.depth + 1 FROM anc a JOIN fx_classes c ON c.class_id = a.ancestor_id WHERE c.super_id IS NOT NULL)"""


@query("g1_ancestors", f"{_ANC_SQL} SELECT class_id, ancestor_id, depth FROM anc")
def ancestors(f):
    return tree(f)[1]


@query("g1_subtypes", f"{_ANC_SQL} SELECT ancestor_id AS class_id, class_id AS subtype_id FROM anc WHERE depth > 0")
def subtypes(f):
    return H.subtypes(tree(f)[1], include_self=False)


@query(
    "j2_nearest_declaration",
    f"""{_ANC_SQL},
w AS (SELECT p_partkey AS class_id, 'm' || p_size % 12 || ':()V' AS sub_sig FROM part)
SELECT w.class_id, w.sub_sig, min_by(a.ancestor_id, a.depth) AS declaring_id
FROM w JOIN anc a USING (class_id) JOIN fx_methods m ON m.class_id = a.ancestor_id AND m.sub_sig = w.sub_sig GROUP BY 1, 2""",
)
def nearest_declaration(f):
    _, anc = tree(f)
    wanted = f["part"].selectExpr("p_partkey AS class_id", "concat('m', p_size % 12, ':()V') AS sub_sig")
    return H.nearest_ancestor(anc, f["fx_methods"], wanted, "sub_sig")


_SS = [("m1", "source"), ("m2", "sink"), ("m3", "sink"), ("m5", "source")]


def ss_list(f):
    """Listed signatures: one method of most class names; the list grows with the classes."""
    rows = local_table(f.spark, [(n, r) for n, r in _SS], "m string, role string")
    number = F.col("number")
    return (
        f["fx_app_classes"].select("class_name", "number").distinct().join(rows, F.expr("substr(m, 2) = cast(number % 6 AS string)"))
        .select(
            F.concat(F.lit("L"), F.translate("class_name", ".", "/"), F.lit(";."), F.col("m"), F.lit(":()V")).alias("signature"),
            "role",
            F.when(F.col("role") == "sink", F.array((number % 3).cast("int"))).otherwise(F.array().cast("array<int>")).alias("positions"),
            F.array(F.concat(F.lit("T"), (number % 4).cast("string"))).alias("tags"),
        )
    )


def subtype_matches(f):
    """A call of every class's method by the app that has the class."""
    classes = f["fx_app_classes"]
    anc = H.ancestors(classes, H.super_edges(classes, "super_id"))
    names = classes.select("app_id", "class_id", "class_name")
    above = classes.select(F.col("class_id").alias("ancestor_id"), F.col("class_name").alias("ancestor_name"))
    calls = classes.select(
        "app_id",
        F.col("class_id").alias("method_id"),
        F.concat(F.lit("L"), F.translate("class_name", ".", "/"), F.lit(";."), F.col("sub_sig")).alias("callee_sig"),
    )
    ancestor_names = anc.join(names, "class_id").join(above, "ancestor_id").select("app_id", "class_name", "ancestor_name")
    return H.match_by_subtype(calls, ancestor_names, ss_list(f))


_SS_SQL = """
WITH RECURSIVE anc AS (
  SELECT class_id, class_id AS ancestor_id FROM fx_app_classes
  UNION SELECT a.class_id, c.super_id FROM anc a JOIN fx_app_classes c ON c.class_id = a.ancestor_id WHERE c.super_id IS NOT NULL),
l AS (SELECT DISTINCT class_name, number, 'm' || number % 6 || ':()V' AS sub_sig, CASE number % 6 WHEN 1 THEN 'source' WHEN 2 THEN 'sink' WHEN 3 THEN 'sink' ELSE 'source' END AS role
  FROM fx_app_classes WHERE number % 6 IN (1, 2, 3, 5)),
mt AS (SELECT m.app_id, m.class_id AS method_id, l.class_name, l.number, l.role FROM fx_app_classes m JOIN anc a USING (class_id)
  JOIN fx_app_classes c ON c.class_id = a.ancestor_id JOIN l ON l.class_name = c.class_name AND l.sub_sig = m.sub_sig)"""


@query("e5_subtype_matches", f"{_SS_SQL} SELECT app_id, method_id, class_name AS listed_class, role FROM mt")
def e5_subtype_matches(f):
    cls = F.translate(F.regexp_extract("listed_signature", r"^L([^;]+);", 1), "/", ".")
    return subtype_matches(f).select("app_id", "method_id", cls.alias("listed_class"), "role")


@query(
    "f12_merged_tags",
    f"""{_SS_SQL}
SELECT DISTINCT method_id, 'tag' AS what, 'T' || number % 4 AS value FROM mt
UNION SELECT method_id, 'position', CAST(number % 3 AS VARCHAR) FROM mt WHERE role = 'sink'""",
)
def merged_tags(f):
    return H.merge_tags(subtype_matches(f), ["method_id"])


@query(
    "g9_system_services",
    f"""{_ANC_SQL},
n AS (SELECT class_id, CASE class_id % 10 WHEN 0 THEN class_name || '$Stub' WHEN 1 THEN class_name || '$Inner' ELSE class_name END AS class_name FROM fx_classes)
SELECT class_id, class_name FROM n WHERE NOT contains(class_name, '$') AND class_id IN (
  SELECT a.class_id FROM anc a JOIN n ON n.class_id = a.ancestor_id WHERE a.depth > 0 AND n.class_name LIKE '%$Stub')""",
)
def system_services(f):
    classes, anc = tree(f)
    k = F.col("class_id") % 10
    suffix = F.when(k == 0, "$Stub").when(k == 1, "$Inner").otherwise("")
    return H.system_services(classes.withColumn("class_name", F.concat("class_name", suffix)), anc)


def listener_tree(f):
    classes = f["fx_listener_classes"]
    return classes, H.ancestors(classes, H.super_edges(classes, "super_id", "interface_id"))


_LANC_SQL = """
WITH RECURSIVE up AS (SELECT class_id, super_id FROM fx_listener_classes WHERE super_id IS NOT NULL
  UNION ALL SELECT class_id, interface_id FROM fx_listener_classes WHERE interface_id IS NOT NULL),
reach AS (SELECT class_id, class_id AS ancestor_id, 0 AS depth FROM fx_listener_classes
  UNION SELECT r.class_id, u.super_id, r.depth + 1 FROM reach r JOIN up u ON u.class_id = r.ancestor_id),
anc AS (SELECT class_id, ancestor_id, min(depth) AS depth FROM reach GROUP BY 1, 2)"""
_LIFE = " OR ".join(
    f"(kind = '{kind}' AND sub_sig IN ({', '.join(repr(s) for s in subs)}))" for kind, subs in K.LIFECYCLE_SUBSIGS.items()
)


@query(
    "e15_override_callbacks",
    f"""{_LANC_SQL},
b AS (SELECT DISTINCT l.component_id AS component, c.class_id FROM fx_listener_calls l JOIN fx_listener_classes c ON c.class_id = l.owner_id WHERE c.is_concrete),
k AS (SELECT a.class_id, min(CASE c.class_name WHEN 'android.app.Activity' THEN 'ACTIVITY' WHEN 'android.app.Service' THEN 'SERVICE'
    WHEN 'android.content.BroadcastReceiver' THEN 'RECEIVER' END) AS kind FROM anc a JOIN fx_listener_classes c ON c.class_id = a.ancestor_id WHERE a.depth > 0 GROUP BY 1),
s AS (SELECT DISTINCT a.class_id, m.sub_sig FROM anc a JOIN fx_listener_classes c ON c.class_id = a.ancestor_id AND starts_with(c.class_name, 'android.')
  JOIN fx_listener_methods m ON m.class_id = a.ancestor_id WHERE a.depth > 0),
cb AS (SELECT s.class_id, s.sub_sig FROM s LEFT JOIN k USING (class_id) WHERE NOT coalesce({_LIFE}, false))
SELECT DISTINCT b.component, m.class_id, m.sub_sig FROM b JOIN cb USING (class_id) JOIN anc a ON a.ancestor_id = b.class_id
JOIN fx_listener_methods m ON m.class_id = a.class_id AND m.sub_sig = cb.sub_sig AND NOT m.is_static
JOIN fx_listener_classes mc ON mc.class_id = m.class_id AND NOT starts_with(mc.class_name, 'android.')""",
)
def override_callbacks(f):
    classes, anc = listener_tree(f)
    reach = f["fx_listener_calls"].select(F.col("component_id").alias("component"), F.col("owner_id").alias("class_id"))
    return H.override_callbacks(reach, classes, anc, f["fx_listener_methods"])


_USES_SQL = """
u AS (SELECT DISTINCT app_id, component_id AS component, CASE WHEN contains(callee_sig, 'setOnClick') THEN 0 WHEN contains(callee_sig, 'LocationListener') THEN 1 ELSE 2 END AS listener_id
  FROM fx_listener_calls WHERE NOT contains(callee_sig, 'String'))"""


def registrations(f):
    classes, anc = listener_tree(f)
    calls = f["fx_listener_calls"].withColumnRenamed("component_id", "component")
    return H.registration_callbacks(calls, classes, anc, f["fx_listener_methods"])


_REGISTERED_SQL = f"""{_LANC_SQL}, {_USES_SQL.strip()},
below AS (SELECT DISTINCT u.app_id, u.listener_id, a.class_id FROM u JOIN anc a ON a.ancestor_id = u.listener_id
  JOIN fx_listener_classes c ON c.class_id = a.class_id AND c.app_id = u.app_id WHERE c.is_concrete AND NOT starts_with(c.class_name, 'android.')),
w AS (SELECT DISTINCT a.class_id, m.sub_sig FROM anc a JOIN fx_listener_classes c ON c.class_id = a.ancestor_id AND c.is_interface
  JOIN fx_listener_methods m ON m.class_id = a.ancestor_id WHERE a.class_id IN (SELECT class_id FROM below)),
d AS (SELECT w.class_id, w.sub_sig, min_by(a.ancestor_id, a.depth * CAST(1000000000 AS BIGINT) + a.ancestor_id) AS declaring_id FROM w JOIN anc a USING (class_id)
  JOIN fx_listener_methods m ON m.class_id = a.ancestor_id AND m.sub_sig = w.sub_sig GROUP BY 1, 2),
c AS (SELECT below.app_id, below.listener_id, d.class_id, d.declaring_id, d.sub_sig FROM below JOIN d USING (class_id)
  JOIN fx_listener_classes c ON c.class_id = d.declaring_id WHERE NOT starts_with(c.class_name, 'android.'))"""


@query("e16_registration_callbacks", f"{_REGISTERED_SQL} SELECT * FROM c")
def registration_callbacks(f):
    """Callback methods per app and registered listener type."""
    return registrations(f).callbacks


@query(
    "e16_component_callbacks",
    f"{_REGISTERED_SQL} SELECT DISTINCT u.app_id, u.component, c.class_id, c.declaring_id, c.sub_sig FROM u JOIN c USING (app_id, listener_id)",
)
def component_callbacks(f):
    """The same for each component; apps have components of equal names."""
    return registrations(f).expand()


@query("e16_registered_listeners", f"WITH {_USES_SQL.strip()} SELECT app_id, component, listener_id FROM u")
def registered_listeners(f):
    return registrations(f).uses


_LAYOUT_SQL = """SELECT DISTINCT app_id, class_id, CAST(value AS BIGINT) AS layout_id FROM fx_layout_calls
WHERE callee_sig LIKE '%.setContentView:(I)V' AND kind = 'int'"""


def layouts(f):
    return H.class_layouts(f["fx_layout_calls"].select("app_id", "site_id", "class_id", "callee_sig"), f["fx_layout_calls"].select("app_id", "site_id", "arg_idx", "kind", "value"))


@query("e13_class_layouts", _LAYOUT_SQL)
def class_layouts(f):
    return layouts(f)


@query(
    "e14_layout_callbacks",
    f"""{_ANC_SQL},
cl AS ({_LAYOUT_SQL}), al AS (SELECT * FROM cl UNION SELECT app_id, class_id, included_id FROM cl JOIN fx_layout_includes USING (app_id, layout_id)),
w AS (SELECT DISTINCT class_id, method_name FROM al JOIN fx_layout_handlers USING (app_id, layout_id))
SELECT w.class_id, w.method_name, min_by(a.ancestor_id, a.depth) AS declaring_id FROM w JOIN anc a USING (class_id)
JOIN fx_methods m ON m.class_id = a.ancestor_id AND split_part(m.sub_sig, ':', 1) = w.method_name GROUP BY 1, 2""",
)
def layout_callbacks(f):
    _, anc = tree(f)
    return H.layout_callbacks(layouts(f), f["fx_layout_includes"], f["fx_layout_handlers"], f["fx_methods"], anc)
