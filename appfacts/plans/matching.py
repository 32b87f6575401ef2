"""Queries on intents and the components they can start."""

from pyspark.sql import functions as F

from appfacts.functions.text import data_matches, parse_intent_uri
from appfacts.operators import matching as M
from appfacts.operators import studies as S
from appfacts.plans.registry import query


def _set(c):
    c = F.col(c)
    return F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))


def components(f):
    return f["fx_components"].select("app_id", "component", "comp_type", "component_id")


def filters(f):
    """Filter facts in array form."""
    c = F.col("host")
    data = F.struct(
        _set("scheme").alias("schemes"),
        F.when(c.isNotNull(), F.array(F.struct(c.alias("host"), F.lit(None).cast("string").alias("port"))))
        .otherwise(F.array().cast("array<struct<host:string,port:string>>"))
        .alias("authorities"),
        F.array().cast("array<string>").alias("paths"),
        _set("path_prefix").alias("path_prefixes"),
        F.array().cast("array<string>").alias("path_patterns"),
        _set("mime").alias("mimes"),
    )
    return f["fx_filters"].join(f["fx_components"].select("component_id", "app_id", "component"), "component_id").select(
        "app_id", "component", "filter_id", _set("action").alias("actions"), _set("category").alias("categories"), data.alias("data")
    )


def intents(f):
    """Intent facts in array form; the caller is one of the app's components."""
    caller = F.concat(F.lit("com.app.C"), (F.col("app_id") * 20 + F.col("intent_id") % 20).cast("string"))
    uri = F.col("uri")
    return f["fx_intents"].select(
        "app_id",
        "intent_id",
        "comp_type",
        caller.alias("component"),
        _set("component").alias("component_names"),
        _set("action").alias("actions"),
        _set("category").alias("categories"),
        F.when(uri.isNotNull(), F.array(parse_intent_uri(uri)))
        .otherwise(
            F.array().cast(
                "array<struct<scheme:string,host:string,port:string,path:string,path_prefix:string,path_pattern:string>>"
            )
        )
        .alias("uris"),
        _set("mime").alias("mimes"),
        "precise_explicit",
        "precise_implicit",
    )


# URI parts of the fact table's texts, and the filter test, in plain SQL.
_URI_SQL = """
SELECT i.*, CASE WHEN contains(uri, '://') THEN split_part(uri, '://', 1) WHEN contains(uri, ':') THEN split_part(uri, ':', 1) END AS u_scheme,
  CASE WHEN contains(uri, '://') THEN regexp_extract(uri, '://([^/]*)', 1) END AS u_host,
  CASE WHEN contains(uri, '://') THEN nullif(regexp_extract(uri, '://[^/]*(/.*)', 1), '') END AS u_path,
  'com.app.C' || (app_id * 20 + intent_id % 20) AS caller
FROM fx_intents i"""
_MATCH_SQL = """
NOT (i.action IS NULL AND i.category IS NULL AND i.uri IS NULL AND i.mime IS NULL)
  AND (i.action IS NULL OR i.action = x.action OR x.action = 'ANY')
  AND (i.category IS NULL OR i.category = x.category)
  AND CASE WHEN i.uri IS NULL THEN x.scheme IS NULL
        WHEN x.scheme IS NULL THEN i.u_scheme IS NULL OR i.u_scheme IN ('content', 'file')
        WHEN i.u_scheme IS DISTINCT FROM x.scheme THEN false
        WHEN x.host IS NULL THEN true WHEN x.host IS DISTINCT FROM i.u_host THEN false
        WHEN x.path_prefix IS NULL THEN true WHEN i.u_path IS NULL THEN false ELSE starts_with(i.u_path, x.path_prefix) END
  AND CASE WHEN x.mime IS NULL THEN i.mime IS NULL WHEN i.mime IS NULL THEN false
        ELSE split_part(x.mime, '/', 1) = split_part(i.mime, '/', 1) AND (split_part(x.mime, '/', 2) = split_part(i.mime, '/', 2)
          OR split_part(x.mime, '/', 2) = '*' OR split_part(i.mime, '/', 2) = '*') END"""
_BASE_SQL = f"""
WITH iu AS ({_URI_SQL}), xf AS (SELECT x.*, c.app_id, c.component, c.comp_type FROM fx_filters x JOIN fx_components c USING (component_id))"""
_SHAPE_TEXT = """concat_ws('|', x.action, x.category, coalesce(x.scheme, '-'), coalesce(x.host, '-'), coalesce(x.path_prefix, '-'), coalesce(x.mime, '-'))"""
_CONTENT = "i.action, i.category, i.u_scheme, i.u_host, i.u_path, i.mime"


def _one(c):
    return F.try_element_at(F.col(c), F.lit(1))


def _content_columns(df):
    u = _one("uris")
    return df.withColumns(
        {
            "action": _one("actions"),
            "category": _one("categories"),
            "u_scheme": u["scheme"],
            "u_host": u["host"],
            "u_path": u["path"],
            "mime": _one("mimes"),
        }
    )


def _shape_texts(f):
    """Readable text per filter shape."""
    d = F.col("data")
    dash = F.lit("-")

    def one(a):
        return F.coalesce(F.try_element_at(a, F.lit(1)), dash)

    host = F.coalesce(F.try_element_at(d["authorities"], F.lit(1))["host"], dash)
    return (
        M.with_shape_id(filters(f))
        .select(
            "shape_id",
            F.concat_ws(
                "|", one(F.col("actions")), one(F.col("categories")), one(d["schemes"]), host, one(d["path_prefixes"]), one(d["mimes"])
            ).alias("filter_text"),
        )
        .distinct()
    )


@query(
    "d1_intent_uris",
    "SELECT intent_id, CASE WHEN contains(uri, '://') THEN split_part(uri, '://', 1) ELSE split_part(uri, ':', 1) END AS scheme,"
    " CASE WHEN contains(uri, '://') THEN regexp_extract(uri, '://([^/]*)', 1) END AS host,"
    " CASE WHEN contains(uri, '://') THEN nullif(regexp_extract(uri, '://[^/]*(/.*)', 1), '') END AS path"
    " FROM fx_intents WHERE uri IS NOT NULL",
)
def intent_uris(f):
    return (
        f["fx_intents"].where("uri IS NOT NULL")
        .select("intent_id", parse_intent_uri("uri").alias("u"))
        .select("intent_id", "u.scheme", "u.host", "u.path")
    )


@query(
    "d4_data_matches",
    f"""{_BASE_SQL}
SELECT i.intent_id, x.filter_id, CASE WHEN i.uri IS NULL THEN x.scheme IS NULL
    WHEN x.scheme IS NULL THEN i.u_scheme IS NULL OR i.u_scheme IN ('content', 'file')
    WHEN i.u_scheme IS DISTINCT FROM x.scheme THEN false WHEN x.host IS NULL THEN true WHEN x.host IS DISTINCT FROM i.u_host THEN false
    WHEN x.path_prefix IS NULL THEN true WHEN i.u_path IS NULL THEN false ELSE starts_with(i.u_path, x.path_prefix) END
  AND CASE WHEN x.mime IS NULL THEN i.mime IS NULL WHEN i.mime IS NULL THEN false
    ELSE split_part(x.mime, '/', 1) = split_part(i.mime, '/', 1) AND (split_part(x.mime, '/', 2) = split_part(i.mime, '/', 2) OR split_part(x.mime, '/', 2) = '*') END AS ok
FROM iu i JOIN xf x ON x.component_id = i.app_id * 20 + i.intent_id % 20""",
)
def data_matches_rows(f):
    """Each intent's data against the filter of the component that sends it."""
    i = intents(f).select("app_id", "component", "intent_id", _one("uris").alias("uri"), _one("mimes").alias("mime"))
    return i.join(filters(f).select("app_id", "component", "filter_id", "data"), ["app_id", "component"]).select(
        "intent_id", "filter_id", data_matches("data", F.col("uri"), F.col("mime")).alias("ok")
    )


@query(
    "e1_matching_filters",
    f"""{_BASE_SQL},
q AS (SELECT app_id, {_CONTENT.replace('i.', '')}, uri, COUNT(*) AS n_intents FROM iu GROUP BY ALL),
xs AS (SELECT app_id, {_SHAPE_TEXT.replace('x.', '')} AS filter_text, any_value(action) AS action, any_value(category) AS category,
  any_value(scheme) AS scheme, any_value(host) AS host, any_value(path_prefix) AS path_prefix, any_value(mime) AS mime,
  COUNT(DISTINCT component) AS n_components FROM xf GROUP BY 1, 2)
SELECT i.app_id, {_CONTENT}, x.filter_text, i.n_intents, x.n_components
FROM q i JOIN xs x ON x.app_id = i.app_id WHERE {_MATCH_SQL}""",
)
def matching_filters(f):
    """Requests and filters of the same app that fit, with the number of intents and components behind each."""
    m = M.match_filters(intents(f), filters(f))
    n_components = m.components.groupBy("app_id", "shape_id").agg(F.count(F.lit(1)).alias("n_components"))
    return (
        m.pairs.join(_content_columns(m.requests), ["app_id", "request_id"])
        .join(n_components, ["app_id", "shape_id"])
        .join(_shape_texts(f), "shape_id")
        .select("app_id", "action", "category", "u_scheme", "u_host", "u_path", "mime", "filter_text", "n_intents", "n_components")
    )


def many_valued(f):
    """Intents and filters whose arrays hold several values."""

    def values(cond, c="value"):
        return F.array_sort(F.collect_set(F.when(F.expr(cond), F.col(c))))

    authority = F.struct(F.col("value").alias("host"), "port")
    uri = F.struct(
        F.col("value").alias("scheme"), F.when(F.col("value").isNotNull(), F.col("host")).alias("host"), "port", "path",
        F.lit(None).cast("string").alias("path_prefix"), F.lit(None).cast("string").alias("path_pattern"),
    )
    filters = f["fx_filter_values"].groupBy("app_id", "filter_id").agg(
        values("kind < 2").alias("actions"), values("kind = 2").alias("categories"),
        F.struct(
            values("kind = 3").alias("schemes"), F.collect_set(F.when(F.col("kind") == 4, authority)).alias("authorities"),
            values("kind = 5 and form = 0").alias("paths"), values("kind = 5 and form = 1").alias("path_prefixes"),
            values("kind = 5 and form = 2").alias("path_patterns"), values("kind = 6").alias("mimes"),
        ).alias("data"),
    )
    intents = f["fx_request_values"].groupBy("app_id", "intent_id").agg(
        values("kind < 2").alias("actions"), values("kind = 2").alias("categories"),
        F.collect_set(F.when(F.col("kind") == 3, uri)).alias("uris"), values("kind = 4").alias("mimes"),
    )
    names = F.array().cast("array<string>").alias("component_names")
    return intents.select("*", names), filters.withColumn("component", F.concat(F.lit("F"), F.col("filter_id").cast("string")))


@query(
    "e1_many_valued_filters",
    """
WITH f AS (SELECT app_id, filter_id, list(DISTINCT value) FILTER (WHERE kind < 2) AS actions, list(DISTINCT value) FILTER (WHERE kind = 2) AS categories,
    list(DISTINCT value) FILTER (WHERE kind = 3) AS schemes, list(DISTINCT {'host': value, 'port': port}) FILTER (WHERE kind = 4) AS hosts,
    list(DISTINCT value) FILTER (WHERE kind = 5 AND form = 0) AS paths, list(DISTINCT value) FILTER (WHERE kind = 5 AND form = 1) AS prefixes,
    list(DISTINCT value) FILTER (WHERE kind = 5 AND form = 2) AS patterns, list(DISTINCT value) FILTER (WHERE kind = 6) AS mimes
  FROM fx_filter_values GROUP BY 1, 2),
q AS (SELECT app_id, intent_id, list(DISTINCT value) FILTER (WHERE kind < 2) AS actions, list(DISTINCT value) FILTER (WHERE kind = 2) AS categories,
    bool_or(kind = 3) AS has_uri, list(DISTINCT value) FILTER (WHERE kind = 4) AS mimes FROM fx_request_values GROUP BY 1, 2),
u AS (SELECT DISTINCT app_id, intent_id, value AS scheme, CASE WHEN value IS NOT NULL THEN host END AS host, port, path FROM fx_request_values WHERE kind = 3),
by_uri AS (SELECT DISTINCT u.app_id, intent_id, filter_id FROM u JOIN f USING (app_id) WHERE CASE
    WHEN schemes IS NULL THEN scheme IS NULL OR scheme = 'content'
    WHEN scheme IS NULL OR NOT list_contains(schemes, scheme) THEN false
    WHEN hosts IS NULL THEN true
    WHEN len(list_filter(hosts, lambda h: h.host = u.host AND (h.port IS NULL OR coalesce(h.port = u.port, false)))) = 0 THEN false
    WHEN paths IS NULL AND prefixes IS NULL AND patterns IS NULL THEN true
    WHEN path IS NULL THEN false
    ELSE coalesce(list_contains(paths, path), false) OR coalesce(len(list_filter(prefixes, lambda p: starts_with(path, p))) > 0, false)
      OR coalesce(len(list_filter(patterns, lambda p: regexp_full_match(path, p))) > 0, false) END),
fits AS (SELECT q.app_id, q.intent_id, f.filter_id FROM q JOIN f USING (app_id) LEFT JOIN by_uri b ON b.app_id = q.app_id AND b.intent_id = q.intent_id AND b.filter_id = f.filter_id
  WHERE (q.actions IS NULL OR coalesce(list_has_any(q.actions, f.actions), false) OR coalesce(list_contains(f.actions, 'ANY'), false))
    AND (q.categories IS NULL OR coalesce(list_has_any(q.categories, f.categories), false))
    AND CASE WHEN q.has_uri THEN b.filter_id IS NOT NULL ELSE f.schemes IS NULL END
    AND CASE WHEN q.mimes IS NULL THEN f.mimes IS NULL ELSE coalesce(len(list_filter(f.mimes, lambda t: len(list_filter(q.mimes, lambda m:
      split_part(t, '/', 1) = split_part(m, '/', 1) AND (split_part(t, '/', 2) IN ('*', split_part(m, '/', 2)) OR split_part(m, '/', 2) = '*'))) > 0)) > 0, false) END)
SELECT app_id, intent_id, COUNT(*) AS n_filters, CAST(SUM(filter_id) AS BIGINT) AS filter_sum FROM fits GROUP BY 1, 2""",
)
def many_valued_filters(f):
    """Filters of the same app that each intent passes, where both have several actions, categories, URIs and types."""
    rows = M.match_filters(*many_valued(f)).expand()
    number = F.substring("component", 2, 20).cast("bigint")
    return rows.groupBy("app_id", "intent_id").agg(F.count(F.lit(1)).alias("n_filters"), F.sum(number).alias("filter_sum"))


_CALL_SQL = f"i.app_id, i.comp_type, i.component AS name, {_CONTENT}, i.precise_explicit, i.precise_implicit"
_E2_SQL = f"""{_BASE_SQL},
i AS (SELECT app_id, comp_type, component, {_CONTENT.replace('i.', '')}, uri, precise_explicit, precise_implicit, COUNT(*) AS n_intents FROM iu GROUP BY ALL),
xs AS (SELECT app_id, {_SHAPE_TEXT.replace('x.', '')} AS filter_text, any_value(action) AS action, any_value(category) AS category,
  any_value(scheme) AS scheme, any_value(host) AS host, any_value(path_prefix) AS path_prefix, any_value(mime) AS mime,
  COUNT(DISTINCT component) AS n FROM xf GROUP BY 1, 2),
k AS (SELECT app_id, comp_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE component_id IN (SELECT component_id FROM fx_filters)) AS nf
  FROM fx_components GROUP BY 1, 2),
t AS (
  SELECT {_CALL_SQL}, n_intents, 'KIND' AS scope, i.comp_type AS target, 'EXPLICIT' AS target_type, k.n AS n_targets
  FROM i JOIN k USING (app_id, comp_type) WHERE NOT precise_explicit
  UNION ALL
  SELECT {_CALL_SQL}, n_intents, 'KIND_WITH_FILTER', i.comp_type, 'IMPLICIT', k.nf
  FROM i JOIN k USING (app_id, comp_type) WHERE precise_explicit AND NOT precise_implicit AND k.nf > 0
  UNION ALL
  SELECT {_CALL_SQL}, n_intents, 'COMPONENT', i.component, 'EXPLICIT', 1 FROM i WHERE i.component IS NOT NULL
  UNION ALL
  SELECT {_CALL_SQL}, n_intents, 'FILTER', x.filter_text, 'IMPLICIT', x.n FROM i JOIN xs x ON x.app_id = i.app_id WHERE {_MATCH_SQL})
"""


@query("e2_resolve_intents", _E2_SQL + "SELECT * FROM t")
def resolve_intents(f):
    """What every intent can start: one row per different intent of an app and target, with the numbers they stand for."""
    r = M.resolve_intents(intents(f), filters(f))
    calls = _content_columns(r.calls.withColumn("name", _one("component_names")))
    counts = M.target_counts(r, components(f), filters(f))
    # Only filter shapes have a text to look up; the other targets are a few kinds and names.
    shaped = counts.where("scope = 'FILTER'").join(_shape_texts(f).withColumnRenamed("shape_id", "target"), "target", "left")
    rest = counts.where("scope <> 'FILTER'").withColumn("filter_text", F.lit(None).cast("string"))
    return (
        shaped.unionByName(rest)
        .join(calls.drop("app_id"), "call_id")
        .select(
            "app_id", "comp_type", "name", "action", "category", "u_scheme", "u_host", "u_path", "mime", "precise_explicit",
            "precise_implicit", "n_intents", "scope", F.coalesce("filter_text", "target").alias("target"), "target_type", "n_targets",
        )
    )


@query(
    "f2_icc_metrics",
    f"""{_E2_SQL},
g AS (SELECT app_id, comp_type, name, action, category, u_scheme, u_host, u_path, mime, precise_explicit, precise_implicit,
  bool_or(target_type = 'EXPLICIT') AS e, bool_or(target_type = 'IMPLICIT') AS m FROM t GROUP BY ALL),
c AS (SELECT i.n_intents AS n, i.precise_explicit AS pe, i.precise_implicit AS pi, coalesce(g.e, false) AS e, coalesce(g.m, false) AS m,
  CASE WHEN i.component IS NOT NULL AND coalesce(i.action, i.category, i.uri, i.mime) IS NOT NULL THEN 'MIXED'
    WHEN i.component IS NOT NULL THEN 'EXPLICIT' ELSE 'IMPLICIT' END AS kind
  FROM i LEFT JOIN g ON g.app_id = i.app_id AND g.comp_type = i.comp_type AND g.name IS NOT DISTINCT FROM i.component
    AND g.action IS NOT DISTINCT FROM i.action AND g.category IS NOT DISTINCT FROM i.category AND g.u_scheme IS NOT DISTINCT FROM i.u_scheme
    AND g.u_host IS NOT DISTINCT FROM i.u_host AND g.u_path IS NOT DISTINCT FROM i.u_path AND g.mime IS NOT DISTINCT FROM i.mime
    AND g.precise_explicit = i.precise_explicit AND g.precise_implicit = i.precise_implicit)
SELECT CAST(SUM(n) AS BIGINT) AS icc_total,
  CAST(SUM(n) FILTER (WHERE kind = 'EXPLICIT') AS BIGINT) AS explicit_total, CAST(SUM(n) FILTER (WHERE kind = 'EXPLICIT' AND pe) AS BIGINT) AS explicit_precise,
  CAST(coalesce(SUM(n) FILTER (WHERE kind = 'EXPLICIT' AND e AND NOT m), 0) AS BIGINT) AS explicit_found,
  CAST(SUM(n) FILTER (WHERE kind = 'IMPLICIT') AS BIGINT) AS implicit_total, CAST(SUM(n) FILTER (WHERE kind = 'IMPLICIT' AND pi) AS BIGINT) AS implicit_precise,
  CAST(coalesce(SUM(n) FILTER (WHERE kind = 'IMPLICIT' AND m AND NOT e), 0) AS BIGINT) AS implicit_found,
  CAST(SUM(n) FILTER (WHERE kind = 'MIXED') AS BIGINT) AS mixed_total, CAST(SUM(n) FILTER (WHERE kind = 'MIXED' AND pe AND pi) AS BIGINT) AS mixed_precise,
  CAST(coalesce(SUM(n) FILTER (WHERE kind = 'MIXED' AND m AND e), 0) AS BIGINT) AS mixed_found
FROM c""",
)
def icc_metrics(f):
    r = M.resolve_intents(intents(f), filters(f))
    return M.icc_metrics(r, components(f), filters(f))


# Linked calls and components of all apps, row by row (SQL side only).
_LINK_SQL = f"""{_BASE_SQL},
ck AS (SELECT c.*, c.component_id IN (SELECT component_id FROM fx_filters) AS has_filter FROM fx_components c),
link AS (
  SELECT i.intent_id, c.app_id, c.component FROM iu i JOIN ck c ON c.comp_type = i.comp_type
  WHERE NOT i.precise_explicit OR (NOT i.precise_implicit AND c.has_filter) OR c.component = i.component
  UNION
  SELECT i.intent_id, x.app_id, x.component FROM iu i JOIN xf x ON x.comp_type = i.comp_type WHERE {_MATCH_SQL}),
inc AS (SELECT l.app_id, l.component,
    COUNT(*) FILTER (WHERE coalesce(i.action, i.category, i.uri, i.mime) IS NULL AND i.precise_implicit) AS incoming_explicit,
    COUNT(*) FILTER (WHERE coalesce(i.action, i.category, i.uri, i.mime) IS NOT NULL OR NOT i.precise_implicit) AS incoming_implicit
  FROM link l JOIN iu i USING (intent_id) GROUP BY 1, 2)"""


@query(
    "e3_incoming_calls",
    f"""{_LINK_SQL}
SELECT c.app_id, c.component, coalesce(incoming_explicit, 0) AS incoming_explicit, coalesce(incoming_implicit, 0) AS incoming_implicit
FROM fx_components c LEFT JOIN inc USING (app_id, component)""",
)
def incoming_calls(f):
    """Calls of all apps that can start each component."""
    return M.incoming_counts(intents(f), components(f), filters(f))


def icc_edges(f, caller="concat('call|', intent_id)", entry="concat('entry|', component_id)", resolved=False):
    """Links between all apps; nodes by SQL expressions.  ``resolved`` takes every intent as completely known."""
    callers = intents(f).withColumn("caller_node", F.expr(caller))
    if resolved:
        callers = callers.withColumns({"precise_explicit": F.lit(True), "precise_implicit": F.lit(True)})
    return M.link_icc(callers, components(f).withColumn("entry_node", F.expr(entry)), filters(f))


def _request_texts(f):
    """Readable text per request."""
    dash = F.lit("-")
    parts = ("action", "category", "u_scheme", "u_host", "u_path", "mime")
    return (
        _content_columns(M.with_request_id(intents(f)))
        .select("request_id", F.concat_ws("|", *[F.coalesce(F.col(c), dash) for c in parts]).alias("request_text"))
        .distinct()
    )


def readable(edges, f):
    """Edges whose hubs carry the text of a filter or request instead of its hash."""
    texts = _shape_texts(f).toDF("id", "text").unionByName(_request_texts(f).toDF("id", "text"))
    for end in ("use_node", "def_node"):
        hashed = F.regexp_extract(end, r"^hub\|(?:shape|request)\|[^|]*\|([0-9a-f]{64})$", 1)
        edges = (
            edges.withColumn("id", hashed).join(texts, "id", "left")
            .withColumn(end, F.when(F.col("text").isNull(), F.col(end)).otherwise(F.concat(F.substring_index(end, "|", 3), F.lit("|"), "text")))
            .drop("id", "text")
        )
    return edges


_REQUEST_TEXT = "concat_ws('|', " + ", ".join(
    f"coalesce(i.{c}, '-')" for c in ("action", "category", "u_scheme", "u_host", "u_path", "mime")
) + ")"
_FILTER_TEXT = "concat_ws('|', " + ", ".join(
    f"coalesce(x.{c}, '-')" for c in ("action", "category", "scheme", "host", "path_prefix", "mime")
) + ")"
ICC_EDGE_SQL = f"""{_BASE_SQL.strip()},
calls AS (SELECT i.*, 'call|' || intent_id AS call_node, {_REQUEST_TEXT} AS request FROM iu i),
ends AS (SELECT 'entry|' || component_id AS entry, * FROM fx_components),
shaped AS (SELECT DISTINCT 'entry|' || x.component_id AS entry, x.comp_type, {_FILTER_TEXT} AS shape FROM xf x),
fits AS (SELECT DISTINCT {_FILTER_TEXT} AS shape, {_REQUEST_TEXT} AS request
  FROM (SELECT DISTINCT action, category, uri, u_scheme, u_host, u_path, mime FROM iu) i
  JOIN (SELECT DISTINCT action, category, scheme, host, path_prefix, mime FROM xf) x ON {_MATCH_SQL}),
icc AS (
  SELECT entry AS use_node, 'hub|kind|' || comp_type AS def_node FROM ends
  UNION SELECT 'hub|kind|' || comp_type, call_node FROM calls WHERE NOT precise_explicit
  UNION SELECT entry, 'hub|kind+filter|' || comp_type FROM shaped
  UNION SELECT 'hub|kind+filter|' || comp_type, call_node FROM calls WHERE NOT precise_implicit
  UNION SELECT entry, 'hub|name|' || comp_type || '|' || component FROM ends
  UNION SELECT 'hub|name|' || comp_type || '|' || component, call_node FROM calls WHERE component IS NOT NULL
  UNION SELECT entry, 'hub|shape|' || comp_type || '|' || shape FROM shaped
  UNION SELECT 'hub|shape|' || k.comp_type || '|' || fits.shape, 'hub|request|' || k.comp_type || '|' || fits.request FROM fits
    JOIN (SELECT DISTINCT comp_type, shape FROM shaped) k USING (shape) JOIN (SELECT DISTINCT comp_type, request FROM calls) r
    ON r.comp_type = k.comp_type AND r.request = fits.request
  UNION SELECT 'hub|request|' || comp_type || '|' || request, call_node FROM calls)"""


@query("e3_icc_edges", f"{ICC_EDGE_SQL} SELECT use_node, def_node FROM icc")
def icc_edge_rows(f):
    """The links as a graph through hubs, which are named by what they stand for."""
    return readable(icc_edges(f), f)


@query(
    "e4_rpc_edges",
    """
WITH s AS (SELECT DISTINCT sub_sig FROM fx_methods WHERE class_id % 5 = 0), u AS (SELECT DISTINCT 'm' || intent_id % 20 || ':()V' AS sub_sig FROM fx_intents)
SELECT 'entry|' || method_id AS use_node, 'hub|rpc|' || sub_sig AS def_node FROM fx_methods WHERE class_id % 5 = 0 AND sub_sig IN (SELECT sub_sig FROM u)
UNION SELECT 'hub|rpc|m' || intent_id % 20 || ':()V', 'call|' || intent_id FROM fx_intents WHERE 'm' || intent_id % 20 || ':()V' IN (SELECT sub_sig FROM s)""",
)
def rpc_edges(f):
    callers = f["fx_intents"].selectExpr(
        "concat('m', intent_id % 20, ':()V') AS signature", "concat('call|', intent_id) AS caller_node"
    )
    callees = f["fx_methods"].where("class_id % 5 = 0").selectExpr("sub_sig AS signature", "concat('entry|', method_id) AS entry_node")
    return M.link_rpc(callers, callees)


def edge_counts(f):
    return (
        f["fx_call_edges"]
        .select("app_id", F.concat(F.lit("com.app.C"), (F.col("app_id") * 20 + F.col("caller") % 20).cast("string")).alias("component"))
        .groupBy("app_id", "component")
        .agg(F.count(F.lit(1)).alias("n_edges"))
    )


_STATS_SQL = f"""{_LINK_SQL},
out AS (SELECT app_id, caller AS component,
    COUNT(*) FILTER (WHERE coalesce(action, category, uri, mime) IS NULL AND precise_implicit) AS outgoing_explicit,
    COUNT(*) FILTER (WHERE coalesce(action, category, uri, mime) IS NOT NULL OR NOT precise_implicit) AS outgoing_implicit FROM iu GROUP BY 1, 2),
e AS (SELECT app_id, 'com.app.C' || (app_id * 20 + caller % 20) AS component, COUNT(*) AS n_edges FROM fx_call_edges GROUP BY 1, 2),
stats AS (SELECT c.app_id, c.component, c.has_filter AS handles_implicit, coalesce(n_edges, 0) AS n_edges, coalesce(outgoing_explicit, 0) AS outgoing_explicit,
    coalesce(outgoing_implicit, 0) AS outgoing_implicit, coalesce(incoming_explicit, 0) AS incoming_explicit, coalesce(incoming_implicit, 0) AS incoming_implicit
  FROM ck c LEFT JOIN e USING (app_id, component) LEFT JOIN out USING (app_id, component) LEFT JOIN inc USING (app_id, component))"""


def stats(f):
    return M.component_stats(components(f), filters(f), edge_counts(f), intents(f))


@query("f5_component_stats", f"{_STATS_SQL} SELECT * FROM stats")
def component_stats(f):
    return stats(f)


@query(
    "f3_distributions",
    f"""{_STATS_SQL},
a AS (SELECT app_id, COUNT(*) AS components, COUNT(*) FILTER (WHERE handles_implicit) AS implicit_components,
    COUNT(*) FILTER (WHERE NOT handles_implicit) AS explicit_only_components,
    CAST(FLOOR(SUM(n_edges + outgoing_explicit + outgoing_implicit) / 100.0) * 100 AS BIGINT) AS edges_bucket,
    CAST(FLOOR(median(incoming_explicit)) AS BIGINT) AS median_incoming_explicit,
    CAST(FLOOR(median(outgoing_explicit)) AS BIGINT) AS median_outgoing_explicit FROM stats GROUP BY 1),
v AS (SELECT 'components' AS metric, components AS value FROM a UNION ALL SELECT 'implicit_components', implicit_components FROM a
  UNION ALL SELECT 'explicit_only_components', explicit_only_components FROM a UNION ALL SELECT 'edges_bucket', edges_bucket FROM a
  UNION ALL SELECT 'median_incoming_explicit', median_incoming_explicit FROM a UNION ALL SELECT 'median_outgoing_explicit', median_outgoing_explicit FROM a
  UNION ALL SELECT 'incoming', incoming_explicit + incoming_implicit FROM stats UNION ALL SELECT 'outgoing', outgoing_explicit + outgoing_implicit FROM stats)
SELECT metric, value, COUNT(*) AS n FROM v GROUP BY 1, 2""",
)
def distributions(f):
    return S.frequency_distribution(stats(f))


@query(
    "f4_frequency_matrix",
    f"""{_STATS_SQL}
SELECT app_id, outgoing_explicit AS value, COUNT(*) AS n FROM stats GROUP BY 1, 2""",
)
def frequency_counts(f):
    """Cells of the app x value matrix in long form."""
    return S.frequency_cells(stats(f), "outgoing_explicit")
