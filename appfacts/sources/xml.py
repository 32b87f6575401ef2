"""Manifests and layouts from XML text, parsed by Spark's XML functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appfacts import constants as K
from appfacts.functions.text import qualify_component_name, sanitize_port

_NAMED = "array<struct<_name: string>>"
_DATA = (
    "array<struct<_scheme: string, _host: string, _port: string, _path: string, _pathPrefix: string, "
    "_pathPattern: string, _mimeType: string>>"
)
_ENTRY = (
    "array<struct<_name: string, _exported: string, _enabled: string, _permission: string, "
    f"`intent-filter`: array<struct<action: {_NAMED}, category: {_NAMED}, data: {_DATA}>>>>"
)
MANIFEST_SCHEMA = (
    f"_package: string, `uses-permission`: {_NAMED}, "
    "application: array<struct<_enabled: string, _permission: string, "
    f"activity: {_ENTRY}, service: {_ENTRY}, receiver: {_ENTRY}, provider: {_ENTRY}>>"
)
# Prefixes of names and attributes vary between files and are ignored.
_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}

_TAGS = [("activity", K.ACTIVITY), ("service", K.SERVICE), ("receiver", K.RECEIVER), ("provider", K.PROVIDER)]


class Manifests(NamedTuple):
    apps: DataFrame
    permissions: DataFrame
    components: DataFrame
    filters: DataFrame


def _values(items: Column, name: str) -> Column:
    """Different non-empty values of one attribute, in order, as an array that is never null."""
    got = F.transform(items, lambda x: F.nullif(x[name], F.lit("")))
    return F.coalesce(F.array_distinct(F.array_compact(got)), F.array().cast("array<string>"))


def _tagged(tag: str, kind: str) -> Column:
    """Entries of one tag together with the component kind they declare."""
    return F.coalesce(
        F.transform(F.col(f"a.{tag}"), lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("e"))), F.array()
    )


def _filter_data(items: Column) -> Column:
    authorities = F.filter(
        F.transform(
            items,
            lambda x: F.struct(
                F.nullif(x["_host"], F.lit("")).alias("host"),
                sanitize_port(F.nullif(x["_port"], F.lit(""))).alias("port"),
            ),
        ),
        lambda a: a["host"].isNotNull() | a["port"].isNotNull(),
    )
    return F.struct(
        _values(items, "_scheme").alias("schemes"),
        F.coalesce(F.array_distinct(authorities), F.array().cast("array<struct<host:string,port:string>>")).alias(
            "authorities"
        ),
        _values(items, "_path").alias("paths"),
        _values(items, "_pathPrefix").alias("path_prefixes"),
        _values(items, "_pathPattern").alias("path_patterns"),
        _values(items, "_mimeType").alias("mimes"),
    )


def read_manifests(xml: DataFrame) -> Manifests:
    """Tables of the manifests in ``xml`` (app_id, xml).

    Components and filters are those under an application that is not disabled.  All four tables are views of one
    parsed column; write or persist the ones that are used more than once.
    """
    doc = xml.select("app_id", F.from_xml("xml", "struct<" + MANIFEST_SCHEMA + ">", _OPTIONS).alias("m"))
    apps = doc.select("app_id", F.col("m._package").alias("package"))
    permissions = (
        doc.select("app_id", F.explode("m.uses-permission").alias("p"))
        .select("app_id", F.col("p._name").alias("permission"))
        .where(F.coalesce("permission", F.lit("")) != "")
        .distinct()
    )
    application = doc.select("app_id", F.col("m._package").alias("package"), F.explode("m.application").alias("a")).where(
        F.coalesce(F.col("a._enabled"), F.lit("true")) != "false"
    )
    entries = F.flatten(
        F.array(
            *[
                _tagged(tag, kind)
                for tag, kind in _TAGS
            ]
        )
    )
    rows = application.select(
        "app_id",
        "package",
        F.nullif(F.col("a._permission"), F.lit("")).alias("app_permission"),
        F.posexplode(entries).alias("entry_no", "x"),
    ).select(
        "app_id",
        "entry_no",
        "app_permission",
        qualify_component_name("x.e._name", F.col("package")).alias("component"),
        F.col("x.kind").alias("comp_type"),
        F.col("x.e._exported").alias("exported_attr"),
        F.col("x.e._enabled").alias("enabled_attr"),
        F.col("x.e._permission").alias("permission_attr"),
        F.col("x.e.intent-filter").alias("fs"),
    )
    components = rows.drop("fs", "entry_no").distinct()
    filters = rows.select("app_id", "component", "entry_no", F.posexplode("fs").alias("filter_no", "f")).select(
        "app_id",
        "component",
        # two 31-bit numbers in one
        (F.shiftleft(F.col("entry_no").cast("bigint"), 31) + F.col("filter_no")).alias("filter_id"),
        _values(F.col("f.action"), "_name").alias("actions"),
        _values(F.col("f.category"), "_name").alias("categories"),
        _filter_data(F.col("f.data")).alias("data"),
    )
    return Manifests(apps, permissions, components, filters)


class Layouts(NamedTuple):
    attrs: DataFrame
    callbacks: DataFrame
    includes: DataFrame


_NODE = "_tag_: string, _id: string, _password: string, _inputType: string, _onClick: string, _layout: string"


def _uniform_tags(xml: Column) -> Column:
    """Rename every element to ``node`` and keep its name as an attribute, so that one schema fits all layouts."""
    s = F.regexp_replace(xml, r"(?s)<!--.*?-->|<\?.*?\?>", "")
    s = F.regexp_replace(s, r"</[A-Za-z_][^>]*>", "</node>")
    return F.regexp_replace(s, r"<([A-Za-z_][\w.$:-]*)(?=[\s/>])", '<node tag_="$1"')


def read_layouts(xml: DataFrame) -> Layouts:
    """Attributes, click handlers and includes of the direct children of each layout's root.

    ``xml`` has app_id, file and xml.  ``attrs`` is in the form ``sensitive_controls`` takes.
    """
    schema = f"struct<node: array<struct<{_NODE}>>>"
    children = (
        xml.select("app_id", "file", F.from_xml(_uniform_tags(F.col("xml")), schema, _OPTIONS).alias("r"))
        .select("app_id", "file", F.explode("r.node").alias("n"))
    )
    pairs = F.filter(
        F.array(
            *[
                F.struct(F.lit(a).alias("attr"), F.col(f"n._{a}").alias("value"))
                for a in ("id", "password", "inputType")
            ]
        ),
        lambda p: p["value"].isNotNull(),
    )
    attrs = children.where(F.col("n._id").isNotNull()).select(
        "app_id", F.col("n._id").alias("control_id"), F.col("n._tag_").alias("view_class"), F.explode(pairs).alias("p")
    )
    return Layouts(
        attrs.select("app_id", "control_id", "view_class", "p.attr", "p.value"),
        children.where(F.col("n._onClick").isNotNull())
        .select("app_id", "file", F.col("n._onClick").alias("method_name"))
        .distinct(),
        children.where(F.col("n._layout").startswith("@"))
        .select("app_id", "file", F.col("n._layout").alias("layout_ref"))
        .distinct(),
    )
