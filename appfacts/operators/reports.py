"""Reports per app.

A report is a set of rows, one per item, so an app of any size is written by many tasks; reading the rows of an app in
the order of ``section`` and ``item`` gives the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appfacts import constants as K
from appfacts.operators.skew import number_rows
from appfacts.session import cut_lineage

REPORT = ["app_id", "section", "item", "body"]


def _rows(df: DataFrame, section: str, item: Column, *fields) -> DataFrame:
    return df.select("app_id", F.lit(section).alias("section"), item.cast("string").alias("item"), F.to_json(F.struct(*fields)).alias("body"))


def app_report(
    permissions: DataFrame,
    components: DataFrame,
    filters: DataFrame,
    calls: DataFrame,
    targets: DataFrame,
    taint_nodes: DataFrame,
    taint_pairs: DataFrame,
) -> DataFrame:
    """(app_id, section, item, body): everything known about each app; ``body`` is a JSON object.

    Sections: permission, component, filter, icc_call, icc_target, taint_source, taint_sink, taint_path.
    """
    # Outcomes of long plans: each is written on its own, so that the driver never holds them as one plan.
    targets, taint_pairs = cut_lineage(targets), cut_lineage(taint_pairs)
    name = F.col("component")
    pair = F.concat_ws("->", F.col("source").cast("string"), F.col("sink").cast("string"), F.col("problem"))
    parts = [
        _rows(permissions, "permission", F.col("permission"), "permission"),
        _rows(components, "component", name, "component", "comp_type", "exported", "enabled", "permission"),
        _rows(filters, "filter", F.concat_ws("#", name, F.col("filter_id").cast("string")), "component", "actions", "categories", "data"),
        _rows(
            calls, "icc_call", F.col("call_id"), "comp_type", "component_names", "actions", "categories", "uris", "mimes",
            "precise_explicit", "precise_implicit", "n_intents",
        ),
        _rows(targets, "icc_target", F.concat_ws("#", "call_id", "scope", "target"), "call_id", "scope", "target", "target_type"),
        *[
            _rows(taint_nodes.where(F.col("role") == r), f"taint_{r}", F.col("node"), "node", "category", "descriptor")
            for r in ("source", "sink")
        ],
        _rows(taint_pairs, "taint_path", pair, "source", "sink", "problem"),
    ]
    return reduce(DataFrame.unionByName, parts)


def number_filters(filters: DataFrame) -> DataFrame:
    """Adds ``filter_no``, the 1-based number of a filter within its component."""
    return number_rows(filters, ["app_id", "component"], "filter_id", "filter_no")


_SECTIONS = {K.ACTIVITY: "activities", K.RECEIVER: "receivers", K.SERVICE: "services"}


def summary_report(
    permissions: DataFrame, components: DataFrame, filters: DataFrame, libraries: DataFrame, urls: DataFrame
) -> DataFrame:
    """(app_id, section, item, body): permissions, components by kind with numbered filters, libraries and URLs.

    Providers are not part of the summary.
    """
    kind = F.create_map(*[F.lit(x) for kv in _SECTIONS.items() for x in kv])
    shown = components.where(F.col("comp_type").isin(list(_SECTIONS))).withColumn("section", F.element_at(kind, F.col("comp_type")))
    numbered = number_filters(filters).join(shown.select("app_id", "component", "section"), ["app_id", "component"])

    def simple(df, section, column):
        return df.select("app_id", F.lit(section).alias("section"), F.col(column).alias("item"), F.lit("{}").alias("body"))

    parts = [
        simple(permissions, "permissions", "permission"),
        shown.select("app_id", "section", F.col("component").alias("item"), F.to_json(F.struct("exported", "permission")).alias("body")),
        numbered.select(
            "app_id",
            "section",
            F.concat_ws("/Filter", "component", F.col("filter_no").cast("string")).alias("item"),
            F.to_json(F.struct("actions", "categories", "data")).alias("body"),
        ),
        simple(libraries, "libraries", "library"),
        simple(urls, "urls", "url"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def report_header(report: DataFrame) -> DataFrame:
    """(app_id, section, n_items): how many items each section of an app has."""
    return report.groupBy("app_id", "section").agg(F.count(F.lit(1)).alias("n_items"))
