"""Corpus studies: counts and distributions over all apps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appfacts import constants as K
from appfacts.functions.text import (
    bucket,
    contains_any,
    count_substring,
    extract_all,
    fingerprints,
    int_median,
    string_and_class_literals,
)
from appfacts.operators.manifest import exclude_third_party
from appfacts.session import BROADCAST_ROWS, cut_lineage, short_list


# --- component statistics -----------------------------------------------------------------------------------------
def frequency_distribution(stats: DataFrame) -> DataFrame:
    """Histograms of component statistics: (metric, value, n).

    Per app: components, those with and without filters, edges in steps of 100, medians of explicit intents; per
    component: incoming and outgoing intents.
    """
    stats = cut_lineage(stats)  # read by two aggregations
    per_app = stats.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("components"),
        F.count_if("handles_implicit").alias("implicit_components"),
        F.count_if(~F.col("handles_implicit")).alias("explicit_only_components"),
        bucket(F.sum(F.col("n_edges") + F.col("outgoing_explicit") + F.col("outgoing_implicit")), 100).alias("edges_bucket"),
        int_median("incoming_explicit").alias("median_incoming_explicit"),
        int_median("outgoing_explicit").alias("median_outgoing_explicit"),
    )
    metrics = [c for c in per_app.columns if c != "app_id"]
    per_component = stats.select(
        (F.col("incoming_explicit") + F.col("incoming_implicit")).alias("incoming"),
        (F.col("outgoing_explicit") + F.col("outgoing_implicit")).alias("outgoing"),
    )
    values = per_app.select(*metrics).unpivot([], metrics, "metric", "value").unionByName(
        per_component.unpivot([], ["incoming", "outgoing"], "metric", "value")
    )
    return values.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))


def frequency_cells(stats: DataFrame, metric: str) -> DataFrame:
    """Number of components per app and observed value: the matrix in long form, for any number of values."""
    return stats.groupBy("app_id", F.col(metric).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def frequency_matrix(stats: DataFrame, metric: str, values: list | None = None) -> DataFrame:
    """The same with one column per value; blank where there is none.

    With ``values`` the columns are those, and nothing is collected.  Without, Spark collects the observed values and
    refuses to make more columns than ``spark.sql.pivotMaxValues``; use ``frequency_cells`` then.
    """
    return frequency_cells(stats, metric).groupBy("app_id").pivot("value", values).agg(F.first("n"))


# --- hidden APIs --------------------------------------------------------------------------------------------------
def hidden_api_usage(code_units: DataFrame, api_list: DataFrame, max_list: int = BROADCAST_ROWS) -> DataFrame:
    """(app_id, kind, api): a class of the list and one of its listed methods both named in one code unit.

    A unit's class names are joined to the list by equality.  The list's methods, taken together for each class, then meet
    the names of the same row, so with a short list (``max_list`` rows) only what is found is shuffled.  Beside a longer
    one, classes and names are joined by unit, so that names are not copied for every class.
    """
    apis, short = short_list(api_list.select("kind", "class_name", "method").where("class_name is not null and method is not null").distinct(), max_list)
    unit = ["app_id", "unit_id"]
    lits = code_units.select(*unit, string_and_class_literals("code").alias("l"))
    classes = F.explode(F.array_distinct("l.classes")).alias("class_name")
    if short:
        methods = apis.groupBy("class_name", "kind").agg(F.collect_set("method").alias("methods"))
        found = (
            lits.select("app_id", classes, F.col("l.names").alias("names"))
            .join(F.broadcast(methods), "class_name")
            .select("app_id", "kind", "class_name", F.explode(F.array_intersect("methods", "names")).alias("method"))
        )
    else:
        names = lits.select(*unit, F.explode("l.names").alias("method")).distinct()
        found = lits.select(*unit, classes).distinct().join(apis, "class_name").join(names, [*unit, "method"], "left_semi")
    return found.select("app_id", "kind", F.concat_ws(".", "class_name", "method").alias("api")).distinct()


def api_usage_counts(usage: DataFrame) -> DataFrame:
    """Apps per API and kind."""
    return usage.select("app_id", "kind", "api").distinct().groupBy("kind", "api").agg(F.count(F.lit(1)).alias("n_apps"))


# --- text probes --------------------------------------------------------------------------------------------------
def ad_library_apps(classes: DataFrame) -> DataFrame:
    """(app_id, ad_network): apps with a package whose name contains the network's key."""
    packages = classes.select("app_id", F.regexp_extract("class_name", r"^(.+)\.[^.]+$", 1).alias("package")).distinct()
    keys = F.array(*[F.lit(k) for k in K.AD_NETWORK_KEYS])
    return packages.select(
        "app_id", F.explode(F.filter(keys, lambda k: F.contains(F.col("package"), k))).alias("ad_network")
    ).distinct()


def ad_library_counts(classes: DataFrame) -> DataFrame:
    return ad_library_apps(classes).groupBy("ad_network").agg(F.count(F.lit(1)).alias("n_apps"))


def provider_apps(code_units: DataFrame) -> DataFrame:
    """(app_id, probe): identity providers found in application or library code, plus ``any`` for the login probes."""
    library = F.col("origin") == "library"
    hits = [
        F.when(
            F.when(library, contains_any("code", lib)).otherwise(contains_any("code", app)),
            F.array(*[F.lit(x) for x in ([name, "any"] if login else [name])]),
        ).otherwise(F.array().cast("array<string>"))
        for name, app, lib, login in K.PROVIDER_PROBES
    ]
    return code_units.select("app_id", F.explode(F.array_distinct(F.concat(*hits))).alias("probe")).distinct()


def provider_probe(code_units: DataFrame) -> DataFrame:
    """Apps per probe."""
    return provider_apps(code_units).groupBy("probe").agg(F.count(F.lit(1)).alias("n_apps"))


# A text can only match a family if it has one of these words; the test is far cheaper than the expression.
LOGIN_WORDS = {
    "sso": ["sso", "sign", "log", "regist"],
    "oauth": ["oauth", "token"],
    "oauth1": ["token", "veri", "pin"],
    "oauth2_code": ["code"],
}


def login_strings(texts: DataFrame) -> DataFrame:
    """(family, app_id, unit_id, origin, match): strings about single sign-on and authorisation in each text."""

    def matches(family: str, pattern: str) -> Column:
        found = F.transform(
            extract_all("text", pattern), lambda m: F.struct(F.lit(family).alias("family"), m.alias("match"))
        )
        return F.when(contains_any("__lower", LOGIN_WORDS[family]), found).otherwise(
            F.array().cast("array<struct<family:string,match:string>>")
        )

    found = F.flatten(F.array(*[matches(family, p) for family, p in K.LOGIN_PATTERNS.items()]))
    return (
        texts.withColumn("__lower", F.lower("text"))
        .select("app_id", "unit_id", "origin", F.explode(found).alias("x"))
        .select("x.family", "app_id", "unit_id", "origin", "x.match")
    )


def login_string_counts(texts: DataFrame) -> DataFrame:
    """Per family and origin: apps, units and different strings."""
    found = cut_lineage(login_strings(texts))  # read by three aggregations
    keys = ["family", "origin"]
    apps = found.select(*keys, "app_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_apps"))
    units = found.select(*keys, "app_id", "unit_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_units"))
    strings = found.select(*keys, "match").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_strings"))
    return apps.join(units, keys).join(strings, keys)


def feature_flags(code_units: DataFrame) -> DataFrame:
    """Per app: dynamic loading, reflection and native code in its own (not third-party) code.

    Apps with third-party code only are kept with all flags false.
    """
    own = exclude_third_party(code_units)
    flags = [F.max(contains_any("code", needles)).alias(name) for name, needles in K.FEATURE_SUBSTRINGS.items()]
    found = own.groupBy("app_id").agg(*flags)
    apps = code_units.select("app_id").distinct()
    return apps.join(found, "app_id", "left").select(
        "app_id", *[F.coalesce(n, F.lit(False)).alias(n) for n in K.FEATURE_SUBSTRINGS]
    )


def feature_totals(flags: DataFrame) -> DataFrame:
    return flags.agg(F.count(F.lit(1)).alias("n_apps"), *[F.count_if(n).alias(n) for n in K.FEATURE_SUBSTRINGS])


def icc_census(code_units: DataFrame) -> DataFrame:
    """One row: apps whose code names a call that starts a component, and the number of such calls."""
    subs = [s for s, _ in K.ICC_SUBSIGS]
    calls = F.lit(0)
    for s in subs:
        calls = calls + count_substring("code", s + " @classDescriptor")
    per_app = code_units.groupBy("app_id").agg(F.max(contains_any("code", subs)).alias("has"), F.sum(calls).alias("n"))
    return per_app.agg(
        F.count_if("has").alias("n_apps_with_icc"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_icc_calls")
    )


def run_summary(apps: DataFrame, results: DataFrame) -> DataFrame:
    """One row: apps in all, with a result, with at least one path, and the number of paths.

    ``results`` has app_id and n_paths, one row per analysed app.
    """
    joined = apps.select("app_id").distinct().join(results.select("app_id", "n_paths"), "app_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("n_paths").alias("have_result"),
        F.count_if(F.col("n_paths") > 0).alias("with_path"),
        F.coalesce(F.sum("n_paths"), F.lit(0)).cast("bigint").alias("total_paths"),
    )


def run_apps(apps: DataFrame, results: DataFrame) -> DataFrame:
    """(app_id, status, n_paths): every app of a run as ``no result``, ``no path`` or ``path``."""
    joined = apps.select("app_id").distinct().join(results.select("app_id", "n_paths"), "app_id", "left")
    n = F.col("n_paths")
    status = F.when(n.isNull(), "no result").when(n > 0, "path").otherwise("no path")
    return joined.select("app_id", status.alias("status"), n.cast("bigint").alias("n_paths"))


def signer_groups(certificates: DataFrame) -> DataFrame:
    """(sha256, n_apps): how many apps share a certificate; members are in ``signer_members``."""
    return signer_members(certificates).groupBy("sha256").agg(F.count(F.lit(1)).alias("n_apps"))


def signer_members(certificates: DataFrame) -> DataFrame:
    return certificates.select("app_id", fingerprints("der")["sha256"].alias("sha256")).distinct()
