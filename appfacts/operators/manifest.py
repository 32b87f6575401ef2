"""Components, classes, methods and controls: what a manifest, a layout or a class list says about an app."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appfacts import constants as K
from appfacts.functions.text import signature_parts, starts_with_any
from appfacts.session import broadcast_if_small, local_table


def effective_component_attrs(
    components: DataFrame, filters: DataFrame, app_permission: Column | None = None, min_sdk: Column | None = None
) -> DataFrame:
    """Exported, enabled and permission as they take effect.

    exported: ``"false"`` is false, any other text true; when missing, a component other than a provider is exported
    if it has a filter, and a provider if the SDK is at most 16 (or unknown).  enabled: false only for ``"false"``.
    permission: the component's own, else the application's.
    """
    with_filter = filters.select("app_id", "component").distinct().withColumn("__f", F.lit(True))
    provider_default = F.lit(True) if min_sdk is None else F.coalesce(min_sdk <= 16, F.lit(True))
    own = F.nullif(F.col("permission_attr"), F.lit(""))
    return (
        components.join(with_filter, ["app_id", "component"], "left")
        .withColumn(
            "exported",
            F.when(F.nullif(F.col("exported_attr"), F.lit("")).isNotNull(), F.col("exported_attr") != "false")
            .when(F.col("comp_type") == K.PROVIDER, provider_default)
            .otherwise(F.col("__f").isNotNull()),
        )
        .withColumn("enabled", F.coalesce(F.col("enabled_attr") != "false", F.lit(True)))
        .withColumn("permission", own if app_permission is None else F.coalesce(own, app_permission))
        .drop("__f", "exported_attr", "enabled_attr", "permission_attr")
    )


def entry_points(components: DataFrame, classes: DataFrame) -> DataFrame:
    """Enabled components whose class is known and belongs to the application; exported ones are main entries."""
    known = classes.where(F.col("origin") == "application").select("app_id", F.col("class_name").alias("component"))
    return (
        components.where("enabled")
        .join(known, ["app_id", "component"], "left_semi")
        .select("app_id", "component", "comp_type", F.col("exported").alias("is_main"))
    )


def component_kind(components: DataFrame) -> DataFrame:
    """One kind per component name: activity, service, receiver, provider in this order of precedence."""
    rank = F.create_map(*[F.lit(x) for kv in K.KIND_PRECEDENCE.items() for x in kv])
    return components.groupBy("app_id", "component").agg(
        F.min_by("comp_type", F.element_at(rank, F.col("comp_type"))).alias("comp_type")
    )


def exclude_third_party(code_units: DataFrame) -> DataFrame:
    """Code units outside the named third-party packages."""
    return code_units.where(~starts_with_any("class_name", K.THIRD_PARTY_PREFIXES))


def _generated(name: Column, package: Column) -> Column:
    p = F.coalesce(package, F.lit(""))
    return (
        name.endswith(F.concat(p, F.lit(".BuildConfig")))
        | name.endswith(F.concat(p, F.lit(".Manifest")))
        | name.contains(F.concat(p, F.lit(".Manifest$")))
        | name.endswith(F.concat(p, F.lit(".R")))
        | name.contains(F.concat(p, F.lit(".R$")))
    )


def support_library(name: Column) -> Column:
    """Build dependency a support-library class stands for, null for other classes."""
    out = F.lit(None).cast("string")
    for prefix, dependency in K.SUPPORT_LIBRARIES.items():
        out = F.when(name.startswith(prefix), F.lit(dependency)).otherwise(out)
    return out


def drop_generated_classes(classes: DataFrame, package: str = "package") -> tuple[DataFrame, DataFrame]:
    """(classes that are kept, dependencies per app): support-library and generated classes are dropped."""
    name = F.col("class_name")
    tagged = classes.withColumn("dependency", support_library(name))
    kept = tagged.where(F.col("dependency").isNull() & ~_generated(name, F.col(package))).drop("dependency")
    dependencies = tagged.where(F.col("dependency").isNotNull()).select("app_id", "dependency").distinct()
    return kept, dependencies


def in_scope(classes: DataFrame, packages: DataFrame, include: bool = True) -> DataFrame:
    """Adds ``bypass``: whether a library class is left out of the analysis.

    ``packages`` has one column ``package_name``.  In include mode a library class is bypassed unless its package is
    listed; in exclude mode it is bypassed when listed.  Application classes never are.
    """
    listed = broadcast_if_small(packages.select(F.col("package_name").alias("__p")).distinct())
    with_package = classes.withColumn("__pkg", F.regexp_extract("class_name", r"^(.+)\.[^.]+$", 1))
    hit = F.col("__p").isNotNull()
    return (
        with_package.join(listed, F.col("__pkg") == F.col("__p"), "left")
        .withColumn("bypass", (F.col("origin") != "application") & (~hit if include else hit))
        .drop("__pkg", "__p")
    )


def classify_icc_call(call_sites: DataFrame) -> DataFrame:
    """Calls that start another component, with the kind they start."""
    kinds = local_table(call_sites.sparkSession, K.ICC_SUBSIGS, "__sub string, comp_type string")
    return (
        call_sites.withColumn("__sub", signature_parts("callee_sig")["sub_sig"]).join(kinds, "__sub").drop("__sub")
    )


def rpc_methods(components: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods of services that can be called remotely: no constructors, lifecycle or environment methods."""
    services = components.where(F.col("comp_type") == K.SERVICE).select(
        "app_id", F.col("component").alias("class_name")
    )
    name = F.substring_index("sub_sig", ":", 1)
    own = methods.where(
        ~F.col("is_constructor")
        & ~F.col("sub_sig").isin(K.LIFECYCLE_SUBSIGS[K.SERVICE])
        & ~name.isin(K.ENVIRONMENT_METHODS)
    )
    return own.join(services.distinct(), ["app_id", "class_name"], "left_semi")


def framework_methods(methods: DataFrame) -> DataFrame:
    """Methods of platform classes."""
    return methods.where(F.col("class_name").startswith("android.") | F.col("class_name").startswith("com.android."))


def candidate_api_methods(methods: DataFrame) -> DataFrame:
    """Public, concrete, ordinary methods of platform classes."""
    return framework_methods(methods).where(
        F.col("is_public") & ~F.col("is_abstract") & ~F.col("is_constructor")
    )


def non_public_methods(methods: DataFrame) -> DataFrame:
    """The other platform methods that an app could only reach by reflection."""
    return framework_methods(methods).where(~F.col("is_public") & ~F.col("is_constructor"))


def sensitive_controls(layout_attrs: DataFrame) -> DataFrame:
    """One row per control: sensitive if ``password`` is set or ``inputType`` names a password."""
    attr = F.substring_index("attr", ":", -1)
    hit = ((attr == "password") & ~F.col("value").isin("false", "0")) | (
        (attr == "inputType") & F.col("value").contains("Password")
    )
    return layout_attrs.groupBy("app_id", "control_id", "view_class").agg(F.max(hit).alias("is_sensitive"))


def interesting_assignments(stmts: DataFrame) -> DataFrame:
    """Statements that can move an object: allocations, casts, object assignments and calls."""
    return stmts.where(
        (F.col("kind") == "call")
        | ((F.col("kind") == "assign") & (F.col("rhs").isin("new", "cast") | (F.col("assign_kind") == "object")))
    )


def qualify_view_class(names: DataFrame, classes: DataFrame) -> DataFrame:
    """Class of each layout tag: the name itself, then in the app's package, ``android.widget``, ``android.webkit``.

    ``names`` has app_id, package and name; the first candidate that exists in ``classes`` is taken.
    """
    n = F.col("name")
    candidates = F.array(
        F.struct(F.lit(1).alias("rank"), n.alias("class_name")),
        F.struct(F.lit(2).alias("rank"), F.concat("package", F.lit("."), n).alias("class_name")),
        F.struct(F.lit(3).alias("rank"), F.concat(F.lit("android.widget."), n).alias("class_name")),
        F.struct(F.lit(4).alias("rank"), F.concat(F.lit("android.webkit."), n).alias("class_name")),
    )
    return (
        names.select("app_id", "package", "name")
        .distinct()
        .withColumn("c", F.explode(candidates))
        .select("app_id", "name", "c.rank", "c.class_name")
        .join(classes.select("class_name").distinct(), "class_name", "left_semi")
        .groupBy("app_id", "name")
        .agg(F.min_by("class_name", "rank").alias("view_class"))
    )


def used_library_prefixes(classes: DataFrame) -> DataFrame:
    """Library prefixes each app uses: the first listed prefix of every library class's package."""
    package = F.regexp_extract("class_name", r"^(.+)\.[^.]+$", 1)
    first = F.lit(None).cast("string")
    for p in reversed(K.LIBRARY_PREFIXES):
        first = F.when(package.startswith(p), F.lit(p)).otherwise(first)
    return classes.select("app_id", first.alias("prefix")).where(F.col("prefix").isNotNull()).distinct()


