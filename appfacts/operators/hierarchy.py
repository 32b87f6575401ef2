"""Class hierarchy: ancestors, overriding methods, callbacks.

``supers`` is the edge table (class_id, super_id) of direct super classes and interfaces.  Class ids are unique over all
apps; ``ancestors`` also takes a scope where they are not.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appfacts import constants as K
from appfacts.functions.text import parameter_types, signature_parts
from appfacts.operators.skew import distinct_dealt, skew_join
from appfacts.session import broadcast_if_small, cut_counted, cut_lineage, local_table


def super_edges(classes: DataFrame, *parents: str) -> DataFrame:
    """Edges from each class to its direct super class and interfaces."""
    out = None
    for p in parents:
        e = classes.where(F.col(p).isNotNull()).select("class_id", F.col(p).alias("super_id"))
        out = e if out is None else out.unionByName(e)
    return out


def ancestors(classes: DataFrame, supers: DataFrame, scope: list[str] = ()) -> DataFrame:
    """(class_id, ancestor_id, depth): each class with itself (depth 0) and everything above it.

    The way up is doubled each round: what lies 2^k steps above is joined with all that is known above that.  The
    number of rounds is the logarithm of the height.
    """
    key = [*scope, "class_id", "ancestor_id"]
    direct = supers.select(*scope, "class_id", F.col("super_id").alias("ancestor_id"), F.lit(1).alias("depth"))
    known = cut_lineage(direct.where(F.col("class_id") != F.col("ancestor_id")).distinct())
    reach = 1
    while True:
        far = known.where(F.col("depth") == reach).withColumnRenamed("ancestor_id", "__mid")
        up = known.select(*scope, F.col("class_id").alias("__mid"), "ancestor_id", F.col("depth").alias("__d"))
        new = (
            far.join(up, [*scope, "__mid"])
            .where(F.col("class_id") != F.col("ancestor_id"))
            .groupBy(*key)
            .agg((F.min("__d") + reach).alias("depth"))
            .join(known.select(*key), key, "left_anti")
        )
        new, n = cut_counted(new)
        if not n:
            break
        known = cut_lineage(known.unionByName(new))
        reach *= 2
    itself = classes.select(*scope, "class_id", F.col("class_id").alias("ancestor_id"), F.lit(0).alias("depth"))
    return itself.distinct().unionByName(known)


def subtypes(ancestor_rows: DataFrame, include_self: bool = True) -> DataFrame:
    """(class_id, subtype_id): the same relation read downwards."""
    rows = ancestor_rows if include_self else ancestor_rows.where(F.col("depth") > 0)
    return rows.select(F.col("ancestor_id").alias("class_id"), F.col("class_id").alias("subtype_id"))


def nearest_ancestor(ancestor_rows: DataFrame, methods: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """First class on the way up from ``class_id`` that declares ``key``: (class_id, key, declaring_id).

    ``wanted`` has class_id and the key.  The nearest one is an aggregate, so it is combined before the shuffle.
    """
    declared = methods.select(F.col("class_id").alias("ancestor_id"), key).distinct()
    return (
        wanted.select("class_id", key)
        .distinct()
        .join(ancestor_rows, "class_id")
        .join(declared, ["ancestor_id", key])
        .groupBy("class_id", key)
        .agg(F.min_by("ancestor_id", F.struct("depth", "ancestor_id")).alias("declaring_id"))
    )


def match_by_subtype(
    calls: DataFrame, ancestor_names: DataFrame, ss_list: DataFrame, scope: list[str] = ("app_id",)
) -> DataFrame:
    """Calls whose signature is, or overrides, one of the listed signatures in the app's own hierarchy.

    ``ancestor_names`` has class_name and ancestor_name (itself included) by ``scope``: apps use equal class names for
    different classes.  Both conditions are equalities: the sub-signature and the listed class among the ancestors.
    """
    scope = list(scope)
    p = signature_parts("signature")
    listed = ss_list.withColumns({"ancestor_name": p["cls"], "sub_sig": p["sub_sig"]}).withColumnRenamed(
        "signature", "listed_signature"
    )
    c = signature_parts("callee_sig")
    called = calls.select(*scope, "callee_sig").distinct().withColumns({"class_name": c["cls"], "sub_sig": c["sub_sig"]})
    # Different callee signatures are matched, not calls.
    matched = (
        called.join(listed.select("sub_sig").distinct(), "sub_sig", "left_semi")
        .join(ancestor_names, [*scope, "class_name"])
        .join(listed, ["ancestor_name", "sub_sig"])
        .drop("class_name", "ancestor_name", "sub_sig")
    )
    # One callee may be called by a large share of all calls.
    return skew_join(calls, matched, [*scope, "callee_sig"])


def merge_tags(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tag) and (keys, position) of all list entries that matched, each once, as rows with a ``what`` column."""
    tags = matches.select(*keys, F.lit("tag").alias("what"), F.explode("tags").alias("value"))
    positions = matches.select(
        *keys, F.lit("position").alias("what"), F.explode(F.col("positions").cast("array<string>")).alias("value")
    )
    return tags.unionByName(positions).distinct()


def system_services(classes: DataFrame, ancestor_rows: DataFrame) -> DataFrame:
    """Classes below one that ends in ``$Stub``, without inner classes."""
    stubs = classes.where(F.col("class_name").endswith("$Stub")).select(F.col("class_id").alias("ancestor_id"))
    below = ancestor_rows.where(F.col("depth") > 0).join(stubs, "ancestor_id", "left_semi").select("class_id").distinct()
    return classes.join(below, "class_id", "left_semi").where(~F.col("class_name").contains("$")).select("class_id", "class_name")


def _platform(name: str):
    c = F.col(name)
    return c.startswith("android.") | c.startswith("com.android.")


def override_callbacks(reachable: DataFrame, classes: DataFrame, ancestor_rows: DataFrame, methods: DataFrame) -> DataFrame:
    """(component, class_id, sub_sig): platform methods that an app class overrides and that are no lifecycle methods.

    ``reachable`` has component and class_id of every class with a reachable method.  The instance methods of app
    classes are looked up on their way up: at the concrete reachable classes first, then at the platform ancestors of
    those.  So the work grows with the methods times the height of the hierarchy, not with the size of a platform
    class times its sub-classes.  Which methods count as lifecycle depends on the component class among the ancestors.
    """
    bases = reachable.select("component", "class_id").distinct().join(
        classes.where("is_concrete").select("class_id"), "class_id", "left_semi"
    ).withColumnRenamed("class_id", "base_id")
    base_ids = bases.select("base_id").distinct()
    app_classes = classes.where(~_platform("class_name")).select("class_id")
    platform = classes.where(F.col("class_name").startswith("android.")).select(F.col("class_id").alias("ancestor_id"))

    # (class, method) of app classes with every reachable concrete class at or above the class
    own = methods.where(~F.col("is_static")).select("class_id", "sub_sig").join(app_classes, "class_id", "left_semi")
    up = ancestor_rows.select("class_id", F.col("ancestor_id").alias("base_id")).join(base_ids, "base_id", "left_semi")
    at_base = own.join(up, "class_id")

    # (base, method) with a platform ancestor of the base that declares the method
    above = ancestor_rows.where(F.col("depth") > 0).select(F.col("class_id").alias("base_id"), "ancestor_id").join(
        base_ids, "base_id", "left_semi"
    )
    declared = methods.where(~F.col("sub_sig").startswith("<init>")).select(F.col("class_id").alias("ancestor_id"), "sub_sig")
    overridden = (
        at_base.select("base_id", "sub_sig").distinct()
        .join(above.join(platform, "ancestor_id", "left_semi"), "base_id")
        .join(declared, ["ancestor_id", "sub_sig"], "left_semi")
        .select("base_id", "sub_sig")
        .distinct()
    )
    spark = classes.sparkSession
    kinds = local_table(spark, list(K.COMPONENT_BASE_CLASSES.items()), "class_name string, kind string")
    lifecycle = local_table(
        spark, [(kind, s) for kind, subs in K.LIFECYCLE_SUBSIGS.items() for s in subs], "kind string, sub_sig string"
    )
    roots = classes.join(kinds, "class_name").select(F.col("class_id").alias("ancestor_id"), "kind")
    base_kind = above.join(roots, "ancestor_id").groupBy("base_id").agg(F.min("kind").alias("kind"))
    callbacks = overridden.join(base_kind, "base_id", "left").join(lifecycle, ["kind", "sub_sig"], "left_anti")
    found = at_base.join(callbacks.select("base_id", "sub_sig"), ["base_id", "sub_sig"], "left_semi")
    return bases.join(found, "base_id").select("component", "class_id", "sub_sig").distinct()


class RegistrationCallbacks(NamedTuple):
    """``uses``: (app_id, component, listener_id) of the listener types a component registers; ``callbacks``: (app_id,
    listener_id, class_id, declaring_id, sub_sig) of the app's methods that such a listener may be called back with."""

    uses: DataFrame
    callbacks: DataFrame

    def expand(self) -> DataFrame:
        """Callbacks per component; select the components of interest first."""
        # A listener type may have most classes of an app below it.
        found = skew_join(self.callbacks, self.uses, ["app_id", "listener_id"], once=True)
        return distinct_dealt(found.select("app_id", "component", "class_id", "declaring_id", "sub_sig"))


def registration_callbacks(
    calls: DataFrame, classes: DataFrame, ancestor_rows: DataFrame, methods: DataFrame
) -> RegistrationCallbacks:
    """Callback methods of listeners that reachable app code registers.

    ``calls`` are reachable calls from app code with app_id, component and callee_sig; ``classes`` have the app_id of
    the app they belong to, null for platform classes that all apps share.  A parameter (or array element) of a known
    listener type stands for every concrete class of the app below it; the methods of each known listener interface
    such a class has are looked up from the class upwards.
    """
    listeners = local_table(classes.sparkSession, [(t,) for t in sorted(set(K.LISTENER_TYPES))], "class_name string")
    bases = F.transform(parameter_types("callee_sig"), lambda t: F.regexp_replace(t, r"(\[\])+$", ""))
    ids = classes.select("class_id", "class_name")
    named = (
        calls.select("app_id", "component", "callee_sig").distinct()
        .select("app_id", "component", F.explode(bases).alias("class_name")).distinct()
        .join(listeners, "class_name")
    )
    # An app's own class of that name, or the shared one.
    shared = named.join(classes.where("app_id IS NULL").select("class_id", "class_name"), "class_name")
    own = named.join(classes.where("app_id IS NOT NULL").select("app_id", "class_id", "class_name"), ["app_id", "class_name"])
    uses = (
        shared.select("app_id", "component", "class_id").unionByName(own.select("app_id", "component", "class_id"))
        .withColumnRenamed("class_id", "listener_id").distinct()
    )
    app = classes.where("is_concrete").where(~_platform("class_name") & ~F.col("class_name").startswith("java."))
    below = (
        ancestor_rows.select("class_id", F.col("ancestor_id").alias("listener_id"))
        .join(app.select("app_id", "class_id"), "class_id")
        .join(uses.select("app_id", "listener_id").distinct(), ["app_id", "listener_id"], "left_semi")
    )
    interfaces = ids.join(listeners, "class_name").join(
        classes.where("is_interface").select("class_id"), "class_id", "left_semi"
    ).select(F.col("class_id").alias("ancestor_id"))
    # Methods of listener interfaces are few, but most classes may have the same interface above them.
    offered = broadcast_if_small(
        methods.select(F.col("class_id").alias("ancestor_id"), "sub_sig").join(interfaces, "ancestor_id", "left_semi").distinct()
    )
    wanted = distinct_dealt(
        ancestor_rows.select("class_id", "ancestor_id").join(offered, "ancestor_id")
        .join(below.select("class_id").distinct(), "class_id", "left_semi")
        .select("class_id", "sub_sig"),
        "class_id",
    )
    # The first class on the way up that declares the method; one of a platform class is no callback.
    nearest = nearest_ancestor(ancestor_rows, methods, wanted, "sub_sig")
    not_platform = ids.where(~F.col("class_name").startswith("android.")).select(F.col("class_id").alias("declaring_id"))
    callbacks = below.join(nearest.join(not_platform, "declaring_id", "left_semi"), "class_id")
    return RegistrationCallbacks(uses, callbacks.select("app_id", "listener_id", "class_id", "declaring_id", "sub_sig"))


def class_layouts(call_sites: DataFrame, arg_values: DataFrame) -> DataFrame:
    """(app_id, class_id, layout_id) from the resolved argument of ``setContentView`` calls."""
    keys = ["app_id", "site_id"]
    sites = call_sites.where(signature_parts("callee_sig")["sub_sig"] == K.SET_CONTENT_VIEW_SUBSIG)
    values = arg_values.where((F.col("arg_idx") == 1) & (F.col("kind") == "int")).select(*keys, F.col("value").cast("bigint").alias("layout_id"))
    return sites.join(values, keys).select("app_id", "class_id", "layout_id").distinct()


def layout_callbacks(
    layouts: DataFrame, includes: DataFrame, handlers: DataFrame, methods: DataFrame, ancestor_rows: DataFrame
) -> DataFrame:
    """(class_id, method_name, declaring_id): click handlers of a class's layouts, found in the class or above it.

    A layout brings in its own handlers and those of the layouts it includes.  Layout ids belong to an app: all three
    tables have app_id.
    """
    layout = ["app_id", "layout_id"]
    included = layouts.join(includes, layout).select("app_id", "class_id", F.col("included_id").alias("layout_id"))
    wanted = layouts.unionByName(included).distinct().join(handlers, layout).select("class_id", "method_name").distinct()
    named = methods.withColumn("method_name", F.substring_index("sub_sig", ":", 1))
    return nearest_ancestor(ancestor_rows, named, wanted, "method_name")
