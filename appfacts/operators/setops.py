"""Set operations between corpora, API lists and URL lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appfacts import constants as K
from appfacts.functions.text import extract_urls, url_host
from appfacts.operators.skew import skew_join


def corpus_diff(usage_a: DataFrame, usage_b: DataFrame, side_a: str = "a", side_b: str = "b") -> DataFrame:
    """(side, kind, api): APIs used in one corpus only."""
    a = usage_a.select("kind", "api", F.lit(True).alias("in_a"), F.lit(False).alias("in_b"))
    b = usage_b.select("kind", "api", F.lit(False).alias("in_a"), F.lit(True).alias("in_b"))
    # Combined before the one shuffle, so it takes a row for each different API only.
    seen = a.unionByName(b).groupBy("kind", "api").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    side = F.when(F.col("in_a"), side_a).otherwise(side_b)
    return seen.where("in_a <> in_b").select(side.alias("side"), "kind", "api")


def hidden_apis(framework: DataFrame, sdk: DataFrame) -> DataFrame:
    """Framework methods the SDK does not show, be it the method or its whole class."""
    return framework.join(sdk.select("class_name", "method").distinct(), ["class_name", "method"], "left_anti").distinct()


def service_hidden_apis(service_methods: DataFrame, hidden: DataFrame) -> DataFrame:
    """Hidden methods that system services declare."""
    keys = ["class_name", "method"]
    return service_methods.select(*keys).intersect(hidden.select(*keys))


def app_urls(code_units: DataFrame, strings: DataFrame) -> DataFrame:
    """(app_id, origin, url): URLs in an app's code and in its resource strings."""
    code = code_units.select("app_id", "origin", F.explode(extract_urls("code")).alias("url"))
    resources = strings.select("app_id", "origin", F.explode(extract_urls("value")).alias("url"))
    return code.unionByName(resources).distinct()


def resource_strings(*tables: DataFrame) -> DataFrame:
    """Union of decoded string tables, each value once per app and origin."""
    out = tables[0].select("app_id", "origin", "value")
    for t in tables[1:]:
        out = out.unionByName(t.select("app_id", "origin", "value"))
    return out.where(F.coalesce("value", F.lit("")) != "").distinct()


def merge_points_to(*parts: DataFrame) -> DataFrame:
    """Union of the results of several components."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def url_cascade(urls: DataFrame) -> DataFrame:
    """(host, level) of all different hosts; each level also holds the hosts of the higher ones.

    0: only in the full list; 1: no common site; 2: nor an ad network; 3: nor under .com or .org.
    """
    h = F.col("host")

    def whole(p):
        return h.rlike(f"^(?:{p})$")

    level = (
        F.when(whole(K.COMMON_SITES_PATTERN), 0)
        .when(whole(K.AD_SITES_PATTERN), 1)
        .when(whole(K.ORG_SITES_PATTERN), 2)
        .otherwise(3)
    )
    return (
        urls.select(url_host("url").alias("host")).where(h.isNotNull()).distinct().withColumn("level", level.cast("bigint"))
    )


# Lengths of the text pieces by which containment is turned into an equality; each text uses the longest that fits.
PIECE_LENGTHS = [32, 16, 8, 4, 2, 1]


def contained_in(
    needles: DataFrame, needle: str, entries: DataFrame, entry: str, keep: list[str] | None = None
) -> DataFrame:
    """(needle, entry) pairs with the needle inside the entry, by equality joins only.

    ``keep`` names columns of ``entries`` to return in place of the entry, each combination once.  A needle is looked
    up by its last 32 (16, 8, …) characters among all pieces of that length of the entries.  Where a piece occurs, the
    entry's text before it is cut to each length that needles with this piece have, and the cut text must equal a
    needle.  A piece shared by many needles and many entries therefore makes no pairs of its own.
    """
    n, e = F.col(needle), F.col(entry)
    keep = [entry] if keep is None else list(keep)
    length = F.lit(PIECE_LENGTHS[-1])
    for p in reversed(PIECE_LENGTHS):
        length = F.when(F.length(n) >= p, F.lit(p)).otherwise(length)
    wanted = needles.select(needle).where(F.length(n) > 0).distinct()
    lengths = (
        wanted.withColumn("__len", length)
        .select("__len", F.right(n, F.col("__len")).alias("__piece"), F.length(n).alias("__n"))
        .distinct()
    )
    used = [r[0] for r in lengths.select("__len").distinct().collect()]  # some of PIECE_LENGTHS
    pieces = (
        entries.select(*dict.fromkeys([entry, *keep]))
        .where(e.isNotNull())
        .distinct()
        .withColumn("__len", F.explode(F.array(*[F.lit(p) for p in used]).cast("array<int>")))
        .where(F.length(e) >= F.col("__len"))
        .withColumn("__at", F.explode(F.sequence(F.lit(1), F.length(e) - F.col("__len") + 1)))
        .withColumn("__piece", F.substring(e, F.col("__at"), F.col("__len")))
    )
    start = F.col("__at") + F.col("__len") - F.col("__n")
    cut = (
        pieces.join(lengths, ["__len", "__piece"])
        .where(start >= 1)
        .select(*keep, F.substring(e, start, F.col("__n")).alias("__text"))
        .distinct()
    )
    return cut.join(wanted.withColumn("__text", n), "__text").select(needle, *keep)


def url_permission_join(app_urls: DataFrame, url_lists: DataFrame) -> DataFrame:
    """(app_id, list_name, n_urls, n_listed): how many of an app's URLs occur inside an entry of each list.

    ``url_lists`` has list_name and entry.  Apps without a listed URL have no row for that list.
    """
    urls = app_urls.select("app_id", "url").distinct()
    listed = contained_in(urls, "url", url_lists, "entry", ["list_name"])
    n_urls = urls.groupBy("app_id").agg(F.count(F.lit(1)).alias("n_urls"))
    # One URL may occur in a large share of the apps.
    n_listed = skew_join(urls, listed, ["url"]).groupBy("app_id", "list_name").agg(F.count(F.lit(1)).alias("n_listed"))
    return n_listed.join(n_urls, "app_id").select("app_id", "list_name", "n_urls", "n_listed")


def exclusive_permissions(
    app_urls: DataFrame, app_permissions: DataFrame, url_lists: DataFrame, list_names: list[str]
) -> DataFrame:
    """(list_name, permission): permissions of apps with a listed URL that no app with an unlisted URL has."""
    counts = url_permission_join(app_urls, url_lists)
    permissions = app_permissions.select("app_id", "permission").distinct()
    with_listed = permissions.join(counts.select("app_id", "list_name"), "app_id").select("list_name", "permission")
    # An app has an unlisted URL unless all of its URLs are listed.
    complete = counts.where(F.col("n_listed") == F.col("n_urls")).select("app_id", "list_name")
    all_pairs = app_urls.select("app_id").distinct().withColumn(
        "list_name", F.explode(F.array(*[F.lit(x) for x in list_names]))
    )
    with_unlisted = permissions.join(all_pairs.join(complete, ["app_id", "list_name"], "left_anti"), "app_id").select(
        "list_name", "permission"
    )
    return with_listed.subtract(with_unlisted)
