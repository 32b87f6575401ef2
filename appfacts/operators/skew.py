"""Joins, distinct lists and ordered scans that stay parallel when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from appfacts.session import cut_counted, cut_lineage, fresh_name, sized_broadcast

# A key with more rows than this is split over several tasks.
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of pieces each is split into.

    At most ``rows / hot_rows`` keys qualify, so the result is tiny next to its input.
    """
    return (
        df.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > hot_rows)
        .select(*on, F.ceil(F.col("__n") / F.lit(hot_rows)).cast("int").alias("__pieces"))
    )


def skew_join(
    many: DataFrame, few: DataFrame, on: list[str], how: str = "inner", hot_rows: int = HOT_ROWS, once: bool = False
) -> DataFrame:
    """Equi join in which a hot key of ``many`` is cut into pieces.

    The hot keys are counted first, from the key columns alone; without any the join is the plain one.  Otherwise rows
    of ``many`` with a hot key are spread by a hash of the whole row (so a retried task gives the same split) and the
    matching rows of ``few`` are copied once per piece.  The list of hot keys is broadcast while small, so ``many`` is
    shuffled once.  ``once`` writes ``many`` first, for inputs that are dear to compute twice.  ``how`` may be inner,
    left, left_semi or left_anti (``many`` is the left side).
    """
    if once:
        many = cut_lineage(many)
    pieces, n_hot = cut_counted(hot_keys(many, on, hot_rows))
    if not n_hot:
        return many.join(few, on, how)
    pieces = sized_broadcast(pieces, n_hot)
    salt = fresh_name("salt")
    left = many.join(pieces, on, "left").withColumn(
        salt, F.pmod(F.xxhash64(*[F.col(c) for c in many.columns]), F.coalesce("__pieces", F.lit(1))).cast("int")
    )
    right = few.join(pieces, on, "left").withColumn(
        salt, F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1))
    )
    return left.drop("__pieces").join(right.drop("__pieces"), [*on, salt], how).drop(salt)


def distinct_dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df.distinct()`` for rows that seldom repeat: dealt by a hash of ``by`` (all columns if none) before they are compared.

    The plain form first compares the rows of each task that makes them; where few tasks make many rows (a hot key, a join
    with many results), such a task would hold all of its own.
    """
    return df.repartition(*(by or df.columns)).distinct()


def running_last(
    df: DataFrame, value: Column, group: list[str], order: str, out: str, chunk_rows: int = 100_000
) -> DataFrame:
    """Last non-null ``value`` at or before each row, in ``order`` within ``group``, for groups of any size.

    ``order`` must be an integer line number.  A group is cut into chunks of ``chunk_rows`` numbers; each chunk is
    scanned on its own, and what it starts with comes from a scan over one summary row per chunk.
    """
    numbered = df.withColumn("__v", value).withColumn("__chunk", F.floor(F.col(order) / F.lit(chunk_rows)))
    within = Window.partitionBy(*group, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        numbered.groupBy(*group, "__chunk")
        .agg(F.max(F.when(F.col("__v").isNotNull(), F.struct(order, "__v"))).alias("__last"))
        .withColumn("__carry", F.last("__last", ignorenulls=True).over(before))
        .select(*group, "__chunk", F.col("__carry.__v").alias("__carry"))
    )
    return (
        numbered.withColumn("__seen", F.last("__v", ignorenulls=True).over(within))
        .join(chunks, [*group, "__chunk"])
        .withColumn(out, F.coalesce("__seen", "__carry"))
        .drop("__v", "__chunk", "__seen", "__carry")
    )


def number_rows(df: DataFrame, group: list[str], order: str, out: str, chunk: int = 100_000) -> DataFrame:
    """1-based position of each row by integer ``order`` within ``group``, for groups of any size.

    Ranges of ``order`` are numbered on their own and shifted by the row counts of the ranges before them.
    """
    cut = df.withColumn("__chunk", F.floor(F.col(order) / F.lit(chunk)))
    within = Window.partitionBy(*group, "__chunk").orderBy(order)
    before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*group, "__chunk")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    return (
        cut.withColumn("__rn", F.row_number().over(within))
        .join(offsets, [*group, "__chunk"])
        .withColumn(out, (F.col("__rn") + F.col("__offset")).cast("bigint"))
        .drop("__chunk", "__rn", "__offset")
    )
