"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appfacts.llm.tables import written_measured


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node it is connected with) for every node of ``edges`` (a, b: bigint).

    Alternating star contraction: every node hangs its larger, then its smaller neighbours onto the least node it
    sees; rounds are about logarithmic in the graph's width.  Each round is a written table.  Null ends are ignored.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    # Two edge sets are taken as equal if they agree in number and in the exclusive or of 64-bit hashes.
    measures = {"n": F.count(F.lit(1)), "sign": F.bit_xor(F.xxhash64("u", "v"))}
    now, was = written_measured(ends, **measures)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after, is_ = written_measured(small, **measures)
        # Done when every node hangs directly on one node that hangs on none, and nothing moved.
        if is_ == was:
            break
        now, was = after, is_
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).distinct()
