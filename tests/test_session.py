"""Checkpoints: what they keep of the plan that made them, and what they leave on disk."""

import glob
import time

from pyspark.sql import functions as F

from appfacts.session import cut_counted, cut_lineage


def test_sizes_stay_bounded(spark):
    """A loop that joins its own results keeps size estimates of a long's size, and the rows."""
    found = cut_lineage(spark.range(20).withColumn("v", F.col("id") * 2))
    for _ in range(9):
        twice = found.join(found.withColumnRenamed("v", "w"), "id").withColumn("v", F.least("v", "w")).drop("w")
        found, n = cut_counted(twice)
        assert n == 20
        assert found._jdf.logicalPlan().stats().sizeInBytes() <= 2**63
    assert sorted(map(tuple, found.collect())) == [(i, 2 * i) for i in range(20)]
    # Joined with what comes from it, each side keeps its own columns.
    again = found.alias("a").join(found.alias("b"), F.col("a.id") == F.col("b.v"))
    assert again.count() == 10


def test_shuffle_files_go_with_the_checkpoint(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {p for f in folders for p in glob.glob(f"{f}/**/shuffle_*.data", recursive=True)}

    before = files()
    df = spark.range(50_000).groupBy((F.col("id") % 977).alias("k")).count()
    written, n = cut_counted(df)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert n == written.count() == cut_lineage(df).count() == 977
