"""Incremental ingest of new fact files, and status rows of a stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from appfacts.session import cut_lineage
from appfacts.sinks.staged import has_stage

SEEN = "_ingested_apps"
#: Folders by app that a staged table is kept in, and their column.
BUCKETS, BUCKET = 256, "app_bucket"


def earlier(spark: SparkSession, path: str, batch_id: int, buckets: list[int]) -> DataFrame:
    """Rows of earlier batches in some buckets; other folders aren't read."""
    return spark.read.parquet(path).where((F.col("batch_id") < batch_id) & F.col(BUCKET).isin(buckets))


def _write(df: DataFrame, folder: str) -> None:
    # A task for each bucket, or hot ones would come in as many files as there are tasks.
    df.hint("rebalance", BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(folder)


def ingest_apps(
    spark: SparkSession, in_path: str, schema: T.StructType | str, out_root: str, checkpoint: str, table: str = "facts"
) -> StreamingQuery:
    """Append new facts to a staged table, each row once.

    Files that appear under ``in_path`` are picked up as a stream.  An app may come in several deliveries: rows of a
    known app are compared with what earlier batches brought of that app, and those that are new are added.  The table is
    kept in BUCKETS folders by app, so a delivery reads the folders of its own known apps and no others.  Every batch
    writes its own partition and overwrites it when it is repeated after a failure, so the result does not depend on
    restarts.
    """
    mark = F.pmod(F.xxhash64("app_id"), F.lit(BUCKETS)).cast("int")

    def add(batch: DataFrame, batch_id: int) -> None:
        new = batch.distinct().withColumn(BUCKET, mark)
        if has_stage(spark, out_root, f"{table}{SEEN}"):
            # The buckets are a bounded list, by which partitions are picked.
            fresh = [r[0] for r in new.select(BUCKET).distinct().collect()]
            seen = earlier(spark, f"{out_root}/{table}{SEEN}", batch_id, fresh).select("app_id")
            again = cut_lineage(seen.join(new.select("app_id").distinct(), "app_id", "left_semi").distinct())
            buckets = [r[0] for r in again.select(mark).distinct().collect()]
            if buckets:
                before = earlier(spark, f"{out_root}/{table}", batch_id, buckets)
                before = before.join(again, "app_id", "left_semi").select(*new.columns)
                known = new.join(again, "app_id", "left_semi").subtract(before)
                new = new.join(again, "app_id", "left_anti").unionByName(known)
        # The facts come first: an app counts as known once they are complete.
        _write(new, f"{out_root}/{table}/batch_id={batch_id}")
        done = spark.read.schema(new.schema).parquet(f"{out_root}/{table}/batch_id={batch_id}")
        _write(done.select("app_id", BUCKET).distinct(), f"{out_root}/{table}{SEEN}/batch_id={batch_id}")

    return (
        spark.readStream.schema(schema)
        .parquet(in_path)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def with_status(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all checks, (app_id, error) of those that do not).

    A failed row does not stop the corpus; later stages leave out what failed.
    """
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    tagged = df.withColumn("error", error)
    return tagged.where(F.col("error").isNull()).drop("error"), tagged.where(F.col("error").isNotNull()).select("app_id", "error")


def stage_status(succeeded: DataFrame, failed: list[DataFrame]) -> DataFrame:
    """(app_id, status, error) over all apps of a stage."""
    bad = reduce(DataFrame.unionByName, [f.select("app_id", "error") for f in failed]).groupBy("app_id").agg(F.min("error").alias("error"))
    good = succeeded.select("app_id").distinct().join(bad, "app_id", "left_anti")
    return good.select("app_id", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("app_id", F.lit("failed").alias("status"), "error")
    )
