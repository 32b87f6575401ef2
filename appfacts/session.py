"""Session helpers: where checkpoints go, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Checkpoints must survive the loss of an executor, so the folder has to be set.  Only a local master, whose
    executors are this process, does without the setting: it gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="appfacts-checkpoint-")
    sc.setCheckpointDir(folder)


def workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where it isn't installed (a checkout, with the driver elsewhere)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def _bounded_size(df: DataFrame) -> DataFrame:
    """``df``, a checkpoint, without the size estimate and constraints of its origin once that size exceeds a long.

    Estimates are multiplied by joins and kept by checkpoints: a loop that joins its own results doubles their digits each
    round, until the numbers fill the driver's memory.  Partitioning and order are kept.
    """
    plan = df._jdf.logicalPlan()
    try:
        if plan.stats().sizeInBytes() < 2**63:
            return df
    except ValueError:  # more digits than Python reads
        pass
    spark = df.sparkSession
    none = getattr(spark._jvm, "scala.None$").__getattr__("MODULE$")
    plain = spark._jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, none, none
    )
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plain), spark)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, *observed) -> DataFrame:
    """Checkpoint of ``df``.  Its shuffle files are removed once it is written: nothing reads them again, and they would
    stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    was = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        # A frame takes the setting when it is made.
        out = (df.observe(*observed) if observed else df.select("*")).checkpoint(eager=True)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, was)
    return _bounded_size(out)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written once, read by all later steps, kept when an executor goes away."""
    return _written(df)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_lineage`` and the number of rows, counted while they are written."""
    seen = Observation()
    out = _written(df, seen, F.count(F.lit(1)).alias("n"))
    return out, seen.get["n"]


BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a user-supplied list once its size is known to be small.

    The check reads at most ``max_rows + 1`` rows.  A longer list keeps its ordinary (shuffled) join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def short_list(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df``, written once, and whether it has at most ``max_rows`` rows."""
    written, n = cut_counted(df)
    return written, n <= max_rows


def sized_broadcast(written: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a checkpointed table of ``rows`` rows of a few ids, while it is small."""
    return F.broadcast(written) if rows <= BROADCAST_ROWS else written


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Table of values known on the driver (constants, rules).  Arrow keeps it a local relation: no job reads it."""
    fields = T.StructType.fromDDL(schema)
    arrays = [
        pa.array([r[i] for r in rows], type=to_arrow_type(f.dataType)) for i, f in enumerate(fields.fields)
    ]
    df = spark.createDataFrame(pa.table(arrays, names=fields.names), schema=fields)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def fresh_name(prefix: str) -> str:
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"
