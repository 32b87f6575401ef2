"""Reading the given tables, batch sizes for Python stages, and identities of rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from appfacts.session import ensure_checkpoint_dir

#: Bytes of text that a Python stage holds at a time, besides one row.
BATCH_BYTES = 4 << 20


ARROW_BYTES, UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 1)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str = "text") -> Column:
    """Tells rows with the same id and different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sliced(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes (a longer row stands alone)."""
    for batch in batches:
        each = max(1, int(batch.num_rows * limit / max(batch.nbytes, limit)))
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)


def workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where it isn't installed (a checkout, with the driver elsewhere), and bound
    the batches they get by bytes."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    # Batches of 10,000 rows may be of any size; a worker and its executor hold several at a time.
    if spark.conf.get(ARROW_BYTES, UNSET) == UNSET:
        spark.conf.set(ARROW_BYTES, str(2 * BATCH_BYTES))


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, limit: int = BATCH_BYTES
) -> DataFrame:
    """``fn`` over Arrow batches of about ``limit`` bytes; it may return none for a batch without output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit):
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    workers_import(df.sparkSession)
    return df.mapInArrow(run, schema)


def written_measured(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``written``, with aggregates of the rows taken while they are written."""
    seen = Observation()
    out = written(df.observe(seen, *[c.alias(n) for n, c in measures.items()]))
    return out, seen.get


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared checkpoint folder: computed once, and not lost with an executor.

    Unlike a checkpoint it is compressed and read by column.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Words of 64 bits of a row filter: a megabyte, whatever the table's size.
FILTER_WORDS = 1 << 17


def bit_filter(df: DataFrame, wanted: DataFrame, on: list[str], both: bool = False):
    """Rows of ``df`` that may have a partner in ``wanted``, and if ``both``, also those that surely have none.

    A bit for each hash value, FILTER_WORDS words in all, so the broadcast has a fixed bound.  With more partners than
    bits the filter lets everything pass and saves nothing; results don't depend on it.
    """
    spot = F.pmod(F.xxhash64(*on), F.lit(FILTER_WORDS * 64))
    bits = F.broadcast(
        wanted.select(spot.alias("__spot"))
        .groupBy(F.shiftright("__spot", 6).alias("__word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(__spot & 63 as int))")).alias("__bits"))
    )
    marked = (
        df.withColumn("__spot", spot)
        .withColumn("__word", F.shiftright("__spot", 6))
        .join(bits, "__word", "left")
        .withColumn("__hit", F.expr("coalesce(shiftright(__bits, cast(__spot & 63 as int)) & 1, 0) = 1"))
    )
    hit, miss = (marked.where(c).drop("__spot", "__word", "__bits", "__hit") for c in ("__hit", "not __hit"))
    return (hit, miss) if both else hit
