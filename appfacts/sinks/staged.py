"""Staged fact tables and other outputs."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from appfacts.operators.studies import frequency_cells
from appfacts.session import cut_counted, cut_lineage, workers_import
from appfacts.sources.lines import store_of

BUCKETS = 256
#: Files that a matrix is written to.
MATRIX_FILES = 64
STAGES = ["apps", "components", "intent_filters", "points_to", "taint_paths", "misuse"]


def write_staged(df: DataFrame, root: str, table: str, buckets: int = BUCKETS) -> None:
    """Write a fact table in buckets of apps.

    The rebalance hint gives every bucket files of about the advisory size: a bucket with one huge app becomes several
    files written by several tasks, small ones are put together.  The committer makes the table appear as a whole.
    """
    bucketed = df.withColumn("bucket", F.pmod(F.xxhash64("app_id"), F.lit(buckets)).cast("int"))
    bucketed.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{root}/{table}")


def read_staged(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A staged table without its bucket column (filter on ``bucket`` first to read some apps only)."""
    return spark.read.parquet(f"{root}/{table}").drop("bucket")


def staged_buckets(spark: SparkSession, root: str, table: str, app_ids: list[int], buckets: int = BUCKETS) -> DataFrame:
    """Rows of some apps; only their buckets are read."""
    df = spark.read.parquet(f"{root}/{table}")
    wanted = [F.pmod(F.xxhash64(F.lit(a).cast(df.schema["app_id"].dataType)), F.lit(buckets)).cast("int") for a in app_ids]
    return df.where(F.col("bucket").isin(*wanted) & F.col("app_id").isin(app_ids)).drop("bucket")


def has_stage(spark: SparkSession, root: str, table: str) -> bool:
    try:
        spark.read.parquet(f"{root}/{table}")
        return True
    except AnalysisException:
        return False


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Node and edge tables of a graph, as parquet or csv."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        w = df.write.mode("overwrite").format(fmt)
        (w.option("header", "true") if fmt == "csv" else w).save(f"{path}/{name}")


def write_sorted_list(df: DataFrame, column: str, path: str) -> None:
    """One line per value; the files in name order are one sorted list."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def write_frequency_matrix(stats: DataFrame, metric: str, path: str, files: int = MATRIX_FILES) -> None:
    """CSV with one row per app and one column per observed value, in order; cells without components stay blank.

    Nothing but the header is ever in one place: values are numbered over range partitions, and an app's line is put
    together from its own cells, with as many commas between them as there are blanks.  Each file (one to a folder
    ``part=N``) begins with the header.
    """
    cells = cut_lineage(frequency_cells(stats, metric).where(F.col("value").isNotNull()))
    numbered, n = _numbered(cells.select("value").distinct(), "value", "number")
    lines = (
        cells.join(numbered, "value")
        .groupBy("app_id")
        .agg(F.array_sort(F.collect_list(F.struct("number", "n"))).alias("c"))
        .select(
            F.pmod(F.xxhash64("app_id"), F.lit(files)).cast("int").alias("part"),
            F.lit(1).alias("place"),
            F.concat(
                _csv_field(F.col("app_id")),
                F.expr("array_join(transform(c, (x, i) -> concat(repeat(',', cast(x.number - if(i = 0, -1, c[greatest(i - 1, 0)].number) as int)), x.n)), '')"),
                F.expr(f"repeat(',', cast({n} - 1 - element_at(c, -1).number as int))"),
            ).alias("line"),
        )
    )
    names = F.array_sort(F.collect_list(F.struct("number", _csv_field(F.col("value")).alias("v"))))
    header = numbered.agg(F.concat(F.lit("app_id,"), F.array_join(names["v"], ",")).alias("line"))
    used = cut_lineage(lines)
    headers = header.select(F.explode(F.sequence(F.lit(0), F.lit(files - 1))).alias("part"), F.lit(0).alias("place"), "line")
    whole = used.unionByName(headers.join(used.select("part").distinct(), "part", "left_semi"))
    whole = whole.repartition(files, "part").sortWithinPartitions("part", "place")
    whole.select("part", "line").write.partitionBy("part").mode("overwrite").text(path)


def _csv_field(value: Column) -> Column:
    """A value as a CSV field on one line: line ends in it become spaces."""
    return F.to_csv(F.struct(F.translate(value.cast("string"), "\r\n", "  ").alias("v")))


def _plain(field: Column) -> Column:
    """A CSV field without its quotes."""
    inner = F.regexp_replace(F.substring(field, F.lit(2), F.length(field) - 2), r"\\(.)", "$1")
    return F.when(field.startswith('"'), inner).otherwise(field)


def matrix_cells(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, value, n) for the filled cells of a written matrix, however many columns it has."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).withColumnRenamed("value", "line")
    field = r'("(?:[^"\\]|\\.)*"|[^,]*)'
    header = lines.where(F.col("line").startswith("app_id,")).distinct()
    fields = F.regexp_extract_all(F.expr("substr(line, 8)"), F.lit(rf"(?:^|,){field}"), F.lit(1))
    values = header.select(F.posexplode(fields).alias("number", "field")).select("number", _plain(F.col("field")).alias("value"))
    app = F.regexp_extract("line", f"^{field},", 1)
    body = lines.where(~F.col("line").startswith("app_id,")).select(app.alias("app"), F.expr("line"))
    cells = body.select(
        _plain(F.col("app")).alias("app_id"),
        F.explode(
            F.expr("filter(transform(split(substr(line, length(app) + 2), ','), (x, i) -> struct(i as number, x as n)), y -> y.n <> '')")
        ).alias("c"),
    )
    return cells.select("app_id", "c.number", F.col("c.n").cast("bigint").alias("n")).join(values, "number").select("app_id", "value", "n")


def _numbered(df: DataFrame, column: str, out: str) -> tuple[DataFrame, int]:
    """``df`` with each row's place (from 0) in the order of ``column``, and the number of rows."""
    placed, n = cut_counted(
        df.repartitionByRange(column).sortWithinPartitions(column).withColumn("__id", F.monotonically_increasing_id())
    )
    part = F.shiftright("__id", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the written table.
    offsets = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before")
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(out, place).drop("__id", "__part", "__n", "__before"), n


def write_report(report: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Report rows as JSON lines in buckets of apps."""
    bucketed = report.withColumn("bucket", F.pmod(F.xxhash64("app_id"), F.lit(buckets)).cast("int"))
    bucketed.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").json(path)


CLASS = ["app_id", "origin", "class_name"]
DEFAULT_FOLDER = "__HIVE_DEFAULT_PARTITION__"
_UNSAFE = re.compile(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]")


def write_code_units(units: DataFrame, folder: str) -> None:
    """One text file for each row (app_id, origin, class_name, value), in a folder of that class.

    A file costs Spark's writer a second one with checksums and, on local disks, two processes that set permissions: workers
    write the files themselves where they can open the store.  An attempt that is repeated writes the same files again.
    """

    def write(batches):
        number, last, f = TaskContext.get().partitionId(), None, None
        try:
            store, top = store_of(folder)
        except Exception:  # a store that only Spark writes to
            yield pa.RecordBatch.from_arrays([pa.array([False])], names=["opened"])
            return
        for b in batches:
            for *key, value in zip(*[b.column(c).to_pylist() for c in (*CLASS, "value")], strict=True):
                if key != last:
                    if f is not None:
                        f.close()
                    folders = (f"{k}={DEFAULT_FOLDER if v in (None, '') else _UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', str(v))}" for k, v in zip(CLASS, key))
                    at, last = "/".join([top, *folders]), key
                    store.create_dir(at)
                    f = store.open_output_stream(f"{at}/part-{number:05d}-code.txt")
                f.write(f"{value or ''}\n".encode())
        if f is not None:
            f.close()

    workers_import(units.sparkSession)
    units = units.select(*CLASS, "value").sortWithinPartitions(*CLASS)
    if not cut_lineage(units.mapInArrow(write, "opened boolean")).where("not opened").isEmpty():
        # Tasks move their own files (committer 2), not the driver.
        units.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(
            *CLASS
        ).text(folder)
