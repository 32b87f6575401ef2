"""Line-oriented inputs: permission maps, API lists, usage reports, source/sink lists, code units."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appfacts.functions.text import java_to_jvm_signature, signature_parts
from appfacts.operators.skew import running_last
from appfacts.session import cut_lineage, workers_import


def carry_header(lines: DataFrame, header: Column, group: list[str], line_no: str, out: str = "header") -> DataFrame:
    """Adds the last non-null ``header`` at or above each line of a file of any length."""
    return running_last(lines, header, group, line_no, out)


def parse_permission_map(lines: DataFrame) -> DataFrame:
    """(permission, signature) from lines (file_id, line_no, line).

    A ``Permission:X`` line names the permission of the signature lines below it; other lines are skipped.
    """
    line = F.col("line")
    header = F.when(line.startswith("Permission:"), F.replace(line, F.lit("Permission:"), F.lit("")))
    return (
        carry_header(lines, header, ["file_id"], "line_no", "permission")
        .where(line.startswith("<"))
        .select("permission", java_to_jvm_signature("line").alias("signature"))
        .where(F.col("signature").isNotNull())
        .distinct()
    )


def read_api_list(hidden: DataFrame, non_public: DataFrame) -> DataFrame:
    """(kind, class_name, method) from two tables of one signature per line (column ``value``)."""
    both = hidden.select(F.lit("hidden").alias("kind"), "value").unionByName(
        non_public.select(F.lit("nonpublic").alias("kind"), "value")
    )
    p = signature_parts("value")
    return (
        both.select("kind", p["cls"].alias("class_name"), p["name"].alias("method"))
        .where((F.col("class_name") != "") & (F.col("method") != ""))
        .distinct()
    )


NON_PUBLIC_HEADER = "Non Public Method List:"


def read_usage_report(lines: DataFrame) -> DataFrame:
    """(file_id, kind, api, n) from an API usage report; rows below the second header are about non-public methods."""
    line = F.col("line")
    marker = F.when(line.startswith(NON_PUBLIC_HEADER), F.lit("nonpublic"))
    pattern = r"^(\S+)\s([0-9]+)$"
    return (
        carry_header(lines, marker, ["file_id"], "line_no", "__section")
        .where(line.rlike(pattern))
        .select(
            "file_id",
            F.coalesce("__section", F.lit("hidden")).alias("kind"),
            F.regexp_extract("line", pattern, 1).alias("api"),
            F.regexp_extract("line", pattern, 2).cast("bigint").alias("n"),
        )
    )


SOURCE_SINK_SCHEMA = "signature string, role string, positions string, tags string"


def read_source_sink_list(spark: SparkSession, path: str) -> DataFrame:
    """(signature, role, positions, tags) from tab-separated files; the last two columns are separated by ``|``."""
    raw = spark.read.csv(path, schema=SOURCE_SINK_SCHEMA, sep="\t", comment="#")

    def items(c):
        return F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "")

    tags = items("tags")
    return raw.where(F.col("role").isin("source", "sink")).select(
        "signature",
        "role",
        items("positions").cast("array<int>").alias("positions"),
        F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("ANY"))).alias("tags"),
    )


CODE_PATH_PATTERN = r"/app_id=(\d+)/origin=([^/]+)/(.+)\.[^./]+$"


#: Files and bytes of them that a task hands over together.
BATCH_FILES, BATCH_BYTES = 1_000, 8 << 20


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a file and its path there, for stores that the worker can open itself."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _hidden(name: str) -> bool:
    """Names that Spark's readers skip."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _encoded(path: str) -> str:
    """The path as Spark names a file."""
    return re.sub(r'[\x00-\x20"<>\\^`{|}%#?\[\]\x7f]', lambda m: f"%{ord(m[0]):02X}", path)


def _list_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, file, opened): files below each root; a root that can't be opened here gives one row."""

    def batch(root: str, files: list[str | None], opened: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([root] * len(files)), pa.array(files, pa.string()), pa.array([opened] * len(files))], names=["root", "file", "opened"])

    for b in batches:
        for root in b.column("root").to_pylist():
            try:
                store, top = store_of(root)
                todo = [store.get_file_info(top)]
            except Exception:  # a store that only Spark reads
                yield batch(root, [None], False)
                continue
            found: list[str | None] = []
            while todo:
                at = todo.pop()
                if at.type == fs.FileType.File:
                    found.append(at.path)
                    if len(found) >= BATCH_FILES:
                        yield batch(root, found, True)
                        found = []
                elif at.type == fs.FileType.Directory:
                    todo += [x for x in store.get_file_info(fs.FileSelector(at.path)) if not _hidden(x.base_name)]
            if found:
                yield batch(root, found, True)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(files: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_encoded(f) for f in files]), pa.array(contents, pa.binary())], names=["__file", "value"])

    for b in batches:
        files, contents, size = [], [], 0
        for root, file in zip(b.column("root").to_pylist(), b.column("file").to_pylist(), strict=True):
            with store_of(root)[0].open_input_file(file) as f:
                contents.append(f.read())
            files.append(file)
            size += len(contents[-1])
            if size >= BATCH_BYTES:
                yield batch(files, contents)
                files, contents, size = [], [], 0
        if files:
            yield batch(files, contents)


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(__file, value): every file below ``path`` as one value.

    Spark opens and lists a folder and a file at a time, and takes few small files to a task: a tree with a file for each
    class is listed and read by workers instead, where they can open the store.  The driver lists the top folder only.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    roots = [x.getPath() for x in store.listStatus(top)]
    roots = [(r.toString(),) for r in roots if not _hidden(r.getName())]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    workers_import(spark)
    if roots:
        folders = spark.createDataFrame(roots, "root string").repartition(n)
        files = cut_lineage(folders.mapInArrow(_list_files, "root string, file string, opened boolean").repartition(n, "file"))
        if files.where("not opened").isEmpty():
            read = files.select("root", "file").mapInArrow(_read_files, "__file string, value binary")
            return read.withColumn("value", F.col("value").cast("string"))
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("__file", F.input_file_name())


def read_code_units(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, class_name, origin, code): one text file per class, read whole.

    Files lie under ``app_id=…/origin=…/``, either as ``pkg/Cls.ext`` or in a folder ``class_name=pkg.Cls``.
    """
    files = _whole_files(spark, path)
    named = F.nullif(F.regexp_extract("__file", r"/class_name=([^/]+)/", 1), F.lit(""))
    return files.select(
        F.regexp_extract("__file", r"/app_id=(\d+)/", 1).cast("bigint").alias("app_id"),
        F.coalesce(named, F.translate(F.regexp_extract("__file", CODE_PATH_PATTERN, 3), "/", ".")).alias("class_name"),
        F.regexp_extract("__file", r"/origin=([^/]+)/", 1).alias("origin"),
        F.col("value").alias("code"),
    )
