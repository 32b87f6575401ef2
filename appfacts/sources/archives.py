"""App archives: which files are apps."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appfacts.session import cut_lineage, workers_import

MANIFEST, CODE = "AndroidManifest.xml", "classes.dex"
FLAGS_SCHEMA = "uri string, has_manifest boolean, has_code boolean, error string"


#: Bytes from the end of a file that are looked at first: the directory of some ten thousand members.
TAIL = 1 << 20
#: Spark reads a file as one value of at most so many bytes.
MAX_FILE = (1 << 31) - 1 - 1024


def _names_of(file) -> tuple[bool, bool, str | None]:
    """Flags from an open archive, of which only the directory is read."""
    try:
        with zipfile.ZipFile(file) as z:
            names = set(z.namelist())
        return MANIFEST in names, CODE in names, None
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        return False, False, f"{type(e).__name__}: {e}"


def _read_names(content: bytes) -> tuple[bool, bool, str | None]:
    """Flags from an archive, or from its last bytes if they hold the directory."""
    return _names_of(io.BytesIO(content))


def _flags(batches):
    for batch in batches:
        rows = [(uri, *_read_names(bytes(content)), long) for uri, content, long in zip(batch["uri"], batch["content"], batch["long"])]
        yield pd.DataFrame(rows, columns=["uri", "has_manifest", "has_code", "error", "long"])


def archive_flags(files: DataFrame, tail: int = TAIL) -> DataFrame:
    """(uri, is_valid, is_decompilable, error) for files (uri, content).

    Valid archives hold a manifest and code, decompilable ones need code only; an unreadable file has both flags false
    and its error.  Only the archive's directory is looked at, which stands at its end: the last bytes go to Python, and
    the whole of a longer file only if they give no directory.
    """
    workers_import(files.sparkSession)
    length = F.length("content")
    ends = files.select("uri", (length > tail).alias("long"), F.substring(F.col("content"), -tail, tail).alias("content"))
    # Written once, so that files are not made or read again for each use of their flags.
    first = cut_lineage(ends.mapInPandas(_flags, f"{FLAGS_SCHEMA}, long boolean"))
    # A directory larger than the tail shows as an error, as does a file that is no archive.
    unsure = first.where("long and error is not null")
    if not unsure.isEmpty():
        again = files.join(unsure.select("uri"), "uri", "left_semi").withColumn("long", length > tail)
        first = first.where("not (long and error is not null)").unionByName(again.where("long").mapInPandas(_flags, first.schema))
    return first.select(
        "uri", (F.col("has_manifest") & F.col("has_code")).alias("is_valid"), F.col("has_code").alias("is_decompilable"), "error"
    )


def _open(uri: str):
    """A file of any store that the worker can open itself, to be read in parts."""
    if uri.startswith("file:"):
        return open("/" + uri.removeprefix("file:").lstrip("/"), "rb")
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _ranged(batches):
    for batch in batches:
        rows = []
        for uri in batch["uri"]:
            try:
                file = _open(uri)
            except Exception:  # a store that only Spark reads: its files are handed over by Spark
                rows.append((uri, None, None, None, False))
                continue
            with file:
                rows.append((uri, *_names_of(file), True))
        yield pd.DataFrame(rows, columns=["uri", "has_manifest", "has_code", "error", "opened"])


def scan_app_archives(spark: SparkSession, path: str) -> DataFrame:
    """Flags of every file under a folder, of any size.

    Spark lists the files; tasks read of each only its directory, which an archive has at its end.  Files of a store that
    workers can't open are read by Spark, one value each; among these, one too long for a value gives a row with an error.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumnRenamed("path", "uri")
    )
    workers_import(spark)
    ranged = cut_lineage(files.select("uri").mapInPandas(_ranged, f"{FLAGS_SCHEMA}, opened boolean"))
    opened = ranged.where("opened").select(
        "uri", (F.col("has_manifest") & F.col("has_code")).alias("is_valid"), F.col("has_code").alias("is_decompilable"), "error"
    )
    closed = ranged.where("not opened").select("uri")
    if closed.isEmpty():
        return opened
    left = files.join(closed, "uri", "left_semi")
    readable = archive_flags(left.where(F.col("length") <= MAX_FILE).select("uri", "content"))
    no = F.lit(False)
    too_long = left.where(F.col("length") > MAX_FILE).select(
        "uri", no.alias("is_valid"), no.alias("is_decompilable"), F.lit("file too long to read").alias("error")
    )
    return opened.unionByName(readable).unionByName(too_long)
