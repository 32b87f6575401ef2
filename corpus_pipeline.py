"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. toxicity: documents that the scorer rejects go;
2. near_duplicates: one document of each group of similar ones stays;
3. repeated_bytes: strings of 100 bytes that stood earlier are cut out of the texts;
4. decontamination: documents that hold a benchmark item go;
5. pieces: the texts that remain are encoded, and digests of ids and decoded text returned.

A document whose text changes keeps its id, language and source; its n_chars is counted anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appfacts.llm.decontaminate import drop_leaks
from appfacts.llm.jaccard_trie import first_of_groups
from appfacts.llm.pieces import digest_documents
from appfacts.llm.queries import tokenizer_path
from appfacts.llm.suffix_dedup import remove_repeats
from appfacts.llm.tables import read
from appfacts.llm.toxicity import keep_clean
from appfacts.session import ensure_checkpoint_dir

#: SQL cannot express the trained scorer, nor the piece model; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_groups(docs)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated strings.  A cut may fall inside a character, whose other bytes then go too."""
    cut = remove_repeats(docs, as_text=True, names=("__kept", "__bytes", "__removed", "__runs"))
    changed = F.col("__removed") > 0
    return cut.withColumns(
        {
            "text": F.when(changed, F.col("__kept")).otherwise(F.col("text")),
            "n_chars": F.when(changed, F.length("__kept").cast("bigint")).otherwise(F.col("n_chars")),
        }
    ).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_bytes", repeated_bytes),
    ("decontamination", decontamination),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, written between stages to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    docs = read(spark, sf_dir, "documents")
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
