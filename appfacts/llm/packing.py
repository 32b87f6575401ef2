"""Packing of token ids into rows of fixed length.

Texts are encoded and packed where they lie: a task fills rows from blocks of a bounded number of ids of its own
partition, so no id is shuffled and a lost task is simply run again.  A text longer than a row is split into whole rows
and a rest, without loss.  Rests are packed by best fit in order of falling length: a segment tree over capacities finds
the open row with the least room that still fits.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appfacts.llm.tables import sliced, workers_import

ROW_IDS = 2048
#: Ids packed together; more gives fuller rows and takes more memory.
BLOCK_IDS = 2_000_000
#: Rows of one matrix of the result.
MATRIX_ROWS = 64


class Capacities:
    """Segment tree over capacities 0..size: how many open rows have each, and the least one not below a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, row) of the fullest open row with room for ``length``, removed from the tree."""
        node = length + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node <<= 1
                if not self.count[node]:
                    node += 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows of item numbers such that no row's lengths exceed ``size``; items are taken longest first, then in order."""
    tree, rows = Capacities(size), []
    for item in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        length = int(lengths[item])
        if (found := tree.take(length)) is None:
            capacity, row = size, len(rows)
            rows.append([])
        else:
            capacity, row = found
        rows[row].append(item)
        if capacity > length:
            tree.put(capacity - length, row)
    return rows


def byte_bpe(path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Encoder of a tiktoken rank file (standard base 64 and a rank on each line)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), np.uint32)


_ENCODERS: dict[tuple[str, str], Callable[[str], np.ndarray]] = {}

SCHEMA = (
    "part int, first_row bigint, n_rows int, ids binary, cu_seqlens array<int>, row_starts array<int>,"
    " doc_ids array<bigint>, doc_starts array<int>, position_resets array<int>"
)


def _matrices(
    docs: list[tuple[int | None, np.ndarray]], size: int, end_id: int, pad_id: int, part: int, row: int
) -> Iterator[dict]:
    """Pack one block of (doc_id, ids)."""
    segments: list[tuple[int | None, int, np.ndarray]] = []  # document, place in it, ids
    full: list[list[int]] = []
    rest: list[int] = []
    for doc, ids in docs:
        ids = np.append(ids, np.uint32(end_id))
        for at in range(0, len(ids), size):
            (full.append([len(segments)]) if len(ids) - at >= size else rest.append(len(segments)))
            segments.append((doc, at, ids[at : at + size]))
    packed = best_fit(np.array([len(segments[i][2]) for i in rest], np.int64), size) if rest else []
    rows = full + [[rest[i] for i in items] for items in packed]
    for at in range(0, len(rows), MATRIX_ROWS):
        some = rows[at : at + MATRIX_ROWS]
        matrix = np.full((len(some), size), pad_id, np.uint32)
        lengths, starts, owners, places, resets = [0], [0], [], [], []
        for r, items in enumerate(some):
            filled = 0
            for i in items:
                doc, place, ids = segments[i]
                matrix[r, filled : filled + len(ids)] = ids
                resets.append(r * size + filled)
                owners.append(doc)
                places.append(place)
                lengths.append(lengths[-1] + len(ids))
                filled += len(ids)
            starts.append(len(lengths) - 1)
        yield {
            "part": part, "first_row": row + at, "n_rows": len(some), "ids": matrix.astype("<u4").tobytes(),
            "cu_seqlens": lengths, "row_starts": starts, "doc_ids": owners, "doc_starts": places, "position_resets": resets,
        }


def pack_documents(
    documents: DataFrame, tokenizer: str, pattern: str, size: int = ROW_IDS, end_id: int = 50256, pad_id: int = 50256,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Packed id matrices of all texts.

    Each result row is a matrix of ``n_rows`` x ``size`` little-endian 32-bit ids.  Its segments, in row order, are
    given by ``cu_seqlens`` (cumulative lengths from 0; padding belongs to none), ``row_starts`` (first segment of each
    row, and one past the last), ``doc_ids``, ``doc_starts`` (place of the segment in its document's ids) and
    ``position_resets`` (place in the flattened matrix where position ids start again from 0).  Every text ends with
    ``end_id``; a null or empty one is that id alone.  Repeated rows are packed as often as they stand.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, pattern) not in _ENCODERS:
            _ENCODERS[tokenizer, pattern] = byte_bpe(tokenizer, pattern)
        encode = _ENCODERS[tokenizer, pattern]
        part, row, held, docs = TaskContext.get().partitionId(), 0, 0, []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal row, held
            for m in _matrices(docs, size, end_id, pad_id, part, row):
                yield pa.RecordBatch.from_pylist([m], schema=TYPES)
                last = m["first_row"] + m["n_rows"]
            row, held = last, 0
            docs.clear()

        for batch in sliced(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "")
                docs.append((doc, ids))
                held += len(ids) + 1
                if held >= block_ids:
                    yield from out()
        if docs:
            yield from out()

    workers_import(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


TYPES = pa.schema(
    [("part", pa.int32()), ("first_row", pa.int64()), ("n_rows", pa.int32()), ("ids", pa.binary())]
    + [("cu_seqlens", pa.list_(pa.int32())), ("row_starts", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64()))]
    + [("doc_starts", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32()))]
)


def unpack(packed: DataFrame) -> DataFrame:
    """doc_id, at, ids: every segment of ``pack_documents``, whose ids joined by ``at`` are a document's.

    For checks and for readers that want documents back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                ids = np.frombuffer(m["ids"], "<u4")
                size = np.diff(m["cu_seqlens"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(m["doc_ids"], pa.int64()),
                        pa.array(m["doc_starts"], pa.int32()),
                        pa.array([ids[a : a + n].astype(np.int32) for a, n in zip(m["position_resets"], size, strict=True)], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "at", "ids"],
                )

    return packed.mapInArrow(run, "doc_id bigint, at int, ids array<int>")


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the matrices for training readers: Parquet files, each row one matrix, so any reader can map rows to bytes."""
    packed.write.mode("overwrite").parquet(path)


def read_packed(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def packing_report(packed: DataFrame, size: int = ROW_IDS) -> DataFrame:
    """Rows, ids and share of padding over all matrices."""
    return packed.agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum(F.element_at("cu_seqlens", -1)).alias("n_ids"),
        (1 - F.sum(F.element_at("cu_seqlens", -1)) / (F.sum("n_rows") * size)).alias("padding"),
    )
