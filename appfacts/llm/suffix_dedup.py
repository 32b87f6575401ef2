"""Removal of byte strings that also start earlier, by distributed prefix doubling on a sparse set of positions.

A string of ``length`` bytes is ranked by the ranks of its parts, which grow from round to round; what is unique leaves.

1. *Half length.*  Every window of ``length`` bytes names one position inside it: where its substring of half the length
   has the least hash (the leftmost such).  The choice depends on the window's bytes alone, so equal windows name the
   same place, and only about one position in ``length / 4`` is named at all.  Consecutive windows that name one position
   form a block.  Spark sorts blocks by (hash of the named half, hash of all the block's bytes, position): where a half is
   unique, all its windows are; where a block's bytes stood earlier, all its windows did.
2. *Nearly full length.*  What is left (first blocks whose half also occurs with other surroundings) is cut into runs of a
   few windows, which are sorted in the same way by the bytes that all windows of the run share.
3. *Full length.*  What is left now is sorted window by window, by rank pairs of two halves.

Hot strings: each task reports only the first of equal blocks of its batch to the sort and settles the others itself, so
a string in a third of all texts reaches the sort once for each batch, not for each text.  All ranks are exact up to
hash collisions: halves and runs count only together with a second hash (of the surroundings), windows only within runs
whose shared bytes are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from appfacts.llm.bytehash import _BASE2, BYTE_VALUES, SLICE_BYTES, mix, powers
from appfacts.llm.tables import bit_filter, map_batches, written

LENGTH = 100
#: Windows of one run in the second round, and bytes of a window's hash in the third.
RUN, TAG = 8, 5
_POSITION = np.uint64((1 << 22) - 1)

ROWS = "gram bigint, blk bigint, doc_id bigint, key int, place bigint, until bigint, tags binary"


class Hashes:
    """Hashes of substrings of one buffer."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(_BASE2, len(data)), out=self.total[1:])
        self.down = powers(np.uint64(pow(int(_BASE2), -1, 1 << 64)), len(data) + 1)

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.total[start + size] - self.total[start]) * self.down[start] + np.asarray(size).astype(np.uint64))


def _buffers(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of bounded size: bytes, and of each chunk in it the text, its place in the text, its place in the buffer.

    A long text is cut into chunks that overlap by ``length - 1`` bytes, so each window lies in exactly one chunk.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        sizes = [len(c) for _, _, c in held]
        at = np.concatenate(([0], np.cumsum(sizes)))
        data = np.frombuffer(b"".join(c for _, _, c in held), np.uint8)
        return data, np.array([r for r, _, _ in held]), np.array([p for _, p, _ in held]), at

    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), SLICE_BYTES):
            chunk = text[at : at + SLICE_BYTES + length - 1]
            held.append((row, at, chunk))
            size += len(chunk)
            if size >= SLICE_BYTES:
                yield joined()
                held.clear()
                size = 0
    if held:
        yield joined()


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def find_blocks(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """text, place (first window, number of windows, named position), half hash and block hash of every block."""
    half = length // 2
    out: list[tuple[np.ndarray, ...]] = []
    for data, rows, places, at in _buffers(texts, length):
        h = Hashes(data)
        halves = h.of(np.arange(len(data) - half + 1), half)
        packed = (halves & ~_POSITION) | np.arange(len(halves), dtype=np.uint64)
        named = (_sliding_min(packed, length - half + 1) & _POSITION).astype(np.int64)
        n = len(named)
        chunk = np.repeat(np.arange(len(rows)), np.diff(at))[:n]
        inside = np.arange(n) + length <= at[chunk + 1]
        cut = np.flatnonzero(
            np.concatenate(([True], (named[1:] != named[:-1]) | (chunk[1:] != chunk[:-1]) | (inside[1:] != inside[:-1])))
        )
        count = np.diff(np.append(cut, n))
        keep = inside[cut]
        first, count = cut[keep], count[keep]
        c = chunk[first]
        place = ((first - at[c] + places[c]) << 16) | (count << 8) | (named[first] - first)
        out.append((rows[c], place, halves[named[first]], h.of(first, count - 1 + length)))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def find_runs(texts: list[bytes], wanted: list[list[int]], length: int) -> tuple[np.ndarray, ...]:
    """text, place (first window, number of windows, its distance to the shared bytes), hash of the shared bytes, hash of
    the run, and the windows' own hashes, of all runs in the ``wanted`` blocks of each text."""
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in wanted])
    blocks = np.array([p for w in wanted for p in w], np.int64)
    order = np.lexsort((blocks, owner))
    owner, blocks = owner[order], blocks[order]
    start, count, named = blocks >> 16, blocks >> 8 & 0xFF, blocks & 0xFF
    spot = owner * (1 << 40) + start
    out: list[tuple[np.ndarray, ...]] = []
    for data, rows, places, at in _buffers(texts, length):
        h = Hashes(data)
        lo = np.searchsorted(spot, rows * (1 << 40) + places)
        hi = np.searchsorted(spot, rows * (1 << 40) + places + SLICE_BYTES)
        pick = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
        if not len(pick):
            continue
        chunk = np.repeat(np.arange(len(rows)), hi - lo)
        base = start[pick] - places[chunk] + at[chunk]
        n = count[pick]
        which = np.repeat(np.arange(len(pick)), n)
        window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + base[which]
        back = (base + named[pick])[which] - window  # from the window to the named position
        run = back // RUN
        cut = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (run[1:] != run[:-1]))))
        size = np.diff(np.append(cut, len(window)))
        first = window[cut]
        core = first + back[cut] - run[cut] * RUN
        halves = [h.of(window, length // 2), h.of(window + length - length // 2, length // 2)]
        tags = mix(halves[0] * _BASE2 + halves[1]).view(np.uint8).reshape(-1, 8)[:, :TAG]
        c = chunk[which[cut]]
        place = ((first - at[c] + places[c]) << 16) | (size << 8) | (core - first)
        out.append((rows[c], place, h.of(core, length - RUN + 1), h.of(first, size - 1 + length), tags, size))
    if not out:
        empty = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64), empty, empty, np.zeros((0, TAG), np.uint8), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _batch_rows(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Rows of ROWS for the sort: the first of equal blocks, and (with ``until``) what the others settle at once."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
    tags = size = None
    if "blocks" in batch.schema.names:
        row, place, gram, blk, tags, size = find_runs(texts, batch.column("blocks").to_pylist(), length)
    else:
        row, place, gram, blk = find_blocks(texts, length)
    ids = np.array([-(1 << 63) if d is None else d for d in batch.column("doc_id").to_pylist()], np.int64)
    keys = np.asarray(batch.column("key").to_numpy(), np.int64)
    _, rank = np.unique(np.stack([ids, keys], 1), axis=0, return_inverse=True) if len(ids) else (None, np.zeros(0, np.int64))
    rank = rank.reshape(-1)[row]
    order = np.lexsort((place, rank, blk, gram))
    g, b, r, p = gram[order], blk[order], rank[order], place[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (b[1:] != b[:-1])))[: len(g)]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(g) else np.zeros(0, np.int64)
    again = (r != r[head]) | (p != p[head])
    firsts = np.sort(order[~again])
    # Settled windows, put together to spans of bytes.
    done = np.sort(order[again])
    start, end = place[done] >> 16, (place[done] >> 16) + (place[done] >> 8 & 0xFF) - 1 + length
    o = np.lexsort((start, row[done]))
    owner, start, end = row[done][o], start[o], end[o]
    fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] > end[:-1])))[: len(owner)]
    span = np.flatnonzero(fresh)
    until = np.maximum.reduceat(end, span) if len(span) else end
    owner, start = owner[span], start[span]
    n, m = len(firsts), len(span)
    settled = np.arange(n + m) >= n
    take = pa.array(np.concatenate((row[firsts], owner)))
    if tags is None:
        packed = pa.nulls(n + m, pa.binary())
    else:
        at = np.concatenate(([0], np.cumsum(size)))
        chosen = np.concatenate([np.arange(at[i], at[i + 1]) for i in firsts]) if n else np.zeros(0, np.int64)
        offsets = np.concatenate(([0], np.cumsum(size[firsts]) * TAG, np.full(m, size[firsts].sum() * TAG))).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), n + m, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(tags[chosen]))])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((gram[firsts], mix(start.astype(np.uint64) * _BASE2 + owner.astype(np.uint64)))).view(np.int64)),
            pa.array(np.concatenate((blk[firsts], np.zeros(m, np.uint64))).view(np.int64), mask=settled),
            batch.column("doc_id").take(take),
            batch.column("key").take(take),
            pa.array(np.concatenate((place[firsts], start))),
            pa.array(np.concatenate((np.zeros(n, np.int64), until)), mask=~settled),
            packed,
        ],
        names=["gram", "blk", "doc_id", "key", "place", "until", "tags"],
    )


def _sorted_ranks(rows: DataFrame, length: int) -> DataFrame:
    """Spans that stood earlier (``until`` set), and first blocks whose gram also stands in other surroundings."""
    equal = Window.partitionBy("gram", "blk").orderBy("doc_id", "key", "place")
    whole = Window.partitionBy("gram").orderBy("blk", "doc_id", "key", "place")
    whole = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct("doc_id", "key", "place")
    start, count = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(0xFF)
    ranked = rows.withColumn("again", ~here.eqNullSafe(F.first(here).over(equal)) & F.col("blk").isNotNull()).withColumn(
        "several", F.first("blk").over(whole) != F.last("blk").over(whole)
    )
    return ranked.where(F.col("again") | F.col("until").isNotNull() | F.col("several")).select(
        "gram",
        "doc_id",
        "key",
        F.when(F.col("again"), start).otherwise(F.col("place")).alias("place"),
        F.when(F.col("again"), start + count - 1 + length).otherwise(F.col("until")).alias("until"),
        "tags",
    )


def repeated_spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, key, spans: for each text with repeated strings the byte ranges (from, to) to remove, not yet merged."""
    if not 2 * RUN <= length <= 400:
        raise ValueError("length must be between 16 and 400 bytes")
    texts = documents.select("doc_id", F.hash("text").alias("key"), "text")
    halves = map_batches(texts, lambda b: _batch_rows(b, length), ROWS)
    first = written(_sorted_ranks(halves, length).drop("tags", "gram"))
    blocks = (
        first.where("until is null").groupBy("doc_id", "key").agg(F.collect_set("place").alias("blocks"))
    )  # bounded by the text's own length
    near = bit_filter(texts, first.where("until is null"), ["doc_id", "key"])
    same = F.col("t.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("t.key") == F.col("b.key"))
    wanted = near.alias("t").join(blocks.alias("b"), same).select("t.doc_id", "t.key", "t.text", "b.blocks")
    second = written(_sorted_ranks(map_batches(wanted, lambda b: _batch_rows(b, length), ROWS), length))
    windows = (
        second.where("until is null")
        .withColumn("t", F.explode(F.sequence(F.lit(0), (F.length("tags") / TAG).cast("int") - 1)))
        .select(
            "gram",
            (F.col("place").bitwiseAND(0xFF) - F.col("t")).alias("lead"),
            F.substring(F.col("tags"), F.col("t") * TAG + 1, F.lit(TAG)).alias("tag"),
            "doc_id",
            "key",
            (F.shiftright("place", 16) + F.col("t")).alias("place"),
        )
    )
    equal = Window.partitionBy("gram", "lead", "tag").orderBy("doc_id", "key", "place")
    here = F.struct("doc_id", "key", "place")
    third = windows.withColumn("again", ~here.eqNullSafe(F.first(here).over(equal)))
    spans = [
        first.where("until is not null").select("doc_id", "key", "place", "until"),
        second.where("until is not null").select("doc_id", "key", "place", "until"),
        third.where("again").select("doc_id", "key", "place", (F.col("place") + length).alias("until")),
    ]
    return (
        spans[0].unionByName(spans[1]).unionByName(spans[2])
        .groupBy("doc_id", "key").agg(F.collect_set(F.struct("place", "until")).alias("spans"))
    )


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(kept bytes, number of bytes removed, number of maximal removed runs)."""
    kept, at, removed, runs = [], 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            runs += 1
            kept.append(data[at:a])
            removed += b - a
        elif b > end:
            removed += b - end
        end = max(end, b)
        at = end
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def remove_repeats(
    documents: DataFrame,
    length: int = LENGTH,
    as_text: bool = False,
    names: tuple[str, str, str, str] = ("kept", "n_bytes", "n_removed", "n_spans"),
) -> DataFrame:
    """Every row of ``documents`` with the bytes removed that a string of ``length`` bytes covers which starts earlier.

    Earlier means a smaller doc_id, or the same text and a smaller offset; rows with one doc_id and different texts are
    ordered by a hash of the text, and equal rows are one text.  A null doc_id comes first.  Null texts are empty; texts
    shorter than ``length`` stay as they are.  Result: all columns of ``documents`` and four more called ``names``
    (a column of that name is replaced): what is kept (binary, for a removed run may end inside a character; with
    ``as_text`` a string, without the bytes of characters that were cut), bytes, bytes removed, removed runs.
    """
    columns = [c for c in documents.columns if c not in names]
    base = documents.select(*[F.col(f"`{c}`") for c in columns], F.hash("text").alias("__key"))
    spans = written(
        repeated_spans(documents, length).select("doc_id", F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    )
    near, rest = bit_filter(base, spans, ["doc_id", "__key"], both=True)
    same = F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.__key") == F.col("s.__key"))
    joined = near.alias("t").join(spans.alias("s"), same, "left").select("t.*", "s.__spans")
    kind = T.StringType() if as_text else T.BinaryType()
    added = [T.StructField(n, t) for n, t in zip(names, (kind, T.LongType(), T.LongType(), T.LongType()), strict=True)]
    out = T.StructType([*documents.select(*[F.col(f"`{c}`") for c in columns]).schema.fields, *added])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, cut in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            kept, removed, runs = cut_spans(data, [(s["place"], s["until"]) for s in cut or []])
            rows.append((kept.decode("utf-8", "ignore") if as_text else kept, len(data), removed, runs))
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in columns], pa.array([r[0] for r in rows], pa.string() if as_text else pa.binary())]
            + [pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)],
            names=[*columns, *names],
        )

    whole = F.coalesce("text", F.lit("")) if as_text else F.coalesce("text", F.lit("")).cast("binary")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    zero = F.lit(0).cast("bigint")
    untouched = rest.select(
        *[F.col(f"`{c}`") for c in columns], *[v.alias(n) for v, n in zip((whole, size, zero, zero), names, strict=True)]
    )
    return map_batches(joined, run, out).unionByName(untouched)


def digest_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: bytes, bytes removed, removed runs, and SHA-256 of what stays (see ``remove_repeats``)."""
    return remove_repeats(documents.select("doc_id", "text"), length).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )
