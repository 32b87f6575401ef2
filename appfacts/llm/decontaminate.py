"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Every window of a text that has as many words as a benchmark item can be a copy of it, and so can a whole text that is
shorter than the item: it is its own window for each size of item above its own.  A window's weighted shingles give
a 64-bit SimHash.  Fingerprints are cut into blocks: of two that differ in at most RADIUS bits, some block differs in at
most RADIUS // BLOCKS, so an equality join of the windows' blocks with all such variants of the items' blocks misses no
pair within the radius.  How many similar pairs lie beyond the radius depends on the weights, so pairs are also searched by
shared shingles (``_prefix``), which misses none.  All are then compared by exact Jaccard similarities: the weighted one, and
the one with equal weights, as a changed word would outweigh shingles that many items share.

Windows that can't reach the similarity with any item of their size, because too many of their shingles occur in no such
item, are not fingerprinted; that bound is exact.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appfacts.llm.bytehash import ALNUM_WORD, shingle_hashes, word_hashes
from appfacts.llm.tables import map_batches, written

SHINGLE, SIMILAR = 5, 0.8
#: For equal weights, texts of similarity 0.8 differ in 9.7 of 64 bits on average, with a deviation of 2.9.
BLOCKS, RADIUS = 5, 19
#: Different item shingles that a task holds at a time; a larger benchmark is searched in parts.
PART_SHINGLES = 1_000_000

_BITS = np.arange(64, dtype=np.uint64)
_EDGES = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]

WINDOW = "doc_id bigint, key int, first_word bigint, n_words int, item_words int, print bigint, grams array<bigint>, weights array<double>"


def simhash(grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Fingerprint of each row of a matrix of gram hashes with weights."""
    out = np.zeros(len(grams), np.uint64)
    for bit in range(64):
        sign = ((grams >> np.uint64(bit)) & np.uint64(1)).astype(np.float64) * 2 - 1
        out |= ((sign * weights).sum(axis=1) > 0).astype(np.uint64) << np.uint64(bit)
    return out


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of the least over sum of the greatest weights; a repeated shingle's weights add up."""
    keys, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    left = np.bincount(where[: len(a)], wa, len(keys))
    right = np.bincount(where[len(a) :], wb, len(keys))
    top = np.maximum(left, right).sum()
    return float(np.minimum(left, right).sum() / top) if top else 0.0


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The greater of the weighted Jaccard similarity and that with equal weights."""
    return max(weighted_jaccard(a, wa, b, wb), weighted_jaccard(a, np.ones(len(a)), b, np.ones(len(b))))


def _prefix(grams: list[int], weights: list[float]) -> list[int]:
    """Shingles of which two sets with ``similarity`` of SIMILAR have one in common.

    Both sets share SIMILAR of their own weight at least, so less than the rest stands before the first shared shingle,
    in an order that is the same for both: by falling weight, then by hash.  That holds for either kind of weights.
    """
    g, where = np.unique(np.array(grams, np.int64), return_inverse=True)
    w, count = np.bincount(where, weights, len(g)), np.bincount(where, minlength=len(g))
    order = np.lexsort((g, -np.round(w / count, 12)))
    take = np.zeros(len(g), bool)
    for each in (w[order], count[order].astype(np.float64)):
        before = np.cumsum(each) - each
        take |= before <= (1 - SIMILAR) * each.sum() + 1e-9
    return g[order][take].tolist()


def _prefixes(df: DataFrame, name: str, size: str) -> DataFrame:
    """(name, size, gram) for the shingles of each row's ``_prefix``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_prefix(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("grams", "weights")), strict=True)]
        rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        grams = pa.array([g for f in found for g in f], pa.int64())
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in (name, size)], grams], names=[name, size, "gram"])

    return map_batches(df.select(name, size, "grams", "weights"), run, f"{name} bigint, {size} int, gram bigint")


def _sized(n: int) -> int:
    """Words of a shingle of an item with ``n`` words: SHINGLE, or the whole item if it has fewer."""
    return min(n, SHINGLE)


def _item_grams(batch: pa.RecordBatch) -> pa.RecordBatch:
    words, at = word_hashes(batch.column("text").to_pylist(), ALNUM_WORD)
    n = np.diff(at)
    grams = [shingle_hashes(words[a:b], _sized(b - a)).view(np.int64) if b > a else words[:0].view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [batch.column("item_id"), pa.array(n, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], names=["item_id", "n_words", "grams"]
    )


def _item_prints(batch: pa.RecordBatch) -> pa.RecordBatch:
    prints = [
        simhash(np.array([g], np.int64).view(np.uint64), np.array([w]))[0] if g else np.uint64(0)
        for g, w in zip(batch.column("grams").to_pylist(), batch.column("weights").to_pylist(), strict=True)
    ]
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c) for c in ("item_id", "n_words")], pa.array(np.array(prints, np.uint64).view(np.int64))]
        + [batch.column(c) for c in ("grams", "weights")],
        names=["item_id", "n_words", "print", "grams", "weights"],
    )


class Vocabulary:
    """Item shingles by size of item: sorted hashes with weights."""

    def __init__(self, rows: list[tuple[int, int, float]]):
        by_size: dict[int, list[tuple[int, float]]] = {}
        for size, gram, weight in rows:
            by_size.setdefault(size, []).append((gram, weight))
        self.sizes = {}
        for size, pairs in sorted(by_size.items()):
            grams = np.array([g for g, _ in pairs], np.int64).view(np.uint64)
            order = np.argsort(grams)
            self.sizes[size] = grams[order], np.array([w for _, w in pairs])[order]
        every = [g for s, (g, _) in self.sizes.items() if s >= SHINGLE]
        self.every = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)


def _found(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is a member, place among) for each value."""
    if not len(among):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    spot = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[spot] == values, spot


def _windows(batch: pa.RecordBatch, known: Vocabulary) -> pa.RecordBatch | None:
    """Fingerprints of the windows of each item size, and of whole shorter texts, that may be similar to such an item."""
    words, at = word_hashes(batch.column("text").to_pylist(), ALNUM_WORD)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    out: list[tuple] = []
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size, (grams, weights) in known.sizes.items():
        k = _sized(size)
        if k not in by_length:
            hashes = shingle_hashes(words, k)
            inside = row[: len(hashes)] == row[k - 1 :] if len(hashes) else np.zeros(0, bool)
            among = known.every if k == SHINGLE else grams
            by_length[k] = hashes, np.flatnonzero(inside & _found(hashes, among)[0])
        hashes, spots = by_length[k]
        if k < SHINGLE:  # sizes below SHINGLE have lists of their own
            spots = np.flatnonzero(_found(hashes, grams)[0] & (row[: len(hashes)] == row[k - 1 :])) if len(hashes) else spots
        else:
            spots = spots[_found(hashes[spots], grams)[0]]
        if not len(spots):
            continue
        m = size - k + 1
        starts = np.unique(spots[:, None] - np.arange(m)) if len(spots) * m < 4_000_000 else np.arange(len(words))
        starts = starts[(starts >= 0) & (starts + size <= len(words))]
        starts = starts[row[starts] == row[starts + size - 1]]
        # Unknown shingles weigh 1 each and no known one more, so at most 1 - SIMILAR of the window's may be unknown.
        have = np.searchsorted(spots, starts + m) - np.searchsorted(spots, starts)
        starts = starts[m - have <= (1 - SIMILAR) * m + 1e-9]
        # Texts with fewer words than the item, by their number of shingles; the same bound holds for them.
        some_known = np.unique(row[spots])
        short = some_known[n[some_known] < size]
        unknown = n[short] - k + 1 - (np.searchsorted(spots, at[short + 1]) - np.searchsorted(spots, at[short]))
        short = short[unknown <= (1 - SIMILAR) * (n[short] - k + 1) + 1e-9]
        groups = [(x, m) for x in np.array_split(starts, max(1, len(starts) * m // 200_000))]
        groups += [(at[short[n[short] == words_]], int(words_) - k + 1) for words_ in np.unique(n[short])]
        for some, count in groups:
            if len(some):
                g = hashes[some[:, None] + np.arange(count)]
                member, spot = _found(g.reshape(-1), grams)
                w = np.where(member, weights[spot], 1.0).reshape(g.shape)
                same = np.ones(len(some), np.int64)
                out.append(
                    (row[some], some - at[row[some]], same * (count + k - 1), same * size, simhash(g, w), list(g.view(np.int64)), list(w))
                )
    if not out:
        return None
    rows, first, own, size, prints = (np.concatenate([o[i] for o in out]) for i in range(5))
    take = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(take),
            batch.column("key").take(take),
            pa.array(first, pa.int64()),
            pa.array(own, pa.int32()),
            pa.array(size, pa.int32()),
            pa.array(prints.view(np.int64)),
            pa.array([g for o in out for g in o[5]], pa.list_(pa.int64())),
            pa.array([w for o in out for w in o[6]], pa.list_(pa.float64())),
        ],
        names=["doc_id", "key", "first_word", "n_words", "item_words", "print", "grams", "weights"],
    )


def _block(number: int) -> str:
    low, high = _EDGES[number], _EDGES[number + 1]
    return f"shiftrightunsigned(print, {low}) & {(1 << (high - low)) - 1}L"


def _variants(number: Column, own: Column, masks: Column) -> Column:
    return F.transform(masks, lambda mask: F.struct(number.alias("block"), own.bitwiseXOR(mask).alias("value")))


def blocks(prints: DataFrame, errors: int) -> DataFrame:
    """``prints`` with a row for each block and each value that differs from the block in at most ``errors`` bits."""
    made = []
    for number in range(BLOCKS):
        width = _EDGES[number + 1] - _EDGES[number]
        masks = [sum(1 << b for b in c) for e in range(errors + 1) for c in combinations(range(width), e)]
        own, values = F.expr(_block(number)), F.array(*[F.lit(m).cast("bigint") for m in masks])
        made.append(_variants(F.lit(number), own, values))
    return prints.select("*", F.explode(F.concat(*made)).alias("__b")).select("*", "__b.block", "__b.value").drop("__b")


def _verify(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = (batch.column(c).to_pylist() for c in ("grams", "weights", "item_grams", "item_weights"))
    similar = [similarity(*(np.array(x) for x in row)) for row in zip(*sets, strict=True)]
    keep = ["doc_id", "key", "item_id", "first_word", "n_words", "distance"]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(similar)], names=[*keep, "similarity"])


def find_leaks(documents: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, item_id, first_word, n_words, distance, similarity: the most similar window of each document and item.

    A text with fewer words than the item is one window, of all its words.

    Words are runs of letters, digits and non-ASCII characters, lower-cased; items below five words are one shingle.
    A shingle that several items have weighs 1 over their number, any other 1; the similarity is that with these weights or
    that with equal ones, whichever is greater.  Texts or items that are null or have no
    words match nothing; repeated rows and items with one id and several texts give one row per document and item.
    ``similar`` may not be below SIMILAR, on which the search depends.
    """
    if similar < SIMILAR:
        raise ValueError(f"similarities below {SIMILAR} are not searched")
    spark = documents.sparkSession
    items = map_batches(
        benchmark.select("item_id", "text").where("item_id is not null").distinct(), _item_grams, "item_id bigint, n_words int, grams array<bigint>"
    ).where("n_words > 0")
    items = items.withColumn("__item", F.xxhash64("item_id", "grams"))
    weights = (
        items.select("item_id", F.explode("grams").alias("gram")).distinct().groupBy("gram").agg((1 / F.count(F.lit(1))).alias("weight"))
    )
    weighed = written(
        items.select("item_id", "n_words", "__item", F.posexplode("grams").alias("at", "gram"))
        .join(weights, "gram")
        .groupBy("item_id", "n_words", "__item")
        .agg(F.sort_array(F.collect_list(F.struct("at", "gram", "weight"))).alias("g"))
        .select("item_id", "n_words", F.col("g.gram").alias("grams"), F.col("g.weight").alias("weights"))
    )
    schema = "item_id bigint, n_words int, print bigint, grams array<bigint>, weights array<double>"
    prints = written(map_batches(weighed, _item_prints, schema))
    lists = prints.select("n_words", F.explode(F.arrays_zip("grams", "weights")).alias("g")).select("n_words", "g.grams", "g.weights")
    lists = lists.groupBy("n_words", "grams").agg(F.max("weights").alias("weight"))
    parts = max(1, -(-lists.count() // PART_SHINGLES))
    texts = documents.select("doc_id", F.hash("text").alias("key"), "text")
    found = []
    for part in range(parts):
        # All items of a size go to one part where there are several; each part is searched over all texts.
        some = lists.where(F.pmod(F.hash("n_words", F.when(F.lit(parts) > 1, F.col("n_words"))), F.lit(parts)) == part)
        known = Vocabulary([tuple(r) for r in some.collect()])
        if known.sizes:
            found.append(map_batches(texts, lambda b, k=known: _windows(b, k), WINDOW))
    if not found:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, first_word bigint, n_words int, distance int, similarity double")
    windows = found[0]
    for more in found[1:]:
        windows = windows.unionByName(more)
    # A passage that many texts share has equal windows in all of them: they are searched and compared once.
    windows = written(windows)
    alike = windows.groupBy("n_words", "item_words", "print", "grams").agg(F.first("weights").alias("weights"))
    alike = written(alike.withColumn("window", F.xxhash64("item_words", "grams")))
    candidates = (
        blocks(alike.select("window", F.col("item_words").alias("for_words"), "print"), 0)
        .join(
            blocks(prints.select("item_id", F.col("n_words").alias("item_words"), "print"), RADIUS // BLOCKS)
            .withColumnRenamed("print", "item_print")
            # Variants are about 1,900 for each item, which no estimate from the items' own size tells: never broadcast.
            .hint("merge"),
            ["block", "value"],
        )
        .where(F.col("for_words") == F.col("item_words"))
        .withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
        .where(F.col("distance") <= RADIUS)
        .select("window", "item_id", "item_words")
    )
    sharing = (
        _prefixes(alike, "window", "item_words")
        .join(_prefixes(prints.withColumnRenamed("n_words", "item_words"), "item_id", "item_words"), ["item_words", "gram"])
        .select("window", "item_id", "item_words")
    )
    candidates = candidates.unionByName(sharing).distinct()
    return _checked(windows, alike, candidates, prints, similar)


def _checked(windows: DataFrame, alike: DataFrame, candidates: DataFrame, prints: DataFrame, similar: float) -> DataFrame:
    pairs = candidates.join(
        alike.select("window", "n_words", "item_words", "print", "grams", "weights"), ["window", "item_words"]
    ).join(
        prints.select("item_id", F.col("n_words").alias("item_words"), F.col("print").alias("item_print"), F.col("grams").alias("item_grams"), F.col("weights").alias("item_weights")),
        ["item_id", "item_words"],
    )
    pairs = pairs.select(
        F.col("window").alias("doc_id"), F.lit(0).alias("key"), "item_id", F.lit(0).cast("bigint").alias("first_word"), "n_words",
        F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))).alias("distance"), "grams", "weights", "item_grams", "item_weights",
    )
    checked = map_batches(pairs, _verify, "window bigint, key int, item_id bigint, first_word bigint, n_words int, distance int, similarity double")
    good = checked.where(F.col("similarity") >= similar).select("window", "item_id", "distance", "similarity")
    placed = windows.select("doc_id", "first_word", "n_words", F.xxhash64("item_words", "grams").alias("window"))
    best = F.max_by(
        F.struct("first_word", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("distance"), -F.col("first_word"))
    )
    return placed.join(good, "window").groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def drop_leaks(documents: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Rows of ``documents``, all columns, without documents that hold a benchmark item."""
    leaks = find_leaks(documents, benchmark, similar).select(F.col("doc_id").alias("__leak")).distinct()
    return documents.join(leaks, F.col("doc_id").eqNullSafe(F.col("__leak")), "left_anti")
