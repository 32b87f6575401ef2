"""Divergence audit: how far the word use of each source departs from the other sources of its language.

A task sorts pointers to the word starts of a shard of texts, as they lie in the Arrow buffer: a multikey sort that looks
at eight bytes of a word at a time and goes on only with words that still agree.  A run of equal words gives its document
frequency and its count in each source; only those go on to Spark, which adds them up by language, term and source.

The rest is exact arithmetic over the terms kept (those in enough documents of a language).  Two sources are compared
over all kept terms.  Most terms are missing from one or both, so a pair is summed as: every term of either source against
the other's value for a missing term (from a histogram of counts), plus a correction for the terms that both have.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from appfacts.llm.bytehash import LOWER
from appfacts.llm.tables import map_batches, written

#: Bytes of terms, after A-Z are lower-cased: letters and all that isn't ASCII.
TERM = np.zeros(256, bool)
TERM[0x61:0x7B] = TERM[0x80:] = True
#: Bytes of text whose word starts are sorted at a time.
SHARD_BYTES = 4 << 20
#: Bytes after which equal beginnings are rare: what still agrees is compared as a whole.
LONG_TERM = 64
MIN_DOCUMENTS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000


def term_pointers(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the terms in folded bytes; no term crosses a position of ``breaks``."""
    inside = TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    breaks = breaks[(breaks > 0) & (breaks < len(data))]
    first[breaks] = inside[breaks]
    last[breaks - 1] = inside[breaks - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts


def sort_pointers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by their terms' bytes, and the number of the run of equal terms each one is in.

    A multikey sort: one pass sorts by eight bytes (a big-endian number; what lies behind the term counts as zero, which
    no term holds), and only pointers of runs with longer terms are sorted by the next eight, up to LONG_TERM.
    """
    order, run = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    open_at, depth = order.copy(), 0
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    while len(open_at):
        pointers = order[open_at]
        if depth < LONG_TERM:
            rest = np.clip(sizes[pointers] - depth, 0, 8)
            at = np.minimum(starts[pointers] + depth, len(data))
            taken = padded[at[:, None] + np.arange(8)]
            taken[np.arange(8) >= rest[:, None]] = 0
            key = taken.view(">u8").reshape(-1).astype(np.uint64)
        else:
            tails = [data[s + depth : s + n].tobytes() for s, n in zip(starts[pointers], sizes[pointers], strict=True)]
            rank = {t: i for i, t in enumerate(sorted(set(tails)))}
            key = np.array([rank[t] for t in tails], np.uint64)
        by = np.argsort(key) if depth == 0 else np.lexsort((key, run[open_at]))
        order[open_at], key, was = pointers[by], key[by], run[open_at]
        # ``open_at`` holds whole runs, so their numbers stand as before the sort.
        step = np.zeros(len(run), bool)
        step[open_at[1:]] = (key[1:] != key[:-1]) & (was[1:] == was[:-1])
        run = run + np.cumsum(step)
        if depth >= LONG_TERM:
            break
        depth += 8
        longest = np.zeros(run[-1] + 1, np.int64)
        np.maximum.at(longest, run[open_at], sizes[order[open_at]])
        members = np.bincount(run)
        open_at = np.flatnonzero((longest[run] > depth) & (members[run] > 1))
    return order, run


def _terms(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The terms as an Arrow array."""
    ends = np.cumsum(sizes)
    spots = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[spots].tobytes())])


def shard_counts(data: np.ndarray, breaks: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a shard by group: (term, group, occurrences, documents).

    ``breaks`` are where the documents begin (and the end), ``group`` the group of each.
    """
    starts, sizes = term_pointers(data, breaks)
    order, run = sort_pointers(data, starts, sizes)
    if not len(order):
        return pa.array([], pa.binary()), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    document = np.searchsorted(breaks, starts[order], "right") - 1
    by_document, times = np.unique(run * len(group) + document, return_counts=True)
    n_groups = int(group.max()) + 1
    owner = by_document // len(group) * n_groups + group[by_document % len(group)]
    held, back = np.unique(owner, return_inverse=True)
    n, documents = np.bincount(back, times).astype(np.int64), np.bincount(back)
    head = order[np.searchsorted(run, held // n_groups)]
    return _terms(data, starts[head], sizes[head]), held % n_groups, n, documents


def _long_text(data: np.ndarray) -> Counter:
    """Occurrences of each term of one text that is longer than a shard, sorted shard by shard."""
    total: Counter = Counter()
    at = 0
    while at < len(data):
        end = min(len(data), at + SHARD_BYTES)
        while end < len(data) and TERM[data[end]]:  # a term is never cut
            more = np.flatnonzero(~TERM[data[end : end + SHARD_BYTES]])
            end = end + int(more[0]) if len(more) else min(len(data), end + SHARD_BYTES)
        part = data[at:end]
        terms, _, n, _ = shard_counts(part, np.array([0, len(part)]), np.zeros(1, np.int64))
        total.update(dict(zip(terms.to_pylist(), n.tolist(), strict=True)))
        at = end
    return total


def count_terms(documents: DataFrame, text: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(lang, source, term, n, documents) summed for shards: a term comes once or more often for its group.

    Null texts and names are empty ones.  A text longer than a shard is sorted in parts.
    """
    inner = documents.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in zip((*by, text), ("lang", "source", "text"), strict=True)]
    )

    def table(terms, group, n, documents_, names) -> pa.RecordBatch:
        columns = [names.field(i).take(pa.array(group, pa.int64())) for i in range(2)]
        arrays = [*columns, terms, pa.array(n, pa.int64()), pa.array(documents_, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "documents"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = batch.column("text")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        data, breaks = LOWER[data], (offsets - offsets[0]).astype(np.int64)
        group, seen = np.zeros(len(batch), np.int64), {}
        for i, pair in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            group[i] = seen.setdefault(pair, len(seen))
        names = pa.StructArray.from_arrays(
            [pa.array([p[i] for p in seen], pa.string()) for i in range(2)], names=["lang", "source"]
        )
        if len(data) > 2 * SHARD_BYTES and len(batch) == 1:
            total = _long_text(data)
            return table(pa.array(list(total), pa.binary()), [0] * len(total), list(total.values()), [1] * len(total), names)
        terms, owner, n, held = shard_counts(data, breaks, group)
        return table(terms, owner, n, held, names)

    counted = map_batches(inner, run, "lang string, source string, term binary, n bigint, documents bigint", SHARD_BYTES)
    return counted.withColumn("term", F.col("term").cast("string"))


def audit_sources(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: divergences of source pairs, and each source's most telling terms.

    Every row of ``documents`` is a document: rows repeated in full count as often as they come.  Null and empty texts
    have no terms, null names are the empty name; a group without terms still gets its pairs.  Ties go to the smaller
    item by UTF-8 bytes.  Further columns have no part in it.  No documents give no rows.
    """
    groups = written(documents.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).agg(F.lit(1).alias("__one")).drop("__one"))
    counts = count_terms(documents).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    # At most one entry for each source of the language.
    kept = written(
        counts.groupBy("lang", "term")
        .agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources"))
        .where(F.col("documents") >= min_documents)
        .drop("documents")
    )
    each = kept.select("lang", "term", F.col("n").alias("n_lang"), F.inline("sources"))
    sums = each.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"))
    totals = kept.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("v"))

    def share(n: str, of: str) -> str:
        """The smoothed share of a count, in parts of SCALE; in decimals, since a count times SCALE may pass 64 bits."""
        return f"cast(1 + (cast({SCALE} as decimal(38,0)) * ({n} + 2)) div ({of} + 2 * v) as bigint)"

    def f(p: str, q: str) -> str:
        return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"

    # For every group: the size of its language's list, its own sum, and what a missing term is worth.
    known = written(
        groups.join(totals, "lang", "left")
        .join(sums, ["lang", "source"], "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "total", "n", "terms")])
        .withColumns({"p0": F.expr(f"if(v = 0, 0L, {share('0', 'n')})")})
        .withColumnRenamed("n", "own")
    )
    of_lang = known.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("own", "p0")))).alias("of"), F.first("v").alias("v"))
    valued = kept.join(of_lang, "lang").select(
        "lang", F.expr(f"transform(array_sort(sources), x -> struct(x.source as s, {share('x.n', 'of[x.source].own')} as p, of[x.source].p0 as z))").alias("ps")
    )
    both = (
        valued.select("lang", "ps", F.posexplode("ps").alias("i", "a"))
        .select("lang", "a", F.explode(F.expr("slice(ps, i + 2, size(ps))")).alias("b"))
        .groupBy("lang", F.col("a.s").alias("a"), F.col("b.s").alias("b"))
        .agg(F.expr(f"sum({f('a.p', 'b.p')} - {f('a.p', 'b.z')} - {f('a.z', 'b.p')} + {f('a.z', 'b.z')})").alias("more"))
    )
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "more"))
    pairs = known.alias("x").join(known.alias("y"), F.expr("x.lang = y.lang and x.source <> y.source")).select(
        F.col("x.lang").alias("lang"), F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.v").alias("v"),
        F.col("x.terms").alias("xt"), F.col("y.terms").alias("yt"), F.col("x.p0").alias("x0"), F.col("y.p0").alias("y0"), F.col("x.own").alias("xn"),
    )
    # Terms of a source against what they are worth where they are missing: many terms have the same count.
    bars = written(each.groupBy("lang", F.col("source").alias("a"), "n").agg(F.count(F.lit(1)).alias("times")))
    alone = (
        pairs.select("lang", "a", "b", "v", "xn", "y0").join(bars, ["lang", "a"])
        .groupBy("lang", "a", "b").agg(F.expr(f"sum(times * ({f(share('n', 'xn'), 'y0')}))").alias("alone"))
    )
    mirrored = alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("alone").alias("mirrored"))
    key = ["lang", "a", "b"]
    value = F.expr(f"if(v = 0, 0L, (v - xt - yt) * ({f('x0', 'y0')}) + coalesce(alone, 0L) + coalesce(mirrored, 0L) + coalesce(more, 0L))")
    by_pair = (
        pairs.join(alone, key, "left").join(mirrored, key, "left").join(both, key, "left")
        .select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    by_term = (
        each.join(known.select("lang", "source", "own", "v", "total"), ["lang", "source"])
        .withColumns({"p": F.expr(share("n", "own")), "q": F.expr(share("n_lang", "total"))})
        .where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(f("p", "q")).alias("value"))
    )
    # The limit on ranks reaches the tasks before the shuffle, so a group's rows never meet in one of them.
    return by_pair.withColumn("rank", rank).unionByName(by_term.withColumn("rank", rank).where(F.col("rank") <= top))
