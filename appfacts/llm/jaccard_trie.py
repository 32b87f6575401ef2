"""Similarity join of n-gram sets through a prefix tree.

Two sets are linked when ``100 * intersection >= percent * union``.  Sets are stored in one global order of grams (rare
ones first) in a trie; a set walks the trie with the overlap counted so far, so stored sets with a common beginning share
that work, and a subtree is left as soon as even all that remains could not reach the overlap that its smallest set asks
for.

How the work is cut into tasks, without losing a link:

1. Equal sets become one.
2. A set's first grams by hash (its prefix) must share a known number of grams with the prefix of any partner.  Sets that
   share fewer with all others together have no partner and are done.
3. For the others all grams are counted; a gram of one set only can't be shared.  In the order by count and hash, linked
   sets have a common gram in their first ``n - ceil(p n) + 1``.  Sets that have any such gram in common form a cluster.
4. Clusters are sorted by set size and cut into blocks of a bounded number of grams.  Each pair of blocks whose sizes
   allow a link is a task of its own, so a cluster of any size is handled by many tasks.  A task skips what it has
   already connected, and returns a forest of links, not all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from appfacts.llm.bytehash import SPACE_WORD, mix, second, shingle_hashes, word_hashes
from appfacts.llm.graph import components
from appfacts.llm.tables import bit_filter, map_batches, workers_import, written

WORDS, PERCENT = 5, 80
#: Grams of one block of a cluster.
BLOCK_GRAMS = 300_000


def gram_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each text; a text of fewer than ``k`` words has its whole sequence as one gram."""
    words, at = word_hashes(texts, SPACE_WORD)
    out = []
    for i in range(len(texts)):
        own = words[at[i] : at[i + 1]]
        out.append(np.unique(shingle_hashes(own, min(k, len(own)))) if len(own) else own)
    return out


def _needed(n: np.ndarray | int, percent: int):
    """Least overlap of a set of ``n`` grams with any partner."""
    return -(-n * percent // 100)


def _identity(grams: np.ndarray) -> int:
    """64 bits that stand for a set together with its size."""
    return int((mix(grams).sum(dtype=np.uint64) ^ second(grams).sum(dtype=np.uint64)).astype(np.uint64).view(np.int64))


#: A prefix has one gram more for so many grams of the set, which partners then must share too.
_SPREAD = 12


def _spread(n: int) -> int:
    return n // _SPREAD


def _members(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    sets = gram_sets(batch.column("text").to_pylist(), k)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            batch.column("key"),
            pa.array([_identity(s) if len(s) else 0 for s in sets], pa.int64()),
            pa.array([len(s) for s in sets], pa.int64()),
        ],
        names=["doc_id", "key", "set_id", "n"],
    )


def _prefixes(batch: pa.RecordBatch, k: int, percent: int) -> pa.RecordBatch:
    """A row for each prefix gram of each different set of the batch."""
    seen: dict[tuple[int, int], np.ndarray] = {}
    for grams in gram_sets(batch.column("text").to_pylist(), k):
        n = len(grams)
        if n and (at := (_identity(grams), n)) not in seen:
            seen[at] = grams[: n - _needed(n, percent) + 1 + _spread(n)]
    lengths = [len(p) for p in seen.values()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([np.zeros(0, np.int64), *[p.view(np.int64) for p in seen.values()]])),
            pa.array(np.repeat(np.array([i for i, _ in seen], np.int64), lengths)),
            pa.array(np.repeat(np.array([n for _, n in seen], np.int64), lengths)),
        ],
        names=["gram", "set_id", "n"],
    )


def _all_grams(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    sets = gram_sets(batch.column("text").to_pylist(), k)
    n = [len(s) for s in sets]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([np.zeros(0, np.int64), *[s.view(np.int64) for s in sets]])),
            pa.array(np.repeat(np.array(batch.column("set_id").to_numpy(), np.int64), n)),
            pa.array(np.repeat(np.array(n, np.int64), n)),
        ],
        names=["gram", "set_id", "n"],
    )


class Node:
    """A run of grams, what follows it, and the sets that end with it."""

    __slots__ = ("children", "label", "least", "rest", "sets")

    def __init__(self, label: np.ndarray, least: int, rest: int):
        self.label, self.least, self.rest = label, least, rest
        self.children: dict[int, Node] = {}
        self.sets: list[int] = []


class Trie:
    """Ordered sets by common beginnings.  ``least`` is the size of a subtree's smallest set, ``rest`` the most grams
    that lie below a node's own label."""

    def __init__(self):
        self.root = Node(np.zeros(0, np.int64), 1 << 60, 0)

    def add(self, grams: np.ndarray, size: int, item: int) -> None:
        node, at = self.root, 0
        while True:
            node.least, node.rest = min(node.least, size), max(node.rest, len(grams) - at)
            if at == len(grams):
                node.sets.append(item)
                return
            child = node.children.get(int(grams[at]))
            if child is None:
                child = node.children[int(grams[at])] = Node(grams[at:], size, 0)
                child.sets.append(item)
                return
            n = min(len(child.label), len(grams) - at)
            differ = np.flatnonzero(child.label[:n] != grams[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(child.label):
                upper = Node(child.label[:same], child.least, child.rest + len(child.label) - same)
                node.children[int(grams[at])] = upper
                upper.children[int(child.label[same])] = child
                child.label = child.label[same:]
                child = upper
            node, at = child, at + same

    def partners(self, grams: np.ndarray, size: int, percent: int, known) -> Iterator[int]:
        """Stored sets linked with this one; those for which ``known`` holds are left out before their tails are read."""
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, at = stack.pop()
            if not node.children and all(known(i) for i in node.sets):
                continue
            if len(node.label):
                # Both are ordered: what the label shares, and how far it takes us in the walking set.
                spots = np.searchsorted(grams, node.label)
                spots_in = np.minimum(spots, len(grams) - 1)
                overlap += int(np.count_nonzero(grams[spots_in] == node.label))
                at = int(np.searchsorted(grams, node.label[-1], "right"))
            if overlap + min(node.rest, len(grams) - at) < -(-percent * (size + node.least) // (100 + percent)):
                continue
            for item, n in node.sets:
                if (100 + percent) * overlap >= percent * (size + n):
                    yield item
            stack += [(child, overlap, at) for child in node.children.values()]


def link_block(sets: list[tuple[int, int, bool, np.ndarray]], percent: int, within: bool) -> list[tuple[int, int]]:
    """A forest of links among (id, size, right-hand, ordered grams); only between the two hands unless ``within``."""
    parent = {s[0]: s[0] for s in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    trie, links = Trie(), []
    for item, size, _, grams in sorted((s for s in sets if within or not s[2]), key=lambda s: (s[1], s[0])):
        if within:
            _join(trie, item, size, grams, percent, find, parent, links)
        trie.add(grams, size, (item, size))
    if not within:
        for item, size, right, grams in sets:
            if right:
                _join(trie, item, size, grams, percent, find, parent, links)
    return links


def _join(trie, item, size, grams, percent, find, parent, links) -> None:
    for other in trie.partners(grams, size, percent, lambda i: find(i[0]) == find(item)):
        if find(other) != find(item):
            links.append((min(item, other), max(item, other)))
            parent[find(other)] = find(item)


ROWS = "gram bigint, set_id bigint, n bigint"


def _possible(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """set_id, n of the sets that share enough prefix grams with others to have a partner."""
    prefixes = map_batches(texts, lambda b: _prefixes(b, k, percent), ROWS)
    # All rows of a gram meet once: equal sets of several batches fall together, then the others are counted.
    by_gram = prefixes.repartition("gram").dropDuplicates(["gram", "set_id", "n"])
    shared = by_gram.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("gram"))).where("sets > 1")
    least = F.ceil(F.col("n") * F.lit(percent) / F.lit(100))
    counts = shared.groupBy("set_id", "n").agg(F.count(F.lit(1)).alias("shared"))
    return counts.where(F.col("shared") >= 1 + F.floor(least / _SPREAD)).select("set_id", "n")


def _ordered_sets(chosen: DataFrame, k: int, percent: int) -> DataFrame:
    """set_id, n, prefix (how many of the grams are prefix), grams: the shared grams of each set that may have a partner,
    as ordered 64-bit values (count, then hash)."""
    grams = map_batches(chosen, lambda b: _all_grams(b, k), ROWS)
    counted = grams.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("gram"))).where("sets > 1")
    # 16 bits of count and 47 of the hash, which two sets would have to share by chance.
    value = F.shiftleft(F.least("sets", F.lit(65535)), 47).bitwiseOR(F.expr("shiftrightunsigned(gram, 17)"))
    sets = counted.groupBy("set_id", "n").agg(F.sort_array(F.collect_list(value)).alias("grams"))
    # Grams of one set only come first in the order and can't be shared, so they only use up the prefix.
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100)) + 1 - (F.col("n") - F.size("grams"))
    return sets.withColumn("prefix", prefix.cast("int")).where("prefix > 0").select("set_id", "n", "prefix", "grams")


def _links(sets: DataFrame, percent: int, block_grams: int) -> DataFrame:
    """a, b: links between set ids that connect what is connected."""
    firsts = sets.select("set_id", F.explode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("gram"))
    hub = firsts.groupBy("gram").agg(F.min("set_id").alias("hub"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    stars = firsts.join(hub, "gram").select(F.col("set_id").alias("a"), F.col("hub").alias("b"))
    clusters = components(stars).select(F.col("node").alias("set_id"), F.col("component").alias("cluster"))
    sized = sets.select("set_id", "n", F.size("grams").alias("size")).join(clusters, "set_id")
    order = Window.partitionBy("cluster").orderBy("n", "set_id")
    placed = written(
        sized.select("set_id", "cluster", "n", F.floor(F.sum("size").over(order) / block_grams).cast("int").alias("block"))
    )
    blocks = placed.groupBy("cluster", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    # b's sizes start not above what a's largest can link with; bounded by the blocks of that size span.
    left, right = blocks.alias("l"), blocks.alias("r")
    tasks = left.join(
        right,
        (F.col("l.cluster") == F.col("r.cluster"))
        & (F.col("l.block") <= F.col("r.block"))
        & (F.col("r.lo") * percent <= F.col("l.hi") * 100),
    ).select(F.col("l.cluster").alias("cluster"), F.col("l.block").alias("low"), F.col("r.block").alias("high"))
    sides = tasks.select("cluster", "low", "high", F.col("low").alias("block"), F.lit(False).alias("right")).unionByName(
        tasks.where("low <> high").select("cluster", "low", "high", F.col("high").alias("block"), F.lit(True).alias("right"))
    )
    dealt = sides.join(placed, ["cluster", "block"]).join(sets.select("set_id", "grams"), "set_id")
    workers_import(sets.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        within = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        columns = (table.column(c).to_pylist() for c in ("set_id", "n", "right"))
        grams = [g.values.to_numpy() for g in table.column("grams").combine_chunks()]
        links = link_block([(*x, g) for x, g in zip(zip(*columns, strict=True), grams, strict=True)], percent, within)
        return pa.table({c: pa.array([x[i] for x in links], pa.int64()) for i, c in enumerate("ab")})

    return dealt.select("cluster", "low", "high", "set_id", "n", "right", "grams").groupBy("cluster", "low", "high").applyInArrow(run, "a bigint, b bigint")


def jaccard_components(documents: DataFrame, k: int = WORDS, percent: int = PERCENT, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """doc_id, n_shingles, component_id for each different (doc_id, text).

    Sets are the distinct runs of ``k`` words (lower-cased A-Z, words end at ASCII white space), or the whole text as one
    with fewer words.  Null texts and those without words have an empty set and are linked with nothing.  component_id is
    the least doc_id reachable through links, nulls aside; only texts without any id in reach have null.
    """
    texts = documents.select("doc_id", F.hash("text").alias("key"), "text")
    members = written(
        map_batches(texts, lambda b: _members(b, k), "doc_id bigint, key int, set_id bigint, n bigint").distinct()
    )
    # One text for each set that may have partners.
    chosen = written(
        members.join(_possible(texts, k, percent), ["set_id", "n"])
        .groupBy("set_id", "n")
        .agg(F.min(F.struct("doc_id", "key")).alias("m"))
        .select("set_id", "m.doc_id", "m.key")
    )
    same = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.key") == F.col("c.key"))
    near = bit_filter(texts, chosen, ["doc_id", "key"])
    wanted = near.alias("t").join(chosen.alias("c"), same).select("c.set_id", "t.text").dropDuplicates(["set_id"])
    sets = written(_ordered_sets(wanted, k, percent))
    groups = components(written(_links(sets, percent, block_grams)))
    # A set's component is named by a set; the least document of all its sets names it for the documents.
    named = members.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    whole = (
        groups.join(named, F.col("node") == F.col("set_id"))
        .groupBy("component")
        .agg(F.min("first").alias("least"))
        .join(groups, "component")
        .select(F.col("node").alias("set_id"), "least")
    )
    by_set = named.join(whole, "set_id", "left").select("set_id", F.coalesce("least", "first").alias("component_id"))
    linked = members.where("n > 0").join(by_set, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def first_of_groups(documents: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``documents`` with one row of each linked group: that of the least doc_id (all its rows, if it has several)."""
    kept = jaccard_components(documents, k, percent).where(
        F.col("doc_id").eqNullSafe(F.col("component_id"))
    ).select("doc_id").distinct().withColumnRenamed("doc_id", "__kept")
    return documents.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")
