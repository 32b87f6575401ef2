"""Toxicity scores: boosted trees over dense features of a text, with isotonic calibration.

Features are densities of lexicon words, their nearness to second-person words, and rates of capitals, punctuation and
obfuscated spellings.  The lexicon is a short list of insults plus words and beginnings of words (stems) that labelled
texts show to be toxic, some only where they come more than once in a text; so vocabularies of any language count, with
endings that differ from word to word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from appfacts.llm.bytehash import ALNUM_WORD, LOWER, mix, stem_hashes, word_hashes
from appfacts.llm.jaccard_trie import gram_sets
from appfacts.llm.tables import bit_filter, map_batches, written

#: Seed lexicon: insults that need no context.
INSULTS = (
    "idiot idiots moron morons stupid dumb fool loser losers pathetic worthless disgusting trash garbage scum clown"
    " imbecile cretin jerk bastard filth vermin"
).split()
#: Second person in the corpus's languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted tú ti".split()

#: Labelled rows that a model is fitted on at most, chosen by a hash of their id.
FIT_ROWS = 30_000
#: Bytes of the beginnings of words that may be learned, besides whole words.
STEMS = (4, 5, 6, 7, 8)
#: Stems learned at most; how sure each has to be (twice the log likelihood ratio against chance), the log of how many
#: times likelier in toxic texts, and in how many toxic texts and what share of them it has to stand.
LEARNED, LEARNED_SURE, LEARNED_ODDS, LEARNED_TEXTS, LEARNED_SHARE = 3_000, 30.0, 1.5, 6, 0.005
#: Least hashes by which near copies among the labelled texts are found: they count as one text, or else what only the
#: copies of one mislabelled text have would be learned.
SKETCH = 4
#: Folds of labelled rows: one is held out, one calibrates, the others fit lexicon and trees.
FOLDS, HELD_OUT, CALIBRATE = 4, 2, 3
#: Rows of each class that a calibration fold of its own needs; else all rows calibrate.
CALIBRATE_ROWS = 30
THRESHOLD = 0.3
#: Words at this distance from a second-person word count 1/e.
NEAR = 5.0

NAMES = [
    "seed_density", "seed_count", "learned_density", "learned_count", "learned_odds", "near_second_person", "second_person",
    "capitals", "digits", "punctuation", "exclamation", "question", "punctuation_runs", "obfuscated", "words", "word_size",
]

#: Common substitutes for letters.
LEET = LOWER.copy()
for _from, _to in zip("01345789@$!|+", "oieastbgasilt", strict=True):
    LEET[ord(_from)] = ord(_to)

UPPER, DIGIT, PUNCT, BANG, ASK, LETTER = range(1, 7)
_CLASS = np.zeros(256, np.int64)
_CLASS[list(range(0x21, 0x30)) + list(range(0x3A, 0x41)) + list(range(0x5B, 0x61)) + list(range(0x7B, 0x7F))] = PUNCT
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:] = DIGIT, UPPER, LETTER, LETTER
_CLASS[ord("!")], _CLASS[ord("?")] = BANG, ASK


def _hashed(words: list[str]) -> np.ndarray:
    return np.sort(word_hashes([" ".join(words)], ALNUM_WORD)[0])


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


class Lexicon:
    """Learned stems: hash, how often it has to come in a text (1 or 2), and the log odds that it speaks for."""

    def __init__(self, entries: list[tuple[int, int, float]]):
        rows = sorted(entries)
        self.stems = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(self.stems, kind="stable")
        self.stems = self.stems[order]
        self.need = np.array([r[1] for r in rows], np.int64)[order]
        self.odds = np.array([r[2] for r in rows], float)[order]

    def hits(self, texts: list[str | None], n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word of the texts (as ``word_hashes`` gives them) is in the lexicon, and the greatest odds in
        each text (0 without any)."""
        taught, odds = np.zeros(n_words, bool), np.zeros(len(texts))
        found, first = [], 0
        if not len(self.stems):
            return taught, odds
        for rows, stems in stem_hashes(texts, ALNUM_WORD, STEMS):
            spot = np.minimum(np.searchsorted(self.stems, stems), len(self.stems) - 1)
            word, kind = np.nonzero(self.stems[spot] == stems)
            found.append((first + word, rows[word], spot[word, kind]))
            first += len(rows)
        if not found:
            return taught, odds
        word, row, entry = (np.concatenate(x) for x in zip(*found, strict=True))
        both = row * len(self.stems) + entry
        _, back, times = np.unique(both, return_inverse=True, return_counts=True)
        enough = times[back] >= self.need[entry]
        taught[word[enough]] = True
        np.maximum.at(odds, row[enough], self.odds[entry[enough]])
        return taught, odds


def text_features(texts: list[str | None], seeds: np.ndarray, learned: Lexicon, second: np.ndarray) -> np.ndarray:
    """A row of features (NAMES) for each text; a null text has the features of an empty one."""
    words, at = word_hashes(texts, ALNUM_WORD)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    count = np.maximum(n, 1)

    def per_text(hit: np.ndarray, weight: np.ndarray | None = None, rows: np.ndarray = row) -> np.ndarray:
        return np.bincount(rows[hit], None if weight is None else weight, minlength=len(n))

    seed, person = _member(words, seeds), _member(words, second)
    taught, odds = learned.hits(texts, len(words))
    out = np.zeros((len(n), len(NAMES)))
    seeds_in, taught_in = per_text(seed), per_text(taught)
    out[:, 0], out[:, 1] = seeds_in / count, np.log1p(seeds_in)
    out[:, 2], out[:, 3] = taught_in / count, np.log1p(taught_in)
    hits = seed | taught
    spots, people = np.flatnonzero(hits), np.flatnonzero(person)
    if len(spots) and len(people):
        i = np.searchsorted(people, spots)
        left, right = people[np.maximum(i - 1, 0)], people[np.minimum(i, len(people) - 1)]
        gap = np.minimum(
            np.where(row[left] == row[spots], np.abs(spots - left), 1 << 30),
            np.where(row[right] == row[spots], np.abs(right - spots), 1 << 30),
        )
        out[:, 5] = per_text(hits, np.exp(-gap / NEAR)) / count
    out[:, 4] = odds
    out[:, 6] = per_text(person) / count
    # Hits only after undoing substitutions, such as "id1ot".
    spelled, spelled_at = word_hashes(texts, ALNUM_WORD, LEET)
    spelled_row = np.repeat(np.arange(len(n)), np.diff(spelled_at))
    whole = learned.stems[learned.need == 1]
    undone = per_text(_member(spelled, seeds) | _member(spelled, whole), rows=spelled_row)
    out[:, 13] = np.maximum(undone - per_text(seed | _member(words, whole)), 0) / count
    out[:, 14] = np.log1p(n)
    for i, text in enumerate(texts):
        if not text:
            continue
        kind = _CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
        c = np.bincount(kind, minlength=7)
        mark = (kind >= PUNCT) & (kind <= ASK)
        out[i, 7] = c[UPPER] / max(c[UPPER] + c[LETTER], 1)
        out[i, 8] = c[DIGIT] / len(kind)
        out[i, 9] = (c[PUNCT] + c[BANG] + c[ASK]) / len(kind)
        out[i, 10], out[i, 11] = c[BANG] / len(kind), c[ASK] / len(kind)
        out[i, 12] = np.count_nonzero(mark[1:] & mark[:-1]) / len(kind)
        out[i, 15] = (c[UPPER] + c[LETTER] + c[DIGIT]) / count[i]
    return out


def with_features(df: DataFrame, learned: list[tuple[int, int, float]], keep: list[str]) -> DataFrame:
    """``keep`` columns of ``df`` and the array ``features`` of its text."""
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    schema = T.StructType([*source.drop("__text").schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])
    words = _hashed(INSULTS), Lexicon(learned), _hashed(SECOND_PERSON)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = text_features(batch.column("__text").to_pylist(), *words)
        offsets = pa.array(np.arange(len(values) + 1) * len(NAMES), pa.int32())
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in keep], pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))],
            names=[*keep, "features"],
        )

    return map_batches(source, run, schema)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0))


class Scorer:
    """Lexicon, trees and calibration; the latter are none where labels don't show both classes."""

    def __init__(self, learned: list[tuple[int, int, float]], trees=None, calibration=None):
        self.learned, self.trees, self.calibration = learned, trees, calibration

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns of ``df``, whatever their names, and ``__score``."""
        names = [f"__keep{i}" for i in range(len(keep))]
        inner = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], "text")
        featured = with_features(inner, self.learned, names)
        if self.trees is None:
            scored = featured.select(*names, F.least(F.lit(1.0), F.col("features")[0] * 20).alias("__score"))
        else:
            margin = self.trees.transform(featured.select(*names, array_to_vector("features").alias("features")))
            raw = margin.select(*names, vector_to_array("probability")[1].alias("__raw"))
            calibrated = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__score")))
            scored = self.calibration.transform(raw).select(*names, calibrated.alias("__score"))
        return scored.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "__score")


def one_of_each(rows: DataFrame) -> DataFrame:
    """One text (``text``, ``toxic``) of each group of near copies and label, from rows of them.

    A text belongs to the least hash of its five-word shingles, among SKETCH hash functions, that most texts have.
    """

    def least(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = gram_sets(batch.column("text").to_pylist(), 5)
        seeds = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64)) for i in range(SKETCH)]
        first = [[int(mix(s ^ x).min().view(np.int64)) if len(s) else 0 for x in seeds] for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column("text"), batch.column("toxic"), pa.array(first, pa.list_(pa.int64()))], names=["text", "toxic", "t"]
        )

    # Exact copies first, so that the text itself names a row.
    texts = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    sketched = written(map_batches(texts, least, "text string, toxic double, t array<bigint>"))
    marked = sketched.select(F.xxhash64("text").alias("h"), "toxic", F.posexplode("t").alias("i", "t"))
    crowd = marked.groupBy("i", "t").agg(F.count(F.lit(1)).alias("n"))
    group = marked.join(crowd, ["i", "t"]).groupBy("h").agg(F.max(F.struct("n", "i", "t")).alias("g"))
    grouped = sketched.withColumn("h", F.xxhash64("text")).join(group, "h")
    return grouped.groupBy("g.i", "g.t", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def learn_stems(rows: DataFrame) -> list[tuple[int, int, float]]:
    """Stems of texts (``text``, ``toxic``) that stand in toxic ones far more often than in others, surest first, each
    once or twice in a text.  At most LEARNED entries of three numbers come to the driver.
    """
    texts = written(one_of_each(rows))
    total = texts.groupBy().agg(
        F.count(F.when(F.col("toxic") == 1, 1)).alias("bad"), F.count(F.when(F.col("toxic") == 0, 1)).alias("good")
    ).first()
    if not total.bad or not total.good:
        return []

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        """In how many toxic and other texts of the batch a stem stands, once at least and twice at least."""
        toxic = np.asarray(batch.column("toxic").to_pylist()) == 1
        seen: dict[int, list[np.ndarray]] = {}
        for row, stems in stem_hashes(batch.column("text").to_pylist(), ALNUM_WORD, STEMS):
            for i in np.unique(row):
                seen.setdefault(int(i), []).append(stems[row == i].reshape(-1))
        parts: list[tuple[np.ndarray, int, bool]] = []
        for i, pieces in seen.items():
            stem, times = np.unique(np.concatenate(pieces), return_counts=True)
            for need in (1, 2):
                parts.append((stem[(times >= need) & (stem != 0)], need, bool(toxic[i])))
        out = []
        for need in (1, 2):
            of = [(p, t) for p, n, t in parts if n == need]
            every = np.concatenate([p for p, _ in of]) if of else np.empty(0, np.uint64)
            bad = np.concatenate([np.full(len(p), t) for p, t in of]) if of else np.empty(0, bool)
            stem, back = np.unique(every, return_inverse=True)
            n_bad, n = np.bincount(back, bad, len(stem)), np.bincount(back, minlength=len(stem))
            out.append((stem, np.full(len(stem), need), n_bad, n - n_bad))
        stem, need, b, g = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(stem.view(np.int64)), pa.array(need, pa.int32()), pa.array(b, pa.float64()), pa.array(g, pa.float64())],
            names=["stem", "need", "b", "g"],
        )

    counts = map_batches(texts, count, "stem bigint, need int, b double, g double")
    counts = counts.groupBy("stem", "need").agg(F.sum("b").alias("b"), F.sum("g").alias("g"))
    b, g, bad, good = F.col("b"), F.col("g"), F.lit(float(total.bad)), F.lit(float(total.good))
    both = bad + good

    def part(n: Column, of: Column, having: Column) -> Column:
        return F.when(n > 0, n * F.log(n * both / (of * having))).otherwise(0.0)

    sure = 2 * (part(b, bad, b + g) + part(g, good, b + g) + part(bad - b, bad, both - b - g) + part(good - g, good, both - b - g))
    odds = F.log((b + 0.5) / (bad - b + 0.5)) - F.log((g + 0.5) / (good - g + 0.5))
    error = F.sqrt(1 / (b + 0.5) + 1 / (g + 0.5) + 1 / (bad - b + 0.5) + 1 / (good - g + 0.5))
    told = (
        counts.where(b >= max(LEARNED_TEXTS, LEARNED_SHARE * total.bad))
        .select("stem", "need", sure.alias("sure"), odds.alias("odds"), (odds - error).alias("weight"))
        .where((F.col("sure") >= LEARNED_SURE) & (F.col("odds") >= LEARNED_ODDS))
    )
    # Of a stem that counts once and one that counts twice, the surer.
    best = told.groupBy("stem").agg(F.max_by(F.struct("need", "weight", "sure"), F.struct("sure", "need")).alias("e"))
    chosen = best.select("stem", "e.*").orderBy(F.desc("sure"), "stem").limit(LEARNED)
    return [(r.stem, r.need, r.weight) for r in chosen.collect()]


def fit(documents: DataFrame, labels: DataFrame) -> Scorer:
    """Fit on at most FIT_ROWS labelled texts that aren't held out.

    Rows of ``labels`` without id or label are ignored; a document with several labels is toxic if one says so.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.where(fold(F.col("doc_id")) != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    chosen = written(chosen.withColumn("fold", fold(F.col("doc_id"))))
    texts = bit_filter(documents.select("doc_id", "text"), chosen, ["doc_id"])
    rows = written(texts.join(F.broadcast(chosen), "doc_id").select("text", "fold", F.col("toxic").cast("double").alias("toxic")))
    learned = learn_stems(rows.where(F.col("fold") != CALIBRATE))
    table = written(with_features(rows, learned, ["toxic", "fold"]))
    table = table.select("toxic", "fold", array_to_vector("features").alias("features"))
    fitting, calibrating = table.where(F.col("fold") != CALIBRATE), table.where(F.col("fold") == CALIBRATE)
    counts = {(r.f, r.toxic): r["count"] for r in table.groupBy((F.col("fold") == CALIBRATE).alias("f"), "toxic").count().collect()}
    if not {(False, 0.0), (False, 1.0)} <= counts.keys():
        return Scorer(learned)
    trees = GBTClassifier(
        labelCol="toxic", featuresCol="features", maxDepth=3, maxIter=15, stepSize=0.3, maxBins=32, seed=7, minInstancesPerNode=3
    ).fit(fitting)
    if min(counts.get((True, 0.0), 0), counts.get((True, 1.0), 0)) < CALIBRATE_ROWS:
        calibrating = table  # too few for a fold of their own
    scored = trees.transform(calibrating).select("toxic", vector_to_array("probability")[1].alias("__raw"))
    calibration = IsotonicRegression(featuresCol="__raw", labelCol="toxic", predictionCol="__score").fit(scored)
    return Scorer(learned, trees, calibration)


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``; null texts are empty texts.

    Without labels of both classes the score is twenty times the share of seed insults, at most 1.
    """
    return fit(documents, labels).score(documents, ["doc_id"]).select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``documents``, all columns, whose score is below the threshold."""
    columns = documents.columns
    return fit(documents, labels).score(documents, columns).where(F.col("__score") < THRESHOLD).select(*[F.col(f"`{c}`") for c in columns])
