"""Chroma fingerprints of recordings, and alignment of recordings by them.

A recording (16-bit mono samples) becomes frames of twelve pitch classes; rectangle filters over the last frames, read
from an integral image, give two bits each, packed to one 32-bit integer a frame.  Recordings are aligned by a histogram
of offsets between equal keys (the high bits of integers some frames apart), and judged by the share of bits that differ
along the best offsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appfacts.llm.tables import map_batches, written

RATE, FRAME, HOP = 2048, 512, 128
LOWEST, HIGHEST = 100.0, 1000.0
#: Frames that a filter sees, and filters of two bits.
SPAN, FILTERS = 16, 16
#: Bounds between the four levels of a filter's value (a log ratio).
LEVELS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Keys: so many high bits of two integers so many frames apart.
KEY_BITS, KEY_APART = 20, 6
#: A pair matches if at most this share of bits differs over at least this share of the shorter recording.
BIT_ERROR, OVERLAP = 0.15, 0.5
#: Offsets tried for each pair: those with the most equal keys.
OFFSETS = 3


def _classes() -> np.ndarray:
    """Which pitch class each frequency of a frame counts for."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hertz), 12))
    good = np.flatnonzero((hertz >= LOWEST) & (hertz <= HIGHEST))
    out[good, np.round(12 * np.log2(hertz[good] / 440.0)).astype(int) % 12] = 1
    return out


def _filters() -> list[tuple[tuple[int, int, int, int], tuple[int, int, int, int]]]:
    """Pairs of rectangles (frames from, to; classes from, to), by a rule: time, pitch and checkered contrasts."""
    made = []
    for i in range(FILTERS):
        low, high = (i * 5) % 12, (i * 5) % 12 + 3 + i % 4
        low, high = (low, high) if high <= 12 else (12 - (high - low), 12)
        mid = (low + high) // 2
        if i % 2:
            half = SPAN // 2 if i % 4 == 1 else SPAN // 4
            made.append(((0, half, low, high), (SPAN - half, SPAN, low, high)))
        else:
            made.append(((0, SPAN, low, mid), (0, SPAN, mid, high)))
    return made


CLASSES, CONTRASTS, HANN = _classes(), _filters(), np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch-class shares of every frame; silent frames are even."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * HANN, axis=1)) ** 2
    bins = power @ CLASSES
    total = bins.sum(axis=1, keepdims=True)
    return np.where(total > 1e-6, bins / np.maximum(total, 1e-6), 1 / 12)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One integer for each frame that has SPAN frames from it on; none for shorter recordings."""
    frames = chroma(samples)
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(r):
        a, b, c, d = r
        return (image[at + b, d] - image[at + a, d] - image[at + b, c] + image[at + a, c]) / ((b - a) * (d - c))

    out = np.zeros(n, np.uint32)
    for i, (left, right) in enumerate(CONTRASTS):
        value = np.log((area(left) + 0.01) / (area(right) + 0.01))
        out |= GRAY[np.searchsorted(LEVELS, value)] << np.uint32(2 * (FILTERS - 1 - i))
    return out


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of differing bits, frames compared) with ``a`` moved by ``offset`` frames against ``b``."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 1.0, 0
    x = a[lo:hi] ^ b[lo - offset : hi - offset]
    return float(np.bitwise_count(x).sum()) / (32 * (hi - lo)), hi - lo


def fingerprints(media: DataFrame, id_: str = "media_id", audio: str = "audio") -> DataFrame:
    """media_id, prints (array of 32-bit integers as bigint) of every row; null or short recordings have none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [
            fingerprint(np.frombuffer(a, "<i2", len(a) // 2)).astype(np.int64) if a else np.zeros(0, np.int64)
            for a in batch.column("audio").to_pylist()
        ]
        return pa.RecordBatch.from_arrays([batch.column("media_id"), pa.array(prints, pa.list_(pa.int64()))], names=["media_id", "prints"])

    return map_batches(media.select(F.col(id_).alias("media_id"), F.col(audio).alias("audio")), run, "media_id bigint, prints array<bigint>")


def _keys(classes: DataFrame, name: str) -> DataFrame:
    high = F.shiftright
    part = lambda i: high(F.element_at("prints", i + 1), 32 - KEY_BITS)
    spots = F.sequence(F.lit(0), F.size("prints") - KEY_APART - 1)
    return (
        classes.where(F.size("prints") > KEY_APART)
        .select(F.col("class_id").alias(name), "prints", F.explode(spots).alias(f"{name}_at"))
        .select(
            name,
            f"{name}_at",
            F.shiftleft(part(F.col(f"{name}_at")), KEY_BITS).bitwiseOR(part(F.col(f"{name}_at") + KEY_APART)).alias("key"),
        )
    )


def _align(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for a, b, offsets in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "offsets")), strict=True):
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        tried = [(*bit_error(x, y, o["offset"]), o["offset"], o["votes"]) for o in offsets]
        tried = [t for t in tried if t[1] >= OVERLAP * min(len(x), len(y))] or [(1.0, 0, 0, 0)]
        rows.append(min(tried, key=lambda t: (t[0], -t[3], t[2])))
    columns = [pa.array([r[i] for r in rows], t) for i, t in ((2, pa.int32()), (3, pa.int64()), (0, pa.float64()))]
    return pa.RecordBatch.from_arrays(
        [batch.column("query"), batch.column("other"), *columns], names=["query", "other", "shift", "votes", "bit_error"]
    )


def align_recordings(media: DataFrame, is_query, id_: str = "media_id", audio: str = "audio") -> DataFrame:
    """Classes of equal recordings, and the matches of the query rows' classes among all classes.

    Rows with ``other_id`` null are members: media_id, class_id (the least media_id with the same fingerprint; itself if
    the fingerprint is empty).  Other rows are matches of two classes: class_id holds a row for which ``is_query`` (a
    column over media_id) is true, other_id is another class, with shift (frames), votes (equal keys at that shift) and
    bit_error.  Rows without an id are left out; repeated rows are one recording.
    """
    prints = written(fingerprints(media, id_, audio).where("media_id is not null").distinct())
    some = prints.where(F.size("prints") > 0)
    classes = written(
        some.groupBy("prints").agg(F.min("media_id").alias("class_id"), F.bool_or(is_query).alias("asked"))
    )
    members = some.join(classes, "prints").select("media_id", "class_id").unionByName(
        prints.where(F.size("prints") == 0).select("media_id", F.col("media_id").alias("class_id"))
    )
    # Equal keys of a query and a recording vote for their offset; votes are summed before pairs are formed.
    votes = (
        _keys(classes.where("asked"), "query")
        .join(_keys(classes, "other"), "key")
        .where("query <> other")
        .groupBy("query", "other", (F.col("query_at") - F.col("other_at")).alias("offset"))
        .agg(F.count(F.lit(1)).alias("votes"))
        .groupBy("query", "other")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("votes", "offset")), asc=False), 1, OFFSETS).alias("offsets"))
    )
    pairs = votes.join(classes.select(F.col("class_id").alias("query"), F.col("prints").alias("a")), "query").join(
        classes.select(F.col("class_id").alias("other"), F.col("prints").alias("b")), "other"
    )
    checked = map_batches(
        pairs.select("query", "other", "a", "b", "offsets"), _align, "query bigint, other bigint, shift int, votes bigint, bit_error double"
    ).where(F.col("bit_error") <= BIT_ERROR)
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("other_id", "bigint"), ("shift", "int"), ("votes", "bigint"), ("bit_error", "double"))]
    return members.select("media_id", "class_id", *empty).unionByName(
        checked.select(
            F.lit(None).cast("bigint").alias("media_id"), F.col("query").alias("class_id"), F.col("other").alias("other_id"),
            "shift", "votes", "bit_error",
        )
    )


NOTE_SECONDS = 0.25


def vector_audio(vector: np.ndarray) -> bytes:
    """A tune of a vector: each four values make a note (two voices by pitch, octave and loudness)."""
    scaled = np.tanh(vector / (np.sqrt(np.mean(vector**2)) or 1.0))
    time = np.arange(int(RATE * NOTE_SECONDS)) / RATE
    out = []
    for at in range(0, len(scaled) - 3, 4):
        a, b, c, d = scaled[at : at + 4]
        first = 220 * 2 ** (min(int((a + 1) * 6), 11) / 12 + (b > 0))
        second = 220 * 2 ** (min(int((c + 1) * 6), 11) / 12)
        out.append(np.sin(2 * np.pi * first * time) * 0.6 + np.sin(2 * np.pi * second * time) * (0.3 + 0.1 * d))
    return (np.concatenate(out) * 20000).astype("<i2").tobytes() if out else b""


def media_of_vectors(embeddings: DataFrame) -> DataFrame:
    """media_id, audio: a recording for every vector, since the given tables hold none.  Null vectors have none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = batch.column("embedding").to_pylist()
        audio = [vector_audio(np.nan_to_num(np.array(v, np.float64))) if v else None for v in vectors]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(audio, pa.binary())], names=["media_id", "audio"])

    return map_batches(embeddings.select("vec_id", "embedding"), run, "media_id bigint, audio binary", 1 << 18)
