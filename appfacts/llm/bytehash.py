"""Vectorised hashing of words and byte strings, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

np.seterr(over="ignore")

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.int64).view(np.uint64)


#: A random odd-sized value per byte: polynomial hashes of raw bytes would be weak in their low bits.
BYTE_VALUES = _table(20240229)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer, so that order and low bits of the result look random."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def second(x: np.ndarray) -> np.ndarray:
    """Another hash of the same 64 bits."""
    return mix(x * _BASE2 + np.uint64(0x165667B19E3779F9))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: everything but ASCII controls, space, punctuation.  Letters are lower-cased before.
ALNUM_WORD = np.ones(256, bool)
for _a, _b in ((0x00, 0x30), (0x3A, 0x61), (0x7B, 0x80)):
    ALNUM_WORD[_a:_b] = False

#: Bytes of words that end only at ASCII white space.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _pieces(data: bytes, word: np.ndarray) -> Iterator[bytes]:
    """The text in pieces of about SLICE_BYTES, cut only where no word is cut."""
    at = 0
    while len(data) - at > SLICE_BYTES:
        end = at + SLICE_BYTES
        gaps = np.flatnonzero(~word[np.frombuffer(data, np.uint8, end - at, at)])
        while not len(gaps) and end < len(data):
            was, end = end, min(len(data), end + SLICE_BYTES)
            gaps = np.flatnonzero(~word[np.frombuffer(data, np.uint8, end - was, was)]) + (was - at)
        cut = at + int(gaps[-1]) + 1 if len(gaps) else len(data)
        yield data[at:cut]
        at = cut
    yield data[at:]


def _hash_words(buf: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word in ``buf``."""
    is_word = word[buf]
    edge = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    values = BYTE_VALUES[buf]
    values[~is_word] = 0
    before = np.repeat(starts, np.diff(starts, append=len(buf)))
    within = np.arange(len(buf)) - np.concatenate((np.zeros(starts[0], np.int64), before))
    longest = int((ends - starts).max())
    table = powers(_BASE, longest + 1)
    values *= table[np.minimum(within, longest)]
    return starts, mix(np.add.reduceat(values, starts))


def buffers(
    texts: Sequence[str | None], word: np.ndarray, fold: np.ndarray = LOWER
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Folded bytes of the texts in pieces of about SLICE_BYTES, where each text begins in a piece, and which it is.

    Memory is bounded by SLICE_BYTES, so one very long text is no special case.  Words are never cut.
    """
    pending: list[bytes] = []
    owners: list[int] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        buf = fold[np.frombuffer(b" ".join(pending) + b" ", np.uint8)]
        return buf, np.concatenate(([0], np.cumsum([len(p) + 1 for p in pending])[:-1])), np.asarray(owners)

    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        for part in _pieces(data, word) if len(data) > SLICE_BYTES else (data,):
            pending.append(part)  # pieces are cut by the unfolded bytes; folding never joins what a cut parts
            owners.append(i)
            size += len(part)
            if size >= SLICE_BYTES:
                yield joined()
                pending, owners, size = [], [], 0
    if pending:
        yield joined()


def word_hashes(
    texts: Sequence[str | None], word: np.ndarray, fold: np.ndarray = LOWER
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words begin (one more entry).

    ``fold`` maps bytes (here to lower case) before ``word`` tells which belong to words.
    """
    counts = np.zeros(len(texts) + 1, np.int64)
    out: list[np.ndarray] = []
    for buf, begins, owners in buffers(texts, word, fold):
        starts, hashes = _hash_words(buf, word)
        np.add.at(counts, owners[np.searchsorted(begins, starts, "right") - 1] + 1, 1)
        out.append(hashes)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.cumsum(counts)


def stem_hashes(
    texts: Sequence[str | None], word: np.ndarray, sizes: Sequence[int]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In pieces: the text of every word in order, and a row of hashes for it: the word's, then its first bytes' in each
    of ``sizes`` (rising).  A word shorter than a size has 0 there."""
    for buf, begins, owners in buffers(texts, word):
        starts, whole = _hash_words(buf, word)
        out = np.zeros((len(starts), len(sizes) + 1), np.uint64)
        out[:, 0] = whole
        total, alive = np.zeros(len(starts), np.uint64), np.ones(len(starts), bool)
        for i in range(max(sizes, default=0)):
            at = np.minimum(starts + i, len(buf) - 1)
            alive &= word[buf[at]] & (starts + i < len(buf))
            total = (total + np.uint64(i + 1)) * _BASE + BYTE_VALUES[buf[at]]
            if i + 1 in sizes:
                out[:, 1 + sizes.index(i + 1)] = np.where(alive, mix(total), np.uint64(0))
        yield owners[np.searchsorted(begins, starts, "right") - 1], out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes of one text; shorter texts give none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out = out * _BASE + words[i : n + i]
    return mix(out)


def string_hashes(data: np.ndarray, length: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of every byte string of ``length`` bytes in ``data``."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up = powers(base, len(data))
    down = powers(np.uint64(pow(int(base), -1, 1 << 64)), n)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up, out=total[1:])
    return mix((total[length:] - total[:n]) * down)
