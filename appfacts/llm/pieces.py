"""Piece encoding with byte offsets.

A text is normalised by longest-prefix replacement through the model's compiled character map (a double-array trie),
keeping for each normalised byte the byte of the text that it came from; the normalised text is cut into pieces, and
each piece is projected back to the span of original bytes it stands for.  Pieces never cross the places where ``cutter``
cuts (no piece of the vocabulary does), so the parts of a text are encoded once each and kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from appfacts.llm.tables import map_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts of texts kept by each Python worker.
CACHE_PARTS = 150_000


class CharMap:
    """The compiled character map of a model: the longest key that the text has at a place, and its replacement.

    The blob is a little-endian length, so many bytes of double-array units (32 bits: label or value in the low bits, a
    leaf flag at bit 8, an offset from bit 10 on, scaled by 256 if bit 9 is set), and zero-ended replacements.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """(number of bytes matched, replacement); 0 bytes if no key is found."""
        units, found, value = self.units, 0, 0
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if (unit & 0x800000FF) != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found, value = i + 1 - at, units[node] & 0x7FFFFFFF
        return found, self.strings[value : self.strings.index(b"\0", value)] if found else b""


@dataclass
class Normalized:
    text: str
    #: For each byte of the normalised text, and one past the last, the byte of the text where its source begins.
    source: np.ndarray


class Codec:
    """A piece model: normalisation with alignment, encoding, decoding."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.dummy_prefix = spec.add_dummy_prefix
        self.one_space = spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.unknown_surface = proto.trainer_spec.unk_surface.encode()
        self.kinds = [p.type for p in proto.pieces]
        self.pieces = [p.piece for p in proto.pieces]
        if any(k == USER for k in self.kinds) or self.suffix:
            raise ValueError("models with user-defined symbols or suffix spaces are not supported")
        # The merges of the model alone: normalisation is done here, so the model's own is switched off.
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        spec.escape_whitespaces, spec.name = False, "identity"
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.bytes_of = [
            bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode()
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]
        self.surface = [
            self.unknown_surface if k == UNKNOWN else b if k == BYTE else b.replace(SPACE.encode(), b" ")
            for b, k in zip(self.bytes_of, self.kinds, strict=True)
        ]
        self.is_byte = [k == BYTE for k in self.kinds]
        self.fallback = any(self.is_byte)
        self.cutter = self._cutter()
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.names = [str(i) for i in range(len(self.pieces))]
        self.byte_ids = np.array(self.is_byte, bool)
        self.unknown_ids = np.array([k == UNKNOWN for k in self.kinds], bool)
        self.cache: dict[str, bytes] = {}

    def _cutter(self) -> re.Pattern | None:
        """Cuts a normalised text where no piece reaches across; None if no such place is known."""
        normal = [p for p, k in zip(self.pieces, self.kinds, strict=True) if k == NORMAL]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal) or not self.fallback:
            return None
        joined = {c for p in normal if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        return re.compile(f"[{alone}]|{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+") if alone else re.compile(
            f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        )

    def normalize(self, text: str) -> Normalized:
        """Replace the longest map keys, then handle spaces as the model says; unmapped characters stay."""
        data = text.encode("utf-8", "surrogatepass")
        if self.map is None and not self.one_space:
            return self._spaced(text, data)
        return self._stepwise(data)

    def _spaced(self, text: str, data: bytes) -> Normalized:
        """Only spaces change: each byte's source is the lead byte of its character."""
        if not data:
            return Normalized("", np.zeros(1, np.int64))
        space = SPACE if self.escape else " "
        values = np.frombuffer(data, np.uint8)
        source = np.arange(len(data) + 1)
        source[:-1][(values & 0xC0) == 0x80] = 0
        source = np.maximum.accumulate(source)
        times = np.ones(len(source), np.int64)
        times[:-1][values == 0x20] = len(space.encode())
        if self.dummy_prefix:
            times[0] += len(space.encode())
        prefix = space if self.dummy_prefix else ""
        return Normalized(prefix + (text.replace(" ", space) if self.escape else text), np.repeat(source, times))

    def _stepwise(self, data: bytes) -> Normalized:
        """Any map and any rule for spaces, one replacement at a time."""
        out: list[bytes] = []
        source: list[int] = []
        at = 0
        # (replacement, first byte) of every step
        steps: list[tuple[bytes, int]] = []
        while at < len(data):
            size, new = self.map.longest(data, at) if self.map else (0, b"")
            if not size:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at : at + size]
            steps.append((new, at))
            at += size
        space = SPACE.encode() if self.escape else b" "
        if self.one_space:
            while steps and steps[0][0] == b" ":
                steps.pop(0)
            first = steps[0][1] if steps else 0
        else:
            first = 0
        if self.dummy_prefix and steps:
            out.append(space)
            source += [first] * len(space)
        last_space = self.one_space
        for new, begin in steps:
            if last_space:
                new = new.lstrip(b" ")
            if new:
                for byte in new:
                    put = space if byte == 0x20 else bytes([byte])
                    out.append(put)
                    source += [begin] * len(put)
                last_space = self.one_space and new.endswith(b" ")
        end = len(data)
        if self.one_space:
            joined = b"".join(out)
            while joined.endswith(space) and len(joined) > 0:
                joined = joined[: -len(space)]
                end = source[len(joined)]
                source = source[: len(joined)]
            out = [joined]
        return Normalized(b"".join(out).decode("utf-8", "surrogatepass"), np.asarray([*source, end], np.int64))

    def _learn(self, parts: list[str]) -> None:
        """Encode parts that are new to the cache: their ids as 32-bit integers."""
        if len(self.cache) + len(parts) > CACHE_PARTS:
            self.cache.clear()
        for part in parts:  # a list in one call would start a thread for each call
            self.cache[part] = np.array(self.merges.encode(part), np.int32).tobytes()

    def ids(self, normal: str) -> np.ndarray:
        """Ids of a normalised text: those of its parts in order."""
        if not normal:
            return np.zeros(0, np.int32)
        keys = self.cutter.findall(normal) if self.cutter else [normal]
        out = [self.cache.get(k) for k in keys]
        if None in out:
            new = list(dict.fromkeys(k for k, o in zip(keys, out, strict=True) if o is None))
            if len(self.cache) + len(new) > CACHE_PARTS:
                new = list(dict.fromkeys(keys))
            self._learn(new)
            out = [self.cache[k] for k in keys]
        return np.frombuffer(b"".join(out), np.int32)

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """ids, and for each the first byte of the text it stands for and the byte behind the last."""
        ids, begins, behind = self.spans(text)
        return ids.tolist(), begins.tolist(), behind.tolist()

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``encode`` as arrays.  Pieces that don't spell the normalised text, or spans that leave a gap, are an error."""
        normal = self.normalize(text)
        ids = self.ids(normal.text)
        size = self.sizes[ids]
        if self.unknown_ids[ids].any():
            size = self._unknown_sizes(ids.tolist(), normal.text.encode("utf-8", "surrogatepass"))
        elif b"".join([self.bytes_of[i] for i in ids.tolist()]) != normal.text.encode("utf-8", "surrogatepass"):
            raise ValueError("pieces do not spell the text")
        ends = np.cumsum(size)
        if (int(ends[-1]) if len(ends) else 0) != len(normal.source) - 1:
            raise ValueError("pieces do not cover the text")
        # A piece that ends inside what one source makes gets that whole source.
        begins = normal.source[ends - size] if len(ends) else ends
        behind = normal.source[ends] if len(ends) else ends
        inside = behind <= begins
        if inside.any():
            later = np.searchsorted(normal.source, begins[inside], "right")
            behind[inside] = normal.source[np.minimum(later, len(normal.source) - 1)]
        if self.dummy_prefix and len(ids) and self.bytes_of[ids[0]] == SPACE.encode():
            behind[0] = begins[0]  # stands for nothing in the text
        # Each span begins where the one before ended, or inside what that one stands for.
        if (begins > behind).any() or (begins[1:] > behind[:-1]).any() or (len(ids) and behind[-1] != normal.source[-1]):
            raise ValueError("spans do not cover the text")
        return ids, begins, behind

    def _unknown_sizes(self, ids: list[int], data: bytes) -> np.ndarray:
        """Unknown pieces take what lies between their neighbours (they occur only without byte pieces)."""
        at, sizes = 0, []
        for n, i in enumerate(ids):
            if self.kinds[i] != UNKNOWN:
                end = at + len(self.bytes_of[i])
            elif n + 1 == len(ids):
                end = len(data)
            else:
                end = data.index(self.bytes_of[ids[n + 1]], at + 1)
            sizes.append(end - at)
            at = end
        return np.asarray(sizes, np.int64)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: runs of byte pieces as UTF-8, each byte that doesn't fit as U+FFFD."""
        return self.decoded(np.asarray(ids, np.int32)).decode("utf-8", "surrogatepass")

    def decoded(self, ids: np.ndarray) -> bytes:
        """``decode`` as bytes."""
        if not len(ids):
            return b""
        surfaces = [self.surface[i] for i in ids.tolist()]
        is_byte = self.byte_ids[ids]
        if self.dummy_prefix and not is_byte[0] and surfaces[0].startswith(b" "):
            surfaces[0] = surfaces[0][1:]
        edges = [0, *(np.flatnonzero(is_byte[1:] != is_byte[:-1]) + 1).tolist(), len(ids)]
        runs = [(b"".join(surfaces[a:b]), is_byte[a]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return b"".join([_valid(run) if broken else run for run, broken in runs])


def _valid(data: bytes) -> bytes:
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        pass
    at, out = 0, []
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                data[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            if at + size <= len(data):
                out.append(data[at : at + size])
                at += size
                break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


_CODECS: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """The model file's codec, loaded once by each Python worker."""
    if model not in _CODECS:
        with open(model, "rb") as f:
            _CODECS[model] = Codec(f.read())
    return _CODECS[model]


def encode_documents(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, begins, ends (spans in UTF-8 bytes of the text) and the decoded text of every row.

    Null texts are empty: no ids.  Every row gives a row, repeated ones too.  ``model`` is a file that every executor
    has, part of the installed tokenizer package.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model)
        rows = [c.encode(t or "") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *[pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in range(3)],
                pa.array([c.decode(r[0]) for r in rows], pa.string()),
            ],
            names=["doc_id", "ids", "begins", "ends", "decoded"],
        )

    return map_batches(
        documents.select("doc_id", "text"), run, "doc_id bigint, ids array<int>, begins array<int>, ends array<int>, decoded string"
    )


def digest_documents(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids and decoded text of every row, encoded as in ``encode_documents``.

    Ids, spans and decoded text of a row are all made and checked, but only digests leave the task.
    """

    def digests(c: Codec, text: str) -> tuple[int, str, str]:
        ids, _, _ = c.spans(text)
        joined = ",".join([c.names[i] for i in ids.tolist()])
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(c.decoded(ids)).hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model)
        rows = [digests(c, t or "") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.string()) for i in (1, 2)]],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_batches(
        documents.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
