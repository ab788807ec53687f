"""SentencePiece encoding and decoding that keeps every piece's place in the original bytes.

The text is normalised by the model's own compiled character map: at each place the longest prefix
that the map knows is replaced, else one character is copied, and the normalised bytes' origins are
recorded.  The pieces tile the normalised bytes, so each projects to a span of the original bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoflow.llm.common import batch_texts, id_and_text, slices

#: Fixed value: the character that stands for a space in pieces.
SPACE = "▁"
CHUNKS_KEPT = 150_000


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes, then replacements that end with a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest key of the map that data has at this place: its length and what replaces it."""
        if not self.units:
            return None
        found, node = None, 0
        offset = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        node ^= offset(self.units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1] : end]


@dataclass
class Rules:
    map: CharacterMap
    add_prefix: bool
    squeeze: bool
    escape: bool


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def read_rules(model: bytes) -> Rules:
    """The normaliser's part of a model file: field 3, with the map at 2, the prefix at 3, squeezing at 4, escaping at 5."""
    spec = {number: value for k, part in _fields(model) if k == 3 for number, value in _fields(part)}
    return Rules(CharacterMap(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))


def normalise(text: str, rules: Rules) -> tuple[bytes, np.ndarray]:
    """The normalised bytes, and for each border between them (one more than bytes) the original byte offset."""
    data = text.encode()
    space = SPACE.encode() if rules.escape else b" "
    if not rules.map.units and not rules.squeeze:
        if not data:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        width = np.where(raw == 32, len(space), 1)
        origin = np.repeat(np.arange(len(raw)), width)
        out = data.replace(b" ", space)
        if rules.add_prefix:
            out, origin = space + out, np.concatenate((np.zeros(len(space), np.int64), origin))
        return out, np.append(origin, len(data))
    out, origin = bytearray(), []
    at, start = 0, len(data)
    steps: list[tuple[bytes, int, int]] = []
    while at < len(data):
        hit = rules.map.longest(data, at)
        if hit is None:
            size = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
            hit = size, data[at : at + size]
        steps.append((hit[1], at, at + hit[0]))
        at += hit[0]
    if rules.squeeze:
        while steps and steps[0][0] == b" ":
            steps.pop(0)
    if not steps:
        return b"", np.zeros(1, np.int64) + (start if data else 0)
    if rules.add_prefix:
        out += space
        origin += [steps[0][1]] * len(space)
    blank, last = rules.squeeze, 0
    for new, begin, end in steps:
        if rules.squeeze and blank:
            new = new.lstrip(b" ")
        if not new:
            continue
        last = end
        put = new.replace(b" ", space)
        out += put
        origin += [begin] * len(put)
        blank = rules.squeeze and new.endswith(b" ")
    if rules.squeeze:
        while out.endswith(space):
            last = origin[-len(space)]
            del out[-len(space) :], origin[-len(space) :]
    return bytes(out), np.array([*origin, last], np.int64)


#: Fixed value: the end of a model file that takes the normaliser's part out of it (no map, no prefix, no squeezing, no escaping).
PLAIN = b"\x1a\x08\x12\x00\x18\x00\x20\x00\x28\x00"


class PieceCodec:
    """Normalises texts itself, cuts what that gives into the library's pieces, and projects these to byte spans.

    The library gets the model without its normaliser, so its pieces tile the bytes whose origins are known.
    Where no piece has the space mark after another character, no merge crosses from a word to the next
    space; then a text's ids are those of its words, each with the marks before it, and those of recent
    words are kept, up to a bound.  With any other model texts go whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            blob = f.read()
        self.rules = read_rules(blob)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=blob + PLAIN)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        self.by_word = not any(inner.search(p) for p in names) and not any(self.library.is_unused(i) for i in range(n))
        self.by_word &= self.library.piece_to_id(SPACE) != self.library.unk_id()
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.width = np.array([1 if self.library.is_byte(i) else 0 if self.library.is_control(i) or self.library.is_unknown(i) else len(p.encode()) for i, p in enumerate(names)], np.int64)
        self.decimal = list(map(str, range(n)))
        self.known: dict[str, tuple[bytes, str]] = {}

    def _learn(self, new: list[str]) -> None:
        decimal = self.decimal
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            for word, ids in zip(part, self.cutter.encode(part, num_threads=1), strict=True):
                self.known[word] = array("i", ids).tobytes(), ",".join([decimal[i] for i in ids])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str, np.ndarray]]:
        """The ids of each whole text, as an array and as decimal text, and the origins of its normalised bytes."""
        normal = [normalise(t, self.rules) for t in texts]
        plain = [n.decode() for n, _ in normal]
        words = [self.word.findall(p) if self.by_word and "\0" not in p else None for p in plain]
        new = list({w for x in words if x for w in x}.difference(self.known))
        if len(self.known) + len(new) > CHUNKS_KEPT:
            self.known = {w: self.known[w] for x in words if x for w in x if w in self.known}
        self._learn(new)
        out = []
        for text, x, (_, origin) in zip(plain, words, normal, strict=True):
            if x is None:
                ids = self.cutter.encode(text) if text else []
                out.append((np.array(ids, "<i4"), ",".join(map(str, ids)), origin))
            else:
                got = [self.known[w] for w in x]
                out.append((np.frombuffer(b"".join([g[0] for g in got]), "<i4"), ",".join([g[1] for g in got]), origin))
        return out

    def spans(self, ids: np.ndarray, origin: np.ndarray) -> np.ndarray | None:
        """(len(ids), 2) byte offsets, or None if a piece's width isn't told by its id (unknown characters)."""
        ends = np.cumsum(self.width[ids])
        if (int(ends[-1]) if len(ends) else 0) != len(origin) - 1:
            return None
        borders = origin[np.concatenate(([0], ends)).astype(np.int64)]
        return np.stack([borders[:-1], borders[1:]], 1)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One for each worker process and model."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"
DIGESTED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long"


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """ids, byte spans (starts, ends) and the decoded text of every whole text, however long; null as empty, which has no ids; an empty table has no rows.

    starts and ends are null where the model meets unknown characters without byte pieces.  With digest,
    the worker sums them up instead: the ids' number and SHA-256 (decimal, comma-joined), the decoded
    text's SHA-256, and how many original bytes the spans cover.  Rows that repeat are encoded each.
    model_path must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2_000_000):
            tool, texts = codec(model_path), batch_texts(batch)
            texts = [t if t.isascii() else t.encode("utf-8", "replace").decode() for t in texts]
            coded = tool.encode(texts)
            spans = [tool.spans(ids, origin) for ids, _, origin in coded]
            decoded = [tool.decode(ids) if len(ids) else "" for ids, _, _ in coded]
            doc_id = batch.column("doc_id")
            if digest:
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                cover = [None if s is None else int((s[:, 1] - s[:, 0]).sum()) for s in spans]
                yield pa.RecordBatch.from_arrays([doc_id, pa.array([len(i) for i, _, _ in coded], pa.int64()), pa.array([sha(s) for _, s, _ in coded]), pa.array([sha(d) for d in decoded]), pa.array(cover, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"])
            else:
                of = lambda k: pa.array([None if s is None else s[:, k].astype(np.int32) for s in spans], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([doc_id, pa.array([i for i, _, _ in coded], pa.list_(pa.int32())), of(0), of(1), pa.array(decoded, pa.string())], names=["doc_id", "ids", "starts", "ends", "decoded"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, DIGESTED if digest else ENCODED)
