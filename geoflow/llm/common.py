"""What the operators share: shared folders, Arrow helpers, letter n-grams and word hashes."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.shared import discard, materialise, shared_dir, without_shuffles  # noqa: F401

#: The finaliser of splitmix64, and an odd base for polynomial hashes.
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters that the vectorised scans handle at once, so that their arrays stay in the CPU's cache.
BLOCK_CHARS = 200_000


def hash_share(want: float, total: int) -> int:
    """The border below which the upper 62 bits of a hash fall for about want of total rows, and never 0."""
    return max(1, int(min(1.0, want / max(total, 1)) * (1 << 62)))


def below(share: int, *columns: Column | str) -> Column:
    """Whether a row's hash over the columns falls in that share."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2) < F.lit(share)


#: A membership bitmap has 2 ** BITMAP_BITS bits (16 MB), however many members it takes in.
BITMAP_BITS = 27


def bitmap(members: DataFrame) -> np.ndarray:
    """One bit for each member, by the upper bits of its first column (longs, spread as hashes are): never misses one, and may hold others.

    Partial bitmaps are merged by word, so that at most 2 ** BITMAP_BITS / 64 words reach the driver.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITMAP_BITS - 6, np.uint64)
        for batch in batches:
            slots = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP_BITS))
            if len(slots):
                word = (slots >> np.uint64(6)).astype(np.int64)
                first = np.flatnonzero(np.diff(word, prepend=-1))
                bits[word[first]] |= np.bitwise_or.reduceat(np.uint64(1) << (slots & np.uint64(63)), first)
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bits[at].view(np.int64))], names=["at", "word"])

    got = members.select(F.col(members.columns[0]).alias("key")).mapInArrow(words, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(1 << BITMAP_BITS - 6, np.uint64)
    out[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    return out


class Bits:
    """A bitmap that is sent and stored as its words other than 0, where that takes less room: each broadcast is a file on the driver and on every executor."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __getstate__(self) -> tuple:
        at = np.flatnonzero(self.bits)
        return (len(self.bits), at.astype(np.int32), self.bits[at]) if 3 * len(at) < 2 * len(self.bits) else (len(self.bits), None, self.bits)

    def __setstate__(self, state: tuple) -> None:
        size, at, words = state
        self.bits = words if at is None else np.zeros(size, np.uint64)
        if at is not None:
            self.bits[at] = words


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_batches(docs: DataFrame, rows: int = 1000) -> None:
    """Lets Arrow batches of this session hold few rows, unless it has a number of its own: texts can be long."""
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    small_batches(docs)
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"), *more)


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *more: T.StructField) -> DataFrame:
    """run over all columns, which it sees and returns as c0, c1 and so on, those of `more` last: any name can be in docs."""
    small_batches(docs)
    names = [f"c{i}" for i in range(len(docs.columns) + len(more))]
    kinds = [f.dataType for f in docs.schema] + [f.dataType for f in more]
    out = docs.toDF(*names[: len(docs.columns)]).mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
    return out.toDF(*docs.columns, *(f.name for f in more))


def batch_texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], name: str = "text", limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text, so that Python objects of few rows live at once."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < len(batch):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


@functools.cache
def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def pieces(text: str, limit: int = BLOCK_CHARS) -> Iterator[str]:
    """The text cut at spaces into parts of at most limit characters (a longer word is cut hard)."""
    start = 0
    while len(text) - start > limit:
        stop = text.rfind(" ", start + 1, start + limit)
        stop = stop if stop > 0 else start + limit
        yield text[start:stop]
        start = stop
    yield text[start:]


def gram_blocks(texts: list[str], sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, owner, hash) for all letter n-grams of lower-cased whole texts, in blocks.

    Anything but letters becomes a space; an n-gram may have a space at either end and only letters
    between.  owner is the text's index.  Grams of n characters never equal those of another n.
    """
    block: list[str] = []
    owners: list[int] = []
    total = 0
    for k, text in enumerate(texts):
        for part in pieces(text.lower()):
            block.append(part)
            owners.append(k)
            total += len(part)
            if total >= BLOCK_CHARS:
                yield from _grams(block, owners, sizes)
                block, owners, total = [], [], 0
    if block:
        yield from _grams(block, owners, sizes)


def _grams(block: list[str], owners: list[int], sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    joined = " " + "  ".join(block) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    letters = letter_table()[codes]
    codes = np.where(letters, codes, 32).astype(np.uint64)
    lengths = np.fromiter((len(x) + 2 for x in block), np.int64, len(block))
    owner = np.repeat(np.asarray(owners), lengths)
    for n in sizes:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        ok = letters[1 : 1 + m].copy()
        for j in range(2, n - 1):
            ok &= letters[j : j + m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = h * BASE + codes[at + j]
        yield n, owner[at], mix(h)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes as an array, starts, ends) of the maximal runs of bytes other than \\x20 and \\x09-\\x0D."""
    a = np.frombuffer(data, np.uint8)
    black = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edge = np.diff(np.concatenate(([0], black.view(np.int8), [0])))
    return a, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: What the second lane of word hashes multiplies by, and the bytes up to which words are hashed together.
LANE2, LONG_WORD = np.uint64(0xD6E8FEB86659FD93), 256


def word_hashes(data: bytes, part: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, second hash) of each word of data, 64 bits each, in parts cut at white space.

    A word is taken eight bytes at a time, each mixed with what came before by a bijection, so that words of up
    to eight bytes never collide; longer than LONG_WORD, it gets the two halves of its XXH3.
    """
    out, at = [], 0
    while at < len(data):
        stop = len(data)
        if stop - at > part:
            stop = max(data.rfind(b" ", at, at + part), data.rfind(b"\n", at, at + part)) + 1 or data.find(b" ", at) + 1 or stop
        out.append(_word_hashes(data[at:stop], at))
        at = stop
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _word_hashes(data: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, starts, ends = word_spans(data)
    size = ends - starts
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place on

    def chunk(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        return eight[starts] & (np.uint64(2**64 - 1) >> (np.uint64(8) * (8 - np.clip(size, 1, 8)).astype(np.uint64)))

    first = chunk(starts, size)
    one, two = mix(first + BASE * size.astype(np.uint64)), mix(first * LANE2 + size.astype(np.uint64))
    left = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    k = 8
    while len(left):
        c = chunk(starts[left] + k, size[left] - k)
        one[left], two[left] = mix(one[left] * BASE + c), mix((two[left] ^ c) * LANE2)
        k += 8
        left = left[size[left] > k]
    for w in np.flatnonzero(size > LONG_WORD).tolist():
        one[w], two[w] = np.frombuffer(xxhash.xxh3_128_digest(data[starts[w] : ends[w]]), "<u8")
    return starts + at, one, two


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            cls.up, cls.down = (np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64))).cumprod(dtype=np.uint64) for b in (BASE, inverse))
        return cls.up[:n], cls.down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of values[start:end], from one running sum."""
    up, down = Powers.to(len(values) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(values.astype(np.uint64) * up[: len(values)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
