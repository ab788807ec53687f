"""Substring dedup: words covered by a window of words that occurs elsewhere go.

Three passes over blocks of documents.  First each block counts its windows into a count-min sketch (one
row, counters that stop at two, sent sparse, as wide as the corpus needs); ranges of the row are merged and
each block learns which of its cells count two or more.  The sketch can only overestimate, so no repeated
window is lost.  Second, only windows in such cells are grouped exactly, by 128 bits of hash.  Third, the
blocks drop the words that repeated windows cover.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoflow.llm.common import id_and_text, span_hashes, word_hashes

def pack(values: np.ndarray, flags: np.ndarray) -> bytes:
    """Ascending numbers and a bit for each, small: differences by byte plane, then zstd."""
    step = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return len(values).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes() + np.packbits(flags).tobytes())


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=8 * n + n // 8 + 9), np.uint8)
    step = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    flags = raw[8 * n :]
    return np.cumsum(step, dtype=np.uint64), np.unpackbits(flags, count=n).astype(bool) if len(flags) else np.zeros(n, bool)


class Block:
    """The words of some documents and the hashes of their windows."""

    def __init__(self, texts: list[str | None], window: int):
        data = [(t or "").encode("utf-8", "replace") for t in texts]
        size = np.fromiter((len(d) + 1 for d in data), np.int64, len(data))
        self.data = b"\n".join(data)
        self.starts, one, two = word_hashes(self.data)
        self.first = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(size))))  # of each document's words
        begin = np.arange(max(len(self.starts) - window + 1, 0))
        doc = np.searchsorted(self.first, begin, "right") - 1
        self.at = begin[begin + window <= self.first[doc + 1]] if len(begin) else begin
        self.h1 = span_hashes(one, self.at, self.at + window)
        self.h2 = span_hashes(two, self.at, self.at + window)

    def cells(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The block's distinct cells, ascending, and whether each counts two windows or more."""
        u, n = np.unique(self.h1 >> np.uint64(64 - bits), return_counts=True)
        return u, n > 1

    def distinct(self, hot: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows in these cells: (h1, h2, count above one) of the distinct ones, ascending, and each window's index among them (-1: another cell)."""
        place = np.full(len(self.at), -1, np.int64)
        cell = self.h1 >> np.uint64(64 - bits)
        pos = np.minimum(np.searchsorted(hot, cell), max(len(hot) - 1, 0))
        mine = np.flatnonzero(hot[pos] == cell) if len(hot) else np.zeros(0, np.int64)
        a, b = self.h1[mine], self.h2[mine]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        index = np.cumsum(new) - 1
        place[mine[order]] = index
        count = np.bincount(index, minlength=int(new.sum()))
        return a[new], b[new], count > 1, place

    def removed(self, repeated: np.ndarray, window: int) -> np.ndarray:
        """For each word, whether a window covers it; repeated: for each window."""
        edge = np.zeros(len(self.starts) + 1, np.int64)
        at = self.at[repeated]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, block_bytes: int = 4 << 20, load: int = 32, per_slice: int = 4_000_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space; digest: kept_sha256 instead) of every row.

    Words are runs of anything but \\x20 and \\x09-\\x0D.  A window is `window` consecutive words of one row;
    its words go if the same sequence starts anywhere else, in the same row too.  Null texts hold no
    words.  Repeated rows are rows like any others, so all their windows repeat.  Texts of any length are
    handled whole; an empty table has no rows.  load: cells for each window of the corpus.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    n_blocks = max(1, -(-total // block_bytes))
    windows = max(1, total // 4)
    bits = min(max((windows * load).bit_length(), 16), 56)
    cuts = 1
    while windows / cuts > per_slice:
        cuts *= 2
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_blocks // 8))
    blocked = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"), "doc_id", "text").repartition(partitions, "block")

    def cut(h: np.ndarray, top: int) -> list[tuple[int, int, int]]:
        """(slice, begin, end) of the slices that ascending values of `top` bits reach, and of no others."""
        k = h >> np.uint64(top - cuts.bit_length() + 1) if cuts > 1 else np.zeros(len(h), np.uint64)
        edge = np.flatnonzero(np.diff(k)) + 1
        return [(int(k[a]), int(a), int(b)) for a, b in zip([0, *edge], [*edge, len(h)], strict=True) if b > a]

    def table(fields: list[tuple[str, pa.DataType]], out: list[tuple]) -> pa.Table:
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(fields)})

    sketched = [("slice", pa.int32()), ("block", pa.int32()), ("cells", pa.binary())]

    def sketch(t: pa.Table) -> pa.Table:
        cells, twice = Block(t.column("text").to_pylist(), window).cells(bits)
        block = t.column("block")[0].as_py()
        return table(sketched, [(k, block, pack(cells[a:b], twice[a:b])) for k, a, b in cut(cells, bits)])

    answered = [("block", pa.int32()), ("slice", pa.int32()), ("hot", pa.binary())]

    def merge(t: pa.Table) -> pa.Table:
        """Sums a slice's counters over the blocks; to each block, its own cells that count two or more."""
        got = [unpack(x) for x in t.column("cells").to_pylist()]
        cells = np.concatenate([c for c, _ in got])
        u, back = np.unique(cells, return_inverse=True)
        hot = (np.bincount(back, np.concatenate([1 + f.astype(np.int64) for _, f in got])) >= 2)[back]
        edge = np.cumsum([0, *(len(c) for c, _ in got)])
        blocks, k = t.column("block").to_pylist(), t.column("slice")[0].as_py()
        return table(answered, [(b, k, pack(c[hot[x:y]], np.zeros(0, bool))) for b, (c, _), x, y in zip(blocks, got, edge[:-1], edge[1:], strict=True) if hot[x:y].any()])

    listed = [("slice", pa.int32()), ("block", pa.int32()), ("windows", pa.binary())]

    def hot_cells(t: pa.Table) -> np.ndarray:
        got = sorted(zip(t.column("slice").to_pylist(), t.column("hot").to_pylist(), strict=True))
        return np.concatenate([unpack(x)[0] for _, x in got]) if got else np.zeros(0, np.uint64)

    def candidates(docs: pa.Table, hot: pa.Table) -> pa.Table:
        """The distinct windows in hot cells, by slice, each with its index in the block."""
        if not len(docs) or not len(hot):
            return table(listed, [])
        h1, h2, twice, _ = Block(docs.column("text").to_pylist(), window).distinct(hot_cells(hot), bits)
        block = docs.column("block")[0].as_py()
        return table(listed, [(k, block, np.array([a], "<u8").tobytes() + twice[a:b].tobytes() + h1[a:b].tobytes() + h2[a:b].tobytes()) for k, a, b in cut(h1, 64)])

    repeated = [("block", pa.int32()), ("slice", pa.int32()), ("hot", pa.binary()), ("again", pa.binary())]

    def group(t: pa.Table) -> pa.Table:
        """Groups a slice's windows exactly; to each block, the indices of those that start elsewhere too."""
        h1, h2, twice, first, size = [], [], [], [], []
        for x in t.column("windows").to_pylist():
            n = (len(x) - 8) // 17
            first.append(int(np.frombuffer(x, "<u8", 1)[0]))
            size.append(n)
            twice.append(np.frombuffer(x, bool, n, 8))
            h1.append(np.frombuffer(x, "<u8", n, 8 + n))
            h2.append(np.frombuffer(x, "<u8", n, 8 + 9 * n))
        a, b, twice = np.concatenate(h1), np.concatenate(h2), np.concatenate(twice)
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        index = np.cumsum(new) - 1
        often = np.bincount(index, 1 + twice[order]) >= 2
        hit = np.empty(len(a), bool)
        hit[order] = often[index]
        edge, k = np.cumsum([0, *size]), t.column("slice")[0].as_py()
        return table(repeated, [(blk, k, None, pack((np.flatnonzero(hit[x:y]) + f).astype(np.uint64), np.zeros(0, bool))) for blk, f, x, y in zip(t.column("block").to_pylist(), first, edge[:-1], edge[1:], strict=True) if hit[x:y].any()])

    last = "kept_sha256" if digest else "kept"

    def drop(docs: pa.Table, marks: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), last: pa.array([], pa.string())})
        block = Block(docs.column("text").to_pylist(), window)
        again = np.zeros(len(block.at), bool)
        lists = [unpack(x)[0] for x in marks.column("again").to_pylist() if x is not None]
        if lists:
            hot = hot_cells(marks.filter(pa.compute.is_valid(marks.column("hot"))))
            *_, place = block.distinct(hot, bits)
            ids = np.zeros(place.max() + 2, bool)
            ids[np.concatenate(lists).astype(np.int64)] = True
            again = ids[place] & (place >= 0)
        gone = block.removed(again, window)
        total = np.concatenate(([0], np.cumsum(gone)))
        n_words, n_gone, kept = np.diff(block.first), np.diff(total[block.first]), []
        for k, text in enumerate(docs.column("text").to_pylist()):
            words = (text or "").encode("utf-8", "replace").split()
            if n_gone[k]:
                keep = ~gone[block.first[k] : block.first[k + 1]]
                words = [w for w, ok in zip(words, keep.tolist(), strict=True) if ok]
            joined = b" ".join(words)
            kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), last: pa.array(kept, pa.string())})

    names = {pa.int32(): "int", pa.binary(): "binary"}
    ddl = lambda fields: ", ".join(f"{n} {names[t]}" for n, t in fields)
    cells = blocked.groupBy("block").applyInArrow(sketch, ddl(sketched))
    hot = cells.groupBy("slice").applyInArrow(merge, ddl(answered))
    found = blocked.groupBy("block").cogroup(hot.groupBy("block")).applyInArrow(candidates, ddl(listed))
    again = found.groupBy("slice").applyInArrow(group, ddl(repeated))
    marks = hot.select("block", "slice", "hot", F.lit(None).cast("binary").alias("again")).union(again)
    return blocked.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(drop, f"doc_id long, n_words long, n_removed long, {last} string")

