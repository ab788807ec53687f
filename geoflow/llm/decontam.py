"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages are TF-IDF vectors over their own telling words, weighted by how many passages of the
corpus hold each word.  A distributed randomised SVD of that matrix gives a latent space.  Every passage
of every document is projected into it, and benchmark passages within a cosine are its candidates.  Where
as many of the item's telling words are near as any match must have, a candidate counts if the longest common subsequence of words covers enough of the benchmark item, or
covers less and the item's answer (its last words) is there too, as in a paraphrase.  Whole copies of items
are also looked up by their words, whatever their cosine.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.llm.common import batch_texts, col, discard, id_and_text, map_rows, materialise, slices, span_hashes, word_hashes

#: Fixed value: ASCII punctuation and white space count as spaces.
PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\r\x0b\x0c", b" " * 37)


def batch_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the texts' words, one text after another, and the borders between the texts.

    Words are in lower case, split at white space and ASCII punctuation.
    """
    data = [t.lower().encode("utf-8", "replace").translate(PUNCTUATION) for t in texts]
    starts, hashes, _ = word_hashes(b"\n".join(data))
    return hashes, np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in data)]))


def words(text: str) -> np.ndarray:
    return batch_words([text])[0]


class Vocabulary:
    """Finds hashes among a fixed set, by open tables of increasing depth."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.append(terms, np.uint64(0))
        self.bits = np.uint64(max(12, int(len(terms) * 8).bit_length()))
        self.tables: list[np.ndarray] = []
        left = np.arange(len(terms))
        while len(left):
            slot = (terms[left] >> (np.uint64(64) - self.bits)).astype(np.int64)
            table = np.full(1 << int(self.bits), len(terms), np.int32)
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The index of each hash, or the number of terms."""
        slot = (hashes >> (np.uint64(64) - self.bits)).astype(np.int64)
        out = np.full(len(hashes), len(self.terms) - 1, np.int32)
        for table in self.tables:
            at = table[slot]
            out = np.where((self.terms[at] == hashes) & (at < len(self.terms) - 1), at, out)
        return out


def places(item: np.ndarray) -> dict[int, int]:
    """For each word, its places in the item as bits of one number."""
    out: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


def common_subsequence(masks: dict[int, int], size: int, region: list[int]) -> int:
    """The length of the longest common subsequence of an item (its words' places) and a region."""
    full = v = (1 << size) - 1
    for m in map(masks.get, region):
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


class Copies:
    """Finds the items that a text holds word for word, by the hash of their first words."""

    def __init__(self, items: list[np.ndarray], head: int = 8):
        heads: dict[int, dict[int, dict[int, dict[bytes, list[int]]]]] = {}
        for k, w in enumerate(items):
            a = min(len(w), head)
            first = int(span_hashes(w, np.array([0]), np.array([a]))[0])
            heads.setdefault(a, {}).setdefault(first, {}).setdefault(len(w), {}).setdefault(w.tobytes(), []).append(k)
        self.heads = [(a, Vocabulary(np.array(list(x), np.uint64)), list(x.values())) for a, x in sorted(heads.items())]

    def find(self, hashes: np.ndarray, borders: np.ndarray) -> set[tuple[int, int]]:
        """(item, text) of the items in the texts, whose words lie one after another between the borders."""
        out: set[tuple[int, int]] = set()
        for a, vocabulary, items in self.heads:
            starts = np.arange(len(hashes) - a + 1)
            if len(starts):
                found = vocabulary.find(span_hashes(hashes, starts, starts + a))
                for at in np.flatnonzero(found < len(items)).tolist():
                    text = int(np.searchsorted(borders, at, "right")) - 1
                    for n, same in items[found[at]].items():
                        if at + n <= borders[text + 1]:
                            out.update((k, text) for k in same.get(hashes[at : at + n].tobytes(), ()))
        return out


@dataclass
class Index:
    ids: list[int]
    size: list[int]  # the words of each item
    sections: list[tuple[int, dict[int, int], int]]  # the item of each section, the places of its words, and their number
    answers: list[tuple[dict[int, int], int]]
    vocabulary: Vocabulary
    project: np.ndarray  # terms + 1 (zero) x rank: idf times the latent basis
    passages: np.ndarray  # passages x rank, of length one
    owner: np.ndarray  # the section of each
    holders: tuple[np.ndarray, np.ndarray]  # the sections that hold each term, one after another, and where each term's begin
    telling: np.ndarray  # how many of each section's words are terms
    copies: Copies
    window: int
    stride: int


def _passages(n: int, window: int, stride: int) -> list[tuple[int, int]]:
    return [(a, min(a + window, n)) for a in range(0, max(n - window + stride, 1), stride)]


def item_words(items: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
    lists = [(i, words(t)) for i, t in items if t]
    return [(i, w) for i, w in lists if len(w)]


def common_words(benchmark: DataFrame, share: float) -> np.ndarray:
    """The words that over `share` of the different items hold, and over two; each item adds its own, so there are at most 1 / share times an item's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for t in batch_texts(batch):
                w = words(t)
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(w.tobytes()).digest()], pa.binary()), pa.array([np.unique(w).view(np.int64)], pa.list_(pa.int64()))], names=["item", "words"])

    items = benchmark.select("text").mapInArrow(run, "item binary, words array<long>").where("size(words) > 0")
    items = materialise(items.groupBy("item").agg(F.first("words").alias("words")), "item-words")
    least = max(2, share * items.count())
    got = items.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") > least).toArrow()
    discard(items)
    return got.column("word").to_numpy().view(np.uint64)


def corpus_counts(docs: DataFrame, terms: np.ndarray, window: int) -> np.ndarray:
    """How many passages of `window` words of all documents hold each term, and last how many there are."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(terms))  # of the benchmark's words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = sent.value
        total, seen = 0, np.zeros(len(voc.terms), np.int64)
        for batch in slices(batches, limit=1_000_000):
            hashes, borders = batch_words(batch_texts(batch))
            n = np.diff(borders)
            first = np.cumsum([0, *(-(-n // window))])
            total += int(first[-1])
            found = voc.find(hashes)
            at = np.flatnonzero(found < len(voc.terms) - 1)
            doc = np.searchsorted(borders, at, "right") - 1
            pair = np.unique((first[doc] + (at - borders[doc]) // window) * len(voc.terms) + found[at])
            seen += np.bincount(pair % len(voc.terms), minlength=len(voc.terms))
        seen[-1] = total
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], names=["term", "n"])

    counted = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1)
    out[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    return out


def build_index(spark: SparkSession, lists: list[tuple[int, np.ndarray]], terms: np.ndarray, idf: np.ndarray, *, window: int, stride: int, rank: int, answer_words: int, section: int = 2048, power: int = 2, seed: int = 11) -> Index:
    """Of a bounded number of items, given as their words; terms and idf: of the whole benchmark."""
    sections = [(k, w[a : a + section]) for k, (_, w) in enumerate(lists) for a in range(0, len(w), section)]
    mine = np.isin(terms, np.concatenate([np.unique(w) for _, w in sections]))
    terms, idf = terms[mine], idf[mine]
    vocabulary = Vocabulary(terms)
    held = [vocabulary.find(w) for _, w in sections]
    rows, owner = [], []
    for k, found in enumerate(held):
        for a, b in _passages(len(found), window, stride):
            part = found[a:b]
            t, n = np.unique(part[part < len(terms)], return_counts=True)
            if len(t):
                v = n * idf[t]
                rows.append((t.tolist(), (v / np.linalg.norm(v)).tolist()))
                owner.append(k)
    rank = max(rank, int(6 * len(rows) ** 0.5))
    basis = _svd(spark, rows, len(terms), rank, power, seed) if rows else np.zeros((len(terms), 1))
    project = np.zeros((len(terms) + 1, basis.shape[1]), np.float32)
    project[:-1] = idf[:, None] * basis
    latent = np.array([(np.array(v)[:, None] * basis[t]).sum(0) for t, v in rows]).reshape(-1, basis.shape[1])
    length = np.linalg.norm(latent, axis=1, keepdims=True)
    ok = length[:, 0] > 1e-6
    held = [f[f < len(terms)] for f in held]
    pairs = np.unique(np.concatenate([np.unique(f).astype(np.int64) * len(sections) + k for k, f in enumerate(held)]))
    holders = pairs % len(sections), np.searchsorted(pairs // len(sections), np.arange(len(terms) + 1))
    return Index([i for i, _ in lists], [len(w) for _, w in lists], [(k, places(w), len(w)) for k, w in sections], [(places(w[-answer_words:]), len(w[-answer_words:])) for _, w in lists], vocabulary, project, (latent[ok] / length[ok]).astype(np.float32), np.array(owner, np.int64)[ok], holders, np.array([len(f) for f in held]), Copies([w for _, w in lists]), window, stride)


def _svd(spark, rows: list[tuple[list[int], list[float]]], n_terms: int, rank: int, power: int, seed: int) -> np.ndarray:
    """An orthonormal basis (terms x rank) of the matrix's leading right singular vectors, by randomised subspace iteration over partitions of its rows."""
    rank = max(1, min(rank, len(rows), n_terms))
    table = spark.createDataFrame(rows or [([], [])], "t array<int>, v array<double>").repartition(max(1, len(rows) // 2000))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_terms, min(rank + 8, n_terms))))[0]
    for _ in range(power + 1):
        sent = spark.sparkContext.broadcast(q)

        def multiply(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            basis, out = sent.value, np.zeros_like(sent.value)
            for batch in batches:
                for t, v in zip(batch.column("t").to_pylist(), batch.column("v").to_pylist(), strict=True):
                    if t:
                        v = np.array(v)
                        out[t] += np.outer(v, v @ basis[t])
            at = np.flatnonzero(np.abs(out).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([x.tobytes() for x in out[at]], pa.binary())], names=["term", "x"])

        parts = table.mapInArrow(multiply, "term int, x binary").toArrow()
        y = np.zeros_like(q)
        if len(parts):
            np.add.at(y, parts.column("term").to_numpy(), np.frombuffer(b"".join(parts.column("x").to_pylist())).reshape(len(parts), -1))
        q = np.linalg.qr(y)[0]
    return q[:, :rank]


def search(texts: list[str], index: Index, cosine: float, covered: float, covered_with_answer: float) -> list[list[tuple[int, float, float]]]:
    """(item's place, best cosine, best share of the item that a common subsequence covers) of the items found in each whole text."""
    hashes, borders = batch_words(texts)
    out = _similar(hashes, borders, index, cosine, covered, covered_with_answer) if len(index.passages) else [{} for _ in texts]
    for k, at in index.copies.find(hashes, borders):
        out[at][k] = out[at][k][0] if k in out[at] else 1.0, 1.0
    return [[(k, c, s) for k, (c, s) in sorted(best.items())] for best in out]


def _similar(hashes: np.ndarray, borders: np.ndarray, index: Index, cosine: float, covered: float, covered_with_answer: float, rows: int = 4096) -> list[dict[int, tuple[float, float]]]:
    """For each text, the best cosine and share of the items found through the latent space; `rows` windows are scored at a time."""
    best: list[dict[int, tuple[float, float]]] = [{} for _ in borders[1:]]
    found = index.vocabulary.find(hashes)
    known = np.flatnonzero(found < len(index.vocabulary.terms) - 1)
    if not len(known):
        return best
    span = index.window // index.stride
    first = np.cumsum([0, *(-(-np.diff(borders) // index.stride) + span)])  # of each text's steps; the last `span` are empty
    doc = np.searchsorted(borders, known, "right") - 1
    step = first[doc] + (known - borders[doc]) // index.stride
    hits = []
    for low in range(0, int(first[-1]), rows):
        a, b = np.searchsorted(step, [low, low + rows + span])
        if a == b:
            continue
        steps, start = np.unique(step[a:b], return_index=True)
        total = np.zeros((rows + 2 * span, index.project.shape[1]), np.float32)
        total[steps - low] = np.add.reduceat(index.project[found[known[a:b]]], start, axis=0)
        window = sum(total[j : rows + j] for j in range(span))
        length = np.linalg.norm(window, axis=1)
        some = np.flatnonzero(length > 1e-9)
        score = (window[some] / length[some, None]) @ index.passages.T
        at, passage = np.nonzero(score >= cosine)
        hits.append((some[at] + low, passage, score[at, passage]))
    if not hits:
        return best
    row, passage, score = map(np.concatenate, zip(*hits, strict=True))
    of = np.searchsorted(first, row, "right") - 1
    inside = row < first[of + 1] - span
    row, passage, score, of = row[inside], passage[inside], score[inside], of[inside]
    cuts = np.searchsorted(of, np.arange(len(borders)))
    inner = np.searchsorted(doc, np.arange(len(borders)))
    for d in np.unique(of).tolist():
        mine = slice(cuts[d], cuts[d + 1])
        at, p = row[mine] - first[d], passage[mine]
        here = slice(inner[d], inner[d + 1])
        ok = _told(index, found[known[here]], step[here] - first[d], int(first[d + 1] - first[d]), at, index.owner[p], min(covered, covered_with_answer))
        if ok.any():
            best[d] = _compared(hashes[borders[d] : borders[d + 1]], index, at[ok], p[ok], score[mine][ok], covered, covered_with_answer)
    return best


def _compared(hashes: np.ndarray, index: Index, at: np.ndarray, passage: np.ndarray, score: np.ndarray, covered: float, covered_with_answer: float) -> dict[int, tuple[float, float]]:
    """The items that a text's candidates (window, passage) confirm, by common subsequences and answers."""
    best: dict[int, tuple[float, float]] = {}
    length: dict[int, dict[int, int]] = {}  # of items in several sections, the longest subsequence of each
    top: dict[int, tuple[float, bool]] = {}
    tried: set[tuple[int, int]] = set()
    listed = hashes.tolist()
    for k in np.argsort(-score, kind="stable").tolist():
        sec = int(index.owner[passage[k]])
        item, masks, size = index.sections[sec]
        if (int(at[k]), sec) in tried or best.get(item, (0, 0))[1] >= 1:
            continue
        tried.add((int(at[k]), sec))
        begin = int(at[k]) * index.stride
        region = listed[max(0, begin - size) : begin + index.window + size]
        got = common_subsequence(masks, size, region)
        told = lambda: common_subsequence(*index.answers[item], region) == index.answers[item][1]  # noqa: E731, B023
        if size == index.size[item]:
            share = got / size
            if (share >= covered or (share >= covered_with_answer and told())) and share > best.get(item, (0, 0))[1]:
                best[item] = float(score[k]), share
        else:
            of = length.setdefault(item, {})
            of[sec] = max(of.get(sec, 0), got)
            c, answered = top.get(item, (0.0, False))
            top[item] = max(c, float(score[k])), answered or told()
    for item, of in length.items():
        share = sum(of.values()) / index.size[item]
        if share >= covered or (share >= covered_with_answer and top[item][1]):
            best[item] = top[item][0], share
    return best


def _told(index: Index, terms: np.ndarray, step: np.ndarray, n: int, at: np.ndarray, item: np.ndarray, least: float) -> np.ndarray:
    """For candidates (window, section), whether the text around the window has the telling words without which no common subsequence covers `least` of an item in one section."""
    items, back = np.unique(item, return_inverse=True)
    place = np.full(len(index.telling), -1)
    place[items] = np.arange(len(items))
    flat, first = index.holders
    many = first[terms + 1] - first[terms]
    owner = place[flat[np.repeat(first[terms] - np.cumsum(many) + many, many) + np.arange(many.sum())]]
    cell = (np.repeat(step, many) * len(items) + owner)[owner >= 0]
    total = np.zeros((n + 1, len(items)), np.int64)
    total[1:] = np.cumsum(np.bincount(cell, minlength=n * len(items)).reshape(n, len(items)), axis=0)
    size = np.array([index.sections[k][2] for k in items])[back]
    whole = np.array([index.sections[k][2] == index.size[index.sections[k][0]] for k in items])[back]
    low = np.maximum(at - -(-size // index.stride), 0)
    high = np.minimum(at + -(-(index.window + size) // index.stride), n)
    return ~whole | (total[high, back] - total[low, back] >= index.telling[item] - (1 - least) * size - 1e-6)


def indexes(docs: DataFrame, benchmark: DataFrame, *, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, stride: int, rank: int, common: float, answer_words: int, items_per_block: int) -> Iterator[Index]:
    """An index of each block of about items_per_block items, by a hash of their ids, so that any benchmark fits.

    The telling words and how many passages of the corpus hold each are those of the whole benchmark, counted in one
    scan of the documents; the latent space is each block's own.
    """
    spark = docs.sparkSession
    items = benchmark.select(col(item_col).cast("long").alias("item_id"), col(item_text_col).cast("string").alias("text")).where("text is not null and item_id is not null")
    items = materialise(items, "items")
    blocks = max(1, -(-items.count() // items_per_block))
    often, terms = common_words(items, common), [np.zeros(0, np.uint64)]

    def block(k: int) -> list[tuple[int, np.ndarray]]:
        return item_words([(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()])

    for k in range(blocks):
        terms = [np.unique(np.concatenate([*terms, *(w for _, w in block(k))]))]
    terms = np.setdiff1d(terms[0], often)
    df = corpus_counts(id_and_text(docs, id_col, text_col), terms, window)
    idf = np.log((df[-1] + items.count() + 1) / (df[:-1] + 1)) + 1
    for k in range(blocks):
        lists = block(k)
        if lists:
            yield build_index(spark, lists, terms, idf, window=window, stride=stride, rank=rank, answer_words=answer_words)
    discard(items)


FOUND = "doc_id long, item_ids array<long>, best_cosine double, best_cover double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 32, stride: int = 16, rank: int = 128, cosine: float = 0.45, covered: float = 0.75, covered_with_answer: float = 0.55, answer_words: int = 5, common: float = 0.05, items_per_block: int = 5000) -> DataFrame:
    """doc_id, item_ids (ascending), best_cosine, best_cover: one row for each row of docs that holds a benchmark item.

    Whole texts are searched.  Null and empty texts and items, and empty tables, hold nothing.  Word-for-word copies
    of whole items are always found (with cosine 1 if the latent space has missed them).  `rank` is the least; it
    grows with the root of a block's passages.  An item whose every word is common to over `common` of the items (and
    to over two) is found as such a copy only.  Items of over 2,048 words are compared in sections of that many, whose
    common subsequences add up.  Repeated items are found each, repeated rows too.
    """
    spark, options = docs.sparkSession, {"id_col": id_col, "text_col": text_col, "item_col": item_col, "item_text_col": item_text_col, "window": window, "stride": stride, "rank": rank, "common": common, "answer_words": answer_words, "items_per_block": items_per_block}
    parts = [id_and_text(docs, id_col, text_col).mapInArrow(_searcher(docs, index, cosine, covered, covered_with_answer), FOUND + ", digest binary") for index in indexes(docs, benchmark, **options)]
    if not parts:
        return spark.createDataFrame([], FOUND)
    if len(parts) == 1:
        return parts[0].drop("digest")
    alike = [part.groupBy("doc_id", "digest").agg(F.first("item_ids").alias("item_ids"), F.first("best_cosine").alias("c"), F.first("best_cover").alias("s"), F.count(F.lit(1)).alias("rows")) for part in parts]
    every = functools.reduce(DataFrame.unionAll, alike).groupBy("doc_id", "digest").agg(F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.max("c").alias("best_cosine"), F.max("s").alias("best_cover"), F.max("rows").alias("rows"))  # a row for each block at most
    return every.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows")))).select("doc_id", "item_ids", "best_cosine", "best_cover")


def _searcher(docs: DataFrame, index: Index, *limits: float):
    sent = docs.sparkSession.sparkContext.broadcast(index)  # of a block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1_000_000):
            texts, rows = batch_texts(batch), []
            for doc_id, text, got in zip(batch.column("doc_id").to_pylist(), texts, search(texts, sent.value, *limits), strict=True):
                if got:
                    rows.append((doc_id, sorted(sent.value.ids[k] for k, _, _ in got), max(c for _, c, _ in got), max(s for *_, s in got), hashlib.sha256(text.encode("utf-8", "replace")).digest()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_ids", "best_cosine", "best_cover", "digest"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 32, stride: int = 16, rank: int = 128, cosine: float = 0.45, covered: float = 0.75, covered_with_answer: float = 0.55, answer_words: int = 5, common: float = 0.05, items_per_block: int = 5000) -> DataFrame:
    """The rows of docs in which no item is found, all columns, rows judged one by one as find_leaks() does; null texts stay."""
    options = {"id_col": id_col, "text_col": text_col, "item_col": item_col, "item_text_col": item_text_col, "window": window, "stride": stride, "rank": rank, "common": common, "answer_words": answer_words, "items_per_block": items_per_block}
    out, at = docs, docs.columns.index(text_col)
    for index in indexes(docs, benchmark, **options):
        sent = docs.sparkSession.sparkContext.broadcast(index)  # of a block of items

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, f"c{at}", limit=1_000_000):
                yield batch.filter(pa.array([not got for got in search(batch_texts(batch, f"c{at}"), sent.value, cosine, covered, covered_with_answer)], pa.bool_()))

        out = map_rows(out, run)
    return out
