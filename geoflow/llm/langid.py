"""Language identification with bit-sliced Bloom filters over letter n-grams.

Every cell of one table holds a bit for each language (64 to a word).  A lookup ANDs the k cells of an n-gram: the
result is the set of all languages whose profile has the n-gram (and, rarely, some that don't).  A
document's hits are counted by language and corrected for the filter's known false-positive rates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.llm.common import batch_texts, col, discard, gram_blocks, has_letter, hash_share, id_and_text, map_rows, materialise, slices

UNDETERMINED = "und"


def bit(words: np.ndarray, k: int) -> np.ndarray:
    """Bit k of each row's words."""
    return words[:, k >> 6] >> np.uint64(k & 63) & np.uint64(1) == 1


@dataclass
class LanguageFilters:
    languages: list[str]
    table: np.ndarray  # cells x words of 64 bits: a bit for each language
    false_rate: np.ndarray  # by language, of one n-gram lookup
    hashes: int
    sizes: tuple[int, ...]

    def cells(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        """The k cells of each n-gram, by double hashing."""
        step = (grams >> np.uint64(32)) | np.uint64(1)
        for i in range(self.hashes):
            yield (grams + np.uint64(i) * step) & np.uint64(len(self.table) - 1)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram, the words with the bits of all languages that contain it."""
        out = None
        for at in self.cells(grams):
            out = self.table[at] if out is None else out & self.table[at]
        return out

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language and the corrected share of the text's n-grams that it contains (0 to 1) of each text."""
        total = np.zeros(len(texts))
        hits = np.zeros((len(self.languages), len(texts)))
        for _, owner, grams in gram_blocks(texts, self.sizes):
            mask = self.masks(grams)
            total += np.bincount(owner, minlength=len(texts))
            for k in range(len(self.languages)):
                hits[k] += np.bincount(owner[bit(mask, k)], minlength=len(texts))
        rate = self.false_rate[:, None]
        share = np.clip((hits - rate * total) / np.maximum((1 - rate) * total, 1e-9), 0, 1)
        best = share.argmax(0) if self.languages else np.zeros(len(texts), int)
        langs = [self.languages[b] if self.languages and has_letter(t) else UNDETERMINED for b, t in zip(best, texts, strict=True)]
        score = np.where([x != UNDETERMINED for x in langs], share[best, np.arange(len(texts))] if self.languages else 0, 0.0)
        return langs, score


def train(docs: DataFrame, *, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = 1500, sizes: tuple[int, ...] = (3, 4), least_rate: float = 2e-5, least_ratio: float = 0.2,
          cells: int = 1 << 20, hashes: int = 2) -> LanguageFilters:
    """Builds the filters from rows with a non-null language and text, of any number of languages.

    The fit reads about sample_docs whole documents of each language (chosen by a hash of the id), so
    that its cost doesn't grow with the table.  A language's profile holds each n-gram that makes up at
    least least_rate of its n-grams, and at least least_ratio of the rate in any other language: at
    most 1 / least_rate n-grams a language and size.  No row: no language, all `und`.
    """
    if learn is not None:
        docs = docs.where(learn)
    rows = id_and_text(docs, id_col, text_col, col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    count = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(count)
    table = np.zeros((cells, max(1, -(-len(languages) // 64))), np.uint64)
    filters = LanguageFilters(languages, table, np.zeros(len(languages)), hashes, tuple(sizes))
    if not languages:
        return filters
    shares = docs.sparkSession.createDataFrame([(lang, k, hash_share(sample_docs, count[lang])) for k, lang in enumerate(languages)], "lang string, k int, share long")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.shiftrightunsigned(F.xxhash64("doc_id"), 2) < F.col("share"))  # a row for each language

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by: dict[int, list[str]] = {}
            for text, k in zip(batch_texts(batch), batch.column("k").to_pylist(), strict=True):
                by.setdefault(k, []).append(text)
            for k, texts in by.items():
                for _, _, h in gram_blocks(texts, sizes):
                    u, c = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k, np.int32)), pa.array(u.view(np.int64)), pa.array(c, pa.int64())], names=["k", "gram", "c"])

    counted = materialise(chosen.select("k", "text").mapInArrow(grams, "k int, gram long, c long").groupBy("k", "gram").agg(F.sum("c").alias("c")), "gram-counts")
    totals = counted.groupBy("k").agg(F.sum("c").alias("total"))
    rates = counted.join(F.broadcast(totals), "k").select("k", "gram", (F.col("c") / F.col("total")).alias("rate")).where(F.col("rate") >= least_rate)
    listed = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("k", "rate")).alias("of"))  # an entry for each language at most
    profile = listed.select("gram", F.explode("of").alias("e"), "top").where(F.col("e.rate") >= F.col("top") * least_ratio).select("gram", "e.k").toArrow()
    discard(counted)
    gram, of = profile.column("gram").to_numpy().view(np.uint64), profile.column("k").to_numpy()
    for at in filters.cells(gram):
        np.bitwise_or.at(table, (at, of >> 6), np.uint64(1) << (of & 63).astype(np.uint64))
    filters.false_rate = np.array([bit(table, k).mean() ** hashes for k in range(len(languages))])
    return filters


def identify(docs: DataFrame, filters: LanguageFilters, *, text_col: str = "text", keep: bool = False, least_score: float = 0.0) -> DataFrame:
    """All columns of docs with lang_pred and lang_score; keep: only documents with a language and that score, with the columns of docs alone.

    Whole texts are judged, however long.  Null and empty texts and texts without a letter are `und`, score 0.  Ties go to the language that
    sorts first.  Rows that repeat are judged each.  Existing columns of the added names are replaced.
    """
    share = docs.sparkSession.sparkContext.broadcast(filters)  # a table of fixed size
    docs = docs if keep else docs.drop("lang_pred", "lang_score")
    at, n = docs.columns.index(text_col), len(docs.columns)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}"):
            langs, scores = share.value.decide(batch_texts(batch, f"c{at}"))
            if keep:
                yield batch.filter(pa.array([x != UNDETERMINED and s >= least_score for x, s in zip(langs, scores, strict=True)], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[f"c{i}" for i in range(n + 2)])

    return map_rows(docs, judge, *([] if keep else [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))
