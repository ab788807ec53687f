"""Token counts with a digest cache.

The cache is a table of (tokenizer digest, content digest, n_tokens).  A call joins the documents'
digests to it, encodes each distinct missing content once, and appends those counts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoflow.llm.common import batch_texts, id_and_text, materialise, shared_dir, slices

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Rises with each change of this module that could change a count.
VERSION = "1"

#: White space for Python holds all that tokenizers take for white space, so a chunk that ends with
#: anything else, before one that starts with white space, ends a pre-token in any of them.
CHUNK = re.compile(r"\s*\S+|\s+")
CHUNKS_KEPT = 600_000


def tokenizer_digest(path: str) -> str:
    """Of the vocabulary file's bytes and this module's version."""
    return hashlib.sha256(VERSION.encode() + Path(path).read_bytes()).hexdigest()


class ChunkCounter:
    """Counts a byte-level BPE's tokens chunk by chunk; counts of recent chunks are kept, up to a bound.

    Its pre-tokens never run over the border between a character that isn't white space and white space,
    and special tokens hold none, so a text's count is the sum of its chunks' counts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        texts = [t if t.isascii() else t.encode("utf-8", "replace").decode() for t in texts]
        chunks = [CHUNK.findall(t) for t in texts]
        new = list({c for x in chunks for c in x}.difference(self.known))
        if len(self.known) + len(new) > CHUNKS_KEPT:
            self.known = {c: self.known[c] for x in chunks for c in x if c in self.known}
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.known.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, x)) for x in chunks]


_counters: dict[str, ChunkCounter] = {}


def counter(path: str) -> ChunkCounter:
    """One for each worker process and vocabulary."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = ChunkCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, *, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; null text counts as empty.

    The content is normalised to text with null as "", and nothing more, since the tokenizer tells all
    else apart; its digest is SHA-256.  cache_path is a folder that all executors share (a new one if
    none is given).  A content that many rows share is reduced within each task before it moves, and is
    encoded once.  Concurrent writers can append a content twice, with equal counts; reads take one.
    tokenizer_path must be readable on every executor.  Whole texts are counted; an empty table has no rows.
    """
    spark = docs.sparkSession
    cache_path = cache_path or shared_dir(spark, "token-counts")
    version = tokenizer_digest(tokenizer_path)
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    digest = F.unhex(F.sha2("text", 256))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def cache() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = rows.groupBy(digest.alias("digest")).agg(F.first("text").alias("text")).join(cache(), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = counter(tokenizer_path).count(batch_texts(batch))
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(batch)), batch.column("digest"), pa.array(counts, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    misses.select("digest", "text").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    sized = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("digest"))
    known = materialise(cache(), "token-counts-read")  # plain on both sides, so that a digest of very many rows can be split
    return sized.join(known, "digest", "left").select("doc_id", "n_bytes", "n_tokens")
