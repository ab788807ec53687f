"""Toxicity as a linear softmax over the mean of subword embeddings, trained jointly in numpy.

A text is the bag of the letter n-grams of its words, each hashed to a row of an embedding table; the
rows' mean feeds a softmax of two classes.  A misspelling that was never seen shares most n-grams with
its word, and so its vectors.  For scoring, embedding and softmax fold into one number for each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoflow.llm.common import batch_texts, col, discard, gram_blocks, hash_share, id_and_text, materialise, slices


@dataclass
class SubwordModel:
    embedding: np.ndarray  # buckets x dim
    weight: np.ndarray  # dim x 2
    bias: np.ndarray  # 2
    sizes: tuple[int, ...]

    def folded(self) -> np.ndarray:
        """What one n-gram of each bucket adds to the sum whose mean is the margin of class 1 over class 0."""
        return (self.embedding @ (self.weight[:, 1] - self.weight[:, 0])).astype(np.float32)

    def scores(self, texts: list[str], folded: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for _, owner, grams in gram_blocks(texts, self.sizes):
            total += np.bincount(owner, folded[grams & np.uint64(len(folded) - 1)], minlength=len(texts))
            count += np.bincount(owner, minlength=len(texts))
        margin = total / np.maximum(count, 1) + self.bias[1] - self.bias[0]
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def fit(texts: list[str], labels: np.ndarray, *, sizes: tuple[int, ...] = (3, 4, 5), buckets: int = 1 << 19, dim: int = 4, epochs: int = 30, rate: float = 0.5, least_docs: int = 5, prior: float | None = None, seed: int = 7) -> SubwordModel:
    """Trains embedding and softmax together with Adam on the mean cross-entropy, over minibatches of whole texts.

    Rows of n-grams in fewer than least_docs texts stay zero.  prior: the share of class 1 where the model
    will be used, if the texts are sampled otherwise; the bias is moved by the difference of the log odds.
    """
    rng = np.random.default_rng(seed)
    rows, cols, vals = [], [], []
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        keys = np.concatenate([owner.astype(np.uint64) * np.uint64(buckets) + (g & np.uint64(buckets - 1)) for _, owner, g in gram_blocks(part, sizes)] or [np.zeros(0, np.uint64)])
        u, c = np.unique(keys, return_counts=True)
        rows.append((u // np.uint64(buckets)).astype(np.int32) + k)
        cols.append((u % np.uint64(buckets)).astype(np.int32))
        vals.append(c.astype(np.float32))
    row, at, val = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (rows, cols, vals))
    used = np.flatnonzero(np.bincount(at, minlength=buckets) >= least_docs)
    val = val / np.maximum(np.bincount(row, val, minlength=max(len(texts), 1)), 1)[row].astype(np.float32) if len(row) else val
    place = np.full(buckets, -1, np.int32)
    place[used] = np.arange(len(used))
    at = place[at] if len(at) else at
    row, val, at = row[at >= 0], val[at >= 0], at[at >= 0]
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    e = rng.normal(0, 0.3, (len(used), dim)).astype(np.float32)
    w, b = rng.normal(0, 0.3, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    one_hot = np.eye(2, dtype=np.float32)[labels.astype(int)]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (e, w, b)]
    step, size = 0, max(64, len(texts) // 6)
    for epoch in range(epochs if len(texts) else 0):
        order = rng.permutation(len(texts))
        for k in range(0, len(texts), size):
            docs = np.sort(order[k : k + size])
            n = first[docs + 1] - first[docs]
            index = np.repeat(first[docs] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            owner, cell, share = np.repeat(np.arange(len(docs)), n), at[index], val[index]
            mean = np.stack([np.bincount(owner, e[cell, d] * share, minlength=len(docs)) for d in range(dim)], 1).astype(np.float32)
            z = mean @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - one_hot[docs]) / len(docs)
            gm = g @ w.T
            ge = np.stack([np.bincount(cell, gm[owner, d] * share, minlength=len(used)) for d in range(dim)], 1).astype(np.float32)
            step += 1
            now = rate * (1 - epoch / epochs)
            for p, grad, (m, v) in zip((e, w, b), (ge, mean.T @ g, g.sum(0)), state, strict=True):
                m *= 0.9
                m += 0.1 * grad
                v *= 0.99
                v += 0.01 * grad * grad
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    if prior is not None and 0 < prior < 1 and 0 < labels.sum() < len(labels):
        b += np.array([0, np.log(prior / (1 - prior)) - np.log(labels.sum() / (len(labels) - labels.sum()))], np.float32)
    full = np.zeros((buckets, dim), np.float32)
    full[used] = e
    return SubwordModel(full, w, b, tuple(sizes))


def train(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: tuple[int, int] = (4000, 2500), sample_chars: int = 20_000_000, **fit_options) -> SubwordModel:
    """Fits on about sample_docs documents of label 0 and 1, chosen by a hash of the id; at most about sample_chars characters come to the driver.

    Texts are taken whole in the order of the hashes, but for those that would bring the sum to over sample_chars; if
    none of a label fits, its shortest is taken.  The bias is set for the labels' own shares.  Rows with a null label,
    id or text don't train.  A document with several labels trains once for each.  Without a row to learn from, every
    score is 0.5.
    """
    spark = docs.sparkSession
    marks = labels.select(col(id_col).cast("long").alias("doc_id"), col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    if learn is not None:
        marks = marks.where(learn)
    total = {r.y: r.n for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = [hash_share(most, total.get(y, 0)) for y, most in enumerate(sample_docs)]
    marks = marks.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 2) < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    marks = F.broadcast(marks.distinct())  # about sum(sample_docs) rows
    rows = id_and_text(docs, id_col, text_col).where("text is not null").join(marks, "doc_id")
    rows = materialise(rows.select("y", "text", F.xxhash64("doc_id").alias("h"), F.length("text").alias("n"), F.monotonically_increasing_id().alias("row")), "labelled")
    room, chosen, seen = sample_chars, [], set()
    listed = sorted((r.h, r.n, r.y, r.row) for r in rows.select("h", "n", "y", "row").collect())
    for _, n, y, row in listed:
        if n <= room:
            room -= n
            chosen.append(row)
            seen.add(y)
    chosen += [min((n, row) for _, n, k, row in listed if k == y)[1] for y in {y for _, _, y, _ in listed} - seen]
    texts, ys = [], []
    if chosen:
        picked = spark.createDataFrame([(row,) for row in chosen], "row long")
        for r in rows.join(F.broadcast(picked), "row").orderBy("h", "text", "y").toLocalIterator():
            texts.append(r.text)
            ys.append(r.y)
    discard(rows)
    prior = total.get(1, 0) / max(sum(total.values()), 1)
    return fit(texts, np.array(ys, int), prior=prior, **fit_options)


def score(docs: DataFrame, model: SubwordModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, toxicity (0 to 1) of every whole text; null and empty texts, and texts without letters, score as an empty bag."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast((SubwordModel(np.zeros((0, 0)), model.weight, model.bias, model.sizes), model.folded()))  # fixed size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, folded = share.value
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(small.scores(batch_texts(batch), folded))], names=["doc_id", "toxicity"])

    return id_and_text(docs, id_col, text_col).mapInArrow(judge, "doc_id long, toxicity double")
