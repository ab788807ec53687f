"""SimHash near-duplicates by multi-index hashing, and the groups that their links connect."""

from __future__ import annotations

import gc
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.llm.common import BASE, Bits, batch_texts, below, bitmap, discard, id_and_text, in_bitmap, map_rows, materialise, mix, slices, without_shuffles, word_hashes

SEED = 42
#: Longs of a set's parity that go with each of its prefix shingles.
FOLDS = 4


def wide_fingerprint(text: str | None, words: int = 3, width: int = 1) -> np.ndarray:
    """width times 64 bits: a bit is 1 if it is set in over half of the shingles' hashes; no words: all 0.  A-Z count as a-z.

    The first 64 come from the shingles' XXH64, the others from bijections of it.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(width, np.uint64)
    data = b" ".join(found)
    if len(found) <= words:
        shingles = [data]
    else:
        size = np.fromiter(map(len, found), np.int64, len(found)) + 1
        ends = np.cumsum(size) - 1
        starts = ends - size + 1
        shingles = [data[a:b] for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]
    count, digest = np.zeros(64 * width, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(shingles), 50_000):
        h = np.array([digest(s, SEED) for s in shingles[k : k + 50_000]], np.uint64)
        every = np.stack([h, *(mix(h + np.array([j], np.uint64) * BASE) for j in range(1, width))], 1).astype(">u8")
        count += np.unpackbits(every.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(shingles)).view(">u8").astype(np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    return int(wide_fingerprint(text, words)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fingerprint (a long with the 64 bits) of every whole text; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, words) for t in batch_texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, *, distance: int = 3, largest_bucket: int = 500) -> DataFrame:
    """Edges (a < b as fingerprints) that connect what Hamming distances up to 3 connect, from distinct `fp`.

    The 64 bits are two segments of 32.  Two fingerprints within 3 bits differ by at most one bit in one
    of the segments, so each looks up the 33 values of that ball in the table of that segment, and full
    distances are verified in the join.  A segment value that over largest_bucket fingerprints share is
    not paired: each of its fingerprints names the points within 2 bits in the other segment, any that
    could meet it names the points within 1 bit, and those that name a point are chained to one of them.
    That is linear in the bucket's size and joins the same components.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of one bit find distances up to 3")
    halves = F.array(*(F.struct(F.lit(k).alias("side"), v.cast("long").alias("key")) for k, v in ((0, F.shiftrightunsigned("fp", 32)), (1, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))))))
    table = distinct.select("fp", F.explode(halves).alias("h")).select("fp", "h.side", "h.key")
    hot = materialise(table.groupBy("side", "key").count().where(F.col("count") > largest_bucket).select("side", "key"), "hot-segments")
    ball = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(32)))
    has_hot = not hot.isEmpty()
    cold = table.join(hot, ["side", "key"], "left_anti") if has_hot else table
    probe = table.select(F.col("fp").alias("a"), "side", F.explode(F.transform(ball, lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
    found = probe.join(cold, ["side", "key"]).where((F.col("a") != F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= distance))
    out = found.select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    if has_hot:
        out = out.union(_chained(table, hot, distance))
    return out.distinct()


def _chained(table: DataFrame, hot: DataFrame, distance: int) -> DataFrame:
    """For distance 3 (less: the far points are fewer): edges from one near member of each point to all its members."""
    far_bits = max(distance - 1, 0)
    masks = lambda most: [sum(1 << b for b in c) for n in range(most + 1) for c in itertools.combinations(range(32), n)]
    one, two = masks(min(1, distance)), masks(far_bits)
    other = F.when(F.col("side") == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32)).alias("other")
    table = table.select("fp", "side", "key", other)
    far = table.join(hot, ["side", "key"]).select("side", "key", F.explode(F.transform(F.array(*map(F.lit, two)).cast("array<long>"), lambda m: F.col("other").bitwiseXOR(m))).alias("other"), "fp", F.lit(False).alias("near"))
    inside = table.join(hot, ["side", "key"]).select("side", "key", F.explode(F.transform(F.array(*map(F.lit, one)).cast("array<long>"), lambda m: F.col("other").bitwiseXOR(m))).alias("other"), "fp", F.lit(True).alias("near"))
    beside = table.select("fp", "side", F.explode(F.transform(F.array(*map(F.lit, one[1:])).cast("array<long>"), lambda m: F.col("key").bitwiseXOR(m))).alias("key"), "other").join(hot, ["side", "key"]).select("side", "key", "other", "fp", F.lit(True).alias("near"))
    named = far.union(inside).union(beside)
    hub = named.where("near").groupBy("side", "key", "other").agg(F.min("fp").alias("hub"))
    return named.join(hub, ["side", "key", "other"]).where("fp != hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))


def components(edges: DataFrame, *, at_once: int = 0) -> DataFrame:
    """(node, root): the smallest node of each connected component, for all nodes with an edge (a, b).

    Alternating large-star and small-star steps, each written to the shared folder, until all that is
    left are stars.  A node's least neighbour is an aggregate and joined back, so that a hub with very many
    neighbours is reduced before it moves, and its join can be split.  Up to at_once different edges are
    connected on the driver instead, 16 bytes each: a step has some 1,500 tasks over 211 partitions, however few they are.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    if at_once and now.count() <= at_once:
        few = now.toArrow()
        discard(now)
        node, root = _rooted(few.column("a").to_numpy(), few.column("b").to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"node": node, "root": root}), "node long, root long")
    while True:
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("hub")).union(now.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub")).where("leaf + hub > 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        old, now = now, materialise(small.distinct(), "edges")
        discard(old)


def _rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, sorted, and the smallest node of each one's component: larger roots hang on smaller ones until no edge joins two."""
    node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while (root[x] != root[y]).any():
        p, q = root[x], root[y]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    return node, node[root]


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links) of every row.

    Rows with equal fingerprints are one node, however many they are.  Null and empty texts have
    fingerprint zero, which links like any other.  A null doc_id never names a component unless all of
    its members' are null.  Repeated rows stay.
    """
    marked = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = materialise(nodes, "nodes")
    root = materialise(components(links(nodes.select("fp"), distance=distance)), "roots")
    rooted = nodes.join(root, nodes.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@without_shuffles
def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, sample_share: float = 0.1, group: int = 4, distance: int = 3, at_once: int = 250_000) -> DataFrame:
    """The rows of docs without near-duplicates: of each group of linked rows the one with the smallest id stays, and rows without an id.

    Two texts are linked if their distinct shingles of `words` words (fewer words: the whole sequence) have a
    Jaccard similarity of at least `similarity`.  Texts with equal sets are one node, null and empty texts too;
    different texts that share an id are different nodes.

    Candidates come from fingerprints first: each set has a SimHash, links() finds those within `distance` bits, and
    a node meets the smallest one of its fingerprint and of the least fingerprint near it.  Pairs whose shingles prove
    them alike are contracted.  Sets that alike can differ by more bits, so an exact way for the rest follows, which
    pairs only what fingerprints have not joined, and no link is lost.  Its candidates come from prefixes: with all sets sorted in one order (rare in a sample first, then by hash), two linked sets share one of their first
    n - similarity * n + 1 shingles, however long they are.  Prefix shingles that one document alone holds are
    left out by their counts.  Bounds that no link can break (sizes, places in the order, and how many bits of
    the sets' parities differ) drop most candidates, and the rest are compared shingle by shingle.

    The smallest node of a shingle meets all others; then what is linked is contracted, and the nodes outside of
    the shingle's largest component (about `group` of them in the first such round, four times as many in each
    later one, the same ones in all shingles of one size) meet all nodes of other components.  A shingle is done when one component holds all that are left.
    at_once: see components().
    """
    rows = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    spark = docs.sparkSession
    folds = [f"p{k}" for k in range(FOLDS)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=500_000):
            sets = shingle_sets(batch_texts(batch), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(_digest, sets), pa.binary()), pa.array(map(len, sets), pa.int32()), pa.array(map(_parity, sets), pa.binary()), pa.array(map(_simhash, sets), pa.int64()), *_folded(sets)], names=["doc_id", "digest", "n", "parity", "fp", *folds])

    marks = materialise(rows.mapInArrow(mark, "doc_id long, digest binary, n int, parity binary, fp long" + "".join(f", {c} long" for c in folds)), "shingle-sets")
    nodes = marks.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "parity", "fp", *folds)))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    least = similarity / (1 + similarity)  # the share of both sizes that linked sets have in common

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (1 - 2 * least) * (batch.column("m").to_numpy() + batch.column("n").to_numpy()) + 1e-6
            ok = [_differing(p.as_buffer(), q.as_buffer()) <= d for p, q, d in zip(batch.column("p"), batch.column("q"), most.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def bounded(met: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and parities allow a link."""
        x = nodes.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("parity").alias("p")).hint("merge")
        y = nodes.select(F.col("node").alias("b"), "n", F.col("parity").alias("q")).hint("merge")
        both = met.join(x, "a").join(y, "b").where(F.least("m", "n") >= least * (F.col("m") + F.col("n")) - 1e-6)
        return both.select("a", "b", "m", "n", "p", "q").mapInArrow(near, "a long, b long")

    def candidates(table: DataFrame, leads: DataFrame) -> DataFrame:
        """Pairs a > b of a lead and a node of another component that share a key and pass the bounds."""
        leads = leads.select("key", F.col("node").alias("lead"), F.col("root").alias("lead_root"), F.col("n").alias("lead_n"), F.col("at").alias("lead_at"), *(F.col(c).alias(f"lead_{c}") for c in folds))
        enough = F.least(F.col("n") - F.col("at"), F.col("lead_n") - F.col("lead_at")) >= least * (F.col("n") + F.col("lead_n")) - 1e-6
        differing = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"lead_{c}"))) for c in folds), F.lit(0))
        few = differing <= (1 - 2 * least) * (F.col("n") + F.col("lead_n")) + 1e-6
        met = table.join(leads.hint("merge"), "key").where((F.col("root") != F.col("lead_root")) & enough & few)
        return bounded(met.select(F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b")).distinct())

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = _unpacked(x), _unpacked(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are alike; their texts are found again through a bitmap of fixed size."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        ends = materialise(ends.hint("merge").join(nodes.select("node", "doc_id", "digest"), "node"), "compared")
        asked = spark.sparkContext.broadcast(Bits(bitmap(ends.select(F.xxhash64("doc_id")))))
        texts = rows.withColumn("h", F.xxhash64("doc_id")).mapInArrow(_sets_of(asked, words), "doc_id long, digest binary, grams binary")
        sets = texts.groupBy("doc_id", "digest").agg(F.first("grams").alias("grams")).join(ends.hint("merge"), ["doc_id", "digest"])
        sets = materialise(sets.select("node", "grams"), "compared-sets")
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        found = materialise(both.mapInArrow(alike, "a long, b long"), "links")
        discard(ends, sets)
        asked.destroy()
        del ends, sets, texts, both
        _free_broadcasts(spark)
        return found

    fps = materialise(nodes.groupBy("fp").agg(F.min("node").alias("hub")), "fingerprints")
    close = materialise(links(fps.select("fp"), distance=distance), "close-fingerprints")
    nearest = close.union(close.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
    met = nearest.join(fps.toDF("a", "x").hint("merge"), "a").join(fps.toDF("b", "y").hint("merge"), "b").select("x", "y")
    met = met.union(nodes.select("fp", "node").join(fps.hint("merge"), "fp").where("node != hub").select("node", "hub"))
    pairs = materialise(bounded(met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()), "pairs")
    found = linked(pairs)
    roots = materialise(components(found, at_once=at_once), "roots")
    discard(fps, close, pairs)

    order = spark.sparkContext.broadcast(_common_shingles(rows, words, sample_share))  # of a fixed size

    def prefix(s: np.ndarray) -> np.ndarray:
        known, often, repeated = order.value
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        by = np.lexsort((mix(s), np.where(known[at] == s, often[at], in_bitmap(repeated.bits, s))))
        return s[by[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=500_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([prefix(s) for s in shingle_sets(batch_texts(batch), words)]).view(np.int64))], names=["key"])

    shared = rows.select("text").mapInArrow(keys, "key long").groupBy("key").count().where("count > 1")
    often = spark.sparkContext.broadcast(Bits(bitmap(shared)))  # of a fixed size

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=500_000):
            digests, keys, places = [], [], []
            for s in shingle_sets(batch_texts(batch), words):
                p = prefix(s)
                at = np.flatnonzero(in_bitmap(often.value.bits, p))
                digests.append(_digest(s))
                keys.append(p[at].view(np.int64))
                places.append(at.astype(np.int32))
            each = pa.StructArray.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))], names=["key", "at"])
            found = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), found], names=["doc_id", "digest", "found"])

    of_node = rows.mapInArrow(entries, "doc_id long, digest binary, found array<struct<key: long, at: int>>").where("size(found) > 0").groupBy("doc_id", "digest").agg(F.first("found").alias("found"))
    of_node = of_node.join(nodes.select("doc_id", "digest", "node", "n", *folds).hint("merge"), ["doc_id", "digest"]).select("node", "n", *folds, F.explode("found").alias("e"))
    table = materialise(of_node.select("e.key", "node", "n", "e.at", *folds), "prefixes")
    order.destroy()
    often.destroy()
    per_key = table.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("first")).where("many > 1")
    before = table
    table = table.join(per_key.hint("merge"), "key").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    table = materialise(table, "shared-prefixes")
    discard(before)
    leads = table.where(F.col("node") == F.col("first"))
    left = table.where((F.col("many") > 2) & (F.col("node") != F.col("first")))
    while True:
        pairs = materialise(candidates(table, leads), "pairs")
        found = linked(pairs)
        discard(pairs)
        if not found.isEmpty():
            old, roots = roots, materialise(components(roots.toDF("a", "b").union(found), at_once=at_once), "roots")
            discard(old)
        if left.isEmpty():
            break
        left = left.select("key", "node", "n", "at", *folds).join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        before, left = table, materialise(left, "unmet")
        discard(before)
        parts = left.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("parts"), (F.sum("c") - F.max("c")).alias("rest")).where("parts > 1")
        before, table = left, materialise(left.join(parts.hint("merge"), "key").withColumn("leads", (F.col("root") != F.col("main")) & (F.shiftrightunsigned(F.xxhash64("node"), 1).cast("double") < group * 2.0**63 / F.col("rest"))), "shared-prefixes")
        discard(before)
        leads, left = table.where("leads"), table.where(F.col("rest") > group).where("not leads")
        group *= 4
    discard(table)
    owner = marks.select("doc_id", "digest").distinct().join(nodes.select("digest", "node").hint("merge"), "digest").join(roots.hint("merge"), "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))
    owner = materialise(owner, "owners")
    stays = owner.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("stays"))
    gone = materialise(owner.join(stays.hint("merge"), "root").where(F.struct("doc_id", "digest") != F.col("stays")).select("doc_id", "digest"), "gone")
    again = not marks.groupBy("doc_id").count().where("count > 1").isEmpty()
    discard(roots, owner, nodes)
    names = [f"_c{k}" for k in range(len(docs.columns))]
    named = docs.toDF(*names)
    id_at = names[docs.columns.index(id_col)]
    if not again:
        ids = gone.select(F.col("doc_id").alias("_gone"))  # they grow with the documents; the plan is the same at every size
        return named.join(ids.hint("merge"), F.col(id_at).cast("long") == F.col("_gone"), "left_anti").toDF(*docs.columns)
    told = map_rows(named, _add_digest(docs.columns.index(text_col), words), T.StructField("_digest", T.BinaryType()))
    left = told.join(gone.toDF("_gone", "_gone_digest").hint("merge"), (F.col(id_at).cast("long") == F.col("_gone")) & (F.col("_digest") == F.col("_gone_digest")), "left_anti")
    kept = left.where(F.col(id_at).isNotNull()).dropDuplicates([id_at, "_digest"]).unionByName(left.where(F.col(id_at).isNull()))
    return kept.drop("_digest").toDF(*docs.columns)


def _free_broadcasts(spark: SparkSession) -> None:
    """What joins have sent to the executors goes once the driver's garbage is collected; else it piles up over the rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles (fewer words: one, of the whole sequence); A-Z count as a-z."""
    data = [t.encode("utf-8", "replace").lower() for t in texts]
    starts, h, _ = word_hashes(b"\n".join(data))
    borders = np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in data)])).tolist()

    def chained(size: int) -> np.ndarray:
        out = np.full(max(len(h) - size + 1, 0), size, np.uint64)
        for j in range(size):
            out = mix(out * BASE + h[j : j + len(out)])
        return out

    every, short, sets = chained(words), {}, []
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        if b - a >= words:
            s = np.sort(every[a : b - words + 1])
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            sets.append(s[new])
        else:
            if b - a not in short:
                short[b - a] = chained(b - a) if b > a else np.zeros(len(h) + 1, np.uint64)
            sets.append(short[b - a][a : a + 1].copy())
    return sets


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _simhash(s: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the set's hashes."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(s), 4096):
        count += np.unpackbits(s[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(s)).view(">i8")[0])


def _parity(s: np.ndarray) -> bytes:
    """For each low end of the hashes, in as many bits as two for each shingle need (1,024 at least), whether an odd number has it."""
    size = max(1024, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) % 2 == 1, bitorder="little").tobytes()


def _folded(sets: list[np.ndarray]) -> list[pa.Array]:
    """The parities of the sets in FOLDS longs each, which tell most short sets apart where they meet."""
    low = [np.bincount((s & np.uint64(64 * FOLDS - 1)).astype(np.int64), minlength=64 * FOLDS) % 2 == 1 for s in sets]
    words = np.packbits(np.array(low, bool).reshape(len(sets), FOLDS, 64), axis=2, bitorder="little").reshape(len(sets), FOLDS * 8).view("<i8")
    return [pa.array(np.ascontiguousarray(words[:, k])) for k in range(FOLDS)]


def _differing(p: pa.Buffer, q: pa.Buffer) -> int:
    """In how many bits two parities differ, the longer folded to the shorter; never more than the shingles that one set alone has."""
    x, y = (np.frombuffer(z, np.uint64) for z in (p, q))
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) if len(z) > size else z for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, which tell a pair's shingles apart and take less to move."""
    return np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpacked(data: pa.BinaryScalar) -> np.ndarray:
    six = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, 2:] = six
    return out.view("<u8").ravel()


def _common_shingles(rows: DataFrame, words: int, share: float, most: int = 200_000) -> tuple[np.ndarray, np.ndarray, Bits]:
    """What only sets the order of prefixes, from a share of the documents (by a hash of the id): the `most` most frequent shingles, sorted, how many documents hold each, and a bitmap of all that two or more hold."""
    rows = rows.where(below(max(1, int(share * 2**62)), "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=500_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(batch_texts(batch), words)).view(np.int64))], names=["key"])

    counted = materialise(rows.mapInArrow(run, "key long").groupBy("key").count().where("count > 1"), "repeated-shingles")
    often = counted.orderBy(F.desc("count"), "key").limit(most).toArrow()
    repeated = Bits(bitmap(counted.select("key")))
    discard(counted)
    known = often.column("key").to_numpy().view(np.uint64)
    order = np.argsort(known)
    return np.append(known[order], np.uint64(2**64 - 1)), np.append(often.column("count").to_numpy()[order], 0), repeated


def _sets_of(asked, words: int):
    """doc_id, digest and packed set of the rows whose hash `h` is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=500_000):
            batch = batch.filter(pa.array(in_bitmap(asked.value.bits, batch.column("h").to_numpy())))
            sets = shingle_sets(batch_texts(batch), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(_digest, sets), pa.binary()), pa.array(map(_packed, sets), pa.binary())], names=["doc_id", "digest", "grams"])

    return run


def _add_digest(at: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}", limit=500_000):
            digests = pa.array(map(_digest, shingle_sets(batch_texts(batch, f"c{at}"), words)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], names=[f"c{k}" for k in range(batch.num_columns + 1)])

    return run
