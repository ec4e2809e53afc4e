"""Near-duplicate documents by SimHash, verified and made whole: five-word shingles, Jaccard similarity of 0.8 or more.

SimHash comes first: nodes whose fingerprints (over their five-word shingles) operator 5's pivot tables link are
verified on their sets, and the classes they make are not looked into again. No SimHash radius can do this whole: at a
similarity of 0.8 two 64-bit fingerprints lie about 10 bits apart, with a spread of 3, and pigeonhole keys for 16 bits
and more would be tens of thousands a document. An exact join by prefixes finds the links between what is left apart:
with the shingles of all documents in one order, two sets of similarity 0.8 share one of the first n - ceil(0.8 n) + 1
of each. That holds for every order; here common shingles (found on a sample, which only sets the order) come last.

Documents with the same set are one node. Of the join, stars come first: in each bucket (nodes with a prefix shingle in
common) each node is compared with one other, so that dense groups become one class; then all pairs of a bucket that are still in
different classes are compared. Pairs whose bitmaps rule the similarity out are discarded (a bit set in one and not in
the other is a shingle the other lacks), the rest are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, columns, hot_join, in_arrow, staged, text_bytes, unstage
from .components import components
from .simhash import _LOWER, keep_one, majority, named_classes, star_links

SHINGLE = 5
#: Least Jaccard similarity, as a fraction.
SIMILARITY = (4, 5)
SEED = 42
#: One document in so many is counted for the order; a shingle in at least COMMON of those is common, the first COMMON_MOST count.
SAMPLE, COMMON, COMMON_MOST = 32, 8, 100_000
#: Shared shingles or documents up to this number are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of UTF-8 text (A-Z lower-cased, ASCII-space words); of fewer words than SHINGLE, one of all."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64).view(np.int64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64).view(np.int64))


def fingerprint(found: np.ndarray) -> int:
    """64-bit SimHash of distinct shingles; 0 without any."""
    return majority(found.astype(">i8").tobytes())


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of n sorted shingles, those in common (sorted) last."""
    if not len(found):
        return found
    a, b = SIMILARITY
    most = len(found) + a * -len(found) // b + 1
    if len(common):
        last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate([found[~last], found[last]])
    return found[:most]


def bitmap(found: np.ndarray) -> np.ndarray:
    """Bits at the low bits of the shingles, in a power of two of bits, at least two a shingle, as 64-bit words."""
    size = max(64, 1 << (2 * len(found) - 1).bit_length()) if len(found) else 64
    on = np.zeros(size, bool)
    on[found & (size - 1)] = True
    return np.packbits(on, bitorder="little").view("<i8")


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *values])))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in chunks(text_bytes(batch.column("text"))):
            yield pa.record_batch([batch.column("text_hash").slice(begin, len(texts)), _lists([shingles(t) for t in texts])], names=["text_hash", "shingles"])


def _marks(common: np.ndarray):
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks(text_bytes(batch.column("text"))):
                found = [shingles(t) for t in texts]
                nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], np.uint64).view(np.int64)
                ids, hashes = (batch.column(c).slice(begin, len(texts)) for c in ("doc_id", "text_hash"))
                prints = np.fromiter(map(fingerprint, found), np.uint64, len(found)).view(np.int64)
                arrays = [ids, hashes, pa.array(nodes), pa.array([len(x) for x in found], pa.int32()), pa.array(prints), _lists([prefix(x, common) for x in found]), _lists([bitmap(x) for x in found])]
                yield pa.record_batch(arrays, names=["doc_id", "text_hash", "node", "n", "fp", "prefix", "bits"])

    return marks


def common_shingles(rows: DataFrame) -> np.ndarray:
    """Shingles in many documents of a sample of the texts, at most COMMON_MOST, sorted."""
    some = rows.where(F.pmod("text_hash", F.lit(SAMPLE)) == 0).select("text_hash", "text")
    some = in_arrow(some, _sets, "text_hash long, shingles array<long>")
    times = some.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().where(F.col("count") >= COMMON)
    return np.sort(np.array([r.shingle for r in times.orderBy(F.desc("count"), "shingle").limit(COMMON_MOST).collect()], np.int64))


def _hopeful(a: str, b: str) -> Column:
    """If two prefix entries (n, pos), of one shingle, may belong to sets as similar as asked: by lengths and places.

    Of the first shingle two sets share, min(n - pos) bounds the overlap; pairs that fail only at later ones have met there.
    """
    p, q = SIMILARITY
    na, nb = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    return F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos")) * (p + q) >= (na + nb) * p


def _folded(bits: Column, other: Column) -> Column:
    """bits at the size of other, where that is half: sets of similar sizes are at most a doubling apart."""
    half = F.size(other)
    return F.when(F.size(bits) > half, F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseOR(y))).otherwise(bits)


def _lacking(a: Column, b: Column) -> Column:
    """Bits of a that b lacks."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda acc, x: acc + x)


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs (u, v: nodes, of sizes that _hopeful lets pass) without those whose bitmaps rule the similarity out; staged."""
    marks = nodes.select("node", "n", "bits")
    both = pairs.distinct().join(marks.toDF("u", "un", "ub"), "u").join(marks.toDF("v", "vn", "vb"), "v")
    both = both.select("u", "v", "un", "vn", _folded(F.col("ub"), F.col("vb")).alias("ub"), _folded(F.col("vb"), F.col("ub")).alias("vb"))
    p, q = SIMILARITY
    least = (F.col("un").cast("long") + F.col("vn")) * p
    near = ((F.col("un") - _lacking(F.col("ub"), F.col("vb"))) * (p + q) >= least) & ((F.col("vn") - _lacking(F.col("vb"), F.col("ub"))) * (p + q) >= least)
    return staged(both.where(near).select("u", "v"))


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of staged pairs (u, v: nodes) whose sets have a Jaccard similarity of at least SIMILARITY; staged."""
    kept = staged(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "least_hash"), "node"))
    wanted = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    texts = rows.select("text_hash", "text").join(wanted.select(F.col("least_hash").alias("text_hash")).distinct(), "text_hash", "left_semi")
    sets = in_arrow(texts, _sets, "text_hash long, shingles array<long>").join(wanted, F.col("text_hash") == F.col("least_hash"))
    sets = staged(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))
    both = pairs.join(sets.toDF("u", "us"), "u").join(sets.toDF("v", "vs"), "v")
    p, q = SIMILARITY
    found = staged(both.where(F.size(F.array_intersect("us", "vs")) * (p + q) >= (F.size("us") + F.size("vs")) * p).select("u", "v"))
    unstage(kept, sets, pairs)
    return found


def simhash_links(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (u, v) of SIMILARITY and more between nodes whose fingerprints simhash.star_links links, or are equal; staged.

    A node is compared with the least one of its fingerprint, and that with those of the fingerprints linked to it.
    """
    hub = F.struct("node", "n", F.lit(0).alias("pos"))
    heads = staged(nodes.groupBy("fp").agg(F.min(hub).alias("b"), F.count("*").alias("times")))
    same = hot_join(nodes.select("fp", "node", "n"), heads, ["fp"], ["node"]).where("node <> b.node").select(hub.alias("a"), "b")
    far = star_links(heads.select("fp")).join(heads.select(F.col("fp").alias("u"), F.col("b").alias("a")), "u").join(heads.select(F.col("fp").alias("v"), "b"), "v").select("a", "b")
    pairs = same.unionByName(far).where(_hopeful("a", "b")).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))
    pairs = possible(pairs, nodes)
    unstage(heads)
    return verified(pairs, nodes, rows)


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) that staged links leave in different classes."""
    label = components(links)
    if links.count() <= BROADCAST_ROWS:
        label = F.broadcast(label)
    both = pairs.distinct().join(label.toDF("u", "uc"), "u", "left").join(label.toDF("v", "vc"), "v", "left")
    return both.where(F.coalesce("uc", "u") != F.coalesce("vc", "v")).select("u", "v")


def similar_links(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (u, v) between nodes (node, least_hash, n, fp, prefix, bits) with the same classes as all pairs of SIMILARITY and more."""
    near = simhash_links(nodes, rows)
    keyed = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    shared = staged(keyed.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1").select("shingle"))
    met = staged(keyed.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, "shingle"))
    unstage(shared)
    hub = F.struct("node", "n", "pos")
    hubs = met.groupBy("shingle").agg(F.min_by(hub, F.xxhash64("node", "shingle")).alias("b"))
    stars = met.withColumn("a", hub).join(hubs, "shingle").where("a.node <> b.node").where(_hopeful("a", "b"))
    hopeful = possible(_apart(stars.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")), near), nodes)
    # Two stars a node are enough to make dense groups one class; the rest is left to the pairs between classes.
    stars = hopeful.groupBy("u").agg(F.array_distinct(F.array(F.min("v"), F.max("v"))).alias("vs")).select("u", F.explode("vs").alias("v"))
    stars = verified(staged(stars), nodes, rows)
    unstage(hopeful)
    label = components(near.unionByName(stars))
    classed = met.join(label, "node", "left").withColumn("class", F.coalesce("component", "node"))
    mixed = classed.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("shingle")
    left = staged(classed.join(mixed, "shingle").select("shingle", "class", hub.alias("a")))
    unstage(met)
    other = left.select("shingle", F.col("class").alias("other"), F.col("a").alias("b"))
    pairs = left.join(other, "shingle").where(F.col("class") < F.col("other")).where(_hopeful("a", "b"))
    rest = possible(pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")), nodes)
    unstage(left)
    return near.unionByName(stars).unionByName(verified(rest, nodes, rows))


def similar_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, component_id, keeper_hash) of every row of docs, by links of SIMILARITY and more.

    Ids, nulls and repeated rows are as in simhash.simhash_classes. Texts without a word are copies of each other.
    """
    rows = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    common = common_shingles(rows)
    wide = staged(in_arrow(rows, _marks(common), "doc_id long, text_hash long, node long, n int, fp long, prefix array<long>, bits array<long>"))
    nodes = staged(wide.groupBy("node").agg(F.min("text_hash").alias("least_hash"), *(F.first(c).alias(c) for c in ("n", "fp", "prefix", "bits"))))
    marks = staged(wide.select("doc_id", "text_hash", "node"))
    unstage(wide)
    classes = named_classes(marks, "node", lambda reps: similar_links(nodes, rows))
    unstage(nodes)  # the links found by them are staged, and so are their classes
    return classes


def drop_similar(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of similar texts, as simhash.drop_near_copies chooses it. Columns are those of docs."""
    return keep_one(docs, similar_classes(docs))
