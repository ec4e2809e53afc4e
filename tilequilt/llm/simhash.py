"""SimHash near-duplicate classes.

Fingerprints are made in Arrow batches; links between fingerprints are found with pivot distance tables: each bucket
of fingerprints holds their Hamming distances to many reference fingerprints, pairs whose coordinates differ by more
than the radius are discarded (by the triangle inequality they can't be within it), and the survivors are verified.

Pivot distances alone can't bring pairs together without comparing all with all (random 64-bit words lie at nearly
the same distance from any pivot), so buckets come from an exact pigeonhole key: of 5 bit blocks at most 3 differ, so
two agree. A bucket over BLOCK fingerprints is cut into blocks and each pair of blocks is a group of its own, so no
task holds an unbounded bucket and no link is lost. A group puts out a star per local class, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, hot_join, in_arrow, staged, text_bytes
from .components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
PIVOTS = 16
#: Fingerprints in one block of a bucket.
BLOCK = 2048
#: Bit widths of the five blocks of a fingerprint.
WIDTHS = (13, 13, 13, 13, 12)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """n fixed reference fingerprints, from a rule."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i) for i in range(n)], dtype=np.uint64)


def majority(hashes: bytes) -> int:
    """The 64-bit word whose bits are set in over half of the hashes, of eight bytes each, highest first."""
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 255 * 255  # so many ones fit a byte
    votes = np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(bits)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 text: A-Z lower-cased, ASCII-space words, shingles with repeats, bit set if in over half."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return majority(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.fromiter((fingerprint(t) for t in text_bytes(batch.column("text"))), np.uint64, batch.num_rows)
        yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(marks.view(np.int64))], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; a null text counts as empty and has fingerprint 0."""
    rows = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return in_arrow(rows, _fingerprints, "doc_id long, text_hash long, fp long")


def _masks() -> list[int]:
    at = np.cumsum((0, *WIDTHS)).tolist()
    parts = [((1 << w) - 1) << a for a, w in zip(at, WIDTHS, strict=False)]
    signed = [a | b for a, b in combinations(parts, len(WIDTHS) - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in signed]


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of linked positions in place; a class is named by its smallest position."""
    while len(a):
        la, lb = labels[a], labels[b]
        on = la != lb
        a, b, la, lb = a[on], b[on], la[on], lb[on]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (nxt := labels[labels]).tolist() != labels.tolist():
            labels[:] = nxt


def links_within(fps: np.ndarray, table: np.ndarray, refs: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Labels of fps (sorted distinct uint64) by links of at most radius bits: the pivot table discards, popcount verifies."""
    labels = np.arange(len(fps))
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0].astype(np.int64)
    until = np.searchsorted(first, first + radius, side="right")
    step = max(1, (1 << 18) // max(1, len(fps)))
    for lo in range(0, len(fps), step):
        rows = np.arange(lo, min(lo + step, len(fps)))
        span = until[rows] - rows - 1
        i = np.repeat(rows, span)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(span) - span, span)
        i, j = order[i], order[j]
        for p in range(1, table.shape[1]):
            near = np.abs(table[i, p] - table[j, p]) <= radius
            i, j = i[near], j[near]
            if not len(i):
                break
        true = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        _settle(labels, i[true], j[true])
    return labels


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    refs = pivots()
    for batch in batches:
        column = batch.column("fps")
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        table = np.empty((len(flat), len(refs)), np.int8)
        for i, ref in enumerate(refs):  # one pivot at a time: eight bytes a fingerprint for a while
            table[:, i] = np.bitwise_count(flat ^ ref)
        cuts = np.cumsum([0, *column.value_lengths().to_pylist()]).tolist()
        us, vs = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a == 2:  # most buckets
                if np.abs(table[a] - table[a + 1]).max() <= RADIUS and int(flat[a] ^ flat[a + 1]).bit_count() <= RADIUS:
                    us.append(flat[a : a + 1])
                    vs.append(flat[a + 1 : b])
                continue
            labels = links_within(flat[a:b], table[a:b], refs)
            moved = np.flatnonzero(labels != np.arange(b - a))
            us.append(flat[a:b][labels[moved]])
            vs.append(flat[a:b][moved])
        none = np.empty(0, np.uint64)
        yield pa.record_batch([pa.array(np.concatenate([none, *x]).view(np.int64)) for x in (us, vs)], names=["u", "v"])


def star_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct fps (fp) -> links (u, v) with the same connected classes as all pairs within RADIUS."""
    keys = F.array(*(F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(_masks())))
    keyed = fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.k", "x.part")
    shared = staged(keyed.groupBy("k", "part").agg(F.count("*").alias("times")).where("times > 1").withColumn("count", F.col("times")))
    rows = hot_join(keyed, shared, ["k", "part"], ["fp"]).withColumn("nb", F.ceil(F.col("count") / F.lit(block)).cast("int")).withColumn("b", F.pmod(F.xxhash64("fp", "k"), "nb").cast("int"))
    rows = rows.select("k", "part", "fp", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    groups = rows.groupBy("k", "part", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")).agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    return in_arrow(groups.select("fps"), _stars, "u long, v long").distinct()


def named_classes(marks: DataFrame, key: str, links) -> DataFrame:
    """(doc_id, text_hash, key, component_id, keeper_hash) of staged marks (doc_id, text_hash, key), by links of keys.

    links makes links (u, v) of the distinct keys; see simhash_classes for the names.
    """
    reps = staged(marks.groupBy(key).agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("first"), F.min("text_hash").alias("least_hash")))
    found = components(links(reps.select(key)))
    classed = reps.join(found.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))
    names = classed.groupBy("component").agg(F.min("first").alias("first"), F.min("least_hash").alias("least_hash"))
    named = classed.select(key, "component").join(names, "component")
    named = named.select(key, F.col("first.doc_id").alias("component_id"), F.coalesce("first.text_hash", "least_hash").alias("keeper_hash"))
    return marks.join(named, key).select("doc_id", "text_hash", key, "component_id", "keeper_hash")


def simhash_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, keeper_hash) of every row of docs.

    component_id is the smallest doc_id reachable over links of at most 3 bits; (component_id, keeper_hash) names the
    one row of the class that a filter keeps. Null or empty texts have fingerprint 0 and link like any other. Rows with
    a null doc_id belong to their class but never name it (component_id is null if all its ids are null). Repeated rows
    each come back. An empty table gives an empty one. Extra columns are ignored.
    """
    return named_classes(staged(fingerprints(docs)), "fp", star_links)


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs with the row of each class that (component_id, keeper_hash) names; of rows equal in doc_id and text one stays."""
    keep = classes.select(F.col("component_id").alias("keep_id"), F.col("keeper_hash").alias("keep_hash")).distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("hash"))
    kept = rows.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("hash") == F.col("keep_hash")), "left_semi")
    return kept.dropDuplicates(["id", "hash"]).select("row.*")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each SimHash class: that with the smallest doc_id, then the smallest text hash.

    Of rows equal in doc_id and text one stays. Columns are those of docs.
    """
    return keep_one(docs, simhash_classes(docs))
