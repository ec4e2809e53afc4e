"""Near-duplicate line removal by a deletion-neighbourhood join.

Lines are compared as sequences of units: words (runs of anything but ASCII space) if a line has at least LEAST of
them, code points of the line (its words joined by one space) if it has fewer, as short lines and those in scripts
without spaces do. The edit bound is one unit, and at most a fifth of a line (a similarity of 0.8), so lines of fewer
than LEAST code points match only if they are equal, and so do two lines of different units.

Every line puts out the hash of itself and of each variant with one unit left out. Lines with one variant at one gap
differ by a replaced unit; a line that equals another's variant lacks one unit of it. Such pairs are joined, their
units are compared, and a line with an earlier match goes.

Equal lines are told by a 128-bit hash of the whole line. Hashes of variants are polynomials over 64-bit unit hashes
modulo two primes, so all variants of a line cost as much as the line. Before variants are made, an exact filter leaves
lines without a possible partner out: one edit leaves the first or the last half of a line whole, so a line none of
whose halves recurs has no match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, columns, hot_join, in_arrow, staged, text_bytes

#: Units that one edit needs, so that it leaves a similarity of 0.8; also the least words for words to be the units.
LEAST = 5
#: Units whose hashes a worker remembers.
REMEMBERED = 100_000
#: (modulus, base): two primes below 2**31, so that products fit 64 bits, and bases of high order.
FIELDS = ((2147483647, 16807), (2147483629, 48271))
_PLACE = "struct<last:boolean,doc_id:bigint,text_hash:bigint,pos:int>"


class Hashes(dict):
    """unit -> its 64-bit hash; words are bytes and code points strings, which hash apart."""

    def __missing__(self, unit: bytes | str) -> int:
        out = xxhash.xxh64_intdigest(unit, 1) if isinstance(unit, bytes) else xxhash.xxh64_intdigest(unit.encode("utf-8", "surrogateescape"), 2)
        self[unit] = out
        return out

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()


def units(line: bytes, words: list[bytes]) -> list:
    """The units of a line, given with its words."""
    return words if len(words) >= LEAST else list(line.decode("utf-8", "surrogateescape"))


def _powers(base: int, p: int, n: int) -> np.ndarray:
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, p)) % np.uint64(p)
        k *= 2
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sequences:
    """Consecutive sequences of units (their hashes, and the length of each) with polynomial sums over them."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray) -> None:
        self.n, self.end = n, np.cumsum(n)
        self.first = self.end - n
        self.parts = []
        for p, base in FIELDS:
            q = np.uint64(p)
            sums = np.zeros(len(hashes) + 1, np.uint64)
            np.add.accumulate(hashes % q * _powers(base, p, len(hashes)) % q, out=sums[1:])
            self.parts.append((q, sums, _powers(pow(base, -1, p), p, len(hashes) + 2)))

    def span(self, a: np.ndarray, b: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Hashes of the units [a, b), as if each began a sequence."""
        hi, lo = ((s[b] - s[a]) % q * down[a] % q for q, s, down in self.parts)
        return _mixed((hi << np.uint64(31) | lo) ^ _mixed(salt.astype(np.uint64)))

    def wholes(self) -> np.ndarray:
        return self.span(self.first, self.end, self.n)

    def variants(self) -> np.ndarray:
        """For each unit the hash of its sequence without it, comparable with wholes()."""
        first, end, at = np.repeat(self.first, self.n), np.repeat(self.end, self.n), np.arange(int(self.n.sum()))
        hi, lo = (((s[at] - s[first]) % q + (s[end] - s[at + 1]) % q * down[1] % q) % q * down[first] % q for q, s, down in self.parts)
        return _mixed((hi << np.uint64(31) | lo) ^ _mixed((np.repeat(self.n, self.n) - 1).astype(np.uint64)))

    def half_keys(self) -> np.ndarray:
        """[sequence, 4]: hashes of the first and last half for a partner of equal or greater length, then a unit shorter."""
        out = []
        for c in (self.n, self.n - 1):
            half = c // 2
            for side, (a, b) in enumerate(((self.first, self.first + half), (self.end - (c - half), self.end))):
                out.append(self.span(a, b, c * 4 + 2 + side + (1 << 40)))
        return np.stack(out, axis=1)


def lines_of(texts: list[bytes]) -> Iterator[tuple[int, int, bytes, list[bytes]]]:
    """(text, place, line, words) of each line with a word; a line is its words joined by one space."""
    for i, text in enumerate(texts):
        for pos, raw in enumerate(text.split(b"\n")):
            if words := raw.split():
                yield i, pos, b" ".join(words), words


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Hashes()
    for batch in batches:
        for begin, texts in chunks(text_bytes(batch.column("text"))):
            rows, places, keys, n, all_units = [], [], [], [], []
            for i, pos, line, words in lines_of(texts):
                rows.append(begin + i)
                places.append(pos)
                keys.append(xxhash.xxh3_128_digest(line))
                some = units(line, words)
                if len(some) >= LEAST:
                    all_units += some
                n.append(len(some))
            n = np.array(n, np.int64)
            near = n >= LEAST
            halves = Sequences(np.fromiter(map(known.__getitem__, all_units), np.uint64, len(all_units)), n[near]).half_keys().view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(near, 4, 0))]).astype(np.int32)
            rows = pa.array(rows, pa.int64())
            yield pa.record_batch([batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(places, pa.int32()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(halves.ravel()))], names=["doc_id", "text_hash", "pos", "line", "halves"])
            known.trim()


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in chunks(text_bytes(batch.column("text"))):
            some = [line for _, _, line, words in lines_of(texts) if len(words) >= LEAST or len(line.decode("utf-8", "surrogateescape")) >= LEAST]
            yield pa.record_batch([pa.array([xxhash.xxh3_128_digest(x) for x in some], pa.binary()), pa.array(some, pa.binary())], names=["line", "content"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each line its own hash (gap: null) and that of each variant with one unit left out (gap: its place)."""
    known = Hashes()
    for batch in batches:
        for begin, lines in chunks(batch.column("content").to_pylist(), 1 << 16):
            some = [units(x, x.split()) for x in lines]
            n = np.array([len(x) for x in some])
            seq = Sequences(np.fromiter((known[u] for x in some for u in x), np.uint64, int(n.sum())), n)
            gap = np.concatenate([np.arange(int(n.sum())) - np.repeat(seq.first, n), np.full(len(n), -1)])
            rows = pa.array(np.concatenate([np.repeat(np.arange(len(n)), n), np.arange(len(n))]) + begin)
            keys = np.concatenate([seq.variants(), seq.wholes()]).view(np.int64)
            yield pa.record_batch([batch.column("line").take(rows), batch.column("first").take(rows), pa.array(gap, pa.int32(), mask=gap < 0), pa.array(keys)], names=["line", "first", "gap", "variant"])
            known.trim()


def within_one_edit(a: list, b: list) -> bool:
    """If one inserted, deleted or replaced item turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    return head + tail >= n - (len(a) == len(b))


def match(a: bytes, b: bytes) -> bool:
    """If two lines (words joined by one space) are equal or within the edit bound, by their units themselves."""
    x, y = units(a, a.split()), units(b, b.split())
    return a == b or (min(len(x), len(y)) >= LEAST and type(x[0]) is type(y[0]) and within_one_edit(x, y))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [match(a, b) for a, b in zip(batch.column("content").to_pylist(), batch.column("other_content").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("line").filter(pa.array(ok, pa.bool_()))], names=["line"])


def near_lines(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """Hashes of the distinct lines (line) that an earlier line matches within the edit bound.

    firsts: staged (line, first, halves), first being the line's earliest place. Only lines with an earlier match come
    out. No key is met whole by one task: counts are combined before the shuffle, and hot keys are split (hot_join).
    """
    keyed = firsts.select("line", F.explode("halves").alias("half"))
    shared = staged(keyed.groupBy("half").agg(F.count("*").alias("times")).where("times > 1"))
    hopeful = hot_join(keyed, shared, ["half"], ["line"]).select("line").distinct()
    hopeful = staged(firsts.select("line", "first").join(hopeful, "line", "left_semi").withColumn("times", F.lit(1)))
    met = hot_join(in_arrow(columns(docs, "text"), _contents, "line binary, content binary"), hopeful, ["line"], ["line"])
    worded = staged(met.groupBy("line").agg(F.first("content").alias("content"), F.first("first").alias("first")))
    made = staged(in_arrow(worded, _variants, f"line binary, first {_PLACE}, gap int, variant long"))
    left_out, best = made.where("gap IS NOT NULL"), F.min(F.struct("first", "line")).alias("best")
    # Replaced units: lines with the same variant at the same gap. All match the earliest of them, so a star is whole.
    stars = staged(left_out.groupBy("variant", "gap").agg(best, F.count("*").alias("times")).where("times > 1"))
    replaced = hot_join(left_out, stars, ["variant", "gap"], ["line"]).where("line <> best.line").select("line", F.col("best.line").alias("other"))
    # Inserted units: a variant that is a line of its own. That line goes if the first of the longer ones is earlier,
    # and of the longer ones those go that are later.
    short = made.where("gap IS NULL").select("variant", F.col("line").alias("short"), F.col("first").alias("short_first"))
    short = staged(short.join(left_out.groupBy("variant").agg(best, F.count("*").alias("times")), "variant"))
    shorter = short.where("best.first < short_first").select(F.col("short").alias("line"), F.col("best.line").alias("other"))
    longer = hot_join(left_out, short.drop("best"), ["variant"], ["line"]).where("first > short_first").select("line", F.col("short").alias("other"))
    found = staged(replaced.unionByName(shorter).unionByName(longer).distinct())
    others = worded.select(F.col("line").alias("other"), F.col("content").alias("other_content")).join(found.groupBy("other").agg(F.count("*").alias("times")), "other")
    pairs = hot_join(found, staged(others), ["other"], ["line"], F.octet_length("other_content")).join(worded.select("line", "content"), "line")
    return in_arrow(pairs.select("line", "content", "other_content"), _verified, "line binary").distinct()


def line_report(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, removed): every line with a word, and those that go, of docs (doc_id, text).

    lines: (doc_id, text_hash, pos, line); removed: (doc_id, text_hash, pos, near). Lines are split at newlines and
    numbered from 0; earlier means smaller (doc_id, text_hash, pos), a null doc_id last. A line goes if an equal line
    (words alike, white space aside) or one within the edit bound is earlier, kept or not. Lines without a word stay.
    Rows that repeat in both doc_id and text are one document: what goes from one goes from all. Null texts have no
    lines; an empty table gives two empty tables.
    """
    rows = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    lines = staged(in_arrow(rows, _scan, "doc_id long, text_hash long, pos int, line binary, halves array<long>"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "pos")
    firsts = staged(lines.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.first("halves").alias("halves")))
    near = near_lines(firsts.select("line", "first", "halves"), docs).withColumn("near", F.lit(True))
    marked = staged(firsts.join(near, "line", "left").select("line", "first", "times", F.coalesce("near", F.lit(False)).alias("near")).where("times > 1 OR near"))
    met = hot_join(lines.drop("halves"), marked, ["line"], ["doc_id", "pos"])
    removed = met.where(F.col("near") | (place != F.col("first"))).select("doc_id", "text_hash", "pos", "near")
    return lines, removed.distinct()


def line_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_equal, n_near, removed) of every row of docs: lines with a word, how many go because an equal
    line or else only a near line is earlier, and the places of those that go (ascending). See line_report."""
    lines, removed = line_report(docs)
    by_doc = lines.groupBy("doc_id", "text_hash").agg(F.countDistinct("pos").alias("n_lines"))
    gone = removed.groupBy("doc_id", "text_hash").agg(F.sum((~F.col("near")).cast("long")).alias("n_equal"), F.sum(F.col("near").cast("long")).alias("n_near"), F.sort_array(F.collect_list("pos")).alias("removed"))
    ids = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"))
    a, b = by_doc.toDF("a_id", "a_hash", "n_lines"), gone.toDF("b_id", "b_hash", "n_equal", "n_near", "removed")
    out = ids.join(a, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_hash") == F.col("a_hash")), "left")
    out = out.join(b, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_hash") == F.col("b_hash")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_equal", zero).alias("n_equal"), F.coalesce("n_near", zero).alias("n_near"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def drop_near_lines(docs: DataFrame) -> DataFrame:
    """docs without the lines that go (see line_report); columns as those of docs, n_chars set anew where text changed.

    No row goes: a row all of whose lines go has an empty text (or only its blank lines). Columns of any name may
    stand beside text; n_chars is only set if docs has it.
    """
    _, removed = line_report(docs)
    gone = removed.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("hash"))
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    out = out.select("row", F.col("gone").isNull().alias("same"), F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept).alias("kept"))
    kinds = dict(docs.dtypes)
    made = {"text": F.col("kept"), "n_chars": F.when(F.col("same"), F.col("row.n_chars")).otherwise(F.length("kept")).cast(kinds["n_chars"]) if "n_chars" in kinds else None}
    return out.select(*((made[c] if c in made else F.col("row")[c]).alias(c) for c in docs.columns))
