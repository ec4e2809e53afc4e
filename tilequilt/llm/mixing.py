"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: Times its own size that a source may give at most.
MOST = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the key that name a range; 3 make 4,096 ranges a source.
RANGE_DIGITS = 3


def word_count(text):
    """Number of ASCII-space separated words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): weights by code point of the source, null last.

    Excess over MOST times a source's size goes to the others by weight until none is above: with sources in order of
    their cap per weight, the first ones are capped up to the point where the rest can all take an equal level.
    Windows here run over one row a source, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(w) for w in weights))
    ranked = sizes.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(MOST)))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (
        ranked.withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("cap") * F.col("w_left") <= F.col("left") * F.col("w"))
    )
    free = level.withColumn("free_left", F.max(F.when(~F.col("capped"), F.col("left"))).over(whole)).withColumn("free_w", F.max(F.when(~F.col("capped"), F.col("w_left"))).over(whole))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("free_left") * F.col("w") / F.col("free_w"))
    return free.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, taken) of every row of docs.

    taken is the number of words that the mix takes from the row, repeats counted: whole epochs while the budget (the
    target, rounded) exceeds the source's size, then a cut in hash-random order, exactly at the budget, so that a
    source's taken words sum up to it. No row exceeds twice its size. Null texts have size 0 and give 0; null is a
    source of its own; null ids hash like the word null. The hash is of id and text, so that rows of one id or without
    one are spread; rows that tie (same id, same text) follow one another.

    The order within a source is never sorted in one task: keys fall into 4,096 ranges of the hash, sums by (source,
    range) are prefix-summed over that small table, and only rows within a range are put in order.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    rows = columns(docs, "doc_id", "source", "text").select("doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"), key.alias("key"))
    rows = staged(rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS)))
    by_range = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    by_source = targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    so_far = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_range.withColumn("offset", F.coalesce(F.sum("range_size").over(so_far), F.lit(0)))
    known = offsets.join(by_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "range_size")
    known = known.select(F.col("source").alias("k_source"), F.col("range").alias("k_range"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("k_source")) & (F.col("range") == F.col("k_range")))
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least("size", rest - F.col("offset") - F.col("ahead")))
    return placed.select("doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("size") * epochs + cut).cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed documents, columns as those of docs: each row as often as the mix takes it whole, then its cut.

    A cut copy holds the row's first words up to the budget, with their white space, and its n_chars (if docs has such
    a column) is set anew. Rows of which nothing is taken (also those without a word) go.
    """
    keys = ["doc_id", "source", "text_hash"]
    plan = staged(mix_plan(docs, seed).select(*keys, "size", "taken"))
    groups = plan.groupBy(*keys).agg(F.min("taken").alias("low"), F.max("taken").alias("high"), F.first("size").alias("size"))
    groups = groups.where("high > 0").toDF("g_id", "g_source", "g_hash", "low", "high", "size")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).select("row", F.col("row.doc_id").alias("id"), F.col("row.source").alias("source"), F.xxhash64("row.text").alias("hash"))
    on = F.col("id").eqNullSafe(F.col("g_id")) & rows["source"].eqNullSafe(F.col("g_source")) & (F.col("hash") == F.col("g_hash"))
    even = rows.join(groups.where("low = high").withColumn("taken", F.col("high")), on).select("row", "size", "taken")
    # Rows alike in id, source and text of which the cut takes differently (at most one such group a source) are numbered.
    uneven = groups.where("low < high")
    nth = F.row_number().over(Window.partitionBy("g_id", "g_source", "g_hash").orderBy("taken"))
    shares = plan.join(uneven.drop("size"), plan["doc_id"].eqNullSafe(F.col("g_id")) & plan["source"].eqNullSafe(F.col("g_source")) & (plan["text_hash"] == F.col("g_hash")))
    shares = shares.select("g_id", "g_source", "g_hash", "size", "taken", nth.alias("nth")).where("taken > 0")
    tied = rows.join(uneven.drop("size"), on).select("row", "id", "source", "hash", F.row_number().over(Window.partitionBy("id", "source", "hash").orderBy(F.lit(0))).alias("n"))
    uneven = tied.join(shares, on & (F.col("n") == F.col("nth"))).select("row", "size", "taken")
    many = even.unionByName(uneven).withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    # The words and the white space between them, up to the cut; the whole text where nothing is cut.
    lead = F.regexp_extract("row.text", r"^[\x20\x09-\x0D]*", 0)
    pieces = F.regexp_extract_all("row.text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    short = F.concat(lead, F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), ""))
    out = many.select("row", (words == F.col("size")).alias("whole"), F.when(words == F.col("size"), F.col("row.text")).otherwise(short).alias("kept"))
    kinds = dict(docs.dtypes)
    made = {"text": F.col("kept"), "n_chars": F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.length("kept")).cast(kinds["n_chars"]) if "n_chars" in kinds else None}
    return out.select(*((made[c] if c in made else F.col("row")[c]).alias(c) for c in docs.columns))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * sum(size) AS cap,
    CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM d GROUP BY source),
l AS (SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_rest FROM s
    WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * w_rest <= rest * w AS capped FROM l),
t AS (SELECT source, source_size, CAST(CASE WHEN capped THEN cap ELSE
    max(CASE WHEN NOT capped THEN rest END) OVER () * w / max(CASE WHEN NOT capped THEN w_rest END) OVER () END AS DOUBLE) AS target FROM c),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE
    size * (budget // source_size) + greatest(0, least(size, budget % source_size - ahead)) END AS BIGINT) AS taken FROM p
"""
