"""Helpers shared by the corpus operators: byte-bounded Arrow batches and joins whose hot keys are split."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import shared_dir, staged, unstage

__all__ = ["chunks", "columns", "hot_join", "in_arrow", "shared_dir", "staged", "text_bytes", "unstage"]

#: UTF-8 bytes of text that one vectorised step works on; a longer single text is a step of its own.
CHUNK_BYTES = 1 << 19
#: Bytes of an Arrow batch on its way to a Python worker (a longer single row is a batch of its own).
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A table of up to so many bytes is broadcast by hot_join; beyond, both sides are shuffled.
BROADCAST_BYTES = 16 << 20
#: A key with more than this share of the rows is hot (so there are fewer than 1 / HOT_SHARE); it is dealt over SALTS tasks.
HOT_SHARE = 0.002
SALTS = 64


def in_arrow(rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """rows.mapInArrow, with the session's batches bounded by BATCH_BYTES unless the user has set a bound.

    Spark's own bound is 64 MB a batch; each task holds one on either side of the pipe, and a worker copies of it.
    """
    conf = rows.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return rows.mapInArrow(function, schema)


def hot_join(rows: DataFrame, small: DataFrame, keys: list[str], salt: list[str], size: Column | None = None) -> DataFrame:
    """Inner join of rows with small on keys, which hold no nulls and are unique in small.

    small is staged and has a column times, the number of rows of each key (it is not in the result). Up to
    BROADCAST_BYTES (64 a row, or the column size) small is broadcast. Beyond, rows of a hot key are dealt over SALTS
    tasks by a hash of their columns salt, and small has a copy for each; only the names of the hot keys are broadcast,
    of which there are fewer than 1 / HOT_SHARE.
    """
    total = small.agg(F.sum("times").alias("rows"), F.sum(F.lit(64) if size is None else size + 64).alias("size")).first()
    plain = small.drop("times")
    if (total["size"] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(plain), keys)
    hot = F.col("times") > HOT_SHARE * total["rows"]
    names = small.where(hot).select(*keys, F.lit(True).alias("__hot"))
    dealt = rows.join(F.broadcast(names), keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*salt), F.lit(SALTS))).otherwise(0).cast("int")).drop("__hot")
    copies = small.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("times")
    return dealt.join(copies, [*keys, "__salt"]).drop("__salt")


def chunks(texts: Iterable, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list]]:
    """Consecutive runs of texts (None: empty) of about limit bytes or characters in all, each with the index of its first text."""
    run: list = []
    size = begin = 0
    for i, t in enumerate(texts):
        n = len(t or ())
        if run and size + n > limit:
            yield begin, run
            run, size, begin = [], 0, i
        run.append(t)
        size += n
    if run:
        yield begin, run


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8, null as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name can't clash with an operator's own."""
    return docs.select(*(docs[n] for n in names))
