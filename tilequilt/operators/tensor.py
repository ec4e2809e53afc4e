"""Decoding of model outputs held as float arrays, as column expressions and DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def channel(values: Column, c: int, n: int) -> Column:
    """Channel c of a channel-major array with n items a channel."""
    return F.slice(values, F.lit(c * n + 1), F.lit(n))


def best_class(scores: Column) -> Column:
    """struct<class_id, score>: the highest score over 0 and its first place; class 0 with score 0 if none is."""
    top = F.array_max(scores)
    hit = top > 0
    return F.struct(F.when(hit, F.array_position(scores, top).cast("int") - 1).otherwise(F.lit(0)).alias("class_id"), F.when(hit, top).otherwise(F.lit(0.0)).alias("score"))


def softmax_best(logits: Column) -> Column:
    """struct<class_id, prob> of a cell's logits: first place of the highest, and its softmax probability."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - top.cast("double")))
    return F.struct((F.array_position(logits, top).cast("int") - 1).alias("class_id"), (F.lit(1.0) / total).alias("prob"))


def cell_classes(tensors: DataFrame, channels: int, cells: int, keys: list[str]) -> DataFrame:
    """(keys, cell, class_id, prob) of each cell of a channel-major `values` array."""
    per_cell = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: softmax_best(F.array(*(F.element_at("values", (i + 1 + c * cells).cast("int")) for c in range(channels)))))
    return tensors.select(*keys, F.posexplode(per_cell).alias("cell", "best")).select(*keys, "cell", "best.class_id", "best.prob")


def block_votes(cells: DataFrame, keys: list[str], width: int, block: int, votes: int, threshold: float, excluded: tuple[int, ...]) -> DataFrame:
    """(keys, block_row, block_col, class_id, votes, confidence): the class with most cells of each block.

    Only cells of classes not excluded and of at least the threshold vote; ties go to the smaller class; a winner needs
    so many votes; confidence is the mean over its cells.
    """
    rows = cells.where(~F.col("class_id").isin(*excluded) & (F.col("prob") >= threshold))
    rows = rows.withColumns({"block_row": F.floor(F.floor(F.col("cell") / width) / block).cast("int"), "block_col": F.floor(F.pmod("cell", F.lit(width)) / block).cast("int")})
    by = [*keys, "block_row", "block_col"]
    counted = rows.groupBy(*by, "class_id").agg(F.count("*").alias("votes"), F.avg("prob").alias("confidence"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("votes"), "class_id"))
    return counted.withColumn("__n", first).where(F.col("__n") == 1).where(F.col("votes") >= votes).drop("__n")


def top_per_tile(rows: DataFrame, keys: list[str], n: int, *ties: str) -> DataFrame:
    """The n rows of highest confidence of each tile; ties by the given columns."""
    order = Window.partitionBy(*keys).orderBy(F.desc("confidence"), *ties)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def decode_anchors(tensors: DataFrame, classes: int, anchors: int, threshold: float, keys: list[str]) -> DataFrame:
    """(keys, anchor, class_id, confidence, cx, cy, w, h) of anchors whose best class reaches the threshold."""
    per_anchor = F.transform(
        F.sequence(F.lit(0), F.lit(anchors - 1)),
        lambda i: F.struct(
            *(F.element_at("values", (i + 1 + c * anchors).cast("int")).cast("double").alias(n) for c, n in enumerate(("cx", "cy", "w", "h"))),
            best_class(F.array(*(F.element_at("values", (i + 1 + (4 + c) * anchors).cast("int")).cast("double") for c in range(classes)))).alias("best"),
        ),
    )
    rows = tensors.select(*keys, F.posexplode(per_anchor).alias("anchor", "a"))
    return rows.select(*keys, "anchor", F.col("a.best.class_id").alias("class_id"), F.col("a.best.score").alias("confidence"), "a.cx", "a.cy", "a.w", "a.h").where(F.col("confidence") >= threshold)
