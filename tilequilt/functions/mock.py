"""The deterministic mock detector as column expressions: a linear congruential generator seeded by the tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The generator's multiplier, increment and modulus; boxes a tile; seed.
MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 1 << 32
BOXES, SEED, CLASSES = 3, 42, 4


def _next(state: Column) -> Column:
    return F.pmod(state * MULTIPLIER + INCREMENT, F.lit(MODULUS))


def draw(state: Column) -> tuple[Column, Column]:
    """(value, next state): a 31-bit value of three generator steps, high bits first (11, 10 and 10 bits)."""
    one = _next(state)
    two = _next(one)
    three = _next(two)
    high = F.pmod(F.shiftright(one, 16), F.lit(2048))
    value = F.shiftleft(high, 10).bitwiseXOR(F.pmod(F.shiftright(two, 16), F.lit(1024)))
    return F.shiftleft(value, 10).bitwiseXOR(F.pmod(F.shiftright(three, 16), F.lit(1024))), three


def detections(tiles: DataFrame) -> DataFrame:
    """tiles (tile_index, width, height, ...) with one row a box: ordinal, x, y, w, h (float), class_id, confidence.

    Each draw is a projection of its own, so the generator's state is computed once a step.
    """
    df = tiles.withColumn("__s", (F.lit(SEED) + F.col("tile_index")).cast("long"))
    for i in range(BOXES * 6):
        value, state = draw(F.col("__s"))
        df = df.withColumns({f"__v{i}": value, "__t": state}).drop("__s").withColumnRenamed("__t", "__s")

    def box(k: int) -> Column:
        v = [F.col(f"__v{6 * k + j}") for j in range(6)]
        max_x, max_y = (F.col(c) - 1 for c in ("width", "height"))
        share = [(x % 100).cast("float") / F.lit(100.0) for x in v[:2]] + [(x % 30 + 10).cast("float") / F.lit(100.0) for x in v[2:4]]
        share = [x.cast("float") for x in share]  # single precision after every operation
        x, y = (share[0] * max_x.cast("float")).cast("float"), (share[1] * max_y.cast("float")).cast("float")
        w = F.least((share[2] * max_x.cast("float")).cast("float"), (max_x.cast("float") - x).cast("float"))
        h = F.least((share[3] * max_y.cast("float")).cast("float"), (max_y.cast("float") - y).cast("float"))
        conf = (F.lit(0.5).cast("float") + ((v[5] % 50).cast("float") / F.lit(100.0)).cast("float")).cast("float")
        return F.struct(F.lit(k).alias("ordinal"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), (v[4] % CLASSES).cast("int").alias("class_id"), conf.alias("confidence"))

    return df.select(*tiles.columns, F.explode(F.array(*(box(k) for k in range(BOXES)))).alias("__b")).select(*tiles.columns, "__b.*")
