"""Land cover by class priority over boxes and rectilinear outlines, by interval arithmetic on strips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Height of the bands that strips and boxes are dealt into, so that the strip join is an equi-join.
BAND = 64


def class_priority(boxes: DataFrame) -> DataFrame:
    """(session_id, class_id, max_conf, rank): classes by highest confidence, then smaller id."""
    top = boxes.groupBy("session_id", "class_id").agg(F.max("conf").alias("max_conf"))
    order = Window.partitionBy("session_id").orderBy(F.desc("max_conf"), "class_id")
    return top.withColumn("rank", F.row_number().over(order))


def clip(boxes: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """Boxes cut to an image of that size."""
    lim = {"x0": width, "x1": width, "y0": height, "y1": height}
    return boxes.withColumns({c: F.least(F.greatest(F.col(c), F.lit(0)), m if isinstance(m, Column) else F.lit(m)) for c, m in lim.items()})


def shape_boxes(shapes: DataFrame) -> DataFrame:
    """Boxes (x0, y0, x1, y1) in place of shapes: a rectilinear outline of four points or more (column outline) gives the
    boxes that tile it, other rows stay; an outline without an inside keeps its bounds' first corner as an empty box,
    as it counts for its class's confidence."""
    inside = F.when(F.size("outline") >= 4, F.filter(G.ring_boxes(F.col("outline")), lambda b: b["x1"] > b["x0"]))
    first = F.struct(*(F.col(c) for c in ("x0", "y0", "x0", "y0")))
    same = F.struct(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    kind = "array<struct<x0:long,y0:long,x1:long,y1:long>>"
    parts = F.when(inside.isNull(), F.array(same).cast(kind)).when(F.size(inside) == 0, F.array(first).cast(kind)).otherwise(inside.cast(kind))
    others = [c for c in shapes.columns if c not in ("x0", "y0", "x1", "y1", "outline")]
    return shapes.select(*others, F.explode(parts).alias("b")).select(*others, "b.*")


def _cut(boxes: DataFrame, keys: list[str], layers: list[str]) -> DataFrame:
    """Intervals (keys, band, ys, ye, layers, x0, x1) of integer boxes in strips between neighbouring y values of equal keys.

    Boxes and strips also are cut at bands of BAND rows and meet by an equi-join on the band; all that follows is keyed
    by keys and band at least, so it stays in that join's partitions.
    """
    solid = boxes.where("x1 > x0 AND y1 > y0")
    bands = F.sequence(F.floor(F.col("y0") / BAND).cast("long"), F.floor((F.col("y1") - 1) / BAND).cast("long"))
    part = solid.select(*keys, *layers, "x0", "x1", "y0", "y1", F.explode(bands).alias("band"))
    part = part.withColumns({"y0": F.greatest("y0", F.col("band") * BAND), "y1": F.least("y1", (F.col("band") + 1) * BAND)})
    breaks = part.select(*keys, "band", F.explode(F.array("y0", "y1")).alias("ys")).distinct()
    strips = breaks.withColumn("ye", F.lead("ys").over(Window.partitionBy(*keys, "band").orderBy("ys"))).where("ye IS NOT NULL")
    inside = part.join(strips, [*keys, "band"]).where("y0 <= ys AND ye <= y1")
    return inside.groupBy(*keys, "band", "ys", "ye", *layers, "x0").agg(F.max("x1").alias("x1"))


def _new(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with far: the furthest x1 of the intervals before, in order of x0, or the own x0."""
    so_far = F.max("x1").over(Window.partitionBy(*by).orderBy("x0").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("far", F.greatest("x0", F.coalesce(so_far, F.col("x0"))))


def union_area(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area) of the union of integer boxes (x0, y0, x1, y1) of equal keys: within a strip, intervals in order of
    x0 add what lies beyond the furthest x1 so far."""
    rows = _new(_cut(boxes, keys, []), [*keys, "band", "ys"])
    return rows.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.col("x1") - F.col("far")) * (F.col("ye") - F.col("ys"))).cast("long").alias("area"))


def class_areas(boxes: DataFrame, gt: Column | None = None, epsg: Column | int | None = None) -> DataFrame:
    """(session_id, class_id, rank, area): pixels of each class that no class before it in priority covers; with a
    transform (a constant, or an expression of session_id) also area_m2, on the ellipsoid.

    The union of the classes up to a rank, less that up to the rank before, is the class's own area, strip by strip. In
    a strip a class's intervals are merged first; what is left is repeated for the later classes of that strip only.
    Boxes without an area still count for their class's confidence.
    """
    ranks = class_priority(boxes).select("session_id", "class_id", "rank")
    strip = ["session_id", "band", "ys", "ye"]
    rows = _new(_cut(boxes.join(ranks, ["session_id", "class_id"]), ["session_id"], ["rank"]), [*strip, "rank"])
    # far is the own x0 where a gap lies before; where the interval before ends there, two islands touch, which is as good.
    island = F.sum(F.when(F.col("far") == F.col("x0"), 1).otherwise(0)).over(Window.partitionBy(*strip, "rank").orderBy("x0"))
    merged = rows.withColumn("island", island).groupBy(*strip, "rank", "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    here = F.collect_set("rank").over(Window.partitionBy(*strip))
    later = merged.withColumn("here", here).withColumn("upto", F.explode(F.filter("here", lambda r: r >= F.col("rank"))))
    later = later.groupBy(*strip, "upto", "x0").agg(F.max("x1").alias("x1"))
    # A piece reaches from far to x1, if it does.
    piece = _new(later, [*strip, "upto"]).where("x1 > far")
    sums = {"area": F.sum((F.col("x1") - F.col("far")) * (F.col("ye") - F.col("ys"))).cast("long")}
    if gt is not None:
        at = [G.to_wgs84(epsg, *G.affine(gt, x, y)) for x, y in G.corners(*(F.col(c) for c in ("far", "ys", "x1", "ye")))]
        sums["area_m2"] = F.sum(G.geographic_area([(p["lon"], p["lat"]) for p in at]))
    unions = piece.groupBy(*strip, "upto").agg(*(v.alias(k) for k, v in sums.items()))
    order = Window.partitionBy(*strip).orderBy("upto")
    own = unions.select("session_id", F.col("upto").alias("rank"), *((F.col(k) - F.coalesce(F.lag(k).over(order), F.lit(0))).alias(k) for k in sums))
    totals = own.groupBy("session_id", "rank").agg(*(F.sum(k).alias(k) for k in sums))
    return ranks.join(totals, ["session_id", "rank"], "left").select("session_id", "class_id", "rank", *(F.coalesce(F.col(k), F.lit(0)).alias(k) for k in sums))


def coverage(areas: DataFrame, footprint: int | Column) -> DataFrame:
    """areas with percent of the footprint, the session's classified area and its unclassified percent; classes of no
    area are left out."""
    base = F.nullif(footprint if isinstance(footprint, Column) else F.lit(footprint), F.lit(0))
    some = areas.where("area > 0").withColumn("percent", F.col("area") * 100.0 / base)
    whole = Window.partitionBy("session_id")
    some = some.withColumn("classified_area", F.sum("area").over(whole))
    return some.withColumn("unclassified_percent", F.greatest(F.lit(0.0), 100.0 - F.col("classified_area") * 100.0 / base))


def with_unclassified(areas: DataFrame, footprint: int) -> DataFrame:
    """(session_id, label, area, percent) of the classes and of what none covers."""
    some = areas.where("area > 0")
    rest = some.groupBy("session_id").agg(F.greatest(F.lit(0), F.lit(footprint) - F.sum("area")).cast("long").alias("area")).withColumn("label", F.lit("unclassified"))
    rows = some.select("session_id", F.col("class_id").cast("string").alias("label"), "area").unionByName(rest.select("session_id", "label", "area"))
    return rows.withColumn("percent", F.col("area") * 100.0 / footprint)
