"""The registered queries, each over whole tables, with DuckDB SQL of the same results."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, mock
from ..functions import geometry as G
from ..operators import config, coverage, grid, inference, nms, rings, telemetry, tensor
from ..sources import geotiff
from ..staging import shared_dir
from . import session

SIDE = 1024
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer pixel boxes of ten sessions and four classes, out of orders."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    x0, y0 = (k * 7919) % SIDE, (k * 104729) % SIDE
    return table(spark, sf_dir, "orders").select(
        k.alias("det_id"), (F.col("o_custkey") % 10).alias("session_id"), (k % 4).cast("int").alias("class_id"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 10 + F.floor(p).cast("long") % 120).alias("x1"), (y0 + 10 + F.floor(p / 7).cast("long") % 120).alias("y1"), (50 + (k * 31) % 50).alias("conf"),
    )


DET = f"""det AS (SELECT o_orderkey AS det_id, o_custkey % 10 AS session_id, CAST(o_orderkey % 4 AS INTEGER) AS class_id,
  (o_orderkey * 7919) % {SIDE} AS x0, (o_orderkey * 104729) % {SIDE} AS y0,
  (o_orderkey * 7919) % {SIDE} + 10 + CAST(floor(o_totalprice) AS BIGINT) % 120 AS x1,
  (o_orderkey * 104729) % {SIDE} + 10 + CAST(floor(o_totalprice / 7) AS BIGINT) % 120 AS y1, 50 + (o_orderkey * 31) % 50 AS conf FROM orders)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sizes and transforms, out of part."""
    k = F.col("p_partkey")
    gt = F.array(100 + k * 0.01, F.lit(0.00001), F.lit(0.0), F.lit(20.0), F.lit(0.0), F.lit(-0.00001))
    return table(spark, sf_dir, "part").select(k.alias("image_id"), (256 + F.col("p_size") * 64).alias("width"), (256 + (k % 37) * 64).cast("int").alias("height"), gt.alias("gt"))


IMG = "img AS (SELECT p_partkey AS image_id, 256 + p_size * 64 AS width, CAST(256 + (p_partkey % 37) * 64 AS INTEGER) AS height, [100 + p_partkey * 0.01::DOUBLE, 0.00001::DOUBLE, 0.0::DOUBLE, 20.0::DOUBLE, 0.0::DOUBLE, -0.00001::DOUBLE] AS gt FROM part)"
GRID = f"""{IMG}, dims AS (SELECT *, CAST(ceil(width / 448.0) AS INTEGER) AS cols, CAST(ceil(height / 448.0) AS INTEGER) AS rows FROM img),
r AS (SELECT *, unnest(range(0, rows))::INTEGER AS tile_row FROM dims), g AS (SELECT *, unnest(range(0, cols))::INTEGER AS tile_col FROM r),
tiles AS (SELECT image_id, width, height, tile_row, tile_col, tile_row * cols + tile_col AS tile_index, tile_col * 448 AS x, tile_row * 448 AS y,
  least(512, width - tile_col * 448) AS tile_w, least(512, height - tile_row * 448) AS tile_h FROM g)"""

# --- grids and coordinates


@query(f"WITH {GRID} SELECT image_id, tile_row, tile_col, tile_index, x, y FROM tiles")
def tile_grid(spark, sf_dir):
    return grid.tile_grid(images(spark, sf_dir)).select("image_id", "tile_row", "tile_col", "tile_index", "x", "y")


@query(f"WITH {GRID} SELECT image_id, tile_index, tile_w, tile_h, CAST(tile_w AS BIGINT) * tile_h * 3 AS pixel_bytes FROM tiles")
def tile_window_clip(spark, sf_dir):
    return grid.tile_grid(images(spark, sf_dir)).select("image_id", "tile_index", "tile_w", "tile_h", (F.col("tile_w").cast("long") * F.col("tile_h") * 3).alias("pixel_bytes"))


@query(f"""WITH {GRID} SELECT image_id, tile_index, round(gt0 + x * 0.00001::DOUBLE, 9) AS left_lon, round(20::DOUBLE - y * 0.00001::DOUBLE, 9) AS top_lat,
  round(gt0 + (x + tile_w) * 0.00001::DOUBLE, 9) AS right_lon, round(20::DOUBLE - (y + tile_h) * 0.00001::DOUBLE, 9) AS bottom_lat FROM (SELECT *, 100 + image_id * 0.01::DOUBLE AS gt0 FROM tiles)""")
def tile_corners(spark, sf_dir):
    t = grid.tile_grid(images(spark, sf_dir))
    gt = F.col("gt")
    left, top = G.affine(gt, F.col("x"), F.col("y"))
    right, bottom = G.affine(gt, F.col("x") + F.col("tile_w"), F.col("y") + F.col("tile_h"))
    return t.select("image_id", "tile_index", *(F.round(c, 9).alias(n) for c, n in ((left, "left_lon"), (top, "top_lat"), (right, "right_lon"), (bottom, "bottom_lat"))))


@query(f"""WITH {IMG} SELECT image_id, unnest([1, 2, 3, 4]) AS corner, round(unnest([gt[1], gt[1] + width * gt[2], gt[1] + width * gt[2], gt[1]]), 9) AS lon,
  round(unnest([gt[4], gt[4], gt[4] + height * gt[6], gt[4] + height * gt[6]]), 9) AS lat FROM img""")
def footprint_affine(spark, sf_dir):
    ring = images(spark, sf_dir).select("image_id", F.posexplode(G.footprint(F.col("gt"), F.col("width"), F.col("height"))).alias("at", "p"))
    return ring.select("image_id", (F.col("at") + 1).alias("corner"), F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat"))


_FLOATS = "o_orderkey AS det_id, (o_orderkey * 7919 % 10240) / 20.0 AS x, (o_orderkey * 104729 % 10240) / 20.0 AS y, 10 + (o_orderkey * 31 % 1000) / 8.0 AS w, 10 + (o_orderkey * 17 % 1000) / 8.0 AS h"


def float_boxes(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("det_id"), (k * 7919 % 10240 / 20.0).alias("x"), (k * 104729 % 10240 / 20.0).alias("y"), (10 + k * 31 % 1000 / 8.0).alias("w"), (10 + k * 17 % 1000 / 8.0).alias("h"))


@query(f"""WITH b AS (SELECT {_FLOATS} FROM orders), t AS (SELECT det_id, 448 + CAST(trunc(x) AS INTEGER) AS x0, 896 + CAST(trunc(y) AS INTEGER) AS y0, CAST(trunc(w) AS INTEGER) AS w, CAST(trunc(h) AS INTEGER) AS h FROM b)
  SELECT det_id, x0, y0, x0 + w AS x1, y0 + h AS y1, CAST(w AS DOUBLE) * h AS area FROM t""")
def det_to_ring(spark, sf_dir):
    ring = G.box_ring(F.lit(448), F.lit(896), F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    b = float_boxes(spark, sf_dir).select("det_id", ring.alias("ring"))
    return b.select("det_id", G.bounds(F.col("ring")).alias("b"), G.shoelace(F.col("ring")).alias("area")).select("det_id", "b.x0", "b.y0", "b.x1", "b.y1", "area")


@query(f"""WITH b AS (SELECT {_FLOATS} FROM orders), p AS (SELECT det_id, [x, x + w, x + w / 2] AS xs, [y, y + h / 2, y + h] AS ys FROM b),
  q AS (SELECT det_id, list_transform(xs, lambda v: 448 + round(v)) AS xs, list_transform(ys, lambda v: 448 + round(v)) AS ys FROM p)
  SELECT det_id, CAST(list_min(xs) AS INTEGER) AS x0, CAST(list_min(ys) AS INTEGER) AS y0, CAST(list_max(xs) AS INTEGER) AS x1, CAST(list_max(ys) AS INTEGER) AS y1 FROM q""")
def bbox_of_ring(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    poly = G.ring([(x, y), (x + w, y + h / 2), (x + w / 2, y + h)])
    return float_boxes(spark, sf_dir).select("det_id", G.bounds(G.polygon_ring(F.lit(448), F.lit(448), poly)).alias("b")).select("det_id", "b.*")


@query(f"""WITH b AS (SELECT {_FLOATS} FROM orders), r AS (SELECT det_id, [[x, y], [x + w, y], [x + w, y + h], [x, y + h]] AS p FROM b)
  SELECT det_id, 'POLYGON((' || array_to_string(list_transform(list_append(p, p[1]), lambda v: printf('%.8f %.8f', v[1], v[2])), ',') || '))' AS wkt FROM r""")
def wkt_polygons(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    return float_boxes(spark, sf_dir).select("det_id", G.wkt(G.ring(G.corners(x, y, x + w, y + h), "lon", "lat")).alias("wkt"))


# --- boxes


@query(f"""WITH {DET} SELECT a.det_id AS a_id, b.det_id AS b_id, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h
  FROM det a JOIN det b ON a.session_id = b.session_id AND a.class_id = b.class_id AND (a.conf > b.conf OR (a.conf = b.conf AND a.det_id < b.det_id))
  AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
  WHERE 2 * w * h > (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - w * h""".replace("AS w,", "AS w,"))
def iou_pairs(spark, sf_dir):
    return nms.over_half_pairs(boxes(spark, sf_dir), ["session_id", "class_id"])


_EDGES = """e AS (SELECT a.det_id AS src, b.det_id AS dst FROM det a JOIN det b ON a.session_id = b.session_id AND a.class_id = b.class_id
  AND (a.conf > b.conf OR (a.conf = b.conf AND a.det_id < b.det_id)) AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
  WHERE 3 * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0))"""
# Rounds written out: what nothing precedes is kept, what it conflicts with goes, and both leave the graph.
_ROUNDS = 12
_NMS = (
    f"{DET}, {_EDGES.replace('e AS (', 'e0 AS MATERIALIZED (', 1)}, "
    + ", ".join(f"""r{i} AS MATERIALIZED (SELECT DISTINCT src AS id FROM e{i} WHERE src NOT IN (SELECT dst FROM e{i})), g{i} AS MATERIALIZED (SELECT DISTINCT dst AS id FROM e{i} JOIN r{i} ON src = id),
e{i + 1} AS MATERIALIZED (SELECT * FROM e{i} WHERE dst NOT IN (SELECT id FROM g{i}) AND src NOT IN (SELECT id FROM g{i}) AND src NOT IN (SELECT id FROM r{i}))""" for i in range(_ROUNDS))
    + ", gone AS MATERIALIZED ("
    + " UNION ALL ".join(f"SELECT id FROM g{i}" for i in range(_ROUNDS))
    + ")"
)


@query(f"WITH {_NMS} SELECT det_id, session_id, class_id, conf FROM det WHERE det_id NOT IN (SELECT id FROM gone)")
def nms_global(spark, sf_dir):
    return nms.suppress(boxes(spark, sf_dir), ["session_id", "class_id"]).select("det_id", "session_id", "class_id", "conf")


@query(f"WITH {_NMS} SELECT session_id, count(*) AS n_in, count(*) FILTER (WHERE det_id NOT IN (SELECT id FROM gone)) AS n_out, count(*) FILTER (WHERE det_id IN (SELECT id FROM gone)) AS n_removed FROM det GROUP BY session_id")
def nms_counters(spark, sf_dir):
    b = boxes(spark, sf_dir)
    gone = nms.suppressed(nms.conflicts(b, ["session_id", "class_id"], 128, nms.over_half)).withColumn("gone", F.lit(1))
    marked = b.join(gone, "det_id", "left")
    return marked.groupBy("session_id").agg(F.count("*").alias("n_in"), F.count(F.when(F.col("gone").isNull(), 1)).alias("n_out"), F.count("gone").alias("n_removed"))


# --- classes and coverage


@query(f"WITH {DET}, m AS (SELECT session_id, class_id, max(conf) AS max_conf FROM det GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY max_conf DESC, class_id) AS INTEGER) AS rank FROM m")
def class_priority(spark, sf_dir):
    return coverage.class_priority(boxes(spark, sf_dir))


# An independent way: every row of pixels is swept by itself.
_AREAS = f"""{DET}, clipped AS (SELECT session_id, class_id, conf, least(x0, {SIDE}) AS x0, least(x1, {SIDE}) AS x1, least(y0, {SIDE}) AS y0, least(y1, {SIDE}) AS y1 FROM det),
m AS (SELECT session_id, class_id, max(conf) AS max_conf FROM clipped GROUP BY ALL),
rk AS (SELECT session_id, class_id, row_number() OVER (PARTITION BY session_id ORDER BY max_conf DESC, class_id) AS rank FROM m),
pre AS (SELECT c.session_id, q.rank, c.x0, c.x1, c.y0, c.y1 FROM clipped c JOIN rk r USING (session_id, class_id) JOIN rk q ON q.session_id = c.session_id AND q.rank >= r.rank),
line AS (SELECT session_id, rank, x0, x1, unnest(range(y0, y1)) AS y FROM pre),
run AS (SELECT *, max(x1) OVER (PARTITION BY session_id, rank, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM line),
tot AS (SELECT session_id, rank, sum(greatest(0, x1 - greatest(x0, coalesce(far, x0)))) AS total FROM run GROUP BY ALL),
areas AS (SELECT rk.session_id, rk.class_id, CAST(rk.rank AS INTEGER) AS rank, CAST(coalesce(total, 0) - coalesce(lag(coalesce(total, 0)) OVER (PARTITION BY rk.session_id ORDER BY rk.rank), 0) AS BIGINT) AS area
  FROM rk LEFT JOIN tot ON rk.session_id = tot.session_id AND rk.rank = tot.rank)"""


def _areas(spark, sf_dir):
    return coverage.class_areas(coverage.clip(boxes(spark, sf_dir), SIDE, SIDE))


@query(f"WITH {_AREAS} SELECT * FROM areas")
def coverage_disjoint(spark, sf_dir):
    return _areas(spark, sf_dir)


@query(f"""WITH {_AREAS} SELECT session_id, class_id, area, round(area * 100.0 / {SIDE * SIDE}, 9) AS percent, CAST(sum(area) OVER w AS BIGINT) AS classified_area,
  round(greatest(0, 100.0 - sum(area) OVER w * 100.0 / {SIDE * SIDE}), 9) AS unclassified_percent FROM areas WHERE area > 0 WINDOW w AS (PARTITION BY session_id)""")
def coverage_percent(spark, sf_dir):
    c = coverage.coverage(_areas(spark, sf_dir), SIDE * SIDE)
    return c.select("session_id", "class_id", "area", F.round("percent", 9).alias("percent"), "classified_area", F.round("unclassified_percent", 9).alias("unclassified_percent"))


@query(f"""WITH {_AREAS}, u AS (SELECT session_id, CAST(class_id AS VARCHAR) AS label, area FROM areas WHERE area > 0
  UNION ALL SELECT session_id, 'unclassified', CAST(greatest(0, {SIDE * SIDE} - sum(area)) AS BIGINT) FROM areas GROUP BY session_id)
  SELECT session_id, label, area, round(area * 100.0 / {SIDE * SIDE}, 9) AS percent, CAST(row_number() OVER (PARTITION BY session_id ORDER BY area DESC, label) AS INTEGER) AS place FROM u""")
def coverage_with_unclassified(spark, sf_dir):
    rows = coverage.with_unclassified(_areas(spark, sf_dir), SIDE * SIDE)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("area"), "label"))
    return rows.select("session_id", "label", "area", F.round("percent", 9).alias("percent"), place.alias("place"))


@query(f"WITH {DET} SELECT class_id, count(*) AS n, min(det_id) AS first_id, max(conf) AS max_conf FROM det GROUP BY class_id")
def class_counts(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("class_id").agg(F.count("*").alias("n"), F.min("det_id").alias("first_id"), F.max("conf").alias("max_conf"))


_BY_CLASS = f"WITH {DET}, c AS (SELECT session_id, class_id, count(*) AS n, min(det_id) AS first_id FROM det GROUP BY ALL)"


@query(f"{_BY_CLASS} SELECT session_id, class_id, n FROM c QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first_id) <= 6")
def class_top6(spark, sf_dir):
    c = boxes(spark, sf_dir).groupBy("session_id", "class_id").agg(F.count("*").alias("n"), F.min("det_id").alias("first_id"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "first_id"))
    return c.withColumn("place", place).where("place <= 6").select("session_id", "class_id", "n")


_DICT = "dict AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i}, '{n}', '{c}')" for m, i, n, c in fixed.class_rows()) + ") t(model, class_id, name, color))"
_PALETTE = "[" + ", ".join(f"'{c}'" for c in fixed.PALETTE) + "]"
_MODEL_SQL = "CASE o_orderkey % 5 WHEN 0 THEN 'mock' WHEN 1 THEN 'onnx' WHEN 2 THEN 'dota_obb' WHEN 3 THEN 'segformer_loveda' ELSE 'other' END"


@query(f"""WITH {_DICT}, o AS (SELECT o_orderkey AS det_id, {_MODEL_SQL} AS asked, CAST(o_orderkey // 5 % 90 AS INTEGER) AS class_id FROM orders),
  k AS (SELECT *, CASE WHEN asked IN (SELECT model FROM dict) THEN asked ELSE 'mock' END AS model FROM o)
  SELECT det_id, k.model, k.class_id, coalesce(name, 'Class ' || k.class_id) AS class_name, coalesce(color, {_PALETTE}[k.class_id % 15 + 1]) AS color FROM k LEFT JOIN dict USING (model, class_id)""")
def class_lookup(spark, sf_dir):
    k = F.col("o_orderkey")
    asked = F.element_at(F.array(*(F.lit(m) for m in ("mock", "onnx", "dota_obb", "segformer_loveda", "other"))), (k % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(k.alias("det_id"), asked.alias("asked"), (F.floor(k / 5) % 90).cast("int").alias("class_id"))
    rows = rows.select("det_id", "class_id", F.when(F.col("asked").isin(*fixed.MODELS), F.col("asked")).otherwise("mock").alias("model"))
    out = rows.join(F.broadcast(fixed.class_dictionary(spark)), ["model", "class_id"], "left")  # 107 rows
    palette = F.array(*(F.lit(c) for c in fixed.PALETTE))
    return out.select("det_id", "model", "class_id", F.coalesce("name", F.concat(F.lit("Class "), F.col("class_id"))).alias("class_name"), F.coalesce("color", F.element_at(palette, F.pmod(F.abs("class_id"), F.lit(15)) + 1)).alias("color"))


@query(f"WITH {DET} SELECT session_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM det GROUP BY session_id")
def extent(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("session_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query(f"""WITH {DET} SELECT det_id, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[['||x0||'.0,'||y0||'.0],['||x1||'.0,'||y0||'.0],['||x1||'.0,'||y1||'.0],['||x0||'.0,'||y1||'.0],['||x0||'.0,'||y0||'.0]]]}},"properties":{{"id":'||det_id||',"class_id":'||class_id||',"confidence":'||conf||',"session_id":'||session_id||'}}}}' AS feature FROM det""")
def geojson_features(spark, sf_dir):
    return boxes(spark, sf_dir).select("det_id", feature().alias("feature"))


def feature():
    """A detection's GeoJSON feature text, of columns det_id, class_id, conf, session_id and box corners."""
    ring = G.ring(G.corners(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))), "lon", "lat")
    coords = F.array(F.transform(G.closed(ring), lambda p: F.array(p["lon"].cast("double"), p["lat"].cast("double"))))
    geometry = F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates"))
    properties = F.struct(F.col("det_id").alias("id"), "class_id", F.col("conf").alias("confidence"), "session_id")
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


# --- model pre- and post-processing


@query(f"""WITH {IMG}, s AS (SELECT image_id, width, height, least(640.0 / width, 640.0 / height) AS scale FROM img), n AS (SELECT *, CAST(floor(width * scale + 0.5) AS INTEGER) AS new_w, CAST(floor(height * scale + 0.5) AS INTEGER) AS new_h FROM s)
  SELECT image_id, round(scale, 12) AS scale, new_w, new_h, (640 - new_w) // 2 AS pad_x, (640 - new_h) // 2 AS pad_y FROM n""".replace("640.0", "640.0::DOUBLE"))
def letterbox(spark, sf_dir):
    x = images(spark, sf_dir).select("image_id", G.letterbox(F.col("width"), F.col("height"), 640, 640).alias("b"))
    return x.select("image_id", F.round("b.scale", 12).alias("scale"), "b.new_w", "b.new_h", "b.pad_x", "b.pad_y")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest((l_quantity * 12.8 - 40) / 1.25, 0), 512), 6) AS x, round(least(greatest((l_tax * 8000 - 160) / 1.25, 0), 256), 6) AS y FROM lineitem""")
def inverse_letterbox(spark, sf_dir):
    s = F.lit(1.25)
    x = G.unletterbox(F.col("l_quantity") * 12.8, F.lit(40), s, F.lit(512))
    y = G.unletterbox(F.col("l_tax") * 8000, F.lit(160), s, F.lit(256))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


_EMB = "SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings"


def tensors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("values"))


@query(f"WITH t AS ({_EMB}) SELECT vec_id, round(e[1] - e[3] / 2, 9) AS x0, round(e[2] - e[4] / 2, 9) AS y0, round(e[1] + e[3] / 2, 9) AS x1, round(e[2] + e[4] / 2, 9) AS y1 FROM t")
def cxcywh(spark, sf_dir):
    v = F.col("values")
    box = G.center_box(v[0], v[1], v[2], v[3])
    return tensors(spark, sf_dir).select("vec_id", *(F.round(c, 9).alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)))


@query(f"""WITH t AS ({_EMB}), a AS (SELECT vec_id, e[1] * 100 AS cx, e[2] * 100 AS cy, abs(e[3]) * 50 AS w, abs(e[4]) * 50 AS h, cos(e[5] * 3) AS c, sin(e[5] * 3) AS s FROM t),
  b AS (SELECT *, abs(w * c) / 2 + abs(h * s) / 2 AS hx, abs(w * s) / 2 + abs(h * c) / 2 AS hy FROM a)
  SELECT vec_id, round(cx - hx, 6) AS x0, round(cy - hy, 6) AS y0, round(cx + hx, 6) AS x1, round(cy + hy, 6) AS y1 FROM b""")
def obb_aabb(spark, sf_dir):
    v = F.col("values")
    b = G.rotated_bounds(v[0] * 100, v[1] * 100, F.abs(v[2]) * 50, F.abs(v[3]) * 50, v[4] * 3)
    return tensors(spark, sf_dir).select("vec_id", b.alias("b")).select("vec_id", *(F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


_CELLS = f"""t AS ({_EMB}), c AS (SELECT vec_id, i::INTEGER AS cell, [e[c * 8 + i + 1] FOR c IN range(0, 8)] AS v FROM (SELECT *, unnest(range(0, 8)) AS i FROM t)),
cells AS (SELECT vec_id, cell, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS class_id, 1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) AS prob FROM c)"""


@query(f"WITH {_CELLS} SELECT vec_id, cell, class_id, round(prob, 9) AS prob FROM cells")
def softmax_argmax(spark, sf_dir):
    return tensor.cell_classes(tensors(spark, sf_dir), 8, 8, ["vec_id"]).withColumn("prob", F.round("prob", 9))


@query(f"""WITH {_CELLS}, v AS (SELECT vec_id, CAST((cell // 4) // 2 AS INTEGER) AS block_row, CAST((cell % 4) // 2 AS INTEGER) AS block_col, class_id, count(*) AS votes, round(avg(prob), 9) AS confidence
  FROM cells WHERE class_id NOT IN (0, 1) AND prob >= 0.14 GROUP BY ALL)
  SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY vec_id, block_row, block_col ORDER BY votes DESC, class_id) = 1 AND votes >= 2""")
def block_vote(spark, sf_dir):
    cells = tensor.cell_classes(tensors(spark, sf_dir), 8, 8, ["vec_id"])
    return tensor.block_votes(cells, ["vec_id"], 4, 2, fixed.VOTES, 0.14, fixed.EXCLUDED).withColumn("confidence", F.round("confidence", 9))


@query(f"""WITH t AS ({_EMB}), a AS (SELECT vec_id, i::INTEGER AS anchor, [e[(4 + c) * 3 + i + 1] FOR c IN range(0, 15)] AS s FROM (SELECT *, unnest(range(0, 3)) AS i FROM t))
  SELECT vec_id, anchor, CAST(CASE WHEN list_max(s) > 0 THEN list_position(s, list_max(s)) - 1 ELSE 0 END AS INTEGER) AS class_id, greatest(list_max(s), 0) AS confidence FROM a""")
def argmax_scores(spark, sf_dir):
    return tensor.decode_anchors(tensors(spark, sf_dir), 15, 3, 0.0, ["vec_id"]).select("vec_id", "anchor", "class_id", "confidence")


@query(f"""WITH t AS ({_EMB}), a AS (SELECT vec_id, i::INTEGER AS anchor, e[i + 1] AS cx, e[3 + i + 1] AS cy, e[6 + i + 1] AS w, e[9 + i + 1] AS h, list_max([e[(4 + c) * 3 + i + 1] FOR c IN range(0, 15)]) AS s FROM (SELECT *, unnest(range(0, 3)) AS i FROM t))
  SELECT vec_id, anchor, s AS confidence, round(cx - w / 2, 9) AS x0, round(cy - h / 2, 9) AS y0, round(w, 9) AS w, round(h, 9) AS h FROM a WHERE s >= 0.2 AND w > 0 AND h > 0""")
def decode_boxes(spark, sf_dir):
    a = tensor.decode_anchors(tensors(spark, sf_dir), 15, 3, 0.2, ["vec_id"]).where("w > 0 AND h > 0")
    x0, y0, _, _ = G.center_box(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    return a.select("vec_id", "anchor", "confidence", F.round(x0, 9).alias("x0"), F.round(y0, 9).alias("y0"), F.round("w", 9).alias("w"), F.round("h", 9).alias("h"))


@query(f"WITH {DET} SELECT session_id, class_id, det_id, conf AS confidence FROM det QUALIFY row_number() OVER (PARTITION BY session_id, class_id ORDER BY conf DESC, det_id) <= 256")
def topk_per_tile(spark, sf_dir):
    rows = boxes(spark, sf_dir).select("session_id", "class_id", "det_id", F.col("conf").alias("confidence"))
    return tensor.top_per_tile(rows, ["session_id", "class_id"], fixed.TILE_LIMIT, "det_id")


def _lcg(s: str) -> str:
    return f"(({s}) * 1103515245 + 12345) % 4294967296"


_RAW = f"""{GRID}, seq AS (SELECT *, list_transform(range(0, 54), lambda i: 0::BIGINT) AS z, (42 + tile_index)::BIGINT AS s0 FROM tiles),
walk AS (SELECT *, list_reduce(range(0, 54), lambda acc, i: list_append(acc, {_lcg("acc[len(acc)]")}), [s0]) AS st FROM (SELECT image_id, tile_index, tile_w, tile_h, s0 FROM seq)),
v AS (SELECT image_id, tile_index, tile_w, tile_h, [xor(xor((st[3 * i + 2] // 65536) % 2048 * 1024, (st[3 * i + 3] // 65536) % 1024) * 1024, (st[3 * i + 4] // 65536) % 1024) FOR i IN range(0, 18)] AS r FROM walk),
b AS (SELECT *, unnest(range(0, 3)) AS k FROM v)"""


@query(f"""WITH {_RAW} SELECT image_id, tile_index, k::INTEGER AS ordinal, CAST(r[6 * k + 5] % 4 AS INTEGER) AS class_id, CAST(50 + r[6 * k + 6] % 50 AS INTEGER) AS percent,
  CAST(r[6 * k + 1] % 100 AS INTEGER) AS x_percent, CAST(r[6 * k + 2] % 100 AS INTEGER) AS y_percent FROM b""")
def mock_infer(spark, sf_dir):
    t = grid.tile_grid(images(spark, sf_dir)).select("image_id", "tile_index", F.col("tile_w").alias("width"), F.col("tile_h").alias("height"))
    d = mock.detections(t)
    return d.select(
        "image_id", "tile_index", "ordinal", "class_id", F.round(F.col("confidence") * 100).cast("int").alias("percent"),
        F.round(F.col("x") * 100 / (F.col("width") - 1)).cast("int").alias("x_percent"), F.round(F.col("y") * 100 / (F.col("height") - 1)).cast("int").alias("y_percent"),
    )


# --- configuration, sessions, telemetry

_PROPS = """SELECT event_id, '{"tile_size": ' || (CAST(json_extract(props, '$.k') AS INTEGER) * 64) || CASE WHEN event_id % 3 = 0 THEN '' ELSE ', "overlap": ' || (event_id % 700 - 10) END
  || CASE WHEN event_id % 4 = 0 THEN '' ELSE ', "conf_thresh": ' || ((event_id % 120) / 100.0) END || ', "max_workers": ' || (event_id % 70) || '}' AS js FROM events"""
_CONFIG = f"""j AS ({_PROPS}), p AS (SELECT event_id, coalesce(CAST(json_extract(js, '$.tile_size') AS INTEGER), 512) AS tile_size, coalesce(CAST(json_extract(js, '$.overlap') AS INTEGER), 64) AS overlap,
  coalesce(CAST(json_extract(js, '$.max_workers') AS INTEGER), 0) AS max_workers, coalesce(CAST(json_extract(js, '$.conf_thresh') AS DOUBLE), 0.5) AS conf_thresh FROM j)"""


def configs(spark, sf_dir):
    e = F.col("event_id")
    text = F.concat(
        F.lit('{"tile_size": '), (F.get_json_object("props", "$.k").cast("int") * 64).cast("string"), F.when(e % 3 == 0, "").otherwise(F.concat(F.lit(', "overlap": '), (e % 700 - 10).cast("string"))),
        F.when(e % 4 == 0, "").otherwise(F.concat(F.lit(', "conf_thresh": '), (e % 120 / 100.0).cast("string"))), F.lit(', "max_workers": '), (e % 70).cast("string"), F.lit("}"),
    )
    return table(spark, sf_dir, "events").select("event_id", config.parse_config(text).alias("c"))


@query(f"WITH {_CONFIG} SELECT event_id, tile_size, overlap, 'mock' AS model, max_workers, conf_thresh FROM p")
def config_parse(spark, sf_dir):
    return configs(spark, sf_dir).select("event_id", "c.tile_size", "c.overlap", "c.model", "c.max_workers", "c.conf_thresh")


@query(f"""WITH {_CONFIG} SELECT event_id, CASE WHEN tile_size <= 0 OR tile_size > 4096 THEN 'tile_size must be in range 1..4096' WHEN overlap < 0 OR overlap >= tile_size THEN 'overlap must be >= 0 and smaller than tile_size'
  WHEN max_workers < 0 OR max_workers > 64 THEN 'max_workers must be in range 0..64' WHEN conf_thresh < 0 OR conf_thresh > 1 THEN 'conf_thresh must be in range 0..1' END AS error FROM p""")
def config_validate(spark, sf_dir):
    return configs(spark, sf_dir).select("event_id", config.config_error(F.col("c")).alias("error"))


_STATE = "CASE event_type WHEN 'view' THEN 'LOADING' WHEN 'signup' THEN 'TILING' WHEN 'click' THEN 'PROCESSING' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'ERROR' END"
_LEGAL = "(" + ", ".join(f"('{a}', '{b}')" for a, b in fixed.TRANSITIONS) + ")"
_TELE = f"tele AS (SELECT event_id, user_id AS session_id, ts, {_STATE} AS state, value AS cpu_percent, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS tiles_done FROM events)"


def metrics(spark, sf_dir):
    state = F.create_map(*(F.lit(x) for pair in (("view", "LOADING"), ("signup", "TILING"), ("click", "PROCESSING"), ("purchase", "DONE"), ("error", "ERROR")) for x in pair))
    done = F.count("*").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), "ts", F.element_at(state, F.col("event_type")).alias("state"), F.col("value").alias("cpu_percent"), done.cast("int").alias("tiles_done"))


@query(f"WITH {_TELE}, f AS (SELECT *, lag(state) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS from_state FROM tele) SELECT event_id, from_state, state, CASE WHEN from_state IS NOT NULL THEN (from_state, state) IN {_LEGAL} END AS legal FROM f")
def fsm_validate(spark, sf_dir):
    legal = F.broadcast(fixed.transition_table(spark))  # 14 rows
    return telemetry.transitions(metrics(spark, sf_dir), "session_id", ["ts", "event_id"], "state", legal).select("event_id", "from_state", "state", "legal")


@query(f"""WITH {_TELE}, d AS (SELECT *, tiles_done - lag(tiles_done) OVER w AS more, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap FROM tele WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id))
  SELECT event_id, session_id, round(CASE WHEN more > 0 AND gap > 0 THEN more / gap ELSE 0 END, 9) AS fps FROM d""")
def fps_rate(spark, sf_dir):
    return telemetry.rate(metrics(spark, sf_dir), "session_id", ["ts", "event_id"]).select("event_id", "session_id", F.round("fps", 9).alias("fps"))


@query(f"WITH {_TELE} SELECT session_id, event_id, tiles_done FROM tele QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) <= 60")
def last60(spark, sf_dir):
    return telemetry.last_rows(metrics(spark, sf_dir), "session_id", [F.desc("ts"), F.desc("event_id")], 60).select("session_id", "event_id", "tiles_done")


@query(f"WITH {_TELE} SELECT session_id, event_id, tiles_done FROM tele QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) <= 20")
def last20(spark, sf_dir):
    return telemetry.last_rows(metrics(spark, sf_dir), "session_id", [F.desc("ts"), F.desc("event_id")], 20).select("session_id", "event_id", "tiles_done")


@query(f"WITH {_TELE} SELECT session_id, event_id, state, tiles_done FROM tele QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_metric(spark, sf_dir):
    return telemetry.latest(metrics(spark, sf_dir), "session_id", ["ts", "event_id"], "event_id", "state", "tiles_done")


_TENTHS = "CAST(floor(abs(cpu_percent) * 10 + 0.5) AS BIGINT)"
_ONE_DECIMAL = f"(CASE WHEN cpu_percent < 0 AND {_TENTHS} > 0 THEN '-' ELSE '' END || ({_TENTHS} // 10) || '.' || ({_TENTHS} % 10))"


@query(f"""WITH {_TELE} SELECT event_id, '{{"session_id":' || session_id || ',"state":"' || state || '","cpu_percent":' || {_ONE_DECIMAL} || ',"ram_used_mb":512,"ram_total_mb":2048,"fps":0.0,"tiles_done":' || tiles_done || ',"tiles_total":100,"queue_size":0}}' AS js FROM tele""")
def metrics_json(spark, sf_dir):
    rows = metrics(spark, sf_dir).withColumns({"ram_used_mb": F.lit(512), "ram_total_mb": F.lit(2048), "fps": F.lit(0.0), "tiles_total": F.lit(100), "queue_size": F.lit(0)})
    return rows.select("event_id", telemetry.metrics_document().alias("js"))


@query("""SELECT event_id, CAST(floor((event_id % 97) * 100 / (event_id % 7 + 97)) AS INTEGER) AS progress, CAST(round((event_id % 97) * 100 / (event_id % 7 + 97)) AS INTEGER) AS shown,
  '[' || repeat('#', CAST(floor((event_id % 97) * 100 / (event_id % 7 + 97)) AS INTEGER) // 5) || repeat('-', 20 - CAST(floor((event_id % 97) * 100 / (event_id % 7 + 97)) AS INTEGER) // 5) || '] ' || CAST(floor((event_id % 97) * 100 / (event_id % 7 + 97)) AS INTEGER) || '%' AS bar FROM events""")
def progress_pct(spark, sf_dir):
    done, total = F.col("event_id") % 97, F.col("event_id") % 7 + 97
    p = config.progress(done, total)
    return table(spark, sf_dir, "events").select("event_id", p.alias("progress"), config.shown_progress(done, total).alias("shown"), config.progress_bar(p).alias("bar"))


@query(f"WITH {DET}, r AS (SELECT session_id, count(*) AS n FROM det GROUP BY 1) SELECT count(*) AS runs, count(DISTINCT n) AS distinct_counts, true AS all_done, CASE WHEN count(DISTINCT n) = 1 THEN 'PASS' ELSE 'WARN' END AS verdict FROM r")
def run_consistency(spark, sf_dir):
    return telemetry.run_summary(boxes(spark, sf_dir).withColumn("status", F.lit("DONE")), "session_id", "status")


@query(f"""WITH {DET} SELECT det_id, round((radians(x1 * 0.00001) - radians(x0 * 0.00001)) * {G.WGS84_A**2 / 2} * abs(q(20 - y1 * 0.00001) - q(20 - y0 * 0.00001)), 3) AS area_m2 FROM det""".replace("q(20 - y1 * 0.00001)", "Q1").replace("q(20 - y0 * 0.00001)", "Q0").replace("Q1", "(1 - e2) * (s1 / (1 - e2 * s1 * s1) + atanh(sqrt(e2) * s1) / sqrt(e2))").replace("Q0", "(1 - e2) * (s0 / (1 - e2 * s0 * s0) + atanh(sqrt(e2) * s0) / sqrt(e2))").replace("FROM det", f"FROM (SELECT *, sin(radians(20 - y1 * 0.00001)) AS s1, sin(radians(20 - y0 * 0.00001)) AS s0, {(1 / 298.257223563) * (2 - 1 / 298.257223563)!r}::DOUBLE AS e2 FROM det)").replace("0.00001", "0.00001::DOUBLE"))
def ellipsoid_area(spark, sf_dir):
    lon = {c: F.col(c) * 0.00001 for c in ("x0", "x1")}
    lat = {c: 20 - F.col(c) * 0.00001 for c in ("y0", "y1")}
    return boxes(spark, sf_dir).select("det_id", F.round(G.ellipsoidal_area(lon["x0"], lat["y0"], lon["x1"], lat["y1"]), 3).alias("area_m2"))


@query(f"WITH {DET} SELECT session_id, class_id, count(*) AS n, CAST(sum(det_id) AS BIGINT) AS ids FROM det GROUP BY ALL")
def features_by_class(spark, sf_dir):
    """Features grouped by class, as counts and sums over the collected lists."""
    g = boxes(spark, sf_dir).groupBy("session_id", "class_id").agg(F.collect_list("det_id").alias("all"))
    return g.select("session_id", "class_id", F.size("all").cast("long").alias("n"), F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))


@query(f"WITH {DET}, r AS (SELECT session_id, count(*) AS n FROM det GROUP BY 1) SELECT session_id, rpad(session_id::VARCHAR, greatest(6, length(session_id::VARCHAR))::INTEGER, ' ') || ' ' || rpad(n::VARCHAR, greatest(12, length(n::VARCHAR))::INTEGER, ' ') || ' DONE' AS line FROM r")
def report_lines(spark, sf_dir):
    n = boxes(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n"))
    return n.select("session_id", telemetry.report_line((F.col("session_id"), 6), (F.col("n"), 12), (F.lit("DONE"), 0)).alias("line"))


# --- sessions and results


def _geo_boxes(spark, sf_dir):
    """boxes with a Web Mercator transform by session."""
    s = F.col("session_id").cast("double")
    gt = F.array(F.lit(1e6) + s * 1000, F.lit(0.5), F.lit(0.0), F.lit(5e6) + s * 500, F.lit(0.0), F.lit(-0.5))
    return boxes(spark, sf_dir).withColumn("gt", gt)


_LON = "round((1e6 + session_id * 1000 + {0} * 0.5::DOUBLE) / 6378137.0::DOUBLE * (180 / pi()), 8)"
_LAT = "round((2 * atan(exp((5e6 + session_id * 500 - {0} * 0.5::DOUBLE) / 6378137.0::DOUBLE)) - pi() / 2) * (180 / pi()), 8)"


@query(f"""WITH {DET} SELECT det_id, {_LON.format("x0")} AS west, {_LAT.format("y1")} AS south, {_LON.format("x1")} AS east, {_LAT.format("y0")} AS north FROM det""")
def detections_lonlat(spark, sf_dir):
    rows = session.mapped(_geo_boxes(spark, sf_dir), F.col("gt"), F.lit(3857))
    at = F.col("ring")
    return rows.select("det_id", F.round(at[0]["lon"], 8).alias("west"), F.round(at[2]["lat"], 8).alias("south"), F.round(at[2]["lon"], 8).alias("east"), F.round(at[0]["lat"], 8).alias("north"))


@query(f"""WITH {DET}, f AS (SELECT session_id, det_id, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[['||x0||'.0,'||y0||'.0],['||x1||'.0,'||y0||'.0],['||x1||'.0,'||y1||'.0],['||x0||'.0,'||y1||'.0],['||x0||'.0,'||y0||'.0]]]}},"properties":{{"id":'||det_id||',"class_id":'||class_id||',"confidence":'||conf||',"session_id":'||session_id||',"tile_index":0}}}}' AS feature FROM det WHERE conf >= 99)
  SELECT session_id, '{{"type":"FeatureCollection","features":[' || string_agg(feature, ',' ORDER BY feature) || ']}}' AS document FROM f GROUP BY session_id""")
def feature_collections(spark, sf_dir):
    """The best detections of each session as one document."""
    rows = boxes(spark, sf_dir).where("conf >= 99").withColumn("tile_index", F.lit(0))
    rows = rows.withColumn("ring", G.ring(G.corners(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))), "lon", "lat"))
    return session.feature_collection(rows.select("session_id", session.feature().alias("feature")))


_CUT = "CAST(floor({0} * 100 + 1e-6) / 100 AS DOUBLE)"


@query(f"""WITH {_AREAS}, p AS (SELECT session_id, class_id, area, {_CUT.format(f"(area * 100.0::DOUBLE / {SIDE * SIDE})")} AS percent FROM areas WHERE area > 0)
  SELECT session_id, '{{"classes":[' || string_agg('{{"class_id":' || class_id || ',"area":' || area || ',"percent":' || percent || '}}', ',' ORDER BY area DESC, class_id) || '],"unclassified_percent":'
  || {_CUT.format(f"greatest(0.0::DOUBLE, 100.0::DOUBLE - sum(area) * 100.0::DOUBLE / {SIDE * SIDE})")} || '}}' AS document FROM p GROUP BY session_id""")
def coverage_documents(spark, sf_dir):
    return session.coverage_document(_areas(spark, sf_dir), SIDE * SIDE)


@query("""WITH s AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'PROCESSING' ELSE 'ERROR' END AS status, CAST(o_orderkey % 97 AS INTEGER) AS total, CAST(o_orderkey % 97 * (o_orderkey % 5) // 4 AS INTEGER) AS done FROM orders)
  SELECT id AS session_id, '{"session_id":' || id || ',"filename":"scan ' || id || '.tif","status":"' || status || '","tile_total":' || total || ',"tile_done":' || done || ',"progress":' || CASE WHEN total > 0 THEN done * 100 // total ELSE 0 END
  || CASE WHEN status = 'ERROR' THEN ',"error_message":"Cancelled by user."' ELSE '' END
  || CASE WHEN id % 3 = 0 THEN ',"footprint":{"type":"Feature","properties":{"kind":"image_footprint"},"geometry":{"type":"Polygon","coordinates":[[[' || id % 90 || '.0,0.0],[' || id % 90 + 1 || '.0,0.0],[' || id % 90 + 1 || '.0,1.0],[' || id % 90 || '.0,1.0],[' || id % 90 || '.0,0.0]]]}}' ELSE '' END || '}' AS document FROM s""")
def status_documents(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "O", "PROCESSING").otherwise("ERROR")
    x = (k % 90).cast("double")
    ring = G.ring(G.corners(x, F.lit(0.0), x + 1, F.lit(1.0)), "lon", "lat")
    outline = F.when(k % 3 == 0, ring).otherwise(F.slice(ring, 1, 2))
    total, done = (k % 97).cast("int"), F.floor(k % 97 * (k % 5) / 4).cast("int")
    text = config.status_document(k, F.concat(F.lit("scan "), k.cast("string"), F.lit(".tif")), status, done, total, F.when(status == "ERROR", "Cancelled by user.").otherwise(""), outline)
    return table(spark, sf_dir, "orders").select(k.alias("session_id"), text.alias("document"))


@query(f"""WITH {DET} SELECT det_id, class_id, 'POLYGON((' || x0 || '.00000000 ' || y0 || '.00000000,' || x1 || '.00000000 ' || y0 || '.00000000,' || x1 || '.00000000 ' || y1 || '.00000000,' || x0 || '.00000000 ' || y1 || '.00000000,' || x0 || '.00000000 ' || y0 || '.00000000))' AS wkt
  FROM det WHERE session_id = 3 AND det_id % 7 <> 0""")
def stored_scan(spark, sf_dir):
    """Detections appended to a folder a session, those without a ring left out; then one session's scan."""
    rows = boxes(spark, sf_dir)
    ring = G.ring(G.corners(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))), "lon", "lat")
    path = f"{shared_dir(spark)}/detections-{uuid.uuid4().hex}"
    session.save_detections(rows.withColumn("ring", F.when(F.col("det_id") % 7 == 0, F.slice(ring, 1, 3)).otherwise(ring)), path)
    return session.load_detections(spark, path, 3).select("det_id", "class_id", "wkt")


@query(f"""WITH {DET}, f AS (SELECT session_id, class_id, det_id, conf, x0 * 0.25::DOUBLE AS x0, y0 * 0.25::DOUBLE AS y0, x1 * 0.25::DOUBLE AS x1, y1 * 0.25::DOUBLE AS y1 FROM det),
  i AS (SELECT a.det_id AS src, b.det_id AS dst, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS sides
  FROM f a JOIN f b ON a.session_id = b.session_id AND a.class_id = b.class_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND (a.conf > b.conf OR a.conf = b.conf AND a.det_id < b.det_id))
  SELECT src, dst FROM i WHERE CAST(inter / (sides - inter) AS FLOAT) > CAST(0.45 AS FLOAT)""")
def iou_float_pairs(spark, sf_dir):
    """Conflicts by the IoU of fractional boxes in single precision, at the threshold of a tile."""
    b = boxes(spark, sf_dir).withColumns({c: F.col(c) * 0.25 for c in ("x0", "y0", "x1", "y1")})
    return nms.conflicts(b, ["session_id", "class_id"], 16, nms.iou_over(fixed.TILE_IOU))


@query(f"""WITH {DET} SELECT det_id, 3 AS n, CAST(x0 + 0.5 AS DOUBLE) AS first_x, CAST(-y1 AS DOUBLE) AS last_y FROM det""")
def flat_points(spark, sf_dir):
    """Three points out of one to three levels of brackets."""
    x0, y0, y1 = (F.col(c).cast("string") for c in ("x0", "y0", "y1"))
    flat = F.concat(F.lit("[["), x0, F.lit(".5,"), y0, F.lit("],["), x0, F.lit(" , 1e2],["), x0, F.lit(",-"), y1, F.lit("]]"))
    deep = (F.col("det_id") % 3).cast("int")
    at = G.flat_points(F.concat(F.repeat(F.lit("["), deep), flat, F.repeat(F.lit("]"), deep)))
    return boxes(spark, sf_dir).select("det_id", F.size(at).alias("n"), at[0]["x"].alias("first_x"), at[F.size(at) - 1]["y"].alias("last_y"))


# --- outlines and areas

_L = "det AS (SELECT det_id, session_id, class_id, conf, x0, y0, (x0 + x1) // 2 AS x1, y1 FROM det0 UNION ALL SELECT det_id, session_id, class_id, conf, (x0 + x1) // 2, (y0 + y1) // 2, x1, y1 FROM det0)"


def outlines(spark, sf_dir):
    """Each box without its upper right quarter, as an outline."""
    b = boxes(spark, sf_dir)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    mx, my = F.floor((x0 + x1) / 2), F.floor((y0 + y1) / 2)
    return b.withColumn("outline", G.ring([(x0, y0), (mx, y0), (mx, my), (x1, my), (x1, y1), (x0, y1)]))


@query(f"WITH {_AREAS.replace('det AS (', 'det0 AS (', 1).replace('clipped AS', _L + ', clipped AS', 1)} SELECT * FROM areas")
def outline_coverage(spark, sf_dir):
    """Coverage of rectilinear outlines by class priority."""
    return coverage.class_areas(coverage.clip(coverage.shape_boxes(outlines(spark, sf_dir)), SIDE, SIDE))


@query(f"""WITH {DET} SELECT det_id, (x1 - x0) * (y1 - y0) - (x1 - (x0 + x1) // 2) * ((y0 + y1) // 2 - y0) AS area, x0 <= 300 AND x1 >= 200 AND y0 <= 900 AND y1 >= 100 AND (x0 + x1) // 2 >= 200 OR
  (x0 + x1) // 2 <= 300 AND x1 >= 200 AND (y0 + y1) // 2 <= 900 AND y1 >= 100 AS meets FROM det""")
def outline_predicates(spark, sf_dir):
    """Area of each outline, and whether it meets a window."""
    window = dict(zip(("x0", "y0", "x1", "y1"), map(F.lit, (200, 100, 300, 900)), strict=True))
    inside = G.ring_boxes(F.col("outline"))
    area = F.aggregate(F.transform(inside, G.box_area), F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))
    return outlines(spark, sf_dir).select("det_id", area.alias("area"), F.exists(inside, lambda b: G.meets(b, window)).alias("meets"))


_E2 = G.WGS84_F * (2 - G.WGS84_F)
# Every row of pixels by itself again: its runs of pixels have the ellipsoidal area between its parallels.
_METRES = _AREAS[: _AREAS.index("tot AS (")] + f"""pixel AS (SELECT session_id, y, abs(q1 - q0) * 0.5 / 6378137.0::DOUBLE * {G.WGS84_A**2 / 2} AS m2 FROM (SELECT *, (1 - e2) * (s0 / (1 - e2 * s0 * s0) + atanh(sqrt(e2) * s0) / sqrt(e2)) AS q0, (1 - e2) * (s1 / (1 - e2 * s1 * s1) + atanh(sqrt(e2) * s1) / sqrt(e2)) AS q1
  FROM (SELECT session_id, y, {_E2!r}::DOUBLE AS e2, tanh((5e6 + session_id * 500 - y * 0.5::DOUBLE) / 6378137.0) AS s0, tanh((5e6 + session_id * 500 - (y + 1) * 0.5::DOUBLE) / 6378137.0) AS s1 FROM (SELECT DISTINCT session_id, y FROM line)))),
tot AS (SELECT run.session_id, rank, sum(greatest(0, x1 - greatest(x0, coalesce(far, x0))) * m2) AS total FROM run JOIN pixel ON run.session_id = pixel.session_id AND run.y = pixel.y GROUP BY ALL),
metres AS (SELECT rk.session_id, rk.class_id, round(coalesce(total, 0) - coalesce(lag(coalesce(total, 0)) OVER (PARTITION BY rk.session_id ORDER BY rk.rank), 0), 2) AS area_m2 FROM rk LEFT JOIN tot ON rk.session_id = tot.session_id AND rk.rank = tot.rank)"""


@query(f"WITH {_METRES} SELECT * FROM metres")
def coverage_metres(spark, sf_dir):
    """Square metres of each class's own area, on the ellipsoid."""
    s = F.col("session_id").cast("double")
    gt = F.array(F.lit(1e6) + s * 1000, F.lit(0.5), F.lit(0.0), F.lit(5e6) + s * 500, F.lit(0.0), F.lit(-0.5))
    areas = coverage.class_areas(coverage.clip(boxes(spark, sf_dir), SIDE, SIDE), gt, 3857)
    return areas.select("session_id", "class_id", F.round("area_m2", 2).alias("area_m2"))


@query(f"""WITH b AS (SELECT {_FLOATS} FROM orders) SELECT det_id, CASE WHEN det_id % 2 = 0 THEN 448 + CAST(round(x) AS INTEGER) ELSE 448 + CAST(trunc(x) AS INTEGER) END AS x0,
  CASE WHEN det_id % 2 = 0 THEN 896 + CAST(round(y + h) AS INTEGER) ELSE 896 + CAST(trunc(y) AS INTEGER) + CAST(trunc(h) AS INTEGER) END AS y1 FROM b""")
def detection_rings(spark, sf_dir):
    """Outlines of four points round, boxes (here: outlines of three points or none) truncate."""
    x, y, w, h = (F.col(c) for c in "xywh")
    full = G.ring(G.corners(x, y, x + w, y + h))
    polygon = F.when(F.col("det_id") % 2 == 0, full).when(F.col("det_id") % 3 == 0, F.slice(full, 1, 3)).otherwise(F.slice(full, 1, 0))
    b = G.bounds(G.detection_ring(F.lit(448), F.lit(896), polygon, x, y, w, h))
    return float_boxes(spark, sf_dir).select("det_id", b["x0"].alias("x0"), b["y1"].alias("y1"))


@query("SELECT o_orderkey AS id, round(CAST((o_orderkey * 7919 % 60000) / 10000.0 AS DOUBLE) - 3 + (o_orderkey % 60 + 1) * 6 - 183, 7) AS lon, round(CAST((o_orderkey * 104729 % 840000) / 10000.0 AS DOUBLE), 7) AS lat FROM orders")
def utm_positions(spark, sf_dir):
    """Positions put into the grid of their zone and taken back."""
    k = F.col("o_orderkey")
    zone = k % 60 + 1
    lon, lat = k * 7919 % 60000 / 10000.0 - 3 + zone * 6 - 183, k * 104729 % 840000 / 10000.0
    at = table(spark, sf_dir, "orders").select(k.alias("id"), (32600 + zone).cast("int").alias("epsg"), G.from_wgs84_utm(lon, lat, zone).alias("p"))
    return at.select("id", G.to_wgs84(F.col("epsg"), F.col("p.x"), F.col("p.y")).alias("g")).select("id", F.round("g.lon", 7).alias("lon"), F.round("g.lat", 7).alias("lat"))


# --- sources, tiles, probes and logs


@query("""WITH p AS (SELECT o_orderkey AS id, 'scans/' || o_orderkey || '.' || CASE o_orderkey % 5 WHEN 0 THEN 'tif' WHEN 1 THEN 'TIFF' WHEN 2 THEN 'png' WHEN 3 THEN 'tar.TIF' ELSE 'JPG' END AS path, o_orderkey % 7 <> 0 AS found, o_orderkey % 11 <> 0 AS opens FROM orders)
  SELECT id, CASE WHEN NOT found THEN 'File not found: ' || path WHEN lower(path) NOT LIKE '%.tif' AND lower(path) NOT LIKE '%.tiff' THEN 'Unsupported format: .' || CASE WHEN path LIKE '%.png' THEN 'png' ELSE 'jpg' END || ' (expected .tif/.tiff)' WHEN NOT opens THEN 'Cannot open file: ' || path END AS fault FROM p""")
def raster_faults(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("tif", "TIFF", "png", "tar.TIF", "JPG"))), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), config.raster_fault(F.concat(F.lit("scans/"), k.cast("string"), F.lit("."), kind), k % 7 != 0, k % 11 != 0).alias("fault"))


@query("SELECT o_orderkey AS id, o_orderkey % 12 = (o_orderkey % 4) * (o_orderkey % 3) AS ok FROM orders")
def valid_buffers(spark, sf_dir):
    """Tiles whose pixels have the length that their size says."""
    k = F.col("o_orderkey")
    pixels = F.encode(F.repeat(F.lit("x"), (k % 12).cast("int")), "utf-8")
    return table(spark, sf_dir, "orders").select(k.alias("id"), grid.buffer_ok(pixels, k % 4, k % 3, F.lit(1)).alias("ok"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_suppkey % 5 > 0 THEN 100.0 * (1 - (l_partkey % (l_suppkey % 5 + 1)) / (l_suppkey % 5)::DOUBLE) ELSE 0 END, 9) AS cpu, CAST((l_partkey * 4096 + 100000) // 1024 AS INTEGER) AS ram_mb FROM lineitem""")
def os_probe(spark, sf_dir):
    """CPU use between two readings of idle and total time, and memory in use."""
    span, idle = F.col("l_suppkey") % 5, F.col("l_partkey") % (F.col("l_suppkey") % 5 + 1)
    before = F.lit(1000)
    free = F.col("l_partkey") % 1000
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(telemetry.cpu_percent(before, before + 500, before + span - idle, before + 500 + span), 9).alias("cpu"),
        telemetry.ram_used_mb(F.col("l_partkey") * 4096 + 100000 + free, free).alias("ram_mb"),
    )


@query(f"""WITH log AS (SELECT user_id AS session_id, event_id, {_STATE} AS status, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 500 AS INTEGER) END AS tile_done FROM events)
  SELECT session_id, arg_max(status, event_id) FILTER (WHERE status IS NOT NULL) AS status, arg_max(tile_done, event_id) FILTER (WHERE tile_done IS NOT NULL) AS tile_done, max(event_id) AS updated FROM log GROUP BY session_id""")
def sessions_now(spark, sf_dir):
    """Newest status and progress out of an append-only log; records without a progress leave it as it was."""
    e = F.col("event_id")
    log = metrics(spark, sf_dir).select("session_id", F.timestamp_seconds(e).alias("ts"), F.col("state").alias("status"), F.when(e % 3 != 0, (e % 500).cast("int")).alias("tile_done"))
    return session.current_sessions(log).select("session_id", "status", "tile_done", F.unix_seconds("updated_at").alias("updated"))


@query(f"""WITH {_TELE} SELECT event_id, state IN ('DONE', 'ERROR') AS terminal, state IN ('TILING', 'PROCESSING', 'STITCHING') AS working FROM tele""")
def state_predicates(spark, sf_dir):
    return metrics(spark, sf_dir).select("event_id", F.col("state").isin(*fixed.TERMINAL).alias("terminal"), F.col("state").isin(*fixed.WORKING).alias("working"))


@query(f"""WITH {DET}, r AS (SELECT session_id, count(*) AS n, bool_and(conf < 99 OR det_id % 2 = 0) AS ok FROM det GROUP BY 1)
  SELECT count(*) AS runs, count(DISTINCT n) AS distinct_counts, bool_and(ok) AS all_done, CASE WHEN count(DISTINCT n) = 1 AND bool_and(ok) THEN 'PASS' ELSE 'WARN' END AS verdict FROM r""")
def run_failures(spark, sf_dir):
    """The summary of runs some of which failed."""
    failed = (F.col("conf") >= 99) & (F.col("det_id") % 2 != 0)
    return telemetry.run_summary(boxes(spark, sf_dir).withColumn("status", F.when(failed, "ERROR").otherwise("DONE")), "session_id", "status")


@query(f"""WITH {DET}, r AS (SELECT session_id, count(*) AS n, CASE WHEN bool_and(conf < 99 OR det_id % 2 = 0) THEN 'DONE' ELSE 'ERROR' END AS state FROM det GROUP BY 1)
  SELECT 0 AS part, NULL::BIGINT AS run, 'Run    Detections   State' AS line UNION ALL SELECT 1, NULL, repeat('-', 60)
  UNION ALL SELECT 2, session_id, rpad(session_id::VARCHAR, 6, ' ') || ' ' || rpad(n::VARCHAR, 12, ' ') || ' ' || state FROM r
  UNION ALL SELECT 3, NULL, CASE WHEN min(n) = max(n) THEN 'PASS: All ' || count(*) || ' runs produced ' || min(n) || ' detections (consistent)' ELSE 'WARN: Inconsistent detection counts: ' || min(n) || ' to ' || max(n) END FROM r
  UNION ALL SELECT 4, NULL, CASE WHEN bool_and(state = 'DONE') THEN 'PASS' ELSE 'FAIL' END || ': All sessions reached DONE state' FROM r""")
def run_report(spark, sf_dir):
    """The whole report of runs some of which failed."""
    failed = F.bool_or((F.col("conf") >= 99) & (F.col("det_id") % 2 != 0))
    runs = boxes(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n"), F.when(failed, "ERROR").otherwise("DONE").alias("status"))
    return telemetry.report(runs, "session_id", [("Run", "session_id", 6), ("Detections", "n", 12), ("State", "status", 0)])


_TILE_DET = """det AS (SELECT o_orderkey // 7 AS tile, o_orderkey AS det_id, CAST(o_orderkey % 2 AS INTEGER) AS class_id, CAST(o_orderkey * 31 % 50 AS INTEGER) AS conf, o_custkey % 9 AS x0, o_orderkey * 7919 % 5 AS y0, o_custkey % 9 + 10 + o_orderkey % 3 AS x1, o_orderkey * 7919 % 5 + 20 AS y1 FROM orders),
e0 AS MATERIALIZED (SELECT a.tile, a.det_id AS src, b.det_id AS dst FROM det a JOIN det b ON a.tile = b.tile AND a.class_id = b.class_id AND (a.conf > b.conf OR (a.conf = b.conf AND a.det_id < b.det_id))
  AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
  WHERE 29 * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 9 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0))), """
# A class of a tile has four boxes at most, so four rounds settle it.
_TILE_NMS = _TILE_DET + ", ".join(f"""r{i} AS MATERIALIZED (SELECT DISTINCT tile, src AS id FROM e{i} WHERE (tile, src) NOT IN (SELECT (tile, dst) FROM e{i})), g{i} AS MATERIALIZED (SELECT DISTINCT e{i}.tile, dst AS id FROM e{i} JOIN r{i} ON e{i}.tile = r{i}.tile AND src = id),
e{i + 1} AS MATERIALIZED (SELECT * FROM e{i} WHERE (tile, dst) NOT IN (SELECT (tile, id) FROM g{i}) AND (tile, src) NOT IN (SELECT (tile, id) FROM g{i}) AND (tile, src) NOT IN (SELECT (tile, id) FROM r{i}))""" for i in range(4))
_TILE_GONE = " UNION ALL ".join(f"SELECT tile, id FROM g{i}" for i in range(4))


@query(f"WITH {_TILE_NMS} SELECT tile, det_id, class_id, conf FROM det WHERE (tile, det_id) NOT IN (SELECT (tile, id) FROM ({_TILE_GONE}))")
def tile_suppression(spark, sf_dir):
    """Suppression within tiles, as the models' decoders do it."""
    k, x, y = F.col("o_orderkey"), F.col("o_custkey") % 9, F.col("o_orderkey") * 7919 % 5
    rows = table(spark, sf_dir, "orders").select(F.floor(k / 7).alias("tile"), k.alias("det_id"), (k % 2).cast("int").alias("class_id"), (k * 31 % 50).cast("int").alias("conf"), x.alias("x"), y.alias("y"), (k % 3 + 10).alias("w"), F.lit(20).alias("h"))

    def kept(frame):
        frame = frame.sort_values("det_id")
        at = inference.tile_suppressed(frame[["x", "y", "w", "h"]].to_numpy(float), frame["class_id"].to_numpy(), frame["conf"].to_numpy(float))
        return frame.iloc[at][["tile", "det_id", "class_id", "conf"]]

    return rows.groupBy("tile").applyInPandas(kept, "tile long, det_id long, class_id int, conf int")


_GREY = "list_transform(list_transform(embedding, lambda v: v::DOUBLE), lambda v: CAST(least(255, abs(trunc(v * 400))) AS INTEGER))"


def grey(spark, sf_dir):
    """Images of 8 x 8 bytes, out of embeddings."""
    level = F.transform("embedding", lambda v: F.least(F.lit(255), F.abs((v.cast("double") * 400).cast("int"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.unhex(F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), "")).alias("pixels"))


@query(f"""WITH g AS (SELECT vec_id, {_GREY} AS e FROM embeddings), p AS (SELECT vec_id, e, r, c, least(r // 2 + 1, 7) AS r1, least(c // 2 + 1, 7) AS c1 FROM g, range(0, 16) a(r), range(0, 16) b(c)),
  v AS (SELECT vec_id, r, c, CASE WHEN r % 2 = 0 THEN (CASE WHEN c % 2 = 0 THEN e[r // 2 * 8 + c // 2 + 1] ELSE (e[r // 2 * 8 + c // 2 + 1] + e[r // 2 * 8 + c1 + 1]) // 2 END)
    WHEN c % 2 = 0 THEN (e[r // 2 * 8 + c // 2 + 1] + e[r1 * 8 + c // 2 + 1]) // 2 ELSE (e[r // 2 * 8 + c // 2 + 1] + e[r // 2 * 8 + c1 + 1] + e[r1 * 8 + c // 2 + 1] + e[r1 * 8 + c1 + 1]) // 4 END AS v FROM p)
  SELECT vec_id, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (r * 16 + c)) AS BIGINT) AS weighted FROM v GROUP BY vec_id""")
def resized_images(spark, sf_dir):
    """Images resized to twice their sides, in the middle of a model's canvas without a margin."""

    def run(frames):
        for frame in frames:
            made = [inference.prepared(np.frombuffer(p, np.uint8).reshape(8, 8, 1), 16, 114)[0][0, 1] for p in frame["pixels"]]
            whole = [np.rint(m * np.float32(255)).astype(np.int64) for m in made]
            yield pd.DataFrame({"vec_id": frame["vec_id"], "total": [int(w.sum()) for w in whole], "weighted": [int((w.ravel() * np.arange(256)).sum()) for w in whole]})

    return grey(spark, sf_dir).mapInPandas(run, "vec_id long, total long, weighted long")


@query("""WITH m AS (SELECT vec_id, array_to_string(list_transform(embedding[1:16], lambda v: CASE WHEN v > 0 THEN '1' ELSE ' ' END), '') AS t FROM embeddings),
  r AS (SELECT vec_id, list_max(list_transform(string_split(t, ' '), lambda x: length(x))) AS n FROM m) SELECT vec_id, n AS area, CASE WHEN n > 0 THEN 2 * n + 2 ELSE 0 END AS points FROM r""")
def largest_rings(spark, sf_dir):
    """The largest outline of a mask of one row of cells: its longest run."""

    def run(frames):
        for frame in frames:
            found = [rings.largest_ring(np.array(e[:16], float).reshape(1, 16) > 0) for e in frame["embedding"]]
            yield pd.DataFrame({"vec_id": frame["vec_id"], "area": [int(rings.area(f)) if f else 0 for f in found], "points": [len(f) for f in found]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, area long, points long")


_RASTERS = "img AS (SELECT n_nationkey AS k, CAST(60 + n_nationkey AS INTEGER) AS width, CAST(40 + n_nationkey % 7 AS INTEGER) AS height FROM nation)"


def rasters(spark, sf_dir) -> str:
    """A folder with one small GeoTIFF a nation, written by the tasks."""
    folder = f"{shared_dir(spark)}/rasters-{uuid.uuid4().hex}"

    def write(frames):
        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            for k in frame["n_nationkey"].tolist():
                y, x = np.mgrid[0 : 40 + k % 7, 0 : 60 + k]
                image = np.stack([(x * 7 + y * 13 + k) % 251, (x + y) % 256, (x * y) % 256], axis=2).astype(np.uint8)
                geotiff.write_geotiff(f"{folder}/{k}.tif", image, [float(k), 0.5, 0.0, 50.0, 0.0, -0.25], 32633, 32 if k % 2 else 0, 8)
            yield pd.DataFrame({"n": [len(frame)]})

    table(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()
    spark.dataSource.register(geotiff.GeoTiffSource)
    return folder


_NAME = r"CAST(regexp_extract(path, '([0-9]+)\.tif$', 1) AS BIGINT) AS k"


@query(f"WITH {_RASTERS} SELECT CAST(k AS BIGINT) AS k, width, height, 3 AS band_count, 32633 AS epsg, CAST(k AS DOUBLE) AS west, 50.0::DOUBLE AS north FROM img")
def raster_metadata(spark, sf_dir):
    """Metadata rows of GeoTIFF files."""
    meta = spark.read.format("geotiff").option("mode", "meta").load(rasters(spark, sf_dir))
    return meta.selectExpr(_NAME, "width", "height", "band_count", "epsg", "geo_transform[0] AS west", "geo_transform[3] AS north")


@query(f"""WITH {_RASTERS}, t AS (SELECT k, width, height, i AS x, j AS y, least(32, width - i) AS tile_w, least(32, height - j) AS tile_h FROM img, range(0, 96, 24) a(i), range(0, 48, 24) b(j) WHERE i < width AND j < height),
  p AS (SELECT *, x + dx AS px, y + dy AS py FROM t, range(0, 32) c(dx), range(0, 32) d(dy) WHERE dx < tile_w AND dy < tile_h)
  SELECT CAST(k AS BIGINT) AS k, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(tile_w AS INTEGER) AS tile_w, CAST(tile_h AS INTEGER) AS tile_h, CAST(sum((px * 7 + py * 13 + k) % 251 + 2 * ((px + py) % 256) + 3 * (px * py % 256)) AS BIGINT) AS total FROM p GROUP BY ALL""")
def raster_windows(spark, sf_dir):
    """Overlapping windows of GeoTIFF files, stored by strips or tiles, with a sum of their pixels by band."""
    tiles = spark.read.format("geotiff").option("tile", 32).option("overlap", 8).load(rasters(spark, sf_dir)).where("read_ok")

    def sums(frames):
        for frame in frames:
            frame["total"] = [int(np.frombuffer(p, np.uint8).reshape(-1, 3).sum(axis=0) @ (1, 2, 3)) for p in frame["pixels"]]
            yield frame.drop(columns="pixels")

    return tiles.selectExpr(_NAME, "x", "y", "tile_w", "tile_h", "pixels").mapInPandas(sums, "k long, x int, y int, tile_w int, tile_h int, total long")
