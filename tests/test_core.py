import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilequilt.functions import geometry as G
from tilequilt.functions import mock
from tilequilt.operators import config, coverage, grid, nms, rings, telemetry
from tilequilt.plans import queries, session
from tilequilt.sources import geotiff

SF = "/root/testdata/sf0.001"
TABLES = "part orders lineitem events embeddings nation".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SF).toArrow()) == rows(duck.sql(queries.ORACLES[name]).to_arrow_table())


@pytest.mark.parametrize(("w", "h", "tile", "overlap", "tiles", "kept"), [(64, 64, 64, 0, 1, 3), (100, 70, 64, 16, 6, 18), (512, 512, 512, 64, 4, 12), (1024, 768, 256, 32, 20, 60), (23000, 23000, 512, 64, 2704, 8094)])
def test_mock_run_golden_counts(spark, w, h, tile, overlap, tiles, kept):
    images = spark.createDataFrame([(1, w, h)], "session_id long, width int, height int")
    assert grid.tile_grid(images, tile, overlap).count() == tiles
    assert session.mock_run(images, tile, overlap).count() == kept


def test_mock_boxes(spark):
    tiles = spark.createDataFrame([(0, 512, 512), (2703, 152, 152)], "tile_index int, width int, height int")
    got = [tuple(round(v, 2) for v in r) for r in mock.detections(tiles).orderBy("tile_index", "ordinal").select("x", "y", "w", "h", "class_id", "confidence").collect()]
    assert got[:3] == [(168.63, 434.35, 66.43, 76.65, 1, 0.63), (5.11, 490.56, 56.21, 20.44, 3, 0.71), (178.85, 439.46, 132.86, 71.54, 3, 0.92)]
    assert got[3:] == [(18.12, 147.98, 51.34, 3.02, 2, 0.55), (89.09, 80.03, 49.83, 45.30, 1, 0.90), (122.31, 7.55, 28.69, 24.16, 0, 0.74)]


@pytest.mark.parametrize(("other", "same", "kept"), [((0, 0, 10, 5), True, 2), ((0, 0, 10, 6), True, 1), ((0, 0, 10, 6), False, 2), ((5, 0, 15, 10), True, 2)])
def test_suppression_thresholds(spark, other, same, kept):
    b = spark.createDataFrame([(1, 0, 0.9, 0, 0, 10, 10), (2, 0 if same else 1, 0.8, *other)], "det_id long, class_id int, conf double, x0 int, y0 int, x1 int, y1 int")
    assert nms.suppress(b, ["class_id"]).count() == kept


def test_suppression_chain(spark):
    b = spark.createDataFrame([(1, 0, 0.9, 0, 0, 10, 10), (2, 0, 0.8, 3, 0, 13, 10), (3, 0, 0.7, 6, 0, 16, 10)], "det_id long, class_id int, conf double, x0 int, y0 int, x1 int, y1 int")
    assert sorted(r[0] for r in nms.suppress(b, ["class_id"]).select("det_id").collect()) == [1, 3]


@pytest.mark.parametrize(("confs", "areas"), [((0.9, 0.8), {2: 60, 3: 20}), ((0.5, 0.5), {2: 60, 3: 20}), ((0.8, 0.9), {2: 50, 3: 30})])
def test_coverage(spark, confs, areas):
    b = spark.createDataFrame([(1, 2, confs[0], 0, 0, 6, 10), (1, 3, confs[1], 4, 0, 10, 5)], "session_id long, class_id int, conf double, x0 int, y0 int, x1 int, y1 int")
    c = coverage.coverage(coverage.class_areas(b), 100).collect()
    assert {r["class_id"]: r["area"] for r in c} == areas
    assert c[0]["unclassified_percent"] == 20.0


def test_rings():
    assert len(rings.largest_ring(np.ones((2, 2), bool))) == 8 and rings.area(rings.largest_ring(np.ones((2, 2), bool))) == 4
    for m in ([[1, 0], [0, 1]], [[0, 1], [1, 0]]):
        ring = rings.largest_ring(np.array(m, bool))
        assert len(ring) == 8 and rings.area(ring) == 2
    hole = np.ones((3, 3), bool)
    hole[1, 1] = False
    assert len(rings.largest_ring(hole)) == 12 and rings.area(rings.largest_ring(hole)) == 9
    assert rings.largest_ring(np.zeros((2, 2), bool)) == []


def test_state_machine():
    m, seen = session.StateMachine(), []
    m.on_change(lambda a, b: seen.append((a, b)))
    assert not m.transition("PROCESSING") and not m.transition("DONE") and m.state == "IDLE"
    assert all(m.transition(s) for s in ("LOADING", "TILING", "PROCESSING", "STITCHING", "SAVING", "DONE")) and m.terminal
    assert seen[0] == ("IDLE", "LOADING") and len(seen) == 6
    assert m.transition("IDLE") and not m.terminal
    m.force("ERROR")
    assert m.state == "ERROR" and m.transition("RECOVERING") and m.transition("IDLE")


def test_engine(spark):
    e = session.Engine(spark)
    sid = e.register("a.tif", 512, 512)
    with pytest.raises(ValueError, match="overlap"):
        e.configure(sid, tile_size=64, overlap=64)
    e.configure(sid, conf_thresh=0.0)
    assert e.start(sid).count() == 12
    assert e.status(sid)["progress"] == 100 and e.status(sid)["status"] == "DONE"
    e.cancel(sid)
    assert e.status(sid)["error_message"] == "Cancelled by user."
    with pytest.raises(KeyError):
        e.status(99)


def test_rate(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 0), (1, "2024-01-01 00:00:01", 10), (1, "2024-01-01 00:00:02", 10), (1, "2024-01-01 00:00:04", 30), (1, "2024-01-01 00:00:05", 0)], "s int, ts string, tiles_done int").withColumn("ts", F.to_timestamp("ts"))
    assert [r["fps"] for r in telemetry.rate(df, "s", ["ts"]).orderBy("ts").collect()] == [0, 10, 0, 10, 0]


@pytest.mark.parametrize(("compression", "tile", "dtype", "bands"), [(1, 0, "u1", 3), (8, 0, "u1", 1), (32773, 16, "u1", 4), (8, 32, "u2", 3)])
def test_geotiff(spark, tmp_path, compression, tile, dtype, bands):
    image = np.random.default_rng(0).integers(0, 255, (70, 100, bands)).astype(dtype)
    geotiff.write_geotiff(str(tmp_path / "a.tif"), image, [100.0, 0.5, 0, 20.0, 0, -0.5], 4326, tile, compression)
    (tmp_path / "b.tif").write_bytes(b"no image")
    spark.dataSource.register(geotiff.GeoTiffSource)
    meta = {r["path"][-5:]: r for r in spark.read.format("geotiff").option("mode", "meta").load(str(tmp_path)).collect()}
    assert meta["a.tif"]["width"] == 100 and meta["a.tif"]["epsg"] == 4326 and meta["a.tif"]["geo_transform"] == [100.0, 0.5, 0, 20.0, 0, -0.5]
    assert meta["b.tif"]["error"].startswith("Cannot open file")
    got = spark.read.format("geotiff").option("tile", 64).option("overlap", 16).load(str(tmp_path / "a.tif")).collect()
    assert len(got) == 6 and all(r["read_ok"] for r in got)
    for r in got:
        part = np.frombuffer(r["pixels"], "u1").reshape(r["tile_h"], r["tile_w"], bands)
        assert (part == image[r["y"] : r["y"] + r["tile_h"], r["x"] : r["x"] + r["tile_w"]]).all()


def test_crs(spark):
    df = spark.createDataFrame([(32618, 500000.0, 4500000.0), (3857, 111319.490793, 111325.142866), (4326, 10.0, 20.0), (None, 7.0, 8.0)], "epsg int, x double, y double")
    got = df.select(G.to_wgs84(F.col("epsg"), F.col("x"), F.col("y")).alias("g")).select("g.*").collect()
    assert abs(got[0]["lon"] + 75) < 1e-9 and abs(got[0]["lat"] - 40.6506) < 1e-3
    assert abs(got[1]["lon"] - 1) < 1e-6 and abs(got[1]["lat"] - 1) < 1e-4
    assert tuple(got[2])[:2] == (10.0, 20.0) and got[3]["crs_status"] == "none"


@pytest.mark.parametrize(
    ("epsg", "x", "y", "lon", "lat"),
    [
        (3035, 3962799.45, 2999718.85, 5.0, 50.0), (3032, 7255380.79, 7053389.56, 120.0, -75.0), (2154, 652469.02, 6862035.26, 2.3522, 48.8566), (2154, 700000, 6600000, 3.0, 46.5), (5070, 0, 0, -96.0, 23.0),
        (3413, 0, 0, -45.0, 90.0), (25832, 500000, 0, 9.0, 0.0), (28355, 500000, 10000000, 147.0, 0.0), (3395, 1113194.907933, 0, 10.0, 0.0), (3006, 500000, 0, 15.0, 0.0), (4258, 7, 8, 7.0, 8.0), (99, 7, 8, 7.0, 8.0),
    ],
)
def test_projections(spark, epsg, x, y, lon, lat):
    """Published points and points of origin; codes known beforehand and in a column agree where both can be."""
    at = spark.range(1).select(G.to_wgs84(epsg, F.lit(float(x)), F.lit(float(y))).alias("a"), G.to_wgs84(F.lit(epsg), F.lit(float(x)), F.lit(float(y))).alias("b")).first()
    assert at["a"]["lon"] == pytest.approx(lon, abs=2e-7) and at["a"]["lat"] == pytest.approx(lat, abs=2e-7)
    if at["b"]["crs_status"] == "projected":
        assert at["b"]["lon"] == pytest.approx(lon, abs=2e-7) and at["b"]["lat"] == pytest.approx(lat, abs=2e-7)
    assert at["a"]["crs_status"] == {4258: "geographic", 99: "passed through"}.get(epsg, "projected")


def test_outlines_against_painting(spark):
    """Random masks' outlines by class priority, painted pixel by pixel; an outline that touches itself; one without an inside."""
    rng = np.random.default_rng(5)
    rows, painted = [], {}
    for i in range(60):
        mask = rng.random((4, 4)) < 0.6
        ring = rings.largest_ring(mask)
        x, y, c = int(rng.integers(0, 60)), int(rng.integers(0, 100)), int(rng.integers(0, 5))
        points = [(x + 7 * a, y + 5 * b) for a, b in ring]
        # Even-odd by pixel: sides to the right of its middle.
        inside = np.zeros((140, 120), bool)
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
            if ax == bx:
                inside[min(ay, by) : max(ay, by), :ax] ^= True
        conf = float(rng.integers(0, 100))
        rows.append((1, c, conf, min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points), points))
        painted.setdefault(c, [0.0, np.zeros_like(inside)])
        painted[c] = [max(painted[c][0], conf), painted[c][1] | inside]
    rows.append((1, 9, 1000.0, 3, 3, 9, 3, [(3, 3), (9, 3), (9, 3), (3, 3)]))
    rows.append((1, 8, 999.0, 0, 0, 4, 4, None))
    painted[9], painted[8] = [1000.0, np.zeros((140, 120), bool)], [999.0, np.zeros((140, 120), bool)]
    painted[8][1][:4, :4] = True
    taken, want = np.zeros((140, 120), bool), {}
    for c, (_, mask) in sorted(painted.items(), key=lambda x: (-x[1][0], x[0])):
        want[c] = int((mask & ~taken).sum())
        taken |= mask
    df = spark.createDataFrame(rows, "session_id long, class_id int, conf double, x0 long, y0 long, x1 long, y1 long, outline array<struct<x:long,y:long>>")
    boxes = coverage.shape_boxes(df)
    gt = F.array(*map(F.lit, (10.0, 1e-5, 0.0, 50.0, 0.0, -1e-5)))
    got = coverage.class_areas(boxes, gt, 4326).collect()
    assert {r["class_id"]: r["area"] for r in got} == want
    assert {r["class_id"] for r in got if r["rank"] == 1} == {9}
    pixel = np.cos(np.radians(50)) * 1.1131949 * 1.1124  # about, in square metres
    for r in got:
        assert r["area_m2"] == pytest.approx(r["area"] * pixel, rel=0.01)
    assert coverage.union_area(boxes, ["session_id"]).first()["area"] == int(taken.sum())
    assert coverage.class_areas(boxes.limit(0)).count() == 0


def test_stored_detections(spark, tmp_path):
    ring = G.ring(G.corners(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)), "lon", "lat")
    df = spark.range(4).select((F.col("id") % 2).alias("session_id"), F.when(F.col("id") < 3, ring).otherwise(F.slice(ring, 1, 3)).alias("ring"))
    session.save_detections(df, str(tmp_path / "d"))
    got = session.load_detections(spark, str(tmp_path / "d"), 0).collect()
    assert len(got) == 2 and got[0]["wkt"] == "POLYGON((0.00000000 0.00000000,1.00000000 0.00000000,1.00000000 1.00000000,0.00000000 1.00000000,0.00000000 0.00000000))"
    assert session.load_detections(spark, str(tmp_path / "d"), 1).count() == 1


def test_stream_rates(spark, tmp_path):
    from tilequilt.streaming import telemetry as T

    (tmp_path / "in").mkdir()
    lines = [json.dumps({"session_id": 1, "state": "TILING", "tiles_done": d, "ts": f"2024-01-01T00:00:0{t}"}) for t, d in ((0, 0), (1, 10), (2, 10), (4, 30))]
    (tmp_path / "in/a.json").write_text("\n".join([*lines, "not json"]))
    q = T.rates(T.read_folder(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["fps"] for r in spark.sql("SELECT fps FROM rates ORDER BY ts").collect()] == [0, 10, 0, 10]


def test_image_preparation():
    from tilequilt.operators import inference as I

    image = np.arange(12, dtype=np.uint8).reshape(3, 4, 1)
    assert (I.resized(image, 4, 3) == image).all()
    wide = I.resized(image, 8, 3)[0, :, 0]
    assert wide.tolist() == [0, 0, 1, 1, 2, 2, 3, 3]  # halves truncate, the edge is repeated
    tensor, fit = I.prepared(image, 8, 114)
    assert tensor.shape == (1, 3, 8, 8) and (fit.new_w, fit.new_h, fit.pad_x, fit.pad_y) == (8, 6, 0, 1)
    assert np.allclose(tensor[0, :, 0], 114 / 255) and np.allclose(tensor[0, :, 1, 7], 3 / 255)
    assert np.allclose(I.prepared(image, 8, 0, normalise=True)[0][0, 0, 0, 0], -0.485 / 0.229)
    assert I.as_rgb(np.zeros((2, 2, 4))).shape == (2, 2, 3)


def test_tile_suppression_against_brute_force():
    from tilequilt.operators import inference as I

    rng = np.random.default_rng(1)
    boxes = np.concatenate([rng.integers(0, 40, (80, 2)), rng.integers(5, 30, (80, 2))], axis=1).astype(float)
    classes, scores = rng.integers(0, 2, 80), rng.integers(0, 20, 80) / 20
    kept = []
    for i in sorted(range(80), key=lambda i: (-scores[i], i)):
        def over(j, i=i):
            w, h = (min(boxes[i][k] + boxes[i][k + 2], boxes[j][k] + boxes[j][k + 2]) - max(boxes[i][k], boxes[j][k]) for k in (0, 1))
            inter = w * h if w > 0 and h > 0 else 0
            return classes[i] == classes[j] and inter / (boxes[i][2] * boxes[i][3] + boxes[j][2] * boxes[j][3] - inter) > 0.45
        if not any(over(j) for j in kept):
            kept.append(i)
    assert I.tile_suppressed(boxes, classes, scores).tolist() == kept


def test_decoders():
    from tilequilt.operators import inference as I

    fit = I.Fit.of(320, 160, 640)  # scale 2, 160 pixels above
    out = np.zeros((1, 84, 4), np.float32)
    out[0, :4, 0], out[0, 4 + 7, 0] = (100, 260, 40, 20), 0.9
    out[0, :4, 1], out[0, 4 + 7, 1] = (102, 260, 40, 20), 0.8  # suppressed
    out[0, :4, 2], out[0, 4 + 3, 2] = (100, 10, 40, 20), 0.8  # wholly above the tile
    boxes, classes, scores, _ = I.decode_upright(out, fit, 0.5, 640)
    assert boxes.tolist() == [[40, 45, 20, 10]] and classes.tolist() == [7] and scores.tolist() == [pytest.approx(0.9)]
    turned = np.zeros((1, 20, 1), np.float32)
    turned[0, :4, 0], turned[0, 4 + 2, 0], turned[0, 19, 0] = (100, 260, 40, 20), 0.7, np.pi / 2
    boxes, classes, _, _ = I.decode_rotated(turned, fit, 0.5, 640)
    assert np.allclose(boxes, [[45, 40, 10, 20]], atol=1e-4) and classes.tolist() == [2]
    logits = np.zeros((1, 8, 8, 8), np.float32)
    logits[0, 1] = 5
    logits[0, 4, 0:2, 0:2] = 9
    logits[0, 0, 5:7, 5:7] = 9  # an excluded class
    logits[0, 6, 0, 4] = 9  # one vote only
    boxes, classes, scores, rings = I.decode_cells(logits, I.Fit.of(64, 64, 512), 0.5, 512)
    assert boxes.tolist() == [[0, 0, 16, 16]] and classes.tolist() == [4] and len(rings[0]) == 8 and scores[0] > 0.97
    with pytest.raises(ValueError, match="shape"):
        I.decode_cells(logits[:, :7], fit, 0.5, 512)


def test_model_over_tiles(spark):
    from tilequilt.operators import inference as I

    def make():
        import numpy as np

        def model(tensor):
            out = np.zeros((1, 84, 2), np.float32)
            out[0, :4, 0], out[0, 9, 0] = (320, 320, 64, 32), tensor[0, 0, 320, 320]
            return out

        return model

    rows = [(1, 64, 64, 1, bytes([255]) * 4096), (2, 64, 64, 1, bytes(4096)), (3, 64, 64, 1, None), (4, 64, 64, 3, bytes(5))]
    tiles = spark.createDataFrame(rows, "tile_index int, width int, height int, band_count int, pixels binary")
    got = I.detections(tiles, "onnx", make, 0.3, ["tile_index"]).collect()
    assert [(r["tile_index"], r["class_id"], r["x"], r["w"], r["polygon"]) for r in got] == [(1, 5, pytest.approx(28.8), pytest.approx(6.4), [])]
    assert I.detections(tiles.limit(0), "onnx", make, 0.3, ["tile_index"]).count() == 0
    with pytest.raises(ValueError, match="not registered"):
        I.detections(tiles, "other", make, 0.3, ["tile_index"])


def test_sinks(spark, tmp_path):
    import socket

    from tilequilt.streaming import sinks
    from tilequilt.streaming import telemetry as T

    (tmp_path / "in").mkdir()
    line = {"session_id": 1, "state": "TILING", "cpu_percent": 12.25, "ram_used_mb": 1, "ram_total_mb": 2, "fps": -0.04, "tiles_done": 3, "tiles_total": 4, "queue_size": 0}
    (tmp_path / "in/a.json").write_text(json.dumps(line))
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as ear:
        ear.bind(("127.0.0.1", 0))
        ear.settimeout(20)
        q = sinks.send(T.read_folder(spark, str(tmp_path / "in")), sinks.Datagrams("127.0.0.1", ear.getsockname()[1]), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
        assert ear.recv(4096).decode() == '{"session_id":1,"state":"TILING","cpu_percent":12.3,"ram_used_mb":1,"ram_total_mb":2,"fps":0.0,"tiles_done":3,"tiles_total":4,"queue_size":0}'
    post = sinks.Posts("http://127.0.0.1:9/none", 0.2)
    post.open(0, 0)
    post.process({"document": "{}"})  # nobody listens: a warning, no error
    post.close(None)


def test_suppression_against_a_plain_loop(spark):
    """Dense boxes of very different sizes, in rounds and by one task, and a chain of 1,000."""
    rng = np.random.default_rng(11)
    n = 600
    x, y = rng.uniform(0, 300, n), rng.uniform(0, 300, n)
    w, h = rng.choice([6.0, 20.0, 90.0, 700.0], n) * rng.uniform(0.7, 1.3, n), rng.choice([6.0, 20.0, 90.0, 700.0], n) * rng.uniform(0.7, 1.3, n)
    rows = [(i, 1, int(i % 2), float(rng.integers(0, 20)), *(float(v) for v in (x[i], y[i], x[i] + w[i], y[i] + h[i]))) for i in range(n)]
    rows += [(1000 + i, 2, 0, float(2000 - i), float(i * 3), 0.0, float(i * 3 + 10), 10.0) for i in range(1000)]

    def conflict(a, b):
        iw, ih = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
        inter = max(0.0, iw) * max(0.0, ih)
        return np.float32(inter / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - inter)) > np.float32(0.5)

    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if not any(r[1:3] == k[1:3] and conflict(k, r) for k in kept):
            kept.append(r)
    want = {r[0] for r in kept}
    assert sum(i >= 1000 for i in want) == 500
    boxes = spark.createDataFrame(rows, "det_id long, session_id long, class_id int, conf double, x0 double, y0 double, x1 double, y1 double")
    assert {r["det_id"] for r in nms.suppress(boxes, ["session_id", "class_id"], 16, nms.iou_over(0.5)).collect()} == want
    few = boxes.where("session_id = 1")
    edges = nms.conflicts(few, ["session_id", "class_id"], 16, nms.iou_over(0.5))
    assert {i for i in range(n)} - {r["det_id"] for r in nms.suppressed(edges, 5).collect()} == {i for i in want if i < n}
    assert nms.suppress(boxes.limit(0), ["session_id", "class_id"]).count() == 0


def test_half_pairs_against_sql(spark, tmp_path, monkeypatch):
    """Repeated ids, sizes of several levels, flat and inverted boxes, nulls, cells cut into parts, in every kind of integer."""
    rng = np.random.default_rng(4)
    made = []
    for i in range(700):
        w, h = (int(v) for v in rng.choice([-40, 0, 9, 30, 250, 900], 2, p=[0.02, 0.02, 0.2, 0.4, 0.3, 0.06]) * rng.uniform(0.6, 1.4, 2))
        x, y = (int(v) for v in rng.integers(-60, 60, 2))
        made.append((i if i % 9 else i // 2, i % 2, int(rng.integers(0, 20)), x, y, x + w, y + h))
    made += [(5, None, 1, 0, 0, 9, 9), (6, 1, 1, 0, 0, None, 9), *made[:40]]
    sql = queries.ORACLES["iou_pairs"]
    sql = "WITH det AS (SELECT *, 0 AS class_id FROM boxes) " + sql[sql.index("SELECT a.det_id") :]
    for by in (1, 1 << 20):
        boxes = spark.createDataFrame([(*r[:3], *(v if v is None else v * by for v in r[3:])) for r in made], "det_id long, session_id int, conf int, x0 long, y0 long, x1 long, y1 long")
        boxes.write.parquet(str(tmp_path / f"{by}"))
        want = rows(duckdb.sql(sql.replace("FROM boxes", f"FROM '{tmp_path}/{by}/*.parquet'")).to_arrow_table())
        assert len(want) > 500
        for block in (1 << 16, 50):
            assert rows(nms.over_half_pairs(boxes, ["session_id"], 16 * by, block).toArrow()) == want
        monkeypatch.setattr(nms, "TILE_PAIRS", 100)
        monkeypatch.setattr(nms, "PAIR_ROWS", 100)


def test_pairs_are_not_dealt_out(spark):
    """Nothing is shuffled or joined after the pairs are found: they grow with the square of the boxes."""
    plan = queries.QUERIES["iou_pairs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("FlatMapGroupsInArrow")[0]


def test_engine_on_a_raster(spark, tmp_path):
    """Registered, run by a model over windows, mapped, stored and read back as documents; the log has each step."""
    from tilequilt.operators import inference as I

    image = np.zeros((100, 150, 3), "u1")
    geotiff.write_geotiff(str(tmp_path / "a.tif"), image, [1e6, 2.0, 0, 5e6, 0, -2.0], 3857)
    (tmp_path / "b.tif").write_bytes(b"no image")

    def make():
        """One box of class 5 a tile, in the middle of it."""
        def model(tensor):
            out = np.zeros((1, 84, 3), np.float32)
            out[0, :4, 1] = 320, 320, 64, 64
            out[0, 4 + 5, 1] = 0.9
            return out

        return model

    e, seen = session.Engine(spark, str(tmp_path / "store"), {"onnx": make}), []
    e.on_progress.append(lambda *x: seen.append(x))
    with pytest.raises(ValueError, match="Cannot open file"):
        e.register(str(tmp_path / "b.tif"))
    sid = e.register(str(tmp_path / "a.tif"))
    assert e.results(sid)["features"] == []
    e.configure(sid, model="onnx", tile_size=64, overlap=0, conf_thresh=0.3)
    kept = e.start(sid).collect()
    assert 1 <= len(kept) <= 6 and len({r["det_id"] for r in kept}) == len(kept)
    assert seen == [(sid, 0, 6), (sid, 6, 6)]
    lon, lat = (1e6 + 2 * kept[0]["x0"]) / 6378137 * 180 / np.pi, (2 * np.arctan(np.exp((5e6 - 2 * kept[0]["y0"]) / 6378137)) - np.pi / 2) * 180 / np.pi
    assert kept[0]["ring"][0]["lon"] == pytest.approx(lon) and kept[0]["ring"][0]["lat"] == pytest.approx(lat)
    out = e.results(sid)
    assert out["type"] == "FeatureCollection" and {f["properties"]["id"] for f in out["features"]} == {r["det_id"] for r in kept}
    assert out["features"][0]["properties"]["class_id"] == 5 and out["coverage"]["classes"][0]["class_id"] == 5
    area = sum((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) for r in kept)
    assert out["coverage"]["classes"][0]["area"] <= area
    assert 0 < out["coverage"]["classes"][0]["area_m2"] < out["coverage"]["classes"][0]["area"] * 4
    log = e.log().collect()
    assert [(r["session_id"], r["status"], r["tile_done"]) for r in log] == [(sid, "DONE", 6)]
    e.configure(sid, conf_thresh=0.95)
    assert e.start(sid).count() == 0 and e.results(sid) == {"type": "FeatureCollection", "features": [], "coverage": None}
    assert e.status(sid)["progress"] == 100
    assert e.wait(sid, 0.1)["status"] == "DONE" and e.health() == {"status": "ok"}
    assert e.telemetry() == {"session_id": 0, "state": "IDLE", "tiles_done": 0, "tiles_total": 0, "queue_size": 0}
    with (tmp_path / "a.tif").open("rb") as body:
        sent = e.upload(body, "../my scan.tif")
    assert e.status(sent)["filename"] == "../my scan.tif" and e.sessions[sent]["meta"]["width"] == 150
    other = e.register("none", 100, 100)
    e.configure(other, model="onnx")
    with pytest.raises(ValueError, match="needs a raster"):
        e.start(other)
    assert e.status(other)["status"] == "ERROR" and "raster" in e.status(other)["error_message"]


def test_engine_keeps_outlines(spark, tmp_path):
    """Outlines of a model of cells reach the stored rings and the coverage."""
    geotiff.write_geotiff(str(tmp_path / "a.tif"), np.zeros((64, 64, 3), "u1"), [1e6, 2.0, 0, 5e6, 0, -2.0], 3857)

    def make():
        def model(tensor):
            out = np.zeros((1, 8, 8, 8), np.float32)
            out[0, 0] = 5
            out[0, 4, 0, 0:2] = out[0, 4, 1, 0] = 9  # an L of three cells
            return out

        return model

    e = session.Engine(spark, str(tmp_path / "store"), {"segformer_loveda": make})
    sid = e.register(str(tmp_path / "a.tif"))
    e.configure(sid, model="segformer_loveda", tile_size=64, overlap=0, conf_thresh=0.3)
    kept = e.start(sid).collect()
    assert len(kept) == 1 and len(kept[0]["outline"]) == len(kept[0]["ring"]) == 8
    out = e.results(sid)
    assert out["coverage"]["classes"][0]["area"] == 3 * 64 and len(out["features"][0]["geometry"]["coordinates"][0]) == 9


def test_geotiff_faults_and_samples(spark, tmp_path):
    image = np.array([[[0.4], [0.5], [254.6], [300.0]], [[-3.0], [np.nan], [7.49], [1.5]]], "<f4")
    geotiff.write_geotiff(str(tmp_path / "a.tif"), image, [10.0, 1.0, 0, 20.0, 0, -1.0], 4326)
    (tmp_path / "b.tif").write_bytes(b"no image")
    spark.dataSource.register(geotiff.GeoTiffSource)
    got = {r["path"][-5:]: r for r in spark.read.format("geotiff").load(str(tmp_path)).collect()}
    assert list(got["a.tif"]["pixels"]) == [0, 1, 255, 255, 0, 0, 7, 2] and got["a.tif"]["read_ok"]
    assert not got["b.tif"]["read_ok"] and got["b.tif"]["pixels"] is None
    # A tie point at a pixel's centre lies half a pixel from the corner.
    t = geotiff.Tiff(str(tmp_path / "a.tif"))
    t.tags[34735] = (*t.tags[34735], 1025, 0, 1, 2)
    assert t.meta()["geo_transform"] == [9.5, 1.0, 0.0, 20.5, 0.0, -1.0]
    # Byte planes with differences, highest bytes first.
    planes = image.astype(">f4").reshape(2, 4).view("u1").reshape(2, 4, 4).transpose(0, 2, 1).reshape(2, 16)
    raw = np.diff(planes.astype(int), axis=1, prepend=0).astype("u1").tobytes()
    t.predictor, t.decoded, t._at = 3, {}, lambda at, n: raw
    assert np.array_equal(t.cell(0), image, equal_nan=True)


def test_stream_of_own_documents(spark, tmp_path):
    """Documents of the metrics operator come back as records: arrival times, malformed ones dropped, 60 rows kept."""
    from tilequilt.streaming import sinks
    from tilequilt.streaming import telemetry as T

    schema = "session_id long, state string, cpu_percent double, ram_used_mb int, ram_total_mb int, fps double, tiles_done int, tiles_total int, queue_size int"
    made = spark.createDataFrame([(1, "TILING", 1.0, 1, 2, 0.0, i, 99, 0) for i in range(5)], schema)
    lines = [r["document"] for r in sinks.documents(made).collect()]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join([*lines, '{"session_id":1,"state":"TILING"}', "{", '{"session_id":null}']))
    later = [json.dumps({"session_id": 1, "state": "TILING", "tiles_done": 10 + i, "ts": f"2090-01-01T00:{i // 60:02}:{i % 60:02}"}) for i in range(70)]
    rows = T.read_folder(spark, str(tmp_path / "in"))
    rates = T.rates(rows).writeStream.format("memory").queryName("own_rates").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    kept = T.history(rows).writeStream.format("memory").queryName("own_history").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).start()
    for q in (rates, kept):
        q.processAllAvailable()
    assert spark.table("own_rates").count() == 5 and spark.table("own_rates").where("ts IS NULL").count() == 0
    (tmp_path / "in/b.json").write_text("\n".join(later))
    for q in (rates, kept):
        q.processAllAvailable()
        q.stop()
    newest = [r["tiles_done"] for r in spark.table("own_history").collect()][5:]
    assert newest == list(range(20, 80)) and T.HISTORY == 60
    got = sorted(spark.table("own_rates").where("tiles_done > 10").collect(), key=lambda r: r["tiles_done"])
    assert len(got) == 69 and all(r["fps"] == 1 for r in got)
    taken = []

    class Broken:
        def open(self, *x):
            raise OSError("down")

        process = close = open

    class Good:
        def open(self, *x):
            return True

        def process(self, row):
            taken.append(row)

        def close(self, error):
            pass

    both = sinks.FanOut(Broken(), Good())
    assert both.open(0, 0)
    both.process("row")
    both.close(None)
    assert taken == ["row"]


def test_reports(spark):
    """Runs that agree, a run without a status, and no runs at all."""
    fields = [("Run", "run", 6), ("Detections", "n", 12), ("State", "status", 0)]

    def lines(*rows):
        df = spark.createDataFrame(list(rows), "run long, n long, status string")
        return [r.line for r in telemetry.report(df, "run", fields).orderBy("part", "run").collect()]

    head = ["Run    Detections   State", "-" * 60]
    assert lines((1, 7, "DONE"), (1234567, 7, "DONE")) == [*head, "1      7            DONE", "1234567 7            DONE", "PASS: All 2 runs produced 7 detections (consistent)", "PASS: All sessions reached DONE state"]
    assert lines((1, 7, None), (2, 9, "DONE"))[-2:] == ["WARN: Inconsistent detection counts: 7 to 9", "FAIL: All sessions reached DONE state"]
    assert lines() == head


def test_documents_and_formulas(spark):
    row = spark.createDataFrame([("x/a.TIFF", True, True, 100, 200, 10, 60, 4096, 1024)], "path string, found boolean, opens boolean, t0 long, t1 long, b0 long, b1 long, total long, free long")
    c = F.col
    got = row.select(
        config.raster_fault(c("path"), c("found"), c("opens")).alias("ok"), config.raster_fault(F.lit("a.png"), c("found"), c("opens")).alias("kind"), config.raster_fault(c("path"), ~c("found"), c("opens")).alias("none"), config.raster_fault(c("path"), c("found"), ~c("opens")).alias("shut"),
        telemetry.cpu_percent(c("b0"), c("t0"), c("b1"), c("t1")).alias("cpu"), telemetry.cpu_percent(c("b0"), c("t0"), c("b1"), c("t0")).alias("still"), telemetry.ram_used_mb(c("total"), c("free")).alias("ram"),
    ).first()
    assert tuple(got) == (None, "Unsupported format: .png (expected .tif/.tiff)", "File not found: x/a.TIFF", "Cannot open file: x/a.TIFF", 50.0, 0.0, 3)


def test_live_sources(spark):
    """Datagrams and posts become rows; a post that is too large, elsewhere or no JSON is refused."""
    import socket
    import time
    import urllib.error
    import urllib.request

    from tilequilt.sources import live
    from tilequilt.streaming import telemetry as T

    line = json.dumps({"session_id": 1, "state": "TILING", "tiles_done": 3})
    for kind in (live.DatagramSource, live.HttpSource):
        spark.dataSource.register(kind)
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM if kind is live.DatagramSource else socket.SOCK_STREAM) as free:
            free.bind(("127.0.0.1", 0))
            port = free.getsockname()[1]
        rows = T.parsed(spark.readStream.format(kind.name()).option("host", "127.0.0.1").option("port", port).load())
        q = rows.writeStream.format("memory").queryName(f"live_{kind.name()}").start()

        def post(path, body, port=port):
            try:
                return urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", body)).status
            except urllib.error.HTTPError as e:
                return e.code
            except OSError:
                return 0

        try:
            until = time.time() + 60
            while spark.table(f"live_{kind.name()}").count() < 2 and time.time() < until:
                if kind is live.DatagramSource:
                    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
                        out.sendto(line.encode(), ("127.0.0.1", port))
                        out.sendto(b"no record", ("127.0.0.1", port))
                elif post("/telemetry", line.encode()) == 204:
                    assert (post("/telemetry", b"{"), post("/other", b"{}"), post("/telemetry", b"1" * 70000)) == (400, 404, 413)
                time.sleep(0.5)
            got = spark.table(f"live_{kind.name()}").collect()
            assert len(got) >= 2 and {r["tiles_done"] for r in got} == {3} and all(r["ts"] for r in got)
        finally:
            q.stop()
    b = live.Buffer()
    assert all(b.put(str(i)) for i in range(5)) and b.since(2) == (["2", "3", "4"], 5) and b.between(1, 3) == ["1", "2"]
    b.drop(4)
    assert b.since(4) == (["4"], 5) and b.since(9)[1] == 9
