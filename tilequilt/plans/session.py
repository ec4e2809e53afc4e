"""Sessions: the state machine, stored detections, and the run from raster to results."""

from __future__ import annotations

import json
import shutil
import threading
import time
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, mock
from ..functions import geometry as G
from ..operators import config, coverage, grid, inference, nms
from ..sources.geotiff import GeoTiffSource
from ..staging import staged

#: Bits of a detection's id for its place in its tile, and for that and its tile: the session is above.
PLACE_BITS, TILE_BITS = 20, 46


class StateMachine:
    """The session's state; only legal steps are taken, observers are told of each."""

    def __init__(self) -> None:
        self.state, self.observers, self._lock = fixed.STATES[0], [], threading.Lock()

    def on_change(self, observer: Callable[[str, str], None]) -> None:
        self.observers.append(observer)

    def transition(self, to: str) -> bool:
        return (self.state, to) in fixed.TRANSITIONS and self._go(to, check=True)

    def force(self, to: str) -> None:
        self._go(to, check=False)

    def _go(self, to: str, check: bool) -> bool:
        with self._lock:
            before = self.state
            if check and (before, to) not in fixed.TRANSITIONS:
                return False
            self.state = to
            for f in self.observers:
                f(before, to)
        return True

    @property
    def terminal(self) -> bool:
        return self.state in fixed.TERMINAL

    @property
    def can_process(self) -> bool:
        return self.state in fixed.WORKING


def mock_run(images: DataFrame, tile: int = 512, overlap: int = 64, conf: float = 0.0, model: Callable[[DataFrame], DataFrame] = mock.detections) -> DataFrame:
    """Detections that survive suppression, of images (session_id, width, height): det_id, session_id, class_id, conf,
    tile_index and the pixel box. Boxes without an area stay, as they conflict with none.

    model is the tile function: tiles in, one row a detection out. The whole run is one plan up to suppression.
    """
    tiles = grid.tile_grid(images, tile, overlap).select("session_id", "tile_index", "x", "y", F.col("tile_w").alias("width"), F.col("tile_h").alias("height"))
    found = model(tiles.withColumnsRenamed({"x": "tx", "y": "ty"})).where(F.col("confidence") >= F.lit(conf).cast("float"))
    return survivors(found, tile)


def survivors(found: DataFrame, tile: int) -> DataFrame:
    """What suppression keeps of tile detections (session_id, tile_index, tx, ty, ordinal, class_id, confidence, x, y, w, h).

    With a column polygon, those of four points or more are outlines: they come back as outline, in image pixels (null
    for a box), and suppression takes their bounds.
    """
    at = [F.col(c) for c in ("tx", "ty", "x", "y", "w", "h")]
    outlined = "polygon" in found.columns
    ring = G.detection_ring(*at[:2], F.col("polygon"), *at[2:]) if outlined else G.box_ring(*at)
    boxes = found.withColumn("b", G.bounds(ring)).select(
        det_id(F.col("session_id"), F.col("tile_index"), F.col("ordinal")).alias("det_id"), "session_id", "class_id", F.col("confidence").alias("conf"), "tile_index", "b.*",
        *([F.when(F.size("polygon") >= 4, ring).alias("outline")] if outlined else []),
    )
    return nms.suppress(boxes, ["session_id", "class_id"], tile / 2)


def det_id(session_id, tile_index, ordinal):
    """One number for a detection: 2**20 a tile, 2**26 tiles a session."""
    return session_id.cast("long") * (1 << TILE_BITS) + tile_index.cast("long") * (1 << PLACE_BITS) + ordinal


def mapped(boxes: DataFrame, gt, epsg) -> DataFrame:
    """boxes with ring: their outlines, or corners, in longitude and latitude, under a transform and a CRS (epsg is a
    column, a number or None; without a transform, None, pixels stay)."""

    def point(x, y):
        at = G.to_wgs84(epsg, *G.affine(gt, x, y)) if gt is not None else {"lon": x.cast("double"), "lat": y.cast("double")}
        return F.struct(at["lon"].alias("lon"), at["lat"].alias("lat"))

    ring = F.array(*(point(x, y) for x, y in G.corners(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))))
    if "outline" in boxes.columns:
        ring = F.when(F.size("outline") >= 4, F.transform("outline", lambda p: point(p["x"], p["y"]))).otherwise(ring)
    return boxes.withColumn("ring", ring)


def feature():
    """A detection's GeoJSON feature, of columns det_id, class_id, conf, session_id, tile_index and ring."""
    coords = F.transform(G.closed(F.col("ring")), lambda p: F.array(p["lon"].cast("double"), p["lat"].cast("double")))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(coords).alias("coordinates"))
    properties = F.struct(F.col("det_id").alias("id"), "class_id", F.col("conf").alias("confidence"), "session_id", "tile_index")
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def coverage_document(areas: DataFrame, footprint) -> DataFrame:
    """(session_id, document): classes by area, largest first, with percent to two decimals (cut), and what none covers;
    with area_m2 to two decimals if areas has it."""
    some = coverage.coverage(areas, footprint)
    metres = "area_m2" in areas.columns

    def cut(x):
        return F.floor(x * 100 + F.lit(1e-6)) / 100

    part = F.struct(F.col("area"), (-F.col("class_id")).alias("order"), cut(F.col("percent")).alias("percent"), F.col("class_id"), *([F.round("area_m2", 2).alias("area_m2")] if metres else []))
    by = some.groupBy("session_id").agg(F.sort_array(F.collect_list(part), asc=False).alias("parts"), F.max(cut(F.col("unclassified_percent"))).alias("rest"))
    classes = F.transform("parts", lambda p: F.struct(p["class_id"].alias("class_id"), p["area"].alias("area"), *([p["area_m2"].alias("area_m2")] if metres else []), p["percent"].alias("percent")))
    return by.select("session_id", F.to_json(F.struct(classes.alias("classes"), F.col("rest").alias("unclassified_percent"))).alias("document"))


def save_detections(rows: DataFrame, path: str) -> None:
    """Append detections with rings of four points or more, a folder a session; a failed job leaves nothing."""
    rows.where(F.size("ring") >= 4).withColumns({"wkt": G.wkt(F.col("ring")), "created_at": F.current_timestamp()}).write.mode("append").partitionBy("session_id").parquet(path)


def load_detections(spark: SparkSession, path: str, session_id: int) -> DataFrame:
    """One session's detections; only its folder is read."""
    return spark.read.parquet(path).where(F.col("session_id") == session_id)


def feature_collection(features: DataFrame) -> DataFrame:
    """One GeoJSON FeatureCollection a session, of (session_id, feature text); a session's features meet in one row."""
    return features.groupBy("session_id").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array(F.collect_list("feature")), ","), F.lit("]}")).alias("document"))


def current_sessions(log: DataFrame) -> DataFrame:
    """The newest status and progress of each session of an append-only log (session_id, ts, status, tile_done)."""
    return log.groupBy("session_id").agg(F.max_by("status", "ts").alias("status"), F.max_by("tile_done", F.when(F.col("tile_done").isNotNull(), F.col("ts"))).alias("tile_done"), F.max("ts").alias("updated_at"))


class Engine:
    """Register, configure, start, cancel and look at sessions.

    store: a folder that detections and the status log are appended to; without it results live in the session only.
    models: name of a model -> a function that makes it on an executor (see inference.detections); names without one
    are taken from the configuration's model_path, an ONNX file. Observers of on_progress get (session, done, total).
    """

    def __init__(self, spark: SparkSession, store: str | None = None, models: dict[str, Callable] | None = None) -> None:
        self.spark, self.sessions, self._next, self.store, self.models = spark, {}, 1, store, models or {}
        self.on_progress: list[Callable[[int, int, int], None]] = []

    def upload(self, body: BinaryIO, filename: str = "input.tif") -> int:
        """A session of a raster read from body, piece by piece, into a folder of its own in the store; filename only names it."""
        path = Path(self.store, "uploads", uuid.uuid4().hex, "input.tif")
        path.parent.mkdir(parents=True)
        with path.open("wb") as out:
            shutil.copyfileobj(body, out, 1 << 20)
        return self.register(filename, path=str(path))

    def register(self, filename: str, width: int | None = None, height: int | None = None, path: str | None = None) -> int:
        """A session of an image of that size or, without a size, of the raster at path (or filename)."""
        path = path or filename
        meta = {"width": width, "height": height, "geo_transform": None, "epsg": None}
        if width is None:
            self.spark.dataSource.register(GeoTiffSource)
            row = self.spark.read.format("geotiff").option("mode", "meta").load(path).select("*", config.raster_fault(F.lit(path), F.lit(True), F.col("error").isNull()).alias("fault")).first()
            if row["fault"]:
                raise ValueError(row["fault"])
            meta = row.asDict()
        sid, self._next = self._next, self._next + 1
        self.sessions[sid] = {"filename": filename, "path": path, "meta": meta, "raster": width is None, "machine": StateMachine(), "config": dict(fixed.CONFIG), "error": "", "result": None, "done": 0, "total": 0}
        self._log(sid)
        return sid

    def _log(self, sid: int) -> None:
        """Append the session's status to the log."""
        if self.store:
            s = self.sessions[sid]
            row = self.spark.createDataFrame([(sid, s["filename"], s["machine"].state, s["done"], s["total"], s["error"])], "session_id long, filename string, status string, tile_done int, tile_total int, error_message string")
            row.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(f"{self.store}/sessions")

    def log(self) -> DataFrame:
        """Newest status and progress of every session in the store."""
        return current_sessions(self.spark.read.parquet(f"{self.store}/sessions"))

    def configure(self, sid: int, **changes) -> None:
        c = self.sessions[sid]["config"] | changes
        faults = ((0 < c["tile_size"] <= 4096, "tile_size must be in range 1..4096"), (0 <= c["overlap"] < c["tile_size"], "overlap must be >= 0 and smaller than tile_size"), (0 <= c["max_workers"] <= 64, "max_workers must be in range 0..64"), (0 <= c["conf_thresh"] <= 1, "conf_thresh must be in range 0..1"))
        for ok, text in faults:
            if not ok:
                raise ValueError(text)
        self.sessions[sid]["config"] = c

    def _found(self, sid: int) -> DataFrame:
        """Tile detections of a session by its model."""
        s = self.sessions[sid]
        c, m = s["config"], s["meta"]
        if c["model"] == "mock":
            images = self.spark.createDataFrame([(sid, m["width"], m["height"])], "session_id long, width int, height int")
            tiles = grid.tile_grid(images, c["tile_size"], c["overlap"]).select("session_id", "tile_index", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("tile_w").alias("width"), F.col("tile_h").alias("height"))
            return mock.detections(tiles)
        if not s["raster"]:
            raise ValueError(f"model {c['model']} needs a raster")
        tiles = self.spark.read.format("geotiff").option("tile", c["tile_size"]).option("overlap", c["overlap"]).load(s["path"]).where("read_ok")
        tiles = tiles.select(F.lit(sid).cast("long").alias("session_id"), "tile_index", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("tile_w").alias("width"), F.col("tile_h").alias("height"), "band_count", "pixels")
        keys = ["session_id", "tile_index", "tx", "ty"]
        if c["model"] in self.models:
            return inference.detections(tiles, c["model"], self.models[c["model"]], c["conf_thresh"], keys)
        return inference.onnx_detections(tiles, c["model"], c["model_path"], c["conf_thresh"], keys)

    def _transform(self, sid: int):
        numbers = self.sessions[sid]["meta"]["geo_transform"]
        return F.array(*map(F.lit, numbers)) if numbers else None

    def _progress(self, sid: int, done: int) -> None:
        self.sessions[sid]["done"] = done
        for f in self.on_progress:
            f(sid, done, self.sessions[sid]["total"])

    def _go(self, sid: int, *steps: str) -> bool:
        """Take steps; False once the session has been cancelled meanwhile."""
        ok = all(self.sessions[sid]["machine"].transition(step) for step in steps)
        self._log(sid)
        return ok

    def start(self, sid: int) -> DataFrame:
        """Run the configured model over a session's tiles: detections that survive, with their rings in longitude and
        latitude if the image has a transform; they are stored if there is a store. A finished session goes back to
        IDLE first. Tiles count as done once their detections are written to the shared folder."""
        s = self.sessions[sid]
        m, c = s["machine"], s["config"]
        if m.state == "DONE":
            m.transition("IDLE")
        if m.state != "IDLE":
            raise RuntimeError("Cannot start. Check session state.")
        if c["model"] != "mock" and c["model"] not in inference.BACKENDS:
            raise ValueError(f"model {c['model']} is not registered")
        stride = c["tile_size"] - c["overlap"]
        s["total"], s["error"] = -(-s["meta"]["width"] // stride) * -(-s["meta"]["height"] // stride), ""
        try:
            self.spark.addTag(f"session-{sid}")
            self._go(sid, "LOADING", "TILING")
            self._progress(sid, 0)
            self._go(sid, "PROCESSING")
            found = staged(self._found(sid).where(F.col("confidence") >= F.lit(c["conf_thresh"]).cast("float")))
            self._progress(sid, s["total"])
            self._go(sid, "STITCHING")
            kept = survivors(found, c["tile_size"])
            s["result"] = staged(mapped(kept, self._transform(sid), s["meta"]["epsg"]))
            if self._go(sid, "SAVING"):
                if self.store:
                    save_detections(s["result"], f"{self.store}/detections")
                self._go(sid, "DONE")
        except Exception as e:
            s["error"] = s["error"] or str(e)
            m.transition("ERROR")
            self._log(sid)
            raise
        finally:
            self.spark.removeTag(f"session-{sid}")
        return s["result"]

    def results(self, sid: int) -> dict:
        """The session's FeatureCollection (features [] if there are none) and its coverage, parsed from their documents;
        coverage counts pixels and, for an image with a transform, square metres."""
        s = self.sessions[sid]
        out = {"type": "FeatureCollection", "features": [], "coverage": None}
        if s["result"] is None:
            return out
        rows = load_detections(self.spark, f"{self.store}/detections", sid).join(s["result"].select("det_id"), "det_id", "left_semi") if self.store else s["result"]
        found = feature_collection(rows.select("session_id", feature().alias("feature"))).first()
        if found:
            out |= json.loads(found["document"])
        size = s["meta"]["width"], s["meta"]["height"]
        wanted = ["session_id", "class_id", "conf", "x0", "y0", "x1", "y1", "outline"]
        shapes = s["result"].select(*(c for c in wanted if c in s["result"].columns))
        boxes = coverage.shape_boxes(shapes) if "outline" in shapes.columns else shapes
        areas = coverage.class_areas(coverage.clip(boxes, *size), self._transform(sid), s["meta"]["epsg"])
        cover = coverage_document(areas, size[0] * size[1]).first()
        return out | {"coverage": json.loads(cover["document"]) if cover else None}

    def cancel(self, sid: int) -> None:
        s = self.sessions[sid]
        self.spark.interruptTag(f"session-{sid}")
        s["error"] = "Cancelled by user."
        s["machine"].force("ERROR")
        self._log(sid)

    def status(self, sid: int) -> dict:
        """An unknown session raises KeyError."""
        s = self.sessions[sid]
        return {"session_id": sid, "filename": s["filename"], "status": s["machine"].state, "tile_total": s["total"], "tile_done": s["done"], "progress": s["done"] * 100 // s["total"] if s["total"] else 0, "error_message": s["error"]}

    def wait(self, sid: int, every: float = 1.0) -> dict:
        """Look every so many seconds until the session has ended; its status then."""
        while not self.sessions[sid]["machine"].terminal:
            time.sleep(every)
        return self.status(sid)

    def health(self) -> dict:
        return {"status": "ok"}

    def telemetry(self) -> dict:
        """The session at work, or an idle record."""
        sid = next((i for i, s in self.sessions.items() if s["machine"].can_process), 0)
        s = self.sessions.get(sid, {"done": 0, "total": 0})
        return {"session_id": sid, "state": s["machine"].state if sid else fixed.STATES[0], "tiles_done": s["done"], "tiles_total": s["total"], "queue_size": s["total"] - s["done"]}


def newest_first(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of all by ts: a limit that Spark takes from each partition's newest."""
    return rows.orderBy(F.desc("ts")).limit(n)


__all__ = ["Engine", "StateMachine", "current_sessions", "feature_collection", "load_detections", "mock_run", "newest_first", "save_detections"]
