"""Run configuration from JSON, its checks, and status documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.fixed import CONFIG

_SCHEMA = "tile_size int, overlap int, model string, model_path string, max_workers int, conf_thresh double"


def parse_config(text: Column) -> Column:
    """struct of the configuration; a key that is missing or of a wrong type takes its default, as does malformed JSON."""
    parsed = F.from_json(text, _SCHEMA, {"mode": "PERMISSIVE"})
    return F.struct(*(F.coalesce(parsed[k], F.lit(v)).alias(k) for k, v in CONFIG.items()))


def config_error(c: Column) -> Column:
    """The first fault of a configuration, or null."""
    return (
        F.when((c["tile_size"] <= 0) | (c["tile_size"] > 4096), "tile_size must be in range 1..4096")
        .when((c["overlap"] < 0) | (c["overlap"] >= c["tile_size"]), "overlap must be >= 0 and smaller than tile_size")
        .when((c["max_workers"] < 0) | (c["max_workers"] > 64), "max_workers must be in range 0..64")
        .when((c["conf_thresh"] < 0) | (c["conf_thresh"] > 1), "conf_thresh must be in range 0..1")
    )


def progress(done: Column, total: Column) -> Column:
    """Whole percent, rounded down; 0 without tiles."""
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(F.lit(0)).cast("int")


def shown_progress(done: Column, total: Column) -> Column:
    """Percent as shown: rounded."""
    return F.when(total > 0, F.round(done * 100 / total)).otherwise(F.lit(0)).cast("int")


def progress_bar(percent: Column) -> Column:
    """Twenty cells and the percent."""
    full = F.floor(percent / 5).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(20) - full), F.lit("] "), percent.cast("string"), F.lit("%"))


def status_document(session_id: Column, filename: Column, status: Column, done: Column, total: Column, error: Column, footprint: Column) -> Column:
    """Status JSON; error_message only if not empty, the footprint feature only with four points or more."""
    ring = F.transform(G.closed(footprint), lambda p: F.array(p["lon"], p["lat"]))
    kind = F.struct(F.lit("image_footprint").alias("kind"))
    feature = F.struct(F.lit("Feature").alias("type"), kind.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    return F.to_json(
        F.struct(
            session_id.alias("session_id"), filename.alias("filename"), status.alias("status"), total.alias("tile_total"), done.alias("tile_done"), progress(done, total).alias("progress"),
            F.when(error != "", error).alias("error_message"), F.when(F.size(footprint) >= 4, feature).alias("footprint"),
        )
    )


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot."""
    return F.lower(F.substring_index(path, ".", -1))


def raster_fault(path: Column, found: Column, opens: Column) -> Column:
    """Why a raster can't be read, or null."""
    ext = extension(path)
    return F.when(~found, F.concat(F.lit("File not found: "), path)).when(~ext.isin("tif", "tiff"), F.concat(F.lit("Unsupported format: ."), ext, F.lit(" (expected .tif/.tiff)"))).when(~opens, F.concat(F.lit("Cannot open file: "), path))
