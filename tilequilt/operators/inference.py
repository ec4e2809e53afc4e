"""Tiles to detections by a model: image preparation, the model call, decoding and suppression, in Arrow batches.

A model is any function from a float32 array [1, 3, side, side] to one output array, made once a worker. onnx_model
makes one of an ONNX file; others can be passed as they are. Tiles are rows (keys, width, height, band_count, pixels),
pixels being interleaved bytes; every step works on one tile at a time, so memory is bounded by a tile and its tensors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import fixed
from .rings import largest_ring

Model = Callable[[np.ndarray], np.ndarray]
#: (box [n, 4] as x, y, w, h in tile pixels, class_id [n], confidence [n], polygons or None)
Found = tuple[np.ndarray, np.ndarray, np.ndarray, list | None]
DETECTION = "ordinal int, class_id int, confidence float, x float, y float, w float, h float, polygon array<struct<x:float,y:float>>"


@dataclass(frozen=True)
class Fit:
    """How a tile lies in the model's canvas."""

    scale: float
    new_w: int
    new_h: int
    pad_x: int
    pad_y: int
    tile_w: int
    tile_h: int

    @classmethod
    def of(cls, w: int, h: int, side: int) -> Fit:
        scale = min(side / w, side / h)
        new_w, new_h = int(w * scale + 0.5), int(h * scale + 0.5)
        return cls(scale, new_w, new_h, (side - new_w) // 2, (side - new_h) // 2, w, h)

    def back(self, xy: np.ndarray) -> np.ndarray:
        """Canvas coordinates [..., 2] in the tile, clamped to it."""
        return np.clip((xy - (self.pad_x, self.pad_y)) / self.scale, 0, (self.tile_w, self.tile_h))


def as_rgb(image: np.ndarray) -> np.ndarray:
    """The first three bands of [h, w, bands], or the first one three times."""
    return image[:, :, :3] if image.shape[2] >= 3 else np.repeat(image[:, :, :1], 3, axis=2)


def _axis(size: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(new, dtype=np.float32) * np.float32(size / new)
    low = np.minimum(at.astype(np.int64), size - 1)
    return low, np.minimum(low + 1, size - 1), at - low.astype(np.float32)


def resized(image: np.ndarray, new_w: int, new_h: int) -> np.ndarray:
    """Bilinear resize of [h, w, bands] bytes: a pixel's place is scaled without a half-pixel shift, values truncate."""
    (x0, x1, dx), (y0, y1, dy) = _axis(image.shape[1], new_w), _axis(image.shape[0], new_h)
    pixels = image.astype(np.float32)
    dx, dy = dx[None, :, None], dy[:, None, None]
    top = pixels[y0][:, x0] * (1 - dx) + pixels[y0][:, x1] * dx
    low = pixels[y1][:, x0] * (1 - dx) + pixels[y1][:, x1] * dx
    return np.clip(top * (1 - dy) + low * dy, 0, 255).astype(np.uint8)


def prepared(image: np.ndarray, side: int, fill: int, normalise: bool = False) -> tuple[np.ndarray, Fit]:
    """The tensor [1, 3, side, side] of an image: resized into a canvas of fill, channels first, from 0 to 1.

    normalise also subtracts the means and divides by the deviations of the fixed values.
    """
    fit = Fit.of(image.shape[1], image.shape[0], side)
    canvas = np.full((side, side, 3), fill, np.uint8)
    canvas[fit.pad_y : fit.pad_y + fit.new_h, fit.pad_x : fit.pad_x + fit.new_w] = resized(as_rgb(image), fit.new_w, fit.new_h)
    tensor = canvas.astype(np.float32) / np.float32(255)
    if normalise:
        tensor = (tensor - np.array(fixed.IMAGENET_MEAN, np.float32)) / np.array(fixed.IMAGENET_STD, np.float32)
    return np.ascontiguousarray(tensor.transpose(2, 0, 1))[None], fit


def _ious(boxes: np.ndarray, one: np.ndarray) -> np.ndarray:
    """IoU of boxes [n, 4] (x, y, w, h) with one."""
    shared = np.minimum(boxes[:, :2] + boxes[:, 2:], one[:2] + one[2:]) - np.maximum(boxes[:, :2], one[:2])
    inter = np.where((shared > 0).all(axis=1), shared.prod(axis=1), 0)
    union = boxes[:, 2:].prod(axis=1) + one[2:].prod() - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def tile_suppressed(boxes: np.ndarray, classes: np.ndarray, scores: np.ndarray, threshold: float = fixed.TILE_IOU) -> np.ndarray:
    """Places of the boxes that greedy suppression within classes keeps, highest score first, ties by place."""
    left, kept = np.lexsort((np.arange(len(scores)), -scores)), []
    while len(left):
        first, left = left[0], left[1:]
        kept.append(first)
        left = left[(classes[left] != classes[first]) | (_ious(boxes[left], boxes[first]) <= threshold)]
    return np.array(kept, np.int64)


def _scored(output: np.ndarray, classes: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of [channels, anchors] whose best class (the first, class 0 with 0 if none is above 0) reaches least."""
    scores = output[4 : 4 + classes]
    best, top = scores.argmax(axis=0), np.maximum(scores.max(axis=0), 0)
    best = np.where(top > 0, best, 0)
    on = np.flatnonzero(top >= least)
    return on, best[on], top[on]


def _boxed(corners: np.ndarray, classes: np.ndarray, scores: np.ndarray, fit: Fit) -> Found:
    """Suppressed upright boxes around corners [n, k, 2] in canvas coordinates; boxes without an area go."""
    inside = fit.back(corners)
    low, high = inside.min(axis=1), inside.max(axis=1)
    boxes = np.concatenate([low, high - low], axis=1).astype(np.float32)
    real = np.flatnonzero((boxes[:, 2:] > 0).all(axis=1))
    kept = real[tile_suppressed(boxes[real], classes[real], scores[real])]
    return boxes[kept], classes[kept], scores[kept], None


def decode_upright(output: np.ndarray, fit: Fit, least: float, side: int, classes: int = 80) -> Found:
    """Boxes of [1, 4 + classes + more, anchors]: centre and size, then class scores; mask coefficients are not used."""
    if output.ndim != 3 or output.shape[1] < 4 + classes:
        raise ValueError(f"unexpected output shape {output.shape}")
    on, best, top = _scored(output[0], classes, least)
    centre, half = output[0, :2, on], output[0, 2:4, on] / 2
    return _boxed(np.stack([centre - half, centre + half], axis=1), best, top, fit)


def decode_rotated(output: np.ndarray, fit: Fit, least: float, side: int, classes: int = 15) -> Found:
    """Upright boxes around the turned ones of [1, 4 + classes + 1, anchors]; the channel after the classes is the angle."""
    if output.ndim != 3 or output.shape[1] < 5 + classes:
        raise ValueError(f"unexpected output shape {output.shape}")
    on, best, top = _scored(output[0], classes, least)
    centre, half, angle = output[0, :2, on], output[0, 2:4, on] / 2, output[0, 4 + classes, on]
    c, s = np.cos(angle), np.sin(angle)
    turned = [np.stack([i * half[:, 0] * c - j * half[:, 1] * s, i * half[:, 0] * s + j * half[:, 1] * c], axis=1) for i in (-1, 1) for j in (-1, 1)]
    return _boxed(centre[:, None] + np.stack(turned, axis=1), best, top, fit)


def decode_cells(output: np.ndarray, fit: Fit, least: float, side: int, classes: int = 8) -> Found:
    """Outlines of the winning class of each block of cells of the logits [1, classes, rows, columns].

    Cells vote with their best class where its softmax probability reaches least and the class isn't an excluded one;
    a winner needs fixed.VOTES, ties go to the smaller class; confidence is the mean over its cells. The fixed.TILE_LIMIT
    most confident come back, ties in reading order.
    """
    if output.ndim != 4 or output.shape[1] != classes:
        raise ValueError(f"unexpected output shape {output.shape}")
    logits = output[0]
    label = logits.argmax(axis=0)
    prob = 1 / np.exp(logits - logits.max(axis=0)).sum(axis=0)
    votes = (prob >= least) & ~np.isin(label, fixed.EXCLUDED)
    cell = np.array([side / logits.shape[2], side / logits.shape[1]])
    out = []
    for by in range(0, logits.shape[1], fixed.BLOCK):
        for bx in range(0, logits.shape[2], fixed.BLOCK):
            block = np.s_[by : by + fixed.BLOCK, bx : bx + fixed.BLOCK]
            count = np.bincount(label[block][votes[block]], minlength=classes)
            winner = int(count.argmax())
            if count[winner] < fixed.VOTES:
                continue
            chosen = votes[block] & (label[block] == winner)
            ring = fit.back((np.array(largest_ring(chosen)) + (bx, by)) * cell)
            low, high = ring.min(axis=0), ring.max(axis=0)
            if (high > low).all():
                out.append((prob[block][chosen].mean(), winner, np.concatenate([low, high - low]), ring))
    out = sorted(out, key=lambda x: -x[0])[: fixed.TILE_LIMIT]
    boxes = np.array([b for _, _, b, _ in out], np.float32).reshape(-1, 4)
    return boxes, np.array([c for _, c, _, _ in out], np.int64), np.array([p for p, _, _, _ in out], np.float32), [r for _, _, _, r in out]


@dataclass(frozen=True)
class Backend:
    """A kind of model: side of its canvas, filling, normalising, and how its output is read."""

    side: int
    fill: int
    normalise: bool
    decode: Callable[[np.ndarray, Fit, float, int], Found]


#: Registered kinds of models, by the names of the configuration.
BACKENDS = {
    "onnx": Backend(640, 114, False, decode_upright),
    "dota_obb": Backend(1024, 114, False, decode_rotated),
    "segformer_loveda": Backend(512, 0, True, decode_cells),
}


@lru_cache(4)
def onnx_model(path: str) -> Model:
    """The first output of an ONNX file's model, with one thread a worker; needs onnxruntime."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
    feed, first = session.get_inputs()[0].name, session.get_outputs()[0].name
    return lambda tensor: session.run([first], {feed: tensor})[0]


def detect(image: np.ndarray, model: Model, backend: Backend, least: float) -> Found:
    """Detections of one image [h, w, bands]."""
    tensor, fit = prepared(image, backend.side, backend.fill, backend.normalise)
    return backend.decode(model(tensor), fit, least, backend.side)


def _rows(frames: Iterator[pd.DataFrame], make: Callable[[], Model], backend: Backend, least: float, keys: list[str]) -> Iterator[pd.DataFrame]:
    model = make()
    for frame in frames:
        out = []
        for tile in frame.itertuples(index=False):
            if tile.pixels is None or len(tile.pixels) != tile.width * tile.height * tile.band_count or not tile.pixels:
                continue
            image = np.frombuffer(tile.pixels, np.uint8).reshape(tile.height, tile.width, tile.band_count)
            boxes, classes, scores, rings = detect(image, model, backend, least)
            for i, (b, c, s) in enumerate(zip(boxes.tolist(), classes.tolist(), scores.tolist(), strict=True)):
                ring = [{"x": float(x), "y": float(y)} for x, y in rings[i]] if rings else []
                out.append((*(getattr(tile, k) for k in keys), i, c, s, *b, ring))
        yield pd.DataFrame(out, columns=[*keys, "ordinal", "class_id", "confidence", "x", "y", "w", "h", "polygon"])


def detections(tiles: DataFrame, name: str, make: Callable[[], Model], least: float, keys: list[str]) -> DataFrame:
    """tiles (keys, width, height, band_count, pixels) -> (keys, ordinal, class_id, confidence, x, y, w, h, polygon).

    make is called once a task for the model, such as partial(onnx_model, path). Tiles whose pixels are missing or of
    another length than their size says give nothing. No shuffle.
    """
    if name not in BACKENDS:
        raise ValueError(f"model {name} is not registered")
    kinds = dict(tiles.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), DETECTION])
    rows = tiles.select(*keys, "width", "height", "band_count", "pixels")
    return rows.mapInPandas(lambda frames: _rows(frames, make, BACKENDS[name], least, keys), schema)


def onnx_detections(tiles: DataFrame, name: str, path: str, least: float, keys: list[str]) -> DataFrame:
    """detections by the ONNX file at path, which every executor must reach."""
    return detections(tiles, name, partial(onnx_model, path), least, keys)
