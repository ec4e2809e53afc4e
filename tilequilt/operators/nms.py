"""Greedy class-aware non-maximum suppression as a fixpoint over the conflict graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..staging import staged

#: A conflict graph of up to so many edges (16 bytes each) is settled by one task; a larger one in rounds until it is that small.
LOCAL_EDGES = 1_000_000
#: Of over_half_pairs: boxes in a part of a cell, pairs tried at a time, pairs in a batch, squares of a part along a side.
PART_BOXES, TILE_PAIRS, PAIR_ROWS, SQUARES = 1 << 16, 1 << 16, 1 << 16, 8
#: What a row is in its part of a cell: its centre lies there, others look for it, it belongs to the cell's level.
HOME, LISTED, OWN = 1, 2, 4
_VALUES = ("det_id", "conf", "x0", "y0", "x1", "y1")


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in ("x0", "y0", "x1", "y1")}


def conflicts(boxes: DataFrame, keys: list[str], cell: float, over: Callable[[dict, dict], Column]) -> DataFrame:
    """(src, dst): pairs of boxes with equal keys that conflict, src first in order of (conf descending, det_id).

    boxes: det_id, conf, x0, y0, x1, y1, keys. Boxes meet in grid cells by an equi-join; a pair counts only in the cell
    of its intersection's first corner, so no pair comes twice and none is missed. Grids double in size by level; a box
    belongs to the level whose cells are no smaller than it, where it lies in four cells at most, and is also listed at
    the coarser levels in use, for the boxes of those; a pair meets at the coarser of its two levels.
    """
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(cell))
    side = boxes.select("det_id", "conf", "x0", "y0", "x1", "y1", *keys).withColumn("level", F.ceil(F.log2(extent / cell)).cast("int"))
    most = side.agg(F.max("level")).first()[0] or 0
    side = side.withColumn("at", F.explode(F.sequence(F.col("level"), F.lit(most)))).withColumn("size", F.lit(cell) * F.pow(F.lit(2.0), F.col("at")))

    def cells(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / F.col("size")).cast("long"), F.floor(F.col(hi) / F.col("size")).cast("long"))

    side = side.withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", "y1")))
    on = [*keys, "at", "size", "cx", "cy"]
    values = ("det_id", "conf", "x0", "y0", "x1", "y1")
    own = side.where("level = at").select(*on, *(F.col(c).alias(f"a_{c}") for c in values))
    listed = side.select(*on, (F.col("level") < F.col("at")).alias("finer"), *(F.col(c).alias(f"b_{c}") for c in values))
    before = (F.col("a_conf") > F.col("b_conf")) | ((F.col("a_conf") == F.col("b_conf")) & (F.col("a_det_id") < F.col("b_det_id")))
    here = (F.floor(F.greatest("a_x0", "b_x0") / F.col("size")) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / F.col("size")) == F.col("cy"))
    met = own.join(listed, on).where((before | F.col("finer")) & here & over(box("a_"), box("b_")))
    return met.select(F.when(before, F.col("a_det_id")).otherwise(F.col("b_det_id")).alias("src"), F.when(before, F.col("b_det_id")).otherwise(F.col("a_det_id")).alias("dst"))


def over_half(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """IoU over 1/2, in whole numbers."""
    return 2 * G.intersection(a, b) > G.box_area(a) + G.box_area(b) - G.intersection(a, b)


def iou_over(threshold: float) -> Callable[[dict, dict], Column]:
    """IoU, narrowed to single precision, over a threshold."""
    return lambda a, b: G.iou(a, b) > F.lit(threshold).cast("float")


def _span_type(span: int) -> type:
    """A type that holds three times the area of a box of that side."""
    return np.int32 if span < 1 << 14 else np.int64 if span < 1 << 30 else object


def _near_tiles(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, rank: np.ndarray, flag: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), about TILE_PAIRS all with all: of homes, by squares of their centres, and of the listed boxes
    around the centres of a square that come after the first of i in rank, in which all arrays are sorted."""
    cx, cy, own = x0 + x1, y0 + y1, flag & OWN > 0
    # Two boxes of the finer level meet on their own grid.
    for home, listed in ((own, flag & LISTED > 0), (~own, (flag & LISTED > 0) & own)):
        home, listed = np.flatnonzero(home & (flag & HOME > 0)), np.flatnonzero(listed)
        if not len(home) or not len(listed):
            continue
        at = [(c[home] - c[home].min()).astype(np.int64) * SQUARES // (int(c[home].max() - c[home].min()) + 1) for c in (cx, cy)]
        square = at[0] * SQUARES + at[1]
        by = np.argsort(square, kind="stable")
        for mine in np.split(home[by], np.flatnonzero(np.diff(square[by])) + 1):
            around = [(lo[listed] * 2 < c[mine].max()) & (hi[listed] * 2 > c[mine].min()) for lo, hi, c in ((x0, x1, cx), (y0, y1, cy))]
            met = listed[(around[0] & around[1]).astype(bool)]
            step = max(1, TILE_PAIRS // max(1, len(met)))
            for begin in range(0, len(mine), step):
                i = mine[begin : begin + step]
                j = met[np.searchsorted(rank[met], rank[i[0]], side="right") :]
                if len(j):
                    yield i, j


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one part of a cell (see over_half_pairs), written out by about PAIR_ROWS."""
    part = {n: np.concatenate(v) for n, v in zip(("id", "conf", "x0", "y0", "x1", "y1", "flag"), zip(*([c.to_numpy() for c in b.select([*_VALUES, "flag"]).columns] for b in batches)))}
    order = np.lexsort((part["id"], -np.unique(part["conf"], return_inverse=True)[1]))
    part = {n: v[order] for n, v in part.items()}
    ids, flag = part["id"], part["flag"]
    # Equal places in the order are no pair.
    rank = np.cumsum(np.concatenate([[0], (np.diff(part["conf"]) != 0) | (np.diff(ids) != 0)]))
    left, top = part["x0"].min(), part["y0"].min()
    kind = _span_type(int(max(part["x1"].max() - left, part["y1"].max() - top)))
    x0, x1, y0, y1 = ((part[n] - o).astype(kind) for n, o in (("x0", left), ("x1", left), ("y0", top), ("y1", top)))
    area = (x1 - x0) * (y1 - y0)
    out, held = [], 0
    for i, j in _near_tiles(x0, x1, y0, y1, rank, flag):
        u = i[:, None]
        shared = np.minimum(x1[u], x1[j])
        shared -= np.maximum(x0[u], x0[j])
        np.maximum(shared, 0, out=shared)
        high = np.minimum(y1[u], y1[j])
        high -= np.maximum(y0[u], y0[j])
        shared *= high
        shared *= 3
        hit = np.flatnonzero((shared > area[u] + area[j]) & (rank[u] < rank[j]))
        if not len(hit):
            continue
        u, v = i[hit // len(j)], j[hit % len(j)]
        w, h = np.minimum(x1[u], x1[v]) - np.maximum(x0[u], x0[v]), np.minimum(y1[u], y1[v]) - np.maximum(y0[u], y0[v])
        out.append((ids[u], ids[v], w.astype(np.int64), h.astype(np.int64)))
        held += len(u)
        if held >= PAIR_ROWS:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a_id", "b_id", "w", "h"])
            out, held = [], 0
    if out:
        yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a_id", "b_id", "w", "h"])


def _flat_pairs(side: DataFrame, flat: Column, keys: list[str]) -> DataFrame:
    """(a_id, b_id, w, h): what the comparisons of over_half_pairs hold for where a or b has no positive width or height."""
    a, b = (side.select(*keys, flat.alias(f"{p}_flat"), *(F.col(c).alias(f"{p}_{c}") for c in _VALUES)) for p in "ab")
    both = a.where("a_flat").join(b, keys).unionByName(a.where("not a_flat").join(b.where("b_flat"), keys))
    w, h = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0"), F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    before = "(a_conf > b_conf or a_conf = b_conf and a_det_id < b_det_id) and a_x0 < b_x1 and b_x0 < a_x1 and a_y0 < b_y1 and b_y0 < a_y1"
    over = 3 * w * h > G.box_area(box("a_")) + G.box_area(box("b_"))
    return both.where(before).where(over).select(F.col("a_det_id").alias("a_id"), F.col("b_det_id").alias("b_id"), w.alias("w"), h.alias("h"))


def over_half_pairs(boxes: DataFrame, keys: list[str], cell: int = 256, block: int = PART_BOXES) -> DataFrame:
    """(a_id, b_id, w, h): pairs of boxes in whole numbers, with equal keys and IoU over 1/2, a first in order of (conf
    descending, det_id), with the sides of their intersection. Rows that share a det_id are boxes of their own.

    As conflicts() over grids by box size, but the boxes are dealt out once and their pairs never: at over 1/2 the
    centre of each box lies within the other, and neither is twice as long as the other. So a pair meets where the
    centre of a lies, on the grid of the larger one, and only boxes of the next finer level are listed on a grid besides
    its own. A cell of over block boxes is cut into blocks, and each pair of blocks is a part of its own.
    Boxes without a positive width and height, for which the SQL's comparisons hold in odd cases, meet all of their keys.
    """
    side = boxes.select(F.col("det_id").cast("long").alias("det_id"), "conf", *(F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")), *keys).dropna()
    flat = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(cell))
    whole = side.where(~flat).withColumn("level", F.ceil(F.log2(extent / cell)).cast("int"))
    most, flats = whole.agg(F.max("level")).first()[0] or 0, side.where(flat).limit(1).count()
    whole = whole.withColumn("at", F.explode(F.sequence(F.col("level"), F.least(F.col("level") + 1, F.lit(most))))).withColumn("size", F.lit(cell) * F.pow(F.lit(2.0), F.col("at")))

    def cells(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / F.col("size")).cast("long"), F.floor(F.col(hi) / F.col("size")).cast("long"))

    whole = whole.withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", "y1")))
    on = [*keys, "at", "cx", "cy"]
    large = whole.groupBy(*on).agg(F.count("*").alias("count")).where(F.col("count") > block).withColumn("nb", F.ceil(F.col("count") / block)).drop("count")
    # Few: fewer than one in block rows.
    whole = whole.join(F.broadcast(large), on, "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("b", F.pmod(F.xxhash64(*_VALUES), "nb"))
    centre = (F.floor((F.col("x0") + F.col("x1")) / (F.col("size") * 2)) == F.col("cx")) & (F.floor((F.col("y0") + F.col("y1")) / (F.col("size") * 2)) == F.col("cy"))
    own = F.when(F.col("level") == F.col("at"), OWN).otherwise(0)
    others = F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)

    def role(part: Column, flag: Column) -> Column:
        return F.struct(part.cast("long").alias("part"), flag.cast("int").alias("flag"))

    one = F.array(role(F.lit(0), F.when(centre, HOME + LISTED).otherwise(LISTED) + own))
    many = F.concat(F.filter(F.transform(others, lambda o: role(F.col("b") * F.col("nb") + o, HOME + own)), lambda _: centre), F.transform(others, lambda o: role(o * F.col("nb") + F.col("b"), LISTED + own)))
    dealt = whole.withColumn("role", F.explode(F.when(F.col("nb") == 1, one).otherwise(many))).select(*on, "role.part", "role.flag", *_VALUES)
    met = dealt.groupBy(*on, "part").applyInArrow(_halves, "a_id long, b_id long, w long, h long")
    return met.unionByName(_flat_pairs(side, flat, keys)) if flats else met


def dropped(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Ids that greedy suppression drops: each box is decided once all that precede it are."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    u, v = at[: len(src)], at[len(src) :]
    order = np.argsort(u, kind="stable")
    nexts, cut = v[order].tolist(), np.searchsorted(u[order], np.arange(len(ids) + 1)).tolist()
    waits = np.bincount(v, minlength=len(ids)).tolist()
    gone = bytearray(len(ids))
    ready = [i for i, n in enumerate(waits) if n == 0]
    while ready:
        i = ready.pop()
        for j in nexts[cut[i] : cut[i + 1]]:
            if not gone[i]:
                gone[j] = 1
            waits[j] -= 1
            if not waits[j]:
                ready.append(j)
    return ids[np.frombuffer(gone, np.uint8) == 1]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("src").to_numpy(), b.column("dst").to_numpy()) for b in batches]
    none = np.empty(0, np.int64)
    yield pa.record_batch([pa.array(dropped(*(np.concatenate([none, *x]) for x in (zip(*parts) if parts else ((), ())))))], names=["det_id"])


def suppressed(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """det_id of all that greedy suppression drops, given directed conflicts (which have no cycle).

    A box that nothing undecided precedes is kept and drops all that it conflicts with; both leave the graph. Such
    rounds go on, each written to the shared folder, until no more than local edges are left, which one task settles;
    most graphs begin below that. Boxes without a conflict never enter.
    """
    edges, gone = staged(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))), None
    while edges.count() > local:
        roots = edges.select("src").distinct().join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
        out = staged(edges.join(roots, "src", "left_semi").select(F.col("dst").alias("det_id")).distinct())
        gone = out if gone is None else gone.unionByName(out)
        left = edges.join(out.withColumnRenamed("det_id", "dst"), "dst", "left_anti")
        edges = staged(left.join(out.withColumnRenamed("det_id", "src"), "src", "left_anti").join(roots, "src", "left_anti"))
    rest = edges.coalesce(1).mapInArrow(_settled, "det_id long")
    return rest if gone is None else gone.unionByName(rest)


def suppress(boxes: DataFrame, keys: list[str], cell: float = 128, over: Callable[[dict, dict], Column] = over_half) -> DataFrame:
    """The rows of boxes that greedy class-aware suppression keeps."""
    return boxes.join(suppressed(conflicts(boxes, keys, cell, over)), "det_id", "left_anti")
