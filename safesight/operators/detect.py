"""Detections: filters, tiles and suppression of overlaps."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from safesight.functions.geometry import box, intersection, iou
from safesight.lineage import cut, large
from safesight.schemas import FRAME

#: Boxes of a frame and class up to which one task folds over them.
CROWD = 64
BOX = ["x1", "y1", "x2", "y2"]


def filter_detections(df: DataFrame, min_conf: float = 0.0, classes: list[int] | None = None) -> DataFrame:
    """Confidence and class predicate (pushed into Parquet)."""
    df = df.where(F.col("conf") >= min_conf)
    return df if classes is None else df.where(F.col("cls").isin(*classes))


def tiles_to_frame(tiled: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """Tile-local boxes to frame coordinates, with full-frame boxes if given."""
    moved = tiled.withColumns({"x1": F.col("x1") + F.col("tile_x"), "x2": F.col("x2") + F.col("tile_x"), "y1": F.col("y1") + F.col("tile_y"), "y2": F.col("y2") + F.col("tile_y")}).drop("tile_x", "tile_y")
    return moved if full is None else moved.unionByName(full.select(*moved.columns))


def suppress_overlaps(df: DataFrame, iou_max: float = 0.5) -> DataFrame:
    """Per frame and class: a box stays if no better box that stays overlaps it by more than iou_max.

    Better: higher confidence, then smaller det_id (one box a frame and class). Groups of
    up to CROWD boxes are dealt out, sorted and folded, many at a time; larger ones go by
    _in_rounds(). Which there are is counted when this is called.
    """
    keys = [*FRAME, "cls"]
    # by one number first, which no group has more boxes than: most tables have no crowd
    most = df.groupBy(F.xxhash64(*keys).alias("_group")).count().agg(F.max("count")).first()[0] or 0
    if most <= CROWD:
        return _folded(df, iou_max)
    crowded = cut(df.groupBy(*keys).count().where(F.col("count") > CROWD).select(*keys))
    few, many = (df.join(large(crowded), keys, how) for how in ("left_anti", "left_semi"))
    return _folded(few.select(*df.columns), iou_max).unionByName(_in_rounds(many.select(*df.columns), iou_max))


def _folded(df: DataFrame, iou_max: float) -> DataFrame:
    """Groups of few boxes: in order of rank within sorted partitions, see _kept()."""
    keys = [*FRAME, "cls"]
    rest = [c for c in df.columns if c not in keys]
    # the hash comes first, as rows are then told apart by one number
    dealt = df.repartition(*keys).withColumn("_group", F.xxhash64(*keys)).withColumn("_rank", -F.col("conf"))
    ranked = dealt.sortWithinPartitions("_group", *keys, "_rank", "det_id", *(F.col(c).cast("double") for c in BOX), *rest).drop("_group", "_rank")
    return ranked.mapInArrow(partial(_kept, keys, iou_max), df.schema)


def _kept(keys: list[str], iou_max: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that stay, of rows sorted by group and rank; a group that goes on in the next batch waits for it."""
    held = None
    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        if not rows.num_rows:
            continue
        starts = _starts(rows, keys)
        held = rows.slice(starts[-1])
        if starts[-1]:
            yield _judged(rows.slice(0, starts[-1]), starts[:-1], iou_max)
    if held is not None:
        yield _judged(held, np.zeros(1, np.int64), iou_max)


def _starts(rows: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """First rows of groups; null keys are alike."""
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for key in keys:
        c = rows.column(key)
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        new[1:] |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _judged(rows: pa.RecordBatch, starts: np.ndarray, iou_max: float) -> pa.RecordBatch:
    """Whole groups: boxes are held against the k-th before them for k = 1, 2, .., then stay or go in order of place."""
    n = rows.num_rows
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    columns = [rows.column(c).cast(pa.float64()) for c in BOX]
    box_ = [(c.fill_null(0.0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)) for c in columns]
    worse, better = [], []
    for k in range(1, int(place.max()) + 1):
        at = np.flatnonzero(place >= k)
        at = at[_iou_above([(v[at], null[at]) for v, null in box_], [(v[at - k], null[at - k]) for v, null in box_], iou_max)]
        worse.append(at)
        better.append(at - k)
    keep = np.ones(n, bool)
    if worse:
        worse, better = np.concatenate(worse), np.concatenate(better)
        for k in np.unique(place[worse]).tolist():
            own = place[worse] == k
            keep[worse[own][keep[better[own]]]] = False
    return rows.filter(pa.array(keep))


def _iou_above(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]], iou_max: float) -> np.ndarray:
    """geometry.iou() > iou_max on columns (values, nulls) of x1, y1, x2, y2: nulls and NaN count as in SQL."""
    with np.errstate(all="ignore"):

        def common(first: int, last: int) -> np.ndarray:
            (u, un), (v, vn) = a[first], b[first]
            low = np.where(un, v, np.where(vn, u, np.maximum(u, v)))
            (x, xn), (y, yn) = a[last], b[last]
            high = np.where(xn, y, np.where(yn, x, np.fmin(x, y)))
            return np.where(un & vn | xn & yn, 0.0, np.maximum(high - low, 0.0))

        def side(c: list[tuple[np.ndarray, np.ndarray]], first: int, last: int) -> np.ndarray:
            return np.where(c[first][1] | c[last][1], 0.0, np.maximum(c[last][0] - c[first][0], 0.0))

        inter = common(0, 2) * common(1, 3)
        union = side(a, 0, 2) * side(a, 1, 3) + side(b, 0, 2) * side(b, 1, 3) - inter
        return ~(np.where(union <= 0, 0.0, inter / union) <= iou_max)


def _in_rounds(df: DataFrame, iou_max: float) -> DataFrame:
    """Pairs that overlap come from a grid; then boxes without a better one stay and strike out the worse ones beside them, until no pair is left."""
    keys = [*FRAME, "cls"]
    pairs, struck = cut(overlapping(df, iou_max)), None
    while not pairs.isEmpty():
        worse = pairs.select(*keys, F.col("worse").alias("better")).distinct()
        gone = cut(pairs.join(large(worse), [*keys, "better"], "left_anti").select(*keys, F.col("worse").alias("det_id")).distinct())
        struck = gone if struck is None else struck.unionByName(gone)
        for side in ("better", "worse"):
            pairs = pairs.join(large(gone.withColumnRenamed("det_id", side)), [*keys, side], "left_anti")
        pairs = cut(pairs)
    return (df if struck is None else df.join(large(struck), [*keys, "det_id"], "left_anti")).select(*df.columns)


def overlapping(df: DataFrame, iou_max: float) -> DataFrame:
    """Pairs (frame, class, better, worse) of boxes that overlap by more than iou_max.

    A box stands in the cells of a grid as wide as its longer side (rounded up to a power
    of 2), four at most. It asks for larger ones in the grids of its own size and of those
    up to 1 / iou_max times wider: from half on by its centre, which the larger box then
    covers, below that by all its cells. So a frame's work grows with boxes and the pairs that are near.
    """
    keys = [*FRAME, "cls"]
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(2.0**-20))
    boxes = df.select(*keys, "det_id", "conf", "x1", "y1", "x2", "y2").withColumn("level", F.ceil(F.log2(side)).cast("int"))
    if iou_max > 0:
        wider = math.ceil(math.log2(1 / iou_max) - 1e-9)
    else:
        low, high = boxes.agg(F.min("level"), F.max("level")).first()
        wider = 0 if low is None else high - low
    centre = iou_max >= 0.5

    def cells(rows: DataFrame, level: str, point: bool) -> DataFrame:
        size = F.pow(F.lit(2.0), F.col(level))
        for axis in "xy":
            a, b = (F.col(f"{axis}{k}") for k in (1, 2))
            a, b = ((a + b) / 2, (a + b) / 2) if point else (a, b)
            first, last = F.floor(a / size), F.floor(b / size)
            rows = rows.withColumn(f"c{axis}", first) if point else rows.withColumn(f"c{axis}", F.explode(F.sequence(first, last)))
        return rows

    named = lambda rows, p: rows.select(*keys, F.col("at" if p == "s" else "level").alias("at"), "cx", "cy", *(F.col(c).alias(f"{p}_{c}") for c in ("det_id", "conf", "level", "x1", "y1", "x2", "y2")))
    homes = named(cells(boxes, "level", False), "l")
    asks = named(cells(boxes.withColumn("at", F.explode(F.sequence(F.col("level"), F.col("level") + wider))), "at", centre), "s")
    a, b = (box(*(f"{p}_{c}" for c in ("x1", "y1", "x2", "y2"))) for p in "sl")
    met = asks.join(large(homes), [*keys, "at", "cx", "cy"]).where("s_level < l_level or (s_level = l_level and s_det_id < l_det_id)").where((intersection(a, b) > 0) & (iou(a, b) > iou_max))
    first = (F.col("s_conf") > F.col("l_conf")) | ((F.col("s_conf") == F.col("l_conf")) & (F.col("s_det_id") < F.col("l_det_id")))
    pairs = met.select(*keys, F.when(first, F.col("s_det_id")).otherwise(F.col("l_det_id")).alias("better"), F.when(first, F.col("l_det_id")).otherwise(F.col("s_det_id")).alias("worse"))
    return pairs if centre else pairs.distinct()
