"""Tracking as relational linking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from safesight.functions.geometry import box, intersection, iou
from safesight.lineage import cut, large
from safesight.schemas import TRACK

CAMERA = ["run", "camera_id"]
BOX = ["x1", "y1", "x2", "y2"]
#: Frames of a camera within which chains are followed in one task.
BLOCK = 1024


def _ends(rows: DataFrame) -> DataFrame:
    return rows.select(*CAMERA, F.col("det_id").alias("prev_det_id"), F.col("frame").alias("f1"), F.col("conf").alias("c1"), *(F.col(c).alias(f"a{c}") for c in BOX))


def _starts(rows: DataFrame) -> DataFrame:
    return rows.select(*CAMERA, "det_id", F.col("frame").alias("f2"), F.col("conf").alias("c2"), *(F.col(c).alias(f"b{c}") for c in BOX))


def _overlaps(met: DataFrame, iou_min: float, *columns: str) -> DataFrame:
    """Pairs with enough overlap, and the columns that choose the best."""
    a, b = (box(*(f"{side}{c}" for c in BOX)) for side in "ab")
    return met.where(intersection(a, b) > 0).select(*columns, "prev_det_id", "det_id", (F.col("f2") - F.col("f1")).alias("gap"), F.round(iou(a, b), 9).alias("iou")).where(F.col("iou") >= iou_min)


def _mutual(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """pairs with a column: whether both take each other for the best, by the nearest frame, then IoU, then smaller id. keys: what pairs are dealt by already."""
    forth = Window.partitionBy(*keys, "prev_det_id").orderBy("gap", F.desc("iou"), "det_id")
    back = Window.partitionBy(*keys, "det_id").orderBy("gap", F.desc("iou"), "prev_det_id")
    both = pairs.withColumn("_r1", F.row_number().over(forth)).withColumn("_r2", F.row_number().over(back))
    return both.withColumn(name, (F.col("_r1") == 1) & (F.col("_r2") == 1)).drop("_r1", "_r2")


def _adjacent(seen: DataFrame, high: float, iou_min: float) -> DataFrame:
    """Links of tiers 1 and 2, one frame to the next: an equi-join on the frame, whose exchange serves all choices of the best too."""
    at = [*CAMERA, "at"]
    met = _ends(seen).withColumn("at", F.col("f1") + 1).join(large(_starts(seen).withColumn("at", F.col("f2"))), at)
    pairs = _overlaps(met.withColumn("sure", (F.col("c1") >= high) & (F.col("c2") >= high)), iou_min, *at, "sure")
    first = _mutual(pairs, [*at, "sure"], "_best").withColumn("_one", F.col("_best") & F.col("sure")).drop("_best")
    for end in ("prev_det_id", "det_id"):
        first = first.withColumn(f"_{end}", F.max("_one").over(Window.partitionBy(*at, end)))
    # what touches a link of tier 1 without being one is out; links of tier 1 touch nothing that is left
    rest = first.where("_one or not (_prev_det_id or _det_id)")
    tier = F.when(F.col("_one"), 1).otherwise(2)
    return _mutual(rest, at, "_two").where("_two").select(*CAMERA, "prev_det_id", "det_id", "gap", "iou", tier.alias("tier"))


def _bridged(ends: DataFrame, starts: DataFrame, gaps: tuple[int, int], iou_min: float) -> DataFrame:
    """Links over gaps of frames, an interval join: both sides get a bucket of frames as equi key, the later side also the bucket before, so one camera's frames spread over tasks."""
    low, high = gaps
    later = F.floor(F.col("f2") / high)
    a = _ends(ends).withColumn("bucket", F.floor(F.col("f1") / high))
    b = _starts(starts).withColumn("bucket", F.explode(F.array(later, later - 1)))
    met = a.join(large(b), [*CAMERA, "bucket"]).where((F.col("f2") - F.col("f1")).between(low, high))
    return _mutual(_overlaps(met, iou_min, *CAMERA), CAMERA, "_best").where("_best").drop("_best")


def link_detections(df: DataFrame, high: float = 0.5, low: float = 0.1, max_gap: int = 30, iou_min: float = 0.3) -> DataFrame:
    """Links between person boxes: run, camera_id, prev_det_id, det_id, gap, iou, tier.

    Tier 1 links confident boxes of adjacent frames; tier 2 extends what is still
    unlinked by boxes of low confidence; tier 3 bridges gaps up to max_gap between
    ends and confident starts. Each tier sees only what the ones before left over,
    so gaps cost candidates for the ends of chains alone. df is read four times: where
    its rows of a camera are together, as after a groupBy or repartition on it, no box is
    shuffled, which a table in between would forget; cut() it if it is dear to compute.
    """
    seen = df.where(F.col("conf") >= low).select(*CAMERA, "frame", "det_id", "conf", "x1", "y1", "x2", "y2")
    found = cut(_adjacent(seen, high, iou_min))
    third = _bridged(_without(seen, found, "prev_det_id"), _without(seen.where(F.col("conf") >= high), found, "det_id"), (2, max_gap), iou_min)
    return found.unionByName(third.withColumn("tier", F.lit(3)))


def _without(rows: DataFrame, links: DataFrame, end: str) -> DataFrame:
    """rows that are not that end of a link."""
    return rows.join(large(links.select(*CAMERA, F.col(end).alias("det_id"))), [*CAMERA, "det_id"], "left_anti")


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boxes of a camera's block in order of frames: the first box of their chain there (track_id), and what that one follows in an earlier block (up)."""
    roots = {}
    for batch in batches:
        nth, det, up = (batch.column(c).to_pylist() for c in ("_nth", "det_id", "up"))
        first, before = [], []
        for n, d, u in zip(nth, det, up):
            if n == 1:
                roots = {}
            found = roots.get(u) if u is not None else None
            found = roots[d] = (d, u) if found is None else found
            first.append(found[0])
            before.append(found[1])
        names = [c for c in batch.schema.names if c not in ("_block", "_nth", "up")]
        columns = [batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(first, pa.int64()), pa.array(before, pa.int64())], [*names, "track_id", "up"])


def assign_tracks(dets: DataFrame, links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """dets with track_id: the first detection of their chain.

    Chains are followed within blocks of frames of a camera; what goes on over their edges,
    a row per chain and block, by pointer doubling, so rounds are the logarithm of the most blocks of a chain.
    """
    named = dets.join(large(links.select(*CAMERA, "det_id", F.col("prev_det_id").alias("up"))), [*CAMERA, "det_id"], "left")
    blocks = named.select(*dets.columns, F.col("up").cast("long").alias("up"), F.floor(F.col("frame") / BLOCK).alias("_block"))
    # the window puts a block's rows together and in order; rows of a camera that are together already stay where they are
    order = ["frame", "det_id"]
    dealt = blocks.withColumn("_nth", F.row_number().over(Window.partitionBy(*CAMERA, "_block").orderBy(*order))).sortWithinPartitions(*CAMERA, "_block", *order)
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in dets.dtypes)
    followed = cut(dealt.mapInArrow(_followed, f"{kinds}, track_id long, up long"))
    at = cut(followed.where("up is not null and det_id = track_id").select(*CAMERA, "det_id", "up"))
    if at.isEmpty():
        return followed.select(*dets.columns, "track_id")
    # what a first box of a block follows is some box of an earlier one: its own first box there
    heads = followed.select(*CAMERA, F.col("det_id").alias("up"), F.col("track_id").alias("_head"))
    at = cut(at.join(large(heads), [*CAMERA, "up"], "left").select(*CAMERA, "det_id", F.coalesce("_head", "up").alias("up")))
    for _ in range(max_rounds):
        above = at.select(*CAMERA, F.col("det_id").alias("up"), F.col("up").alias("up2"))
        at = cut(at.join(large(above), [*CAMERA, "up"], "left").select(*CAMERA, "det_id", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    else:
        raise RuntimeError("chains are too long")
    ends = at.select(*CAMERA, F.col("det_id").alias("track_id"), F.col("up").alias("_first"))
    return followed.join(large(ends), [*CAMERA, "track_id"], "left").withColumn("track_id", F.coalesce("_first", "track_id")).select(*dets.columns, "track_id")


def track_summary(df: DataFrame) -> DataFrame:
    """Per track: first and last frame, frames, mean confidence, mean box and displacement of its centre."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    mean = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("conf", "x1", "y1", "x2", "y2")]
    ends = df.groupBy(*TRACK).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n_frames"), *mean, F.min_by(F.struct(cx.alias("x"), cy.alias("y")), "frame").alias("a"), F.max_by(F.struct(cx.alias("x"), cy.alias("y")), "frame").alias("b"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    return ends.withColumn("displacement", F.round(F.sqrt(dx * dx + dy * dy), 6)).drop("a", "b")
