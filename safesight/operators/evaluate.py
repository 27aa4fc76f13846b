"""Four evaluations that must not be taken for one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from safesight.functions.geometry import box, intersection, iou
from safesight.lineage import cut, large
from safesight.operators.matching import dominant_pairs
from safesight.operators.segments import carried, spans
from safesight.schemas import FRAME


def _matched(dets: DataFrame, truth: DataFrame, iou_min: float, keys: list[str]) -> DataFrame:
    """Greedy matching in each group: the best det (confidence, then id) takes its best free truth box."""
    side = lambda p: [F.col(c).alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")]
    a, b = (box(*(f"{p}{c}" for c in ("x1", "y1", "x2", "y2"))) for p in "dt")
    met = dets.select(*keys, "det_id", "conf", *side("d")).join(large(truth.select(*keys, "truth_id", *side("t"))), keys)
    met = met.where(intersection(a, b) > 0) if iou_min > 0 else met
    pairs = met.select(*keys, "det_id", "conf", "truth_id", F.round(iou(a, b), 9).alias("iou")).where(F.col("iou") >= iou_min)
    rank = F.struct("conf", -F.col("det_id"), "iou", -F.col("truth_id"))
    return dominant_pairs(pairs, keys, "det_id", "truth_id", rank, dealt=True).select(*keys, "det_id", "truth_id")


def detector_ap(dets: DataFrame, truth: DataFrame, iou_min: float = 0.5) -> DataFrame:
    """Average precision per class (all-point interpolation) and a row of cls -1 with their mean.

    truth: run, camera_id, frame, cls, truth_id and box. Boxes of equal confidence form
    one step of the curve. Steps are in order over range partitions: running counts within
    a partition and totals of those before it, so no class is in one task, whatever the
    number of different confidences.
    """
    keys = [*FRAME, "cls"]
    hits = _matched(dets, truth, iou_min, keys).select(*keys, "det_id").withColumn("tp", F.lit(1))
    marked = dets.select(*keys, "det_id", "conf").join(large(hits), [*keys, "det_id"], "left")
    total = truth.groupBy("cls").agg(F.count("*").alias("n_truth"))
    steps = marked.groupBy("cls", (-F.col("conf")).alias("at")).agg(F.count("tp").alias("tp"), F.count("*").alias("n"))
    steps = cut(steps.repartitionByRange("cls", "at").withColumn("block", F.spark_partition_id()))
    several = spans(steps, ["cls"])
    for name in ("tp", "n"):
        steps = carried(steps, ["cls"], "at", f"{name}s", F.col(name), "sum", True, several)
    # the best precision from a step on: the same from the other end
    back = steps.withColumns({"precision": F.col("tps") / F.col("ns"), "at": -F.col("at"), "block": -F.col("block")})
    back = carried(back, ["cls"], "at", "best", F.col("precision"), "max", True, several)
    area = back.join(total, "cls").groupBy("cls").agg(F.sum(F.col("tp") / F.col("n_truth") * F.col("best")).alias("ap"))
    per_class = total.join(area, "cls", "left").select("cls", "n_truth", F.round(F.coalesce("ap", F.lit(0.0)), 9).alias("ap"))
    mean = per_class.agg(F.lit(-1).alias("cls"), F.sum("n_truth").alias("n_truth"), F.round(F.avg("ap"), 9).alias("ap"))
    return per_class.unionByName(mean)


def tracking_quality(tracks: DataFrame, truth: DataFrame, iou_min: float = 0.5) -> DataFrame:
    """Per run: truth boxes, misses, false positives, identity switches and MOTA.

    tracks: person boxes with track_id; truth: person boxes with truth_id (an object's id).
    """
    pairs = _matched(tracks, truth, iou_min, FRAME).join(large(tracks.select(*FRAME, "det_id", "track_id")), [*FRAME, "det_id"])
    own = Window.partitionBy("run", "truth_id").orderBy("frame", "camera_id")
    switch = pairs.withColumn("switch", F.coalesce(F.col("track_id") != F.lag("track_id").over(own), F.lit(False)).cast("long"))
    found = switch.groupBy("run").agg(F.count("*").alias("matched"), F.sum("switch").alias("switches"))
    n = truth.groupBy("run").agg(F.count("*").alias("n_truth")).join(tracks.groupBy("run").agg(F.count("*").alias("n_boxes")), "run", "left").join(found, "run", "left").na.fill(0)
    errors = (F.col("n_truth") - F.col("matched")) + (F.col("n_boxes") - F.col("matched")) + F.col("switches")
    return n.select("run", "n_truth", (F.col("n_truth") - F.col("matched")).alias("misses"), (F.col("n_boxes") - F.col("matched")).alias("false_positives"), "switches", F.round(1 - errors / F.col("n_truth"), 9).alias("mota"))


def association_accuracy(assignments: DataFrame, truth: DataFrame) -> DataFrame:
    """Per class: right, wrong, missing and spurious assignments; precision, recall, accuracy.

    truth: run, camera_id, frame, cls, ppe_det_id, true_person (null: belongs to nobody);
    assignments: as associate() returns, with person (what true_person is compared with).
    """
    keys = [*FRAME, "cls", "ppe_det_id"]
    both = assignments.select(*keys, "person").join(large(truth.where("true_person is not null").select(*keys, "true_person")), keys, "full")
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    p, t = F.col("person"), F.col("true_person")
    n = both.groupBy("cls").agg(one(p == t).alias("right"), one(p != t).alias("wrong"), one(p.isNull()).alias("missing"), one(t.isNull()).alias("spurious"))
    made, there = F.col("right") + F.col("wrong") + F.col("spurious"), F.col("right") + F.col("wrong") + F.col("missing")
    share = lambda whole: F.round(F.when(whole > 0, F.col("right") / whole), 9)
    return n.select("*", share(made).alias("precision"), share(there).alias("recall"), share(made + F.col("missing")).alias("accuracy"))


def event_accuracy(events: DataFrame, truth: DataFrame, bucket: int = 64) -> DataFrame:
    """Per type: matched, precision, recall and mean detection delay in frames.

    truth: camera_id, violation, truth_id, start_frame, end_frame. Events and truths of
    a camera and type match if they overlap in time and are each other's best (longest
    overlap, then smaller id). Overlaps are found over buckets of frames as equi keys.
    """
    spread = lambda d: d.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_frame") / bucket), F.floor(F.col("end_frame") / bucket))))
    e = spread(events.select("camera_id", "violation", "event_id", "start_frame", "confirm_frame", "end_frame"))
    t = spread(truth.select("camera_id", "violation", "truth_id", "start_frame", "end_frame")).select("camera_id", "violation", "bucket", "truth_id", F.col("start_frame").alias("s"), F.col("end_frame").alias("t"))
    common = F.least("end_frame", "t") - F.greatest("start_frame", "s") + 1
    pairs = e.join(large(t), ["camera_id", "violation", "bucket"]).withColumn("common", common).where("common > 0").drop("bucket").distinct()
    forth, back = Window.partitionBy("event_id").orderBy(F.desc("common"), "truth_id"), Window.partitionBy("camera_id", "violation", "truth_id").orderBy(F.desc("common"), "event_id")
    best = pairs.withColumn("r1", F.row_number().over(forth)).withColumn("r2", F.row_number().over(back)).where("r1 = 1 and r2 = 1")
    hits = best.groupBy("violation").agg(F.count("*").alias("matched"), F.round(F.avg(F.col("confirm_frame") - F.col("s")), 9).alias("mean_delay"))
    n = events.groupBy("violation").agg(F.count("*").alias("n_events")).join(truth.groupBy("violation").agg(F.count("*").alias("n_truth")), "violation", "full").join(hits, "violation", "left").na.fill(0, ["n_events", "n_truth", "matched"])
    share = lambda whole: F.round(F.when(F.col(whole) > 0, F.col("matched") / F.col(whole)), 9)
    return n.select("violation", "n_events", "n_truth", "matched", share("n_events").alias("precision"), share("n_truth").alias("recall"), "mean_delay")


def metrics_table(run: str, **evaluations: tuple[DataFrame, list[str], list[str]]) -> DataFrame:
    """Long table (run, evaluation, subject, metric, value); each evaluation: (table, subject columns, metric columns)."""
    out = None
    for name, (df, subject, metrics) in evaluations.items():
        who = F.concat_ws("/", *(F.col(c).cast("string") for c in subject)) if subject else F.lit("")
        long = df.select(who.alias("subject"), *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(["subject"], metrics, "metric", "value")
        part = long.select(F.lit(run).alias("run"), F.lit(name).alias("evaluation"), "subject", "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out
