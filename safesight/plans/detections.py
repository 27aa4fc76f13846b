"""Detections derived from the customer table, and the chain from detections to events.

One customer is one worker, five workers share a camera, 40 frames each. Truth by
construction: worker = det_id div 160, frame = (det_id div 4) % 40.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from safesight.lineage import cut
from safesight.operators.associate import associate, association_candidates, frame_status
from safesight.operators.temporal import BLOCK, consecutive_events, violations
from safesight.operators.track import assign_tracks, link_detections
from safesight.schemas import TRACK

START_US = 1_767_225_600_000_000
FRAME_US = 100_000
#: Workers whose boxes are one partition.
WORKERS = 4096
#: States of persons that are one partition, when events are made of them.
STATES = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections of all customers, who are dealt out by camera first: each gives some 110 rows.

    Workers are a hundredth of the boxes, and a camera has five. Spark knows of what follows that a camera's
    rows are together, so joins, windows and groups within cameras or frames shuffle no box; joins need the
    setting for it, as they have more keys than the camera.
    """
    customers = table(spark, sf_dir, "customer")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    n = max(spark.sparkContext.defaultParallelism, customers.count() // WORKERS)
    return _boxes(_workers(customers).repartition(n, "camera_id"))


def from_customers(customers: DataFrame) -> DataFrame:
    """The detections of a table or stream of customers."""
    return _boxes(_workers(customers))


def _workers(customers: DataFrame) -> DataFrame:
    return customers.select(F.col("c_custkey").cast("long").alias("w"), F.expr("c_custkey div 5").alias("camera_id"))


def _boxes(workers: DataFrame) -> DataFrame:
    e = F.expr
    frames = workers.select("w", "camera_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("k"))
    p = frames.select("w", "k", "camera_id", e("100+150*(w%5)+((w%7)-3)*k").alias("px"), e("200+((w*13)%80)").alias("py"), e("(w*5+k*3)%5").alias("j"))

    def part(where: str, offset: int, cls: str, *values: str) -> DataFrame:
        x1, y1, x2, y2, conf = (e(v) for v in values)
        return p.where(where).select("camera_id", "k", e(f"(w*40+k)*4+{offset}").alias("det_id"), e(cls).cast("int").alias("cls"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"), (conf.cast("double") / 100).alias("conf"))

    boxes = (
        part("(w*31+k*17)%23<>0", 0, "0", "px", "py", "px+60", "py+160", "CASE WHEN (w+k)%9=0 THEN 30 ELSE 50+(w*7+k*11)%50 END")
        .unionByName(part("(w*29+k*19)%31<>0", 1, "CASE WHEN w%4=0 AND k BETWEEN 10 AND 29 THEN 1 ELSE 2 END", "px+15+j", "py-5+j", "px+45+j", "py+30+j", "50+(w*3+k*7)%50"))
        .unionByName(part("NOT (w%6=1 AND k BETWEEN 5 AND 34)", 3, "3", "px+5-j", "py+45", "px+55-j", "py+110", "50+(w*11+k*5)%50"))
    )
    ts = F.timestamp_micros(F.lit(START_US) + F.col("k") * FRAME_US)
    return boxes.select(F.lit("fixture").alias("run"), "camera_id", F.col("k").alias("frame"), ts.alias("ts"), "det_id", "cls", "x1", "y1", "x2", "y2", "conf")


def true_tracks(dets: DataFrame) -> DataFrame:
    """Person boxes with the true worker as track."""
    return dets.where("cls = 0").withColumn("track_id", F.expr("det_id div 160"))


def linked_tracks(dets: DataFrame, **options) -> DataFrame:
    """Person boxes with tracks from linking."""
    persons = dets.where("cls = 0")
    return assign_tracks(persons, link_detections(persons, **options))


def status_of(dets: DataFrame, persons: DataFrame, mode: str = "one_to_one") -> DataFrame:
    """Frame status of tracked persons."""
    return frame_status(persons, associate(association_candidates(dets), mode))


def events_of(status: DataFrame, n: int = 5) -> DataFrame:
    """Events by the consecutive rule; rows are dealt by track (and block of frames) once for both types, before they are two."""
    states = cut(status.select(*TRACK, "frame", "ts", "det_id", "helmet_state", "vest_state"))
    # as rows shuffle to few bytes, partitions by their bytes would be too large to sort in memory
    parts = max(status.sparkSession.sparkContext.defaultParallelism, states.count() // STATES)
    return consecutive_events(violations(states.repartition(parts, *TRACK, F.floor(F.col("frame") / BLOCK))), n)
