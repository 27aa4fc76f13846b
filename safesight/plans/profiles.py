"""Profiles and ablation: how many stages run."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from safesight.lineage import cut, large
from safesight.operators.associate import associate, association_candidates, frame_status
from safesight.operators.temporal import rule_consecutive, rule_duration, violations
from safesight.operators.track import assign_tracks, link_detections
from safesight.plans.detections import events_of, linked_tracks, status_of
from safesight.schemas import HEAD, TRACK

ALERT = ["profile", "run", "camera_id", "track_id", "violation", "frame"]


def _alerts(df: DataFrame, profile: str) -> DataFrame:
    return df.withColumn("profile", F.lit(profile)).select(*ALERT)


def profile_a(dets: DataFrame) -> DataFrame:
    """Detector only: every bare head is an alert (its own id stands for the track)."""
    return _alerts(dets.where(F.col("cls") == HEAD).select("run", "camera_id", F.col("det_id").alias("track_id"), F.lit("NO_HELMET").alias("violation"), "frame"), "A_yolo")


def profile_b(dets: DataFrame) -> DataFrame:
    """Tracking: one alert per linked track of bare heads, at its first frame."""
    heads = dets.where(F.col("cls") == HEAD)
    tracks = assign_tracks(heads, link_detections(heads))
    return _alerts(tracks.groupBy("run", "camera_id", "track_id").agg(F.min("frame").alias("frame")).withColumn("violation", F.lit("NO_HELMET")), "B_tracking")


def profile_c(dets: DataFrame, persons: DataFrame | None = None, status: DataFrame | None = None) -> DataFrame:
    """Association: one alert per person track and type, at the first violating frame. status: the persons' states, if there already."""
    if status is None:
        status = status_of(dets, linked_tracks(dets) if persons is None else persons)
    return _alerts(violations(status).where("flag").groupBy("run", "camera_id", "track_id", "violation").agg(F.min("frame").alias("frame")), "C_association")


def profile_d(dets: DataFrame, persons: DataFrame | None = None, status: DataFrame | None = None) -> DataFrame:
    """Full system: one alert per event, when it is confirmed. status: as in profile_c()."""
    if status is None:
        status = status_of(dets, linked_tracks(dets) if persons is None else persons)
    return _alerts(events_of(status).withColumnRenamed("confirm_frame", "frame"), "D_full_system")


def compare_profiles(alerts: list[DataFrame], truth: DataFrame | None = None) -> DataFrame:
    """Alerts per camera and type, profiles side by side; truth (camera_id, violation, n) adds its column."""
    every = alerts[0]
    for a in alerts[1:]:
        every = every.unionByName(a)
    names = ["A_yolo", "B_tracking", "C_association", "D_full_system"]
    out = every.groupBy("camera_id", "violation").pivot("profile", names).count().na.fill(0, names)
    return out if truth is None else out.join(large(truth.withColumnRenamed("n", "truth")), ["camera_id", "violation"], "full").na.fill(0, [*names, "truth"])


def profile_accuracy(alerts: list[DataFrame], truth: DataFrame, slack: int = 10, bucket: int = 64) -> DataFrame:
    """Event accuracy per profile and type: alerts, those within a true event, events with an alert; precision, recall and mean delay of the first.

    truth: camera_id, violation, truth_id, start_frame, end_frame. An alert is right if its
    frame is in an event of its camera and type, or up to slack frames after it (a rule
    confirms late). Buckets of frames are equi keys, so a busy camera is no single task.
    """
    every = alerts[0]
    for a in alerts[1:]:
        every = every.unionByName(a)
    every = every.withColumn("alert", F.struct("track_id", "frame")).withColumn("bucket", F.floor(F.col("frame") / bucket))
    last = F.col("end_frame") + slack
    held = truth.select("camera_id", "violation", "truth_id", "start_frame", last.alias("last"), F.explode(F.sequence(F.floor(F.col("start_frame") / bucket), F.floor(last / bucket))).alias("bucket"))
    met = every.join(large(held), ["camera_id", "violation", "bucket"]).where(F.col("frame").between(F.col("start_frame"), F.col("last")))
    key = ["profile", "violation"]
    right = met.select(*key, "run", "camera_id", "alert").distinct().groupBy(*key).agg(F.count("*").alias("right"))
    first = met.groupBy(*key, "camera_id", "truth_id").agg(F.min(F.col("frame") - F.col("start_frame")).alias("delay"))
    found = first.groupBy(*key).agg(F.count("*").alias("found"), F.round(F.avg("delay"), 9).alias("mean_delay"))
    n = every.select(*key, "run", "camera_id", "alert").distinct().groupBy(*key).agg(F.count("*").alias("alerts"))
    out = n.join(truth.groupBy("violation").agg(F.count("*").alias("events")), "violation").join(right, key, "left").join(found, key, "left").na.fill(0, ["right", "found"])
    return out.select(*key, "alerts", "events", "right", "found", F.round(F.col("right") / F.col("alerts"), 9).alias("precision"), F.round(F.col("found") / F.col("events"), 9).alias("recall"), "mean_delay")


def ablate(dets: DataFrame, tracking: bool = True, association: bool = True, engine: bool = True, seconds: float = 1.0, linked: DataFrame | None = None) -> DataFrame:
    """The three switches and the time threshold, for helmets alone; linked: the person tracks, if there already."""
    if not association:
        alerts = profile_b(dets) if tracking else profile_a(dets)
        return alerts
    persons = (linked_tracks(dets) if linked is None else linked) if tracking else dets.where("cls = 0").withColumn("track_id", F.col("det_id"))
    return _judged(_helmets(dets, persons), engine, seconds)


def _helmets(dets: DataFrame, persons: DataFrame) -> DataFrame:
    """Whether helmets are missing, a row per track and frame, as a table: rules look at it more than once."""
    v = violations(frame_status(persons, associate(association_candidates(dets)))).where("violation = 'NO_HELMET'")
    return cut(v.select(*TRACK, "frame", "ts", "det_id", "violation", "flag"))


def _judged(v: DataFrame, engine: bool, seconds: float) -> DataFrame:
    """Alerts of violations: by the rule of duration, or the first of each track."""
    if engine:
        return _alerts(rule_duration(v, seconds).withColumnRenamed("confirm_frame", "frame"), "ablation")
    return _alerts(v.where("flag").groupBy("run", "camera_id", "track_id", "violation").agg(F.min("frame").alias("frame")), "ablation")


def ablation_table(dets: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Number of alerts under each of the eight settings of the switches, as ablate() gives them; persons are linked and associated once.

    Without tracking a person's box is its own track, so the same states serve; without
    association there is nothing for the engine to judge.
    """
    v = _helmets(dets, linked_tracks(dets))
    out = None
    for tracking, association in product((True, False), repeat=2):
        own = v if tracking else v.withColumn("track_id", F.col("det_id"))
        for engines in ((True,), (False,)) if association else ((True, False),):
            alerts = _judged(own, engines[0], seconds) if association else ablate(dets, tracking, association)
            engine = F.explode(F.array(*map(F.lit, engines))).alias("engine")
            row = alerts.agg(F.count("*").alias("alerts")).select(F.lit(tracking).alias("tracking"), F.lit(association).alias("association"), engine, "alerts")
            out = row if out is None else out.unionByName(row)
    return out


def confirmed(dets: DataFrame, persons: DataFrame, n: int = 5) -> DataFrame:
    """Rows at which the consecutive rule confirms."""
    return rule_consecutive(violations(status_of(dets, persons)), n)
