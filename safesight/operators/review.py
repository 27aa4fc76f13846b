"""Event queries, human review and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from safesight.lineage import large
from safesight.schemas import DECISIONS


def query_events(events: DataFrame, camera: int | None = None, track: int | None = None, violation: str | None = None, since: Column | None = None, until: Column | None = None, limit: int | None = None) -> DataFrame:
    """Filtered events, newest first; the limit is a top-k."""
    for column, value in (("camera_id", camera), ("track_id", track), ("violation", violation)):
        events = events if value is None else events.where(F.col(column) == value)
    events = events if since is None else events.where(F.col("start_ts") >= since)
    events = events if until is None else events.where(F.col("start_ts") < until)
    events = events.orderBy(F.desc("start_ts"), "event_id")
    return events if limit is None else events.limit(limit)


def event_detail(events: DataFrame, evidence: DataFrame, clips: DataFrame, tracks: DataFrame, reviews: DataFrame) -> DataFrame:
    """One nested row per event: evidence frames, clip, track and decisions."""
    shown = evidence.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rank", "frame", "det_id"))).alias("evidence"))
    clip = clips.select(F.explode("event_ids").alias("event_id"), F.struct("from_frame", "to_frame").alias("clip"))
    track = tracks.select("run", "camera_id", "track_id", F.struct("first_frame", "last_frame", "n_frames").alias("track"))
    decided = reviews.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("decided_at", "review_id", "decision"))).alias("reviews"))
    out = events
    for part, key in ((shown, ["event_id"]), (clip, ["event_id"]), (track, ["run", "camera_id", "track_id"]), (decided, ["event_id"])):
        out = out.join(large(part), key, "left")
    return out.select(*events.columns, "evidence", "clip", "track", "reviews")


def latest_decisions(reviews: DataFrame) -> DataFrame:
    """The decision in force per event: the latest, then the largest review_id."""
    last = F.max_by(F.struct("decision", "reviewer", "decided_at", "review_id"), F.struct("decided_at", "review_id"))
    return reviews.groupBy("event_id").agg(last.alias("r")).select("event_id", "r.*")


def review_queue(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Events without a decision or in need of review, oldest first."""
    decided = latest_decisions(reviews).select("event_id", "decision")
    return events.join(large(decided), "event_id", "left").where("decision is null or decision = 'NEEDS_REVIEW'").orderBy("start_ts", "event_id")


def record_decisions(reviews: DataFrame, new: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all decisions, rejected new rows): values outside the three and unknown events are rejected."""
    known = new.join(large(events.select("event_id").distinct().withColumn("known", F.lit(True))), "event_id", "left")
    sound = F.coalesce(F.col("known"), F.lit(False)) & F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False))
    return reviews.unionByName(known.where(sound).select(*reviews.columns)), known.where(~sound).select(*new.columns)


def confirmed_violations(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Events but for false alarms."""
    return events.join(large(latest_decisions(reviews).where("decision = 'FALSE_ALARM'")), "event_id", "left_anti")


def run_summary(events: DataFrame, status: DataFrame) -> DataFrame:
    """Per run: frames, tracks, events by type and the share of compliant rows."""
    frames = status.groupBy("run").agg(F.count_distinct("camera_id", "frame").alias("n_frames"), F.count_distinct("camera_id", "track_id").alias("n_tracks"), F.round(F.avg(((F.col("helmet_state") == "present") & (F.col("vest_state") == "present")).cast("double")), 9).alias("compliant"))
    kinds = events.groupBy("run").pivot("violation", ["NO_HELMET", "NO_VEST"]).count()
    return frames.join(kinds, "run", "left").na.fill(0, ["NO_HELMET", "NO_VEST"])


#: What a run is recorded with, besides its name.
FIELDS = ("manifest_sha256", "checkpoint_sha256", "config_sha256", "seed", "packages_sha256", "image_digest")


def run_registry(runs: DataFrame) -> DataFrame:
    """runs (run, config and other fields) with hashes of the configuration and, if there, of the package list (packages)."""
    out = runs.withColumn("config_sha256", F.sha2(F.to_json("config"), 256))
    return out.withColumn("packages_sha256", F.sha2(F.to_json(F.array_sort("packages")), 256)) if "packages" in runs.columns else out


def run_classes(registry: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Like runs as one row: the fields, first_run and n_runs."""
    return registry.groupBy(*fields).agg(F.min("run").alias("first_run"), F.count("*").alias("n_runs"))


def one_field_apart(registry: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Groups of runs that differ in one field only: field, value, first_run and n_runs of its class, n_values and n_group of its group.

    Each class of like runs gives a hash per field of all the others; classes that share
    one are a group. So one aggregation and one equi-join find them for all fields, and the
    result has a row per class and field, not per pair. Nulls are a value like others.
    """
    others = lambda f: F.sha2(F.concat(F.lit(f"{f} "), F.to_json(F.struct(*(g for g in fields if g != f)))), 256)
    own = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), others(f).alias("key")) for f in fields))
    keyed = run_classes(registry, fields).select("first_run", "n_runs", F.inline(own))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n_values"), F.sum("n_runs").alias("n_group")).where("n_values > 1")
    return keyed.join(groups, "key").select("field", "value", "first_run", "n_runs", "n_values", "n_group")


def runs_that_differ_in(runs: DataFrame, field: str, fields: list[str]) -> DataFrame:
    """Pairs of runs alike in every one of fields but the one named: all pairs, so for few runs (else see one_field_apart)."""
    same = [f for f in fields if f != field]
    other = runs.select(F.col("run").alias("other_run"), F.col(field).alias(f"other_{field}"), *same)
    return runs.select("run", field, *same).join(other, same).where((F.col("run") < F.col("other_run")) & ~F.col(field).eqNullSafe(F.col(f"other_{field}"))).select("run", "other_run", field, f"other_{field}")


def best_epochs(curve: DataFrame, metric: str) -> DataFrame:
    """The best epoch of each run by a metric, the earlier if tied."""
    return curve.groupBy("run").agg(F.max_by("epoch", F.struct(F.col(metric), -F.col("epoch"))).alias("best_epoch"), F.max(metric).alias(metric))
