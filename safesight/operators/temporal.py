"""Temporal rules and events: windows, gaps and islands."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from safesight.lineage import cut, large
from safesight.operators.segments import carried, spans
from safesight.schemas import TRACK

KEY = [*TRACK, "violation"]
BREAK = 5
#: Frames of a block, and how much wider each size of aligned ranges is.
BLOCK, FAN = 1 << 16, 8


def violations(status: DataFrame) -> DataFrame:
    """One row per track, frame and violation type with a flag; unknown states give no row."""
    long = status.select(*TRACK, "frame", "ts", "det_id", F.expr("stack(2, 'NO_HELMET', helmet_state, 'NO_VEST', vest_state) AS (violation, state)"))
    return long.where("state <> 'unknown'").select(*TRACK, "frame", "ts", "det_id", "violation", (F.col("state") == "missing").alias("flag"))


def _islands(v: DataFrame, max_gap: int) -> DataFrame:
    """Violating rows with their run's start_frame and start_ts, and their number in it.

    A run: no other observation, nor more than max_gap frames, in between. Runs are found
    in blocks of frames and go on over their edges, so a track with all rows is no single task.
    """
    rows = v.withColumn("block", F.floor(F.col("frame") / BLOCK))
    several = spans(rows, KEY)
    rows = carried(rows, KEY, "frame", "_prev", F.struct("frame", "flag"), "last", False, several)
    breaks = ~F.col("_prev.flag") | (F.col("frame") - F.col("_prev.frame") > max_gap)
    rows = rows.withColumn("_start", F.col("flag") & F.coalesce(breaks, F.lit(True))).drop("_prev")
    rows = carried(rows, KEY, "frame", "_n", F.col("flag").cast("long"), "sum", True, several)
    rows = carried(rows, KEY, "frame", "_from", F.when(F.col("_start"), F.struct("_n", "frame", "ts")), "last", True, several)
    return rows.where("flag").select(*v.columns, F.col("_from.frame").alias("start_frame"), F.col("_from.ts").alias("start_ts"), (F.col("_n") - F.col("_from._n") + 1).alias("nth"))


def rule_consecutive(v: DataFrame, n: int = 5, max_gap: int = BREAK) -> DataFrame:
    """Confirmed rows: the n-th violating observation in a row of each run."""
    return _islands(v, max_gap).where(F.col("nth") == n).select(*KEY, "start_frame", "start_ts", F.col("frame").alias("confirm_frame"), F.col("ts").alias("confirm_ts"))


def rule_majority(v: DataFrame, k: int = 10, ratio: float = 0.5) -> DataFrame:
    """Confirmed rows: those where over the last k observations the violating share is above ratio."""
    last = Window.partitionBy(*KEY).orderBy("frame").rowsBetween(-(k - 1), 0)
    judged = v.withColumn("share", F.avg(F.col("flag").cast("double")).over(last)).withColumn("seen", F.count("*").over(last))
    return judged.where((F.col("seen") == k) & (F.col("share") > ratio)).select(*KEY, "frame", "ts", F.round("share", 9).alias("share"))


def rule_duration(v: DataFrame, seconds: float = 1.0, max_gap: int = BREAK) -> DataFrame:
    """Confirmed rows: the first of each run at which it has lasted the given seconds."""
    lasted = (F.unix_micros("ts") - F.unix_micros("start_ts")) / 1e6
    late = _islands(v, max_gap).withColumn("seconds", lasted).where(F.col("seconds") >= seconds)
    first = late.groupBy(*KEY, "start_frame").agg(F.min(F.struct("frame", "seconds")).alias("first"))
    return first.select(*KEY, "start_frame", F.col("first.frame").alias("confirm_frame"), F.round("first.seconds", 6).alias("seconds"))


def build_events(v: DataFrame, confirmed: DataFrame, max_gap: int = BREAK, merge_gap: int = 10) -> DataFrame:
    """One row per event: confirmed runs of v, neighbours of a track closer than merge_gap frames merged.

    confirmed: rows of rule_consecutive() or rule_duration() of the same v and max_gap.
    """
    runs = _runs(_islands(v, max_gap)).join(large(confirmed.select(*KEY, "start_frame", "confirm_frame")), [*KEY, "start_frame"])
    return _merged(runs, merge_gap)


def consecutive_events(v: DataFrame, n: int = 5, max_gap: int = BREAK, merge_gap: int = 10) -> DataFrame:
    """build_events() of rule_consecutive(), from one search for runs."""
    confirm = F.min(F.when(F.col("nth") == n, F.col("frame"))).alias("confirm_frame")
    return _merged(_runs(_islands(v, max_gap), confirm).where("confirm_frame is not null"), merge_gap)


def _runs(islands: DataFrame, *more: Column) -> DataFrame:
    return islands.groupBy(*KEY, "start_frame").agg(F.max("frame").alias("end_frame"), F.min("start_ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_frames"), *more)


def _merged(runs: DataFrame, merge_gap: int) -> DataFrame:
    """Events of runs, in blocks as above."""
    runs = cut(runs.withColumn("block", F.floor(F.col("start_frame") / BLOCK)))
    several = spans(runs, KEY)
    runs = carried(runs, KEY, "start_frame", "_end", F.col("end_frame"), "max", False, several)
    far = F.coalesce(F.col("start_frame") - F.col("_end") >= merge_gap, F.lit(True))
    runs = carried(runs, KEY, "start_frame", "group", F.when(far, F.col("start_frame")), "last", True, several)
    events = runs.groupBy(*KEY, "group").agg(F.min("confirm_frame").alias("confirm_frame"), F.max("end_frame").alias("end_frame"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n_frames").alias("n_frames"))
    return events.withColumnRenamed("group", "start_frame").select(event_id().alias("event_id"), *KEY, "start_frame", "confirm_frame", "end_frame", "start_ts", "end_ts", "n_frames")


def event_id() -> Column:
    """A hash of what makes an event: its keys and first frame."""
    return F.sha2(F.concat_ws("|", "run", "camera_id", "track_id", "violation", "start_frame"), 256)


def select_evidence(events: DataFrame, status: DataFrame, k: int = 3) -> DataFrame:
    """The best k frames of each event: highest person confidence, then earliest.

    An event is cut into aligned ranges of 1, FAN, FAN^2, .. frames, some 2 FAN of each
    size at most, and a frame is looked up in the ranges of each size that holds it: an
    equi-join that forms no pair outside an event, however long a track is.
    """
    longest = events.agg(F.max(F.col("end_frame") - F.col("start_frame") + 1)).first()[0] or 1
    sizes = [1]
    while sizes[-1] * FAN <= longest:
        sizes.append(sizes[-1] * FAN)
    own = _ranges(events.select("event_id", *TRACK, F.col("start_frame").alias("a"), (F.col("end_frame") + 1).alias("b")), sizes)
    frames = status.select(*TRACK, "frame", "det_id", "conf", "x1", "y1", "x2", "y2").withColumn("size", F.explode(F.array(*(F.lit(s).cast("long") for s in sizes)))).withColumn("at", F.floor(F.col("frame") / F.col("size")))
    met = own.join(large(frames), [*TRACK, "size", "at"])
    best = Window.partitionBy("event_id").orderBy(F.desc("conf"), "frame")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("event_id", "rank", "frame", "det_id", "conf", "x1", "y1", "x2", "y2")


def _ranges(spans_: DataFrame, sizes: list[int]) -> DataFrame:
    """Aligned ranges (size, at) that make up [a, b): of each size those inside whose larger range is not."""
    parts = []
    for size, larger in zip(sizes, [*sizes[1:], None]):
        inside = lambda z: (F.ceil(F.col("a") / z), F.floor(F.col("b") / z))  # noqa: E731  first, and the one after the last
        run = lambda i, j: F.when(i < j, F.sequence(i, j - 1)).otherwise(F.array().cast("array<bigint>"))
        first, last = inside(size)
        if larger is None:
            at = run(first, last)
        else:
            up, down = inside(larger)
            at = F.when(up < down, F.concat(run(first, up * FAN), run(down * FAN, last))).otherwise(run(first, last))
        parts.append(F.transform(at, partial(_range, size)))
    return spans_.select("event_id", *TRACK, F.inline(F.concat(*parts)))


def _range(size: int, at: Column) -> Column:
    return F.struct(F.lit(size).cast("long").alias("size"), at.alias("at"))


def clip_ranges(events: DataFrame, before: int = 25, after: int = 25) -> DataFrame:
    """Frame ranges to cut per camera, overlapping or touching ones merged (in blocks, as a camera may have most events)."""
    camera = ["run", "camera_id"]
    padded = events.select(*camera, "event_id", F.greatest(F.lit(0), F.col("start_frame") - before).alias("from_frame"), (F.col("end_frame") + after).alias("to_frame"))
    # events of one first frame are one step of the order
    steps = padded.groupBy(*camera, "from_frame").agg(F.max("to_frame").alias("to_frame"))
    steps = cut(steps.withColumn("block", F.floor(F.col("from_frame") / BLOCK)))
    several = spans(steps, camera)
    steps = carried(steps, camera, "from_frame", "_end", F.col("to_frame"), "max", False, several)
    new = F.coalesce(F.col("from_frame") > F.col("_end") + 1, F.lit(True))
    steps = carried(steps, camera, "from_frame", "clip", F.when(new, F.col("from_frame")), "last", True, several)
    named = padded.join(large(steps.select(*camera, "from_frame", "clip")), [*camera, "from_frame"])
    return named.groupBy(*camera, "clip").agg(F.max("to_frame").alias("to_frame"), F.array_sort(F.collect_list("event_id")).alias("event_ids")).select(*camera, F.col("clip").alias("from_frame"), "to_frame", "event_ids")
