"""Registered stream queries over the events table: each runs a stream over the whole table and returns its output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from safesight.lineage import shared_dir
from safesight.plans.detections import from_customers
from safesight.plans import sql
from safesight.plans.sql import query
from safesight.registry import _SQL, register
from safesight.streaming import streams

#: The table spans months, so delays and windows are days here.
DELAY = "3 days"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: user_id, ts, id, flag."""
    path = f"{sf_dir}/events.parquet"
    # a pattern, as a stream can't have one file as its base path
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    return rows.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("event_type").isin("error", "click", "view").alias("flag"))


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def finished(df: DataFrame) -> DataFrame:
    """The output of a stream, by way of the shared folder."""
    root = folder(df.sparkSession)
    return streams.run_to_end(df, f"{root}/out", f"{root}/checkpoint")


#: Frames of a camera one after another; a frame's boxes against the live tracks, greedy in the order of (-IoU, box, track): first confident boxes, then others, which only extend.
TRACK_STREAM = """
fr AS (SELECT camera_id, frame, list({'d': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) FILTER (WHERE conf >= 0.5) AS sure, list({'d': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) FILTER (WHERE conf >= 0.1 AND conf < 0.5) AS weak
  FROM det WHERE cls = 0 GROUP BY ALL),
al AS (SELECT c.camera_id, f.frame, coalesce(fr.sure, []) AS sure, coalesce(fr.weak, []) AS weak FROM (SELECT DISTINCT camera_id FROM det) c CROSS JOIN (SELECT range AS frame FROM range(0, 40)) f LEFT JOIN fr ON fr.camera_id = c.camera_id AND fr.frame = f.frame),
st(camera_id, frame, live, made) AS (SELECT camera_id, -1::BIGINT, []::STRUCT(t BIGINT, f BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[], []::STRUCT(d BIGINT, t BIGINT)[] FROM (SELECT DISTINCT camera_id FROM det)
  UNION ALL
  SELECT camera_id, frame,
    list_concat(list_filter(live, lambda v: NOT list_contains(list_transform(made, lambda m: m.t), v.t)),
      list_transform(made, lambda m: {'t': m.t, 'f': frame, 'x1': list_filter(boxes, lambda b: b.d = m.d)[1].x1, 'y1': list_filter(boxes, lambda b: b.d = m.d)[1].y1, 'x2': list_filter(boxes, lambda b: b.d = m.d)[1].x2, 'y2': list_filter(boxes, lambda b: b.d = m.d)[1].y2})), made
  FROM (SELECT camera_id, frame, live, list_concat(sure, weak) AS boxes, list_concat(list_concat(m1, m2), list_transform(list_filter(sure, lambda b: NOT list_contains(list_transform(m1, lambda m: m.d), b.d)), lambda b: {'d': b.d, 't': b.d})) AS made
  FROM (SELECT *, %s AS m2
  FROM (SELECT *, list_filter(live, lambda v: NOT list_contains(list_transform(m1, lambda m: m.t), v.t)) AS free
  FROM (SELECT *, %s AS m1
  FROM (SELECT al.camera_id, al.frame, al.sure, al.weak, list_filter(st.live, lambda v: al.frame - v.f <= 30) AS live FROM st JOIN al ON al.camera_id = st.camera_id AND al.frame = st.frame + 1)))))),
out AS (SELECT 'fixture' AS run, camera_id, frame, unnest(made) AS m FROM st)"""


def _greedy(boxes: str, tracks: str) -> str:
    pairs = f"flatten(list_transform({boxes}, lambda b: list_transform({tracks}, lambda v: {{'o': -{sql.iou('v', 'b')}, 'd': b.d, 't': v.t}})))"
    best = f"list_sort(list_filter({pairs}, lambda p: p.o <= -0.3))"
    took = "list_contains(list_transform(acc, lambda m: m.d), p.d) OR list_contains(list_transform(acc, lambda m: m.t), p.t)"
    return f"list_reduce({best}, lambda acc, p: CASE WHEN {took} THEN acc ELSE list_append(acc, {{'d': p.d, 't': p.t}}) END, []::STRUCT(d BIGINT, t BIGINT)[])"


@register("k4_track_stream", query(sql.DET, TRACK_STREAM % (_greedy("weak", "free"), _greedy("sure", "live")), "SELECT run, camera_id, frame, m.d AS det_id, m.t AS track_id FROM out"))
def _(spark, sf_dir):
    path = f"{sf_dir}/customer.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/customer.parque[t]")
    persons = from_customers(rows).where("cls = 0")
    root = folder(spark)
    tracked = streams.track_stream(streams.closable(persons, f"{root}/closing"), delay="1 second")
    return streams.run_to_end(tracked, f"{root}/out", f"{root}/checkpoint", f"{root}/closing")


OBS = "obs AS (SELECT user_id, epoch_us(ts) AS us, event_id AS id, event_type IN ('error', 'click', 'view') AS flag FROM events), wm AS (SELECT (max(us) // 1000 - 259200000) * 1000 AS w FROM obs)"


@register("r1_stream_consecutive", f"""WITH {OBS},
b AS (SELECT *, sum((NOT flag)::INT) OVER (PARTITION BY user_id ORDER BY us, id) AS g FROM obs),
r AS (SELECT *, row_number() OVER w AS nth, first_value(us) OVER w AS s FROM b WHERE flag WINDOW w AS (PARTITION BY user_id, g ORDER BY us, id))
SELECT user_id AS k0, s AS start_us, us AS confirm_us FROM r, wm WHERE nth = 5 AND us < w""")
def _(spark, sf_dir):
    return finished(streams.stream_consecutive(observations(spark, sf_dir), ["user_id"], 5, DELAY, step_seconds=30 * 86_400))


@register("r2_stream_majority", f"""WITH {OBS},
x AS (SELECT user_id, flag, k * 432000000000 AS s FROM obs, LATERAL (SELECT unnest([us // 432000000000, us // 432000000000 - 1]) AS k)),
g AS (SELECT user_id, s, avg(flag::INT) AS share, count(*) AS n FROM x GROUP BY ALL)
SELECT s AS window_start, s + 864000000000 AS window_end, user_id, round(share, 9) AS share, n FROM g, wm WHERE share > 0.5 AND s + 864000000000 <= w""")
def _(spark, sf_dir):
    return finished(streams.stream_majority(observations(spark, sf_dir), ["user_id"], "10 days", "5 days", 0.5, DELAY))


@register("r3_stream_events", f"""WITH {OBS},
a AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, id) AS d FROM obs WHERE flag),
b AS (SELECT *, sum(CASE WHEN d < 172800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, id) AS g FROM a),
c AS (SELECT user_id, g, min(us) AS s, max(us) + 172800000000 AS e, count(*) AS n FROM b GROUP BY ALL)
SELECT s AS start_ts, e AS end_ts, user_id, n FROM c, wm WHERE e <= w""")
def _(spark, sf_dir):
    return finished(streams.stream_events(observations(spark, sf_dir), ["user_id"], "2 days", DELAY))


@register("r4_dedup_stream", "SELECT event_id AS id, user_id FROM events")
def _(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return finished(streams.dedup_stream(obs.unionByName(obs), "id", DELAY)).select("id", "user_id")


@register("r5_stream_stats", f"""WITH {OBS}
SELECT us // 86400000000 * 86400000000 AS window_start, user_id, count(*) AS n, sum(flag::INT)::BIGINT AS n_violations FROM obs, wm WHERE us // 86400000000 * 86400000000 + 86400000000 <= w GROUP BY ALL""")
def _(spark, sf_dir):
    return finished(streams.stream_stats(observations(spark, sf_dir), "1 day", DELAY, "user_id"))


@register("r6_late_rows", """WITH o AS (SELECT epoch_us(ts) AS us, event_type <> 'error' AS early FROM events), w AS (SELECT (max(us) // 1000 - 259200000) * 1000 AS w FROM o WHERE early)
SELECT count(*) AS n_input, coalesce(sum((NOT early AND us <= w)::INT), 0)::BIGINT AS n_late, coalesce(sum((early OR us > w)::INT), 0)::BIGINT AS n_kept FROM o, w""")
def _(spark, sf_dir):
    """Errors arrive after all other events; those behind the watermark are dropped, and counted."""
    root = folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(streams.made(spark, f"{root}/in"))
    progress = streams.Progress()
    spark.streams.addListener(progress)
    try:
        for name, part in (("a", rows.where("event_type <> 'error'")), ("b", rows.where("event_type = 'error'"))):
            part.write.parquet(f"{root}/in/{name}")
            kept = streams.run_to_end(streams.dedup_stream(source, "event_id", DELAY), f"{root}/out", f"{root}/checkpoint")
        seen = progress.append_to(spark, f"{root}/progress", ended=2)
    finally:
        spark.streams.removeListener(progress)
    return seen.agg(F.sum("n_input").alias("n_input"), F.sum("n_late").alias("n_late")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("n_kept"))))


@register("r7_event_sink", _SQL["r3_stream_events"])
def _(spark, sf_dir):
    """Sessions by way of the sink that a batch can be given to twice."""
    root = folder(spark)
    sessions = streams.stream_events(observations(spark, sf_dir), ["user_id"], "2 days", DELAY)
    streams.start_event_sink(sessions, f"{root}/events", f"{root}/checkpoint").awaitTermination()
    return streams.read_event_sink(spark, f"{root}/events", sessions.schema)
