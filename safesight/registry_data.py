"""Registered queries: dataset preparation, review, profiles and evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from safesight.lineage import cut
from safesight.operators import dataset, evaluate, review, temporal, track
from safesight.plans import detections as plan
from safesight.plans import profiles, sql
from safesight.plans.detections import table
from safesight.plans.sql import query
from safesight.registry import TILED, _status, _tiled, register
from safesight.schemas import TRACK

# dataset preparation: files from documents, labels and images from detections


def files(spark, sf_dir):
    """Files with hashes; the split follows the id."""
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test")
    return table(spark, sf_dir, "documents").select(F.format_string("img/%d.jpg", "doc_id").alias("path"), F.col("doc_id").alias("image_id"), split.alias("split"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


FILES = """fil AS (SELECT 'img/' || doc_id || '.jpg' AS path, doc_id AS image_id, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents)"""
GROUPS = """grp AS (SELECT sha256, min(image_id) AS group_id, count(*) AS n, list_sort(list(DISTINCT split)) AS splits FROM fil GROUP BY sha256 HAVING count(*) > 1)"""


def boxes(spark, sf_dir):
    """Boxes of a frame as boxes of an image of 1000 x 500."""
    image = F.col("camera_id") * 40 + F.col("frame")
    return plan.detections(spark, sf_dir).select(_split(image).alias("split"), image.alias("image_id"), F.col("det_id").alias("box_id"), "cls", "x1", "y1", "x2", "y2", F.lit(1000).alias("width"), F.lit(500).alias("height"))


def _split(image):
    return F.when(image % 10 < 8, "train").when(image % 10 == 8, "val").otherwise("test")


def labels(spark, sf_dir):
    """Normalised labels with some bad lines and repeated boxes."""
    c = dataset.voc_to_yolo(boxes(spark, sf_dir), (0, 1, 2, 3)).select("split", "image_id", "cls", "cx", "cy", "w", "h", "box_id")
    bad = F.col("box_id") % 101 == 0
    marked = c.select("split", "image_id", *(F.when(~bad, F.col(x)).alias(x) for x in ("cls", "cx", "cy", "w", "h")), F.when(bad, F.lit("bad")).alias("error"), "box_id")
    return marked.unionByName(marked.where("box_id % 203 = 0 and error is null")).drop("box_id")


def images(spark, sf_dir):
    """Images: some without labels, and some labels without one."""
    known = boxes(spark, sf_dir).select("split", "image_id").distinct().where("image_id % 50 <> 0")
    return known.unionByName(known.where("image_id % 97 = 1").select("split", (F.col("image_id") + 1_000_000_000).alias("image_id")))


BOXES = """box AS (SELECT CASE WHEN (camera_id*40+frame) % 10 < 8 THEN 'train' WHEN (camera_id*40+frame) % 10 = 8 THEN 'val' ELSE 'test' END AS split, camera_id*40+frame AS image_id, det_id AS box_id, cls, x1, y1, x2, y2 FROM det)"""
LABELS = """
yol AS (SELECT split, image_id, box_id, cls, (x1+x2)/2/1000 AS cx, (y1+y2)/2/500 AS cy, (x2-x1)/1000 AS w, (y2-y1)/500 AS h FROM box),
la0 AS (SELECT *, CASE WHEN box_id % 101 = 0 THEN 'bad' END AS error FROM yol),
lab AS (SELECT * FROM la0 UNION ALL SELECT * FROM la0 WHERE box_id % 203 = 0 AND error IS NULL),
im0 AS (SELECT DISTINCT split, image_id FROM box WHERE image_id % 50 <> 0),
img AS (SELECT * FROM im0 UNION ALL SELECT split, image_id + 1000000000 FROM im0 WHERE image_id % 97 = 1)"""
FINDINGS = """
fnd AS (
  SELECT split, image_id, 'bad_line' AS finding, count(*) AS n FROM lab WHERE error IS NOT NULL GROUP BY ALL
  UNION ALL SELECT split, image_id, 'box_outside_image', count(*) FROM lab WHERE error IS NULL AND (cx-w/2 < -1e-9 OR cx+w/2 > 1+1e-9 OR cy-h/2 < -1e-9 OR cy+h/2 > 1+1e-9) GROUP BY ALL
  UNION ALL SELECT split, image_id, 'duplicate_box', sum(k)::BIGINT FROM (SELECT split, image_id, count(*) - 1 AS k FROM lab WHERE error IS NULL GROUP BY split, image_id, cls, cx, cy, w, h) WHERE k > 0 GROUP BY ALL
  UNION ALL SELECT split, image_id, 'image_without_label', 1 FROM img i WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE l.split = i.split AND l.image_id = i.image_id)
  UNION ALL SELECT DISTINCT split, image_id, 'label_without_image', 1 FROM lab l WHERE NOT EXISTS (SELECT 1 FROM img i WHERE l.split = i.split AND l.image_id = i.image_id))"""


@register("d1_remap_classes", "SELECT event_type AS name, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 END AS cls, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf_dir):
    named = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"))
    mapped, rest = dataset.remap_classes(named, {"view": 0, "click": 1, "purchase": 2, "signup": 3})
    return mapped.groupBy("name", "cls").agg(F.count("*").alias("n")).unionByName(rest.select("name", F.lit(None).cast("int").alias("cls"), F.col("count").alias("n")))


@register("d2_voc_to_yolo", query(sql.DET, BOXES, LABELS, "SELECT split, image_id, box_id, cls, round(cx, 9) AS cx, round(cy, 9) AS cy, round(w, 9) AS w, round(h, 9) AS h FROM yol WHERE cls IN (0, 1, 2)"))
def _(spark, sf_dir):
    return dataset.voc_to_yolo(boxes(spark, sf_dir)).select("split", "image_id", "box_id", "cls", *(F.round(c, 9).alias(c) for c in ("cx", "cy", "w", "h")))


@register("d3_merge_sources", query(sql.DET, BOXES, "SELECT CASE WHEN image_id % 2 = 0 THEN 'chvg' ELSE 'shel5k' END AS source, split, cls, count(*) AS n FROM box GROUP BY ALL"))
def _(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return dataset.merge_sources(chvg=b.where("image_id % 2 = 0"), shel5k=b.where("image_id % 2 = 1")).groupBy("source", "split", "cls").agg(F.count("*").alias("n"))


@register("d4_audit_labels", query(sql.DET, BOXES, LABELS, FINDINGS, "SELECT * FROM fnd"))
def _(spark, sf_dir):
    return dataset.audit_labels(labels(spark, sf_dir), images(spark, sf_dir))


@register("d5_audit_summary", query(sql.DET, BOXES, LABELS, FINDINGS, "SELECT split, finding, sum(n)::BIGINT AS n, count(*) AS images FROM fnd GROUP BY ROLLUP (split, finding)"))
def _(spark, sf_dir):
    return dataset.audit_summary(dataset.audit_labels(labels(spark, sf_dir), images(spark, sf_dir)))


@register("d6_audit_duplicates", query(FILES, GROUPS, "SELECT * FROM grp"))
def _(spark, sf_dir):
    return dataset.audit_duplicates(files(spark, sf_dir))


@register("d7_find_split_leakage", query(FILES, GROUPS, "SELECT * FROM grp WHERE len(splits) > 1"))
def _(spark, sf_dir):
    return dataset.find_split_leakage(files(spark, sf_dir))


@register("d8_repair_splits", query(FILES, """SELECT f.path, f.image_id, f.bytes, f.sha256,
  CASE WHEN bool_or(split = 'test') OVER w THEN 'test' WHEN bool_or(split = 'val') OVER w THEN 'val' ELSE 'train' END AS split FROM fil f WINDOW w AS (PARTITION BY sha256)"""))
def _(spark, sf_dir):
    return dataset.repair_splits(files(spark, sf_dir))


@register("d9_check_split_counts", query(FILES, "SELECT split, count(DISTINCT image_id) AS n, 100::BIGINT AS expected, count(DISTINCT image_id) = 100 AS ok FROM fil GROUP BY split"))
def _(spark, sf_dir):
    return dataset.check_split_counts(files(spark, sf_dir), {"train": 100, "val": 100, "test": 100})


MANIFEST = "man AS (SELECT path, CASE WHEN image_id % 11 = 0 THEN 'old' ELSE sha256 END AS sha256 FROM fil WHERE image_id % 7 <> 0 UNION ALL SELECT 'gone/' || image_id, sha256 FROM fil WHERE image_id % 13 = 0)"
DIFF = "dif AS (SELECT coalesce(f.path, m.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra' ELSE 'changed' END AS state FROM fil f FULL JOIN man m ON f.path = m.path WHERE f.path IS NULL OR m.path IS NULL OR f.sha256 <> m.sha256)"


def manifest(spark, sf_dir):
    """An older listing of the files."""
    f = files(spark, sf_dir)
    return f.where("image_id % 7 <> 0").select("path", F.when(F.col("image_id") % 11 == 0, "old").otherwise(F.col("sha256")).alias("sha256")).unionByName(f.where("image_id % 13 = 0").select(F.concat(F.lit("gone/"), F.col("image_id").cast("string")).alias("path"), "sha256"))


@register("d10_validate_dataset", query(sql.DET, BOXES, LABELS, FINDINGS, FILES, MANIFEST, DIFF, """
SELECT 'classes' AS "check", n = 0 AS ok, n || ' findings' AS detail FROM (SELECT count(*) AS n FROM fnd WHERE finding = 'class_out_of_range')
UNION ALL SELECT 'labels', n = 0, n || ' findings' FROM (SELECT coalesce(sum(n), 0)::BIGINT AS n FROM fnd WHERE finding IN ('bad_line', 'box_outside_image', 'duplicate_box'))
UNION ALL SELECT 'pairs', n = 0, n || ' findings' FROM (SELECT coalesce(sum(n), 0)::BIGINT AS n FROM fnd WHERE finding LIKE '%without%')
UNION ALL SELECT 'split_counts', n = 0, n || ' findings' FROM (SELECT count(*) AS n FROM (SELECT split, count(DISTINCT image_id) AS k FROM img GROUP BY split) WHERE k <> 10)
UNION ALL SELECT 'manifest', n = 0, n || ' findings' FROM (SELECT count(*) AS n FROM dif)"""))
def _(spark, sf_dir):
    return dataset.validate_dataset(labels(spark, sf_dir), images(spark, sf_dir), {"train": 10, "val": 10, "test": 10}, manifest(spark, sf_dir), files(spark, sf_dir))


@register("d11_diff_manifest", query(FILES, MANIFEST, DIFF, "SELECT * FROM dif"))
def _(spark, sf_dir):
    return dataset.diff_manifest(files(spark, sf_dir), manifest(spark, sf_dir))


@register("d12_augment_boxes", query(sql.DET, BOXES, LABELS, """
SELECT split, image_id::VARCHAR AS image_id, box_id, cls, round(cx, 9) AS cx, round(cy, 9) AS cy, NULL AS transform FROM yol
UNION ALL SELECT split, image_id || '_' || t, box_id, cls, round(CASE WHEN t <> 'vflip' THEN 1-cx ELSE cx END, 9), round(CASE WHEN t <> 'hflip' THEN 1-cy ELSE cy END, 9), t FROM yol, (VALUES ('hflip'), ('vflip'), ('rot180')) v(t) WHERE split = 'train'"""))
def _(spark, sf_dir):
    c = dataset.voc_to_yolo(boxes(spark, sf_dir), (0, 1, 2, 3))
    return dataset.augment_boxes(c).select("split", "image_id", "box_id", "cls", F.round("cx", 9).alias("cx"), F.round("cy", 9).alias("cy"), "transform")


@register("d13_vest_candidates", query(sql.DET, BOXES, f"""SELECT split, image_id, box_id, area, rank FROM (SELECT split, image_id, box_id, (x2-x1)*(y2-y1) AS area, row_number() OVER (PARTITION BY split ORDER BY (x2-x1)*(y2-y1) DESC, image_id, box_id)::INT AS rank
  FROM box p WHERE cls = 0 AND NOT EXISTS (SELECT 1 FROM box v WHERE v.cls = 3 AND v.image_id = p.image_id AND {sql.inter("v", "p")} / ((v.x2-v.x1)*(v.y2-v.y1)) >= 0.5)) WHERE rank <= 100"""))
def _(spark, sf_dir):
    return dataset.vest_candidates(boxes(spark, sf_dir))


MODELS = """
m1 AS (SELECT * FROM box WHERE box_id % 5 <> 0),
m2 AS (SELECT split, image_id, box_id + 500000000 AS box_id, cls, x1 + box_id % 9 AS x1, y1 + box_id % 7 AS y1, x2 + box_id % 9 AS x2, y2 + box_id % 7 AS y2 FROM box WHERE box_id % 3 <> 0)"""


def _models(spark, sf_dir):
    b = boxes(spark, sf_dir)
    shift = {"x1": "x1 + box_id % 9", "x2": "x2 + box_id % 9", "y1": "y1 + box_id % 7", "y2": "y2 + box_id % 7", "box_id": "box_id + 500000000"}
    return b.where("box_id % 5 <> 0"), b.where("box_id % 3 <> 0").withColumns({c: F.expr(e) for c, e in shift.items()})


@register("d14_propose_dual", query(sql.DET, BOXES, MODELS, f"""
pa AS (SELECT a.image_id, a.cls, a.box_id AS box_1, b.box_id AS box_2, round({sql.iou("a", "b")}, 9) AS iou FROM m1 a JOIN m2 b ON a.image_id = b.image_id AND a.cls = b.cls),
du AS (SELECT * EXCLUDE (r1, r2) FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls, box_1 ORDER BY iou DESC, box_2) AS r1, row_number() OVER (PARTITION BY image_id, cls, box_2 ORDER BY iou DESC, box_1) AS r2 FROM pa WHERE iou >= 0.5) WHERE r1 = 1 AND r2 = 1)""", """
SELECT image_id, cls, box_1, box_2, iou, 'dual' AS kind FROM du
UNION ALL SELECT image_id, cls, box_id, NULL, NULL, 'single' FROM m1 WHERE box_id NOT IN (SELECT box_1 FROM du)
UNION ALL SELECT image_id, cls, NULL, box_id, NULL, 'single' FROM m2 WHERE box_id NOT IN (SELECT box_2 FROM du)"""))
def _(spark, sf_dir):
    return dataset.propose_dual(*_models(spark, sf_dir))


@register("d15_apply_reviewed_boxes", query(sql.DET, BOXES, """
ol AS (SELECT split, image_id, cls, (x1+x2)/2/1000 AS cx, (y1+y2)/2/500 AS cy, (x2-x1)/1000 AS w, (y2-y1)/500 AS h FROM box WHERE NOT (cls = 3 AND box_id % 4 = 3 AND image_id % 2 = 0)),
ac AS (SELECT DISTINCT split, image_id, (x1+x2)/2/1000 AS cx, (y1+y2)/2/500 AS cy, (x2-x1)/1000 AS w, (y2-y1)/500 AS h FROM box WHERE cls = 3),
na AS (SELECT *, cx-w/2 AS x1, cx+w/2 AS x2, cy-h/2 AS y1, cy+h/2 AS y2 FROM ac), nb AS (SELECT *, cx-w/2 AS x1, cx+w/2 AS x2, cy-h/2 AS y1, cy+h/2 AS y2 FROM ol WHERE cls = 3)""", f"""
SELECT split, image_id, cls, count(*) AS n, round(sum(cx), 6) AS cx FROM (SELECT split, image_id, cls, cx FROM ol
  UNION ALL SELECT split, image_id, 3, cx FROM na WHERE NOT EXISTS (SELECT 1 FROM nb WHERE nb.image_id = na.image_id AND {sql.iou("na", "nb")} > 0.5)) GROUP BY ALL"""))
def _(spark, sf_dir):
    c = dataset.voc_to_yolo(boxes(spark, sf_dir), (0, 1, 2, 3)).select("split", "image_id", "cls", "cx", "cy", "w", "h", "box_id")
    old = c.where("not (cls = 3 and box_id % 4 = 3 and image_id % 2 = 0)").drop("box_id")
    new = dataset.apply_reviewed_boxes(old, c.where("cls = 3").select("split", "image_id", "cx", "cy", "w", "h"))
    return new.groupBy("split", "image_id", "cls").agg(F.count("*").alias("n"), F.round(F.sum("cx"), 6).alias("cx"))


@register("d16_sample_preview", query(sql.DET, BOXES, "SELECT * FROM (SELECT split, cls, image_id, row_number() OVER (PARTITION BY split, cls ORDER BY md5('7|' || image_id), image_id)::INT AS rank FROM (SELECT DISTINCT split, cls, image_id FROM box)) WHERE rank <= 5"))
def _(spark, sf_dir):
    return dataset.sample_preview(boxes(spark, sf_dir), 5, 7)


# review

REVIEWS = """rev AS (SELECT track_id * 4 + k AS review_id, event_id, d AS decision, 'r' || k AS reviewer, start_ts + k * 60000000 AS decided_at FROM (
  SELECT *, 0 AS k, ['CONFIRMED_VIOLATION', 'FALSE_ALARM', 'NEEDS_REVIEW'][track_id % 4 + 1] AS d FROM evt WHERE track_id % 4 < 3
  UNION ALL SELECT *, 1, 'CONFIRMED_VIOLATION' FROM evt WHERE track_id % 8 = 1))"""
LATEST = "lat AS (SELECT event_id, arg_max(decision, {'a': decided_at, 'b': review_id}) AS decision, arg_max(reviewer, {'a': decided_at, 'b': review_id}) AS reviewer, max(decided_at) AS decided_at, arg_max(review_id, {'a': decided_at, 'b': review_id}) AS review_id FROM rev GROUP BY event_id)"


def _events(spark, sf_dir):
    return plan.events_of(_status(spark, sf_dir))


def reviews(events):
    """Decisions on three quarters of the events, some of them revised."""
    first = events.where("track_id % 4 < 3").withColumn("k", F.lit(0)).withColumn("decision", F.expr("element_at(array('CONFIRMED_VIOLATION', 'FALSE_ALARM', 'NEEDS_REVIEW'), cast(track_id % 4 + 1 as int))"))
    later = events.where("track_id % 8 = 1").withColumn("k", F.lit(1)).withColumn("decision", F.lit("CONFIRMED_VIOLATION"))
    return first.unionByName(later).select((F.col("track_id") * 4 + F.col("k")).alias("review_id"), "event_id", "decision", F.concat(F.lit("r"), F.col("k").cast("string")).alias("reviewer"), F.timestamp_micros(F.unix_micros("start_ts") + F.col("k") * 60_000_000).alias("decided_at"))


@register("q1_query_events", query(*sql.TRUE_EVENTS, "SELECT event_id, camera_id, track_id, start_ts FROM evt WHERE violation = 'NO_HELMET' ORDER BY start_ts DESC, event_id LIMIT 50"))
def _(spark, sf_dir):
    return review.query_events(_events(spark, sf_dir), violation="NO_HELMET", limit=50).select("event_id", "camera_id", "track_id", "start_ts")


@register("q2_event_detail", query(*sql.TRUE_EVENTS, sql.EVIDENCE, sql.CLIPS, REVIEWS, """
tr AS (SELECT run, camera_id, track_id, min(frame) AS f, max(frame) AS l, count(*) AS n FROM trk GROUP BY ALL)""", """
SELECT e.event_id, len((SELECT list(rank) FROM evi v WHERE v.event_id = e.event_id)) AS n_evidence, (SELECT min(det_id) FROM evi v WHERE v.event_id = e.event_id AND rank = 1) AS best,
  c.from_frame, c.to_frame, tr.n AS track_frames, (SELECT count(*) FROM rev r WHERE r.event_id = e.event_id) AS n_reviews
FROM evt e JOIN clp c ON list_contains(c.event_ids, e.event_id) JOIN tr ON tr.run = e.run AND tr.camera_id = e.camera_id AND tr.track_id = e.track_id"""))
def _(spark, sf_dir):
    status = _status(spark, sf_dir)
    events = plan.events_of(status)
    tracks = track.track_summary(plan.true_tracks(plan.detections(spark, sf_dir)))
    d = review.event_detail(events, temporal.select_evidence(events, status), temporal.clip_ranges(events), tracks, reviews(events))
    return d.select("event_id", F.size("evidence").cast("long").alias("n_evidence"), F.col("evidence")[0]["det_id"].alias("best"), "clip.from_frame", "clip.to_frame", F.col("track.n_frames").alias("track_frames"), F.coalesce(F.size("reviews"), F.lit(0)).cast("long").alias("n_reviews"))


@register("q3_latest_decisions", query(*sql.TRUE_EVENTS, REVIEWS, LATEST, "SELECT * FROM lat"))
def _(spark, sf_dir):
    return review.latest_decisions(reviews(_events(spark, sf_dir)))


@register("q4_review_queue", query(*sql.TRUE_EVENTS, REVIEWS, LATEST, "SELECT e.event_id, l.decision FROM evt e LEFT JOIN lat l USING (event_id) WHERE l.decision IS NULL OR l.decision = 'NEEDS_REVIEW'"))
def _(spark, sf_dir):
    events = _events(spark, sf_dir)
    return review.review_queue(events, reviews(events)).select("event_id", "decision")


@register("q5_record_decisions", query(*sql.TRUE_EVENTS, REVIEWS, """
SELECT review_id, event_id, decision, 'kept' AS state FROM rev
UNION ALL SELECT track_id * 4 + 2, CASE WHEN track_id % 5 = 0 THEN 'none' ELSE event_id END, CASE WHEN track_id % 3 = 0 THEN 'MAYBE' ELSE 'FALSE_ALARM' END, CASE WHEN track_id % 5 = 0 OR track_id % 3 = 0 THEN 'rejected' ELSE 'kept' END FROM evt"""))
def _(spark, sf_dir):
    events = _events(spark, sf_dir)
    new = events.select((F.col("track_id") * 4 + 2).alias("review_id"), F.when(F.col("track_id") % 5 == 0, "none").otherwise(F.col("event_id")).alias("event_id"), F.when(F.col("track_id") % 3 == 0, "MAYBE").otherwise("FALSE_ALARM").alias("decision"), F.lit("r2").alias("reviewer"), F.col("start_ts").alias("decided_at"))
    kept, rejected = review.record_decisions(reviews(events), new, events)
    named = lambda d, s: d.select("review_id", "event_id", "decision", F.lit(s).alias("state"))
    return named(kept, "kept").unionByName(named(rejected, "rejected"))


@register("q6_confirmed_violations", query(*sql.TRUE_EVENTS, REVIEWS, LATEST, "SELECT event_id, camera_id, track_id, violation FROM evt WHERE event_id NOT IN (SELECT event_id FROM lat WHERE decision = 'FALSE_ALARM')"))
def _(spark, sf_dir):
    events = _events(spark, sf_dir)
    return review.confirmed_violations(events, reviews(events)).select("event_id", "camera_id", "track_id", "violation")


@register("q7_run_summary", query(*sql.TRUE_EVENTS, """
SELECT run, count(DISTINCT (camera_id, frame)) AS n_frames, count(DISTINCT (camera_id, track_id)) AS n_tracks, round(avg((helmet_state = 'present' AND vest_state = 'present')::INT), 9) AS compliant,
  (SELECT count(*) FROM evt WHERE violation = 'NO_HELMET') AS "NO_HELMET", (SELECT count(*) FROM evt WHERE violation = 'NO_VEST') AS "NO_VEST" FROM sta GROUP BY run"""))
def _(spark, sf_dir):
    status = _status(spark, sf_dir)
    return review.run_summary(plan.events_of(status), status)


@register("q8_run_registry", """
WITH r AS (SELECT o_orderkey AS run, o_orderstatus AS status, o_orderpriority AS priority, o_custkey AS customer FROM orders)
SELECT a.run, b.run AS other_run, a.status, b.status AS other_status FROM r a JOIN r b ON a.priority = b.priority AND a.customer = b.customer WHERE a.run < b.run AND a.status <> b.status""")
def _(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"), F.struct("o_orderstatus", "o_orderpriority").alias("config"))
    return review.runs_that_differ_in(review.run_registry(runs), "status", ["status", "priority", "customer"])


REGISTRY = """reg AS (SELECT o_orderkey AS run, sha256(o_orderpriority) AS manifest_sha256, sha256(o_orderstatus) AS checkpoint_sha256, sha256('{"rate":' || o_custkey % 5 || ',"batch":' || o_custkey % 2 || '}') AS config_sha256, o_custkey % 7 AS seed,
  sha256('["p' || o_custkey % 3 || '","q1"]') AS packages_sha256, CASE WHEN o_custkey % 11 <> 0 THEN 'img' || o_custkey % 3 END AS image_digest FROM orders),
cls AS (SELECT manifest_sha256, checkpoint_sha256, config_sha256, seed, packages_sha256, image_digest, min(run) AS first_run, count(*) AS n_runs FROM reg GROUP BY ALL)"""


def _apart(field):
    others = ", ".join(f for f in review.FIELDS if f != field)
    return f"SELECT '{field}' AS field, {field}::VARCHAR AS value, first_run, n_runs, count(*) OVER w AS n_values, sum(n_runs) OVER w::BIGINT AS n_group FROM cls WINDOW w AS (PARTITION BY {others})"


@register("q8_one_field_apart", query(REGISTRY, f"SELECT * FROM ({' UNION ALL '.join(_apart(f) for f in review.FIELDS)}) WHERE n_values > 1".replace("sum(n_runs) OVER w::BIGINT", "(sum(n_runs) OVER w)::BIGINT")))
def _(spark, sf_dir):
    """Runs recorded with manifest, checkpoint, configuration, seed, packages and image."""
    c = F.col("o_custkey")
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run"), F.sha2("o_orderpriority", 256).alias("manifest_sha256"), F.sha2("o_orderstatus", 256).alias("checkpoint_sha256"), F.struct((c % 5).alias("rate"), (c % 2).alias("batch")).alias("config"),
        (c % 7).alias("seed"), F.array(F.lit("q1"), F.concat(F.lit("p"), (c % 3).cast("string"))).alias("packages"), F.when(c % 11 != 0, F.concat(F.lit("img"), (c % 3).cast("string"))).alias("image_digest"),
    )
    return review.one_field_apart(review.run_registry(runs))


# profiles

HEAD_LINKS, HEAD_TRACKS = (s.replace("cls = 0", "cls = 1") for s in (sql.LINKS, sql.TRACKS))
# the same beside the tables of persons
H_TRACKS = re.sub(r"\b(seen|sure|l[123]m?|l12|[es][23]|lnk|chain|trk)\b", r"h_\1", HEAD_LINKS + "," + HEAD_TRACKS)
A = "SELECT 'A_yolo' AS profile, run, camera_id, det_id AS track_id, 'NO_HELMET' AS violation, frame FROM det WHERE cls = 1"
B = "SELECT 'B_tracking' AS profile, run, camera_id, track_id, 'NO_HELMET' AS violation, min(frame) AS frame FROM trk GROUP BY ALL"
C = "SELECT 'C_association' AS profile, run, camera_id, track_id, violation, min(frame) AS frame FROM vio WHERE flag GROUP BY ALL"
D = "SELECT 'D_full_system' AS profile, run, camera_id, track_id, violation, confirm_frame AS frame FROM evt"


@register("p1_profile_a", query(sql.DET, A))
def _(spark, sf_dir):
    return profiles.profile_a(plan.detections(spark, sf_dir))


@register("p2_profile_b", query(sql.DET, HEAD_LINKS, HEAD_TRACKS, B))
def _(spark, sf_dir):
    return profiles.profile_b(plan.detections(spark, sf_dir))


@register("p3_profile_c", query(*sql.LINKED_EVENTS, C))
def _(spark, sf_dir):
    return profiles.profile_c(plan.detections(spark, sf_dir))


@register("p4_profile_d", query(*sql.LINKED_EVENTS, D))
def _(spark, sf_dir):
    return profiles.profile_d(plan.detections(spark, sf_dir))


def _states(dets):
    """The states of the true tracks, associated once for all profiles."""
    return cut(plan.status_of(dets, plan.true_tracks(dets)).select(*TRACK, "frame", "ts", "det_id", "helmet_state", "vest_state"))


@register("p5_compare_profiles", query(*sql.TRUE_EVENTS, H_TRACKS, f"al AS ({A} UNION ALL {B.replace('FROM trk', 'FROM h_trk')} UNION ALL {C} UNION ALL {D})", """
SELECT coalesce(p.camera_id, t.camera_id) AS camera_id, coalesce(p.violation, t.violation) AS violation, coalesce(a, 0) AS "A_yolo", coalesce(b, 0) AS "B_tracking", coalesce(c, 0) AS "C_association", coalesce(d, 0) AS "D_full_system", coalesce(n, 0) AS truth
FROM (SELECT camera_id, violation, count(*) FILTER (profile = 'A_yolo') AS a, count(*) FILTER (profile = 'B_tracking') AS b, count(*) FILTER (profile = 'C_association') AS c, count(*) FILTER (profile = 'D_full_system') AS d FROM al GROUP BY ALL) p
FULL JOIN (SELECT w // 5 AS camera_id, v AS violation, count(*) AS n FROM (SELECT DISTINCT w, 'NO_HELMET' AS v FROM wk WHERE w % 4 = 0 UNION ALL SELECT DISTINCT w, 'NO_VEST' FROM wk WHERE w % 6 = 1) GROUP BY ALL) t USING (camera_id, violation)"""))
def _(spark, sf_dir):
    dets = plan.detections(spark, sf_dir)
    status = _states(dets)
    truth = truth_events(spark, sf_dir).groupBy("camera_id", "violation").agg(F.count("*").alias("n"))
    return profiles.compare_profiles([profiles.profile_a(dets), profiles.profile_b(dets), profiles.profile_c(dets, status=status), profiles.profile_d(dets, status=status)], truth)


@register("p5_profile_accuracy", query(*sql.TRUE_EVENTS, H_TRACKS, f"al AS ({A} UNION ALL {B.replace('FROM trk', 'FROM h_trk')} UNION ALL {C} UNION ALL {D})", """
tr AS (SELECT w // 5 AS camera_id, v AS violation, w AS truth_id, s AS start_frame, e AS end_frame FROM (SELECT DISTINCT w, 'NO_HELMET' AS v, 10 AS s, 29 AS e FROM wk WHERE w % 4 = 0 UNION ALL SELECT DISTINCT w, 'NO_VEST', 5, 34 FROM wk WHERE w % 6 = 1)),
mt AS (SELECT profile, al.violation, al.run, al.camera_id, track_id, frame, truth_id, start_frame FROM al JOIN tr ON al.camera_id = tr.camera_id AND al.violation = tr.violation AND frame BETWEEN start_frame AND end_frame + 10),
fi AS (SELECT profile, violation, camera_id, truth_id, min(frame - start_frame) AS delay FROM mt GROUP BY ALL)""", """
SELECT n.profile, n.violation, n.alerts, e.events, coalesce(r."right", 0) AS "right", coalesce(f.found, 0) AS found, round(coalesce(r."right", 0) / alerts, 9) AS precision, round(coalesce(f.found, 0) / events, 9) AS recall, round(f.mean_delay, 9) AS mean_delay
FROM (SELECT profile, violation, count(DISTINCT (run, camera_id, track_id, frame)) AS alerts FROM al GROUP BY ALL) n JOIN (SELECT violation, count(*) AS events FROM tr GROUP BY ALL) e USING (violation)
LEFT JOIN (SELECT profile, violation, count(DISTINCT (run, camera_id, track_id, frame)) AS "right" FROM mt GROUP BY ALL) r USING (profile, violation) LEFT JOIN (SELECT profile, violation, count(*) AS found, avg(delay) AS mean_delay FROM fi GROUP BY ALL) f USING (profile, violation)"""))
def _(spark, sf_dir):
    dets = plan.detections(spark, sf_dir)
    status = _states(dets)
    return profiles.profile_accuracy([profiles.profile_a(dets), profiles.profile_b(dets), profiles.profile_c(dets, status=status), profiles.profile_d(dets, status=status)], truth_events(spark, sf_dir))


@register("p6_ablate", query(*sql.LINKED_EVENTS[:8], "SELECT 'ablation' AS profile, run, camera_id, track_id, violation, min(frame) AS frame FROM runs WHERE violation = 'NO_HELMET' AND ts - first_ts >= 1000000 GROUP BY run, camera_id, track_id, violation, first_frame"))
def _(spark, sf_dir):
    return profiles.ablate(plan.detections(spark, sf_dir))


@register("p6_ablation_table", query(*sql.LINKED_EVENTS[:8], H_TRACKS, "nv AS (SELECT * FROM vio WHERE flag AND violation = 'NO_HELMET')", """
SELECT tracking, association, engine, CASE
  WHEN NOT association AND NOT tracking THEN (SELECT count(*) FROM det WHERE cls = 1)
  WHEN NOT association THEN (SELECT count(DISTINCT (run, camera_id, track_id)) FROM h_trk)
  WHEN NOT tracking AND engine THEN 0
  WHEN NOT tracking THEN (SELECT count(*) FROM nv)
  WHEN NOT engine THEN (SELECT count(DISTINCT (run, camera_id, track_id)) FROM nv)
  ELSE (SELECT count(DISTINCT (run, camera_id, track_id, first_frame)) FROM runs WHERE violation = 'NO_HELMET' AND ts - first_ts >= 1000000) END AS alerts
FROM (VALUES (TRUE), (FALSE)) t(tracking), (VALUES (TRUE), (FALSE)) a(association), (VALUES (TRUE), (FALSE)) e(engine)"""))
def _(spark, sf_dir):
    return profiles.ablation_table(plan.detections(spark, sf_dir))


# evaluation


def truth_events(spark, sf_dir):
    """True violations by construction: camera_id, violation, truth_id, start_frame, end_frame."""
    w = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("truth_id")).distinct()
    camera = F.expr("truth_id div 5").alias("camera_id")
    part = lambda where, kind, a, b: w.where(where).select(camera, F.lit(kind).alias("violation"), "truth_id", F.lit(a).alias("start_frame"), F.lit(b).alias("end_frame"))
    return part("truth_id % 4 = 0", "NO_HELMET", 10, 29).unionByName(part("truth_id % 6 = 1", "NO_VEST", 5, 34))


MATCH = f"""
mp AS (SELECT d.camera_id, d.frame, d.cls, d.det_id, t.det_id AS truth_id, d.conf, round({sql.iou("d", "t")}, 9) AS iou FROM til d JOIN det t ON d.camera_id = t.camera_id AND d.frame = t.frame AND d.cls = t.cls),
mr AS (SELECT *, row_number() OVER (PARTITION BY camera_id, frame, cls ORDER BY conf DESC, det_id, iou DESC, truth_id) AS rn FROM mp WHERE iou >= 0.5),
mf AS (SELECT camera_id, frame, cls, rn, det_id, TRUE AS take, [det_id] AS ds, [truth_id] AS ts FROM mr WHERE rn = 1
  UNION ALL SELECT c.camera_id, c.frame, c.cls, c.rn, c.det_id, NOT (list_contains(f.ds, c.det_id) OR list_contains(f.ts, c.truth_id)),
    CASE WHEN list_contains(f.ds, c.det_id) OR list_contains(f.ts, c.truth_id) THEN f.ds ELSE list_append(f.ds, c.det_id) END,
    CASE WHEN list_contains(f.ds, c.det_id) OR list_contains(f.ts, c.truth_id) THEN f.ts ELSE list_append(f.ts, c.truth_id) END
  FROM mf f JOIN mr c ON c.camera_id = f.camera_id AND c.frame = f.frame AND c.cls = f.cls AND c.rn = f.rn + 1)"""
CURVE = """
nt AS (SELECT cls, count(*) AS n_truth FROM det GROUP BY cls),
cu AS (SELECT t.cls, t.conf, m.take FROM til t LEFT JOIN (SELECT det_id, take FROM mf WHERE take) m USING (det_id)),
st AS (SELECT cls, round(conf*1000)::INT AS bin, count(take) AS tp, count(*) AS n FROM cu GROUP BY ALL),
c2 AS (SELECT cls, bin, sum(tp) OVER w AS tps, sum(n) OVER w AS seen FROM st WINDOW w AS (PARTITION BY cls ORDER BY bin DESC)),
c3 AS (SELECT cls, bin, tps / n_truth AS recall, tps / seen AS precision FROM c2 JOIN nt USING (cls)),
c4 AS (SELECT cls, recall - coalesce(lag(recall) OVER (PARTITION BY cls ORDER BY bin DESC), 0) AS step, max(precision) OVER (PARTITION BY cls ORDER BY bin) AS best FROM c3),
ap AS (SELECT n.cls, n_truth, round(coalesce(sum(step * best), 0), 9) AS ap FROM nt n LEFT JOIN c4 USING (cls) GROUP BY n.cls, n_truth)"""


@register("v1_detector_ap", query(sql.DET, TILED, MATCH, CURVE, "SELECT * FROM ap UNION ALL SELECT -1, sum(n_truth)::BIGINT, round(avg(ap), 9) FROM ap"))
def _(spark, sf_dir):
    truth = plan.detections(spark, sf_dir).withColumnRenamed("det_id", "truth_id")
    return evaluate.detector_ap(_tiled(spark, sf_dir), truth)


# the tracker sees sure boxes only, some of them 40 pixels beside the truth
SEEN = sql.DET.replace("det AS (SELECT 'fixture'", "all_det AS (SELECT 'fixture'") + """,
det AS (SELECT * REPLACE (x1 + sh AS x1, x2 + sh AS x2) FROM (SELECT *, CASE WHEN (det_id // 4 * 7 + frame) % 11 = 0 THEN 40.0 ELSE 0.0 END AS sh FROM all_det) WHERE conf >= 0.5)"""
QUALITY = """
hit AS (SELECT t.run, f.camera_id, f.frame, list_extract(f.ts, -1) // 160 AS w, t.track_id FROM mf f JOIN trk t USING (det_id) WHERE f.take),
sw AS (SELECT run, (track_id <> lag(track_id) OVER (PARTITION BY run, w ORDER BY frame, camera_id))::INT AS s FROM hit),
nn AS (SELECT run, (SELECT count(*) FROM tru) AS n, (SELECT count(*) FROM tru) - count(*) AS misses, (SELECT count(*) FROM trk) - count(*) AS extra, coalesce(sum(s), 0)::BIGINT AS switches FROM sw GROUP BY run)"""


@register("v2_tracking_quality", query(SEEN, sql.LINKS, sql.TRACKS, "til AS (SELECT * FROM trk), tru AS (SELECT * FROM all_det WHERE cls = 0)", MATCH.replace("JOIN det t", "JOIN tru t"), QUALITY, "SELECT run, n AS n_truth, misses, extra AS false_positives, switches, round(1 - (misses + extra + switches) / n, 9) AS mota FROM nn"))
def _(spark, sf_dir):
    dets = plan.detections(spark, sf_dir)
    shift = F.expr("CASE WHEN (det_id div 4 * 7 + frame) % 11 = 0 THEN 40D ELSE 0D END")
    seen = dets.where("conf >= 0.5").withColumns({"x1": F.col("x1") + shift, "x2": F.col("x2") + shift})
    truth = plan.true_tracks(dets).withColumnRenamed("track_id", "truth_id")
    return evaluate.tracking_quality(plan.linked_tracks(seen), truth)


ACCURACY = """
fj AS (SELECT coalesce(a.cls, d.cls) AS cls, a.person_det_id // 160 AS p, CASE WHEN d.det_id IS NOT NULL THEN d.det_id // 160 END AS t FROM (SELECT * FROM det WHERE cls > 0 AND det_id % 37 <> 0) d FULL JOIN asg a ON a.ppe_det_id = d.det_id),
ac AS (SELECT cls, count(*) FILTER (p = t) AS "right", count(*) FILTER (p <> t) AS wrong, count(*) FILTER (p IS NULL) AS missing, count(*) FILTER (t IS NULL) AS spurious FROM fj GROUP BY cls),
acc AS (SELECT *, round("right" / ("right"+wrong+spurious), 9) AS precision, round("right" / ("right"+wrong+missing), 9) AS recall, round("right" / ("right"+wrong+missing+spurious), 9) AS accuracy FROM ac)"""


def _accuracy(spark, sf_dir):
    dets = plan.detections(spark, sf_dir)
    made = plan.associate(plan.association_candidates(dets)).withColumn("person", F.expr("person_det_id div 160"))
    truth = dets.where("cls > 0 and det_id % 37 <> 0").withColumnRenamed("det_id", "ppe_det_id").withColumn("true_person", F.expr("ppe_det_id div 160"))
    return evaluate.association_accuracy(made, truth)


@register("v3_association_accuracy", query(sql.DET, sql.CAND, sql.ONE, ACCURACY, "SELECT * FROM acc"))
def _(spark, sf_dir):
    return _accuracy(spark, sf_dir)


EVENT_ACCURACY = """
tru AS (SELECT DISTINCT w // 5 AS camera_id, 'NO_HELMET' AS violation, w AS truth_id, 10 AS s, 29 AS t FROM wk WHERE w % 4 = 0 UNION ALL SELECT DISTINCT w // 5, 'NO_VEST', w, 5, 34 FROM wk WHERE w % 6 = 1),
ep AS (SELECT e.camera_id, e.violation, e.event_id, e.confirm_frame, u.truth_id, u.s, least(e.end_frame, u.t) - greatest(e.start_frame, u.s) + 1 AS common FROM evt e JOIN tru u USING (camera_id, violation)),
eb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY common DESC, truth_id) AS r1, row_number() OVER (PARTITION BY camera_id, violation, truth_id ORDER BY common DESC, event_id) AS r2 FROM ep WHERE common > 0) WHERE r1 = 1 AND r2 = 1),
eh AS (SELECT violation, count(*) AS matched, round(avg(confirm_frame - s), 9) AS mean_delay FROM eb GROUP BY violation),
ea AS (SELECT violation, n_events, n_truth, matched, round(matched / n_events, 9) AS precision, round(matched / n_truth, 9) AS recall, mean_delay
  FROM (SELECT violation, count(*) AS n_events FROM evt GROUP BY ALL) JOIN (SELECT violation, count(*) AS n_truth FROM tru GROUP BY ALL) USING (violation) JOIN eh USING (violation))"""


@register("v4_event_accuracy", query(*sql.TRUE_EVENTS, EVENT_ACCURACY, "SELECT * FROM ea"))
def _(spark, sf_dir):
    return evaluate.event_accuracy(_events(spark, sf_dir), truth_events(spark, sf_dir))


@register("v5_metrics_table", query(*sql.TRUE_EVENTS, ACCURACY, EVENT_ACCURACY, """
SELECT 'fixture' AS run, 'association' AS evaluation, cls::VARCHAR AS subject, metric, value FROM (SELECT cls, precision, recall, accuracy FROM acc) UNPIVOT (value FOR metric IN (precision, recall, accuracy))
UNION ALL SELECT 'fixture', 'events', violation, metric, value FROM (SELECT violation, precision, recall FROM ea) UNPIVOT (value FOR metric IN (precision, recall))"""))
def _(spark, sf_dir):
    events = evaluate.event_accuracy(_events(spark, sf_dir), truth_events(spark, sf_dir))
    return evaluate.metrics_table("fixture", association=(_accuracy(spark, sf_dir), ["cls"], ["precision", "recall", "accuracy"]), events=(events, ["violation"], ["precision", "recall"]))
