"""Registered queries of sources and sinks: tables are written to the shared folder in a format and read back, so the rows are those of the table's own SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from safesight.lineage import shared_dir
from safesight.operators import review
from safesight.plans import detections as plan
from safesight.plans import sql
from safesight.plans.detections import table
from safesight.plans.sql import query
from safesight.registry import register
from safesight.schemas import CLASSES
from safesight.sources import readers, writers
from safesight.streaming import streams


def folder(spark):
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def labels(spark, sf_dir):
    """A labelled image per supplier: s_suppkey % 4 boxes and one more, split by the key."""
    box = F.explode(F.sequence(F.lit(0), (F.col("s_suppkey") % 4).cast("int")))
    split = F.when(F.col("s_suppkey") % 5 == 0, "val").otherwise("train")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", split.alias("split"), F.format_string("img%06d", "s_suppkey").alias("image_id"), box.alias("cls"))
    return rows.select("s_suppkey", "split", "image_id", "cls", ((F.col("s_nationkey") + 1) / 64).alias("cx"), ((F.col("cls") + 1) / 8).alias("cy"), F.lit(0.25).alias("w"), F.lit(0.125).alias("h"))


LABELS = """lab AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, printf('img%06d', s_suppkey) AS image_id, k::INT AS cls, (s_nationkey + 1) / 64 AS cx, (k + 1) / 8 AS cy, 0.25::DOUBLE AS w, 0.125::DOUBLE AS h
  FROM supplier, LATERAL (SELECT unnest(range(0, s_suppkey % 4 + 1)) AS k))"""
#: A line that is no label, in every seventh image.
BAD = "7 not a label"


@register("s1_read_voc", query(LABELS, """
SELECT CASE WHEN s_suppkey % 7 <> 0 THEN image_id END AS image_id, CASE WHEN s_suppkey % 7 <> 0 THEN 640 END AS width, CASE WHEN s_suppkey % 7 <> 0 THEN ['person', 'head', 'helmet', 'vest'][cls + 1] END AS name, CASE WHEN s_suppkey % 7 <> 0 THEN cx * 640 END AS x1,
  CASE WHEN s_suppkey % 7 <> 0 THEN (cx + w) * 640 END AS x2, s_suppkey % 7 = 0 AS bad FROM lab WHERE s_suppkey % 7 <> 0 OR cls = 0"""))
def _(spark, sf_dir):
    """One annotation an image, every seventh with a size that is no number."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    name = F.element_at(F.array(*(F.lit(c) for c in CLASSES)), F.col("cls") + 1)
    corners = F.concat(tag("xmin", F.col("cx") * 640), tag("ymin", F.col("cy") * 480), tag("xmax", (F.col("cx") + F.col("w")) * 640), tag("ymax", (F.col("cy") + F.col("h")) * 480))
    objects = labels(spark, sf_dir).groupBy("s_suppkey", "image_id").agg(F.concat_ws("", F.collect_list(tag("object", F.concat(tag("name", name), tag("bndbox", corners))))).alias("o"))
    width = F.when(F.col("s_suppkey") % 7 == 0, "wide").otherwise("640")
    xml = tag("annotation", F.concat(tag("filename", F.concat("image_id", F.lit(".jpg"))), tag("size", F.concat(tag("width", width), tag("height", F.lit(480)))), F.col("o")))
    path = folder(spark)
    objects.select(xml.alias("value")).write.text(path)
    return readers.read_voc(spark, path).select("image_id", "width", "name", "x1", "x2", F.col("error").isNotNull().alias("bad"))


def _yolo(spark, sf_dir):
    """The labels as files, and a bad line in some: the path."""
    path = folder(spark)
    writers.write_yolo(labels(spark, sf_dir), path)
    bad = table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").select(F.lit(BAD).alias("value"), F.lit("bad").alias("split"), F.format_string("img%06d", "s_suppkey").alias("image_id"))
    writers.by_image(bad).write.mode("append").partitionBy("split", "image_id").text(path)
    return path


@register("s2_read_yolo", query(LABELS, f"""
SELECT split, image_id, cls, cx, cy, w, h, NULL::VARCHAR AS error FROM lab UNION ALL SELECT 'bad', image_id, NULL, NULL, NULL, NULL, NULL, '{BAD}' FROM lab WHERE s_suppkey % 7 = 0 AND cls = 0"""))
def _(spark, sf_dir):
    """Label files, good and bad, read back (writes them by S6)."""
    return readers.read_yolo(spark, _yolo(spark, sf_dir))


FILES = """ln AS (SELECT split, image_id, cls || ' ' || printf('%.6f', cx) || ' ' || printf('%.6f', cy) || ' ' || printf('%.6f', w) || ' ' || printf('%.6f', h) AS line FROM lab),
fl AS (SELECT split, image_id, string_agg(line || chr(10), '' ORDER BY line) AS content FROM ln GROUP BY ALL)"""


@register("s3_read_files", query(LABELS, FILES, f"""
SELECT split, image_id, strlen(content)::BIGINT AS bytes, sha256(content) AS sha256 FROM fl UNION ALL SELECT 'bad', image_id, {len(BAD) + 1}, sha256('{BAD}' || chr(10)) FROM lab WHERE s_suppkey % 7 = 0 AND cls = 0"""))
def _(spark, sf_dir):
    """Size and hash of every label file: one an image."""
    return readers.read_files(spark, _yolo(spark, sf_dir), "*.txt").select("split", "image_id", "bytes", "sha256")


@register("s4_read_detections", query(sql.DET, "SELECT f AS fmt, cls, count(*) AS n, sum(det_id)::BIGINT AS ids, round(sum(x1*7+y1*3+x2+y2), 3) AS boxes, round(sum(conf), 6) AS conf, max(ts) AS last FROM det, (SELECT unnest(['parquet', 'json', 'csv']) AS f) GROUP BY ALL"))
def _(spark, sf_dir):
    """Detections in all three formats; sums per class as all rows are compared by t1 and others."""
    dets, every = plan.detections(spark, sf_dir), None
    for fmt in ("parquet", "json", "csv"):
        path = folder(spark)
        dets.write.format(fmt).option("header", "true").option("compression", "zstd" if fmt == "parquet" else "gzip").save(path)
        back = readers.read_detections(spark, path, fmt).withColumn("fmt", F.lit(fmt))
        every = back if every is None else every.unionByName(back)
    sums = every.groupBy("fmt", "cls").agg(F.count("*").alias("n"), F.sum("det_id").alias("ids"), F.round(F.sum(F.expr("x1*7+y1*3+x2+y2")), 3).alias("boxes"), F.round(F.sum("conf"), 6).alias("conf"), F.max("ts").alias("last"))
    return sums


@register("s5_stream_detections", query(sql.DET, "SELECT det_id, camera_id, frame, x1, conf FROM det WHERE cls = 1"))
def _(spark, sf_dir):
    """Bare heads of a stream of detection files."""
    root = folder(spark)
    plan.detections(spark, sf_dir).write.parquet(f"{root}/in")
    heads = readers.stream_detections(spark, f"{root}/in", per_batch=4).where("cls = 1").select("det_id", "camera_id", "frame", "x1", "conf")
    return streams.run_to_end(heads, f"{root}/out", f"{root}/checkpoint")


@register("s6_write_yolo", query(LABELS, FILES, "SELECT 'split=' || split || '/image_id=' || image_id AS place, line AS value FROM ln"))
def _(spark, sf_dir):
    """Lines and places of label files as written."""
    path = folder(spark)
    writers.write_yolo(labels(spark, sf_dir), path)
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(F.regexp_extract("_metadata.file_path", r"(split=[^/]+/image_id=[^/]+)/[^/]+$", 1).alias("place"), "value")


@register("s7_write_frame_status", query(*sql.TRUE_STATUS, "SELECT camera_id, frame, track_id, ts, x1, has_head, has_helmet, has_vest, helmet_state, vest_state FROM sta"))
def _(spark, sf_dir):
    """Frame status as JSON lines, read back."""
    dets = plan.detections(spark, sf_dir)
    status = plan.status_of(dets, plan.true_tracks(dets))
    path = folder(spark)
    writers.write_frame_status(status, path)
    return spark.read.schema(status.schema).json(path).select("camera_id", "frame", "track_id", "ts", "x1", "has_head", "has_helmet", "has_vest", "helmet_state", "vest_state")


@register("s8_write_csv", "SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS ts FROM events")
def _(spark, sf_dir):
    """Events with JSON (quotes and commas) as CSV, read back."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", F.col("ts").cast("timestamp").alias("ts"))
    path = folder(spark)
    writers.write_csv(rows, path)
    return readers.read_csv(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))


def _observed(spark, sf_dir):
    """Events of users as rows of an event table."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.sha2(F.col("event_id").cast("string"), 256).alias("event_id"), F.col("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("run"))


@register("s9_write_events", "SELECT sha256(event_id::VARCHAR) AS event_id, user_id, epoch_us(ts) AS us, event_type AS run FROM events")
def _(spark, sf_dir):
    """Appends that overlap leave each event once."""
    rows, name = _observed(spark, sf_dir), f"events_{uuid.uuid4().hex}"
    for part in (rows.where("run <> 'view'"), rows, rows.where("run = 'click'")):
        writers.write_events(part, name)
    return spark.table(name)


@register("s10_write_run", "SELECT sha256(event_id::VARCHAR) AS event_id, user_id, epoch_us(ts) AS us, event_type AS run, TRUE AS refused FROM events")
def _(spark, sf_dir):
    """A run's table, which a second call refuses to overwrite."""
    rows, root = _observed(spark, sf_dir), folder(spark)
    path, refused = writers.write_run(rows, root, "one", "events"), False
    try:
        writers.write_run(rows.limit(0), root, "one", "events")
    except Exception as e:  # noqa: BLE001  Spark's class for it differs by kind of session
        refused = "EXISTS" in str(e).upper()
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


@register("s11_publish_run", "SELECT event_type AS run, count(*) AS n, CASE WHEN event_type = 'error' THEN 'backup' ELSE 'current' END AS place FROM events GROUP BY ALL")
def _(spark, sf_dir):
    """Two runs published after one another: what readers see, and the backup."""
    rows, root = _observed(spark, sf_dir), folder(spark)
    for stamp, part in (("s1", rows.where("run = 'error'")), ("s2", rows.where("run <> 'error'"))):
        writers.write_run(part, root, stamp, "events")
        writers.publish_run(spark, root, stamp, "events", stamp)
    seen = writers.read_published(spark, root, "events").withColumn("place", F.lit("current")).unionByName(writers.read_published(spark, root, "events", backup="s2").withColumn("place", F.lit("backup")))
    return seen.groupBy("run", "place").agg(F.count("*").alias("n"))


CURVES = """cv AS (SELECT s_nationkey::VARCHAR AS run, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS epoch, round(s_acctbal / 10000, 2) AS map FROM supplier)"""


@register("q9_training_curve", query(CURVES, "SELECT run, arg_max(epoch, (map, -epoch)) AS best_epoch, max(map) AS map, count(*) AS epochs FROM cv GROUP BY run"))
def _(spark, sf_dir):
    """Results of a run per nation, a supplier an epoch, as CSV files of many runs: the best epoch of each."""
    epoch = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("run"), epoch.alias("epoch"), *(F.lit(0.5).alias(c) for c in ("precision", "recall", "map50")), F.round(F.col("s_acctbal") / 10000, 2).alias("map"))
    path = folder(spark)
    rows.write.option("header", "true").partitionBy("run").csv(path)
    curve = readers.training_curve(spark, path)
    return review.best_epochs(curve, "map").join(curve.groupBy("run").agg(F.count("*").alias("epochs")), "run")
