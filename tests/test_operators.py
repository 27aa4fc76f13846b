"""Small hand-made cases."""

import datetime as dt
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from safesight.operators import associate, dataset, detect, evaluate, review, temporal, track
from safesight.plans import detections as plan
from safesight.schemas import DETECTIONS
from safesight.sources import readers, writers
from safesight.streaming import streams

T0 = dt.datetime(2026, 1, 1)


def dets(spark, rows):
    """rows: frame, det_id, cls, x1, y1, x2, y2, conf."""
    return spark.createDataFrame([("r", 0, f, T0 + dt.timedelta(milliseconds=100 * f), i, c, float(a), float(b), float(x), float(y), float(p)) for f, i, c, a, b, x, y, p in rows], DETECTIONS)


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_suppress_keeps_the_better_and_chains(spark):
    d = dets(spark, [(0, 1, 0, 0, 0, 10, 10, 0.9), (0, 2, 0, 1, 0, 11, 10, 0.8), (0, 3, 0, 4, 0, 14, 10, 0.7), (0, 4, 1, 0, 0, 10, 10, 0.1), (1, 5, 0, 0, 0, 10, 10, 0.1)])
    # 2 falls to 1; 3 overlaps 2 but not 1 by half, so it stays
    assert ids(detect.suppress_overlaps(d), "det_id") == [(1,), (3,), (4,), (5,)]
    assert detect.suppress_overlaps(d.limit(0)).count() == 0


def test_association_ties_and_shared_boxes(spark):
    d = dets(spark, [(0, 1, 0, 0, 0, 100, 200, 0.9), (0, 2, 0, 0, 0, 100, 200, 0.9), (0, 3, 2, 30, 10, 60, 40, 0.8), (0, 4, 2, 30, 10, 60, 40, 0.8), (0, 5, 3, 20, 60, 80, 120, 0.8), (1, 6, 2, 0, 0, 9, 9, 0.5)])
    c = associate.association_candidates(d)
    one = associate.associate(c)
    assert ids(one, "ppe_det_id", "person_det_id") == [(3, 1), (4, 2), (5, 1)]
    assert ids(associate.associate(c, "box_unique"), "ppe_det_id", "person_det_id") == [(3, 1), (4, 1), (5, 1)]
    status = associate.frame_status(d.where("cls = 0").withColumn("track_id", F.col("det_id")), one)
    assert ids(status, "track_id", "helmet_state", "vest_state") == [(1, "present", "present"), (2, "present", "missing")]


def test_consecutive_breaks_on_observation_and_gap(spark):
    def flags(track_id, seq):
        return [("r", 0, track_id, f, T0, f, "NO_VEST", x) for f, x in seq]

    rows = flags(1, [(f, True) for f in range(5)]) + flags(2, [(0, True), (1, True), (2, False), (3, True), (4, True)]) + flags(3, [(0, True), (1, True), (20, True), (21, True), (22, True)]) + flags(4, [(0, True)])
    v = spark.createDataFrame(rows, "run string, camera_id long, track_id long, frame long, ts timestamp, det_id long, violation string, flag boolean")
    assert ids(temporal.rule_consecutive(v, 3), "track_id", "confirm_frame") == [(1, 2), (3, 22)]
    assert ids(temporal.rule_majority(v, 5, 0.5), "track_id", "frame") == [(1, 4), (2, 4), (3, 22)]
    events = temporal.build_events(v, temporal.rule_consecutive(v, 3))
    assert ids(events, "track_id", "start_frame", "end_frame", "n_frames") == [(1, 0, 4, 5), (3, 20, 22, 3)]


def test_tracks_bridge_gaps_and_low_confidence(spark):
    d = dets(spark, [(0, 1, 0, 0, 0, 10, 10, 0.9), (1, 2, 0, 1, 0, 11, 10, 0.2), (2, 3, 0, 2, 0, 12, 10, 0.9), (9, 4, 0, 3, 0, 13, 10, 0.9), (60, 5, 0, 3, 0, 13, 10, 0.9), (3, 6, 0, 500, 0, 510, 10, 0.05)])
    links = track.link_detections(d)
    assert ids(links, "prev_det_id", "det_id", "tier") == [(1, 2, 2), (2, 3, 2), (3, 4, 3)]
    assert ids(track.assign_tracks(d, links), "det_id", "track_id") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6)]


def test_clips_are_disjoint(spark, sf):
    clips = plan.events_of(plan.status_of(plan.detections(spark, sf), plan.true_tracks(plan.detections(spark, sf))))
    rows = sorted((r.camera_id, r.from_frame, r.to_frame) for r in temporal.clip_ranges(clips).collect())
    assert all(a[0] != b[0] or a[2] + 1 < b[1] for a, b in zip(rows, rows[1:]))


def test_leakage_is_gone_after_repair(spark):
    files = spark.createDataFrame([("a", 1, "train", "x"), ("b", 2, "test", "x"), ("c", 3, "val", "y"), ("d", 4, "train", "z"), ("e", 5, "val", "z")], "path string, image_id long, split string, sha256 string")
    assert dataset.find_split_leakage(files).count() == 2
    fixed = dataset.repair_splits(files)
    assert dataset.find_split_leakage(fixed).count() == 0
    assert ids(fixed, "image_id", "split") == [(1, "test"), (2, "test"), (3, "val"), (4, "val"), (5, "val")]
    pairs = spark.createDataFrame([(1, 3), (3, 4)], "image_id long, other_id long")
    assert ids(dataset.repair_splits(files, pairs=pairs), "image_id", "split") == [(1, "val"), (2, "test"), (3, "val"), (4, "val"), (5, "val")]


def test_perfect_scores_on_the_truth(spark, sf):
    d = plan.detections(spark, sf)
    ap = evaluate.detector_ap(d, d.withColumnRenamed("det_id", "truth_id"))
    assert {r.ap for r in ap.collect()} == {1.0}
    persons = plan.true_tracks(d)
    assert evaluate.tracking_quality(persons, persons.withColumnRenamed("track_id", "truth_id")).first().mota == 1.0


def test_reviews(spark):
    events = spark.createDataFrame([("a",), ("b",), ("c",)], "event_id string").withColumn("start_ts", F.lit(T0))
    old = spark.createDataFrame([(1, "a", "FALSE_ALARM", "x", T0), (2, "a", "NEEDS_REVIEW", "x", T0), (3, "b", "FALSE_ALARM", "x", T0)], "review_id long, event_id string, decision string, reviewer string, decided_at timestamp")
    assert ids(review.latest_decisions(old), "event_id", "decision") == [("a", "NEEDS_REVIEW"), ("b", "FALSE_ALARM")]
    assert ids(review.review_queue(events, old), "event_id") == [("a",), ("c",)]
    new = spark.createDataFrame([(4, "c", "MAYBE", "x", T0), (5, "z", "FALSE_ALARM", "x", T0), (6, "c", None, "x", T0), (7, "c", "CONFIRMED_VIOLATION", "x", T0)], old.schema)
    kept, rejected = review.record_decisions(old, new, events)
    assert ids(kept, "review_id") == [(1,), (2,), (3,), (7,)] and ids(rejected, "review_id") == [(4,), (5,), (6,)]
    runs = review.run_registry(spark.createDataFrame([("r1", 1, 5), ("r2", 2, 5), ("r3", 2, 6)], "run string, seed int, size int").withColumn("config", F.struct("seed", "size")))
    assert ids(review.runs_that_differ_in(runs, "seed", ["seed", "size"]), "run", "other_run") == [("r1", "r2")]


VOC = """<annotation><filename>{n}.jpg</filename><size><width>100</width><height>50</height></size>{o}</annotation>"""
OBJECT = "<object><name>{c}</name><bndbox><xmin>{a}</xmin><ymin>0</ymin><xmax>{b}</xmax><ymax>25</ymax></bndbox></object>"


def test_voc_to_yolo_and_back(spark, tmp_path):
    src = tmp_path / "voc"
    src.mkdir()
    (src / "one.xml").write_text(VOC.format(n="one", o=OBJECT.format(c="helmet", a=0, b=50) + OBJECT.format(c="cat", a=1, b=2)))
    (src / "two.xml").write_text(VOC.format(n="two", o=""))
    voc = readers.read_voc(spark, str(src))
    assert ids(voc.where("name is not null"), "image_id", "name") == [("one", "cat"), ("one", "helmet")]
    boxes, rest = dataset.remap_classes(voc, {"helmet": 2})
    assert [r["name"] for r in rest.where("name is not null").collect()] == ["cat"]
    yolo = dataset.voc_to_yolo(boxes).withColumn("split", F.lit("train"))
    out = str(tmp_path / "yolo")
    writers.write_yolo(yolo.select("split", "image_id", "cls", "cx", "cy", "w", "h"), out)
    back = readers.read_yolo(spark, out).collect()
    assert [(r.cls, r.cx, r.cy, r.w, r.h, r.error) for r in back] == [(2, 0.25, 0.25, 0.5, 0.5, None)]


def test_yolo_bad_lines_and_files(spark, tmp_path):
    folder = tmp_path / "val"
    folder.mkdir()
    (folder / "a.txt").write_text("0 0.5 0.5 0.1 0.1\n1 x 0 0 0\n\n9 1 2\n")
    rows = readers.read_yolo(spark, str(tmp_path))
    assert sorted((r.split, r.image_id, r.cls, r.error) for r in rows.collect() if r.error is None) == [("val", "a", 0, None)]
    assert rows.where("error is not null").count() == 2
    files = readers.read_files(spark, str(tmp_path), "*.txt").collect()
    assert [(f.image_id, f.split, f.bytes) for f in files] == [("a", "val", 35)]


def test_sinks(spark, tmp_path):
    d = dets(spark, [(0, 1, 0, 0, 0, 1, 1, 0.5)])
    writers.write_frame_status(d, str(tmp_path / "json"))
    assert readers.read_detections(spark, str(tmp_path / "json"), "json").collect() == d.collect()
    writers.write_csv(d, str(tmp_path / "csv"))
    assert readers.read_detections(spark, str(tmp_path / "csv"), "csv").count() == 1
    root = str(tmp_path / "root")
    writers.write_run(d, root, "one", "events")
    try:
        writers.write_run(d, root, "one", "events")
        raise AssertionError("it must not overwrite")
    except Exception as e:  # noqa: BLE001
        assert "EXISTS" in str(e).upper()
    for stamp in ("s1", "s2"):
        writers.publish_run(spark, root, "one", "events", stamp)
    assert writers.read_published(spark, root, "events").count() == writers.read_published(spark, root, "events", backup="s2").count() == 1
    events = d.select(F.sha2("run", 256).alias("event_id"), "run")
    for _ in range(2):
        writers.write_events(events, "stored_events")
    assert spark.table("stored_events").count() == 1
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r1" / "results.csv").write_text("epoch,precision,recall,map50,map\n1,0,0,0,0.5\n2,0,0,0,0.5\n3,0,0,0,0.4\n")
    assert ids(review.best_epochs(readers.training_curve(spark, str(tmp_path / "runs")), "map"), "run", "best_epoch") == [("r1", 1)]


def test_stream_equals_batch_with_disorder(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(seconds=s), s, s % 7 != 6) for s in range(60)]
    batches = [rows[10:20], rows[0:10], rows[20:25] + rows[30:45], rows[25:30] + rows[45:], [(1, T0 + dt.timedelta(hours=1), 9999, False)]]
    schema = "user long, ts timestamp, id long, flag boolean"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = streams.run_to_end(streams.stream_consecutive(source, ["user"], 5, "30 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    # runs of six violating rows: the fifth of each confirms
    want = [int((T0.replace(tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)).timestamp() * 1e6) for s in range(4, 60, 7)]
    assert sorted(r.confirm_us for r in out.collect()) == want


def test_consecutive_keys_share_state(spark, tmp_path):
    """Keys of several columns and types, null too, in two batches, in 8 shards: as one key after another."""
    rnd = random.Random(5)
    users = [(k if k % 7 else None, f'a"{k % 5}\\ü' if k % 3 else None, dt.datetime(2026, 1, 1, 0, 0, 0, k), bytes([k % 251, 255]), [k / 3, None][k % 2], [None, dt.datetime(2026, 1, 1, 0, 0, 0, k)]) for k in range(300)]
    rows = [(u, T0 + dt.timedelta(seconds=s), 1000 * i + s, rnd.random() < 0.75) for i, u in enumerate(users) for s in range(0, 60, 4)]
    schema = "k1 long, k2 string, k3 timestamp, k4 binary, k5 double, k6 array<timestamp>, ts timestamp, id long, flag boolean"
    for i in range(2):
        part = [(*u, *r) for u, *r in rows if (r[0] >= T0 + dt.timedelta(seconds=30)) == bool(i)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    end = spark.createDataFrame([(*users[0], T0 + dt.timedelta(hours=1), 0, False)], schema)
    end.write.mode("append").parquet(str(tmp_path / "in" / "2"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    df = streams.stream_consecutive(source, ["k1", "k2", "k3", "k4", "k5", "k6"], 3, "30 seconds", 10, shards=8)
    out = streams.run_to_end(df, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [t for _, t in out.dtypes] == ["bigint", "string", "timestamp", "binary", "double", "array<timestamp>", "bigint", "bigint"]
    want, us = [], lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    for i, u in enumerate(users):
        n = 0
        for _, at, _, flag in rows[15 * i : 15 * i + 15]:
            n, start = (n + 1, start if n else at) if flag else (0, None)
            if n == 3:
                want.append((*u, us(start), us(at)))
    assert sorted(((*r[:3], bytes(r[3]), *r[4:]) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_consecutive_state_does_not_grow_with_keys(spark, tmp_path):
    """3,000 keys of one row each: at most a timer per shard, where each key had its own."""
    rows = spark.range(3000).select(F.col("id").alias("user"), F.timestamp_seconds(F.lit(1_767_225_600)).alias("ts"), "id", F.lit(True).alias("flag"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    try:
        query = streams.start_sink(streams.stream_consecutive(source, ["user"]), str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    metrics = [o["customMetrics"] for p in query.recentProgress for o in p["stateOperators"]]
    assert sum(m["numRegisteredTimers"] for m in metrics) <= 1024


def test_tracker_overlap():
    assert streams.overlap((0, 0, 2, 2), (1, 0, 3, 2)) == 1 / 3 and streams.overlap((0, 0, 0, 0), (0, 0, 0, 0)) == 0


def test_dominant_pairs_equal_greedy_choice_in_a_crowded_frame(spark):
    rnd = random.Random(2)
    rows = [(0, 7, 2, p, 1000 + b, rnd.randrange(40) / 40) for p in range(1000) for b in {rnd.randrange(1000) for _ in range(12)}]
    # a chain: each pair is dominated by the next
    rows += [(0, 8, 3, k // 2, 5000 + (k + 1) // 2, k / 100) for k in range(30)]
    cands = spark.createDataFrame([("r", *r) for r in rows], "run string, camera_id long, frame long, cls int, person_det_id long, ppe_det_id long, score double")
    taken, want = set(), set()
    for _, f, c, p, b, s in sorted(rows, key=lambda r: (r[1], -r[5], r[4], r[3])):
        if not {(f, "p", p), (f, "b", b)} & taken:
            taken |= {(f, "p", p), (f, "b", b)}
            want.add((f, p, b))
    began = time.time()
    assert set(ids(associate.associate(cands), "frame", "person_det_id", "ppe_det_id")) == want
    assert time.time() - began < 60
    assert associate.associate(cands.limit(0)).count() == 0


def test_links_of_crowded_and_bridged_frames(spark):
    """Mutual best within a frame: the nearer of two candidates, each side."""
    d = dets(spark, [(0, 1, 0, 0, 0, 10, 10, 0.9), (0, 2, 0, 2, 0, 12, 10, 0.9), (1, 3, 0, 1, 0, 11, 10, 0.9), (1, 4, 0, 2, 0, 12, 10, 0.9), (31, 5, 0, 2, 0, 12, 10, 0.9), (31, 6, 0, 1, 0, 11, 10, 0.3)])
    assert ids(track.link_detections(d), "prev_det_id", "det_id", "gap", "tier") == [(1, 3, 1, 1), (2, 4, 1, 1), (4, 5, 30, 3)]


def test_published_version_after_a_crash_at_each_step(spark, tmp_path, monkeypatch):
    root, steps = str(tmp_path), []
    for run in ("a", "b"):
        writers.write_run(spark.range(3).withColumn("run", F.lit(run)), root, run, "t")
    writers.publish_run(spark, root, "a", "t", "s1")
    point = writers._point

    def broken(at):
        def f(*args):
            steps.append(args[1])
            if len(steps) == at:
                raise OSError("crash")
            point(*args)

        return f

    for at in (1, 2):  # while the backup is kept, and while the pointer is switched
        steps.clear()
        monkeypatch.setattr(writers, "_point", broken(at))
        with pytest.raises(OSError):
            writers.publish_run(spark, root, "b", "t", "s2")
        assert {r.run for r in writers.read_published(spark, root, "t").collect()} == {"a"}
    monkeypatch.setattr(writers, "_point", point)
    for _ in range(2):
        writers.publish_run(spark, root, "b", "t", "s2")
    assert {r.run for r in writers.read_published(spark, root, "t").collect()} == {"b"}
    assert {r.run for r in writers.read_published(spark, root, "t", backup="s2").collect()} == {"a"}
    with pytest.raises(FileNotFoundError):
        writers.read_published(spark, root, "other")


def test_event_sink_after_a_replayed_batch(spark, tmp_path):
    """A batch whose commit is lost runs again: the table is the same."""
    schema = "user long, ts timestamp, n long"
    for i in range(3):
        spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), k) for k in range(5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    path, checkpoint = str(tmp_path / "out"), tmp_path / "cp"
    streams.start_event_sink(source, path, str(checkpoint)).awaitTermination()
    want = ids(streams.read_event_sink(spark, path, source.schema), "user", "n")
    assert len(want) == 15
    for lost in ("commits", "ledger"):  # the batch was written, with and without its ledger entry
        for f in (checkpoint / "commits").glob("*2*"):
            f.unlink()
        if lost == "ledger":
            shutil.rmtree(tmp_path / "out" / "ledger" / "batch=2")
        streams.start_event_sink(source, path, str(checkpoint)).awaitTermination()
        assert ids(streams.read_event_sink(spark, path, source.schema), "user", "n") == want


def test_tracks_of_a_stream_in_several_batches(spark, tmp_path):
    """Frames in disorder and in many batches give the tracks of one batch, the last frame too; nulls are left out."""
    rows = [("r", 0, f, T0 + dt.timedelta(milliseconds=100 * f), 10 * f + p, 0, float(100 * p + f), 0.0, float(100 * p + f + 50), 50.0, 0.9 if (f + p) % 4 else 0.3) for f in range(12) for p in range(3)]
    rows += [("r", None, None, None, None, 0, None, None, None, None, None)]
    found = []
    for n, parts in enumerate(([rows], [rows[6:12], rows[0:6] + rows[36:], rows[18:30], rows[12:18], rows[30:36]])):
        for i, part in enumerate(parts):
            spark.createDataFrame(part, DETECTIONS).coalesce(1).write.parquet(str(tmp_path / f"in{n}" / f"{i}"))
        source = spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / f"in{n}"))
        closing = str(tmp_path / f"closing{n}")
        out = streams.run_to_end(streams.track_stream(streams.closable(source, closing), delay="2 seconds", step_seconds=1), str(tmp_path / f"out{n}"), str(tmp_path / f"cp{n}"), closing)
        found.append(ids(out, "frame", "det_id", "track_id"))
    assert found[0] == found[1] and len(found[0]) == 35 and {t for _, _, t in found[0]} == {1, 2, 10}


def observed(spark, rows):
    """rows: track_id, frame, flag."""
    return spark.createDataFrame([("r", 0, t, f, T0 + dt.timedelta(milliseconds=100 * f), f, "NO_VEST", x) for t, f, x in rows], "run string, camera_id long, track_id long, frame long, ts timestamp, det_id long, violation string, flag boolean")


def test_runs_go_on_over_blocks(spark, monkeypatch):
    """One track with all rows, in blocks of a few frames or in one: the same runs, events, clips."""
    rnd = random.Random(5)
    v = observed(spark, [(t, f, rnd.random() < 0.85) for t, n in ((1, 700), (2, 40), (3, 1)) for f in sorted(rnd.sample(range(2 * n), n))]).cache()
    found = []
    for block in (1 << 16, 1, 7, 64):
        monkeypatch.setattr(temporal, "BLOCK", block)
        confirmed = temporal.rule_consecutive(v, 4)
        events = temporal.consecutive_events(v, 4, merge_gap=6)
        assert sorted(events.collect()) == sorted(temporal.build_events(v, confirmed, merge_gap=6).collect())
        found.append([sorted(x.collect()) for x in (confirmed, temporal.rule_duration(v, 0.6), events, temporal.clip_ranges(events, 3, 4))])
    assert all(f == found[0] for f in found) and len(found[0][0]) > 20 and len(found[0][2]) > 5
    assert temporal.consecutive_events(v.limit(0)).count() == 0


def test_evidence_of_long_and_short_events(spark):
    rnd = random.Random(6)
    spans = [(k, k % 3, a, a + rnd.randrange(1, 300)) for k in range(40) for a in [rnd.randrange(500)]]
    events = spark.createDataFrame([(f"e{k}", "r", 0, t, a, b) for k, t, a, b in spans], "event_id string, run string, camera_id long, track_id long, start_frame long, end_frame long")
    rows = [("r", 0, t, f, f, rnd.randrange(50) / 50, 0.0, 0.0, 1.0, 1.0) for t in range(3) for f in range(0, 800, 1 + t)]
    status = spark.createDataFrame(rows, "run string, camera_id long, track_id long, frame long, det_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    want = sorted((f"e{k}", i, r[3]) for k, t, a, b in spans for i, r in enumerate(sorted((r for r in rows if r[2] == t and a <= r[3] <= b), key=lambda r: (-r[5], r[3]))[:3], 1))
    assert ids(temporal.select_evidence(events, status), "event_id", "rank", "frame") == want
    assert temporal.select_evidence(events.limit(0), status).count() == 0


@pytest.mark.parametrize(("iou_max", "crowd"), [(0.5, 64), (0.5, 1000), (0.7, 64), (0.2, 64), (0.0, 64)])
def test_suppression_equals_the_plain_fold(spark, monkeypatch, iou_max, crowd):
    """Boxes of many sizes in one frame, negative corners, ties and empty boxes; by rounds over a grid, and by one fold."""
    monkeypatch.setattr(detect, "CROWD", crowd)
    rnd = random.Random(7)
    boxes = [(0, k, 0, x := rnd.randrange(-50, 300), y := rnd.randrange(-50, 300), x + rnd.choice([1, 5, 20, 33, 64, 200]), y + rnd.choice([1, 5, 20, 33, 64, 200]), rnd.randrange(10) / 10) for k in range(300)]
    boxes += [(0, 900 + k, 0, 10, 10, 10, 10, 0.5) for k in range(2)]
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[7], b[1])):
        if all(streams.overlap(k[3:7], b[3:7]) <= iou_max for k in kept):
            kept.append(b)
    assert ids(detect.suppress_overlaps(dets(spark, boxes), iou_max), "det_id") == sorted((b[1],) for b in kept)


def test_a_crowded_frame_is_quick(spark):
    """20,000 boxes of one frame, each with its shifted copy."""
    rows = spark.range(20_000).selectExpr("'r' as run", "0L as camera_id", "0L as frame", "timestamp '2026-01-01' as ts", "id as det_id", "0 as cls", "cast(id div 2 % 100 * 12 + id % 2 as double) as x1", "cast(id div 200 * 12 as double) as y1", "cast(id div 2 % 100 * 12 + id % 2 + 10 as double) as x2", "cast(id div 200 * 12 + 10 as double) as y2", "0.5 as conf")
    began = time.time()
    assert detect.suppress_overlaps(rows.unionByName(rows.selectExpr("run", "camera_id", "1L as frame", "ts", "det_id", "cls", "x1", "y1", "x2", "y2", "conf").limit(10))).where("det_id % 2 = 0").count() == 10_005
    assert time.time() - began < 90


def test_average_precision_over_distinct_confidences(spark):
    """Steps in several partitions give the all-point formula."""
    rnd = random.Random(8)
    truth = [(f, 10 * f + k, 0, 100 * k, 0, 100 * k + 50, 50, 1.0) for f in range(40) for k in range(3)]
    found = [(f, i, c, a + rnd.choice([0, 0, 60]), b, x + rnd.choice([0, 10]), y, rnd.random()) for f, i, c, a, b, x, y, _ in truth if rnd.random() < 0.9]
    hit = sorted(((r[7], streams.overlap(r[3:7], (100 * (r[1] % 10), 0, 100 * (r[1] % 10) + 50, 50)) >= 0.5) for r in found), reverse=True)
    precision, area = [], 0.0
    for k in range(1, len(hit) + 1):
        precision.append(sum(h for _, h in hit[:k]) / k)
    for k, (_, h) in enumerate(hit):
        area += h / len(truth) * max(precision[k:])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for coalesce in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            ap = {r.cls: r.ap for r in evaluate.detector_ap(dets(spark, found), dets(spark, truth).withColumnRenamed("det_id", "truth_id")).collect()}
            assert abs(ap[0] - area) < 1e-9 and 0.3 < area < 0.95
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
