"""Tracks of a stream, whose cameras share shards, are those of each camera by itself."""

import datetime as dt
import random

from safesight.streaming import streams

SCHEMA = "run string, camera_id long, frame long, ts timestamp, det_id long, x1 double, y1 double, x2 double, y2 double, conf double"
T0 = dt.datetime(2026, 1, 1)


def frames(rnd, cameras):
    """Boxes of cameras that miss frames; some ids are there again."""
    rows = []
    for c in cameras:
        for f in sorted(rnd.sample(range(30), rnd.randrange(1, 25))):
            for k in range(rnd.randrange(1, 5)):
                x = float(rnd.randrange(60))
                rows.append(("r", c, f, T0 + dt.timedelta(milliseconds=100 * f), rnd.randrange(40), x, 0.0, x + rnd.choice([10, 30]), 20.0, rnd.choice([0.05, 0.2, 0.5, 0.9])))
    return list({(r[1], r[2], r[4], r[9]): r for r in rows}.values())


def followed(rows, high=0.5, low=0.1, max_gap=5, iou_min=0.3):
    """One camera after the other, box by box."""
    out = []
    for c in {r[1] for r in rows}:
        live = {}
        for f in sorted({r[2] for r in rows if r[1] == c}):
            live = {t: v for t, v in live.items() if f - v[0] <= max_gap}
            free = set(live)
            for sure in (True, False):
                boxes = {r[4]: r[5:9] for r in sorted(rows, key=lambda r: r[4]) if r[1:3] == (c, f) and r[9] >= low and (r[9] >= high) == sure}
                for _, d, t in sorted((-o, d, t) for d, b in boxes.items() for t in free if (o := streams.overlap(live[t][1], b)) >= iou_min):
                    if t in free and d in boxes:
                        free.discard(t)
                        live[t] = (f, boxes.pop(d))
                        out.append((c if c is not None else -1, f, d, t))
                for d, b in boxes.items() if sure else ():
                    live[d] = (f, b)
                    out.append((c if c is not None else -1, f, d, d))
    return sorted(out)


def tracked(spark, rows, path, **options):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in/a")
    source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    df = streams.track_stream(streams.closable(source, f"{path}/closing"), delay="1 second", **options)
    return streams.run_to_end(df, f"{path}/out", f"{path}/checkpoint", f"{path}/closing")


def test_cameras_of_one_shard(spark, tmp_path, monkeypatch):
    """All cameras in one shard (one has no number), few pairs at once: each camera's own tracks."""
    monkeypatch.setattr(streams.Tracker, "PAIRS", 3)
    rows = frames(random.Random(11), [*range(12), 2**60 + 1, None])
    found = tracked(spark, rows, tmp_path, max_gap=5, shards=1).collect()
    assert {r.run for r in found} == {"r"}
    assert sorted((-1 if r.camera_id is None else r.camera_id, r.frame, r.det_id, r.track_id) for r in found) == followed(rows)


def test_calls_do_not_grow_with_cameras(spark, tmp_path):
    """Frames are worked on by shard, not by camera."""
    rows = [("r", c, f, T0 + dt.timedelta(milliseconds=100 * f), 10 * c + f, 0.0, 0.0, 9.0, 9.0, 0.9) for c in range(50) for f in range(2)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    df = streams.track_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/a"), shards=3)
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "shard" in plan.split("TransformWithState")[1].split("\n")[0]


def test_state_in_bytes():
    import numpy as np

    columns = {"a": "long", "b": "boolean", "c": "double", "d": "string"}
    values = [np.array([1, -(2**62)]), np.array([True, False]), np.array([0.5, np.inf]), np.array(["", "xé"], object)]
    for own, back in zip(values, streams.unpack(columns, streams.pack(columns, values))):
        assert own.tolist() == back.tolist()
    assert [c.tolist() for c in streams.unpack(columns, streams.pack(columns, [v[:0] for v in values]))] == [[], [], [], []]
