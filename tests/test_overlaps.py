"""Suppression of overlaps by sorted batches: against a plain loop, on groups across batches, nulls and NaN."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from safesight import registry
from safesight.functions.geometry import box, iou
from safesight.operators import detect

SCHEMA = "run string, camera_id long, frame long, cls int, det_id long, conf double, x1 double, y1 double, x2 double, y2 double, note string"


def expected(df, iou_max):
    """det_ids that stay: overlaps by the expression of geometry, greedy choice by a loop."""
    b = df.select("run", "camera_id", "frame", "cls", "det_id", "conf", box().alias("b"))
    c = b.select("run", "camera_id", "frame", "cls", F.col("det_id").alias("other"), F.col("b").alias("c"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ("run", "camera_id", "frame", "cls")]
    met = b.alias("l").join(c.alias("r"), same[0] & same[1] & same[2] & same[3]).where(iou(F.col("c"), F.col("b")) > iou_max)
    near = {(r.other, r.det_id) for r in met.select("other", "det_id").collect()}
    rows = b.orderBy(-F.col("conf"), "det_id").collect()
    kept = []
    for r in rows:
        if not any(k[:4] == r[:4] and (k.det_id, r.det_id) in near for k in kept):
            kept.append(r)
    return sorted(k.det_id for k in kept)


def rows(n, seed, odd):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = (float(rng.randrange(k)) for k in (12, 12, 9, 9))
        b = [x, y, x + w, y + h]
        if odd and rng.random() < 0.3:
            b[rng.randrange(4)] = rng.choice([None, float("nan"), float("inf"), float("-inf"), -5.0])
        conf = rng.choice([None, float("nan"), 0.5, 0.9]) if odd else rng.choice([0.5, 0.7, 0.9])
        run, camera = (rng.choice([None, "a"]), rng.choice([None, 1])) if odd else ("a", 1)
        out.append((run, camera, rng.randrange(6), rng.randrange(2), i, conf, *b, f"n{i}"))
    return out


@pytest.mark.parametrize("odd, batch", list(itertools.product([False, True], [3, 10_000])))
def test_as_greedy_choice(spark, odd, batch):
    df = spark.createDataFrame(rows(150, 3, odd), SCHEMA)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = detect.suppress_overlaps(df, 0.3)
        assert found.columns == df.columns
        assert sorted(r.det_id for r in found.collect()) == expected(df, 0.3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_crowded_and_other_groups(spark, monkeypatch):
    monkeypatch.setattr(detect, "CROWD", 12)
    df = spark.createDataFrame(rows(120, 5, False), SCHEMA)
    assert df.groupBy("frame", "cls").count().where("count > 12").count() not in (0, 12)
    found = detect.suppress_overlaps(df)
    assert sorted(r.det_id for r in found.collect()) == expected(df, 0.5)


def test_whole_numbers_and_no_rows(spark):
    df = spark.sql("SELECT 'a' AS run, 1L AS camera_id, 1L AS frame, 0 AS cls, id AS det_id, 0.5D AS conf, 0 AS x1, 0 AS y1, 10 AS x2, 10 AS y2 FROM range(3)")
    assert [r.det_id for r in detect.suppress_overlaps(df).collect()] == [0]
    assert detect.suppress_overlaps(df.where("det_id < 0")).collect() == []


def test_folded_by_batches_not_by_lists(spark, sf):
    plan = registry.queries()["t3_suppress_overlaps"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan
