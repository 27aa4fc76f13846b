"""Joins of rows that an explode() made are not broadcast, however few Spark takes them for."""

import pytest
from pyspark.sql import functions as F

from safesight import registry
from safesight.lineage import cut
from safesight.operators import dataset, matching, segments, temporal, track
from safesight.plans import detections


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [k for k in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "SortMergeJoin") if k in plan]


@pytest.mark.parametrize("name", ["a1_association_candidates", "a2_associate_box_unique", "d4_audit_labels", "d13_vest_candidates", "d14_propose_dual", "g_box_geometry"])
def test_no_broadcast(spark, sf, name):
    assert joins(registry.queries()[name](spark, sf)) == ["SortMergeJoin"]


@pytest.mark.parametrize("name", ["d_full_system_events", "v4_event_accuracy"])
def test_chain_without_broadcast(spark, sf, monkeypatch, name):
    """Every table that is cut on the way to events is made by merged joins, as is what is left to run."""
    seen = []

    def watched(df):
        seen.append(joins(df))
        return cut(df)

    for module in (detections, matching, segments, temporal, track):
        monkeypatch.setattr(module, "cut", watched)
    df = registry.queries()[name](spark, sf)
    assert "SortMergeJoin" in sum(seen, []) and set(sum(seen, [])) == {"SortMergeJoin"}
    assert df.count() > 0


def test_cut_is_read_from_a_table(spark):
    df = spark.range(100).select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), F.struct(F.lit(None).cast("double").alias("x"), F.current_timestamp().alias("t")).alias("s"))
    found = cut(df)
    assert found.dtypes == df.dtypes and found.count() == 300
    assert "FileScan parquet" in found._jdf.queryExecution().executedPlan().toString()


def test_cut_of_nothing(spark):
    assert cut(spark.range(0)).collect() == []


def test_dual_boxes_by_one_join(spark, sf):
    """Pairs and single boxes from one join of the models."""
    plan = registry.queries()["d14_propose_dual"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_single_boxes_that_overlap_others(spark):
    """Box 2 loses box 10 to box 1, box 11 has no pair, box 12 is in another image; each is there once."""
    row = lambda image, box, x: (image, 0, box, float(x), 0.0, float(x + 10), 10.0)
    schema = "image_id long, cls int, box_id long, x1 double, y1 double, x2 double, y2 double"
    m1 = spark.createDataFrame([row(1, 1, 0), row(1, 2, 2), row(1, 3, 50)], schema)
    m2 = spark.createDataFrame([row(1, 10, 0), row(1, 11, 80), row(2, 12, 0)], schema)
    found = [(r.image_id, r.box_1, r.box_2, r.kind) for r in dataset.propose_dual(m1, m2).collect()]
    assert sorted(found, key=str) == [(1, 1, 10, "dual"), (1, 2, None, "single"), (1, 3, None, "single"), (1, None, 11, "single"), (2, None, 12, "single")]
