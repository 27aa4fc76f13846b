"""Chains over the edges of blocks, and the bytes that linking shuffles."""

import pytest
from pyspark.sql import functions as F

from safesight.operators import track
from safesight.plans import detections as plan


@pytest.mark.parametrize("block", [1, 3, 16])
def test_chains_over_blocks(spark, sf, monkeypatch, block):
    dets = plan.detections(spark, sf).where("camera_id < 3")
    want = sorted(map(tuple, plan.linked_tracks(dets).select("det_id", "track_id").collect()))
    monkeypatch.setattr(track, "BLOCK", block)
    assert sorted(map(tuple, plan.linked_tracks(dets).select("det_id", "track_id").collect())) == want


def test_links_are_found_by_three_joins(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(track, "large", lambda df: made.append(df) or df.hint("merge"))
    track.link_detections(plan.detections(spark, sf).where("cls = 0")).count()
    # tiers 1 and 2 by one, two for what is left over, one for gaps
    assert len(made) == 4


def test_tiers_of_one_step(spark):
    """Boxes 1 and 2 are sure, 3 is not and overlaps more: tier 1 goes first, tier 2 takes what is left."""
    row = lambda frame, det, conf, x: ("r", 1, frame, det, conf, float(x), 0.0, float(x + 100), 100.0)
    rows = [row(0, 1, 0.9, 0), row(1, 2, 0.9, 20), row(1, 3, 0.2, 5), row(0, 4, 0.2, 25)]
    dets = spark.createDataFrame(rows, "run string, camera_id long, frame long, det_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    found = track.link_detections(dets).select("prev_det_id", "det_id", "tier").collect()
    assert sorted(map(tuple, found)) == [(1, 2, 1), (4, 3, 2)]
    assert dict(track.assign_tracks(dets, track.link_detections(dets)).select("det_id", F.col("track_id")).collect()) == {1: 1, 2: 1, 3: 4, 4: 4}
