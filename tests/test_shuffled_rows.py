"""Boxes of a camera are together from the start: what links, associates and matches them shuffles none."""

import re

import pytest

from safesight import registry
from safesight.lineage import cut
from safesight.operators import associate, matching, segments, temporal, track
from safesight.plans import detections, profiles


def dealt(df):
    """Exchanges that deal rows by more than the camera of a worker."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.findall(r"Exchange hashpartitioning\(([^\n]*)", plan) if "REPARTITION_BY_NUM" not in x]


def watched(monkeypatch):
    seen = []

    def f(df):
        seen.append((set(df.columns), len(dealt(df))))
        return cut(df)

    for module in (detections, matching, segments, temporal, track):
        monkeypatch.setattr(module, "cut", f)
    return seen


@pytest.mark.parametrize("name", ["a1_association_candidates", "g_box_geometry"])
def test_joins_within_frames(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == plan.count("REPARTITION_BY_NUM") > 0


def test_matching_of_boxes(spark, sf, monkeypatch):
    seen = watched(monkeypatch)
    registry.queries()["v1_detector_ap"](spark, sf)
    first = next(n for columns, n in seen if "_free" in columns)
    assert first == 0


def test_chain_to_events(spark, sf, monkeypatch):
    """Links are found without an exchange; following them and the states of persons deal links and matched pairs alone."""
    seen = watched(monkeypatch)
    registry.queries()["d_full_system_events"](spark, sf)
    by = {name: next(n for columns, n in seen if name in columns) for name in ("tier", "_free")}
    assert by == {"tier": 0, "_free": 0}
    # both anti-joins and the join with all links read the table of links: an exchange each
    assert next(n for columns, n in seen if {"track_id", "up", "x1"} <= columns) <= 3


@pytest.mark.parametrize(("name", "linked"), [("p6_ablation_table", 2), ("p5_compare_profiles", 1), ("p5_profile_accuracy", 1)])
def test_settings_share_steps(spark, sf, monkeypatch, name, linked):
    """Equipment is matched once, persons and heads are linked once each, whatever the number of settings."""
    calls = {"pairs": 0, "links": 0}

    def counted(module, f, key):
        def g(*args, **options):
            calls[key] += 1
            return f(*args, **options)

        monkeypatch.setattr(module, f.__name__, g)

    counted(associate, matching.dominant_pairs, "pairs")
    for module in (detections, profiles):
        counted(module, track.link_detections, "links")
    registry.queries()[name](spark, sf)
    # heads once for either setting of the engine; without tracking they are not linked
    assert calls == {"pairs": 1, "links": linked}


def test_ablation_table_counts_each_setting(spark, sf):
    dets = detections.detections(spark, sf).where("camera_id < 12")
    rows = profiles.ablation_table(dets).collect()
    assert len(rows) == 8
    for r in rows:
        assert profiles.ablate(dets, r.tracking, r.association, r.engine).count() == r.alerts
