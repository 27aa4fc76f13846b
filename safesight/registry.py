"""Registered queries of the safety operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from safesight.functions import geometry as g
from safesight.lineage import large
from safesight.operators import associate, detect, temporal, track
from safesight.plans import detections as plan
from safesight.plans import sql
from safesight.plans.sql import query

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a query under a name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if oracle:
            _SQL[name] = oracle
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as microseconds, so that engines agree."""
    return df.select(*(F.unix_micros(F.col(c).cast("timestamp")).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to a function of (spark, sf_dir)."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL with the same rows."""
    _load()
    return dict(_SQL)


def _load() -> None:
    from safesight import registry_data, registry_io, registry_stream  # noqa: F401  they register on import

    # the largest result comes last
    for found in (_QUERIES, _SQL):
        found["detections"] = found.pop("detections")


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = plan.detections(spark, sf_dir)
    return plan.status_of(dets, plan.true_tracks(dets))


# detections and geometry


@register("detections", query(sql.DET, "SELECT * FROM det"))
def _(spark, sf_dir):
    return plan.detections(spark, sf_dir)


@register("g_box_geometry", query(sql.DET, f"""
SELECT p.det_id AS a, b.det_id AS b, round({sql.iou("p", "b")}, 9) AS iou, round({sql.inter("p", "b")} / ((b.x2-b.x1)*(b.y2-b.y1)), 9) AS containment,
  round(greatest(0.0, 1 - sqrt(pow((p.x1+p.x2)/2-(b.x1+b.x2)/2, 2) + pow((p.y1+p.y2)/2-(b.y1+b.y2)/2, 2)) / sqrt(pow(p.x2-p.x1, 2) + pow(p.y2-p.y1, 2))), 9) AS proximity,
  round((p.x1+p.x2)/2/1000, 9) AS cx, round((p.y2-p.y1)/500, 9) AS h, greatest(0.0, least(p.x1, 1000.0)) AS clipped,
  round(p.y1 + (p.y2-p.y1)*0.3, 9) AS head_bottom, round(p.y1 + (p.y2-p.y1)*0.25, 9) AS torso_top, round(p.y1 + (p.y2-p.y1)*0.75, 9) AS torso_bottom, p.x2 AS right_again
FROM det p JOIN det b ON p.camera_id = b.camera_id AND p.frame = b.frame AND p.cls = 0 AND b.cls = 3 AND p.det_id // 160 = b.det_id // 160"""))
def _(spark, sf_dir):
    d = plan.detections(spark, sf_dir)
    p = d.where("cls = 0").select("camera_id", "frame", F.col("det_id").alias("a"), g.box().alias("p"))
    b = d.where("cls = 3").select("camera_id", "frame", F.col("det_id").alias("b"), g.box().alias("q"))
    met = p.join(large(b), ["camera_id", "frame"]).where("a div 160 = b div 160")
    p, q = F.col("p"), F.col("q")
    centre = g.xyxy_to_cxcywh(p, F.lit(1000), F.lit(500))
    return met.select("a", "b", F.round(g.iou(p, q), 9).alias("iou"), F.round(g.containment(q, p), 9).alias("containment"), F.round(g.proximity(q, p), 9).alias("proximity"), F.round(centre["cx"], 9).alias("cx"), F.round(centre["h"], 9).alias("h"), g.clip_box(p, F.lit(1000), F.lit(500))["x1"].alias("clipped"), F.round(g.head_region(p)["y2"], 9).alias("head_bottom"), F.round(g.torso_region(p)["y1"], 9).alias("torso_top"), F.round(g.torso_region(p)["y2"], 9).alias("torso_bottom"), F.round(g.cxcywh_to_xyxy(centre, F.lit(1000), F.lit(500))["x2"], 9).alias("right_again"))


@register("t1_filter_detections", query(sql.DET, "SELECT det_id, cls, conf FROM det WHERE conf >= 0.7 AND cls IN (1, 3)"))
def _(spark, sf_dir):
    return detect.filter_detections(plan.detections(spark, sf_dir), 0.7, [1, 3]).select("det_id", "cls", "conf")


def _tiled(spark, sf_dir):
    d = plan.detections(spark, sf_dir)
    shifted = d.where("det_id % 3 = 0").withColumns({"det_id": F.col("det_id") + 100_000_000, "conf": (F.round(F.col("conf") * 100) - 5) / 100, "tile_x": F.lit(100.0), "tile_y": F.lit(50.0)})
    local = shifted.withColumns({c: F.col(c) + v for c, v in (("x1", -98), ("x2", -98), ("y1", -49), ("y2", -49))})
    return detect.tiles_to_frame(local, d)


TILED = """til AS (SELECT * FROM det UNION ALL SELECT run, camera_id, frame, ts, det_id + 100000000, cls, x1+2, y1+1, x2+2, y2+1, (round(conf*100)-5)/100 FROM det WHERE det_id % 3 = 0)"""


@register("t2_tiles_to_frame", query(sql.DET, TILED, "SELECT * FROM til"))
def _(spark, sf_dir):
    return _tiled(spark, sf_dir)


@register("t3_suppress_overlaps", query(sql.DET, TILED, """
o AS (SELECT *, row_number() OVER (PARTITION BY camera_id, frame, cls ORDER BY conf DESC, det_id) AS rn FROM til)""", f"""
s AS (SELECT camera_id, frame, cls, rn, det_id, TRUE AS keep, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS held FROM o WHERE rn = 1
  UNION ALL SELECT o.camera_id, o.frame, o.cls, o.rn, o.det_id, len(list_filter(s.held, lambda b: {sql.iou("b", "o")} > 0.5)) = 0,
    CASE WHEN len(list_filter(s.held, lambda b: {sql.iou("b", "o")} > 0.5)) = 0 THEN list_append(s.held, {{'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) ELSE s.held END
  FROM s JOIN o ON o.camera_id = s.camera_id AND o.frame = s.frame AND o.cls = s.cls AND o.rn = s.rn + 1)""", "SELECT camera_id, frame, cls, det_id FROM s WHERE keep"))
def _(spark, sf_dir):
    return detect.suppress_overlaps(_tiled(spark, sf_dir)).select("camera_id", "frame", "cls", "det_id")


# tracking


@register("k1_link_detections", query(sql.DET, sql.LINKS, "SELECT * FROM lnk"))
def _(spark, sf_dir):
    return track.link_detections(plan.detections(spark, sf_dir).where("cls = 0"))


@register("k2_assign_tracks", query(sql.DET, sql.LINKS, sql.TRACKS, "SELECT camera_id, frame, det_id, track_id FROM trk"))
def _(spark, sf_dir):
    return plan.linked_tracks(plan.detections(spark, sf_dir)).select("camera_id", "frame", "det_id", "track_id")


@register("k3_track_summary", query(sql.DET, sql.TRUE_TRACKS, """
SELECT run, camera_id, track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_frames, round(avg(conf), 6) AS mean_conf, round(avg(x1), 6) AS mean_x1, round(avg(y1), 6) AS mean_y1,
  round(avg(x2), 6) AS mean_x2, round(avg(y2), 6) AS mean_y2, round(sqrt(pow(arg_max((x1+x2)/2, frame) - arg_min((x1+x2)/2, frame), 2) + pow(arg_max((y1+y2)/2, frame) - arg_min((y1+y2)/2, frame), 2)), 6) AS displacement
FROM trk GROUP BY ALL"""))
def _(spark, sf_dir):
    return track.track_summary(plan.true_tracks(plan.detections(spark, sf_dir)))


# association


@register("a1_association_candidates", query(sql.DET, sql.CAND, "SELECT * FROM cand"))
def _(spark, sf_dir):
    return associate.association_candidates(plan.detections(spark, sf_dir))


@register("a2_associate_one_to_one", query(sql.DET, sql.CAND, sql.ONE, "SELECT * FROM asg"))
def _(spark, sf_dir):
    return associate.associate(associate.association_candidates(plan.detections(spark, sf_dir)))


@register("a2_associate_box_unique", query(sql.DET, sql.CAND, """
SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.camera_id = c.camera_id AND o.frame = c.frame AND o.ppe_det_id = c.ppe_det_id
  AND (o.score > c.score OR (o.score = c.score AND o.person_det_id < c.person_det_id)))"""))
def _(spark, sf_dir):
    return associate.associate(associate.association_candidates(plan.detections(spark, sf_dir)), "box_unique")


@register("a3_frame_status", query(*sql.TRUE_STATUS, "SELECT * FROM sta"))
def _(spark, sf_dir):
    return _status(spark, sf_dir)


# temporal rules and events


@register("e1_violations", query(*sql.TRUE_STATUS, sql.VIOL, "SELECT * FROM vio"))
def _(spark, sf_dir):
    return temporal.violations(_status(spark, sf_dir))


@register("e2_rule_consecutive", query(*sql.TRUE_STATUS, sql.VIOL, sql.RUNS, "SELECT run, camera_id, track_id, violation, first_frame AS start_frame, first_ts AS start_ts, frame AS confirm_frame, ts AS confirm_ts FROM runs WHERE nth = 5"))
def _(spark, sf_dir):
    return temporal.rule_consecutive(temporal.violations(_status(spark, sf_dir)))


@register("e3_rule_majority", query(*sql.TRUE_STATUS, sql.VIOL, """
SELECT run, camera_id, track_id, violation, frame, ts, round(share, 9) AS share FROM (SELECT *, avg(flag::INT) OVER w AS share, count(*) OVER w AS n FROM vio
  WINDOW w AS (PARTITION BY run, camera_id, track_id, violation ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE n = 10 AND share > 0.5"""))
def _(spark, sf_dir):
    return temporal.rule_majority(temporal.violations(_status(spark, sf_dir)))


@register("e4_rule_duration", query(*sql.TRUE_STATUS, sql.VIOL, sql.RUNS, """
SELECT run, camera_id, track_id, violation, first_frame AS start_frame, min(frame) AS confirm_frame, round(min(ts - first_ts) / 1e6, 6) AS seconds FROM runs WHERE ts - first_ts >= 1000000 GROUP BY ALL"""))
def _(spark, sf_dir):
    return temporal.rule_duration(temporal.violations(_status(spark, sf_dir)))


@register("e5_build_events", query(*sql.TRUE_EVENTS, "SELECT * FROM evt"))
def _(spark, sf_dir):
    return plan.events_of(_status(spark, sf_dir))


@register("e6_select_evidence", query(*sql.TRUE_EVENTS, sql.EVIDENCE, "SELECT * FROM evi"))
def _(spark, sf_dir):
    status = _status(spark, sf_dir)
    return temporal.select_evidence(plan.events_of(status), status)


@register("e7_clip_ranges", query(*sql.TRUE_EVENTS, sql.CLIPS, "SELECT * FROM clp"))
def _(spark, sf_dir):
    return temporal.clip_ranges(plan.events_of(_status(spark, sf_dir)))


@register("d_full_system_events", query(*sql.LINKED_EVENTS, "SELECT * FROM evt"))
def _(spark, sf_dir):
    dets = plan.detections(spark, sf_dir)
    return plan.events_of(plan.status_of(dets, plan.linked_tracks(dets)))
