"""DuckDB SQL of the registered queries, as chains of common table expressions."""

from __future__ import annotations

DET = """
wk AS (SELECT c_custkey::BIGINT AS w, t.k AS k FROM customer, range(0, 40) t(k)),
pp AS (SELECT w, k, w // 5 AS camera_id, 100+150*(w%5)+((w%7)-3)*k AS px, 200+((w*13)%80) AS py, (w*5+k*3)%5 AS j FROM wk),
dd AS (
  SELECT camera_id, k AS frame, (w*40+k)*4 AS det_id, 0 AS cls, px AS x1, py AS y1, px+60 AS x2, py+160 AS y2,
    CASE WHEN (w+k)%9=0 THEN 30 ELSE 50+(w*7+k*11)%50 END AS c FROM pp WHERE (w*31+k*17)%23<>0
  UNION ALL SELECT camera_id, k, (w*40+k)*4+1, CASE WHEN w%4=0 AND k BETWEEN 10 AND 29 THEN 1 ELSE 2 END, px+15+j, py-5+j, px+45+j, py+30+j, 50+(w*3+k*7)%50 FROM pp WHERE (w*29+k*19)%31<>0
  UNION ALL SELECT camera_id, k, (w*40+k)*4+3, 3, px+5-j, py+45, px+55-j, py+110, 50+(w*11+k*5)%50 FROM pp WHERE NOT (w%6=1 AND k BETWEEN 5 AND 34)),
det AS (SELECT 'fixture' AS run, camera_id, frame, 1767225600000000 + frame * 100000 AS ts, det_id, cls,
  x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, c::DOUBLE / 100 AS conf FROM dd)"""


def inter(a: str, b: str) -> str:
    """Common area of the boxes of two table aliases."""
    return f"(greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1),0.0)*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1),0.0))"


def iou(a: str, b: str) -> str:
    """Intersection over union of the boxes of two table aliases."""
    size = lambda t: f"(({t}.x2-{t}.x1)*({t}.y2-{t}.y1))"
    return f"({inter(a, b)}/({size(a)}+{size(b)}-{inter(a, b)}))"


CAND = f"""
pr AS (SELECT run, camera_id, frame, det_id, x1, x2, y1, y2 FROM det WHERE cls = 0),
rg AS (SELECT run, camera_id, frame, det_id, x1, x2, y1 + (y2-y1)*0.0 AS y1, y1 + (y2-y1)*0.3 AS y2, FALSE AS torso FROM pr
  UNION ALL SELECT run, camera_id, frame, det_id, x1, x2, y1 + (y2-y1)*0.25, y1 + (y2-y1)*0.75, TRUE FROM pr),
m0 AS (SELECT i.run, i.camera_id, i.frame, i.cls, r.det_id AS person_det_id, i.det_id AS ppe_det_id, i.conf, {inter("i", "r")} AS s,
    (i.x2-i.x1)*(i.y2-i.y1) AS own, (i.x1+i.x2)/2-(r.x1+r.x2)/2 AS dx, (i.y1+i.y2)/2-(r.y1+r.y2)/2 AS dy, r.x2-r.x1 AS w, r.y2-r.y1 AS h
  FROM det i JOIN rg r ON i.run = r.run AND i.camera_id = r.camera_id AND i.frame = r.frame AND r.torso = (i.cls = 3) WHERE i.cls IN (1,2,3)),
cand AS (SELECT run, camera_id, frame, cls, person_det_id, ppe_det_id,
    round(0.5*(s/own) + 0.3*greatest(0.0, 1-sqrt(dx*dx+dy*dy)/sqrt(w*w+h*h)) + 0.2*conf, 9) AS score FROM m0 WHERE s > 0)"""

ONE = """
cr AS (SELECT *, row_number() OVER (PARTITION BY run, camera_id, frame, cls ORDER BY score DESC, ppe_det_id, person_det_id) AS rn FROM cand),
fold AS (SELECT run, camera_id, frame, cls, rn, person_det_id, ppe_det_id, score, TRUE AS take, [person_det_id] AS ps, [ppe_det_id] AS bs FROM cr WHERE rn = 1
  UNION ALL SELECT c.run, c.camera_id, c.frame, c.cls, c.rn, c.person_det_id, c.ppe_det_id, c.score,
    NOT (list_contains(f.ps, c.person_det_id) OR list_contains(f.bs, c.ppe_det_id)),
    CASE WHEN list_contains(f.ps, c.person_det_id) OR list_contains(f.bs, c.ppe_det_id) THEN f.ps ELSE list_append(f.ps, c.person_det_id) END,
    CASE WHEN list_contains(f.ps, c.person_det_id) OR list_contains(f.bs, c.ppe_det_id) THEN f.bs ELSE list_append(f.bs, c.ppe_det_id) END
  FROM fold f JOIN cr c ON c.run = f.run AND c.camera_id = f.camera_id AND c.frame = f.frame AND c.cls = f.cls AND c.rn = f.rn + 1),
asg AS (SELECT run, camera_id, frame, cls, person_det_id, ppe_det_id, score FROM fold WHERE take)"""

TRUE_TRACKS = "trk AS (SELECT *, det_id // 160 AS track_id FROM det WHERE cls = 0)"

STATUS = """
hs AS (SELECT run, camera_id, frame, person_det_id AS det_id, bool_or(cls=1) AS has_head, bool_or(cls=2) AS has_helmet, bool_or(cls=3) AS has_vest FROM asg GROUP BY ALL),
sta AS (SELECT t.run, t.camera_id, t.frame, t.ts, t.track_id, t.det_id, t.x1, t.y1, t.x2, t.y2, t.conf, coalesce(has_head, FALSE) AS has_head, coalesce(has_helmet, FALSE) AS has_helmet, coalesce(has_vest, FALSE) AS has_vest,
    CASE WHEN has_helmet THEN 'present' WHEN has_head THEN 'missing' ELSE 'unknown' END AS helmet_state, CASE WHEN has_vest THEN 'present' ELSE 'missing' END AS vest_state
  FROM trk t LEFT JOIN hs USING (run, camera_id, frame, det_id))"""

VIOL = """
vio AS (SELECT run, camera_id, track_id, frame, ts, det_id, 'NO_HELMET' AS violation, helmet_state = 'missing' AS flag FROM sta WHERE helmet_state <> 'unknown'
  UNION ALL SELECT run, camera_id, track_id, frame, ts, det_id, 'NO_VEST', vest_state = 'missing' FROM sta WHERE vest_state <> 'unknown')"""

# a run's id in this formulation: the frame of its first row, by comparing with the row before
RUNS = """
b1 AS (SELECT *, lag(flag) OVER w AS pf, lag(frame) OVER w AS pk FROM vio WINDOW w AS (PARTITION BY run, camera_id, track_id, violation ORDER BY frame)),
b2 AS (SELECT *, max(CASE WHEN flag AND NOT coalesce(pf AND frame - pk <= 5, FALSE) THEN frame END) OVER (PARTITION BY run, camera_id, track_id, violation ORDER BY frame) AS first_frame FROM b1),
runs AS (SELECT * EXCLUDE (pf, pk), row_number() OVER w AS nth, first_value(ts) OVER w AS first_ts FROM b2 WHERE flag WINDOW w AS (PARTITION BY run, camera_id, track_id, violation, first_frame ORDER BY frame))"""

EVENTS = """
rn AS (SELECT run, camera_id, track_id, violation, first_frame AS s, max(frame) AS e, max(CASE WHEN nth = 5 THEN frame END) AS c, min(ts) AS st, max(ts) AS et, count(*) AS n
  FROM runs GROUP BY ALL HAVING count(*) >= 5),
rg2 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY run, camera_id, track_id, violation ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 10 THEN 0 ELSE 1 END AS far FROM rn),
rg3 AS (SELECT *, sum(far) OVER (PARTITION BY run, camera_id, track_id, violation ORDER BY s) AS g FROM rg2),
evt AS (SELECT sha256(run || '|' || camera_id || '|' || track_id || '|' || violation || '|' || min(s)) AS event_id, run, camera_id, track_id, violation,
    min(s) AS start_frame, min(c) AS confirm_frame, max(e) AS end_frame, min(st) AS start_ts, max(et) AS end_ts, sum(n)::BIGINT AS n_frames FROM rg3 GROUP BY run, camera_id, track_id, violation, g)"""

EVIDENCE = """
evi AS (SELECT event_id, rank, frame, det_id, conf, x1, y1, x2, y2 FROM (
  SELECT e.event_id, s.frame, s.det_id, s.conf, s.x1, s.y1, s.x2, s.y2, row_number() OVER (PARTITION BY e.event_id ORDER BY s.conf DESC, s.frame)::INT AS rank
  FROM evt e JOIN sta s ON s.run = e.run AND s.camera_id = e.camera_id AND s.track_id = e.track_id AND s.frame BETWEEN e.start_frame AND e.end_frame) WHERE rank <= 3)"""

CLIPS = """
pd AS (SELECT run, camera_id, event_id, greatest(0, start_frame - 25) AS f, end_frame + 25 AS t FROM evt),
pe AS (SELECT *, CASE WHEN f <= max(t) OVER (PARTITION BY run, camera_id ORDER BY f, t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM pd),
pf AS (SELECT *, sum(new) OVER (PARTITION BY run, camera_id ORDER BY f, t, event_id) AS g FROM pe),
clp AS (SELECT run, camera_id, min(f) AS from_frame, max(t) AS to_frame, list_sort(list(event_id)) AS event_ids FROM pf GROUP BY run, camera_id, g)"""


def _link(name: str, ends: str, starts: str, low: int, high: int, tier: int) -> str:
    return f"""
{name}m AS (SELECT a.run, a.camera_id, a.det_id AS prev_det_id, b.det_id, b.frame - a.frame AS gap, round({iou("a", "b")}, 9) AS iou
  FROM {ends} a JOIN {starts} b ON a.run = b.run AND a.camera_id = b.camera_id AND b.frame - a.frame BETWEEN {low} AND {high}),
{name} AS (SELECT run, camera_id, prev_det_id, det_id, gap, iou, {tier} AS tier FROM (SELECT *,
    row_number() OVER (PARTITION BY run, camera_id, prev_det_id ORDER BY gap, iou DESC, det_id) AS r1,
    row_number() OVER (PARTITION BY run, camera_id, det_id ORDER BY gap, iou DESC, prev_det_id) AS r2 FROM {name}m WHERE iou >= 0.3) WHERE r1 = 1 AND r2 = 1)"""


LINKS = (
    "seen AS (SELECT * FROM det WHERE cls = 0 AND conf >= 0.1), sure AS (SELECT * FROM seen WHERE conf >= 0.5),"
    + _link("l1", "sure", "sure", 1, 1, 1)
    + ", e2 AS (SELECT * FROM seen WHERE det_id NOT IN (SELECT prev_det_id FROM l1)), s2 AS (SELECT * FROM seen WHERE det_id NOT IN (SELECT det_id FROM l1)),"
    + _link("l2", "e2", "s2", 1, 1, 2)
    + ", l12 AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2), e3 AS (SELECT * FROM seen WHERE det_id NOT IN (SELECT prev_det_id FROM l12)), s3 AS (SELECT * FROM sure WHERE det_id NOT IN (SELECT det_id FROM l12)),"
    + _link("l3", "e3", "s3", 2, 30, 3)
    + ", lnk AS (SELECT * FROM l12 UNION ALL SELECT * FROM l3)"
)

TRACKS = """
chain AS (SELECT det_id, det_id AS track_id FROM det WHERE cls = 0 AND det_id NOT IN (SELECT det_id FROM lnk)
  UNION ALL SELECT l.det_id, c.track_id FROM chain c JOIN lnk l ON l.prev_det_id = c.det_id),
trk AS (SELECT d.*, c.track_id FROM det d JOIN chain c USING (det_id) WHERE d.cls = 0)"""


def query(*parts: str) -> str:
    """WITH RECURSIVE the parts but the last, which selects."""
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1]


TRUE_STATUS = (DET, CAND, ONE, TRUE_TRACKS, STATUS)
TRUE_EVENTS = (*TRUE_STATUS, VIOL, RUNS, EVENTS)
LINKED_EVENTS = (DET, CAND, ONE, LINKS, TRACKS, STATUS, VIOL, RUNS, EVENTS)
