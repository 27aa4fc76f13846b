"""Association of protective equipment with persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from safesight.functions.geometry import box, containment, head_region, intersection, proximity, torso_region
from safesight.lineage import large
from safesight.operators.matching import dominant_pairs
from safesight.schemas import FRAME, HEAD, HELMET, PERSON, VEST

WEIGHTS = (0.5, 0.3, 0.2)


def association_candidates(dets: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Scored pairs of a person and a piece of equipment of one frame whose box meets the person's region.

    Heads and helmets are held against the head region, vests against the torso
    region. Score: weighted containment, proximity and confidence, to 9 decimals.
    """
    # both regions of a person as plain columns: expressions over pairs stay small enough to be compiled
    p = box()
    regions = [r[c].alias(f"{name}{c}") for name, r in (("h", head_region(p)), ("t", torso_region(p))) for c in ("y1", "y2")]
    persons = dets.where(F.col("cls") == PERSON).select(*FRAME, F.col("det_id").alias("person_det_id"), p["x1"].alias("rx1"), p["x2"].alias("rx2"), *regions)
    items = dets.where(F.col("cls").isin(HEAD, HELMET, VEST)).select(*FRAME, "cls", F.col("det_id").alias("ppe_det_id"), "x1", "y1", "x2", "y2", "conf")
    edge = lambda c: F.when(F.col("cls") == VEST, F.col(f"t{c}")).otherwise(F.col(f"h{c}"))
    b, r = box(), box("rx1", edge("y1"), "rx2", edge("y2"))
    met = items.join(large(persons), FRAME).where(intersection(b, r) > 0)
    score = weights[0] * containment(b, r) + weights[1] * proximity(b, r) + weights[2] * F.col("conf")
    return met.select(*FRAME, "cls", "person_det_id", "ppe_det_id", F.round(score, 9).alias("score"))


def associate(cands: DataFrame, mode: str = "one_to_one") -> DataFrame:
    """Greedy assignment by score, ties by smaller ppe_det_id, then person_det_id.

    box_unique: each box goes to its best person. one_to_one: besides, a person
    gets one box of a class at most (see dominant_pairs). A group is one
    class in one frame. Scores may tie; a pair is there once, as association_candidates() returns it.
    """
    if mode == "box_unique":
        best = Window.partitionBy(*FRAME, "cls", "ppe_det_id").orderBy(F.desc("score"), "person_det_id")
        return cands.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    if mode != "one_to_one":
        raise ValueError(mode)
    taken = dominant_pairs(cands, [*FRAME, "cls"], "person_det_id", "ppe_det_id", F.struct("score", -F.col("ppe_det_id"), -F.col("person_det_id")), dealt=True)
    return taken.select(*FRAME, "cls", "person_det_id", "ppe_det_id", "score")


def frame_status(persons: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per track and frame: the person box, what is matched, helmet_state and vest_state.

    persons: person detections with track_id. A helmet wins over a bare head; a bare
    head alone is missing; neither is unknown. A vest that is not matched is missing.
    """
    has = assignments.groupBy(*FRAME, F.col("person_det_id").alias("det_id")).agg(*(F.bool_or(F.col("cls") == c).alias(n) for n, c in (("has_head", HEAD), ("has_helmet", HELMET), ("has_vest", VEST))))
    joined = persons.join(large(has), [*FRAME, "det_id"], "left")
    flags = {n: F.coalesce(n, F.lit(False)) for n in ("has_head", "has_helmet", "has_vest")}
    out = joined.withColumns(flags)
    helmet = F.when(F.col("has_helmet"), "present").when(F.col("has_head"), "missing").otherwise("unknown")
    vest = F.when(F.col("has_vest"), "present").otherwise("missing")
    return out.select(*FRAME, "ts", "track_id", "det_id", "x1", "y1", "x2", "y2", "conf", *flags, helmet.alias("helmet_state"), vest.alias("vest_state"))
