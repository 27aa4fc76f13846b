"""Ids of boxes may be there again in another camera: each is matched and marked by itself."""

import datetime as dt

from safesight.operators import evaluate
from safesight.schemas import DETECTIONS


def test_average_precision_with_ids_that_cameras_share(spark):
    at = dt.datetime(2026, 1, 1)
    row = lambda camera, det, x, conf: ("r", camera, 0, at, det, 0, float(x), 0.0, float(x + 10), 10.0, conf)
    truth = spark.createDataFrame([row(0, 5, 0, 1.0), row(1, 6, 0, 1.0)], DETECTIONS).withColumnRenamed("det_id", "truth_id")
    # box 1 is right in camera 0 and wrong in camera 1
    found = spark.createDataFrame([row(0, 1, 0, 0.9), row(1, 1, 50, 0.8)], DETECTIONS)
    assert {r.cls: (r.n_truth, r.ap) for r in evaluate.detector_ap(found, truth).collect()} == {0: (2, 0.5), -1: (2, 0.5)}
