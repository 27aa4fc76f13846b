"""What sources and sinks leave on disk."""

import glob

from safesight import registry, registry_io
from safesight.sources import writers


def test_detections_are_written_compressed(spark, sf, tmp_path, monkeypatch):
    paths = iter(f"{tmp_path}/{k}" for k in range(3))
    monkeypatch.setattr(registry_io, "folder", lambda spark: next(paths))
    assert registry.queries()["s4_read_detections"](spark, sf).count() == 12
    for k, end in enumerate(("zstd.parquet", "json.gz", "csv.gz")):
        assert glob.glob(f"{tmp_path}/{k}/part-*.{end}")


def test_label_files_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(40).selectExpr("'train' AS split", "concat('i', id) AS image_id", "0 AS cls", "0.5D AS cx", "0.5D AS cy", "0.1D AS w", "0.1D AS h")
    writers.write_yolo(rows.unionByName(rows), f"{tmp_path}/y")
    files = glob.glob(f"{tmp_path}/y/split=train/image_id=*/part-*.txt")
    assert len(files) == 40
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f in files}) > 4
