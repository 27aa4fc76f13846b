"""Sources: annotations, label files, file listings and detections. Schemas are fixed, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from safesight.schemas import DETECTIONS

VOC = "filename string, size struct<width:int,height:int>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>, _corrupt_record string"


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _split_and_image(path: Column) -> tuple[Column, Column]:
    """Split and image of split/image.ext, or of split=<split>/image_id=<image>/any file, as write_yolo() makes them."""
    named = r"/split=([^/]+)/image_id=([^/]+)/[^/]+$"
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    own = F.regexp_extract(path, named, 2)
    return F.when(own != "", F.regexp_extract(path, named, 1)).otherwise(F.regexp_replace(folder, "^split=", "")), F.when(own != "", own).otherwise(_stem(path))


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """Pascal VOC XML: one row per box with image name and size; an image without objects gives one row of nulls.

    A file may hold several annotations. One that can't be read gives one row too, with its text in error and nulls else.
    """
    files = spark.read.format("xml").option("rowTag", "annotation").option("multiLine", "false").schema(VOC).load(path)
    error = F.col("_corrupt_record")
    sound = files.select(*(F.when(error.isNull(), F.col(c)).alias(c) for c in ("filename", "size", "object")), error.alias("error"))
    boxes = sound.select(F.col("filename").alias("image"), "size.width", "size.height", "error", F.inline_outer("object"))
    return boxes.select(_stem(F.col("image")).alias("image_id"), "image", "width", "height", "name", F.col("bndbox.xmin").alias("x1"), F.col("bndbox.ymin").alias("y1"), F.col("bndbox.xmax").alias("x2"), F.col("bndbox.ymax").alias("y2"), "error")


def read_yolo(spark: SparkSession, path: str) -> DataFrame:
    """Label files split/image_id.txt: one row per line; a bad line keeps its text in error. An empty file gives no row."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    parts = F.split(F.trim("value"), r"\s+")
    number = [F.get(parts, F.lit(i)).try_cast("double") for i in range(5)]
    sound = (F.size(parts) == 5) & F.get(parts, F.lit(0)).rlike(r"^\d+$")
    for n in number[1:]:
        sound = sound & n.isNotNull()
    value = lambda c: F.when(sound, c)
    split, image = _split_and_image(F.col("path"))
    return lines.where(F.trim("value") != "").select(split.alias("split"), image.alias("image_id"), value(number[0].cast("int")).alias("cls"), *(value(n).alias(c) for n, c in zip(number[1:], ("cx", "cy", "w", "h"))), F.when(~sound, F.col("value")).alias("error"))


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Listing with size and SHA-256; image id and split from the path. Content is hashed where it is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    split, image = _split_and_image(F.col("path"))
    return files.select("path", image.alias("image_id"), split.alias("split"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_detections(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = DETECTIONS) -> DataFrame:
    """Detector output as a table, from Parquet, JSON lines or CSV."""
    reader = spark.read.schema(schema)
    return (reader.option("header", "true") if fmt == "csv" else reader).format(fmt).load(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that write_csv() wrote."""
    return spark.read.schema(schema).option("header", "true").option("escape", '"').csv(path)


def stream_detections(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = DETECTIONS, per_batch: int | None = None) -> DataFrame:
    """Detections as a stream of files (a camera source is the same plan with another format)."""
    reader = spark.readStream.schema(schema)
    reader = reader if per_batch is None else reader.option("maxFilesPerTrigger", per_batch)
    return reader.format(fmt).load(path)


def training_curve(spark: SparkSession, root: str) -> DataFrame:
    """results.csv of many runs as one table: root/<run>/results.csv, or root/run=<run>/ with any CSV files."""
    schema = "epoch int, precision double, recall double, map50 double, map double"
    rows = spark.read.schema(schema).option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(root)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"/(?:run=)?([^/]+)/(?:results\.csv/)?[^/]+$", 1).alias("run"), "*")
