"""Sinks: label files, JSON lines, CSV, event tables and run directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Time stamps in text keep their microseconds.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_yolo(df: DataFrame, path: str) -> None:
    """Boxes (split, image_id, cls, cx, cy, w, h) as label lines, one file an image under split=/image_id=; lines in order."""
    line = F.concat_ws(" ", F.col("cls").cast("string"), *(F.format_string("%.6f", c) for c in ("cx", "cy", "w", "h")))
    dealt = by_image(df.select(line.alias("value"), "split", "image_id")).sortWithinPartitions("split", "image_id", "value")
    dealt.write.partitionBy("split", "image_id").text(path)


def by_image(lines: DataFrame) -> DataFrame:
    """lines dealt by image to a fixed number of tasks: a file costs far more than its bytes, by which Spark would put all in one task."""
    return lines.repartition(4 * lines.sparkSession.sparkContext.defaultParallelism, "split", "image_id")


def write_frame_status(df: DataFrame, path: str) -> None:
    """Frame status as JSON lines."""
    df.write.option("timestampFormat", MICROS).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Any flat table as CSV with a header; quotes are doubled, as most readers of CSV expect."""
    df.write.option("header", "true").option("escape", '"').option("timestampFormat", MICROS).csv(path)


def write_events(df: DataFrame, table: str) -> None:
    """Append events to a table partitioned by run; events that the table has already are left out."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        df = df.join(spark.table(table).select("event_id"), "event_id", "left_anti").select(*spark.table(table).columns)
        df.write.insertInto(table)
    else:
        df.write.partitionBy("run").saveAsTable(table)


def write_run(df: DataFrame, root: str, run: str, name: str) -> str:
    """A table of a run under root/runs/<run>/<name>; refuses to overwrite. Returns the path."""
    path = f"{root}/runs/{run}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return path


def publish_run(spark: SparkSession, root: str, run: str, name: str, stamp: str) -> None:
    """Make a run's table the published one: root/published/<name>/CURRENT names the version that readers follow.

    The version is copied beside the others first. Then what CURRENT named is kept as
    BACKUP-<stamp>, and CURRENT is replaced by renaming a file, which is atomic: whatever
    step a crash comes after, readers see one whole version, and the call can be repeated.
    """
    own = f"{root}/published/{name}"
    spark.read.parquet(f"{root}/runs/{run}/{name}").write.mode("overwrite").parquet(f"{own}/versions/{stamp}")
    before = _pointer(spark, f"{own}/CURRENT")
    if before == stamp:
        return
    if before is not None:
        _point(spark, f"{own}/BACKUP-{stamp}", before)
    _point(spark, f"{own}/CURRENT", stamp)


def read_published(spark: SparkSession, root: str, name: str, backup: str | None = None) -> DataFrame:
    """The published table, or the one that stood there when stamp backup was published."""
    own = f"{root}/published/{name}"
    stamp = _pointer(spark, f"{own}/CURRENT" if backup is None else f"{own}/BACKUP-{backup}")
    if stamp is None:
        raise FileNotFoundError(f"nothing is published as {own}")
    return spark.read.parquet(f"{own}/versions/{stamp}")


def _pointer(spark: SparkSession, path: str) -> str | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def _point(spark: SparkSession, path: str, stamp: str) -> None:
    """Write a new file, then rename it over path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    to, new = hadoop.Path(path), hadoop.Path(f"{path}.new")
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(new, True)
    out.write(bytearray(stamp.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(new, to, options)
