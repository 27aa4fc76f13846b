"""Shared helpers: reading tables, cutting lineage, words, hashes and connected components."""

from __future__ import annotations

import gc
import string
import tempfile
import time
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are what bytes.split() leaves: runs without \x20 and \x09-\x0D.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: A worker's word cache is emptied at this many entries (some 20 MB), and keeps no word over so many bytes.
CACHE_WORDS, CACHE_BYTES = 150_000, 64
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000
#: Rows and bytes of texts that a worker takes from a batch at a time (one longer text is alone).
PART_ROWS, PART_BYTES = 500, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(docs: DataFrame, *columns: Column) -> DataFrame:
    """Columns of docs for a Python stage: its Arrow batches get BATCH_ROWS rows at most from here on, as whole texts are long."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Compute df now and cut its lineage by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Compute df now into a Parquet table in the shared folder and read it back."""
    path = path or table_path(df.sparkSession)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


def forget(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage, so that Spark's cleaner deletes the shuffle files of tables that are written; it does so at long intervals otherwise.

    Twice, as what the first round lets go of still holds plans.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


#: Ids up to this many are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def by_ids(rows: DataFrame, ids: DataFrame, key: str | list[str], how: str) -> DataFrame:
    """rows with (left_semi) or without (left_anti) some ids, which are broadcast only if they are few."""
    n = ids.limit(BROADCAST_IDS + 1).count()
    return rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, how)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(modulus)


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some PART_BYTES and PART_ROWS rows at most, so that Python holds few texts at once."""
    for batch in batches:
        rows = max(1, min(PART_ROWS, PART_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def byte_rows(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column of a batch as bytes; null becomes empty."""
    i = batch.schema.get_field_index(column)
    return [x or b"" for x in batch.column(i).cast(pa.large_binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that are hashed together; a longer word is hashed alone.
SEGMENT = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15
_LOWERED = np.frombuffer(LOWER, np.uint8)
_INSIDE = np.array([c not in b" \t\n\v\f\r" for c in range(256)])
_SOLID = np.array([c not in b" \t\n\v\f\r" and c not in string.punctuation.encode() for c in range(256)])


@cache
def _powers(factor: int) -> np.ndarray:
    out = np.full(SEGMENT, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(texts: pa.Array, strip: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string column, text after text, and each text's number of words.

    Words are lower-cased (A-Z); strip: without ASCII punctuation at their ends, and
    none of punctuation alone. A word's hash is a polynomial of its bytes modulo 2^64,
    taken from running sums over all bytes at once, then scrambled.
    """
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _INSIDE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    for edge, at in ((first, offsets[:-1][full]), (last, offsets[1:][full] - 1)):
        edge[at] = inside[at]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if strip:
        solid = np.flatnonzero(_SOLID[data])
        b, e = np.searchsorted(solid, begin), np.searchsorted(solid, end)
        begin, end = solid[b[b < e]], solid[e[b < e] - 1] + 1
    out, i = np.empty(len(begin), np.uint64), 0
    while i < len(begin):
        base = begin[i]
        j = int(np.searchsorted(end, base + SEGMENT - 1, "right"))
        if j <= i:
            out[i] = xxhash.xxh3_64_intdigest(data[base : end[i]].tobytes().translate(LOWER))
            i += 1
            continue
        part = _LOWERED[data[base : end[j - 1]]].astype(np.uint64) + np.uint64(1)
        part *= _powers(_FACTOR)[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        out[i:j] = (sums[end[i:j] - base] - sums[begin[i:j] - base]) * _powers(pow(_FACTOR, -1, 1 << 64))[begin[i:j] - base]
        i = j
    return mix(out), np.diff(np.searchsorted(begin, offsets))


def per_text(hashes: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The hashes of one text after another."""
    at = 0
    for n in sizes.tolist():
        yield hashes[at : at + n]
        at += n


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words count as one shingle, none as nothing."""
    if not len(hashes):
        return hashes
    if len(hashes) < n:
        return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(hashes))], np.uint64)
    out = hashes[: len(hashes) - n + 1]
    for k in range(1, n):
        out = mix(out + np.uint64(0x9E3779B97F4A7C15)) + hashes[k : len(hashes) - n + 1 + k]
    out = mix(out)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node with an edge; component = smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), so that
    paths shorten in a logarithmic number of rounds and no component is ever
    gathered in one row. Self-loops are allowed; repeated edges don't matter.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low2, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b")))
        e = cut(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        # a fingerprint of the edge set: sums that don't depend on order
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    root = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
