"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Exact: two texts link when 100 x intersection >= percent x union of their
distinct n-word shingles (64-bit hashes). Steps, all Spark jobs:

1. Load table: how often shingles fall in each of 2^22 cells, over all texts (4
   MB as classes at any size). It gives the global order: cells without excess
   load first, then by hash. Any order is exact; this one keeps shared passages
   out of prefixes.
2. Equal sets collapse into one representative.
3. Prefixes: linked texts share a token within their first |x| - ceil(t|x|) + 1
   tokens, and l tokens within l - 1 more. Document frequencies of all prefix
   tokens give each text's candidate cost, which sets its l: the costlier, the
   longer its prefix, and a pair must share the smaller l of both.
4. A bucket is the texts whose prefixes hold a token. In LEADERS turns every text
   of a bucket that is not yet in its leader's component is verified against that
   leader, so that a group of copies joins one component without all its pairs.
   Then all pairs of different components that share a bucket are verified: the
   texts outside a bucket's commonest component, dealt by salt, meet the bucket.
   Buckets of more than DEALT_ROWS rows are dealt out for all these joins.
   Two texts of different components find all their common tokens in such mixed
   buckets, so shared tokens are counted there alone.
5. Components by alternating stars.

Texts without words have no shingles and link with nothing; null counts as
empty; fewer than n words are one shingle. Repeated rows give repeated rows of
one component. Columns besides the id and the text are ignored. Ids are distinct
integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from safesight.llm.common import by_ids, components, cut, discard, forget, in_parts, per_text, shingle_set, table_path, whole_texts, word_hashes, written

CELLS = 1 << 22
SLICES = 64
#: Candidate costs above which a text's prefix grows, and by what part of its size: (cost, parts).
GROWTH = ((4, 40), (32, 20))
LEADERS = 2
#: Texts outside the commonest component of a bucket that one salt takes.
SALT_ROWS = 512
#: Rows of a bucket that meet its leader in one task; larger buckets are dealt out by document.
DEALT_ROWS = 1 << 20


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    for found in per_text(*word_hashes(batch.column("text"))):
        yield shingle_set(found, n)


def _loads(texts: DataFrame, n: int) -> np.ndarray:
    """Order classes of the cells: 0 up to four deviations above the mean load, then by powers of two of the excess."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(CELLS, np.int64), [], 0
        for batch in in_parts(batches):
            for found in _sets(batch, n):
                held.append((found & np.uint64(CELLS - 1)).astype(np.int64))
                size += len(found)
                if size > 250_000:
                    total += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=CELLS)
        parts = np.split(total, SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(p.astype(np.uint32).tobytes(), 1) for p in parts], pa.binary())], ["slice", "loads"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(CELLS // SLICES, np.int64), None
        for part in parts:
            at = part.column(0)[0].as_py()
            for x in part.column(1):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["slice", "loads"])

    rows = texts.mapInArrow(count, "slice int, loads binary").groupBy("slice").applyInArrow(add, "slice int, loads binary").collect()
    total = np.zeros(CELLS, np.int64)
    for r in rows:
        total[r["slice"] * (CELLS // SLICES) :][: CELLS // SLICES] = np.frombuffer(zlib.decompress(r["loads"]), np.int64)
    excess = (total - total.mean()) / (4 * np.sqrt(total.mean()) + 4)
    return np.ceil(np.log2(np.maximum(1, excess))).astype(np.uint8)


def _prefixes(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """doc, size, d1, d2 (digest of the set) and its first tokens in the global order."""
    classes = texts.sparkSession.sparkContext.broadcast(_loads(texts, n))  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = classes.value
        for batch in in_parts(batches):
            sizes, d1, d2, prefix = [], [], [], []
            for found in _sets(batch, n):
                digest = xxhash.xxh3_128_digest(found.tobytes())
                a, b = np.frombuffer(digest, np.int64)
                sizes.append(len(found))
                d1.append(int(a))
                d2.append(int(b))
                length = len(found) - -(-len(found) * percent // 100) + 1 + -(-len(found) // GROWTH[-1][1])
                first = found[np.lexsort((found, order[(found & np.uint64(CELLS - 1)).astype(np.int64)]))[:length]] if len(found) else found
                prefix.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], ["doc", "size", "d1", "d2", "prefix"])

    return texts.mapInArrow(run, "doc long, size long, d1 long, d2 long, prefix array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) that link, by their whole sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in _sets(part, n)], pa.binary())], ["doc", "tokens"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    path = table_path(texts.sparkSession)
    found = written(by_ids(texts, ids, "doc", "left_semi").dropDuplicates(["doc"]).mapInArrow(sets, "doc long, tokens binary"), path)
    left = found.select(F.col("doc").alias("a"), F.col("tokens").alias("x"))
    right = found.select(F.col("doc").alias("b"), F.col("tokens").alias("y"))
    linked = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))
    discard(texts.sparkSession, path)
    return linked


def join(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    texts = whole_texts(docs, F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    every = written(_prefixes(texts, n, percent), codec="zstd")
    reps = every.where("size > 0").groupBy("d1", "d2").agg(F.min("doc").alias("doc"), F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    base = (F.col("size") - F.ceil(F.col("size") * percent / F.lit(100)) + 1).cast("int")
    tokens = reps.select("doc", F.explode(F.slice("prefix", F.lit(1), base)).alias("token"))
    cost = tokens.join(_frequent(tokens), "token").groupBy("doc").agg(F.sum(F.col("df") - 1).alias("cost"))
    need = F.lit(1)
    for least, part in GROWTH:
        need = F.when(F.col("cost") > least, 1 + F.ceil(F.col("size") / part)).otherwise(need)
    needs = cost.join(reps, "doc").select("doc", "size", need.cast("int").alias("need"), "prefix")
    spark = docs.sparkSession
    path = table_path(spark)
    longer = written(needs.select("doc", F.col("size").cast("int").alias("size"), "need", F.posexplode(F.slice("prefix", F.lit(1), base + F.col("need") - 1)).alias("at", "token")), path, "zstd")
    forget(spark)
    # before: how many tokens of other texts' prefixes stand before this one; alone: how many others the prefix has
    own = Window.partitionBy("doc")
    before = (F.row_number().over(own.orderBy("at")) - 1).alias("before")
    alone = (F.max("at").over(own) - F.count("*").over(own)).cast("int").alias("alone")
    deal = F.pmod(F.xxhash64("doc"), F.floor(F.col("df") / DEALT_ROWS) + 1).cast("int").alias("deal")
    prefixes = table_path(spark)
    rows = written(longer.join(_frequent(longer), "token").select("token", "doc", "size", "need", "at", deal, before, alone), prefixes, "zstd")
    discard(spark, path)
    forget(spark)

    links = _links(rows, texts, n, percent, prefixes)
    parts = components(links)
    known = reps.select("d1", "d2", "doc").join(parts.withColumnRenamed("node", "doc"), "doc", "left").select("d1", "d2", F.coalesce("component", "doc").alias("component_id"))
    return every.select("doc", "size", "d1", "d2").join(known, ["d1", "d2"], "left").select(F.col("doc").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))


def _frequent(rows: DataFrame) -> DataFrame:
    """Tokens of more than one row, with their number of rows."""
    return rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")


def _close(percent: int) -> Column:
    """Position filters on rows of a common token at places at and at2.

    It leaves an overlap of at most least(before) + least(size - at), as tokens that
    stand before it and occur in no other prefix are not common. And linked texts,
    which have at least o = t / (1 + t) x (size + size2) tokens in common, share
    need of them within the first size - o + need of each.
    """
    small, large = F.least("size", "size2"), F.greatest("size", "size2")
    least = F.least("before", "before2") + F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2"))
    common = (F.col("size") + F.col("size2")) * percent
    rest = F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2")) + F.least("need", "need2") - 1
    return (small * 100 >= large * percent) & (least * (100 + percent) >= common) & (rest * (100 + percent) >= common)


def _sharing(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows with doc and doc2 that share as many tokens as the smaller need of both."""
    pair = [F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")]
    shared = met.groupBy(*pair).agg(F.count("*").alias("shared"), F.first(F.least("need", "need2")).alias("need"))
    return shared.where(F.col("shared") >= F.col("need")).select("a", "b")


MEMBER = ("doc", "size", "need", "at", "before", "part")


def _dealt(buckets: DataFrame) -> DataFrame:
    """A row per bucket and deal, of buckets with their largest deal."""
    return buckets.withColumn("deal", F.explode(F.sequence(F.lit(0), "deal")))


def _links(rows: DataFrame, texts: DataFrame, n: int, percent: int, path: str) -> DataFrame:
    """All links but those inside a component that other links already join.

    A bucket's first leader is the text with the fewest tokens of its own, as the
    original of a group of copies has; later ones are drawn by hash. Leaders only save
    work: what they miss is verified in the last turn. The rows' table at path is deleted.
    """
    spark = texts.sparkSession
    links = tested = parts = None
    for turn in range(LEADERS + 1):
        named = rows.withColumn("part", F.col("doc"))
        if links is not None:
            parts = components(links).withColumnRenamed("node", "doc")
            named = rows.join(parts, "doc", "left").withColumn("part", F.coalesce("component", "doc")).drop("component")
        if turn == 1 and links is not None:  # buckets of one component are done for good
            mixed = named.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.max("deal").alias("deal")).where("p < q").select("token", "deal")
            left = table_path(spark)
            rows = written(named.join(_dealt(mixed), ["token", "deal"], "left_semi").drop("part").select(*rows.columns), left, "zstd")
            discard(spark, path)
            path = left
            named = rows.join(parts, "doc", "left").withColumn("part", F.coalesce("component", "doc")).drop("component")
        other = [F.col(c).alias(f"{c}2") for c in MEMBER]
        drawn = F.struct(*(["alone"] if turn == 0 else []), F.xxhash64("doc", F.lit(turn)).alias("h"), *other)
        if turn < LEADERS:
            led = named.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.max("deal").alias("deal"), F.min(drawn).alias("leader")).where("p < q")
            met = named.join(_dealt(led.select("token", "deal", "leader")), ["token", "deal"]).select("*", "leader.*")
            pairs = _sharing(met.where((F.col("part") != F.col("part2")) & _close(percent)))
        else:
            pairs = _sharing(_mixed(named, percent))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        forget(spark)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = _verified(pairs, texts, n, percent)
        links = found if links is None else cut(links.unionByName(found))
        forget(spark)
    discard(spark, path)
    return spark.createDataFrame([], "a long, b long") if links is None else links


def _mixed(named: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows of a bucket that are of different components and may link."""
    shares = named.groupBy("token", "part").agg(F.count("*").alias("rows"), F.max("deal").alias("deal"))
    most = F.max(F.struct("rows", "part"))
    mixed = shares.groupBy("token").agg(most["part"].alias("common"), F.count("*").alias("parts"), (F.sum("rows") - most["rows"]).alias("rest"), F.max("deal").alias("deal")).where("parts > 1")
    bucket = named.join(_dealt(mixed.select("token", "deal", "common", F.floor(F.col("rest") / SALT_ROWS).cast("int").alias("last"))), ["token", "deal"]).drop("alone", "deal")
    few = bucket.where("part <> common").withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("last") + 1).cast("int")).drop("common", "last")
    every = bucket.select("token", *(F.col(c).alias(f"{c}2") for c in MEMBER), (F.col("part") == F.col("common")).alias("base"), F.explode(F.sequence(F.lit(0), "last")).alias("salt"))
    return few.join(every, ["token", "salt"]).where((F.col("part") != F.col("part2")) & (F.col("base") | (F.col("doc") < F.col("doc2"))) & _close(percent))
