"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the words, lower-cased (A-Z) and without ASCII punctuation at their ends. A term's weight in a text is (1 + log
tf) x idf x rf: idf = log(1 + n / df), and the relevance frequency of Lan et al.
(2009), rf = log2(2 + odds), where odds compares how often the term occurs in label
1 and label 0. All frequencies count every training row. Plain TF-IDF without rf
finds texts on the same subject rather than of the same label.

The index holds a sample of the training rows: those with the smallest hash of their
id, ``max_examples`` at most, and as many of them as have ``max_terms`` different
words together (both bound the broadcast). All words of the examples are terms,
none is picked by its label. Every text is searched against the whole index,
exactly: blocks of examples are visited in falling order of their score bound until
no block can improve the k best. Votes are weighted by distance and calibrated by
isotonic regression on the examples' own leave-one-out votes.

Texts without a known term (null and empty ones too) are no example's neighbours
and get the training rows' share of label 1. Repeated rows give repeated rows; ties
go to the example that comes first in the index. Labels with a null id or label are
ignored; several labels of one id count as their largest, several texts of an
example's id as the smallest. Without any training row, every score is 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from safesight.llm.common import in_parts, per_text, whole_texts, word_hashes, written

#: Labels up to this many rows are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: The vocabulary is dealt in so many parts where its counts are summed.
SLICES = 32


def bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of each text's different words, and how often they occur."""
    for words in per_text(*word_hashes(texts, strip=True)):
        words = np.sort(words)
        edge = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
        yield words[edge], np.diff(np.append(edge, len(words)))


def known(vocabulary: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of those words that a sorted vocabulary has, and their counts."""
    at = np.searchsorted(vocabulary, keys)
    has = vocabulary[np.minimum(at, len(vocabulary) - 1)] == keys if len(vocabulary) else np.zeros(len(keys), bool)
    return at[has], n[has].astype(np.float64)


class Model(NamedTuple):
    """Vocabulary, block-max index and calibration; bounded by max_examples and max_terms."""

    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray  # idf x rf of each term
    pairs: np.ndarray  # term -> its first (term, block) pair; one more at the end
    blocks: np.ndarray  # of each pair
    most: np.ndarray  # largest weight of the pair's postings
    posts: np.ndarray  # pair -> its first posting; one more at the end
    examples: np.ndarray  # of each posting
    values: np.ndarray  # weight of each posting
    labels: np.ndarray  # of the examples, in index order
    ids: list[str]
    k: int
    block: int
    prior: float
    steps: np.ndarray  # isotonic steps: raw vote to probability
    chances: np.ndarray

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Weights of a text with terms at these places, of length 1."""
        x = (1 + np.log(n)) * self.weights[at]
        return x / (math.sqrt(x @ x) or 1)


def index(vocabulary: np.ndarray, weights: np.ndarray, rows: list[tuple[str, int, np.ndarray, np.ndarray]], k: int, block: int, prior: float) -> Model:
    """The index of examples: id, label, places and counts of terms. Like examples share blocks."""
    m = Model(vocabulary, weights, *[np.zeros(0)] * 7, [], k, block, prior, np.zeros(0), np.zeros(0))
    vectors = [m.vector(at, n) for _, _, at, n in rows]
    first = [(int(r[2][v.argmax()]), -v.max()) if len(v) else (-1, 0.0) for r, v in zip(rows, vectors)]
    order = sorted(range(len(rows)), key=lambda i: (first[i], rows[i][0]))
    sizes = np.array([len(vectors[i]) for i in order], np.int64)
    example = np.repeat(np.arange(len(order)), sizes)
    term = np.concatenate([*(rows[i][2] for i in order), np.zeros(0, np.int64)])
    value = np.concatenate([*(vectors[i] for i in order), np.zeros(0)])
    by = np.lexsort((example, term))
    example, term, value = example[by].astype(np.int32), term[by], value[by]
    pair = term * (len(rows) // block + 1) + example // block
    posts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(value, posts) if len(posts) else np.zeros(0)
    pairs = np.searchsorted(term[posts], np.arange(len(vocabulary) + 1))
    blocks = (example[posts] // block).astype(np.int32)
    return m._replace(pairs=pairs, blocks=blocks, most=most, posts=np.append(posts, len(term)), examples=example, values=value, labels=np.array([float(rows[i][1]) for i in order]), ids=[rows[i][0] for i in order])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start .. start + size - 1 of all ranges, one after another."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


def nearest(m: Model, at: np.ndarray, q: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the k best examples for a vector q of length 1, best first, ties by place."""
    size = m.pairs[at + 1] - m.pairs[at]
    pair, own = _ranges(m.pairs[at], size), np.repeat(q, size)
    block = m.blocks[pair]
    n_blocks = -(-len(m.labels) // m.block)
    bounds = np.bincount(block, m.most[pair] * own, minlength=n_blocks)
    order = np.argsort(-bounds, kind="stable")
    best, cosine, done, more = np.zeros(0, np.int64), np.zeros(0), 0, 2
    while done < n_blocks and not (len(best) >= m.k and bounds[order[done]] < cosine[m.k - 1] - 1e-9):
        now = np.zeros(n_blocks, bool)
        now[order[done : done + more]] = True
        mine = now[block]
        start = m.posts[pair[mine]]
        size = m.posts[pair[mine] + 1] - start
        post = _ranges(start, size)
        scores = np.bincount(m.examples[post], m.values[post] * np.repeat(own[mine], size), minlength=len(m.labels))
        new = np.flatnonzero(np.repeat(now, m.block)[: len(m.labels)])
        new = new[new != skip]
        best, cosine = np.concatenate([best, new]), np.concatenate([cosine, scores[new]])
        top = np.lexsort((best, -np.round(cosine, 9)))[: m.k]
        best, cosine = best[top], cosine[top]
        done, more = done + more, more * 2
    return best, cosine


def vote(m: Model, at: np.ndarray, n: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
    """Distance-weighted share of label 1 among the nearest examples, their places and cosines."""
    best, cosine = nearest(m, at, m.vector(at, n), skip) if len(at) else (np.zeros(0, np.int64), np.zeros(0))
    if not len(best):
        return m.prior, best, cosine
    w = 1 / (np.sqrt(np.maximum(0, 2 - 2 * cosine)) + 0.05)
    return float((w * m.labels[best]).sum() / w.sum()), best, cosine


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: steps and non-decreasing means of y over x, with a weak prior of the whole mean."""
    levels: list[list[float]] = []  # sum, weight, sum of x
    for v in np.unique(x):
        own = y[x == v]
        levels.append([own.sum(), len(own), v * len(own)])
        while len(levels) > 1 and levels[-2][0] / levels[-2][1] >= levels[-1][0] / levels[-1][1]:
            s, w, t = levels.pop()
            levels[-1] = [levels[-1][0] + s, levels[-1][1] + w, levels[-1][2] + t]
    mean = y.mean()
    return np.array([t / w for _, w, t in levels]), np.array([(s + mean) / (w + 1) for s, w, _ in levels])


def weigh(n0: np.ndarray, n1: np.ndarray, rows0: int, rows1: int) -> np.ndarray:
    """idf x rf of terms in n0 of rows0 rows of label 0 and n1 of rows1 rows of label 1."""
    odds = n1 / np.maximum(n0, 1) * (max(rows0, 1) / max(rows1, 1))
    return np.log(1 + (rows0 + rows1) / np.maximum(n0 + n1, 1)) * np.log2(2 + odds)


def _frequencies(rows: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """In how many of the rows (text, label) each term occurs, by label, and the number of rows."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)  # 8 x max_terms bytes at most
    size = -(-(len(vocabulary) + 1) // SLICES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, size * SLICES), np.uint32)
        for batch in in_parts(batches):
            for bag, label in zip(bags(batch.column("text")), batch.column("label").to_pylist()):
                own = seen[int(label != 0)]
                own[known(shared.value, *bag)[0]] += 1
                own[-1] += 1  # no term's place: all rows
        parts = [zlib.compress(np.ascontiguousarray(x).tobytes(), 1) for x in np.split(seen, SLICES, axis=1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "seen"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(2 * size, np.int64), 0
        for part in parts:
            at = part.column(0)[0].as_py()
            for x in part.column(1):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "seen"])

    found = rows.mapInArrow(count, "slice int, seen binary").groupBy("slice").applyInArrow(add, "slice int, seen binary").collect()
    total = np.zeros((2, size * SLICES), np.int64)
    for r in found:
        total[:, r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["seen"], np.int64).reshape(2, size)
    shared.destroy()
    return total[0, : len(vocabulary)], total[1, : len(vocabulary)], int(total[0, -1]), int(total[1, -1])


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 2000, max_terms: int = 2_000_000, k: int = 21, block: int = 64, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on the rows of docs that labels (id, label 0/1) covers."""
    spark = docs.sparkSession
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    few = given.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = whole_texts(docs, F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    labelled = texts.join(F.broadcast(given) if few else given, "id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            own = list(bags(batch.column("text")))
            sizes, keys, n = zip(*((len(k), k.tobytes(), n.astype(np.uint32).tobytes()) for k, n in own))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("h"), batch.column("label"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(n, pa.binary())], ["id", "h", "label", "size", "keys", "n"])

    sample = labelled.select("id", "label").distinct().select("id", "label", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(max_examples)
    drawn = texts.join(F.broadcast(sample), "id").groupBy("id", "h", "label").agg(F.min("text").alias("text"))
    drawn = written(drawn.mapInArrow(terms, "id string, h long, label int, size long, keys binary, n binary"))
    sizes = sorted(tuple(r) for r in drawn.select("h", "id", "size").collect())
    fits = np.cumsum([s for *_, s in sizes]) <= max_terms
    if len(sizes) and not fits.all():
        h, last, _ = sizes[max(0, int(fits.sum()) - 1)]
        drawn = drawn.where((F.col("h") < h) | ((F.col("h") == h) & (F.col("id") <= last)))
    rows = [(r["id"], r["label"], np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["n"], np.uint32)) for r in drawn.collect()]
    vocabulary = np.unique(np.concatenate([*(keys for *_, keys, _ in rows), np.zeros(0, np.uint64)]))
    n0, n1, rows0, rows1 = _frequencies(labelled.select("text", "label"), vocabulary)
    m = index(vocabulary, weigh(n0, n1, rows0, rows1), [(i, y, np.searchsorted(vocabulary, keys), n.astype(np.float64)) for i, y, keys, n in rows], k, block, rows1 / max(1, rows0 + rows1))
    if not rows:
        return m
    shared = spark.sparkContext.broadcast(m)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        place = {i: at for at, i in enumerate(own.ids)}
        for batch in batches:
            found = [vote(own, np.searchsorted(own.vocabulary, np.frombuffer(r["keys"], np.uint64)), np.frombuffer(r["n"], np.uint32).astype(np.float64), place[r["id"]])[0] for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column("label")], ["raw", "label"])

    # the sample is small in bytes, so it is dealt out for the votes
    raw = drawn.select("id", "label", "keys", "n").repartition(max(8, spark.sparkContext.defaultParallelism)).mapInArrow(left_out, "raw double, label int").collect()
    shared.destroy()
    steps, chances = isotonic(np.round([r["raw"] for r in raw], 6), np.array([float(r["label"]) for r in raw]))
    return m._replace(steps=steps, chances=chances)


def score(docs: DataFrame, model: Model, evidence: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1) and, if asked for, evidence: the nearest examples' ids, labels and cosines."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_examples and max_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in in_parts(batches):
            made, shown = [], []
            for bag in bags(batch.column(1)):
                raw, best, cosine = vote(m, *known(m.vocabulary, *bag))
                made.append(float(np.interp(raw, m.steps, m.chances)) if len(best) else raw)
                if evidence:
                    shown.append([{"id": m.ids[i], "label": int(m.labels[i]), "cosine": float(c)} for i, c in zip(best, cosine)])
            columns = [batch.column(0), pa.array(made, pa.float64())]
            if evidence:
                columns.append(pa.array(shown, pa.list_(pa.struct([("id", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, ["id", "score", "evidence"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, score double" + ", evidence array<struct<id:string,label:int,cosine:double>>" * evidence
    return whole_texts(docs, F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
