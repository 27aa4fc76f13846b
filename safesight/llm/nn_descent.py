"""Approximate nearest neighbours: NN-descent graph, greedy graph search, both as Spark joins.

Index: equal vectors collapse into one node (its smallest ids are kept for
answers). Random binary trees deal nodes to leaves of LEAF consecutive nodes, whose
members are compared with each other: the first graph. NN-descent (Dong, Moses and
Li, 2011) then joins each node's neighbours and reverse neighbours with their
vectors and compares them with one another; closer pairs replace farther
ones, round by round until less than ``delta`` of all edges is new (their rule).
Lists are bounded by k each way, so no hub gathers more. The leaves are a start
only: as nodes grow, they hold fewer of the true neighbours, and rounds follow.

Search: every query keeps a beam of the nearest nodes seen. Each round joins the
nearest unexpanded nodes of the beam to their neighbours, and these to their
vectors, until the beam has no unexpanded node or rounds run out. Queries that
are rows of the table start at their own node.

Distances are Euclidean in double precision on the original vectors. Vectors
that are null, zero or hold null or non-finite components, or whose length is not
the most common one, take part neither as queries nor as candidates. Ties go
to the smaller id. Repeated rows (same id) count once; columns besides id and
vector are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from safesight.llm.common import cut

LEAF = 1024
TREES = 6
SALTS = 32


def _vectors(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Binary float32 vectors as a matrix."""
    rows = [np.frombuffer(x.as_buffer(), np.float32) for x in column]
    return np.stack(rows).astype(kind) if rows else np.zeros((0, 0), kind)


def _distances(x: np.ndarray) -> np.ndarray:
    """Squared distances within a set (single precision is enough to build a graph)."""
    n = (x * x).sum(1)
    d = n[:, None] + n[None] - 2 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    return np.maximum(d, 0)


def _edges(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d.astype(np.float32))], ["u", "v", "d"])


EDGES = "u long, v long, d float"


def _kept(df: DataFrame, key: str) -> DataFrame:
    """df with its lineage cut, dealt by the key and kept so: joins on the key don't deal it anew, and plans stay short."""
    return cut(df).repartition(key).persist()


def _nodes(rows: DataFrame, id_col: str, vector_col: str, answers: int) -> DataFrame:
    """Distinct vectors: node (smallest id), vec (float32 binary), ids (the smallest ones, ascending)."""
    vector = F.col(vector_col).cast("array<float>")
    sound = F.col(id_col).isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    clean = rows.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: x + F.lit(0.0).cast("float")).alias("vector"))
    size = clean.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return None
    keyed = clean.where(F.size("vector") == size["n"]).select("id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), "vector").alias("h2"))
    # the smallest ids of each vector, first within salts: a vector may be on a third of all rows
    some = keyed.groupBy("h1", "h2", "id").agg(F.first("vector").alias("vector")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for part in (["h1", "h2", "salt"], ["h1", "h2"]):
        some = some.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy("id"))).where(F.col("r") <= answers)
    node = some.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.min_by("vector", "id").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.array(v, np.float32).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), b.column(2)], ["node", "vec", "ids"])

    return node.select("node", "vector", "ids").mapInArrow(pack, "node long, vec binary, ids array<long>")


def _first_graph(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """Nearest neighbours within the leaves of random trees."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = 0.0, 0
        for b in batches:
            sums, n = sums + _vectors(b.column("vec")).sum(0), n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["sums", "n"])

    # the mean vector, from one row of sums per task
    parts = nodes.select("vec").mapInArrow(total, "sums binary, n long").collect()
    mean = (sum(np.frombuffer(r["sums"], np.float64) for r in parts) / sum(r["n"] for r in parts)).astype(np.float32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column("vec"), np.float32)
            if not len(x):
                continue
            x = x - mean
            for tree in range(TREES):
                rng = np.random.default_rng(seed + tree)
                # the sign pattern of random directions is the path down a tree
                bits = x @ rng.standard_normal((x.shape[1], 30)).astype(np.float32) > 0
                path = bits @ (1 << np.arange(29, -1, -1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree), pa.int32()), pa.array(path), b.column("node"), b.column("vec")], ["tree", "path", "node", "vec"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = [], None

        def compare() -> Iterator[pa.RecordBatch]:
            ids = np.array([i for i, _ in held])
            if len(ids) > 1:
                d = _distances(np.stack([v for _, v in held]))
                best = np.argpartition(d, min(k, len(ids) - 1) - 1, axis=1)[:, :k]
                yield _edges(np.repeat(ids, best.shape[1]), ids[best].ravel(), np.take_along_axis(d, best, 1).ravel())

        for b in batches:
            for t, node, vec in zip(b.column("tree").to_pylist(), b.column("node").to_pylist(), _vectors(b.column("vec"), np.float32)):
                if t != tree or len(held) >= LEAF:
                    yield from compare()
                    held, tree = [], t
                held.append((node, vec))
        yield from compare()

    # consecutive nodes in the order of a tree's paths make a leaf, so leaves are of one size however dense the data
    return nodes.select("node", "vec").mapInArrow(code, "tree int, path long, node long, vec binary").repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node").mapInArrow(leaf, EDGES)


def _top(edges: DataFrame, by: str, k: int, order: Column | str) -> DataFrame:
    """At most k edges per node."""
    return edges.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(order, "v" if by == "u" else "u"))).where(F.col("r") <= k).drop("r")


def _descend(graph: DataFrame, nodes: DataFrame, k: int, turn: int) -> DataFrame:
    """One round: compare the neighbours of each node with one another."""
    back = _top(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"), "u", k, F.xxhash64("v", F.lit(turn)))
    around = graph.select("u", "v").unionByName(back.select("u", "v"))
    worst = graph.groupBy("u").agg(F.max("d").alias("worst"), F.count("*").alias("n")).select(F.col("u").alias("v"), F.when(F.col("n") >= k, F.col("worst")).otherwise(float("inf")).cast("float").alias("worst"))
    members = around.join(nodes.select(F.col("node").alias("v"), "vec").join(worst, "v"), "v")

    def local(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, worst, x = [], [], []
        for p in parts:
            ids.append(p.column("v").to_numpy())
            worst.append(p.column("worst").to_numpy())
            x.append(_vectors(p.column("vec"), np.float32))
        # a neighbour both ways comes twice
        ids, first = np.unique(np.concatenate(ids), return_index=True)
        worst, x = np.concatenate(worst)[first], np.concatenate(x)[first]
        d = _distances(x)
        a, b = np.nonzero(d < worst[:, None])
        yield _edges(ids[a], ids[b], d[a, b])

    found = members.groupBy("u").applyInArrow(local, EDGES)
    marked = graph.withColumn("new", F.lit(False)).unionByName(found.withColumn("new", F.lit(True)))
    both = marked.repartition("u").groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return _top(both, "u", k, "d")


def build(nodes: DataFrame, k: int, delta: float, seed: int = 7) -> DataFrame:
    """Edges (u, v, d squared): the k nearest neighbours found of each node.

    Rounds go on until at most delta of the edges is new. Edges only give way to nearer
    ones, so this ends.
    """
    first = _first_graph(nodes, k, seed).repartition("u").groupBy("u", "v").agg(F.min("d").alias("d"))
    graph, turn = _kept(_top(first, "u", k, "d"), "u"), 0
    while True:
        before, graph = graph, _kept(_descend(graph.select("u", "v", "d"), nodes, k, turn), "u")
        edges, new = graph.agg(F.count("*"), F.count_if("new")).first()
        before.unpersist()
        turn += 1
        if new <= delta * edges:
            return graph.select("u", "v", "d")


BEAM = "q long, vec binary, nodes binary, distances binary, expanded binary"


def _search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, k: int, beam: int, width: int, max_rounds: int) -> DataFrame:
    """queries (q, vec, start node) to beams: nodes and exact distances, nearest first."""
    back = _top(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"), "u", k, "d")
    # at most 2 k neighbours per node
    near = _kept(graph.select("u", "v").unionByName(back.select("u", "v")).groupBy("u").agg(F.collect_set("v").alias("near")), "u")
    vectors = nodes.select("node", F.col("vec").alias("nvec"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one = lambda x, t: pa.array([np.array([i], t).tobytes() for i in x], pa.binary())
            n = b.num_rows
            # the start node counts as seen at distance 0; what it leads to is what matters
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), one(b.column(2).to_pylist(), np.int64), one([0.0] * n, np.float64), one([False] * n, bool)], ["q", "vec", "nodes", "distances", "expanded"])

    def frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, at = [], []
            for i, nodes_, done in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                open_ = np.frombuffer(nodes_.as_buffer(), np.int64)[~np.frombuffer(done.as_buffer(), bool)][:width]
                q.append(np.full(len(open_), i))
                at.append(open_)
            if q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q)), pa.array(np.concatenate(at))], ["q", "u"])

    def merge(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        row = left.to_pylist()[0]
        at, d, done = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["distances"], np.float64), np.frombuffer(row["expanded"], bool).copy()
        done[np.flatnonzero(~done)[:width]] = True
        if right.num_rows:
            right = right.combine_chunks()
            new = right.column("node").to_numpy()
            fresh = ~np.isin(new, at)
            x = _vectors(right.column("nvec"))[fresh]
            own = np.sqrt(((x - np.frombuffer(row["vec"], np.float32).astype(np.float64)) ** 2).sum(1))
            at, d, done = np.concatenate([at, new[fresh]]), np.concatenate([d, own]), np.concatenate([done, np.zeros(len(own), bool)])
        order = np.lexsort((at, d))[:beam]
        row |= {"nodes": at[order].tobytes(), "distances": d[order].tobytes(), "expanded": done[order].tobytes()}
        return pa.Table.from_pylist([row], left.schema)

    state = cut(queries.mapInArrow(begin, BEAM))
    for _ in range(max_rounds):
        open_ = state.select("q", "nodes", "expanded").mapInArrow(frontier, "q long, u long")
        met = open_.join(near, "u").select("q", F.explode("near").alias("node")).repartition("node").dropDuplicates(["node", "q"]).join(vectors, "node")
        state = cut(state.groupBy("q").cogroup(met.groupBy("q")).applyInArrow(merge, BEAM))
        if state.select("q", "nodes", "expanded").mapInArrow(frontier, "q long, u long").isEmpty():
            break
    return state


def search(rows: DataFrame, queries: Column, n: int = 10, k: int = 24, delta: float = 0.01, beam: int = 160, width: int = 160, max_rounds: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the id column and score (distance) of the n nearest found to each row that queries selects."""
    spark = rows.sparkSession
    schema = f"query_id long, rank int, {id_col} long, score double"
    nodes = _nodes(rows, id_col, vector_col, n + 1)
    if nodes is None:
        return spark.createDataFrame([], schema)
    nodes = _kept(nodes, "node")
    graph = build(nodes, k, delta)
    # queries of one vector share its node: they are searched once
    sound = rows.where(queries & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.transform(F.col(vector_col).cast("array<float>"), lambda x: x + F.lit(0.0).cast("float")).alias("vector")).dropDuplicates(["query_id"])
    keyed = sound.select("query_id", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), "vector").alias("h2"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(_vectors(b.column(1), np.float32)), pa.list_(pa.float32()))], ["node", "vector"])

    of = nodes.select("node", "vec").mapInArrow(keys, "node long, vector array<float>").select("node", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), "vector").alias("h2"))
    asked = cut(keyed.join(of, ["h1", "h2"]).select("query_id", "node"))
    starts = asked.select("node").distinct().join(nodes, "node").select(F.col("node").alias("q"), "vec", "node")
    beams = _search(starts, nodes, graph, k, beam, width, max_rounds)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, at, d in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                at, d = np.frombuffer(at.as_buffer(), np.int64)[: n + 1], np.frombuffer(d.as_buffer(), np.float64)[: n + 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q)), pa.array(at), pa.array(d)], ["q", "node", "score"])

    near = beams.select("q", "nodes", "distances").mapInArrow(answers, "q long, node long, score double")
    named = near.join(nodes.select("node", "ids"), "node").select("q", "score", F.explode("ids").alias("id"))
    # the n + 1 best of a node serve every query of its vector; each leaves out itself
    best = named.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("r") <= n + 1).drop("r")
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("found"))
    own = asked.select("query_id", F.col("node").alias("q")).join(lists, "q")
    own = own.select("query_id", F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, n).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
