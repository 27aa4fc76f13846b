"""Language-model scoring with a log-frequency Bloom filter (Talbot and Osborne, 2007).

Training counts all words, pairs and triples of neighbouring words of the training
rows, without a cut-off. Word counts are exact. The count c of a pair or triple is
held as level 1 + floor(log_base c): the filter gets the keys (gram, 1) .. (gram,
level), and a lookup probes level by level until one is missing. A level stands for
the counts low .. high; with P(w) the add-0.1 probability,

    P(w | v) = share x low(v w) / c(v) + (1 - share) x P(w)
    P(w | u v) = share3 x low(u v w) / high(u v) + (1 - share3) x P(w | v)

(the right term alone where the context was not seen, and no triple at a text's first
token), which sum to one at most but for false positives.

Counts are dealt to buckets by hash; each bucket's filter is built in one task
(buckets follow the input's bytes, so their size is bounded). While all of them
together are within ``shard_bytes``, workers get them by broadcast, in pieces of
``piece_bytes`` that pass through the driver as bytes, one at a time. A larger
model is never in one place: the texts' probes are dealt to the buckets and the
answers come back, with the same scores.

Null and empty texts are one token (the end). Repeated rows give repeated rows;
columns besides the id and the text are ignored. With no training rows all
counts are 0. Ids are integers or null; a null flag counts as not held out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from safesight.llm.common import in_parts, mix, whole_texts, word_hashes, written

END, START = np.uint64(0x5E4D), np.uint64(0x57A7)  # words have scrambled hashes
ADD = 0.1
#: Texts are worked on together up to about this many tokens (one longer text is alone).
CHUNK_TOKENS = 300_000
#: Bytes of text per bucket.
BUCKET_BYTES = 8 << 20
#: Words, pairs and triples.
ORDERS = (1, 2, 3)


class Chunk:
    """Some texts: ids, flags, lengths and the hashes of all their tokens."""

    def __init__(self, ids: pa.Array, held: np.ndarray, lengths: np.ndarray, tokens: np.ndarray):
        self.ids, self.held, self.lengths, self.tokens = ids, held, lengths, tokens
        self.first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums per text."""
        return np.add.reduceat(values, self.first)

    def shifted(self, values: np.ndarray, start) -> np.ndarray:
        """Each token's predecessor's value; start before the first."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = start
        return out

    def keys(self, order: int) -> np.ndarray:
        """A key for each token and the order - 1 tokens before it."""
        out, back = mix(self.tokens), self.tokens
        for k in range(1, order):
            back = self.shifted(back, START)
            out = mix(out ^ mix(back + np.uint64(k * 0xA5A5A5A5)))
        return out


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Batches of id, held, text as chunks."""
    held, size = [], 0

    def out() -> Chunk:
        ids, flags, lengths, tokens = zip(*held)
        return Chunk(pa.concat_arrays(ids), np.concatenate(flags), np.concatenate(lengths), np.concatenate(tokens))

    for part in in_parts(batches):
        words, n = word_hashes(part.column("text"))
        tokens = np.full(len(words) + len(n), END, np.uint64)
        tokens[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
        if held and size + len(tokens) > CHUNK_TOKENS:
            yield out()
            held, size = [], 0
        held.append((part.column(0), part.column(1).fill_null(False).to_numpy(zero_copy_only=False), n + 1, tokens))
        size += len(tokens)
    if held:
        yield out()


def packed(keys: np.ndarray) -> bytes:
    """The upper 40 bits of keys (enough within a bucket of pairs or triples)."""
    return np.ascontiguousarray((keys >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """Back to 64 bits, the lower 24 of them 0."""
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def within(keys: np.ndarray, order: int, bits: int) -> bytes:
    """Keys of one bucket as bytes; the bucket's own bits are known, so a gram's 40 bits follow them."""
    return packed(keys << np.uint64(bits)) if order > 1 else keys.tobytes()


def edges_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted keys, and the end."""
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(keys)])


def count_by_bucket(texts: DataFrame, bits: int) -> DataFrame:
    """Rows (kind, bucket, keys, n): the distinct keys of an order in some chunks, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            keep = np.repeat(~c.held, c.lengths)
            for kind in ORDERS:
                keys = np.sort(c.keys(kind)[keep])
                if not len(keys):
                    continue
                edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                keys, n = keys[edge], np.diff(np.append(edge, len(keys))).astype(np.uint32)
                edges = edges_of(keys, bits)
                own = [(int(b), slice(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges))]
                rows = [pa.array([kind] * len(own), pa.int32()), pa.array([b for b, _ in own], pa.int64()), pa.array([within(keys[x], kind, bits) for _, x in own], pa.binary()), pa.array([zlib.compress(n[x].tobytes(), 1) for _, x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, ["kind", "bucket", "keys", "n"])

    return texts.mapInArrow(run, "kind int, bucket long, keys binary, n binary")


def seeds(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a key at a level; its probes follow from them."""
    a = mix(keys + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    return a, mix(a) | np.uint64(1)


def probe(a: np.ndarray, b: np.ndarray, i: int, n_bits: np.uint64) -> np.ndarray:
    """The i-th place among n_bits (under 2^32)."""
    return ((a + np.uint64(i) * b) >> np.uint64(32)) * n_bits >> np.uint64(32)


def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    """1 + floor(log_base c)."""
    return (1 + np.floor(np.log(counts) / math.log(base) + 1e-9)).astype(np.int64)


def low(level: np.ndarray, base: float) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(level > 0, np.ceil(base ** (level - 1.0) - 1e-9), 0)


def high(level: np.ndarray, base: float) -> np.ndarray:
    """The largest count of a level; 0 for level 0."""
    return np.where(level > 0, np.maximum(low(level, base), np.ceil(base ** level.astype(float) - 1e-9) - 1), 0)


def build(counted: DataFrame, base: float, bits_per_key: float, k: int) -> DataFrame:
    """One row per kind and bucket: keys and counts of words, or the bits of the grams' filter."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, bucket, keys, n = 0, 0, [], []
        for part in parts:
            kind, bucket = part.column("kind")[0].as_py(), part.column("bucket")[0].as_py()
            for data, own in zip(part.column("keys").to_pylist(), part.column("n").to_pylist()):
                keys.append(unpacked(data) if kind > 1 else np.frombuffer(data, np.uint64))
                n.append(np.frombuffer(zlib.decompress(own), np.uint32))
        keys, n = np.concatenate(keys), np.concatenate(n)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order].astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n = keys[edges], np.add.reduceat(n, edges)
        if kind > 1:
            level = level_of(n, base)
            n_bits = -(-int(level.sum() * bits_per_key) // 64) * 64
            held = np.zeros(n_bits, bool)
            for step in range(1, int(level.max()) + 1):
                a, b = seeds(keys[level >= step], step)
                for i in range(k):
                    held[probe(a, b, i, np.uint64(n_bits))] = True
            data, extra = np.packbits(held, bitorder="little").tobytes(), b""
        else:
            # counts over 254 stand in a list of their own
            many = n > 254
            data, extra = keys.tobytes(), np.where(many, 255, n).astype(np.uint8).tobytes() + n[many].tobytes()
        row = [pa.array([kind], pa.int32()), pa.array([bucket], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([len(data) + len(extra)], pa.int64()), pa.array([data], pa.binary()), pa.array([extra], pa.binary())]
        yield pa.RecordBatch.from_arrays(row, ["kind", "bucket", "keys", "total", "bytes", "data", "extra"])

    return counted.groupBy("kind", "bucket").applyInArrow(run, "kind int, bucket long, keys long, total long, bytes long, data binary, extra binary")


def counts_of(keys: np.ndarray, data: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Counts of words of a bucket; 0 where it doesn't hold them."""
    held = np.frombuffer(data, np.uint64)
    small = np.frombuffer(extra, np.uint8, len(held))
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    n = np.where(held[at] == keys, small[at], 0).astype(np.int64)
    if (many := np.flatnonzero(n == 255)).size:
        n[many] = np.frombuffer(extra, np.int64, offset=len(held))[np.searchsorted(np.flatnonzero(small == 255), at[many])]
    return n


def levels_of(keys: np.ndarray, data: np.ndarray, first: np.ndarray, n_bits: np.ndarray, k: int) -> np.ndarray:
    """Levels of grams (their 40 bits, see unpacked) by repeated probes of filters that stand end to end in data: each key's begins at bit first and has n_bits (0: none)."""
    level, alive, step = np.zeros(len(keys), np.int64), np.flatnonzero(n_bits), 1
    while len(alive):
        a, b = seeds(keys[alive], step)
        for i in range(k):
            at = first[alive] + probe(a, b, i, n_bits[alive])
            held = (data[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            a, b, alive = a[held], b[held], alive[held]
        level[alive] = step
        step += 1
    return level


def end_to_end(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each value begins, and the end."""
    held = (column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()).cast(pa.large_binary())  # one chunk is not copied
    data = held.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]


class Run:
    """Some buckets of the model that follow one another: rows kind, bucket, data, extra in that order.

    An order's filters are probed together, where they stand, so that a chunk costs no
    calls per bucket.
    """

    def __init__(self, rows: pa.Table):
        kind, bucket = rows.column("kind").to_numpy(), rows.column("bucket").to_numpy()
        self.data, at = end_to_end(rows.column("data"))
        extra, to = end_to_end(rows.column("extra"))
        self.low, self.high = (int(bucket.min()), int(bucket.max())) if len(bucket) else (0, -1)
        self.words = {int(bucket[i]): (self.data[at[i] : at[i + 1]], extra[to[i] : to[i + 1]]) for i in np.flatnonzero(kind == 1)}
        self.first, self.n_bits = ({order: np.zeros(self.high - self.low + 1, np.uint64) for order in ORDERS} for _ in range(2))
        for order in ORDERS:
            own = kind == order
            self.first[order][bucket[own] - self.low] = 8 * at[:-1][own]
            self.n_bits[order][bucket[own] - self.low] = 8 * np.diff(at)[own]

    def answers(self, kind: int, keys: np.ndarray, edges: np.ndarray, k: int) -> np.ndarray:
        """Counts (words, by whole keys) or levels (grams, by their 40 bits) of keys in order of buckets; edges: where each of low .. high begins, and the end."""
        if kind > 1:
            n = np.diff(edges)
            return levels_of(keys, self.data, np.repeat(self.first[kind], n), np.repeat(self.n_bits[kind], n), k)
        out = np.zeros(len(keys), np.int64)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            if b + self.low in self.words:
                mine = slice(edges[b], edges[b + 1])
                out[mine] = counts_of(keys[mine], *self.words[b + self.low])
        return out


SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


class Scorer:
    """The scores of a chunk whose counts and levels are known."""

    def __init__(self, n_train: int, n_words: int, n_texts: int, share: float, share3: float, base: float):
        self.n_train, self.n_words, self.n_texts, self.share, self.share3, self.base = n_train, n_words, n_texts, share, share3, base

    def __call__(self, c: Chunk, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> pa.RecordBatch:
        p = (words + ADD) / (self.n_train + ADD * (self.n_words + 1))
        of = c.shifted(words.astype(np.float64), self.n_texts)  # every word, and the start, is followed by one token
        p2 = np.where(of > 0, self.share * np.minimum(low(pairs, self.base), of) / np.maximum(of, 1) + (1 - self.share) * p, p)
        of = c.shifted(high(pairs, self.base), 0)
        p3 = np.where(of > 0, self.share3 * np.minimum(low(triples, self.base), of) / np.maximum(of, 1) + (1 - self.share3) * p2, p2)
        known = c.sums((words > 0).astype(np.int64))
        return pa.RecordBatch.from_arrays([c.ids.cast(pa.int64()), pa.array(c.held), pa.array(c.lengths), pa.array(known), pa.array(c.sums(np.log10(p))), pa.array(c.sums(np.log10(p3)))], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def asked(c: Chunk, kind: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct keys of an order, sorted; each token's place among them; and the buckets' edges."""
    keys, at = np.unique(c.keys(kind), return_inverse=True)
    return keys, at, edges_of(keys, bits)


def score(docs: DataFrame, held_out: str, share: float = 0.2, share3: float = 0.2, base: float = 2.0, bits_per_key: float = 8.0, k: int = 5, shard_bytes: int = 256 << 20, piece_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of its probability).

    held_out: name of a boolean column; rows where it is true are not learned from.
    """
    texts = whole_texts(docs, F.col(id_col).cast("long").alias("id"), F.col(held_out).alias("held"), F.col(text_col).cast("string").alias("text"))
    size, n_texts = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.coalesce("held", F.lit(False)))).first()
    bits = max(0, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    built = written(build(count_by_bucket(texts, bits), base, bits_per_key, k))
    sums = built.where("kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("keys"), F.lit(0))).first()
    scorer = Scorer(*sums, n_texts, share, share3, base)
    total = built.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    out = _broadcast(texts, built, bits, k, scorer, piece_bytes) if total <= shard_bytes else _dealt(texts, built, bits, k, scorer)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(sums[0]).cast("long").alias("train_tokens"), "base_score", "score")


def _broadcast(texts: DataFrame, built: DataFrame, bits: int, k: int, scorer: Scorer, piece_bytes: int) -> DataFrame:
    """Scores by the whole model in every worker; it is within shard_bytes."""
    sc = texts.sparkSession.sparkContext
    runs, room = [], 0
    for r in built.groupBy("bucket").agg(F.sum("bytes").alias("b")).orderBy("bucket").collect():  # a row of sizes per bucket
        if r["b"] > room:
            runs.append([r["bucket"], r["bucket"]])
            room = piece_bytes
        runs[-1][1] = r["bucket"]
        room -= r["b"]
    columns = ("kind", "bucket", "data", "extra")
    held = [sc.broadcast(built.where(F.col("bucket").between(*run)).select(*columns).toArrow().sort_by([("kind", "ascending"), ("bucket", "ascending")]).combine_chunks()) for run in runs]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Run(piece.value) for piece in held]
        for c in chunks(batches):
            found = []
            for kind in ORDERS:
                keys, at, edges = asked(c, kind, bits)
                values = np.zeros(len(keys), np.int64)
                probes = keys if kind == 1 else keys << np.uint64(bits) >> np.uint64(24) << np.uint64(24)
                for run in own:
                    mine = edges[run.low : run.high + 2]
                    values[mine[0] : mine[-1]] = run.answers(kind, probes[mine[0] : mine[-1]], mine - mine[0], k)
                found.append(values[at])
            yield scorer(c, *found)

    return texts.mapInArrow(whole, SCORES)


def _dealt(texts: DataFrame, built: DataFrame, bits: int, k: int, scorer: Scorer) -> DataFrame:
    """The same scores by dealing probes to buckets and answers back to chunks; no task holds more than a bucket or a chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            row = [pa.array([c.ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (c.held, c.lengths, c.tokens))]
            yield pa.RecordBatch.from_arrays(row, ["ids", "held", "lengths", "tokens"])

    def back(held: bytes, lengths: bytes, tokens: bytes, ids: list) -> Chunk:
        return Chunk(pa.array(ids, pa.int64()), np.frombuffer(held, bool), np.frombuffer(lengths, np.int64), np.frombuffer(tokens, np.uint64))

    table = written(texts.mapInArrow(cut, "ids array<long>, held binary, lengths binary, tokens binary").withColumn("chunk", F.monotonically_increasing_id()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = back(r["held"], r["lengths"], r["tokens"], [])
                for kind in ORDERS:
                    keys, _, edges = asked(c, kind, bits)
                    own = np.flatnonzero(np.diff(edges)).tolist()
                    columns = [[kind] * len(own), own, [r["chunk"]] * len(own), [within(keys[edges[b] : edges[b + 1]], kind, bits) for b in own]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["kind", "bucket", "chunk", "keys"])

    def answer(asks: pa.Table, own: pa.Table) -> pa.Table:
        # all chunks' keys of the bucket together: they are bounded as its counts are
        found = []
        if asks.num_rows:
            kind = asks.column("kind")[0].as_py()
            parts = [unpacked(x) if kind > 1 else np.frombuffer(x, np.uint64) for x in asks.column("keys").to_pylist()]
            keys, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
            model = Run(own)
            values = model.answers(kind, keys, np.array([0, len(keys)]), k) if own.num_rows else np.zeros(len(keys), np.int64)
            found = [zlib.compress(x.tobytes(), 1) for x in np.split(values, ends[:-1])]
        return pa.Table.from_arrays([*(asks.column(c) for c in ("chunk", "kind", "bucket")), pa.array(found, pa.binary())], ["chunk", "kind", "bucket", "found"])

    def end(rows: pa.Table, found: pa.Table) -> pa.Table:
        r = rows.to_pylist()[0]
        c, parts = back(r["held"], r["lengths"], r["tokens"], r["ids"]), sorted((x["kind"], x["bucket"], x["found"]) for x in found.to_pylist())
        values = [np.concatenate([np.frombuffer(zlib.decompress(f), np.int64) for kind, _, f in parts if kind == own])[np.unique(c.keys(own), return_inverse=True)[1]] for own in ORDERS]
        return pa.Table.from_batches([scorer(c, *values)])

    asks = table.select("chunk", "held", "lengths", "tokens").mapInArrow(ask, "kind int, bucket long, chunk long, keys binary")
    keys = ["kind", "bucket"]
    found = asks.groupBy(keys).cogroup(built.select(*keys, "data", "extra").groupBy(keys)).applyInArrow(answer, "chunk long, kind int, bucket long, found binary")
    return table.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(end, SCORES)
