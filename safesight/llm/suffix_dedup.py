"""Repeated passages, by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``least`` bytes that covers it also starts in a document
with a smaller id. The corpus is never sorted as one text. Every window of ``least``
bytes is dealt by its anchor, the least hash of the grams of GRAM bytes inside it, so
equal windows meet whatever text holds them. Whole copies of a text with a smaller id go
first, by the text's hash. For the others:

1. Anchors of all windows are counted (a row per run of windows with one anchor); those
   of one document alone are done with.
2. Runs of the others are written with their bytes, equal ones collapse to one kind
   with the least and the largest document that hold it.
3. Kinds of an anchor, and of many anchors at a time, are joined to one text of some
   TEXT_BYTES. Its transform is expanded breadth first: rows whose common prefix with
   the row before has 0, 1, 2, .. bytes are marked by backward extension, up to
   least - 1, where it stops. What no mark separates shares ``least`` bytes.
4. The least document of each such interval goes back to the runs, and cuts them.

Anchors whose kinds hold over HOT_BYTES (a boundary of a passage on a third of all
documents) would be one task; their windows are aggregated one by one instead, with
map-side combine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from safesight.llm.common import by_ids, discard, forget, in_parts, mix, table_path, whole_texts, written

#: Bytes of the grams whose least hash is a window's anchor; a shorter window has shorter ones.
GRAM = 20
#: Windows that are hashed together.
SLICE = 1 << 20
#: Bytes of a text that is transformed; kinds of one anchor beyond HOT_BYTES are not.
TEXT_BYTES, HOT_BYTES = 512 << 10, 2 << 20
#: The filter of shared anchors: bits an anchor, and its largest size. It only saves shuffles: a weaker one lets more runs through, which step 3 drops.
FILTER_BITS, FILTER_MAX, FILTER_PIECE = 24, 1 << 29, 1 << 20
#: Ends a piece in a text; no byte of UTF-8.
END = 0xFF
#: A document's place of a byte, with 32 bits of its text's hash above: texts that share an id stay apart.
PLACE_BITS = 31

_FACTOR = 0x9E3779B97F4A7C15


@cache
def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def least_in_window(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every width values in a row."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def window_runs(data: np.ndarray, edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in texts that end at edges: first byte, number of windows, anchor, hash of the run's bytes."""
    gram = min(GRAM, (least + 1) // 2)
    inside = np.zeros(len(data) + 1, np.int8)
    long = np.diff(edges) >= least
    inside[edges[:-1][long]] += 1
    inside[edges[1:][long] - least + 1] -= 1
    inside = np.cumsum(inside, dtype=np.int8).view(bool)
    power, inverse = _powers(_FACTOR, SLICE + least), _powers(pow(_FACTOR, -1, 1 << 64), SLICE + least)
    found = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))]
    for a in range(0, len(data) - least + 1, SLICE):
        part = data[a : a + SLICE + least - 1].astype(np.uint64)
        part += np.uint64(1)
        part *= power[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        anchor = least_in_window(mix((sums[gram:] - sums[:-gram]) * inverse[: len(part) - gram + 1]), least - gram + 1)
        at = np.flatnonzero(inside[a : a + len(anchor)])
        if not len(at):
            continue
        own = anchor[at]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])]))
        start, n = at[first], np.diff(np.append(first, len(at)))
        kind = (sums[start + n + (least - 1)] - sums[start]) * inverse[start] + n.astype(np.uint64) * np.uint64(_FACTOR >> 1)
        # least hashes are small: scrambled once more, they are spread evenly
        found.append((start + a, n, mix(own[first] + np.uint64(_FACTOR)), mix(kind)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with the bytes of their texts on end, and the edges."""
    for part in in_parts(batches):
        texts = part.column("text").cast(pa.large_binary())
        texts = texts.fill_null(b"") if texts.null_count else texts
        if not len(texts):
            continue
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[edges[0] : edges[-1]] if held else np.zeros(0, np.uint8)
        yield part, data, edges - edges[0]


def _anchors(texts: DataFrame, least: int) -> DataFrame:
    """A row (h, doc_id) per run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, edges in _texts(batches):
            start, _, anchor, _ = window_runs(data, edges, least)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ids[np.searchsorted(edges, start, "right") - 1])], ["h", "doc_id"])

    return texts.select("doc_id", "text").mapInArrow(run, "h long, doc_id long")


class AnchorFilter:
    """A bit per anchor hash, in pieces that the driver collects: FILTER_MAX / 8 bytes at most, whatever the corpus."""

    def __init__(self, shared: DataFrame):
        n = shared.count()
        self.bits = min(int(math.log2(FILTER_MAX)), max(int(math.log2(FILTER_PIECE)), math.ceil(math.log2(max(1, n * FILTER_BITS)))))
        place = F.shiftrightunsigned("h", 64 - self.bits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                at = b.column("at").to_numpy()
                for k in np.unique(at // FILTER_PIECE).tolist():
                    held.setdefault(k, np.zeros(FILTER_PIECE, bool))[at[at // FILTER_PIECE == k] % FILTER_PIECE] = True
            for k, own in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["k", "bits"])

        data = bytearray((1 << self.bits) // 8)
        dealt = shared.select(place.alias("at")).repartition(F.shiftright("at", int(math.log2(FILTER_PIECE))))
        for r in dealt.mapInArrow(run, "k long, bits binary").toLocalIterator():
            data[r["k"] * FILTER_PIECE // 8 : (r["k"] + 1) * FILTER_PIECE // 8] = r["bits"]
        self.data = shared.sparkSession.sparkContext.broadcast(bytes(data))

    def hits(self, anchor: np.ndarray) -> np.ndarray:
        """Whether anchors may be shared."""
        at = (anchor >> np.uint64(64 - self.bits)).view(np.int64)
        return (np.frombuffer(self.data.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _spots(texts: DataFrame, shared: AnchorFilter, least: int) -> DataFrame:
    """Runs whose anchor may be shared: h, g (hash of the bytes), doc_id, at, piece (the bytes, once per batch and run's kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, edges in _texts(batches):
            start, n, anchor, kind = (x[...] for x in window_runs(data, edges, least))
            keep = shared.hits(anchor)
            start, n, anchor, kind = start[keep], n[keep], anchor[keep], kind[keep]
            doc = np.searchsorted(edges, start, "right") - 1
            at = (start - edges[doc]) | part.column("tag").to_numpy()[doc] << PLACE_BITS
            once = np.zeros(len(kind), bool)
            once[np.unique(kind, return_index=True)[1]] = True
            raw = data.tobytes()
            pieces = [raw[a : a + k] if o else None for a, k, o in zip(start.tolist(), (n + least - 1).tolist(), once.tolist())]
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[doc]
            columns = [pa.array(anchor.view(np.int64)), pa.array(kind.view(np.int64)), pa.array(ids), pa.array(at), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "g", "doc_id", "at", "piece"])

    return texts.mapInArrow(run, "h long, g long, doc_id long, at long, piece binary")


# the transform of one text


def suffix_order(text: np.ndarray, left: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order; each ends with its own piece, equal ones come by piece.

    text: pieces, each followed by END; left: bytes up to the piece's END; owner: its number.
    The first eight bytes give ranks, which double in length while any are tied.
    """
    n, key = len(text), np.zeros(len(text), np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | np.where(left >= j, padded[j : n + j], np.uint64(0))
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    length = 8
    while True:
        slots = np.flatnonzero(~first | ~np.append(first[1:], True))  # those of tied groups
        if not len(slots):
            return order
        at = order[slots]
        follows = np.where(left[at] >= length, rank[np.minimum(at + length, n - 1)], n + owner[at])
        key = rank[at] << 32 | follows
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first[slots] = new
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        length *= 2


def intervals(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Whether each suffix, in order, shares under ``least`` bytes with the one before.

    Breadth-first backward extension: row r and the row before start with the same byte
    c, and c's occurrences p and i in the transform follow each other there. If rows p+1
    to i hold a mark of exactly l bytes and none of fewer, r's is l + 1. So marks of l
    give all those of l + 1, and the rows of END (each its own) and of a new byte are 0.
    """
    before = text[order - 1]
    rows = np.argsort(before, kind="stable")  # where the byte that a row starts with stands in the transform
    lead = text[order]
    new = np.ones(len(order), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (lead[1:] == END)
    marked = new.copy()
    open_ = np.flatnonzero(~marked)
    i, p = rows[open_], rows[open_ - 1]
    for _ in range(least - 1):
        seen = np.cumsum(new, dtype=np.int32)
        hit = seen[i] > seen[p]
        if not hit.any():
            break
        new = np.zeros(len(order), bool)
        new[open_[hit]] = True
        marked |= new
        rest = ~hit
        open_, i, p = open_[rest], i[rest], p[rest]
    return marked


def lows_of(pieces: list[bytes], docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of pieces, each followed by END: the least of docs (one a piece) that holds the ``least`` bytes from there; and the pieces' starts."""
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    size = np.array([len(p) + 1 for p in pieces])
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(pieces)), size)
    left = (start + size - 1)[owner] - np.arange(len(text))
    order = suffix_order(text, left, owner)
    edge = np.flatnonzero(intervals(text, order, least))
    low = np.empty(len(text), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(docs[owner[order]], edge), np.diff(np.append(edge, len(order))))
    return low, start


def _decided(kinds: dict[str, list], least: int) -> pa.RecordBatch:
    """Runs of windows (h, g, a, b, lo) of whole groups of kinds, where lo, the least document with them, is not the kind's largest."""
    h, g, lo, hi = (np.array(kinds[c], np.int64) for c in ("h", "g", "lo", "hi"))
    pieces = kinds["piece"]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(edge, len(h)))
    live = np.repeat(np.minimum.reduceat(lo, edge) < np.maximum.reduceat(hi, edge), size)
    alone = np.repeat(size == 1, size)  # an interval of one string needs no expansion
    own = np.flatnonzero(live & alone)
    found = [(h[own], g[own], np.zeros(len(own), np.int64), np.array([len(pieces[k]) - least + 1 for k in own], np.int64), lo[own])]
    own = np.flatnonzero(live & ~alone)
    if len(own):
        low, start = lows_of([pieces[k] for k in own], lo[own], least)
        n = np.array([len(pieces[k]) - least + 1 for k in own])
        of = np.repeat(np.arange(len(own)), n)
        within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        value = low[start[of] + within]
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (value[1:] != value[:-1])]))
        first_of, a = of[first], within[first]
        b = a + np.diff(np.append(first, len(of)))
        keep = value[first] < hi[own][first_of]
        found.append((h[own][first_of][keep], g[own][first_of][keep], a[keep], b[keep], value[first][keep]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["h", "g", "a", "b", "lo"])


def _expanded(kinds: DataFrame, least: int) -> DataFrame:
    """Runs of windows with the least document that holds them (see _decided), text after text of whole groups."""
    names = ["h", "g", "lo", "hi", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in names}
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if size >= TEXT_BYTES and row[0] != held["h"][-1]:
                    yield _decided(held, least)
                    held, size = {c: [] for c in names}, 0
                for c, v in zip(names, row):
                    held[c].append(v)
                size += len(row[-1])
        if size:
            yield _decided(held, least)

    return kinds.select(*names).repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, g long, a long, b long, lo long")


def _one_by_one(kinds: DataFrame, least: int) -> DataFrame:
    """The same for hot anchors: windows as rows, equal ones aggregated."""
    windows = kinds.select("h", "g", "lo", "hi", "piece", F.explode(F.sequence(F.lit(1), F.octet_length("piece") - (least - 1))).alias("k")).withColumn("w", F.expr(f"substring(piece, k, {least})"))
    low = windows.groupBy("h", "w").agg(F.min("lo").alias("low"), F.max("hi").alias("high")).where("low < high").select("h", "w", "low")
    return windows.join(low, ["h", "w"]).where("low < hi").select("h", "g", (F.col("k") - 1).cast("long").alias("a"), F.col("k").cast("long").alias("b"), F.col("low").alias("lo"))


def find(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (32 bits of the text's hash) and cuts, the runs of bytes (start, stop) that also start in a document with a smaller id; runs may overlap."""
    spark = docs.sparkSession
    texts = whole_texts(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= least)).select("doc_id", "text", _tag("text").alias("tag"))
    paths = [table_path(spark) for _ in range(6)]
    ends = F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")
    hashed = texts.select("doc_id", "tag", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha"))
    several = hashed.groupBy("sha").agg(*ends).where("lo < hi").select("sha", "lo")
    copies = written(hashed.join(several, "sha").where("doc_id > lo").select("doc_id", "tag", "n").distinct(), paths[0])
    own = by_ids(texts, copies.select("doc_id", "tag"), ["doc_id", "tag"], "left_anti")
    shared = written(_anchors(own, least).groupBy("h").agg(*ends).where("lo < hi").select("h"), paths[1])
    forget(spark)
    spots = written(_spots(own, AnchorFilter(shared), least), paths[2], "zstd")
    kinds = written(spots.groupBy("h", "g").agg(*ends, F.first("piece", ignorenulls=True).alias("piece")), paths[3], "zstd")
    forget(spark)
    hot = written(kinds.groupBy("h").agg(F.sum(F.octet_length("piece")).alias("n")).where(F.col("n") > HOT_BYTES).select("h"), paths[4])
    runs = _expanded(by_ids(kinds, hot, "h", "left_anti"), least).unionByName(_one_by_one(by_ids(kinds, hot, "h", "left_semi"), least))
    spans = _spans(spots, runs, least)
    whole = copies.select("doc_id", "tag", F.array(_cut(F.lit(0).cast("long"), F.col("n"))).alias("cuts"))
    cuts = written(spans.unionByName(whole).groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("cuts")).alias("cuts")), paths[5])
    for path in paths[:5]:
        discard(spark, path)
    forget(spark)
    return cuts


def _spans(spots: DataFrame, runs: DataFrame, least: int) -> DataFrame:
    """doc_id, tag and cuts of every spot that loses bytes. A kind's runs are one row (no more than its windows), so the join gives a row per spot at most."""
    kinds = runs.groupBy("h", "g").agg(F.min("lo").alias("lo"), F.collect_list(F.struct("a", "b", "lo")).alias("runs"))
    met = spots.select("h", "g", "doc_id", "at").join(kinds.hint("merge"), ["h", "g"]).where("lo < doc_id")
    at = F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    earlier = F.filter("runs", lambda r: r["lo"] < F.col("doc_id"))
    cuts = F.transform(earlier, lambda r: _cut(at + r["a"], at + r["b"] + (least - 1)))
    return met.select("doc_id", F.shiftrightunsigned("at", PLACE_BITS).alias("tag"), cuts.alias("cuts"))


def _cut(start: Column, stop: Column) -> Column:
    return F.struct(start.alias("start"), stop.alias("stop"))


def _tag(text: str):
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))


def remove(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without repeated passages: doc_id, n_bytes, kept (binary, as cuts are between bytes), spans (start, stop) that went.

    A byte goes if a string of ``least`` bytes that covers it also starts in a document with
    a smaller id. Null text: empty. Null id: the document neither loses bytes nor takes any
    from others. Repeated rows (one id) lose the same bytes, none to each other. Other
    columns of docs don't matter. Strings are judged on the input, in bytes of UTF-8.
    """
    cuts = find(docs, least, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "cuts")
    texts = whole_texts(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tag", F.coalesce(_tag("text"), F.lit(0)))
    joined = texts.join(cuts.hint("shuffle_hash"), (F.col("doc_id") == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select("doc_id", F.col("text").cast("binary").alias("text"), "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            out = []
            for raw, cuts in zip(part.column("text").to_pylist(), part.column("cuts").to_pylist()):
                raw, spans, kept, done = raw or b"", [], [], 0
                for cut in sorted((c["start"], c["stop"]) for c in cuts or []):
                    if spans and cut[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], cut[1])
                    else:
                        spans.append(list(cut))
                for a, b in spans:
                    kept.append(raw[done:a])
                    done = b
                kept.append(raw[done:])
                out.append((len(raw), b"".join(kept), [{"start": a, "stop": b} for a, b in spans]))
            kinds = pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["doc_id", "n_bytes", "kept", "spans"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>")


def digests(docs: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    done = remove(docs, least)
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
