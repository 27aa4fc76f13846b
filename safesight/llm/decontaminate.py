"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows.

A document leaks an item when some run of its words is within floor(rate x n)
word edits of the item's n words. Words are lower-cased (A-Z) and stripped of
ASCII punctuation at their ends.

An item of two PIECE or more words is cut into pieces of PIECE to one and a half
PIECE words: one of them has no more than its share of the edits. Pieces (shorter items
are one) fall in size classes with a stride and a window: a copy's least length, less
what the stride takes. The document's windows start at multiples of the stride, and
one ends at its last word; the piece's start at each of its words. So some pair of
windows is aligned within every copy, however its words are deleted and wherever it
stands. A window goes on if enough of its words and neighbouring pairs of words occur
in the benchmark (lossless: an edit spoils one word and two pairs at most). Those are
embedded by the random walk of Chakraborty, Goldenberg and Koucky (2016), which maps
edit distance to Hamming distance; sampled positions of the embedding are LSH keys.
Walks and samples repeat until ``recall`` is reached at the largest distance, by
deletions alone (the worst edits: they shift what follows and shorten the copy), as
measured on random pieces of the class (see repeats). Each candidate is
verified by the exact edit distance of the whole item, so there are no false
alarms.

Items go to the workers in parts of at most ``part_words`` words (documents are
read once for each part); document text is never shuffled. Null and empty
texts leak nothing, and items without words are never leaked. Items of one word on
are searched; those of under five words must stand in a text as they are, which
common ones do by chance, so a caller may leave items under ``min_words`` words out.
Repeated items and rows give repeated results; columns besides ids and texts are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from safesight.llm.common import in_parts, mix, whole_texts, word_hashes

PIECE = 24
SAMPLE = 4
SAMPLES_PER_WALK = 4
#: More keys than these are an error: the recall asked for can't be had.
MAX_KEYS = 160
#: Windows that are embedded together.
ROWS = 1000


def embed(windows: np.ndarray, walks: int) -> np.ndarray:
    """CGK: rows of word ids to walks x rows x 2 w symbols (-9 after the end); a walk's coin depends on step and symbol.

    (A walk of 3 w steps sees a window's end almost surely; keys only sample the first 2 w.)
    """
    n, w = windows.shape
    padded = np.concatenate([windows, np.full((n, 1), -9, windows.dtype)], axis=1)
    drawn = mix(padded.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, walks + 1, dtype=np.uint64)[:, None, None] * np.uint64(100_003))
    rows = np.broadcast_to(np.arange(n) * (w + 1), (walks, n))
    own = np.arange(walks)[:, None] * (n * (w + 1)) + rows
    at, flat, coins = np.zeros((walks, n), np.int64), padded.ravel(), drawn.ravel()
    out = np.empty((2 * w, walks, n), np.int64)
    for step in range(2 * w):
        if step and step % 64 == 0:
            coins = mix(coins)
        out[step] = flat[rows + at]
        at += ((coins[own + at] >> np.uint64(step % 64)) & np.uint64(1)).view(np.int64)
        np.minimum(at, w, out=at)
    return out


def keys(windows: np.ndarray, n_keys: int) -> np.ndarray:
    """LSH keys of windows of one size: n x n_keys hashes of sampled positions (more keys begin with the same ones)."""
    w, rng = windows.shape[1], np.random.default_rng(windows.shape[1])
    positions = np.array([np.sort(rng.choice(2 * w, min(SAMPLE, 2 * w), replace=False)) for _ in range(n_keys)])
    walk, number = np.arange(n_keys) // SAMPLES_PER_WALK, np.arange(n_keys, dtype=np.uint64)
    out = np.empty((len(windows), n_keys), np.uint64)
    for lo in range(0, len(windows), ROWS):
        embedded = embed(windows[lo : lo + ROWS], int(walk[-1]) + 1)
        h = np.broadcast_to(number[:, None], (n_keys, embedded.shape[2]))
        for p in positions.T:
            h = mix(h + embedded[p, walk].view(np.uint64))
        out[lo : lo + ROWS] = h.T
    return out


def shape(low: int, rate: float) -> tuple[int, int]:
    """Window and stride of the class of pieces of low words or more."""
    stride = max(1, low // 5)
    return max(1, low - int(rate * low) - stride + 1), stride


@cache
def repeats(low: int, high: int, rate: float, recall: float, trials: int = 400) -> int:
    """Keys per window that reach the recall for the class low .. high: measured on random pieces after the most deletions."""
    width, stride = shape(low, rate)
    rng, own, copies = np.random.default_rng(low), [], []
    for t in range(trials):
        n = low if t % 2 else high
        piece = rng.integers(0, 1 << 40, n)
        copy = np.delete(piece, rng.choice(n, int(rate * n), replace=False))
        own.append([piece[o : o + width] for o in range(n - width + 1)])
        at = int(rng.integers(0, max(1, min(stride, len(copy) - width + 1))))
        copies.append(copy[at : at + width])
    of = np.repeat(np.arange(trials), [len(x) for x in own])
    same = keys(np.concatenate(own), MAX_KEYS) == keys(np.stack(copies), MAX_KEYS)[of]
    found = np.zeros((trials, MAX_KEYS), bool)
    np.logical_or.at(found, of, same)
    reached = np.maximum.accumulate(found, axis=1).mean(0)
    if reached[-1] < recall:
        raise ValueError(f"{MAX_KEYS} keys find only {reached[-1]:.3f} of the pieces of {low} to {high} words at rate {rate}, not {recall}")
    return int(np.searchsorted(reached, recall)) + 1


def best_match(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to a run of the region, and the run's end (first if tied)."""
    at = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, symbol in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != symbol))
        row = np.minimum.accumulate(new - at) + at
    end = int(row.argmin())
    return int(row[end]), end


class SizeClass:
    """The pieces of some size, and the keys of all their windows."""

    def __init__(self, low: int, high: int, pieces: list[tuple[int, int, np.ndarray]], rate: float, recall: float):
        self.width, self.stride = shape(low, rate)
        self.most = int(rate * high)  # edits of the largest piece
        self.n_keys = repeats(low, high, rate, recall)
        places = [(i, start + o, ids[o : o + self.width]) for i, start, ids in pieces for o in range(len(ids) - self.width + 1)]
        found = keys(np.stack([w for *_, w in places]), self.n_keys)
        by = np.argsort(found.ravel(), kind="stable")
        self.table = found.ravel()[by]
        self.item = np.array([i for i, *_ in places])[by // self.n_keys]
        self.offset = np.array([o for _, o, _ in places])[by // self.n_keys]
        size = 1 << (8 + len(self.table).bit_length())
        self.mask = np.uint64(size - 1)
        self.seen = np.zeros(size, bool)  # a quick look before the search
        self.seen[(self.table & self.mask).view(np.int64)] = True

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of windows with the items, and the places in them, that share a key."""
        found = keys(windows, self.n_keys)
        row, key = np.nonzero(self.seen[(found & self.mask).view(np.int64)])
        value = found[row, key]
        first, last = np.searchsorted(self.table, value), np.searchsorted(self.table, value, "right")
        n = last - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(row, n), self.item[at], self.offset[at]


class Items:
    """Vocabulary, pieces and keys of some benchmark items (id, hashes of its words)."""

    def __init__(self, items: list[tuple[int, np.ndarray]], rate: float, recall: float, min_words: int, growth: float = 1.3):
        self.rate = rate
        self.ids = [i for i, _ in items]
        self.vocabulary = np.unique(np.concatenate([*(w for _, w in items), np.zeros(0, np.uint64)]))
        self.words = [np.searchsorted(self.vocabulary, w) for _, w in items]
        pairs = [self.pair(w[:-1], w[1:]) for w in self.words]
        self.linked = [set(p.tolist()) for p in pairs]
        self.pairs = np.unique(np.concatenate([*pairs, np.array([-1])]))
        pieces = []
        for i, w in enumerate(self.words):
            edges = [j * len(w) // max(1, len(w) // PIECE) for j in range(max(1, len(w) // PIECE) + 1)]
            pieces += [(i, a, w[a:b]) for a, b in zip(edges, edges[1:])]
        self.classes: list[SizeClass] = []
        low, longest = min_words, max((len(w) for *_, w in pieces), default=0)
        while low <= longest:
            after = max(low + 1, int(low * growth))
            if own := [p for p in pieces if low <= len(p[2]) < after]:
                self.classes.append(SizeClass(low, after - 1, own, rate, recall))
            low = after

    def pair(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Codes of neighbouring words."""
        return first * len(self.vocabulary) + second

    def leaks(self, hashes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(place of the document, item, distance, first word, end) of the best match of each leaked item."""
        if not len(self.vocabulary):
            return
        # words that the benchmark doesn't have are -1, and so is what stands between documents
        doc = np.repeat(np.arange(len(lengths)), lengths + 1)
        first = np.cumsum(lengths + 1) - lengths - 1
        at = np.arange(len(doc)) - first[doc]
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        ids = np.full(len(doc), -1, np.int64)
        ids[at < lengths[doc]] = np.where(self.vocabulary[place] == hashes, place, -1)
        inside = np.concatenate([[0], np.cumsum(ids >= 0)])
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        code = self.pair(ids[both], ids[both + 1])
        linked = np.zeros(len(ids), np.int64)
        linked[both] = self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code
        linked = np.concatenate([[0], np.cumsum(linked)])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for own in self.classes:
            width = own.width
            starts = np.flatnonzero(((at % own.stride == 0) & (at + width <= lengths[doc])) | (at + width == lengths[doc]))
            starts = starts[inside[starts + width] - inside[starts] >= width - own.most]
            starts = starts[linked[starts + width - 1] - linked[starts] >= width - 1 - 2 * own.most]
            for lo in range(0, len(starts), ROWS):
                part = starts[lo : lo + ROWS]
                row, item, offset = own.candidates(ids[part[:, None] + np.arange(width)])
                for s, i, o in sorted(set(zip(part[row].tolist(), item.tolist(), offset.tolist()))):
                    d = int(doc[s])
                    begin = s - int(first[d]) - o  # of the item in the document, if nothing is edited before
                    if (d, i, begin) in tried:
                        continue
                    tried.add((d, i, begin))
                    words = self.words[i]
                    slack = int(self.rate * len(words))
                    start = max(0, begin - slack)
                    if (known := best.get((d, i))) and known[0] == 0 and known[1] <= start:
                        continue  # an exact match that is no later is known
                    region = ids[first[d] + start : first[d] + max(0, min(int(lengths[d]), begin + len(words) + slack))]
                    near = set(self.pair(region[:-1], region[1:]).tolist())
                    if len(self.linked[i] & near) < len(self.linked[i]) - 2 * slack:
                        continue  # an edit spoils two pairs at most
                    distance, end = best_match(words, region)
                    if distance <= slack:
                        _, size = best_match(words[::-1], region[:end][::-1])
                        new = (distance, start + end - size, start + end)
                        if (d, i) not in best or new < best[d, i]:
                            best[d, i] = new
        for (d, i), found in sorted(best.items()):
            yield d, i, *found


#: The items that this worker has built last: their broadcast's name, and they.
_BUILT: list[tuple[str, Items]] = []


def _items(name: str, *given) -> Items:
    if not _BUILT or _BUILT[0][0] != name:
        _BUILT[:] = [(name, Items(*given))]
    return _BUILT[0][1]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, recall: float = 0.99, min_words: int = 1, part_words: int = 200_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it leaks: ids, distance (word edits), first_word, end_word of its best match."""
    spark = docs.sparkSession
    texts = whole_texts(docs, F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    schema = f"{id_col} long, {item_col} long, distance int, first_word long, end_word long"

    def search(part: list[tuple[int, np.ndarray]]):
        shared, name = spark.sparkContext.broadcast((part, rate, recall, min_words)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _items(name, *shared.value)
            for batch in in_parts(batches):
                names = batch.column(0).to_pylist()
                rows = [(names[d], own.ids[i], *rest) for d, i, *rest in own.leaks(*word_hashes(batch.column("text"), strip=True))]
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [id_col, item_col, "distance", "first_word", "end_word"])

        return texts.mapInArrow(run, schema)

    found, part, size = None, [], 0
    for r in items.toLocalIterator():  # in parts of bounded size
        words, _ = word_hashes(pa.array([r["text"]]), strip=True)
        if len(words) < max(1, min_words):
            continue
        if part and size + len(words) > part_words:
            step = search(part)
            found = step if found is None else found.unionByName(step)
            part, size = [], 0
        part.append((r["item"], words))
        size += len(words)
    step = search(part)
    return step if found is None else found.unionByName(step)
