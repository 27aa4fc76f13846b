"""BPE encoding and decoding with the vocabulary file of a public tokenizer.

Each word is encoded by a priority queue of merge ranks over a doubly linked
list of symbols; queue entries whose symbols have changed since are skipped.
Words repeat, so a task keeps the ids of those it has met (a bounded cache).
Decoding concatenates vocabulary strings, with one space between tokens where
the file names no decoder.

Every text is encoded whole. Null and empty texts give no tokens. Repeated rows
give repeated rows; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from safesight.llm.common import whole_texts

#: Unicode white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Marks (and one second half of a pair) newer than the library's Unicode version, which therefore
# neither reorders nor composes them.
NEW_MARKS = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF "
    "10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 "
    "11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
KNOWN = re.compile("[^" + "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in NEW_MARKS.split()) + "]+")

#: The split pattern of this kind of vocabulary (contractions, letters, single digits, the rest).
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a word-end BPE vocabulary (lower case, byte letters)."""

    def __init__(self, path: str, cache_words: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.letters = byte_letters()
        self.words = regex.compile(WORD)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_words = cache_words

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one word."""
        shown = [self.letters[b] for b in word.encode("utf-8", "replace")]
        shown[-1] += self.end
        ids = [self.vocab[s] for s in shown if s in self.vocab]
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # stale: one of the symbols has been merged since
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if m := self.merges.get((new, ids[k])):
                    heapq.heappush(queue, (m[0], i, m[1], new, ids[k]))
            if (h := left[i]) >= 0 and (m := self.merges.get((ids[h], new))):
                heapq.heappush(queue, (m[0], h, m[1], ids[h], new))
        return tuple(i for i in ids if i >= 0)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; the special tokens' own strings in it are those tokens."""
        out: list[int] = []
        cache = self.cache
        for part in self.marks.split(text or ""):
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii():
                if not unicodedata.is_normalized("NFC", part):
                    part = KNOWN.sub(lambda m: unicodedata.normalize("NFC", m[0]), part)
                part = part.replace("Σ", "σ")  # lower() treats a final sigma by its place
            for word in self.words.findall(part.lower()):
                found = cache.get(word)
                if found is None:
                    if len(cache) >= self.cache_words:
                        cache.clear()
                    found = self.merge(word)
                    if len(word) < 256:
                        cache[word] = found
                out += found
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids, joined by one space (the file has no decoder)."""
        return " ".join(map(self.strings.__getitem__, ids))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids array<int>, decoded string. vocabulary: a path that every worker can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return whole_texts(docs, F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), but n_tokens, ids_sha256 (decimal ids joined by one space) and decoded_sha256 instead of the arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(vocabulary)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                n.append(len(ids))
                a.append(sha(" ".join(map(str, ids))))
                b.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return whole_texts(docs, F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
