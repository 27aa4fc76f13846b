"""URL filters: glob rules packed into multiword Shift-And masks.

Each rule becomes a run of pattern positions in one long bit string (64-bit
words). All rules are simulated at once over each canonical URL, and all URLs of
a batch side by side: one shift, one mask and one self-loop step per character.

A canonical URL is "." + host + path. Host: after the first "://" up to "/",
"?", "#" or the end, A-Z lower-cased; path: then up to "?", "#" or the end. A
null URL or one without "://" has an empty host and path and fits no rule.
Rules: literal characters, "*" (any run of characters) and "~" (any run without
"/": a star that stays inside the host). Repeated rows give repeated rows; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A glob over canonical URLs; the fitting one with the largest weight decides."""

    name: str
    glob: str
    verdict: str
    weight: int


def prefix_rule(rule: str, verdict: str) -> Rule:
    """host + path prefix, fitting the host and all its subdomains; longer ones weigh more."""
    return Rule(rule, f"~.{rule}*", verdict, len(rule))


class Automaton:
    """Shift-And over all globs at once; masks have as many 64-bit words as the globs need."""

    def __init__(self, globs: list[str]):
        literals: list[bytes] = []
        start, loop_any, loop_host, last = [], [], [], []
        for glob in globs:
            raw = glob.encode()
            start.append(len(literals))
            literals.append(b"")  # the position before the first character
            if raw[:1] == b"*":
                loop_any.append(len(literals) - 1)
            if raw[:1] == b"~":
                loop_host.append(len(literals) - 1)
            for k, c in enumerate(raw):
                if c in b"*~":
                    if k:
                        (loop_any if c == 42 else loop_host).append(len(literals) - 1)
                else:
                    literals.append(bytes([c]))
            last.append(len(literals) - 1)
        self.words = (len(literals) + 63) // 64
        self.last = np.array(last)
        bits = lambda at: np.bitwise_or.reduce(np.array([self._bit(i) for i in at] or [self._bit(-1)]), axis=0)
        self.begin = bits(start)
        self.step = np.zeros((257, self.words), np.uint64)  # by character; 256: after the end
        self.stay = np.zeros((257, self.words), np.uint64)
        for i, c in enumerate(literals):
            if c:
                self.step[c[0]] |= self._bit(i)
        self.stay[:256] = bits(loop_any) | bits(loop_host)
        self.stay[ord("/")] = bits(loop_any)
        self.stay[256] = bits(range(len(literals)))

    def _bit(self, i: int) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        if i >= 0:
            out[i // 64] = np.uint64(1) << np.uint64(i % 64)
        return out

    def fits(self, texts: list[bytes]) -> np.ndarray:
        """A boolean per text and glob."""
        state = np.repeat(self.begin[None], len(texts), 0)
        longest = max(map(len, texts), default=0)
        padded = np.full((len(texts), longest), 256, np.int16)
        for row, text in enumerate(texts):
            padded[row, : len(text)] = np.frombuffer(text, np.uint8)
        for at in range(longest):
            c = padded[:, at]
            moved = state << np.uint64(1)
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (moved & self.step[c]) | (state & self.stay[c])
        return (state[:, self.last // 64] >> (self.last % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [k for c in "?#" if (k := rest.find(c)) >= 0]
    rest = rest[: min(ends)] if ends else rest
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


#: URLs that run side by side, and the characters that they are padded to together.
LANES, LANE_BYTES = 512, 1 << 20


def of_like_length(texts: list[bytes]) -> Iterator[list[int]]:
    """Places of the texts, shortest first, in runs whose padding stays small; a very long one is alone."""
    rows: list[int] = []
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if rows and (len(rows) == LANES or (len(rows) + 1) * len(texts[i]) > LANE_BYTES or len(texts[i]) > 2 * len(texts[rows[0]]) + 64):
            yield rows
            rows = []
        rows.append(i)
    if rows:
        yield rows


def judge(pages: DataFrame, rules: list[Rule], otherwise: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict, glob.

    rules decide first (largest weight); where none fits, otherwise (largest
    weight) does, and glob names it; else the default verdict stands.
    """
    every = [*rules, *otherwise]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton([r.glob for r in every])
        weight = np.array([r.weight + 1 for r in every])
        n = len(rules)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = np.zeros((len(parts), len(every)), bool)
            canonical = [f".{h}{p}".encode("utf-8", "replace") if h or p else b"" for h, p in parts]
            for rows in of_like_length(canonical):
                found[rows] = machine.fits([canonical[i] for i in rows])
            scored = found * weight
            own, other = scored[:, :n], scored[:, n:]
            best, rest = own.argmax(1) if n else np.zeros(len(parts), int), other.argmax(1) if len(every) > n else np.zeros(len(parts), int)
            names, verdicts, globs = [], [], []
            for i in range(len(parts)):
                if n and own[i, best[i]]:
                    names.append(rules[best[i]].name)
                    verdicts.append(rules[best[i]].verdict)
                    globs.append(None)
                elif otherwise and other[i, rest[i]]:
                    names.append(None)
                    verdicts.append(otherwise[rest[i]].verdict)
                    globs.append(otherwise[rest[i]].glob)
                else:
                    names.append(None)
                    verdicts.append(default)
                    globs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], names, verdicts, globs))], ["id", "host", "path", "rule", "verdict", "glob"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, glob string").withColumnRenamed("id", id_col)


#: The fixed rules of the registered query.
QUERY_RULES = [
    prefix_rule("com/", "allow"),
    prefix_rule("example.com/en/", "block"),
    prefix_rule("www.example.com/en/", "allow"),
    prefix_rule("net/es/", "block"),
    prefix_rule("net/fr/", "block"),
]

#: What decides where no rule fits: host globs of unwanted kinds of sites, else allow.
QUERY_GLOBS = [Rule(word, f".~{word}~", "block", len(word)) for word in ("adult-", "-adult", "casino", "free-bets", "porn")]
QUERY_GLOBS = [r._replace(glob=f"{r.glob}/*") for r in QUERY_GLOBS] + QUERY_GLOBS

ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h0, regexp_extract(rest, '^[^?#]*') AS hp FROM u),
s AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(hp, length(h0) + 1) AS path FROM h),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM s)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, 'adult-|-adult|casino|free-bets|porn') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
