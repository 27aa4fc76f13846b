"""HTML extraction with a site style tree (in the manner of Yi, Liu and Li, 2003).

Pages are parsed into nodes; the pages of one host are merged by style: a style
node is the path of tags and classes down to an element. Two entropies measure a
style node over the host's pages: presentation (how much its sequence of child
styles varies) and content (how rarely its blocks of text recur on other pages).
Branches of low composite importance are dropped from every page: repeated
boilerplate is low in both. Menus, adverts and footers whose words change from page
to page look important to entropies alone, so elements whose tag, class, id or role
names such a part are dropped whatever their importance, and where a page marks an
article or main element, blocks outside it are. A named element that holds the
article, or most of the page's text, is a wrapper and no such part: only its
entropies decide. Inside an article the entropies judge whole branches (divisions,
sections, lists), and drop nothing that is a plain block (a paragraph that many
pages share is text); they never drop an article's whole text.

Counts per host are pre-aggregated by page batch and then by style node, so that one
host with most pages is no group of its own; its pages are never gathered.

Output text: the kept blocks, one line each, white space turned into one
space, character references decoded. Null and empty pages give empty text. The
host of a page without a URL is empty, and such pages are merged. Repeated rows
give repeated rows; columns besides id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
import string
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from safesight.llm.common import cut
from safesight.llm.url_rules import split_url

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NOISE_TAGS = frozenset("nav header footer aside form menu button dialog head script style noscript template iframe svg select textarea object".split())
NOISE_NAMES = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form header menu modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Their readers' words may outweigh the text, so these are wrappers only if all of it is inside.
TALK_NAMES = frozenset("comment comments disqus replies reply".split())
ARTICLES = frozenset(("article", "main"))
#: What the entropies judge as a whole inside an article.
BRANCHES = frozenset("details div dl ol section ul".split())
P_ENDS = BLOCK  # a p is closed by any of these
SAME_ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}

TOKEN = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
#: What follows a tag's name: up to the first > outside quotes, or the first > of all.
QUOTED = re.compile(r"""((?:[^>"']+|"[^"]*"|'[^']*')*+)>""")
PLAIN = re.compile(r"([^>]*)>")
#: Elements nested deeper count as part of the one at this depth (browsers limit their trees alike); no text is lost.
DEEPEST = 256
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    """A run of text: its styles from the root down, whether a named part holds it, and its words."""

    path: tuple[str, ...]
    noise: bool
    article: bool
    text: str


def _noisy(tag: str, attributes: dict[str, str]) -> bool:
    if tag in NOISE_TAGS or attributes.get("role", "").lower() in NOISE_ROLES or "hidden" in attributes:
        return tag not in ("html", "body", *ARTICLES)
    names = re.split(r"[^a-z0-9]+", (attributes.get("class", "") + " " + attributes.get("id", "")).lower())
    return tag not in ("html", "body", *ARTICLES) and not NOISE_NAMES.isdisjoint(names)


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in its order. Bad markup is taken as browsers do, roughly."""
    out: list[tuple[tuple[str, ...], tuple[int, ...], tuple[int, ...], bool, str]] = []  # path, named parts, those around the article, article, text
    stack: list[tuple[str, str, tuple[int, ...], tuple[int, ...], bool]] = []  # tag, style, named parts, those around the article, article
    talk: list[bool] = []  # of each named part
    held: list[str] = []
    path: tuple[str, ...] | None = None  # of the stack, once a block has asked for it

    def flush() -> None:
        nonlocal path
        text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            top = stack[-1] if stack else ("", "", (), (), False)
            if path is None:
                path = tuple(s for t, s, *_ in stack if t in BLOCK)
            out.append((path, *top[2:], text))

    def close(k: int) -> None:
        nonlocal path
        if any(t in BLOCK for t, *_ in stack[k:]):
            flush()
        del stack[k:]
        path = None

    page, at = page or "", 0
    last, rest = page.rfind(">"), QUOTED
    deeper: dict[str, int] = defaultdict(int)
    while m := TOKEN.search(page, at):
        if m[0] == "<!--":
            held.append(page[at : m.start()])
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            continue
        if m.start() > last:
            break  # no tag ends from here on
        held.append(page[at : m.start()])
        inner = (rest if m[2] else PLAIN).match(page, m.end())
        if inner is None:  # a quote is never closed: from here on quotes mean nothing, so that no tag is scanned to the end again
            rest = PLAIN
            inner = rest.match(page, m.end())
        at = inner.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if deeper[tag]:
                deeper[tag] -= 1
                if tag in BLOCK:
                    flush()
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break  # a stray inline end tag closes no block
            else:
                if tag == "p":
                    flush()
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br":
            held.append(" ")
        if tag in P_ENDS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK and stack[k][0] not in ("p",):
                    break
        if tag in SAME_ENDS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in SAME_ENDS[tag] or stack[k][0] == "table":
                    break
        if tag in VOID or inner[1].rstrip().endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if len(stack) >= DEEPEST:
            deeper[tag] += 1
            continue
        attributes = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(inner[1])} if inner[1] else {}
        parts, around, article = stack[-1][2:] if stack else ((), (), False)
        style = tag + "".join("." + c for c in sorted(set(attributes.get("class", "").lower().split())))
        if tag in ARTICLES and not article:
            around, article = parts, True
        if _noisy(tag, attributes):
            parts += (len(talk),)
            talk.append(not TALK_NAMES.isdisjoint((attributes.get("class", "") + " " + attributes.get("id", "")).lower().split()))
        stack.append((tag, style, parts, around, article))
        path = None
    held.append(page[at:])
    flush()
    wrappers = _wrappers(out, talk)
    return [Block(path, not wrappers.issuperset(parts), article, text) for path, parts, _, article, text in out]


def _wrappers(found: list[tuple], talk: list[bool]) -> set[int]:
    """The named parts that hold most of the page's article text from outside, or most (talk: all) of its text."""
    if not talk:
        return set()
    within, around, total, marked = [0] * len(talk), [0] * len(talk), 0, 0
    for _, parts, outer, article, text in found:
        total += len(text)
        marked += len(text) * article
        for p in parts:
            within[p] += len(text)
        for p in outer:
            around[p] += len(text)
    return {p for p in range(len(talk)) if 2 * around[p] > marked or (within[p] == total if talk[p] else 2 * within[p] > total)}


@lru_cache(1024)
def _branches(path: tuple[str, ...]) -> list[int]:
    """Lengths of the path at the branches inside an article that entropies judge."""
    tags = [s.split(".", 1)[0] for s in path]
    first = next((k for k, t in enumerate(tags) if t in ARTICLES), len(tags))
    return [k + 1 for k in range(first + 1, len(tags)) if tags[k] in BRANCHES]


@lru_cache(1024)
def _keys(path: tuple[str, ...]) -> tuple[int, ...]:
    """The keys of the style nodes from the root down the path; each follows from the one above."""
    return tuple(accumulate(path, lambda key, style: _hash(f"{key} {style}"), initial=0))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def observe(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Rows (host, node, kind, value, n): how many pages of the host have the value at the style node.

    kind 0: the page has the node; 1: the sequence of child styles; 2: a block of text
    at the node or, for a branch inside an article, anywhere in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int, int, int], int] = defaultdict(int)
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                host = split_url(url)[0]
                children: dict[int, int] = defaultdict(int)  # of each node, a running hash of its sequence of children
                own = set()
                for b in blocks(page.as_py()):
                    keys = _keys(b.path)
                    for node, child in zip(keys, keys[1:]):
                        children[node] = (children[node] * 0x9E3779B97F4A7C15 + child) % (1 << 64)
                    children[keys[-1]]  # a leaf has no children
                    for k in {len(b.path), *_branches(b.path)}:
                        own.add((host, keys[k], 2, _hash(b.text)))
                for node, found in children.items():
                    own.add((host, node, 0, 0))
                    own.add((host, node, 1, found - (1 << 63)))
                for key in own:
                    seen[key] += 1
            columns = list(zip(*seen)) or [(), (), (), ()]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds)), pa.array(list(seen.values()), pa.int64())], ["host", "node", "kind", "value", "n"])

    return pages.select(url_col, html_col).mapInArrow(run, "host string, node long, kind int, value long, n long")


def importance(observed: DataFrame) -> DataFrame:
    """host, node, pages, presentation, content: entropies over the host's pages, 0 (alike everywhere) to 1.

    Presentation: the entropy of the child sequences, to base pages. Content: one
    minus the mean of log_pages(pages with the block), over the node's blocks.
    """
    summed = observed.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n"))
    pages = F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("pages")
    n, one, two = F.col("n"), F.col("kind") == 1, F.col("kind") == 2
    # sum p log p over sequences = (sum n log n) / total - log total
    stats = summed.groupBy("host", "node").agg(
        pages,
        F.sum(F.when(one, n * F.log(n))).alias("s1"), F.sum(F.when(one, n)).alias("t1"),
        F.avg(F.when(two, F.log(n))).alias("s2"),
    )
    base = F.log(F.greatest("pages", F.lit(2)))
    return stats.select("host", "node", "pages", ((F.log("t1") - F.col("s1") / F.col("t1")) / base).alias("presentation"), F.when(F.col("s2").isNotNull(), 1 - F.col("s2") / base).alias("content"))


def kept(found: list[Block], low: set[int]) -> list[str]:
    """The texts of the blocks that stay."""
    if any(b.article and not b.noise for b in found):
        own = [b for b in found if b.article and not b.noise]
        rest = own
        if low:
            rest = [b for b in own if not (at := _branches(b.path)) or low.isdisjoint(map(_keys(b.path).__getitem__, at))]
        return [b.text for b in rest or own]
    return [b.text for b in found if not b.noise and (not low or low.isdisjoint(_keys(b.path)[1:]))]


def extract(pages: DataFrame, threshold: float = 0.2, min_pages: int = 5, broadcast_nodes: int = 1_000_000, salts: int = 32, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text.

    threshold: composite importance under which a style node's branch is dropped;
    nodes on fewer than min_pages pages of their host are never judged. Up to
    broadcast_nodes nodes to drop (8 bytes each) go to the pages by broadcast;
    more are joined by host, each host's pages dealt over that many salts.
    """
    clean = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    nodes = importance(observe(clean, "id", "url", "html"))
    composite = F.greatest("presentation", F.coalesce("content", F.lit(0.0)))
    low = nodes.where((F.col("pages") >= min_pages) & F.col("content").isNotNull() & (composite < threshold))
    # one row per host: its unimportant style nodes (as many as the site's templates have)
    low = cut(low.groupBy("host").agg(F.collect_list("node").alias("low")))
    # as split_url has it: only A-Z are lower-cased
    host = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase).alias("host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, drop in zip(batch.column(2), batch.column(3).to_pylist()):
                texts.append("\n".join(kept(blocks(page.as_py()), set(drop or ()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    own = clean.select("id", "url", "html", host)
    if low.agg(F.coalesce(F.sum(F.size("low")), F.lit(0))).first()[0] <= broadcast_nodes:
        joined = own.join(F.broadcast(low), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("id", F.octet_length("html")), F.lit(salts)).cast("int")
        joined = own.withColumn("salt", salt).join(low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["host", "salt"], "left")
    joined = joined.select("id", "url", "html", "low")
    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, url string, text string").withColumnRenamed("id", id_col)


def entropy(counts: list[int]) -> float:
    """Of a list of counts, in nats (for tests)."""
    total = sum(counts)
    return -sum(c / total * math.log(c / total) for c in counts if c)
