"""Secret scans in DataFrame functions only: rules, and Markov models of characters.

Rules find assignments, access keys and hexadecimal runs. The method adds
candidate runs that no rule covers: two character Markov models, one of random
strings and one of ordinary identifiers, give the log-likelihood ratio of each
candidate, which counts as a secret above a threshold per character. The models
are trained from labelled samples: by default the values that the rules matched and
digests (random) against long words, and identifiers made of words, of the same table.

Positions are code points, end exclusive. Everything happens inside the row (no
shuffle); only the two tables of character pairs, bounded by the alphabet, go to
the driver. Null and empty texts have no spans; repeated rows give repeated
rows; columns besides the id and the text are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules, in the order that breaks ties of position.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The same where a run that is too short can't hide a longer one.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
MIN_ASSIGN = 6

KINDS = ("assign", "access", "hex", "model")

#: What the models judge: runs of these characters, this long at least.
#: Runs of digits alone (numbers of cards, accounts, telephones) are not.
RUN = r"(?=[0-9]*[A-Za-z+/_=-])[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

#: Words from one identifier of the ordinary samples to the next.
STRIDE = 64

LEAST = -2147483647

#: Code points of the blocks that redaction cuts a text into.
CUT = 256

SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _let(value: Column, of) -> Column:
    """of(value), with the value computed once and not wherever of names it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _running(values: Column, step, zero: int) -> Column:
    """What step makes of all values before each place, in blocks of about the root of their number (no array grows by one value a time)."""
    fold = lambda x: F.aggregate(x, F.lit(zero), step)

    def blocks(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda k: F.slice(v, k * size + 1, size))

    def joined(own: Column) -> Column:
        totals = F.transform(own, fold)
        before = _let(totals, lambda t: F.transform(t, lambda _, k: fold(F.slice(t, 1, k))))
        inner = lambda x, b: F.transform(x, lambda _, i: step(b, fold(F.slice(x, 1, i))))
        return F.flatten(F.zip_with(own, before, inner))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(blocks(v), joined)).otherwise(F.array().cast("array<int>")))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches as spans.

    split() gives the pieces between the matches: lengths of pieces and matches
    add up to the positions.
    """
    def spans(steps: Column) -> Column:
        at = _running(F.transform(steps, lambda x: x["p"] + F.length(x["m"])), _add, 0)
        return F.zip_with(steps, at, lambda x, a: F.struct((a + x["p"]).alias("start"), F.lit(kind).alias("kind"), (a + x["p"] + F.length(x["m"])).alias("stop"), x["m"].alias("value")))

    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    steps = F.zip_with(found, F.split(text, pattern, -1), lambda m, p: F.struct(m.alias("m"), F.length(p).alias("p")))
    return F.when(text.rlike(pattern), _let(F.filter(steps, lambda x: x["m"].isNotNull()), spans)).otherwise(F.array().cast(SPAN))


def _base(text: Column) -> Column:
    value = lambda x: F.regexp_extract(x["value"], ASSIGN, 2)
    assign = F.filter(_matches(text, ASSIGN, 0), lambda x: F.length(value(x)) >= MIN_ASSIGN)
    return F.concat(assign, _matches(text, ACCESS_LONG, 1), _matches(text, HEX_LONG, 2))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, base spans and the candidate runs that don't touch them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text.alias("text")).select("row", "id", "text", _base(F.col("text")).alias("base"), _matches(F.col("text"), RUN, 3).alias("runs"))
    # a run is free if base spans that start before it stop by its start, and those after it start at its end or later
    def apart(both: Column) -> Column:
        stop = _running(F.transform(both, lambda x: F.when(x["kind"] < 3, x["stop"]).otherwise(0)), _larger, 0)
        start = F.transform(both, lambda x: F.when(x["kind"] < 3, -x["start"]).otherwise(LEAST))
        after = F.reverse(_running(F.reverse(start), _larger, LEAST))
        near = F.zip_with(stop, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
        own = lambda x, n: F.when((x["kind"] == 3) & (n["b"] <= x["start"]) & (-n["a"] >= x["stop"]), x)
        return F.filter(F.zip_with(both, near, own), lambda x: x.isNotNull())

    free = F.when((F.size("base") > 0) & (F.size("runs") > 0), _let(F.array_sort(F.concat("base", "runs")), apart)).otherwise(F.col("runs"))
    return found.select("row", "id", "text", "base", free.alias("runs"))


def _identifier(words: Column, k: Column) -> Column:
    """Words as one identifier, in the k-th style in turn; versions and numbers follow from k."""
    low, high = F.transform(words, F.lower), F.transform(words, F.initcap)
    pascal, snake = F.array_join(high, ""), F.array_join(low, "_")
    styles = {
        "camelCase": F.concat(F.element_at(low, 1), F.array_join(F.slice(high, 2, 3), "")),
        "PascalCase": pascal,
        "snake_case": snake,
        "CONSTANT_CASE": F.upper(snake),
        "kebab-case": F.array_join(low, "-"),
        "path/v1": F.concat_ws("/", F.array_join(low, "/"), F.concat(F.lit("v"), (k % 9 + 1).cast("string"))),
        "ACRONYMClass": F.concat(F.upper(F.substring(F.element_at(low, 1), 1, 3)), F.array_join(F.slice(high, 2, 3), "")),
        "name_12": F.concat(snake, F.lit("_"), (k % 100).cast("string")),
    }
    out = F.element_at(low, 1)
    for place, form in enumerate(styles.values()):
        out = F.when(k % len(styles) == place, form).otherwise(out)
    return out


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled samples (value, label) from the table itself.

    1: values that rules matched, and per document the base64 digest of its first
    ordinary run (a random string by construction, of the whole alphabet). 0: all
    other long runs without digits, per document its first one as constants, paths
    and time stamps write it (capitals, separators, numbers), and identifiers that four
    words of the text make: a new one every STRIDE words, in eight ways of writing in turn.
    """
    found = _prepared(docs, id_col, text_col)
    words = F.regexp_extract_all("text", F.lit(r"([A-Za-z]{2,12})"), F.lit(1))
    named = _let(words, lambda w: F.when(F.size(w) >= 4, F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 4) / STRIDE).cast("int")), lambda k: F.struct(_identifier(F.slice(w, k * STRIDE + 1, 4), k).alias("value"), F.lit(0).alias("label")))).otherwise(F.array().cast("array<struct<value:string,label:int>>")))
    secret = F.transform("base", lambda b: F.struct(F.when(b["kind"] == 0, F.regexp_extract(b["value"], ASSIGN, 2)).otherwise(b["value"]).alias("value"), F.lit(1).alias("label")))
    plain = F.transform(F.filter("runs", lambda r: ~r["value"].rlike("[0-9]")), lambda r: F.struct(r["value"].alias("value"), F.lit(0).alias("label")))
    drawn = F.transform(F.slice(plain, 1, 1), lambda p: F.struct(F.rtrim(F.base64(F.unhex(F.sha2(p["value"], 256))), F.lit("=")).alias("value"), F.lit(1).alias("label")))
    def dressed(p: Column) -> Column:
        value, word = p["value"], F.substring(p["value"], 1, 8)
        clock = F.date_format(F.timestamp_seconds(F.pmod(F.xxhash64(value), F.lit(1_900_000_000))), "yyyy-MM-dd'T'HH-mm-ss")
        number = F.pmod(F.xxhash64(value, F.lit(1)), F.lit(10_000)).cast("string")
        shown = [F.concat_ws("_", F.upper(value), F.upper(word), number), F.concat_ws("/", word, F.lower(value), F.substring(clock, 1, 4), F.concat(word, F.lit("-"), number)), clock, F.concat(clock, F.lit("_"), word), F.concat(word, F.lpad(number, 16, "0"))]
        return F.array(*(F.struct(x.alias("value"), F.lit(0).alias("label")) for x in shown))

    ordinary = F.flatten(F.transform(F.slice(plain, 1, 1), dressed))
    return found.select(F.explode(F.concat(secret, plain, drawn, ordinary, named)).alias("s")).select("s.value", "s.label")


def train(labelled: DataFrame, weight: float = 5.0, add: float = 0.5, ruler: int = 20) -> list[float]:
    """Log-likelihood ratios of character pairs, row by row of the alphabet.

    labelled: value string, label 1 (random string) or 0 (ordinary). Counts cover
    all samples. P(b | a) = (count(ab) + weight x P(b)) / (count(a) + weight) with
    add-``add`` P(b), so that a row that was never seen falls back to how common b
    is. Ordinary samples count as joined by a ruler of each character (that pair
    ``ruler`` times), as masks and lines are drawn. A side without samples has a uniform model. At most 2 x 67 x 67 counts reach the driver.
    """
    pairs = F.expr("transform(sequence(1, greatest(length(value) - 1, 1)), i -> substring(value, i, 2))")
    counted = labelled.where(F.length("value") > 1).select("label", F.explode(pairs).alias("pair")).where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("label", "pair").count().collect()
    k = len(ALPHABET)
    model = []
    for label in (0, 1):
        counts = {r["pair"]: r["count"] for r in counted if r["label"] == label}
        for a in ALPHABET * (label == 0):
            counts[a + a] = counts.get(a + a, 0) + ruler
        rows = {a: sum(counts.get(a + b, 0) for b in ALPHABET) for a in ALPHABET}
        total = sum(rows.values())
        single = {b: (sum(counts.get(a + b, 0) for a in ALPHABET) + add) / (total + add * k) for b in ALPHABET}
        model.append([math.log((counts.get(a + b, 0) + weight * single[b]) / (rows[a] + weight)) for a in ALPHABET for b in ALPHABET])
    return [r - p for p, r in zip(*model)]


def scan(docs: DataFrame, ratios: list[float] | None = None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row (all its columns), id, text, base and spans (arrays of start, kind, stop, value), ordered by start, then kind.

    ratios: from train(); by default trained on samples(docs). threshold: natural
    log-likelihood ratio per character pair above which a run is a secret; random
    strings of 16 characters and more have 0.8 and above, all but a few.
    """
    if ratios is None:
        ratios = train(samples(docs, id_col, text_col))
    table = F.array(*map(F.lit, ratios))
    k = len(ALPHABET)

    def ratio(r: Column) -> Column:
        place = lambda i: F.instr(F.lit(ALPHABET), F.substring(r["value"], i, F.lit(1)))
        total = F.aggregate(F.sequence(F.lit(1), F.length(r["value"]) - 1), F.lit(0.0), lambda a, i: a + F.element_at(table, (place(i) - 1) * k + place(i + 1)))
        return total / (F.length(r["value"]) - 1)

    found = _prepared(docs, id_col, text_col)
    model = F.filter("runs", lambda r: ratio(r) > threshold)
    return found.select("row", "id", "text", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", model)).alias("spans"))


def _joined(spans: str) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digests(docs: DataFrame, ratios: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans by kind, base_sha256 and all spans as kind:start:end."""
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")
    return scan(docs, ratios, id_col=id_col, text_col=text_col).select(F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", ratios: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every secret in the text replaced by the mark (overlapping spans by one); other columns stay."""
    # spans merge where they overlap: each begins a gap's end unless an earlier one reaches over its start
    reach = _running(F.transform("spans", lambda x: x["stop"]), _larger, 0)
    gaps = F.filter(F.zip_with("spans", reach, lambda x, r: F.struct(r.alias("from"), x["start"].alias("to"))), lambda g: g["to"] >= g["from"])
    blocks = F.regexp_extract_all("text", F.lit(f"((?s).{{1,{CUT}}})"), F.lit(1))
    end = F.struct(F.array_max(F.transform("spans", lambda x: x["stop"])).alias("from"), F.length("text").alias("to"))

    def cleaned(blocks: Column) -> Column:
        def cut(g: Column) -> Column:
            first, last = F.floor(g["from"] / CUT).cast("int"), F.floor((g["to"] - 1) / CUT).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
            return F.when(g["to"] > g["from"], F.substring(near, g["from"] - first * CUT + 1, g["to"] - g["from"])).otherwise(F.lit(""))

        return F.array_join(F.concat(F.transform(gaps, lambda g: F.concat(cut(g), F.lit(mark))), F.transform(F.array(end), cut)), "")

    new = F.when(F.size("spans") > 0, _let(blocks, cleaned)).otherwise(F.col("row").getField(text_col))
    columns = [new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return scan(docs, ratios, id_col=id_col, text_col=text_col).select(*columns)
