"""Chat formatting by quotation linking, in DataFrame functions only.

A line that starts with ">" signs (spaces between them allowed) is quoted; their
number is its level. Adjacent lines of one level are a passage, which blank lines
split into paragraphs. Passages, paragraphs and single lines are normalised
(lower case, white space and line breaks to one space, trimmed), so that a quote
may be wrapped anew, and hashed. So is every run of RUN words of a paragraph, by
which a quote links that was cut in the middle of a sentence. Each quoted one points
to the latest earlier message of its conversation that has the same text as its own
words, be it the whole message, one of its passages, a paragraph, a line or a run.

A message replies to what the best evidence among its quotes points to: quotes of
the lowest level first, then whole passages before paragraphs before lines before runs, then
most characters, then the later message. So a short line that many messages share
("ok") decides only where nothing larger links. Messages without a match open a
thread of their own. Following replies up gives each message its thread and
depth; place numbers the messages of a conversation thread by thread, in which
every reply stands after what it answers. The text of a message has lost its
quoted lines, and the lines that introduce them ("On Monday, Ann wrote:"): before a
deeper level, a line that ends in a verb of INTRODUCES and a colon, has an address and ends
in a colon, or stands between dashes.

The latest earlier message is found in two steps, inside blocks of BLOCK turns
and then over one row per block, so that a passage repeated all over one very
long conversation is never sorted in one task alone; places are counted likewise.
Threads are followed by pointer doubling, a logarithmic number of joins.

Null texts count as empty; repeated rows (same conversation and turn) count
once; columns besides conv_id, turn, role and text are ignored; an empty table
gives an empty result. Rows with a null conv_id or turn are left out, as they
have no place in a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from safesight.llm.common import cut

BLOCK = 256
#: Parts that the messages of a conversation are dealt to by their turns.
SALTS = 32
#: A text with a quoted line.
QUOTES = r"(?:^|\n)[ \t]*>"
MARKS = r"^[ \t]*(?:>[ \t]*)+"
#: Ends and starts of normalised lines that introduce a quote (the start stands on the line before, if wrapped).
INTRODUCES, INTRODUCES_FROM = r"(?:wrote|writes|schrieb|a écrit|escribió) ?:$|[^ ]@[^ ]+.*:$|^-{2,}[^-].*-{2,}$", r"^(?:on|am|le|el) "
#: What a quote is compared by, the weakest evidence first.
KINDS = ("run", "line", "paragraph", "passage")
#: Words of a run.
RUN = 5


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def cleaned(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, text (null: empty)."""
    clean = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    clean = clean.groupBy("conv_id", "turn").agg(F.min_by(F.struct("role", "text"), F.struct(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))).alias("m"))
    return clean.select("conv_id", "turn", F.col("m.role").alias("role"), F.coalesce(F.col("m.text"), F.lit("")).alias("text"))


def in_quoting(messages: DataFrame) -> DataFrame:
    """The messages of conversations with a quote: no other can have a link. A long conversation is dealt by its turns."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    quoting = messages.where(F.col("text").rlike(QUOTES)).select("conv_id").distinct().select("conv_id", salts)
    part = messages.withColumn("salt", F.pmod(F.col("turn"), F.lit(SALTS)).cast("int"))
    return part.join(quoting, ["conv_id", "salt"], "left_semi").drop("salt")


def parsed(clean: DataFrame) -> DataFrame:
    """One row per line of each message: conv_id, turn, role, k, level, body, norm, passage, paragraph, intro."""
    lines = clean.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    marks, body = F.regexp_extract("line", MARKS, 0), F.regexp_replace("line", MARKS, "")
    lines = lines.select("conv_id", "turn", "role", "k", F.length(F.regexp_replace(marks, r"[^>]", "")).alias("level"), body.alias("body"), _normal(body).alias("norm"))
    # all windows keep the partitioning by message that the aggregate left
    order = Window.partitionBy("conv_id", "turn").orderBy("k")
    blank = (F.lead("norm").over(order) == "") & (F.lead("level").over(order) == 0)
    below = F.when(blank, F.lead("level", 2).over(order)).otherwise(F.lead("level").over(order))
    lines = lines.withColumn("intro", F.coalesce(F.col("norm").rlike(INTRODUCES) & (below > F.col("level")), F.lit(False)))
    wrapped = F.lead("intro").over(order) & (F.lead("level").over(order) == F.col("level")) & F.col("norm").rlike(INTRODUCES_FROM) & ~F.lead("norm").over(order).rlike(INTRODUCES_FROM)
    lines = lines.withColumn("intro", F.col("intro") | F.coalesce(wrapped, F.lit(False)))
    turns = F.coalesce(F.col("level") != F.lag("level").over(order), F.lit(True)) | F.col("intro")
    lines = lines.withColumn("new", turns.cast("int")).withColumn("gap", (turns | (F.col("norm") == "")).cast("int"))
    return lines.withColumn("passage", F.sum("new").over(order)).withColumn("paragraph", F.sum("gap").over(order)).drop("new", "gap")


def units(lines: DataFrame) -> DataFrame:
    """conv_id, turn, level, kind (place in KINDS), hash, n_chars of every passage, paragraph, line and run of words, and of whole messages (level 0)."""
    full = lines.where((F.col("norm") != "") & ~F.col("intro"))
    # nested in place: lines of a paragraph, paragraphs of a passage, passages of a message and level
    within = full.groupBy("conv_id", "turn", "level", "passage", "paragraph").agg(F.array_sort(F.collect_list(F.struct("k", "norm"))).alias("lines"))
    within = within.select("conv_id", "turn", "level", "passage", "paragraph", F.transform("lines", lambda x: x["norm"]).alias("lines"))
    for keys, inner in ((["conv_id", "turn", "level", "passage"], "paragraph"), (["conv_id", "turn", "level"], "passage")):
        within = within.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(inner, "lines"))).alias("parts"))
        within = within.select(*keys, F.transform("parts", lambda x: x["lines"]).alias("lines"))

    def kind(texts: Column, k: int) -> Column:
        return F.transform(texts, lambda x: F.struct(F.lit(k).alias("kind"), F.md5(x).alias("hash"), F.length(x).cast("long").alias("n_chars")))

    passages = F.transform("lines", lambda paragraphs: F.array_join(F.flatten(paragraphs), " "))
    paragraphs = F.transform(F.flatten("lines"), lambda lines_: F.array_join(lines_, " "))
    single = F.flatten(F.flatten("lines"))

    def cut_out(text: Column) -> Column:
        words = F.split(text, " ")
        first = F.when(F.size(words) >= RUN, F.sequence(F.lit(1), F.size(words) - (RUN - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(first, lambda at: F.array_join(F.slice(words, at, RUN), " "))

    runs = F.flatten(F.transform(paragraphs, cut_out))
    whole = F.when(F.col("level") == 0, F.array(F.array_join(single, " "))).otherwise(F.array().cast("array<string>"))
    every = within.select("conv_id", "turn", "level", F.explode(F.concat(kind(runs, 0), kind(single, 1), kind(paragraphs, 2), kind(passages, 3), kind(whole, 3))).alias("unit"))
    return every.select("conv_id", "turn", "level", "unit.kind", "unit.hash", "unit.n_chars")


def replies(every: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, evidence, n_linked: of each message with a quote from an earlier one.

    n_linked counts its quoted passages that an earlier message has whole.
    """
    quoted = every.where("level > 0").groupBy("conv_id", "hash", "turn", "level", "kind").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
    # only texts that somebody quotes matter
    own = every.where("level = 0").select("conv_id", "hash", "turn").distinct().join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    kinds = dict(quoted.dtypes)
    points = own.select("conv_id", "hash", "turn", block, F.col("turn").alias("own"), *(F.lit(None).cast(kinds[c]).alias(c) for c in ("level", "kind", "n", "n_chars")))
    points = points.unionByName(quoted.select("conv_id", "hash", "turn", block, F.lit(None).cast(kinds["turn"]).alias("own"), "level", "kind", "n", "n_chars"))
    inside = Window.partitionBy("conv_id", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    blocks = points.groupBy("conv_id", "hash", "block").agg(F.max("own").alias("last"))
    before = Window.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "hash", "block", F.max("last").over(before).alias("earlier"))
    found = points.withColumn("near", F.max("own").over(inside)).where("level is not null").join(blocks, ["conv_id", "hash", "block"])
    found = found.select("conv_id", "turn", "level", "kind", "n", "n_chars", F.coalesce("near", "earlier").alias("reply_to")).where("reply_to is not null")
    votes = found.groupBy("conv_id", "turn", "level", "kind", "reply_to").agg(F.sum("n").alias("n"), F.sum("n_chars").alias("n_chars"))
    best = F.max_by(F.struct("reply_to", "kind"), F.struct(-F.col("level"), "kind", "n_chars", "reply_to"))
    whole = F.sum(F.when(F.col("kind") == 3, F.col("n")).otherwise(F.lit(0).cast("long")))
    out = votes.groupBy("conv_id", "turn").agg(best.alias("best"), whole.alias("n_linked"))
    return out.select("conv_id", "turn", "best.reply_to", F.element_at(F.array(*map(F.lit, KINDS)), F.col("best.kind") + 1).alias("evidence"), "n_linked")


def threads(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """conv_id, turn, thread, depth of each message that replies, by pointer doubling."""
    at = cut(links.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth")))
    for _ in range(max_rounds):
        above = at.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        moved = at.join(above, ["conv_id", "up"], "left")
        at = cut(moved.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    else:
        raise RuntimeError("threads did not settle")
    return at.select("conv_id", "turn", F.col("up").alias("thread"), "depth")


def placed(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, thread, ..) with place: 0, 1, .. in each conversation, by thread, then turn."""
    both = messages.withColumn("block", F.floor(F.col("turn") / BLOCK))

    def earlier(df: DataFrame, within: list[str], by: str, name: str) -> DataFrame:
        """df with the sum of n over the rows before, as name."""
        before = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))

    cells = both.groupBy("conv_id", "thread", "block").agg(F.count("*").alias("n"))
    heads = cells.groupBy("conv_id", "thread").agg(F.sum("n").alias("n")).withColumn("heads", F.floor(F.col("thread") / BLOCK))
    groups = heads.groupBy("conv_id", "heads").agg(F.sum("n").alias("n"))
    cells = earlier(cells, ["conv_id", "thread"], "block", "in_thread").drop("n")
    heads = earlier(heads, ["conv_id", "heads"], "thread", "in_heads").drop("n")
    groups = earlier(groups, ["conv_id"], "heads", "in_groups").drop("n")
    rank = F.row_number().over(Window.partitionBy("conv_id", "thread", "block").orderBy("turn")) - 1
    every = both.withColumn("rank", rank).join(cells, ["conv_id", "thread", "block"]).join(heads, ["conv_id", "thread"]).join(groups, ["conv_id", "heads"])
    return every.withColumn("place", F.col("rank") + F.col("in_thread") + F.col("in_heads") + F.col("in_groups")).select(*messages.columns, "place")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, place, turn, role, reply_to, evidence, thread, depth, n_quoted, n_linked, text without quotes.

    Sorted by (conv_id, place) it reads in reply order.
    """
    links = cut(replies(cut(units(parsed(cleaned(in_quoting(messages)))))))
    clean = cleaned(messages)
    quoting = F.col("text").rlike(QUOTES)
    own = F.collect_list(F.when((F.col("level") == 0) & ~F.col("intro"), F.struct("k", "body")))
    text = F.array_join(F.transform(F.array_sort(own), lambda x: x["body"]), "\n")
    base = parsed(clean.where(quoting)).groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.count_if(F.col("level") > 0).alias("n_quoted"), text.alias("text"))
    base = base.unionByName(clean.where(~quoting).select("conv_id", "turn", "role", F.lit(0).cast("long").alias("n_quoted"), "text"))
    base = base.withColumn("text", F.btrim("text", F.lit(" \t\r\n")))
    every = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn").distinct()
    up = every.join(links, ["conv_id", "turn"], "left").join(threads(links), ["conv_id", "turn"], "left")
    none = F.lit(0).cast("long")
    up = up.select("conv_id", "turn", "reply_to", "evidence", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", none).alias("depth"), F.coalesce("n_linked", none).alias("n_linked"))
    out = base.join(placed(cut(up)), ["conv_id", "turn"])
    return out.select("conv_id", "place", "turn", "role", "reply_to", "evidence", "thread", "depth", "n_quoted", "n_linked", "text")


ORACLE_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, r.role AS role, coalesce(r.text, '') AS text FROM (
    SELECT conv_id, turn, arg_min({'role': role, 'text': text}, {'a': coalesce(role, ''), 'b': coalesce(text, '')}) AS r
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL)),
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM c),
p AS (SELECT conv_id, turn, k,
    length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g')) AS level,
    regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', '') AS body FROM l),
n AS (SELECT *, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS norm FROM p),
i AS (SELECT *, coalesce(regexp_matches(norm, '(?:wrote|writes|schrieb|a écrit|escribió) ?:$|[^ ]@[^ ]+.*:$|^-{2,}[^-].*-{2,}$') AND level <
    CASE WHEN lead(norm) OVER w = '' AND lead(level) OVER w = 0 THEN lead(level, 2) OVER w ELSE lead(level) OVER w END, false) AS ends
  FROM n WINDOW w AS (PARTITION BY conv_id, turn ORDER BY k)),
j AS (SELECT *, ends OR coalesce(lead(ends) OVER w AND lead(level) OVER w = level AND regexp_matches(norm, '^(?:on|am|le|el) ')
    AND NOT regexp_matches(lead(norm) OVER w, '^(?:on|am|le|el) '), false) AS intro
  FROM i WINDOW w AS (PARTITION BY conv_id, turn ORDER BY k)),
b AS (SELECT *, coalesce(level <> lag(level) OVER w, true) OR intro AS fresh FROM j WINDOW w AS (PARTITION BY conv_id, turn ORDER BY k)),
g AS (SELECT *, sum(fresh::INT) OVER w AS passage, sum((fresh OR norm = '')::INT) OVER w AS paragraph
  FROM b WINDOW w AS (PARTITION BY conv_id, turn ORDER BY k)),
f AS (SELECT * FROM g WHERE norm <> '' AND NOT intro),
s AS (SELECT conv_id, turn, level, string_agg(norm, ' ' ORDER BY k) AS norm FROM f GROUP BY conv_id, turn, level, paragraph),
r AS (SELECT conv_id, turn, level, w, unnest(range(1, len(w) - 3)) AS b FROM (SELECT *, string_split(norm, ' ') AS w FROM s)),
u AS (SELECT conv_id, turn, level, 0 AS kind, array_to_string(w[b:b + 4], ' ') AS norm FROM r
  UNION ALL SELECT conv_id, turn, level, 1, norm FROM f
  UNION ALL SELECT conv_id, turn, level, 2, norm FROM s
  UNION ALL SELECT conv_id, turn, level, 3, string_agg(norm, ' ' ORDER BY k) FROM f GROUP BY conv_id, turn, level, passage
  UNION ALL SELECT conv_id, turn, level, 3, string_agg(norm, ' ' ORDER BY k) FROM f WHERE level = 0 GROUP BY conv_id, turn, level),
q AS (SELECT a.conv_id, a.turn, a.level, a.kind, b.up, count(*) AS n, sum(length(a.norm)) AS n_chars FROM (SELECT * FROM u WHERE level > 0) a,
    LATERAL (SELECT max(o.turn) AS up FROM u o WHERE o.level = 0 AND o.norm = a.norm AND o.conv_id = a.conv_id AND o.turn < a.turn) b
    WHERE b.up IS NOT NULL GROUP BY ALL),
v AS (SELECT conv_id, turn, arg_max({'up': up, 'kind': kind}, {'a': -level, 'b': kind, 'c': n_chars, 'd': up}) AS best,
    coalesce(sum(n) FILTER (kind = 3), 0)::BIGINT AS n_linked FROM q GROUP BY ALL),
t AS (SELECT conv_id, turn, turn AS thread, 0::BIGINT AS depth FROM c WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM v)
  UNION ALL SELECT v.conv_id, v.turn, t.thread, t.depth + 1 FROM v JOIN t ON t.conv_id = v.conv_id AND t.turn = v.best.up),
x AS (SELECT conv_id, turn, count(*) FILTER (level > 0) AS n_quoted,
    coalesce(trim(string_agg(body, chr(10) ORDER BY k) FILTER (level = 0 AND NOT intro), ' ' || chr(9) || chr(13) || chr(10)), '') AS text FROM g GROUP BY ALL)
SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY t.thread, c.turn) - 1 AS place, c.turn, c.role, v.best.up AS reply_to,
  ['run', 'line', 'paragraph', 'passage'][v.best.kind + 1] AS evidence, t.thread, t.depth, x.n_quoted, coalesce(v.n_linked, 0)::BIGINT AS n_linked, x.text
FROM c JOIN t USING (conv_id, turn) JOIN x USING (conv_id, turn) LEFT JOIN v USING (conv_id, turn)
"""
