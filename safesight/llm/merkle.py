"""Merkle manifest of a dataset by slot pivots.

Leaves are hashes of rows. A tree per group has the group's leaves in order, and every
``fanout`` nodes in a row become their hash; the groups' subroots become the root in the
same way. A level is one aggregation: node number div fanout is the parent, and a
conditional maximum per slot spreads the children into columns. Concatenating the
columns gives the parent's input; leaving out a node's own column gives its siblings.

Nothing is sorted in one task: places come from a range partitioning (places within a
part, and running totals of the parts), and levels are dealt by (tree, parent). Levels
are written in the shared folder, each a ``fanout``-th of the one below; siblings go down
from the root with the parents, so leaves are shuffled once, into their first pivot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from safesight.llm.common import discard, table_path, written

#: Letters that tampering changes.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Siblings of a node and of those above it: what stands before and after each.
_PATH = "array<struct<l:string,r:string>>"


def digest(parts: Column) -> Column:
    """H: lowercase hex SHA-256."""
    return F.sha2(parts, 256)


def field(value: Column) -> Column:
    """``-`` for null, else length in bytes, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """H of a row's values."""
    return digest(F.concat(*(field(v) for v in values)))


def placed(rows: DataFrame, tree: str, order: list[str], path: str) -> DataFrame:
    """rows with pos, their place in their tree by order, and n, its size; written to path.

    One range shuffle; a tree over many parts gets running totals of a row per part and tree.
    """
    made = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("_id", F.monotonically_increasing_id())
    made = written(made.withColumn("_part", F.shiftright("_id", 33)), path)
    parts = made.groupBy(tree, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_size"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("n", F.sum("_size").over(Window.partitionBy(tree)))
    return made.join(parts.drop("_size"), [tree, "_part"]).withColumn("pos", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_part", "_first", "_before")


def pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """Parents (tree, pos, n, h, s0, s1, ..) of nodes (tree, pos, n, node); a slot holds a child's node struct, with its hash in h."""
    slot = F.col("pos") % fanout
    columns = [F.max(F.when(slot == k, F.col("node"))).alias(f"s{k}") for k in range(fanout)]
    made = nodes.groupBy("tree", F.floor(F.col("pos") / fanout).alias("pos")).agg(F.first("n").alias("n"), *columns)
    return made.select("tree", "pos", F.ceil(F.col("n") / fanout).alias("n"), digest(F.concat(*(_hash(k) for k in range(fanout)))).alias("h"), *(f"s{k}" for k in range(fanout)))


def _hash(k: int) -> Column:
    return F.coalesce(F.col(f"s{k}")["h"], F.lit(""))


def _children(parents: DataFrame, fanout: int) -> DataFrame:
    """Children (tree, pos, node, path) of parents with a path: their own siblings first."""
    joined = lambda ks: reduce(F.concat, (_hash(k) for k in ks), F.lit(""))
    own = lambda k: F.struct(joined(range(k)).alias("l"), joined(range(k + 1, fanout)).alias("r"))
    slots = F.array(*(F.struct((F.col("pos") * fanout + k).alias("pos"), F.col(f"s{k}").alias("node"), F.concat(F.array(own(k)), F.col("path")).cast(_PATH).alias("path")) for k in range(fanout)))
    return parents.select("tree", F.explode(F.filter(slots, lambda s: s["node"].isNotNull())).alias("c")).select("tree", "c.*")


class Forest:
    """Levels of all trees, each written; tops: the trees' roots (tree, node), node a struct with the hash in h.

    nodes: tree (not null), pos, n, node. A tree of one node is its own root.
    """

    def __init__(self, nodes: DataFrame, fanout: int):
        self.fanout, self.levels, self.paths = fanout, [], []
        self.alone = nodes.where("n = 1").select("tree", "node")
        tops, level = self.alone, nodes.where("n > 1")
        most = nodes.agg(F.max("n")).first()[0] or 1
        while most > 1:
            self.paths.append(table_path(nodes.sparkSession))
            made = written(pivot(level, fanout), self.paths[-1])
            self.levels.append(made)
            level = made.select("tree", "pos", "n", F.struct("h").alias("node"))
            tops = tops.select("tree", F.struct("node.h").alias("node")).unionByName(level.where("n = 1").select("tree", "node"))
            level, most = level.where("n > 1"), -(-most // fanout)
        self.tops = tops.select("tree", F.col("node.h").alias("h"))

    def leaves(self, above: DataFrame) -> DataFrame:
        """Leaves (tree, node, path): siblings from the leaf's own up, then those above the tree (tree, path)."""
        from_above = lambda rows: rows.join(above, "tree")
        out = from_above(self.alone).select("tree", "node", "path")
        met = None
        for level in reversed(self.levels):
            here = from_above(level.where("n = 1"))
            if met is not None:
                here = here.unionByName(level.where("n > 1").join(met.select("tree", "pos", "path"), ["tree", "pos"]))
            met = _children(here, self.fanout)
        return out if met is None else out.unionByName(met.select("tree", "node", "path"))


def manifest(docs: DataFrame, columns: list[str] | None = None, group: str = "lang", id_col: str = "doc_id", text_col: str = "text", fanout: int = 8) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, siblings (hex, from the leaf's level to the root), folded_root, verified.

    columns: what a leaf hashes. Leaves of a group ascend by id (null first; rows with one id
    by leaf), groups by name (null first, bytewise). A row whose id's crc32 is a multiple of 3
    is tampered with: A-Z of its text is lower-cased, and folded_root is computed from what it
    then is and the siblings of the tree as it was. A null id is not tampered with.
    """
    spark = docs.sparkSession
    columns = columns or ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 0, F.lit(False))
    tampered = [F.translate(F.col(c), _UPPER, _LOWER) if c == text_col else F.col(c) for c in columns]
    own = leaf(*(F.col(c) for c in columns))
    # a tree's name sorts null first, and is never null
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), own.alias("h"), F.when(hit, leaf(*tampered)).alias("changed"))
    paths = [table_path(spark) for _ in range(4)]
    nodes = placed(leaves, "tree", ["id", "h"], paths[0]).select("tree", "pos", "n", F.struct("h", "id", F.coalesce("changed", "h").alias("now")).alias("node"))
    groups = Forest(nodes, fanout)
    subroots = written(groups.tops, paths[1])
    top = Forest(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "h"), "tree", ["name"], paths[2]).select("tree", "pos", "n", F.struct("h", "name").alias("node")), fanout)
    # one row: the root
    root = top.tops.select("h").first()
    above = top.leaves(spark.range(1).select(F.lit("").alias("tree"), F.array().cast(_PATH).alias("path")))
    above = written(above.select(F.col("node.name").alias("tree"), F.col("node.h").alias("subroot"), "path"), paths[3])
    out = groups.leaves(above.select("tree", F.col("path"))).join(above.select("tree", "subroot"), "tree")
    fold = F.aggregate("path", F.col("node.now"), lambda h, s: digest(F.concat(s["l"], h, s["r"])))
    out = out.select(F.col("node.id").alias(id_col), F.col("node.h").alias("leaf"), "subroot", F.lit(root["h"] if root else None).cast("string").alias("root"), F.concat_ws("", F.transform("path", lambda s: F.concat(s["l"], s["r"]))).alias("siblings"), fold.alias("folded_root"))
    for path in (paths[2], *top.paths):
        discard(spark, path)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = """WITH RECURSIVE
crc(k, c, j) AS (SELECT k, k, 0 FROM range(256) t(k) UNION ALL SELECT k, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, j + 1 FROM crc WHERE j < 8),
tab AS (SELECT list(c ORDER BY k) AS t FROM crc WHERE j = 8),
raw AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, row_number() OVER () AS row, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents),
dig AS (SELECT row, j, ascii(substr(doc_id::VARCHAR, j, 1)) AS b FROM raw, range(1, 21) r(j) WHERE j <= length(doc_id::VARCHAR)),
sum32(row, j, c) AS (SELECT row, 1, 4294967295 FROM raw WHERE doc_id IS NOT NULL
  UNION ALL SELECT s.row, s.j + 1, xor(s.c // 256, t[xor(s.c % 256, d.b) + 1]) FROM sum32 s JOIN dig d ON d.row = s.row AND d.j = s.j, tab),
hit AS (SELECT row FROM (SELECT row, arg_max(c, j) AS c FROM sum32 GROUP BY row) WHERE xor(c, 4294967295) % 3 = 0),
lf AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN row IN (SELECT row FROM hit) THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS now FROM raw),
ps AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM lf),
up(tree, lv, pos, h, n) AS (SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM ps
  UNION ALL SELECT tree, lv + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM up WHERE n > 1 GROUP BY tree, lv, pos // 8),
sub AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM up WHERE n = 1),
top(lv, pos, h, n) AS (SELECT 0, pos, h, count(*) OVER () FROM sub
  UNION ALL SELECT lv + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY lv, pos // 8),
sib AS (SELECT a.tree, a.lv, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM up a JOIN up b ON a.tree = b.tree AND a.lv = b.lv AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
sib2 AS (SELECT a.lv, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM top a JOIN top b ON a.lv = b.lv AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
walk(tree, leafpos, lv, pos, h, proof) AS (SELECT tree, pos, 0, pos, now, '' FROM ps
  UNION ALL SELECT w.tree, w.leafpos, w.lv + 1, w.pos // 8, sha256(s.l || w.h || s.r), w.proof || s.l || s.r FROM walk w JOIN sib s ON s.tree = w.tree AND s.lv = w.lv AND s.pos = w.pos),
mid AS (SELECT tree, leafpos, arg_max(h, lv) AS h, arg_max(proof, lv) AS proof FROM walk GROUP BY ALL),
walk2(tree, leafpos, lv, pos, h, proof) AS (SELECT m.tree, leafpos, 0, s.pos, m.h, proof FROM mid m JOIN sub s USING (tree)
  UNION ALL SELECT w.tree, w.leafpos, w.lv + 1, w.pos // 8, sha256(s.l || w.h || s.r), w.proof || s.l || s.r FROM walk2 w JOIN sib2 s ON s.lv = w.lv AND s.pos = w.pos),
fin AS (SELECT tree, leafpos, arg_max(h, lv) AS h, arg_max(proof, lv) AS proof FROM walk2 GROUP BY ALL)
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM ps p JOIN fin f ON f.tree = p.tree AND f.leafpos = p.pos JOIN sub s ON s.tree = p.tree, (SELECT h FROM top WHERE n = 1) t"""
