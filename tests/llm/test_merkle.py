"""The Merkle manifest against a brute-force version and its SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from safesight.llm import merkle
from safesight.llm import queries as q


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """The root of nodes, and each one's siblings (before, after) up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(paths):
            run = at[k] // fanout * fanout
            p.append(("".join(nodes[run : at[k]]), "".join(nodes[at[k] + 1 : run + fanout])))
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], paths


def brute(rows, fanout):
    """rows: doc_id, text, lang, source, n_chars."""
    rows = sorted(((r, leaf(r, r[1])) for r in rows), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    langs = sorted({r[2] for r, _ in rows}, key=lambda v: (v is not None, (v or "").encode()))
    own = {v: climb([x for r, x in rows if r[2] == v], fanout) for v in langs}
    root, above = climb([own[v][0] for v in langs], fanout)
    out = []
    for v, top in zip(langs, above):
        for (r, x), path in zip([y for y in rows if y[0][2] == v], own[v][1]):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for a, b in path + top:
                folded = h(a + folded + b)
            out.append((r[0], x, own[v][0], root, h("".join(a + b for a, b in path + top)), folded, folded == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def found(df, fanout):
    made = merkle.manifest(df, fanout=fanout)
    return sorted((tuple(r) for r in made.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256), "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("fanout", [2, 8])
def test_against_brute_force(spark, fanout):
    """Null ids, languages and texts, an empty language, repeated rows and ids, clashing names, trees of one leaf and of many."""
    rows = [(k, f"Text {k} ÄB" if k % 5 else None, ["en", "de", None, "", "É"][k % 5 if k < 40 else 0], "s" if k % 3 else None, k if k % 4 else None) for k in range(90)]
    rows += [(None, "ABC", "en", "s", 3), (7, "other", "en", None, 1), rows[10], rows[10], (500, "One", "lone", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("clash") for c in ("tree", "pos", "leaf", "root", "h")})
    want = brute(rows, fanout)
    assert found(df, fanout) == want and 0 < sum(not r[-1] for r in want) < len(want)


def test_small_tables(spark):
    one = [(3, "Only", "en", "s", 4)]
    assert found(spark.createDataFrame(one, SCHEMA), 8) == brute(one, 8)
    assert found(spark.createDataFrame([], SCHEMA), 8) == []


def test_query(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(c.execute(q.oracle_sql()["op12_merkle_manifest"]).fetchall())
    assert sorted(tuple(r) for r in q.op12_merkle_manifest(spark, sf).collect()) == want
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    assert sorted(want, key=repr) == brute([tuple(r) for r in docs], 8)
