"""Repeated passages against a brute-force version."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from safesight.llm import queries as q
from safesight.llm import suffix_dedup


def brute(rows, least):
    first, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for w in (b[i : i + least] for i in range(len(b) - least + 1)):
            if d is not None and d < first.get(w, d + 1):
                first[w] = d
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if d is not None and first[b[i : i + least]] < d:
                gone[i : i + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, least):
    return sorted((tuple(r) for r in suffix_dedup.digests(df, least).collect()), key=repr)


@pytest.mark.parametrize(("least", "letters", "hot"), [(5, "ab", 1 << 18), (8, "abcé", 1 << 18), (8, "abc", 300), (50, "abc ", 1 << 18)])
def test_against_brute_force(spark, monkeypatch, least, letters, hot):
    """Null and repeated ids, repeated rows, copies, shared passages, one letter over and over; also with every anchor hot."""
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    rnd = random.Random(least)
    rows = [(rnd.randrange(40) if rnd.random() > 0.05 else None, "".join(rnd.choice(letters) for _ in range(rnd.randrange(120)))) for _ in range(60)]
    passage = "".join(rnd.choice("abcdefgh") for _ in range(300))
    rows += [(100 + k, passage[k * 7 : k * 7 + 150] + rows[k][1]) for k in range(20)] + [(7, None), (8, ""), rows[3], rows[3], (200, "a" * 300), (201, "a" * 77), (202, "\0" * 60), (203, "x" + "\0" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("tag", F.lit("clash")).withColumn("cuts", F.lit(1))
    assert found(df, least) == brute(rows, least)
    assert found(df.limit(0), least) == []


def test_a_long_text_and_many_texts(spark, monkeypatch):
    """Slices and transforms of a few kilobytes cut nothing off."""
    monkeypatch.setattr(suffix_dedup, "SLICE", 1000)
    monkeypatch.setattr(suffix_dedup, "TEXT_BYTES", 2000)
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdef") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    long = " ".join(rnd.choice(words) for _ in range(8000))
    rows = [(5, long), (3, long[2000:2300]), (9, long[:50] + "-" + long[40000:40049]), (12, "new " + long[30000:] + " end")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 50) == brute(rows, 50)


def test_intervals_are_common_prefixes():
    """Marks are where sorted suffixes share under ``least`` bytes."""
    rnd = random.Random(4)
    pieces = [bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(12, 60))) for _ in range(40)]
    pieces += [pieces[0], pieces[1][:20], pieces[2][3:]]
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    size = np.array([len(p) + 1 for p in pieces])
    end = np.repeat(np.cumsum(size), size)
    order = suffix_dedup.suffix_order(text, end - 1 - np.arange(len(text)), np.repeat(np.arange(len(pieces)), size))
    own = [text[i : end[i] - 1].tobytes() for i in order]
    assert own == sorted(own, key=lambda s: s + b"\xff")
    common = [next((k for k in range(12) if a[k : k + 1] != b[k : k + 1] or k == len(a)), 12) for a, b in zip(own, own[1:])]
    assert suffix_dedup.intervals(text, order, 12).tolist() == [True] + [c < 12 for c in common]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((tuple(r) for r in q.op11_suffix_dedup(spark, sf).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 50)
    assert any(r[2] for r in got)


def test_a_spot_meets_its_kind_once(spark):
    """A kind's runs are one row: a spot has one row with its cuts, of runs from smaller documents only."""
    spots = spark.createDataFrame([(1, 2, d, 7, None) for d in (5, 8, 3)], "h long, g long, doc_id long, at long, piece binary")
    runs = spark.createDataFrame([(1, 2, 0, 4, 3), (1, 2, 4, 6, 5)], "h long, g long, a long, b long, lo long")
    found = {r.doc_id: sorted(map(tuple, r.cuts)) for r in suffix_dedup._spans(spots, runs, 50).collect()}
    assert found == {5: [(7, 60)], 8: [(7, 60), (11, 62)]}
