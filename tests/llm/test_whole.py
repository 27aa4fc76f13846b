"""Each operator does its whole job where a shorter way would look alike on small tables."""

import collections

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from safesight.llm import bpe, decontaminate, nn_descent, site_style


def test_descent_goes_on_until_the_graph_is_settled(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "LEAF", 16)
    monkeypatch.setattr(nn_descent, "TREES", 3)
    x = np.random.default_rng(5).standard_normal((1500, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    graphs, search = [], nn_descent._search
    monkeypatch.setattr(nn_descent, "_search", lambda starts, nodes, graph, *a: graphs.append(graph.collect()) or search(starts, nodes, graph, *a))
    nn_descent.search(df, F.col("vec_id") == 0, k=10)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    true = {(u, int(v)) for u, row in enumerate(np.argpartition(d, 10, axis=1)[:, :10]) for v in row}
    share = len(true & {(r.u, r.v) for r in graphs[0]}) / len(true)
    assert share >= 0.85, share


def test_named_wrappers_of_the_article_stay():
    text = "<article><h1>Title</h1><p>A long enough text of the page</p><div class='comments'><p>me too</p></div></article>"
    wrapped = ["<div class='layout has-sidebar'>{}</div>", "<div class='no-ads'>{}</div>", "<section id='with-header'>{}</section>", "<form id='aspnetForm'>{}</form>", "<div class='comments'>{}</div>"]
    for outer in wrapped:
        page = "<body><nav>Menu</nav>" + outer.format(text + "<aside><article>Also read</article></aside>") + "<footer>F</footer></body>"
        assert site_style.kept(site_style.blocks(page), set()) == ["Title", "A long enough text of the page"], outer
        # without an article, the part that holds most of the text is its wrapper
        plain = outer.format("<p>A long enough text of the page</p><div class='share'>Share</div>")
        assert site_style.kept(site_style.blocks(f"<nav>Menu</nav>{plain}" if "comments" not in outer else plain), set()) == ["A long enough text of the page"], outer
    inner = "<article><div class='content no-sidebar'><p>The whole text of the page</p></div><div class='ad'>Buy</div></article>"
    assert site_style.kept(site_style.blocks(inner), set()) == ["The whole text of the page"]
    # readers' words stay out even where they outweigh the text
    talk = "<article><p>Short</p><div class='comments'><p>Much longer words of readers</p></div></article>"
    assert site_style.kept(site_style.blocks(talk), set()) == ["Short"]


def test_entropies_decide_inside_articles(spark):
    strip = "<div class='strip'><p>Same words on every page</p></div><ul class='more'><li>Same</li><li>list</li></ul>"
    rows = [(i, f"http://s.com/{i}", f"<article><h1>Title {i}</h1><div class='body'><p>Shared by all</p>" + "".join(f"<p>Text {i} {k}</p>" for k in range(i % 5 + 1)) + f"</div>{strip}</article>") for i in range(40)]
    # copies of one article keep their text
    rows += [(100 + i, f"http://copies.com/{i}", "<article><div><p>One text</p></div></article>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_style.extract(df).collect()}
    for i in range(40):
        assert got[i] == "\n".join([f"Title {i}", "Shared by all", *(f"Text {i} {k}" for k in range(i % 5 + 1))])
    assert all(got[100 + i] == "One text" for i in range(20))


def test_pipeline_delivers_token_ids(spark):
    docs = spark.createDataFrame([(1, "One text, two words"), (2, None)], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    own = bpe.WordBpe(path)
    got = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()}
    want = own.encode("One text, two words")
    assert want and got[1].ids == want and got[1].decoded == own.decode(want) and got[2].ids == [] and got[2].decoded == ""


def test_pipeline_drops_scattered_edits(spark):
    w = [f"w{i}" for i in range(1000)]
    near = [f"new{i}" if i % 50 == 25 else x for i, x in enumerate(w)]  # 5-word similarity 0.82, 3-word similarity 0.89
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(near)), (3, "something else entirely in this text")], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_pipeline_keeps_rows_without_id_and_the_least_text(spark):
    text = "a text of seven words or so {}"
    docs = spark.createDataFrame([(None, "one"), (None, "two"), (5, text.format("b")), (5, "another text under the same id"), (5, text.format("b")), (6, None), (6, "x y z")], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs.withColumn("_x", F.lit(1)), "")
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "one"), (0, "two"), (5, text.format("b")), (6, "")] and kept.columns == ["doc_id", "text", "_x"]


def test_pipeline_of_odd_rows(spark, sf):
    """Nulls, empty, very long and repeated texts, columns with clashing names and an empty table, through all stages."""
    own = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    odd = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "x" * 50_000), (6, "é ß 日本語 🙂 ok"), (7, "a b c " * 5000), (None, "no id"), (None, None)]
    rows = spark.createDataFrame([(None if i is None else 10**6 + i, None, None, None, t) for i, t in odd], "doc_id long, source string, lang string, n_chars long, text string")
    clash = {c: F.lit("x") for c in ("id", "doc", "label", "score", "size", "token", "part", "h", "component_id")}
    docs = own.select(rows.columns).unionByName(rows).withColumns(clash)
    for given, want in ((docs, {None: 2, **{10**6 + i: 1 for i in range(1, 8)}}), (docs.limit(0), {})):
        kept = given
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, sf)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert kept.columns == docs.columns, name
        got = collections.Counter(r.doc_id for r in kept.collect())
        assert {i: n for i, n in got.items() if i is None or i > 10**6} == want and all(n == 1 for i, n in got.items() if i is not None)


def test_recall_after_deletions_of_all_sizes():
    rng = np.random.default_rng(7)
    sizes = [1, 2, 4, 5, 8, 16, 30, 45, 47, 48, 59, 100, 150, 250, 400]
    items = [(i, rng.integers(0, 1 << 62, n).astype(np.uint64)) for i, n in enumerate(sizes * 25)]
    own = decontaminate.Items(items, 0.2, 0.99, 1)
    docs = []
    for i, (_, w) in enumerate(items):  # at a text's end, or before other words
        gone = rng.choice(len(w), int(0.2 * len(w)), replace=False)
        parts = [rng.integers(0, 1 << 62, rng.integers(0, 30)).astype(np.uint64), np.delete(w, gone), rng.integers(0, 1 << 62, 40 * (i % 2)).astype(np.uint64)]
        docs.append(np.concatenate(parts))
    found = list(own.leaks(np.concatenate(docs), np.array([len(d) for d in docs])))
    assert all(d == i and distance <= 0.2 * len(items[i][1]) for d, i, distance, *_ in found)
    hit = {d for d, *_ in found}
    for at, n in enumerate(sizes):
        share = sum(i in hit for i in range(at, len(items), len(sizes))) / 25
        assert share >= 0.92, (n, share)
    assert len(hit) >= 0.98 * len(items), len(hit) / len(items)
    with pytest.raises(ValueError, match="keys find only"):
        decontaminate.repeats(40, 51, 0.6, 0.999)


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    items = [(i, [f"w{w}" for w in rng.integers(0, 60, n)]) for i, n in enumerate([6, 9, 15, 25, 50] * 3)]
    items += [(15, ["w7"]), (16, ["w3", "w9"]), (17, ["w5", "w5", "w6", "w1"]), (18, [])]
    rows = []
    for d in range(60):
        w = list(items[d % 15][1])
        for _ in range(int(rng.integers(0, len(w) // 3 + 1))):
            w[rng.integers(0, len(w))] = f"w{rng.integers(0, 60)}"
        rows.append((d, " ".join([f"w{x}" for x in rng.integers(0, 60, rng.integers(0, 20))] + w + ["w1"])))

    def least(a, b):  # of a to a run of b
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            row, old = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(row[j] + 1, old[j + 1] + 1, old[j] + (x != y)))
        return min(row)

    want = {(d, i): k for d, t in rows for i, w in items if w and (k := least(w, t.split())) <= len(w) // 5}
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in found}
    assert got.items() <= want.items() and len(got) >= 0.97 * len(want) and len(want) > 20
