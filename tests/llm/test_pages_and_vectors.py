"""HTML extraction, exact top-k and the pipeline."""


import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import encoding, extract, htmltree, labelledpages, quality, topk, toxicity
from tests.llm.conftest import prose
from tests.llm.test_texts import expected_hits
from tests.llm.test_texts import near as near_classes


def shape(html):
    return [(x.tag, x.text) if x.text is not None else x.tag for x in htmltree.parse(html)[1:]]


def test_tree():
    assert shape("<p>a<b>b</b> &amp; c<p>d<div>e<br>f</div>g") == ["p", ("#text", "ab & c"), "p", ("#text", "d"), "div", ("#text", "e f"), ("#text", "g")]
    assert shape("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>") == ["ul", "li", ("#text", "a"), "li", ("#text", "b"), "table", "tr", "td", ("#text", "1"), "td", ("#text", "2"), "tr", "td", ("#text", "3")]
    assert shape("a<script>if (x < y) '</p>'</script>b<!-- <p>no -->c<style>p{}</style><title>t</title>") == [("#text", "abc")]
    assert shape("x < y <3 <p class='a>b'>z</p") == [("#text", "x < y <3"), "p", ("#text", "z")]
    assert shape("<p>a<script>never closed") == ["p", ("#text", "a")]
    assert htmltree.names_of(" class='Site-Header mainNav' id=x1 data-class=no") == ("site", "header", "main", "nav", "x")


def test_marginals_are_exact():
    """Message passing against the sum over all labellings of a small tree."""
    model = extract.default_model()
    nodes = htmltree.parse("<div class=comments><p>one two</p></div><p>three <a href=x>four</a></p>tail")
    (own, given), kinds = extract.features(nodes), extract.edge_kinds(nodes)
    feats = [x + y for x, y in zip(own, extract.above(nodes, given, ()), strict=True)]
    n = len(nodes)
    total, each = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        z = sum(y[i] * (sum(model.weights[b] for b in feats[i]) + model.bias[0 if nodes[i].text is not None else 1]) for i in range(n))
        z += sum(model.edge[kinds[i]][y[nodes[i].parent]][y[i]] for i in range(1, n))
        total += np.exp(z)
        each += np.exp(z) * np.array(y)
    assert model.marginals(nodes) == pytest.approx(each / total, abs=1e-6)


@pytest.mark.parametrize(
    "page",
    [
        "<div class='x y'>" * 100_000 + "deep" + "</div>" * 100_000,
        "<b>" * 50_000 + "</i>" * 50_000 + "end",
        "<div><li>" * 50_000 + "</ul>" * 50_000,
        "<p><b>" * 50_000 + "<td>" * 50_000,
        "<canvas>" * 50_000 + "</canvas>" + "<video>" * 50_000,
        "<svg>" * 50_000 + "</svg>" * 50_000 + "<p>end",
        "<p>x<script>" * 50_000,
        "".join(f"<div class='n{i} m{i}'>" for i in range(50_000)) + "text",
        "<a href=x>" * 50_000 + "link" + "</div>" * 50_000,
    ],
)
def test_time_is_in_proportion_to_the_page(page):
    model = extract.default_model()
    start = time.process_time()
    model.main_text(page)
    assert time.process_time() - start < 20
    assert extract._static.cache_info().currsize <= extract.NAMES_KEPT


def test_held_out_pages():
    model = extract.default_model()
    hit = said = true = 0
    for html, blocks in labelledpages.labelled_pages(120, seed=31):
        got = model.main_text(html).split("\n")
        hit += len(set(got) & set(blocks))
        said += len(set(got) - {""})
        true += len(set(blocks))
    assert hit / said > 0.95 and hit / true > 0.95


def test_extract_query(spark, write):
    rows = [(1, "u", "<nav><a href=x>Home</a></nav><article><h1>T \n t</h1><p>" + prose(1, 60) + ".</p><p>😀 " + prose(2, 60) + ".</p></article>"), (2, None, None)]
    folder = write(pages=spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit(0)))
    got = {r["page_id"]: r for r in extract.op9_html_extraction(spark, folder).collect()}
    text = f"T t\n{prose(1, 60)}.\n😀 {prose(2, 60)}."
    assert got[1].asDict() == {"page_id": 1, "url": "u", "text": text, "n_chars": len(text)}
    assert got[2].asDict() == {"page_id": 2, "url": None, "text": "", "n_chars": 0}


def test_extract(spark):
    article = "<article><h1>Title here</h1>" + "".join(f"<p>{prose(i, 40)}.</p>" for i in range(5)) + "</article>"
    page = f"<html><body><nav><ul><li><a href=a>Home</a><li><a href=b>More</a></ul></nav><div class='ad'>Buy now</div>{article}<footer>&copy; us</footer></body></html>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (1, "u", page), (4, None, page[:-30]), (None, "u", "<nav><a href=x>only</a></nav>"), (5, "u", page.replace(article, article * 300))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    expected = "\n".join(["Title here", *(f"{prose(i, 40)}." for i in range(5))])
    got = [(r["page_id"], r["text"]) for r in extract.extract(pages).collect()]
    assert got[:4] == [(1, expected), (2, ""), (3, ""), (1, expected)] and got[4] == (4, expected) and got[5] == (None, "")
    assert got[6][1].count("\n") == expected.count("\n") * 300 + 299
    assert extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "dim", "spread"), [(300, 3, 1.0), (200, 16, 0.1), (120, 2, 0.0)])
def test_top_k(spark, n, dim, spread):
    r = np.random.default_rng(dim)
    centres = r.normal(size=(6, dim))
    x = centres[r.integers(0, 6, n)] + spread * r.normal(size=(n, dim))
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [float("nan")] * dim), (n + 3, [None] * dim), (n + 4, [float("inf")] * dim), (5, rows[5][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    vectors = topk.integers(frame)
    found = topk.top_k(vectors, vectors.filter("vec_id % 10 = 0 and vec_id < 1000 and size(ints) > 0"), k=4, block=32, query_block=8, slots=3)
    got = {}
    for q in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(q["query_id"], []).append((q["vec_id"], q["score"]))
    ints = {(i, j): np.floor(256 * np.array(v)).astype(np.int64) for j, (i, v) in enumerate(rows) if i < n}
    for (i, _), q in ints.items():
        if i % 10 == 0:
            best = sorted(((-int(q @ v), c[0]) for c, v in ints.items() if c[0] != i))[:4]
            assert got.pop(i) == [(c, -s) for s, c in best]
    assert not got
    assert topk.top_k(vectors, vectors.limit(0)).count() == 0


def test_blocks_are_pruned_before_they_move(spark):
    r = np.random.default_rng(0)
    centres = 40 * r.normal(size=(24, 6))
    x = centres[r.integers(0, 24, 6000)] + 0.1 * r.normal(size=(6000, 6))
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    vectors = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    log = {}
    found = topk.top_k(vectors, vectors.filter("vec_id % 10 = 0"), k=3, block=64, query_block=8, log=log)
    got = {}
    for q in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(q["query_id"], []).append((-q["score"], q["vec_id"]))
    ints = np.floor(256 * x).astype(np.int64)
    scores = ints[::10] @ ints.T
    for i, own in zip(range(0, 6000, 10), scores, strict=True):
        assert got[i] == sorted((-int(s), j) for j, s in enumerate(own.tolist()) if j != i)[:3]
    assert 0 < log["first"] + log["listed"] < 0.1 * log["possible"], log


def test_large_components_and_null_ids(spark):
    big = 2.0**32
    rows = [(1, [big, 1.0]), (2, [big, 2.0]), (3, [-big, 0.0]), (4, [1.0, big]), (None, [big, big])]
    vectors = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=0.4)
    ints = {i: [int(np.floor(0.4 * v)) for v in x] for i, x in rows if i}
    found = topk.top_k(vectors, vectors, k=2).collect()
    best = {i: sorted((-sum(a * b for a, b in zip(q, ints[j], strict=True)), j) for j in ints if j != i)[:2] for i, q in ints.items()}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == {(i, n + 1, j, -s) for i, x in best.items() for n, (s, j) in enumerate(x)}
    assert topk.top_k(vectors.limit(0), vectors).count() == 0
    for x in ([2.0**40, 0.0], [2.0**70, 0.0]):
        over = spark.createDataFrame([(1, x), (2, x)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="beyond 64-bit"):
            topk.top_k(topk.integers(over), topk.integers(over), k=1).collect()


def test_top_k_query(spark, write):
    r = np.random.default_rng(4)
    rows = [(i, [float(v) for v in r.normal(size=5)]) for i in range(300)] + [(50, None), (None, [1.0] * 5), (100, [2.0, 3.0])]
    folder = write(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    got = topk.op10_exact_topk(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(topk.ORACLE).fetchall())


def test_search_prunes():
    r = np.random.default_rng(0)
    centres = 1000 * r.normal(size=(20, 4))
    x = np.floor(centres[r.integers(0, 20, 4000)] + r.normal(size=(4000, 4)))
    p, q = topk.CoverTree(x), topk.CoverTree(x[:50])
    for tree in (p, q):
        for first, last, centre, a, b in tree.nodes.tolist():
            d = np.sqrt(((tree.points[first:last] - tree.points[centre]) ** 2).sum(axis=1)).max()
            assert d <= tree.radii[tree.nodes[:, 2].tolist().index(centre)] + 1e-6 or a or b
    best = topk.Best(50, 3)
    done = topk.dual_search(q, q.order, p, p.order, best)
    assert done < 0.5 * 50 * 4000
    scores = q.points @ p.points.T
    scores[q.order[:, None] == p.order] = -np.inf
    assert (np.sort(best.scores, axis=1)[:, ::-1] == np.sort(scores, axis=1)[:, ::-1][:, :3]).all()


def test_pipeline_against_brute_force(spark, data_dir, write, awkward):
    """Awkward rows and repeated ids through run(): models' scores as they are, all else by brute force."""
    real = spark.read.parquet(f"{data_dir}/documents.parquet")
    tables = {n: spark.read.parquet(f"{data_dir}/{n}.parquet") for n in ("labels", "benchmark")}
    passage = tables["benchmark"].first()["text"]
    near = prose(500, 60)
    rows = [(70001, prose(400, 60)), (70001, prose(401, 60)), (70002, near), (70002, near + " end"), (70003, prose(402, 40) + " " + passage), (None, prose(403, 50)), (None, prose(404, 50)), (70004, prose(405, 40) + " <|endoftext|>")]
    docs = real.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True).unionByName(awkward, allowMissingColumns=True)
    folder = write(documents=docs, **tables)
    packed = corpus_pipeline.run(spark, folder).collect()
    for r in packed:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4
    good = quality.keep_good(docs)
    clean = [(r["doc_id"], r["text"]) for r in toxicity.keep_clean(spark.createDataFrame(good.collect(), good.schema), tables["labels"]).collect()]
    classes, _ = near_classes([t for _, t in clean])
    kept = {}
    for (doc_id, text), c in zip(clean, classes, strict=True):
        kept.setdefault(c, []).append((doc_id, text))
    items = [(r["item_id"], r["text"]) for r in tables["benchmark"].collect()]
    library = Tokenizer.from_file(encoding.tokenizer_path("byte_bpe_50k.json"))
    # One document of each class, and none that holds a passage.
    expected = [[(d, np.append(library.encode(t, add_special_tokens=False).ids, 0).astype("<u4").tobytes()) for d, t in own if not expected_hits(t, items)[1]] for own in kept.values()]
    said = sum(len(r["ids"]) for r in packed)
    least, most = (sum(f(len(i) for _, i in own) for own in expected if own) for f in (min, max))
    assert least <= said <= most
    whole = {(d, i) for own in expected for d, i in own}
    for r in packed:
        if r["start"] == 0 and r["length"] < 2048:
            assert (r["doc_id"], r["ids"]) in whole or any(d == r["doc_id"] and i.startswith(r["ids"]) for d, i in whole)
    starts = [r for r in packed if r["piece"] == 0]
    assert len(starts) == sum(bool(own) for own in expected)
    assert sum(r["doc_id"] == 70001 for r in starts) == 2 and sum(r["doc_id"] == 70002 for r in starts) == 1 and not any(r["doc_id"] == 70003 for r in starts)


def test_pipeline(spark, data_dir, write, no_docs):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    at, counts = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, data_dir).collect(), docs.schema)
        assert at.columns == docs.columns
        counts.append(at.count())
    assert docs.count() > counts[0] >= counts[1] > counts[2] >= counts[3] > 50  # too few toxic rows here to learn from
    packed = corpus_pipeline.STAGES[-1][1](spark, at, data_dir)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    folder = write(documents=no_docs, labels=spark.read.parquet(f"{data_dir}/labels.parquet"), benchmark=spark.read.parquet(f"{data_dir}/benchmark.parquet"))
    assert corpus_pipeline.run(spark, folder).count() == 0



@pytest.mark.parametrize("inset", ["<svg width='1'/>", "<math />", "<svg><svg/><title>no</title><svg>no</svg></svg>", "<video src=x>no</video>", "<object><p>no</p><object>no</object>no</object>", "<canvas>"])
def test_embedded_elements_leave_the_article(inset):
    texts = [n.text for n in htmltree.parse(f"<p>one</p>{inset}<p>two</p><svg>no</svg><p>three</p>") if n.text is not None]
    assert texts == ["one", "two", "three"]
