"""Operators on words: decontamination, similarity join, licences, quality, toxicity."""

import collections
import hashlib
import itertools
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import components, decontaminate, jaccard, licenses, quality, registry, textcore, toxicity
from tests.llm.conftest import prose

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return _WORD.findall((text or "").translate(_LOWER))


def test_words_and_hashes():
    texts = ["Ab-c É日x 9", None, "", "...", "ab c", "AB C ab c"]
    w = textcore.words(texts)
    assert [[w.word(i).decode() for i in range(a, b)] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)] == [[x.lower() if x.isascii() else x for x in words(t)] for t in texts]
    same = textcore.words(["x ab", "ab"]).hashes
    assert same[1] == same[2] and len(set(same.tolist())) == 2
    grams, offsets = textcore.ngrams(w, 2)
    assert np.diff(offsets).tolist() == [3, 0, 0, 0, 1, 3]
    assert grams[offsets[4]] == grams[offsets[5]] == grams[offsets[5] + 2]


def test_hashes_of_chunks_and_whole_texts_agree(monkeypatch):
    texts = [prose(i, 3 * i) + "é日" * i for i in range(30)] + ["x" * 300 + " y", None]
    whole = textcore.words(texts)
    grams, text, other = textcore.ngrams(whole, 5), textcore.text_hashes(whole), whole.others()
    monkeypatch.setattr(textcore, "_CHUNK", 11)
    monkeypatch.setattr(textcore, "_powers", {})
    parts = textcore.words(texts)
    assert (parts.hashes == whole.hashes).all() and (parts.others() == other).all() and not (other == whole.hashes).any()
    assert (textcore.ngrams(parts, 5)[0] == grams[0]).all() and (textcore.text_hashes(parts) == text).all()
    assert (textcore.span_hashes(whole.hashes, np.arange(50), 5) == textcore.every_span(whole.hashes, 5)[:50]).all()


def expected_hits(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(window, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n and item is not None else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                found.add(str(item))
                hit.update(range(i, i + n))
    return len(w), len(hit), found


@pytest.mark.parametrize("block", [2_000_000, 20])
def test_decontamination(spark, awkward, block):
    r = random.Random(3)
    base = words(prose(9, 400))
    items = [(1, " ".join(base[:30])), (2, " ".join(base[20:60])), (2, "tail words " + prose(8, 12)), (3, "two words"), (4, None), (5, ""), (None, " ".join(base[100:130])), (6, " ".join(base[200:209])), (12, " ".join(["an"] * 14))]
    texts = [" ".join(base[5:14]), " ".join(base[5:15]), "X " + " ".join(base[0:60]).upper() + " y", "two words. two-words", " ".join(["an"] * 40), " ".join(base[195:215]), " ".join(base), None, ""]
    texts += [" ".join(r.choice([" ".join(base[k : k + r.randint(3, 14)]), prose(k, 5)]) for k in [r.randint(0, 380) for _ in range(20)]) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: x for x in decontaminate.mark(docs, bench, most_windows=block).collect()}
    for i, t in enumerate(texts):
        n, hit, found = expected_hits(t, items)
        assert (got[i]["n_words"], sum(s["after"] - s["first"] for s in got[i]["hit_spans"]), set(got[i]["items"])) == (n, hit, found), t
    clash = decontaminate.mark(docs.withColumns({"items": F.lit(1), "n_words": F.lit("x"), "_k1": F.lit(0)}), bench, most_windows=block)
    assert clash.columns == ["doc_id", "text", "_k1", "n_words", "hit_spans", "items"] and clash.filter("size(items) > 0").count() > 5
    kept = decontaminate.clean(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert decontaminate.clean(awkward, bench.limit(0)).count() == awkward.count()
    assert decontaminate.mark(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(30 + 10 * seed)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent if top(x) != x}


def near(texts, k=5, threshold=0.8):
    """Class and links of each text, by brute force."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent, links = list(range(len(texts))), collections.Counter()

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(texts))], [links[i] for i in range(len(texts))]


def test_similarity_join(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    r = random.Random(1)
    texts = [None, "", "!!", "short one", "Short one!", "a b c d e", "a b c d e f"]
    for i in range(12):
        base = words(prose(50 + i, 120))
        for _ in range(r.randint(1, 9)):
            x = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                x[r.randrange(len(x))] = "new"
            texts.append(" ".join(x))
    classes, links = near(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in jaccard.classes(docs).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == classes
    assert [got[i]["links"] for i in range(len(texts))] == links
    kept = [x["doc_id"] for x in jaccard.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(classes))


def test_unlike_texts_of_one_id_are_kept(spark):
    texts = []
    for i in range(150):
        w = prose(1000 + i, 60).split()
        texts += [" ".join(w), " ".join([*w, "end"])]
    for ids in ([1] * 300, [None] * 300, [i % 3 for i in range(300)]):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        kept = [x["text"] for x in jaccard.keep_one(docs).collect()]
        assert sorted(t.removesuffix(" end") for t in kept) == sorted(t for t in texts if not t.endswith(" end"))
        assert {x["links"] for x in jaccard.classes(docs).collect()} == {1}


def test_hot_texts_buckets_and_chains(spark, monkeypatch):
    """Many copies under one id, and a chain of texts that are alike in part, in cells of buckets."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    chosen = []
    cells = jaccard.cells
    monkeypatch.setattr(jaccard, "cells", lambda one: chosen.append(cells(one)) or chosen[-1])
    base = words(prose(77, 2000))
    texts = [" ".join(base[12 * i : 12 * i + 60]) for i in range(60)] + [" ".join(base[4 * i + 900 : 4 * i + 960]) for i in range(20)]
    many = [(7, texts[0])] * 400 + [(None, texts[1])] * 400
    docs = spark.createDataFrame(list(enumerate(texts)) + many, "doc_id long, text string")
    got = jaccard.classes(docs).collect()
    assert len(got) == len(texts) + 800
    classes, links = near(texts)
    copies = collections.Counter(t for _, t in many)
    own = {x["doc_id"]: x for x in got if x["doc_id"] is not None and x["copy_of"] == x["doc_id"] and not (x["doc_id"] == 7 and x["texts"] != links[7])}
    assert [own[i]["texts"] for i in range(2, len(texts))] == links[2:]
    roots = {}
    assert all(roots.setdefault(own[i]["root"], classes[i]) == classes[i] for i in range(2, len(texts)))
    assert max(chosen[0].select("band").distinct().toPandas()["band"]) >= 0 and sum(copies.values()) == 800
    kept = jaccard.keep_one(docs).collect()
    assert len(kept) == len(set(classes))


def test_texts_of_equal_hash_are_apart(spark):
    made = spark.createDataFrame([(1, 10), (1, 10), (1, 20), (2, 30), (None, None)], "node long, check long")
    got = [(x["node"], x["check"]) for x in jaccard._apart(made).collect()]
    assert len({n for n, _ in got}) == 4 and {c for n, c in got if n == 1} == {10} and (2, 30) in got and (None, None) in got


def test_similarity_join_of_awkward_rows(awkward, no_docs):
    kept = jaccard.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((x["doc_id"] or 0, (x["text"] or "")[:5]) for x in kept.collect()) == sorted((x["doc_id"] or 0, (x["text"] or "")[:5]) for x in awkward.collect() if x["doc_id"] not in (2, 3))
    assert jaccard.classes(awkward).count() == awkward.count()
    assert jaccard.keep_one(no_docs).count() == 0 and jaccard.keep_one(no_docs).columns == no_docs.columns


def test_bands_meet_the_recall():
    for threshold in (0.5, 0.7, 0.8, 0.95):
        bands, rows = jaccard.choose_bands(threshold)
        assert bands * rows <= jaccard.MOST_HASHES
        assert rows == 1 or 1 - (1 - threshold**rows) ** bands >= jaccard.RECALL


def test_licenses(spark, write, awkward):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 500)
    texts = [None, "", "Released under the MIT licence", "x\nLICENSED UNDER CC-BY-NC 4.0\ny\nReleased under the MIT License.\nreleased under the MIT license", "Copyright (c) 2020 Someone\n\n" + mit.replace("\n", " ").replace("sublicense", "sub-license"), "It isn't released under the MIT License.", "Licensed under the Apache License, v2.0.", prose(4, 5000)]
    folder = write(documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("digest", F.lit("x")))
    got = sorted(map(tuple, licenses.op2_license_scans(spark, folder).collect()))
    assert got == [(2, "MIT", "line", 1), (2, "MIT", "text", 1), (3, "CC-BY-NC-4.0", "line", 1), (3, "MIT", "line", 2), (4, "MIT", "line", 1), (4, "MIT", "span", 1), (4, "MIT", "text", 1), (6, "Apache-2.0", "line", 1), (6, "Apache-2.0", "text", 1)]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(c.sql(registry.ORACLE_SQL["op2_license_scans"]).fetchall()) == got
    assert "Python" not in licenses.findings(awkward)._jdf.queryExecution().toString()
    assert licenses.findings(awkward).count() == 0


def test_licences_within_texts(spark, write):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 500 and t.startswith("Perm"))
    commented = "/*\n * Copyright (c) 2020 Foo\n *\n" + "".join(f" * {x}\n" for x in mit.split("\n")) + " */\nint main() { return 0; }\n"
    texts = [
        "// Copyright (c) 2020 Foo. Licensed under the Apache License, Version 2.0.\nx = 1",
        "Copyright 2021 Foo. All rights reserved.",
        "(c) You must retain all notices\n(c) Neither the name\n(c) 2020 Foo\n(c) Jane Doe",
        commented, prose(1, 300) + "\n\n" + mit + "\n\n" + prose(2, 300), mit.replace("hereby granted", "hereby given") + "\ncode", mit + " and more", mit[:-1] + "s", ("Permission is hereby\n" * 300) + mit + "\n" + mit,
        "Copyright 2020 A. All rights reserved.\n\n" + mit, None, "",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (3, commented), (None, commented)], "doc_id long, text string").withColumn("license_id", F.lit("x"))
    folder = write(documents=docs)
    got = sorted(map(tuple, licenses.op2_license_scans(spark, folder).collect()), key=str)
    said = {}
    for d, i, unit, n in got:
        said.setdefault(d, set()).add((i, unit, n))
    assert said == {
        0: {("Apache-2.0", "line", 1)}, 1: {("all-rights-reserved", "line", 1), ("all-rights-reserved", "text", 1)}, 3: {("MIT", "span", 2)}, None: {("MIT", "span", 1)}, 4: {("MIT", "span", 1)},
        6: {("MIT", "span", 1)}, 8: {("MIT", "span", 2)}, 9: {("MIT", "span", 1), ("MIT", "text", 1), ("all-rights-reserved", "line", 1)},
    }
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(c.sql(registry.ORACLE_SQL["op2_license_scans"]).fetchall(), key=str) == got
    third = spark.createDataFrame([(texts[2],)], "t string").select(licenses.canonical(F.col("t"))).first()[0]
    assert third == "c you must retain all notices c neither the name"


def test_full_licence_texts(spark, write):
    heads = ["Copyright The Go Authors", "Copyright Google Inc.", "Copyright by Jane Doe 2020", "Copyright (c) 2020 A\nAll rights reserved.", "(c) Jane Doe", "© 2020 A", "Copyright [yyyy] [name]", "Copyright Notable Ltd", "Copyright 2020 A. All rights reserved."]
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 500 and t.startswith("Perm"))
    texts = {i: (h + "\n\n" + mit, "MIT") for i, h in enumerate(heads)}
    full = {}
    for i, t in licenses.KNOWN:
        if len(t) > len(full.get(i, "x" * 400)):
            full[i] = t
    assert {*licenses.FILES, "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "AGPL-3.0"} <= set(full)
    for i, t in full.items():
        texts[len(texts)] = (t, i)
        for width in (60, 64, 72, 79, 100):
            kept = "\n\n".join(textwrap.fill(" ".join(x.split()), width, break_on_hyphens=False, break_long_words=False) if "copyright (c)" not in x.lower() and "copyright [" not in x.lower() else x for x in t.split("\n\n"))
            texts[len(texts)] = (kept, i)
    texts[len(texts)] = ("Copyright notice\n" + mit, None)
    folder = write(documents=spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string"))
    got = sorted(map(tuple, licenses.op2_license_scans(spark, folder).collect()))
    whole = {d: i for d, i, unit, _ in got if unit == "text"}
    assert [(k, i, whole.get(k), t[:60]) for k, (t, i) in texts.items() if whole.get(k) != i] == []
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(c.sql(registry.ORACLE_SQL["op2_license_scans"]).fetchall()) == got


def test_expectation_maximisation_finds_accuracies():
    r = np.random.default_rng(0)
    good = r.random(20_000) < 0.8
    kind = r.integers(0, 4, len(good))
    v = np.full((len(good), 4), -1)
    for j in range(4):
        bad = np.where(good, r.random(len(good)) < 0.003, (kind == j) & (r.random(len(good)) < 0.9))
        v[:, j] = np.where(r.random(len(good)) < 0.1, -1, ~bad)
    rows, n = np.unique(v, axis=0, return_counts=True)
    model = quality.expectation_maximisation(rows, n.astype(float))
    assert ((quality.posterior(v, model) > 0.5) == good).mean() > 0.95
    cast = v >= 0
    true = ((v == good[:, None]) & cast).sum(axis=0) / cast.sum(axis=0)
    assert np.abs(model["accuracy"] - true).max() < 0.02


def test_expectation_maximisation_with_overlapping_labellers():
    """Labellers that see several kinds of bad documents, none of them always right."""
    r = np.random.default_rng(3)
    good = r.random(40_000) < 0.7
    kind = r.integers(0, 3, len(good))
    sees = np.array([[0.9, 0.5, 0.0], [0.4, 0.9, 0.3], [0.0, 0.4, 0.9], [0.6, 0.6, 0.6], [0.3, 0.0, 0.5]])
    wrong = np.array([0.01, 0.02, 0.01, 0.03, 0.02])
    v = np.stack([np.where(r.random(len(good)) < 0.1, -1, ~np.where(good, r.random(len(good)) < wrong[j], r.random(len(good)) < sees[j][kind])) for j in range(5)], axis=1)
    rows, n = np.unique(v, axis=0, return_counts=True)
    model = quality.expectation_maximisation(rows, n.astype(float))
    known = quality._posteriors((v == 1).astype(float), (v == 0).astype(float), np.vstack([wrong, sees.T]).clip(1e-4, 1 - 1e-4), np.array([0.7, 0.1, 0.1, 0.1]))[:, 0]
    best = ((known > 0.5) == good).mean()
    assert ((quality.posterior(v, model) > 0.5) == good).mean() > best - 0.02
    cast = v >= 0
    true = ((v == good[:, None]) & cast).sum(axis=0) / cast.sum(axis=0)
    assert np.abs(model["accuracy"] - true).max() < 0.05


SCRIPTS = [
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Всё смешалось в доме Облонских. Жена узнала, что муж был в связи с гувернанткой, и объявила мужу, что не может жить с ним в одном доме.",
    "孔子说，学习并且经常复习，不是很快乐吗？有朋友从远方来，不是很高兴吗？别人不了解我，我却不生气，不是君子吗？今天的天气很好，我们去公园散步，看见许多花开了。",
    "Η γλώσσα είναι το μέσο με το οποίο οι άνθρωποι επικοινωνούν μεταξύ τους. Κάθε μέρα μιλάμε με φίλους και συγγενείς, γράφουμε γράμματα και διαβάζουμε βιβλία.",
    "भारत एक विशाल देश है जहाँ अनेक भाषाएँ बोली जाती हैं। यहाँ के लोग मिलनसार होते हैं और अतिथि का सम्मान करते हैं। हर प्रदेश का अपना भोजन और अपनी वेशभूषा होती है।",
    "اللغة العربية هي أكثر اللغات السامية تحدثا ونطقا وإحدى أكثر اللغات انتشارا في العالم يتحدثها أكثر من أربعمائة مليون نسمة ويتوزع متحدثوها في الوطن العربي.",
    "Suomen kieli on yksi maan virallisista kielistä, ja sitä puhuu noin viisi miljoonaa ihmistä. Monet lapset oppivat sen kotona, mutta koulussa opetetaan myös ruotsia ja englantia.",
    "Wszystkie szczęśliwe rodziny są do siebie podobne, każda nieszczęśliwa rodzina jest nieszczęśliwa na swój sposób. W domu panował wielki zamęt, a żona dowiedziała się o wszystkim.",
]


def test_clean_prose_of_other_scripts_is_kept(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    junk = "!!! $$$ ### " * 40
    rows = [(-1 - i, t) for i, t in enumerate(SCRIPTS)] + [(-100 - i, junk + t[:20]) for i, t in enumerate(SCRIPTS)]
    kept = {x["doc_id"] for x in quality.keep_good(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).filter("doc_id < 0").collect()}
    assert kept == {-1 - i for i in range(len(SCRIPTS))}


def test_quality_query(spark, data_dir):
    got = quality.op6_quality_classifier(spark, data_dir)
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    assert got.count() == docs.count() and got.filter("score < 0 or score > 1 or keep <> (score >= 0.5)").count() == 0
    right, n = got.join(labels, "doc_id").select(F.count_if(F.col("keep") == (F.col("quality") == 1)), F.count("quality")).first()
    assert right > 0.98 * n


def test_quality(spark, awkward, no_docs):
    r = random.Random(2)
    texts = []
    for i in range(240):
        t = "The " + " of the ".join(prose(i * 7 + j, r.randint(4, 12)) for j in range(6)) + "."
        bad = i % 6 == 0
        if bad:
            w = t.split()
            t = [" | ".join(w), " ".join(x + "$$$" for x in w), " ".join(w[:3] * 30), " ".join(w).upper() + "!! " * 60][i // 6 % 4]
        texts.append((i, t, bad))
    docs = spark.createDataFrame(texts, "doc_id long, text string, bad boolean")
    kept = {x["doc_id"] for x in quality.keep_good(docs).collect()}
    assert sum((i in kept) != bad for i, _, bad in texts) >= 235
    out = quality.keep_good(awkward)
    assert out.columns == awkward.columns and {4, 5} & {x["doc_id"] for x in out.collect()} == set()
    assert quality.keep_good(no_docs).count() == 0


def test_restoring():
    counts = np.zeros(toxicity._A**3, np.int64)
    c = toxicity.codes(("the idiot is stupid and a moron was worthless to the clown " + prose(3, 300) + " ") * 30)
    np.add.at(counts, (c[:-2] * toxicity._A + c[1:-1]) * toxicity._A + c[2:], 1)
    restorer = toxicity.Restorer(toxicity.language_model(counts))
    for hidden, plain in [("1d10t", "idiot"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("idiiiiot", "idiot"), ("cl0wn", "clown"), ("$tupid", "stupid")]:
        assert restorer.restore(f"the {hidden} was") == f"the {plain} was"
        assert toxicity.suspicious([f"the {hidden} was"]).all()
    for plain in ("the&&& of*** was$$$ it%%%", "a b was", "The end. Of it!! (yes)", ""):
        assert not toxicity.suspicious([plain]).any() or restorer.restore(plain) == plain


@pytest.fixture(scope="module")
def restorer():
    counts = np.zeros(toxicity._A**3, np.int64)
    c = toxicity.codes(("the idiot is stupid and a moron was worthless to the clown as an ass or pass " + prose(3, 300) + " ") * 30)
    np.add.at(counts, (c[:-2] * toxicity._A + c[1:-1]) * toxicity._A + c[2:], 1)
    return toxicity.Restorer(toxicity.language_model(counts))


def test_restoring_of_combined_forms(restorer):
    apart = ["m 0 r 0 n", "i d 1 0 t", "1.d.1.0.t", "i/d/i/o/t", "i,d,i,o,t", "i  d  i  o  t", "i\td\ti\to\tt", "i\nd\ni\no\nt", "i - d - 1 - 0 - t", "i     d i o t", "i|d|i|o|t", "I D I O +", "(i d i o t)", '"m o r o n"', "a$$", "idio+", "id10+", "idi0t$$$"]
    for hidden in apart:
        plain = "moron" if "r" in hidden else "ass" if hidden == "a$$" else "idiot"
        assert plain in textcore_words(restorer.restore(f"the {hidden} was")), hidden
        assert toxicity.suspicious([hidden, "the end", f"the {hidden} was"]).tolist() == [True, False, True], hidden
    for plain in ("the idiot! was", "was$$$ it*** an!!!!", "it is a 5 was", "1 0 1 0 1 0", "Of it!! (yes)"):
        assert restorer.restore(plain) == plain
    long = "i d " * 50_000
    assert len(restorer.restore(long)) > 1000


def test_decoding_is_the_best_of_all_paths(restorer):
    """Viterbi against the sum of costs and log probabilities of every path of a token's lattice."""
    r = random.Random(6)

    def total(steps):
        s, a, b = 0.0, 0, 0
        for letters, cost in steps:
            s += cost
            for c in letters:
                k = int(toxicity._CODE[ord(c)]) if ord(c) < 0x250 else 0 if c in toxicity.LEET else toxicity._A - 1
                if k or b:
                    s += float(restorer.lm[a, b, k])
                    a, b = b, k
        return s

    tokens = ["1d10t", "m0r0n", "id1ooot", "a$$", "b0t!", "é1!", "i d i 0 t", "m.0.r.0.n", "1|1", "tttooo7"] + ["".join(r.choice("abilot01!$|e") for _ in range(r.randint(2, 7))) for _ in range(120)]
    for token in tokens:
        for spaced in (False, True):
            lattice = [*restorer._options(token, spaced), [(" ", 0.0)]]
            paths = {}
            for steps in itertools.product(*lattice):
                said = "".join(x for x, _ in steps).strip()
                paths[said] = max(paths.get(said, -1e9), total(steps))
            restorer.known.clear()
            got = restorer.decode(token, spaced)
            assert paths[got] >= max(paths.values()) - 1e-4, (token, spaced, got, max(paths, key=paths.get))


def test_noisy_or_shares_causes():
    """A cause that another explains gets little; one word alone suffices."""
    r = np.random.default_rng(1)
    x = (r.random((3000, 6)) < 0.05).astype(int)
    x[:, 4] = x[:, 0] & (r.random(3000) < 0.5) | (r.random(3000) < 0.02)  # comes along with 0
    x[:, 5] = 1
    y = ((x[:, 0] | x[:, 1]) & (r.random(3000) < 0.97) | (r.random(3000) < 0.01)).astype(float)
    rows, cols = np.nonzero(x)
    rate, constant = toxicity.fit_noisy_or(rows, cols, y, 6)
    alone = -np.expm1(-(rate + constant))
    assert alone[:2].min() > 0.9 and alone[2:].max() < 0.2 and constant < 0.1


def test_toxicity_query(spark, data_dir):
    data_dir = data_dir.replace("0.001", "0.01")  # the smallest table has too few toxic rows to learn from
    got = toxicity.op8_toxicity(spark, data_dir).collect()
    docs = [x["doc_id"] for x in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id").collect()]
    assert sorted(x["doc_id"] for x in got) == sorted(docs)
    for x in got:
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) and 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5)
    toxic = {x["doc_id"]: x["toxic"] for x in spark.read.parquet(f"{data_dir}/labels.parquet").collect()}
    known = [(x["predicted"], toxic[x["doc_id"]]) for x in got if x["doc_id"] in toxic]
    assert sum(a == b for a, b in known) > 0.95 * len(known)


def textcore_words(text):
    w = textcore.words([text])
    return [w.word(i).decode() for i in range(len(w.hashes))]


def test_the_gate_takes_all_that_the_decoder_does(restorer):
    assert toxicity.suspicious(['"s c u m"', "(s c u m)", "IdIIiot", "é1", "É1é", None, "the end"]).tolist() == [True] * 5 + [False] * 2
    r = random.Random(8)
    signs = list("aabAB iI  ..-_*!$@|+€01325()\n\tÉéßİΣΩ日\u00a0\u200b😀")
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 14))) for _ in range(40_000)]
    gate = toxicity.suspicious(texts)
    changed = np.array([restorer.restore(t) != t for t in texts])
    assert not (changed & ~gate).any(), [t for t, c, g in zip(texts, changed, gate, strict=True) if c and not g][:5]
    assert 0.02 < (~gate).mean()


def test_toxicity(spark, awkward, no_docs):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        w = prose(i, r.randint(5, 60)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "stupid"] if i % 10 else ["1diot", "m0ron", "s t u p i d"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int"))
    scored = {x["doc_id"]: x["_score"] for x in toxicity.score_documents(docs, marks).collect()}
    unseen = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scored[i] >= 0.5) != (i % 5 == 0) for i in unseen) <= 5
    out = toxicity.keep_clean(awkward, marks)
    assert out.columns == awkward.columns
    assert toxicity.keep_clean(no_docs, marks).count() == 0
    assert toxicity.keep_clean(docs, marks.limit(0)).count() == len(rows)


def test_decontamination_query(spark, write):
    base = words(prose(9, 400))
    items = [(1, " ".join(base[:30])), (10, " ".join(base[5:40])), (2, "tail words"), (None, " ".join(base[100:130])), (4, None), (5, "")]
    texts = [(1, " ".join(base[:50])), (1, " ".join(base[:50])), (None, "Tail WORDS tail"), (3, None), (4, ""), (5, "x " + " ".join(base[95:140])), (6, prose(3, 3000))]
    folder = write(documents=spark.createDataFrame(texts, "doc_id long, text string").withColumn("items", F.lit(0)), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = decontaminate.op5_decontamination(spark, folder)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    said = c.sql(registry.ORACLE_SQL["op5_decontamination"])
    assert got.columns == said.columns
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(said.fetchall(), key=str)
    assert rows == sorted(((d, *expected_hits(t, [(i or "x", s) for i, s in items])[:2], len(f := expected_hits(t, items)[2]), hashlib.sha256(",".join(sorted(f)).encode()).hexdigest(), expected_hits(t, [(i or "x", s) for i, s in items])[1] > 0) for d, t in texts), key=str)


def test_items_without_an_id_are_hit(spark):
    base = prose(9, 40)
    docs = spark.createDataFrame([(1, "x " + base + " y"), (2, prose(10, 40))], "doc_id long, text string")
    for items in ([(None, base)], [(None, base), (3, prose(11, 40))]):
        bench = spark.createDataFrame(items, "item_id long, text string")
        assert [x["doc_id"] for x in decontaminate.clean(docs, bench).collect()] == [2]
        assert [x["items"] for x in decontaminate.mark(docs, bench, unnamed=True).collect()] == [[], []]


@pytest.mark.parametrize("n", [2_900, 6_000, 60_000])
def test_repeated_passages_are_bad_at_any_length(n):
    junk = " ".join(prose(5, 10).split() * (n // 10))
    good = " ".join(f"w{int(abs(x))}" for x in np.random.default_rng(0).zipf(1.3, n) % 10**6)
    assert quality.votes(quality.statistics([junk, good], textcore.words([junk, good])))[:, 4].tolist()[0] == 0
    assert quality.votes(quality.statistics([good], textcore.words([good])))[0, 4] != 0


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_query_against_sql(spark, data_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    got, said = registry.QUERIES[name](spark, data_dir), c.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(said.columns)
    assert sorted(map(tuple, got.select(said.columns).collect()), key=str) == sorted(said.fetchall(), key=str)
