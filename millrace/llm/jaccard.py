"""Similarity join of documents by the Jaccard similarity of their word n-gram sets.

1. Texts of equal word sequence, by 128 bits of hashes, form a class (copies); one stands for it.
2. Each class gets MinHash values, banded. Rows per band are as many as the hash budget allows,
   bands as many as the target recall at the threshold needs. Band hashes are shuffled; a bucket
   links its members to its least one, and components of these links are the candidate groups.
3. Pairs are verified on full n-gram sets in cells. A cell is a candidate group or, where chance
   hits chain many unlike texts so that this moves fewer rows, each of the group's buckets; a pair
   that shares several buckets counts in the first of them only. A cell is cut into blocks of about
   BLOCK texts and BLOCK_WORDS words, and pairs of blocks are dealt out, so no task holds more than
   two blocks and no pair leaves its task: it returns counts by text, and a spanning forest.
4. Components of the forests are the near-duplicate classes.

A cell of m different texts moves m * m / BLOCK rows; that is the price of exact link counts.
Copies cost nothing there. Hot classes are salted in joins, and all is combined before shuffles. Two
joins with hot keys, of buckets and of copies, are left to adaptive execution, which splits their
partitions: salting them would copy the other side, which is nearly as large.

Nulls and texts without words link to nothing; each is its own class. A text of fewer than `k`
words has one gram, all its words. Rows that repeat are copies of each other. Classes are of texts,
not of ids: null and repeated ids are allowed, and rows that share an id but no text are apart.
An empty table gives an empty result. All other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import tables, textcore
from millrace.llm.components import components, salted_join

K, THRESHOLD, RECALL = 5, 0.8, 0.9999
MOST_HASHES = 128
BLOCK, BLOCK_WORDS = 128, 2_000_000


def choose_bands(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands still find a pair at the threshold with the
    target recall, within `most` hashes."""
    best = (1, 1)
    for rows in range(1, 17):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _keyed(docs: DataFrame) -> DataFrame:
    """_tid: a hash of the text; _rid: the document's id, or another hash of its text where that is
    null. Rows equal in both are taken for the same document."""
    return docs.withColumns({"_rid": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", F.lit(1))), "_tid": F.xxhash64("text")})


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """rid, tid, doc_id, node and check (hashes of the word sequence;
    null without words), size (words), bands."""
    rng = np.random.default_rng(20240229)
    factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column("text").to_pylist()
            for a, b in textcore.batches(texts):
                w = textcore.words(texts[a:b])
                grams, offsets = textcore.ngrams(w, k)
                full = np.flatnonzero(np.diff(offsets))
                out = np.zeros((b - a, bands), np.uint64)
                if len(full):
                    starts = offsets[:-1][full]
                    for i in range(bands):
                        h = np.full(len(full), np.uint64(i + 1))
                        for j in range(i * rows, (i + 1) * rows):
                            least = np.minimum.reduceat(textcore.shuffle(grams, factors[j], terms[j]), starts)
                            h = textcore.mix(h ^ least)
                        out[full, i] = h
                none = np.ones(b - a, bool)
                none[full] = False
                node, check = (pa.array(textcore.text_hashes(w, h).view(np.int64), mask=none) for h in (w.hashes, w.others()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands), pa.int32()), pa.array(out.view(np.int64).ravel()))
                own = whole.slice(a, b - a)
                columns = [*(own.column(c) for c in ("_rid", "_tid", "doc_id")), node, check, pa.array(w.counts()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "tid", "doc_id", "node", "check", "size", "bands"])

    made = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return made.mapInArrow(run, "rid long, tid long, doc_id long, node long, check long, size long, bands array<long>")


def _apart(made: DataFrame) -> DataFrame:
    """Gives texts of equal `node` but another `check` a node of their own."""
    clash = tables.saved(made.filter("node is not null").groupBy("node").agg(F.min("check").alias("own"), F.max("check").alias("other")).filter("own <> other").select("node", "own"), "clash")
    if clash.isEmpty():
        return made
    return made.join(clash, "node", "left").withColumn("node", F.when(F.col("own") == F.col("check"), F.col("node")).otherwise(F.when(F.col("own").isNotNull(), F.xxhash64("node", "check")).otherwise(F.col("node")))).drop("own")


def gram_sets(texts: DataFrame, k: int) -> DataFrame:
    """Adds `grams`, the sorted distinct n-gram hashes as bytes, in place of `text`."""
    kept = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column("text").to_pylist()
            for a, b in textcore.batches(texts):
                grams, offsets = textcore.ngrams(textcore.words(texts[a:b]), k)
                sets = [np.unique(grams[i:j]).tobytes() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(whole.column(c).slice(a, b - a) for c in kept), pa.array(sets, pa.binary())], [*kept, "grams"])

    schema = texts.select(*kept).withColumn("grams", F.lit(b"")).schema
    return texts.mapInArrow(run, schema)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: grams of several sets as columns of 0/1 matrices."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    owner, column = owner[often], column[often]
    out = np.zeros((n, n))  # a product of `wide` columns is exact in 32 bits, their sum in 64
    if len(column):
        column = np.concatenate(([0], np.cumsum(column[1:] != column[:-1])))
        wide = 4096
        for begin in range(0, int(column[-1]) + 1, wide):
            a, b = np.searchsorted(column, [begin, begin + wide])
            x = np.zeros((n, wide), np.float32)
            x[owner[a:b], column[a:b] - begin] = 1
            out += x @ x.T
    return np.rint(out).astype(np.int64)


def _verify(threshold: float):
    def links(held: dict[int, tuple], cell: tuple) -> pa.RecordBatch | None:
        _, band, lo, hi = cell
        nodes = np.array(list(held), np.int64)
        copies, block, sets, bands = zip(*held.values(), strict=True)
        copies, block, sets = np.array(copies), np.array(block), [np.frombuffer(x, np.uint64) for x in sets]
        size = np.array([len(s) for s in sets])
        shared = intersections(sets)
        near = shared >= threshold * (size[:, None] + size - shared) - 1e-9
        np.fill_diagonal(near, False)
        if lo != hi:
            near &= block[:, None] != block
        if band >= 0:
            own = np.array(bands)
            for i in range(band):  # such a pair counts in an earlier bucket
                near &= own[:, None, i] != own[:, i]
        some = near.any(axis=1)
        if not some.any():
            return None
        label = nodes.copy()
        while True:
            least = np.minimum(label, np.where(near, label, np.iinfo(np.int64).max).min(axis=1))
            if (least == label).all():
                break
            label = least
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (nodes, near.sum(axis=1), near @ copies, label)], ["node", "texts", "docs", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for *cell, node, copies, block, grams, bands in zip(*(batch.column(c).to_pylist() for c in ("cell", "band", "lo", "hi", "node", "copies", "block", "grams", "bands")), strict=True):
                if cell != now:
                    if len(held) > 1 and (out := links(held, now)):
                        yield out
                    now, held = cell, {}
                held[node] = (copies, block, grams, bands)
        if len(held) > 1 and (out := links(held, now)):
            yield out

    return run


def _blocks(m: str, words: str):
    return F.greatest(F.ceil(F.col(m) / BLOCK), F.ceil(F.col(words) / BLOCK_WORDS), F.lit(1).cast("long"))


def cells(one: DataFrame) -> DataFrame:
    """The cells in which pairs are verified: cell, band (-1 for a whole group), node, blocks, bands
    (only for a bucket). `one`: node, size, bands."""
    every = one.select("node", "size", F.explode("bands").alias("h"))
    buckets = tables.saved(every.groupBy("h").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).filter("n > 1"), "buckets")
    found = components(every.drop("size").join(buckets.select("h", "least"), "h").select(F.col("node").alias("a"), F.col("least").alias("b")))
    roots = found.select("root").distinct().select(F.col("root").alias("node"), "root")
    member = tables.saved(found.unionByName(roots).join(one.select("node", "size"), "node"), "members")
    sums = member.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("words")).withColumn("blocks", _blocks("m", "words"))
    cost = buckets.withColumn("moved", F.col("n") * _blocks("n", "words")).join(member.select(F.col("node").alias("least"), "root"), "least").groupBy("root").agg(F.sum("moved").alias("moved"))
    # A group of one block is a cell at any rate, so only large ones are compared.
    chained = tables.saved(sums.filter("blocks > 1").join(cost, "root").filter(F.col("m") * F.col("blocks") > F.col("moved")).select("root", F.lit(True).alias("chained")), "chained")
    whole = salted_join(member, sums, "root", "node").select("node", "root", "blocks")
    none = F.lit(None).cast("array<long>")
    if chained.isEmpty():
        return whole.select(F.col("root").alias("cell"), F.lit(-1).alias("band"), "node", "blocks", none.alias("bands"))
    whole = whole.join(chained, "root", "left")
    dense = whole.filter("chained is null").select(F.col("root").alias("cell"), F.lit(-1).alias("band"), "node", "blocks", none.alias("bands"))
    sparse = whole.filter("chained").select("node").join(one.select("node", "bands"), "node")
    sparse = sparse.select("node", "bands", F.posexplode("bands").alias("band", "h"))
    parts = sparse.join(buckets, "h").select(F.col("h").alias("cell"), "band", "node", _blocks("n", "words").alias("blocks"), "bands")
    return dense.unionByName(parts)


def classes(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row per document: rid, tid, doc_id, wordless, copy_of (least id of the same text), root (its
    class; null without words), class_id (least id of its class), texts (links to different texts),
    links (to other documents). Classes of documents that share ids may share a class_id, never a
    root."""
    n = tables.partitions(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    made = _apart(tables.saved(sketches(docs, k, bands, rows), "sketches"))
    one = made.filter("node is not null").groupBy("node").agg(F.min(F.struct("rid", "tid")).alias("own"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    one = tables.saved(one.select("node", "own.rid", "own.tid", "copies", "size", "bands"), "classes")
    # A node has one cell, or as many as bands at most.
    own = cells(one).groupBy("node").agg(F.collect_list(F.struct("cell", "band", "blocks", "bands")).alias("cells"))
    wanted = one.select("node", "rid", "tid", "copies").join(own, "node")
    # Combined by key first, repeated rows come once, whatever their number.
    texts = _keyed(docs.select("doc_id", "text")).filter(F.col("text").rlike(textcore.WORDY)).groupBy(F.col("_rid").alias("rid"), F.col("_tid").alias("tid")).agg(F.first("text").alias("text"))
    sets = gram_sets(texts.join(wanted, ["rid", "tid"]).select("node", "copies", "cells", "text"), k)
    placed = sets.select("node", "copies", "grams", F.inline("cells")).withColumn("block", F.pmod(F.xxhash64("node", "cell"), F.col("blocks")))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("cell", "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "copies", "block", "grams", "bands")
    key = ["cell", "band", "lo", "hi"]
    found = tables.saved(pairs.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(_verify(threshold), "node long, texts long, docs long, least long"), "links")
    near = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    counts = found.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    whole = one.select("node", "rid", "copies").join(counts, "node", "left").join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = whole.groupBy("root").agg(F.min("rid").alias("class_id"))
    zero = F.lit(0).cast("long")
    whole = salted_join(whole, least, "root", "node").select("node", F.col("rid").alias("copy_of"), "root", "class_id", F.coalesce("texts", zero).alias("texts"), (F.coalesce("docs", zero) + F.col("copies") - 1).alias("links"))
    columns = ["rid", "tid", "doc_id", "wordless", "copy_of", "root", "class_id", "texts", "links"]
    worded = made.filter("node is not null").join(whole, "node").withColumn("wordless", F.lit(False)).select(*columns)
    bare = made.filter("node is null").withColumns({"wordless": F.lit(True), "copy_of": F.col("rid"), "root": F.lit(None).cast("long"), "class_id": F.col("rid"), "texts": zero, "links": zero}).select(*columns)
    return worded.unionByName(bare)


def keep_one(docs: DataFrame, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each near-duplicate class, the one of least id; texts without words stay."""
    made = classes(docs, k, threshold)
    first = made.filter("not wordless").groupBy("root").agg(F.min(F.struct("rid", "tid")).alias("f")).select(F.col("f.rid").alias("_rid"), F.col("f.tid").alias("_tid"))
    wordy = F.coalesce(F.col("text").rlike(textcore.WORDY), F.lit(False))
    keyed = _keyed(tables.wrapped(docs))
    kept = keyed.filter(wordy).dropDuplicates(["_rid", "_tid"]).join(first, ["_rid", "_tid"], "left_semi")
    return tables.unwrapped(kept.unionByName(keyed.filter(~wordy)), docs.columns)


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id", F.col("links").alias("n_links"), F.col("texts").alias("n_text_links"), "copy_of")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT w, min(doc_id) AS copy_of, count(*) AS copies FROM w WHERE len(w) > 0 GROUP BY w),
g AS (SELECT row_number() OVER () AS k, copy_of, copies, w, list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM t),
u AS (SELECT k, unnest(g) AS s FROM g),
p AS (SELECT a.k AS x, b.k AS y, count(*) AS n FROM u AS a JOIN u AS b ON a.s = b.s AND a.k < b.k GROUP BY ALL),
near AS (SELECT x, y FROM p JOIN g AS a ON a.k = x JOIN g AS b ON b.k = y WHERE n >= 0.8 * (len(a.g) + len(b.g) - n) - 1e-9),
e AS (SELECT x AS a, y AS b FROM near UNION ALL SELECT y, x FROM near),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
classes AS (SELECT a AS k, min(copy_of) AS class_id FROM reach JOIN g ON g.k = b GROUP BY a),
links AS (SELECT e.a AS k, count(*) AS texts, sum(copies) AS docs FROM e JOIN g ON g.k = e.b GROUP BY e.a)
SELECT doc_id, coalesce(class_id, copy_of, doc_id) AS class_id, CAST(coalesce(docs, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links, coalesce(texts, 0) AS n_text_links, coalesce(copy_of, doc_id) AS copy_of
FROM w LEFT JOIN g ON g.w = w.w AND len(w.w) > 0 LEFT JOIN classes USING (k) LEFT JOIN links USING (k)
"""
