"""Benchmark passages in documents, found by winnowing.

A window is `window` consecutive words of a benchmark item; an item of fewer words, but not
none, is one window of all its words. Of every window of words, the least hash of its `k`-grams
is its fingerprint; document and item agree on it, so that every shared window shares one, and
one lookup per change of the fingerprint finds all candidates. Hits are then extended: the whole
window must equal an item's window, and overlapping windows join to spans of words.

A benchmark of at most MOST_WINDOWS windows, which is counted first, is broadcast, and documents
look its fingerprints up. A larger one is joined: a bitmap of fixed size of all fingerprints lets
through the few runs of document windows that may match, these are joined with the benchmark's
fingerprints and then with its windows, both shuffled and salted, and hits go back to the documents
by two hashes of their text. Nothing there grows with the benchmark in any one task or the driver.

Nulls and texts without words hit nothing. Items without words are no windows. Windows of items
without an id count in the operator and in clean(), but add no id to `items`; mark() takes them
only with `unnamed`.
Repeated documents are judged each for itself, repeated items count once. Empty tables give
empty or clean results. Further columns of the documents are kept by clean().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import tables, textcore
from millrace.llm.components import salted_join

WINDOW = 10
K = 6
#: Benchmark windows that are broadcast at most; about 100 bytes each.
MOST_WINDOWS = 2_000_000
#: Bits of the bitmap of fingerprints, as a power of two.
GATE_BITS = 26
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
SPANS_TYPE = "array<struct<first:long,after:long>>"


class Index:
    """Windows of some benchmark items: fingerprints, window hashes and the items of each."""

    def __init__(self, item_ids: list, texts: list[str | None], window: int = WINDOW, k: int = K, unnamed: bool = False):
        self.window, self.k = window, k
        ids = sorted({i for i in item_ids if i is not None})
        number = {x: n for n, x in enumerate(ids)}
        self.item_ids = ids
        code = np.array([number.get(i, -1) for i in item_ids], dtype=np.int64)
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, own, prints, full in item_windows(texts, window, k, None if unnamed else code >= 0):
            pairs = np.unique(np.stack([full.view(np.int64), code[own]], axis=1), axis=0)
            order = np.argsort(pairs[:, 0].view(np.uint64), kind="stable")
            hashes, first = np.unique(pairs[order, 0].view(np.uint64), return_index=True)
            self.sizes[n] = (np.unique(prints), hashes, np.concatenate((first, [len(pairs)])), pairs[order, 1])

    def find(self, texts: list[str | None]) -> tuple[textcore.Words, np.ndarray, list[list[int]]]:
        """Words of the texts, whether each word is hit, and the numbers of the items of each text."""
        w = textcore.words(texts)
        n_words = len(w.hashes)
        change = np.zeros(n_words + 1, dtype=np.int32)
        found = []
        owner = None
        for n, (prints, hashes, first, items) in self.sizes.items():
            grams = np.maximum(w.counts() - n + 1, 0)
            if not grams.sum():
                continue
            at = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams - w.offsets[:-1], grams)
            if n == self.window:
                p = window_prints(w, at, n, self.k)
                new = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
                hit = np.repeat(_member(p[new], prints), np.diff(np.concatenate((new, [len(p)]))))
            else:
                hit = _member(textcore.span_hashes(w.hashes, at, n), prints)
            at = at[hit]
            full = textcore.span_hashes(w.hashes, at, n)
            where = np.minimum(np.searchsorted(hashes, full), len(hashes) - 1)
            same = hashes[where] == full
            at, where = at[same], where[same]
            if not len(at):
                continue
            np.add.at(change, at, 1)
            np.add.at(change, at + n, -1)
            if owner is None:
                owner = np.repeat(np.arange(len(w)), w.counts())
            # One row per text and window, then its items: a passage that repeats counts once.
            both = np.unique(owner[at] * len(hashes) + where)
            text, where = both // len(hashes), both % len(hashes)
            many = first[where + 1] - first[where]
            each = np.repeat(first[where], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            text, item = np.repeat(text, many), items[each]
            found.append(np.unique((text * len(self.item_ids) + item)[item >= 0]))
        out: list[list[int]] = [[] for _ in texts]
        if found:
            for x in np.unique(np.concatenate(found)).tolist():
                out[x // len(self.item_ids)].append(x % len(self.item_ids))
        return w, np.cumsum(change[:-1]) > 0, out


def item_windows(texts: list[str | None], window: int, k: int, some: np.ndarray | None = None) -> Iterator[tuple]:
    """By length n of windows: n, and of each window its text's number, fingerprint and hash."""
    w = textcore.words(texts)
    counts = w.counts() if some is None else np.where(some, w.counts(), 0)
    for n in sorted({min(int(c), window) for c in counts} - {0}):
        own = np.flatnonzero(counts >= window) if n == window else np.flatnonzero(counts == n)
        grams = counts[own] - n + 1
        at = np.repeat(w.offsets[own], grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
        full = textcore.span_hashes(w.hashes, at, n)
        yield n, np.repeat(own, grams), window_prints(w, at, n, k) if n == window else full, full


def window_prints(w: textcore.Words, at: np.ndarray, n: int, k: int) -> np.ndarray:
    """The least k-gram hash of the n words from each of `at` on."""
    if not len(at):
        return np.zeros(0, np.uint64)
    grams = textcore.every_span(w.hashes, k)
    least = grams
    for i in range(1, n - k + 1):
        least = np.minimum(least[: len(grams) - i], grams[i:])
    return least[at]


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    bits = 24 if len(among) > 50_000 else 20
    seen = np.zeros(1 << bits, bool)
    seen[among >> np.uint64(64 - bits)] = True
    out = seen[values >> np.uint64(64 - bits)]
    maybe = values[out]
    out[out] = among[np.minimum(np.searchsorted(among, maybe), len(among) - 1)] == maybe
    return out


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS, keep_text: bool = True, unnamed: bool = False) -> DataFrame:
    """Documents with n_words, hit_spans (first word and word after the last) and items (ids of the
    items with a window in the text). All columns of `docs` stay as they are, but for any of these
    names; without `keep_text` the text comes back null, which saves its way back from Python."""
    docs = docs.drop("n_words", "hit_spans", "items")
    words_most = benchmark.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    if words_most > most_windows:
        return _by_join(docs, benchmark, window, unnamed)
    rows = benchmark.select("item_id", "text").collect()  # within most_windows
    index = docs.sparkSession.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], window, unnamed=unnamed))
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.lit(None).cast(SPANS_TYPE), "items": F.lit(None).cast("array<string>")})
    return out.mapInArrow(_marker(index, keep_text), out.schema)


def _marker(shared, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for whole in batches:
            texts = whole.column("text").to_pylist()
            for a, b in textcore.batches(texts):
                batch = whole.slice(a, b - a)
                w, hit, items = index.find(texts[a:b])
                names = [sorted(str(index.item_ids[i]) for i in x) for x in items]
                own = {"n_words": pa.array(w.counts()), "hit_spans": pa.array([[{"first": i, "after": j} for i, j in x] for x in _by_text(w, hit)], SPANS), "items": pa.array(names, pa.list_(pa.string()))}
                if not keep_text:
                    own["text"] = pa.nulls(b - a, pa.string())
                yield pa.RecordBatch.from_arrays([own.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], batch.schema.names)

    return run


def _tagged(prints: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints apart by the length of their windows."""
    return textcore.mix(prints ^ np.uint64(n << 56))


def _by_join(docs: DataFrame, benchmark: DataFrame, window: int, unnamed: bool, k: int = K) -> DataFrame:
    spark = docs.sparkSession

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column("text").to_pylist()
            for a, b in textcore.batches(texts):
                ids = whole.column("item").slice(a, b - a)
                for n, own, prints, full in item_windows(texts[a:b], window, k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), n)), pa.array(_tagged(prints, n).view(np.int64)), pa.array(_tagged(full, n).view(np.int64)), ids.take(pa.array(own))], ["n", "print", "full", "item"])

    wanted = benchmark if unnamed else benchmark.filter("item_id is not null")
    items = tables.saved(wanted.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(windows, "n long, print long, full long, item string").distinct(), "windows")
    sizes = [r["n"] for r in items.select("n").distinct().collect()]  # at most `window` rows
    place = F.shiftrightunsigned("print", 64 - GATE_BITS)
    bits = items.groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(print, %d) & 63 as int))" % (64 - GATE_BITS))).alias("bits"))
    gate = np.zeros(1 << GATE_BITS - 6, np.uint64)
    for r in bits.toLocalIterator():  # at most 2 ** (GATE_BITS - 6) rows
        gate[r["cell"]] = np.uint64(r["bits"] & (1 << 64) - 1)
    shared = spark.sparkContext.broadcast(gate)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = shared.value
        for whole in batches:
            texts = whole.column("text").to_pylist()
            for a, b in textcore.batches(texts):
                w = textcore.words(texts[a:b])
                keys = [whole.column(c).slice(a, b - a) for c in ("_k1", "_k2")]
                for n in sizes:
                    grams = np.maximum(w.counts() - n + 1, 0)
                    if not grams.sum():
                        continue
                    own = np.repeat(np.arange(b - a), grams)
                    at = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams - w.offsets[:-1], grams)
                    p = _tagged(window_prints(w, at, n, k) if n == window else textcore.span_hashes(w.hashes, at, n), n)
                    place = p >> np.uint64(64 - GATE_BITS)
                    may = gate[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) == 1
                    own, at, p = own[may], at[may], p[may]
                    full = _tagged(textcore.span_hashes(w.hashes, at, n), n)
                    text = pa.array(own)
                    columns = [*(c.take(text) for c in keys), pa.array(p.view(np.int64)), pa.array(full.view(np.int64)), pa.array(at - w.offsets[own]), pa.array(np.full(len(at), n))]
                    yield pa.RecordBatch.from_arrays(columns, ["_k1", "_k2", "print", "full", "at", "n"])

    key = ["_k1", "_k2"]
    keyed = docs.withColumns({"_k1": F.xxhash64("text"), "_k2": F.xxhash64("text", F.lit(1))})
    found = keyed.select(*key, "text").filter("text is not null").mapInArrow(runs, "_k1 long, _k2 long, print long, full long, at long, n long")
    maybe = salted_join(found, items.select("print").distinct(), "print", "_k1")
    hits = tables.saved(salted_join(maybe.select(*key, "full", "at", "n"), items.select("full").distinct(), "full", "_k1").distinct(), "hits")
    # Windows that overlap or touch join to spans.
    before = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ends = hits.groupBy(*key, "at").agg(F.max(F.col("at") + F.col("n")).alias("after"))
    opened = ends.withColumn("new", (F.col("at") > F.coalesce(F.max("after").over(before), F.lit(-1))).cast("int"))
    numbered = opened.withColumn("span", F.sum("new").over(Window.partitionBy(*key).orderBy("at")))
    spans = numbered.groupBy(*key, "span").agg(F.min("at").alias("first"), F.max("after").alias("after"))
    spans = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first", "after"))).alias("hit_spans"))
    named = items.filter("item is not null").select("full", "item").distinct()
    own = hits.select(*key, "full").distinct().join(named, "full").select(*key, "item").distinct()
    marks = spans.join(own.groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items")), key, "left")
    n_words = F.coalesce(F.regexp_count("text", F.lit(textcore.WORD)).cast("long"), F.lit(0).cast("long"))
    out = keyed.withColumn("n_words", n_words).join(marks, key, "left")
    return out.select(*docs.columns, "n_words", F.coalesce("hit_spans", F.array().cast(SPANS_TYPE)).alias("hit_spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _by_text(w: textcore.Words, hit: np.ndarray) -> list[list[tuple[int, int]]]:
    """Spans of hit words, counted from each text's first word."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(w))]
    if not hit.any():
        return out
    start = np.zeros(len(hit), bool)
    own = w.offsets[:-1][w.counts() > 0]
    start[own] = True
    first = np.flatnonzero(hit & (np.concatenate(([True], ~hit[:-1])) | start))
    ends = np.concatenate((~hit[1:] | start[1:], [True]))
    last = np.flatnonzero(hit & ends) + 1
    text = np.searchsorted(w.offsets, first, side="right") - 1
    for t, a, b in zip(text.tolist(), (first - w.offsets[text]).tolist(), (last - w.offsets[text]).tolist(), strict=True):
        out[t].append((a, b))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without any benchmark window, with their own columns."""
    marked = mark(tables.wrapped(docs), benchmark, window, unnamed=True)
    return tables.unwrapped(marked.filter(F.size("hit_spans") == 0), docs.columns)


def digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark(docs, tables.table(spark, sf_dir, "benchmark"), keep_text=False, unnamed=True)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda t, s: t + s["after"] - s["first"])
    return marked.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), h AS (SELECT r, dw.n, k, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
x AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
y AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN x USING (r) LEFT JOIN y USING (r)
"""
