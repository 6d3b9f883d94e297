"""Quality scores from weak labels.

1. Heuristic labellers vote on each text: 1 good, 0 bad, -1 no vote. They overlap, and none is
   always right.
2. Expectation-maximisation over all documents' votes estimates each labeller's accuracy on good
   documents and on the kinds of bad ones, and the shares of these. It needs only how often each combination of
   votes occurs, which is one aggregation; combinations are as many as the labellers allow, not
   as the documents.
3. The posterior of a document is its soft label. A linear scorer on hashed features (character
   class trigrams and binned statistics) is fitted to the soft labels of a bounded sample (SAMPLE,
   the different texts of least hash) and scores every text.

Lengths are counted in characters. Labellers that know Latin script only, those of word length and
of frequent words, cast no bad vote on texts of which more than FOREIGN is in another script, and the
scorer leaves such letters and these two statistics out.

Nulls and texts without words are bad (score 0). Repeated rows are scored each for itself. An
empty table gives an empty result. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import linear, tables, textcore

#: Documents that the scorer is fitted on, at most.
SAMPLE = 8_000
WIDTH = 1 << 12
#: Bytes whose features are counted at once.
_CHUNK = 1 << 21
#: A labeller calls at most this share of good documents bad, and at least that of its own class. Votes
#: alone don't tell a kind of bad document that one labeller sees from that labeller's errors; this does.
MOST_WRONG, LEAST_RIGHT = 0.05, 0.5
#: Share of letters beyond Latin script from which a text is in another script.
FOREIGN = 0.3

# Character classes by first byte in UTF-8: 0 other, 1 lower case and Latin beyond ASCII, 2 upper case,
# 3 digit, 4 space, 5 line break, then one for each ASCII sign, then characters from U+0280 on.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 32]] = 4
_CLASS[[10, 13]] = 5
for _i, _c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[ord(_c)] = 6 + _i
_OTHER_SCRIPT = 6 + 32
_CLASS[0xCA:] = _OTHER_SCRIPT
_N = 6 + 32 + 1
_BUCKET = (textcore.mix(np.arange(_N**3, dtype=np.uint64)) % np.uint64(WIDTH)).astype(np.int32)
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "#$%&*|<>{}[]\\^~=+@_"]] = True

STATISTICS = ["words", "mean_length", "upper", "marks", "shouts", "digits", "repeats", "distinct", "most_common", "stops", "breaks", "foreign"]
#: Statistics that say nothing about other scripts.
_LATIN_ONLY = [STATISTICS.index(x) - 1 for x in ("mean_length", "stops")]

# Frequent function words of English, German, French, Spanish, Italian, Portuguese, Dutch,
# Polish, Swedish, Danish, Finnish, Turkish, Romanian, Czech and Indonesian.
STOPS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one der die und das ist nicht von zu mit sich des auf für im ein eine den le la les des et un une du en que qui dans est pour sur pas par el los las del y una por con para su al lo como che non una per sono della gli anche nel não uma com mais das dos pela het een van niet zijn voor maar ook się nie jest jak ale przez och att det som inte har med til ikke jeg vil ja on että mutta oli kun niin bir ve bu için ile gibi daha ama și pentru este sunt din care že jsem ale nebo při jako yang dan dengan untuk tidak dari pada ini itu".split()
_STOP_HASHES = np.unique(textcore.words(STOPS).hashes)


def statistics(texts: list[str | None], w: textcore.Words) -> np.ndarray:
    """A row of STATISTICS per text."""
    n = len(texts)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw])
    d = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)
    kind = _CLASS[d]
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(flags)
        return (np.searchsorted(at, ends) - np.searchsorted(at, begins)).astype(float)

    counts = w.counts()
    some = np.maximum(counts, 1)
    starts = d & 0xC0 != 0x80  # the first byte of a character
    chars = per_text(starts)
    letters = np.maximum(per_text(starts & ((kind == 1) | (kind == 2))), 1)
    in_words = per_text(starts & textcore.is_word(w.data))
    length = in_words / some
    foreign = per_text(d >= 0xCA) / np.maximum(in_words, 1)
    same = np.concatenate(([0], np.cumsum(np.concatenate(([False], w.hashes[1:] == w.hashes[:-1]))))) if len(w.hashes) else np.zeros(1)
    inner = np.maximum(w.offsets[1:] - w.offsets[:-1], 1)
    repeats = (same[w.offsets[1:]] - same[np.minimum(w.offsets[:-1] + 1, w.offsets[1:])]) / inner
    owner = np.repeat(np.arange(n), counts)
    # Words apart by text: one sort of mixed hashes, in which equal words of a text are neighbours.
    code = textcore.mix(w.hashes ^ textcore.mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(code)
    h, o = code[order], owner[order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    distinct = np.bincount(o[new], minlength=n) / some
    first = np.flatnonzero(new)
    runs = np.diff(np.concatenate((first, [len(h)])))
    most = np.zeros(n)
    np.maximum.at(most, o[first], runs)
    where = np.minimum(np.searchsorted(_STOP_HASHES, w.hashes), len(_STOP_HASHES) - 1)
    stops = np.bincount(owner, weights=_STOP_HASHES[where] == w.hashes, minlength=n) / some
    return np.stack(
        [counts, length, per_text(kind == 2) / letters, per_text(_MARKS[d]) / some, per_text(d == 33) / some, per_text(kind == 3) / np.maximum(chars, 1), repeats, distinct, most / some, stops, per_text(d == 10) / some, foreign],
        axis=1,
    )


def votes(s: np.ndarray) -> np.ndarray:
    """Votes of the labellers on rows of STATISTICS."""
    x = {name: s[:, i] for i, name in enumerate(STATISTICS)}
    some = x["words"] >= 20
    latin = x["foreign"] <= FOREIGN
    # Distinct words grow at least as the root of a text's length.
    few = 0.15 * np.sqrt(3000 / np.maximum(x["words"], 3000))

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 1, -1))

    return np.stack(
        [
            vote(x["marks"] > 0.5, x["marks"] < 0.05),
            vote(x["upper"] > 0.5, x["upper"] < 0.2),
            vote(x["shouts"] > 0.3, x["shouts"] < 0.05),
            vote(x["repeats"] > 0.2, x["repeats"] < 0.05),
            vote(some & (x["distinct"] < few), some & (x["distinct"] > 0.35)),
            vote(some & (x["most_common"] > 0.25), some & (x["most_common"] < 0.15)),
            vote(some & latin & (x["stops"] < 0.03), x["stops"] > 0.1),
            vote(latin & ((x["mean_length"] > 12) | (x["mean_length"] < 2)), (x["mean_length"] > 3) & (x["mean_length"] < 9)),
            vote(x["digits"] > 0.3, x["digits"] < 0.1),
        ],
        axis=1,
    )


def hashed(texts: list[str | None], w: textcore.Words, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and value of the scorer's features."""
    n = len(texts)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    d = np.frombuffer(b"\n".join(raw) + b"\n\n\n", dtype=np.uint8)
    starts = d & 0xC0 != 0x80
    ends = np.cumsum([len(r) + 1 for r in raw])
    sizes = np.array([np.count_nonzero(starts[a:b]) for a, b in zip((ends - [len(r) + 1 for r in raw]).tolist(), ends.tolist(), strict=True)])
    c = _CLASS[d][starts]
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    many = np.zeros(n * WIDTH, np.int64)
    for a in range(0, len(owner), _CHUNK):
        own = owner[a : a + _CHUNK]
        x = c[a : a + len(own) + 2].astype(np.int32)
        known = x != _OTHER_SCRIPT
        known = known[:-2] & known[1:-1] & known[2:]
        bucket = _BUCKET[(x[:-2] * _N + x[1:-1]) * _N + x[2:]]
        many += np.bincount((own * WIDTH + bucket)[known], minlength=n * WIDTH)
    at = np.flatnonzero(many)
    row, col = at // WIDTH, at % WIDTH
    value = np.sqrt(many[at] / sizes[row])
    bins = np.minimum((np.sqrt(np.clip(s[:, 1:-1], 0, 16)) * 8).astype(np.int64), 31)
    kind = np.arange(bins.shape[1]) * 32 + bins
    own = (textcore.mix(kind.ravel().astype(np.uint64) + np.uint64(1 << 40)) % np.uint64(WIDTH)).astype(np.int64)
    weight = np.full(bins.shape, 0.5)
    weight[np.ix_(s[:, -1] > FOREIGN, _LATIN_ONLY)] = 0
    return np.concatenate((row, np.repeat(np.arange(n), bins.shape[1]))), np.concatenate((col, own)), np.concatenate((value, weight.ravel()))


def vote_counts(docs: DataFrame) -> DataFrame:
    """How often each combination of votes occurs: pattern, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in textcore.batches(texts, rows=1024):
                w = textcore.words(texts[a:b])
                v = votes(statistics(texts[a:b], w))[w.counts() > 0]
                code, n = np.unique(_pattern(v), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["pattern", "n"])

    return docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def _pattern(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def _unpattern(p: np.ndarray, labellers: int) -> np.ndarray:
    return p[:, None] // 3 ** np.arange(labellers) % 3 - 1


def expectation_maximisation(v: np.ndarray, n: np.ndarray, rounds: int = 100) -> dict[str, np.ndarray]:
    """A latent class of good documents and one of bad documents for each labeller, since texts are
    bad in different ways: the share of bad votes among the votes of every labeller in every class,
    and the classes' shares, from vote rows and how often each occurs. No vote says nothing. A
    labeller is seldom wrong about good documents and mostly right about its own class, within
    MOST_WRONG and LEAST_RIGHT; all else is estimated.

    accuracy: the estimated share of right votes of each labeller."""
    m = v.shape[1]
    yes, no = (v == 1).astype(float), (v == 0).astype(float)
    own = (np.arange(1, m + 1), np.arange(m))
    bad = np.full((m + 1, m), 0.1)
    bad[0], bad[own] = 0.005, 0.9
    share = np.array([0.85] + [0.15 / m] * m)
    for _ in range(rounds):
        p = _posteriors(yes, no, bad, share) * n[:, None]
        bad = (p.T @ no + 0.05) / (p.T @ (yes + no) + 1)
        bad[0] = np.minimum(bad[0], MOST_WRONG)
        bad[own] = np.maximum(bad[own], LEAST_RIGHT)
        bad = np.clip(bad, 1e-4, 1 - 1e-4)
        share = (p.sum(axis=0) + 0.5) / (n.sum() + 0.5 * (m + 1))
    cast = p.T @ (yes + no)
    right = cast[0] * (1 - bad[0]) + (cast[1:] * bad[1:]).sum(axis=0)
    return {"bad": bad, "share": share, "accuracy": right / np.maximum(cast.sum(axis=0), 1e-9)}


def _posteriors(yes: np.ndarray, no: np.ndarray, bad: np.ndarray, share: np.ndarray) -> np.ndarray:
    z = yes @ np.log(1 - bad).T + no @ np.log(bad).T + np.log(share)
    z -= z.max(axis=1, keepdims=True)
    return np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)


def posterior(v: np.ndarray, model: dict) -> np.ndarray:
    """Probability that a document is good, given its votes."""
    return _posteriors((v == 1).astype(float), (v == 0).astype(float), model["bad"], model["share"])[:, 0]


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, dict]:
    """Weights and bias of the scorer, and the labellers' model."""
    rows = vote_counts(docs).collect()  # a row per combination of votes
    n = np.array([r["n"] for r in rows], dtype=float)
    v = _unpattern(np.array([r["pattern"] for r in rows], dtype=np.int64), votes(np.zeros((1, len(STATISTICS)))).shape[1])
    model = expectation_maximisation(v, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in textcore.batches(texts, rows=1024):
                w = textcore.words(texts[a:b])
                s = statistics(texts[a:b], w)
                row, col, value = hashed(texts[a:b], w, s)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(b - a + 1))
                cells = [(col[order[i:j]].astype("<u4").tobytes(), value[order[i:j]].astype("<f4").tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(posterior(votes(s), model)), *(pa.array(x, pa.binary()) for x in zip(*cells, strict=True))], ["target", "cols", "vals"])

    some = docs.select("text").filter(F.col("text").rlike(textcore.WORDY)).withColumn("_h", F.xxhash64("text"))
    total = int(n.sum())
    if total > sample:
        # A hash below this keeps the sample's share of the rows, so no sort of texts is needed.
        bound = int(-(2**63) + 2**64 * min(1.0, 1.2 * sample / total))
        some = some.filter(F.col("_h") <= F.lit(min(bound, 2**63 - 1)))
    texts = some.groupBy("_h").agg(F.first("text").alias("text"))  # copies are one example
    kept = texts.select("text").mapInArrow(run, "target double, cols binary, vals binary").limit(2 * sample).collect()  # the bound gives fewer
    if not kept:
        return np.zeros(WIDTH), 0.0, model
    cols = [np.frombuffer(r["cols"], "<u4") for r in kept]
    row = np.repeat(np.arange(len(kept)), [len(c) for c in cols])
    w, b = linear.fit_logistic(row, np.concatenate(cols).astype(np.int64), np.concatenate([np.frombuffer(r["vals"], "<f4") for r in kept]).astype(float), np.array([r["target"] for r in kept]), WIDTH, l2=1e-5, steps=200)
    return w, b, model


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """All columns of docs, `_score` of the scorer and `_weak`, the posterior of the votes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, labellers = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, e in textcore.batches(texts, rows=1024):
                w = textcore.words(texts[a:e])
                s = statistics(texts[a:e], w)
                row, col, value = hashed(texts[a:e], w, s)
                z = np.bincount(row, weights=value * weight[col], minlength=e - a) + bias
                some = w.counts() > 0
                own = batch.slice(a, e - a)
                yield pa.RecordBatch.from_arrays([*own.columns[:-2], pa.array(np.where(some, linear.sigmoid(z), 0.0)), pa.array(np.where(some, posterior(votes(s), labellers), 0.0))], own.schema.names)

    out = docs.withColumns({"_score": F.lit(0.0), "_weak": F.lit(0.0)})
    return out.mapInArrow(run, out.schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents of a score of 0.5 or more."""
    return tables.unwrapped(score(tables.wrapped(docs), train(docs)).filter("_score >= 0.5"), docs.columns)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs))
    return scored.select("doc_id", F.col("_score").alias("score"), (F.col("_score") >= 0.5).alias("keep"), F.col("_weak").alias("weak_label"))
