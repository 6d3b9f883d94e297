"""Toxicity scores of restored texts.

Channel. Toxic words hide as leetspeak (1d10t, a$$), by spacing with any signs or white space
(i d i o t, i/d/i/o/t), by both (1.d.1.0.t) or by repeated letters (idiiiiot). Each suspicious
token is a lattice: a position may stay as it is, stand for a letter it resembles, or be deleted.
Three or more equal signs at a word's end (was$$$) stay as they are. Viterbi decoding under a character trigram model of the whole
corpus picks the likeliest letters; the text with the decoded tokens is the restored text.

Scorer. Words and word starts of restored texts, hashed, are tested for association with toxicity on
a bounded sample of labelled rows (SAMPLE, the ids of least hash, one text each). The score is a
noisy or: each feature of the text, and a constant, makes it toxic on its own with some probability,
so that one toxic word suffices in a text of any length. The rates are fitted by maximum a posteriori,
in which features that others explain get little. Features are counted by Spark; the driver gets at
most FEATURES of them, and each sampled row's places among these.
Rows whose crc32(doc_id) mod 5 is 0 are held out. Only the text is an input of a score.

Nulls and empty texts have no words and get the constant's score. A null doc_id counts as ''.
Repeated rows are scored each for itself; several labels of a document are averaged, and of several
texts of one id the one of least hash is learned from. Without
labels the score is the prior 0.05. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import tables, textcore

#: Labelled rows that the scorer is fitted on, at most.
SAMPLE = 12_000
BUCKETS = 1 << 21
FEATURES = 3000
#: Least chi-square of a feature's association with the label; among two million buckets chance
#: alone hardly reaches it.
LEAST_STRENGTH = 45.0
#: A feature's rate is as if it had been the cause in CAUSES more rows and in CLEAN more clean ones.
CAUSES, CLEAN = 0.1, 0.3
#: Bytes of word starts that are features beside whole words.
STARTS = (4, 5, 6, 7, 8)

# Alphabet of the language model: 0 is everything between words, then a-z, then the letters of
# Latin-1 from U+00DF on, then any other letter.
_A = 1 + 26 + 33 + 1
_CODE = np.zeros(0x250, dtype=np.int64)
for _c in range(0x250):
    _low = chr(_c).lower()
    _o = ord(_low) if len(_low) == 1 else 0
    _CODE[_c] = _o - 96 if 97 <= _o <= 122 else _o - 0xDF + 27 if 0xDF <= _o <= 0xFF and _o != 0xF7 else _A - 1 if chr(_c).isalpha() else 0

# Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e"}
_SIGNS = "".join(LEET)
_MARKS = "".join(c for c in LEET if not c.isdigit())
_L = "[A-Za-zÀ-ʯⱥⱦ]"  # U+024F and below, and their lower case
_P = rf"(?:{_L}|[{re.escape(_SIGNS)}])"
_BETWEEN = rf"(?:(?:_|[^\w{re.escape(_MARKS)}])+|(?<={_L})[{re.escape(_MARKS)}](?={_L}))"
_SPACED = rf"(?<![^\W_])(?:{_P}{_BETWEEN}){{2,}}{_P}(?![^\W_])"
_SUSPECT = re.compile(
    rf"(?P<spaced>{_SPACED})"  # spaced letters or signs
    rf"|[{re.escape(_SIGNS)}]*{_L}[\w{re.escape(_SIGNS)}]*"  # a word, perhaps with signs in it
)
# Of words in lower case.
_HAS = re.compile(rf"[{re.escape(_SIGNS)}]{_L}|{_L}[0-9{re.escape(_MARKS)}]+(?!\w)|({_L})\1\1|{_L}_")
_ANY_LETTER = re.compile(_L)
_TAIL = re.compile(rf"([{re.escape(_MARKS)}])\1\1+\Z")

_KEEP, _LEET, _REPEAT = 0.0, -1.0, -0.5
# A gap between single letters joins them, unless the language model much prefers two words.
_DROP, _GAP_STAYS = 0.0, -3.0
_STAY = -7.0
# An exclamation mark at a word's end is one, unless the language model much prefers a letter.
_MARK_STAYS, _MARK_IS_LETTER = 0.0, -4.0
_GAP = [("", _DROP), (" ", _GAP_STAYS)]


def lm_counts(docs: DataFrame) -> DataFrame:
    """Trigram counts of characters over all texts: code, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_A**3, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in textcore.batches(texts):
                c = codes("\n".join(t or "" for t in texts[a:b]))
                if len(c) > 2:
                    total += np.bincount((c[:-2] * _A + c[1:-1]) * _A + c[2:], minlength=_A**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 0x250, _CODE[np.minimum(points, 0x24F)], _A - 1)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a character after two others; trigrams, bigrams and unigrams interpolated."""
    tri = counts.reshape(_A, _A, _A).astype(float)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + _A)
    p2 = (bi + 20 * p1) / (bi.sum(axis=1, keepdims=True) + 20)
    p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


class Restorer:
    """Viterbi decoding of suspicious tokens; decoded tokens are kept."""

    def __init__(self, lm: np.ndarray):
        self.lm = lm
        self.known: dict[str, str] = {}

    def _options(self, token: str, spaced: bool) -> list[list[tuple[str, float]]]:
        out: list[list[tuple[str, float]]] = []
        low = token.lower()
        body = len(low.rstrip("!"))
        i = 0
        while i < len(low):
            c = low[i]
            if i >= body and not spaced:
                out.append([(x, _MARK_IS_LETTER) for x in LEET[c]] + [(c, _MARK_STAYS)])
            elif c in LEET:
                out.append([(x, _LEET) for x in LEET[c]] + [(" " if c.isdigit() else c, _STAY)])
                if spaced and c in _MARKS and 0 < i < len(low) - 1 and _ANY_LETTER.match(low[i - 1]) and _ANY_LETTER.match(low[i + 1]):
                    out[-1] += [("", _DROP), (" ", _GAP_STAYS)]
            elif not c.isalnum():
                if not out or out[-1] is not _GAP:
                    out.append(_GAP)
            else:
                run = i
                while run < len(low) and low[run] == c:
                    run += 1
                if run - i > 2:
                    out.append([(c, _REPEAT), (c + c, _REPEAT)])
                    i = run - 1
                else:
                    out.append([(c, _KEEP)])
            i += 1
        return out

    def decode(self, token: str, spaced: bool = False) -> str:
        if token in self.known:
            return self.known[token]
        # Of each pair of last characters: score, and the letters so far as a chain of pairs.
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in [*self._options(token, spaced), [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (p2, p1), (score, chain) in best.items():
                for letters, cost in options:
                    s, a, b = score + cost, p2, p1
                    for c in letters:
                        o = ord(c)
                        k = int(_CODE[o]) if o < 0x250 else 0 if c in LEET else _A - 1
                        if k or b:  # several signs between words are one
                            s += float(self.lm[a, b, k])
                            a, b = b, k
                    if (a, b) not in new or s > new[a, b][0]:
                        new[a, b] = (s, (chain, letters))
            best = new
        chain = max(best.values(), key=lambda x: x[0])[1]
        parts = []
        while chain:
            chain, letters = chain
            parts.append(letters)
        out = "".join(reversed(parts)).strip()
        if len(self.known) < 200_000 and len(token) < 64:
            self.known[token] = out
        return out

    def _restored(self, m: re.Match) -> str:
        token = m[0]
        if m["spaced"] is not None:
            return self.decode(token, True) if _ANY_LETTER.search(token) else token
        tail = _TAIL.search(token)
        core = token[: tail.start()] if tail else token
        return self.decode(core) + token[len(core) :] if _HAS.search(core.lower()) else token

    def restore(self, text: str) -> str:
        """Decoded tokens take the place of suspicious ones; a spaced word follows what it stood for."""
        return _SUSPECT.sub(self._restored, text)


# Kinds of characters below _FAR; of others it isn't asked whether they separate.
_FAR = 0x2C70
_IS_LETTER, _IS_SIGN, _IS_DIGIT, _SEPARATES, _IS_WORD = 1, 2, 4, 8, 16
_KIND = np.full(_FAR + 1, _SEPARATES, np.uint8)
for _c in range(_FAR):
    _x = chr(_c)
    _KIND[_c] = (
        _IS_LETTER * bool(_ANY_LETTER.match(_x)) | _IS_SIGN * (_x in LEET) | _IS_DIGIT * ("0" <= _x <= "9") | _SEPARATES * (_x not in LEET and not _x.isalnum()) | _IS_WORD * _x.isalnum()
    )
_APART = "\u2c60"  # between texts; in lower case none holds it
_KIND[ord(_APART)] = 0


def suspicious(texts: list[str | None]) -> np.ndarray:
    """Whether a text holds a token that _SUSPECT and _HAS may take: a sign before a letter, a sign or
    digit after one, three equal letters, a letter before '_', or three single letters or signs apart."""
    parts = [(t or "").lower() for t in texts]
    d = np.frombuffer((_APART + _APART.join(parts) + _APART * 7).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _KIND[np.minimum(d, _FAR)]
    letter, sign = kind & _IS_LETTER != 0, kind & _IS_SIGN != 0
    flag = np.zeros(len(d), bool)
    flag[:-1] |= sign[:-1] & letter[1:]
    flag[:-1] |= letter[:-1] & ((kind[1:] & (_IS_SIGN | _IS_DIGIT) != 0) | (d[1:] == 95))
    flag[:-2] |= letter[:-2] & (d[:-2] == d[1:-1]) & (d[1:-1] == d[2:])
    gap = kind & _SEPARATES != 0
    at = np.flatnonzero(np.concatenate(([True], ~(gap[1:] & gap[:-1]))))  # the first of each run of separators
    k = kind[at]
    place, gap, free = k & (_IS_LETTER | _IS_SIGN) != 0, k & _SEPARATES != 0, k & _IS_WORD == 0
    flag[at[1:-5][free[:-6] & place[1:-5] & gap[2:-4] & place[3:-3] & gap[4:-2] & place[5:-1] & free[6:]]] = True
    ends = np.cumsum([len(p) + 1 for p in parts])
    sums = np.concatenate(([0], np.cumsum(flag)))
    return sums[ends + 1] - sums[np.concatenate(([1], ends[:-1] + 1))] > 0


def restored(texts: list[str | None], restorer: Restorer) -> list[str | None]:
    return [restorer.restore(t) if s else t for t, s in zip(texts, suspicious(texts).tolist(), strict=True)]


def features(texts: list[str | None], restorer: Restorer, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each distinct word, and each distinct start of a word, of each
    restored text; only of the buckets marked in `wanted`, if given."""
    w = textcore.words(restored(texts, restorer))
    owner = np.repeat(np.arange(len(w)), w.counts())
    pairs = []
    for n in (0, *STARTS):
        if n:
            longer = np.flatnonzero(w.last - w.first > n)
            hashes = textcore.byte_starts(w, w.first[longer], n) ^ np.uint64(n << 56 | n << 43)
            text = owner[longer]
        else:
            hashes, text = w.hashes, owner
        bucket = (hashes >> np.uint64(43)).astype(np.int64)
        if wanted is not None:
            some = wanted[bucket]
            bucket, text = bucket[some], text[some]
        pairs.append(text * BUCKETS + bucket)
    both = np.unique(np.concatenate(pairs))
    return both // BUCKETS, both % BUCKETS


def fit_noisy_or(rows: np.ndarray, cols: np.ndarray, target: np.ndarray, width: int, steps: int = 300) -> tuple[np.ndarray, float]:
    """Rates of the features and of the constant: a text is clean with probability exp(-(their sum)).
    `rows` and `cols` list the features that are present; targets from 0.5 on count as toxic."""
    clean = target < 0.5
    seen = np.bincount(cols[clean[rows]], minlength=width) + CLEAN
    rate, constant = np.full(width, 0.5), 0.02
    for _ in range(steps):
        total = np.bincount(rows, weights=rate[cols], minlength=len(target)) + constant
        pull = np.where(clean, 0, 1 / np.expm1(np.clip(total, 1e-9, 50)))
        # A damped step to where the posterior is flat in each rate.
        rate = np.sqrt(rate * (rate * np.bincount(cols, weights=pull[rows], minlength=width) + CAUSES) / seen)
        constant = max(1e-6, constant * np.sqrt(pull.sum() / (clean.sum() + 1)))
    return rate, float(constant)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The language model, and buckets, rates and the constant's rate of the scorer."""
    spark = docs.sparkSession
    counts = np.zeros(_A**3, dtype=np.int64)
    for r in lm_counts(docs).toLocalIterator():  # at most _A ** 3 rows
        counts[r["code"]] = r["n"]
    lm = language_model(counts)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held).groupBy("doc_id").agg(F.avg("toxic").alias("target"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    shared = spark.sparkContext.broadcast(lm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in textcore.batches(texts):
                row, bucket = features(texts[a:b], restorer)
                cut = np.searchsorted(row, np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("target").slice(a, b - a), lists], ["target", "buckets"])

    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("target").alias("target"))
    marked = texts.select("target", "text").mapInArrow(run, "target double, buckets array<int>")
    examples = tables.saved(marked.groupBy(F.xxhash64("buckets").alias("h")).agg(F.avg("target").alias("target"), F.first("buckets").alias("buckets")).drop("h"), "examples")  # copies are one
    total, rate = examples.agg(F.count(F.lit(1)), F.avg("target")).first()
    if not total:
        return lm, np.zeros(0, np.int64), np.zeros(0), float(-np.log(0.95))
    constant = float(-np.log1p(-min(max(rate, 0.01), 0.99)))
    if rate in (0, 1):
        return lm, np.zeros(0, np.int64), np.zeros(0), constant
    toxic = F.col("toxic") - F.col("n") * F.lit(rate)
    strength = toxic * toxic / (F.col("n") * F.lit(rate * (1 - rate)))
    each = examples.select(F.explode("buckets").alias("bucket"), "target").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("toxic"))
    best = each.filter("n >= 3").filter(toxic > 0).withColumn("strength", strength).filter(F.col("strength") >= LEAST_STRENGTH).orderBy(F.desc("strength"), "bucket").limit(FEATURES)
    chosen = np.sort(np.array([r["bucket"] for r in best.select("bucket").collect()], dtype=np.int64))
    if not len(chosen):
        return lm, chosen, np.zeros(0), constant
    kept = F.array(*(F.lit(int(c)) for c in chosen))
    rows = examples.select("target", F.array_intersect("buckets", kept).alias("own")).collect()  # at most SAMPLE
    own = [np.searchsorted(chosen, r["own"]) for r in rows]
    cols = np.concatenate(own).astype(np.int64)
    rates, constant = fit_noisy_or(np.repeat(np.arange(len(own)), [len(x) for x in own]), cols, np.array([r["target"] for r in rows]), len(chosen))
    return lm, chosen, rates, constant


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """All columns of docs, and `score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, chosen, w, b = shared.value
        restorer = Restorer(lm)
        weight = np.zeros(BUCKETS, np.float32)
        weight[chosen] = w
        wanted = np.zeros(BUCKETS, bool)
        wanted[chosen] = True
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, e in textcore.batches(texts):
                row, bucket = features(texts[a:e], restorer, wanted)
                total = np.bincount(row, weights=weight[bucket], minlength=e - a) + b
                own = batch.slice(a, e - a)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(-np.expm1(-total))], own.schema.names)

    out = docs.withColumn("_score", F.lit(0.0))
    return out.mapInArrow(run, out.schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of a score under 0.5."""
    return tables.unwrapped(score_documents(tables.wrapped(docs), labels).filter("_score < 0.5"), docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, tables.table(spark, sf_dir, "labels"))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    return scored.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
