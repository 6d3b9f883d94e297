"""Best-fit packing of token documents into fixed-length sequences, with certified bin counts.

Documents longer than a sequence are cut so that every piece but the first fills a sequence;
what is left, one piece shorter than a sequence per document, is packed by best-fit decreasing
in groups of bounded size. Dual-feasible functions give the whole, and each group, a lower bound on
its bins. Full bins are done. When the bins of all groups together meet the bound of the whole,
that certifies the result. Otherwise the bins with gaps go, whole, to the next round, where fewer
and larger mixes of such bins are packed anew; a group that would need more bins than it got keeps
them as they were, and one that is certified by other than the sum of its lengths is done. Rounds
end with the certificate, or when a round saves no bin, with several groups not before
LEAST_ROUNDS, or after MOST_ROUNDS; the result then stays uncertified.

Pieces are dealt by their place in the table, so equal or null ids are spread like any others.

Nulls: a null text is an empty document, of the end id alone. Repeated rows are packed each for
itself. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import encoding, tables, textcore

SEQUENCE = 2048
#: Pieces that one task packs at once; also bounds the driver-free final round.
GROUP = 60_000
LEAST_ROUNDS = 5
#: A sequence's id has six bits for the round.
MOST_ROUNDS = 63
_ROUND_SHIFT, _GROUP_SHIFT = 57, 32


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = SEQUENCE, payload: Callable[[bytes], object] | None = None, payload_type: str = "binary") -> DataFrame:
    """Token pieces of documents (doc_id, text): doc_id, piece, start, length, payload, and a
    sequence_id of its own for each piece that fills a sequence.

    `payload` turns a piece's ids, as little-endian unsigned 32-bit bytes, into what is kept of
    them; by default the bytes themselves."""
    keep = payload or bytes
    arrow = pa.int64() if payload_type in ("long", "bigint") else pa.binary()
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(vocabulary)
        task = TaskContext.get()
        full = (task.partitionId() if task else 0) << 36  # round 0 of the numbering
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in textcore.batches(texts, 3_000_000):
                rows = []
                for doc_id, ids in zip(doc_ids[a:b], enc.encode(texts[a:b]), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    begin, piece = 0, 0
                    end = n % capacity or min(n, capacity)
                    while begin < n:
                        filled = end - begin == capacity
                        full += filled
                        rows.append((doc_id, piece, begin, end - begin, keep(ids[4 * begin : 4 * end]), full if filled else None))
                        begin, end, piece = end, end + capacity, piece + 1
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], arrow), pa.array(cols[5], pa.int64())], ["doc_id", "piece", "start", "length", "payload", "sequence_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, piece int, start long, length long, payload {payload_type}, sequence_id long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most bins that a family of dual-feasible functions proves necessary."""
    hist = np.bincount(lengths, minlength=capacity + 1)
    x = np.flatnonzero(hist)
    return bound_of(x, hist[x], capacity)


def bound_of(x: np.ndarray, n: np.ndarray, capacity: int) -> int:
    """lower_bound() of n pieces of each length x."""
    if not len(x):
        return 0
    best = -(-int((x * n).sum()) // capacity)
    # Sizes over capacity - t count as a whole bin, sizes under t as nothing.
    for t in np.unique(np.concatenate((x[x <= capacity // 2], [1]))):
        f = np.where(x > capacity - t, capacity, np.where(x < t, 0, x))
        best = max(best, -(-int((f * n).sum()) // capacity))
    # Sizes rounded to multiples of capacity / k, those that are no multiple of 1 / (k + 1).
    for k in range(1, 40):
        whole = (k + 1) * x % capacity == 0
        up = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((up * n).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item; equal lengths keep their order. Open bins are lists by free room, and
    one integer with a bit per non-empty list finds the tightest fit at once."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = made, capacity
            made += 1
        bins[i] = b
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _place(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Offset of each item in its bin, in row order."""
    order = np.argsort(bins, kind="stable")
    size = lengths[order]
    ends = np.cumsum(size)
    new = np.concatenate(([True], bins[order][1:] != bins[order][:-1]))
    base = np.repeat((ends - size)[new], np.diff(np.concatenate((np.flatnonzero(new), [len(order)]))))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = ends - size - base
    return out


def _repack(groups: DataFrame, round_no: int, capacity: int) -> DataFrame:
    """One round. Rows are no, length, `grp` and the bin they had (`old`, null in the first round)."""

    def finish(parts: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(parts)
        no, lengths, grp = (rows.column(c).to_numpy() for c in ("no", "length", "grp"))
        order = np.lexsort((no, -lengths))
        no, lengths = no[order], lengths[order]
        bins = best_fit_decreasing(lengths, capacity)
        had = rows.column("old")
        if had.null_count == 0:
            old = np.unique(had.to_numpy()[order], return_inverse=True)[1]
            if old.max() <= bins.max():
                bins = old
        used = int(bins.max()) + 1
        filled = np.bincount(bins, weights=lengths, minlength=used)
        closed = -(-int(lengths.sum()) // capacity) < used <= lower_bound(lengths, capacity)
        done = np.full(len(bins), True) if closed else (filled == capacity)[bins]
        ids = (np.int64(round_no) << _ROUND_SHIFT) + (np.int64(grp[0]) << _GROUP_SHIFT) + bins
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (no, lengths, ids, _place(lengths, bins), done)], ["no", "length", "sequence_id", "offset", "done"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            part = pa.Table.from_batches([batch])
            if not part.num_rows:
                continue
            grp = part.column("grp").to_numpy()
            cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column("grp")[0] != part.column("grp")[a]:
                    yield finish(held)
                    held = []
                held.append(part.slice(a, b - a))
        if held:
            yield finish(held)

    return groups.sortWithinPartitions("grp").mapInArrow(run, "no long, length long, sequence_id long, offset long, done boolean")


def pack(found: DataFrame, capacity: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Packs pieces (as from pieces()) into sequences: adds sequence_id and offset."""
    spark = found.sparkSession
    kept = tables.saved(found.withColumn("no", F.monotonically_increasing_id()), "pieces")
    columns = ["doc_id", "piece", "start", "length", "payload", "sequence_id", "offset"]
    full = kept.filter(F.col("length") == capacity).withColumn("offset", F.lit(0).cast("long")).select(columns)
    short = kept.filter(F.col("length") < capacity).drop("sequence_id")
    lengths = np.array([(r["length"], r["n"]) for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()], dtype=np.int64).reshape(-1, 2)  # at most `capacity` rows
    least, n = bound_of(lengths[:, 0], lengths[:, 1], capacity), int(lengths[:, 1].sum())
    rows, placed = short.select("no", "length").withColumn("old", F.lit(None).cast("long")), []
    before, had = 0, None  # bins done in earlier rounds, bins handed on by the last
    for round_no in itertools.count(1):
        if not n:
            break
        count = -(-n // group)
        dealt = rows.withColumn("grp", F.pmod(F.xxhash64("no" if round_no == 1 else "old"), F.lit(count)).cast("int")).repartition(min(count, tables.partitions(spark) * 8), "grp")
        out = tables.saved(_repack(dealt, round_no, capacity), "packed")
        # A bin's first piece stands for it.
        first, still = F.col("offset") == 0, ~F.col("done")
        bins, left, n = out.agg(F.count_if(first), F.count_if(first & still), F.count_if(still)).first()
        certified = before + bins <= least
        saved_none = had is not None and bins >= had and (count == 1 or round_no >= LEAST_ROUNDS)
        if certified or saved_none or round_no == MOST_ROUNDS:
            placed.append(out.select("no", "sequence_id", "offset"))
            break
        placed.append(out.filter("done").select("no", "sequence_id", "offset"))
        before, had = before + bins - left, left
        rows = out.filter("not done").select("no", "length", F.col("sequence_id").alias("old"))
    if not placed:
        return full
    return full.unionByName(short.join(functools.reduce(DataFrame.unionByName, placed), "no").select(columns))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    found = pieces(docs, encoding.tokenizer_path("byte_bpe_50k.json"), payload=crc32, payload_type="long")
    return pack(found).withColumnRenamed("payload", "ids_crc32")
