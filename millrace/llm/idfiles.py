"""Token ids in bit-packed files with random access.

A file holds whole documents in order. Layout, all integers little-endian:
    8 bytes   magic
    u32 x 4   version, bits per id, ids per block, length in bytes of the index
    u64 x 2   documents, ids
    index     zlib of: doc ids (i64), ids per document (u32), a byte per document that is 1 if its
              doc id is null, byte offset of each block (u64) from the start of the blocks
    blocks    ids of `bits` bits each, least significant bit first; a block starts on a byte
Files are rolled at a bounded number of ids, so a reader holds one file at a time. A writer's
task writes under a name of its own and renames, so that a task run twice leaves one file.

Nulls: a null text has no ids of its own; null doc ids come first. Rows of one doc id are kept, in
the order of a hash of their text; repeated rows may be dealt to several files. An empty table
gives no files and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import encoding, tables, textcore

MAGIC = b"MILLIDS1"
BLOCK = 4096
#: Ids after which a file is closed; a longer document is alone in its file.
FILE_IDS = 4_000_000
_HEAD = struct.Struct("<8s4I2Q")


def bits_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """ids, each in `bits` bits."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    octets = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(octets[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def to_file(doc_ids: list[int | None], docs: list[bytes], bits: int, block: int = BLOCK) -> bytes:
    """The bytes of a file of documents; `docs` as little-endian unsigned 32-bit ids."""
    ids = np.frombuffer(b"".join(docs), dtype="<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id needs more bits")
    blocks = [pack_bits(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks])))[: len(blocks)].astype("<u8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    index = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([len(d) // 4 for d in docs], "<u4").tobytes() + nulls.tobytes() + starts.tobytes(), 1)
    return _HEAD.pack(MAGIC, 1, bits, block, len(index), len(docs), len(ids)) + index + b"".join(blocks)


class IdFile:
    """Reads a file's bytes: whole documents, or any span of ids by its blocks alone."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block, n_index, self.n_docs, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a file of ids")
        self.data, at = memoryview(data), _HEAD.size
        index = zlib.decompress(self.data[at : at + n_index])
        n = self.n_docs
        nulls = np.frombuffer(index, np.uint8, n, 12 * n)
        self.doc_ids = [None if null else d for d, null in zip(np.frombuffer(index, "<i8", n).tolist(), nulls.tolist(), strict=True)]
        self.starts = np.concatenate(([0], np.cumsum(np.frombuffer(index, "<u4", n, 8 * n), dtype=np.int64)))
        self.blocks = np.frombuffer(index, "<u8", -(-self.n_ids // self.block), 13 * n).astype(np.int64)
        self.base = at + n_index

    def span(self, begin: int, end: int) -> np.ndarray:
        """Ids begin..end of the file."""
        if end <= begin:
            return np.zeros(0, "<u4")
        first, last = begin // self.block, (end - 1) // self.block
        out = []
        for k in range(first, last + 1):
            n = min(self.block, self.n_ids - k * self.block)
            at = self.base + int(self.blocks[k])
            out.append(unpack_bits(self.data[at : at + (n * self.bits + 7) // 8], self.bits, n))
        return np.concatenate(out)[begin - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.starts[i]), int(self.starts[i + 1]))


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes documents (doc_id, text) and writes files in ascending doc_id order under `path`, a
    folder that all executors share. Returns a row per file: file, start (ids in files before), n_ids."""
    spark = docs.sparkSession
    bits = bits_for(encoding.vocabulary_size(vocabulary))
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    system, root = _open(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    system.create_dir(root, recursive=True)
    uri = path.replace("file:///", "file:/").replace("file:/", "file:///")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(uri)
        enc = encoding.encoder(vocabulary)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        keys: list = []
        held: list[bytes] = []
        size, seq = 0, 0

        def close() -> pa.RecordBatch:
            name = f"ids-{part:06d}-{seq:06d}.bin"
            with system.open_output_stream(f"{root}/_{attempt}-{name}") as out:
                out.write(to_file(keys, held, bits))
            system.move(f"{root}/_{attempt}-{name}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part]), pa.array([seq]), pa.array([size])], ["file", "part", "seq", "n_ids"])

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in textcore.batches(texts, 3_000_000):
                for doc_id, ids in zip(doc_ids[a:b], enc.encode(texts[a:b]), strict=True):
                    ids += tail
                    if held and size + len(ids) // 4 > file_ids:
                        yield close()
                        keys, held, size, seq = [], [], 0, seq + 1
                    keys.append(doc_id)
                    held.append(ids)
                    size += len(ids) // 4
        if held:
            yield close()

    n = tables.partitions(spark)
    # The rows of one id, and even one row repeated, are ranges of their own where they are many.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"_h": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(n, "doc_id", "_h", "_n").sortWithinPartitions("doc_id", "_h", "_n").select("doc_id", "text")
    wrote = tables.saved(ordered.mapInArrow(run, "file string, part long, seq long, n_ids long"), "manifest")
    parts = wrote.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row per writing task
    base, at = [], 0
    for r in parts:
        base.append((r["part"], at))
        at += r["n"]
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    bases = spark.createDataFrame(base, "part long, base long")
    return wrote.join(bases, "part").select("file", (F.col("base") + F.coalesce(before, F.lit(0))).alias("start"), "n_ids")


def read_ids(spark: SparkSession, path: str, files: DataFrame, payload=None, payload_type: str = "binary") -> DataFrame:
    """Documents from files: doc_id, start (ids of all documents before), n_tokens, payload. The
    payload is the ids as little-endian unsigned 32-bit bytes, or what `payload` makes of them."""
    keep = payload or bytes
    arrow = pa.int64() if payload_type in ("long", "bigint") else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                f = IdFile(content.as_buffer())
                ids = f.span(0, f.n_ids).tobytes()
                starts = f.starts.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py().rsplit("/", 1)[1]] * f.n_docs), pa.array(f.doc_ids, pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(np.diff(f.starts)), pa.array([keep(ids[4 * a : 4 * b]) for a, b in zip(starts[:-1], starts[1:], strict=True)], arrow)],
                    ["file", "doc_id", "at", "n_tokens", "payload"],
                )

    content = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").load(path).select("path", "content")
    rows = content.mapInArrow(run, f"file string, doc_id long, at long, n_tokens long, payload {payload_type}")
    return rows.join(files, "file").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "payload")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.new_path(spark, "ids")
    vocabulary = encoding.tokenizer_path("word_bpe_49k.json")
    files = write_ids(tables.table(spark, sf_dir, "documents"), path, vocabulary, end_id=1)
    return read_ids(spark, path, files, zlib.crc32, "long").withColumnRenamed("payload", "ids_crc32")
