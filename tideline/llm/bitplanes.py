"""Token ids of documents in a bit-plane file format (operator 4).

A file holds documents in ascending doc_id order, their ids end to end, cut into blocks of `BLOCK_IDS`. A block is
transposed into planes, the i-th bits (or bytes) of all its ids; planes above the largest id are left out, the others
are compressed with zstandard one by one. Layout, integers little-endian:

    magic | planes of block 0 | planes of block 1 | ... | document index | chunk index | footer

- document index: doc_id (int64), ids (int64) and a null flag (uint8) for each document, column by column, compressed
- chunk index: for each block offset (uint64), ids (uint32), planes (uint32), then the planes' lengths (uint32)
- footer: offset and length of both indexes, unit (1 bit or 8), documents, ids, blocks (uint64 each), magic

Tasks write one file each to the shared folder under a name of their attempt; only files that the returned manifest
names count, so a task that is run again does no harm. Readers own the documents that start inside their range of
ids and fetch only the blocks they need.

Defined cases: null and empty texts are the end id alone; null doc_ids come first; repeated rows are written one by
one, ties in the order of a hash of their texts; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, scratch_path
from .tokens import encoder, vocabulary

MAGIC = b"TIDEBP1\n"
BLOCK_IDS = 1 << 16
END_ID = 2
#: Ids of a reader's range.
SPLIT_IDS = 1 << 22
#: A reader takes several ranges when there are more than this.
MAX_TASKS = 100_000
_FOOTER = struct.Struct("<8Q8s")
_CHUNK = struct.Struct("<QII")


def to_planes(ids: np.ndarray, unit: int) -> list[bytes]:
    """The planes of uint32 ids, lowest first: bits (unit 1) packed eight to a byte, or bytes (unit 8)."""
    by = ids.astype("<u4").view(np.uint8).reshape(len(ids), 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if unit == 8:
        return [by[:, i].tobytes() for i in range((top + 7) // 8)]
    bits = np.unpackbits(by, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(top)]


def from_planes(planes: list[bytes], n: int, unit: int) -> np.ndarray:
    by = np.zeros((n, 4), np.uint8)
    if unit == 8:
        for i, p in enumerate(planes):
            by[:, i] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for i, p in enumerate(planes):
            bits[:, i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        by = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(by).view("<u4").ravel()


class Writer:
    def __init__(self, out, unit: int = 8, level: int = 3):
        self.out, self.unit, self.zstd = out, unit, zstandard.ZstdCompressor(level=level)
        self.at, self.chunks, self.held, self.n_held = 0, [], [], 0
        self.docs, self.counts = [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= BLOCK_IDS:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        stop = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, stop, BLOCK_IDS):
            block = ids[i : min(i + BLOCK_IDS, stop)]
            planes = [self.zstd.compress(p) for p in to_planes(block, self.unit)]
            self.chunks.append((self.at, len(block), planes and [len(p) for p in planes]))
            for p in planes:
                self._put(p)
        self.held, self.n_held = [ids[stop:].tobytes()], len(ids) - stop

    def close(self) -> None:
        self._blocks(True)
        doc_ids = np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.counts, "<i8").tobytes() + np.array([d is None for d in self.docs], np.uint8).tobytes()
        docs, docs_at = self.zstd.compress(doc_ids), self.at
        self._put(docs)
        index = b"".join(_CHUNK.pack(at, n, len(sizes)) + np.array(sizes, "<u4").tobytes() for at, n, sizes in self.chunks)
        index_at = self.at
        self._put(index)
        self._put(_FOOTER.pack(docs_at, len(docs), index_at, len(index), self.unit, len(self.docs), sum(self.counts), len(self.chunks), MAGIC))


class Reader:
    def __init__(self, source):
        self.source = source
        end = source.size()
        source.seek(end - _FOOTER.size)
        docs_at, docs_len, index_at, index_len, self.unit, n, self.n_ids, blocks, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a bit-plane file")
        self.zstd = zstandard.ZstdDecompressor()
        raw = self.zstd.decompress(self._at(docs_at, docs_len), max_output_size=17 * n) if n else b""
        self.doc_ids, self.counts = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n)
        self.nulls = np.frombuffer(raw, np.uint8, n, 16 * n).astype(bool)
        index, p, self.chunks = self._at(index_at, index_len), 0, []
        for _ in range(blocks):
            at, ids, planes = _CHUNK.unpack_from(index, p)
            self.chunks.append((at, ids, np.frombuffer(index, "<u4", planes, p + _CHUNK.size)))
            p += _CHUNK.size + 4 * planes

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def block(self, i: int) -> np.ndarray:
        at, n, sizes = self.chunks[i]
        data, planes, p = self._at(at, int(sizes.sum())), [], 0
        width = n if self.unit == 8 else -(-n // 8)
        for s in sizes:
            planes.append(self.zstd.decompress(data[p : p + int(s)], max_output_size=width))
            p += int(s)
        return from_planes(planes, n, self.unit)

    def documents(self, low: int, high: int) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, start, ids) of the documents that start at ids from low to high - 1."""
        starts = np.cumsum(self.counts) - self.counts
        held, first, end = np.empty(0, "<u4"), 0, -1
        for i in range(int(np.searchsorted(starts, low)), int(np.searchsorted(starts, high))):
            start, stop = int(starts[i]), int(starts[i] + self.counts[i])
            if end < start:  # blocks before this document aren't needed
                held, first = np.empty(0, "<u4"), start // BLOCK_IDS * BLOCK_IDS
                end = first
            parts = [held[start - first :]] if end > start else []
            base = start if parts else end
            while end < stop:
                parts.append(self.block(end // BLOCK_IDS))
                end += len(parts[-1])
            held, first = np.concatenate(parts) if parts else held, base
            yield None if self.nulls[i] else int(self.doc_ids[i]), start, held[start - first : stop - first].tobytes()


@dataclass(frozen=True)
class _Write:
    folder: str
    path: str
    end: bytes
    unit: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(self.path), TaskContext.get()
        fs, folder = pafs.FileSystem.from_uri(self.folder)
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.bp"
        writer = None
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, encoded in enc.batches(batch.column("text")):
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(name)
                    writer = Writer(out, self.unit)
                for d, ids in zip(doc_ids[at:], encoded, strict=False):
                    writer.add(d, ids + self.end)
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "file": [f"{self.folder}/{name.rpartition('/')[2]}"], "n_docs": [len(writer.docs)], "n_ids": [sum(writer.counts)], "bytes": [writer.at]})


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, unit: int = 8) -> DataFrame:
    """Encodes whole texts and writes them; returns the manifest (part, file, n_docs, n_ids, bytes, base): a row for
    each file in doc_id order, base being the ids in the files before."""
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]  # a doc_id of many rows, or many equal rows, may fill several files
    d = d.repartitionByRange(*order).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    run = _Write(folder, path or vocabulary(), np.array([end_id], "<u4").tobytes(), unit)
    manifest = scratch.table(d.mapInArrow(run, "part long, file string, n_docs long, n_ids long, bytes long"), "manifest")
    return manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))  # a row for each file


def read(manifest: DataFrame, split_ids: int = SPLIT_IDS) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; ids are packed little-endian uint32."""
    each = lambda n: F.greatest(F.ceil(F.col(n) / split_ids), F.lit(1))
    tasks = min(manifest.agg(F.sum(each("n_ids"))).first()[0] or 1, MAX_TASKS)
    splits = manifest.select("file", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_ids") - 1, F.lit(0)), F.lit(split_ids).cast("long"))).alias("low"))
    return splits.repartitionByRange(tasks, "base", "low").mapInArrow(lambda b: _documents(b, split_ids), "doc_id long, start long, ids binary")


def _documents(batches: Iterator[pa.RecordBatch], split_ids: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, base, low in zip(*[batch.column(c).to_pylist() for c in ("file", "base", "low")], strict=True):
            fs, name = pafs.FileSystem.from_uri(file)
            with fs.open_input_file(name) as source:
                rows, held = [], 0
                for d, start, ids in Reader(source).documents(low, low + split_ids):
                    rows.append((d, base + start, ids))
                    held += len(ids)
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    d, s, i = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(i, pa.binary())], ["doc_id", "start", "ids"])


def digest(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(read(write(docs, scratch_path(spark, "bitplanes"))))
