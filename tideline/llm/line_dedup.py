"""Fuzzy line deduplication by MinHash (operator 8).

Lines are split at \\n and stripped of white space; blank lines are left alone. Equal lines are collapsed by a
128-bit hash. A line's set is its character shingles of `SHINGLE` characters (a shorter line has one, itself). One
hash of each shingle falls into one of `BINS` bins, the least of each bin makes the signature, and empty bins borrow
from their neighbours; bands of few rows give high recall. Lines that share a band are verified on their full shingle
sets: those with a Jaccard similarity of 0.8 or more are linked, and of each component of links only the first line
stays, by doc_id, then text hash, then place.

Defined cases: null text has no lines; rows that repeat doc_id and text stand or fall together; documents may lose all
their lines; an empty table gives an empty result; `dedup` keeps further columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from .common import BLANKS, Scratch, fresh, lookup_join, words_of
from .ngram_join import row_key

SHINGLE = 8
BINS = 64
RECALL = 0.998
BANDS, ROWS = neardup.banding(neardup.NUM / neardup.DEN, RECALL, BINS)
#: Characters whose shingles are hashed at once; arrays of this size stay in the processor's cache.
TOGETHER = 200_000
_P = [np.uint64(pow(0x9E3779B97F4A7C15, 2**i, 2**64)) for i in range(3)]
_EMPTY = np.uint64(np.iinfo(np.uint64).max)


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of all lines, the line of each, and the number of shingles of each line."""
    joined = "\n".join(lines) + "\n" * SHINGLE
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = c
    for i, width in enumerate((1, 2, 4)):
        h = h[:-width] * _P[i] + h[width:]
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    n = np.maximum(length - SHINGLE + 1, 1)
    start = np.cumsum(length + 1) - length - 1
    line = np.repeat(np.arange(len(lines)), n)
    at = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    return neardup.mix64(h[at]), line, n


def line_shingles(text: str) -> np.ndarray:
    """The distinct shingles of a line; a short line's one shingle also takes in what pads it."""
    return np.unique(_shingle_hashes([text])[0])


def sets_of(lines: list[str]) -> neardup.Sets:
    h, line, _ = _shingle_hashes(lines)
    return neardup.coded(h, line, len(lines))


def _signatures(lines: list[str]) -> np.ndarray:
    h, line, _ = _shingle_hashes(lines)
    sig = np.full(len(lines) * BINS, _EMPTY, np.uint64)
    np.minimum.at(sig, line * BINS + (h >> np.uint64(58)).astype(np.int64), h & np.uint64((1 << 58) - 1))
    sig = sig.reshape(len(lines), BINS)
    step = 1
    while step < BINS:
        empty, near = sig == _EMPTY, np.roll(sig, -step, axis=1)
        sig = np.where(empty & (near != _EMPTY), neardup.mix64(near + np.uint64(step)), sig)
        step *= 2
    return sig


def lines_of(text: str | None) -> list[tuple[int, str]]:
    stripped = ((i, x.strip(BLANKS)) for i, x in enumerate((text or "").split("\n")))
    return [(i, x) for i, x in stripped if x]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, chars = [], 0
        for row, text in enumerate(batch.column("text").to_pylist()):
            for i, x in lines_of(text):
                held.append((row, i, x))
                chars += len(x)
                if chars > TOGETHER:
                    yield _rows(batch, held)
                    held, chars = [], 0
        if held:
            yield _rows(batch, held)


def _rows(batch: pa.RecordBatch, held: list[tuple[int, int, str]]) -> pa.RecordBatch:
    rows, places, texts = zip(*held, strict=True)
    keys = neardup.band_keys(_signatures(list(texts)), BANDS, ROWS)
    bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
    take = pa.array(rows, pa.int64())
    ids = pa.array([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in texts], pa.binary())
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(places, pa.int32()), ids, bands], ["doc_id", "th", "line", "id", "bands"])


def _load(docs: DataFrame, scratch: Scratch):
    """Brings candidate lines; a document's text is fetched once for all of its candidates."""

    def load(items: DataFrame, arrays: int) -> DataFrame:
        wanted = F.collect_list(F.struct("k", "bands", "weight", "line"))
        by_doc = scratch.table(items.groupBy("key").agg(wanted.alias("wanted")), "wanted_lines")
        both = lookup_join(docs, by_doc, "key", None, arrays + 40 * items.count()).where("wanted is not null")
        lines = both.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
        return lines.select("w.k", "w.bands", "w.weight", F.btrim(F.get("lines", F.col("w.line")), F.lit(BLANKS)).alias("text"))

    return load


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, drop): for each document that repeats lines of others or its own, the places of the lines to drop."""
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    seen = scratch.table(d.mapInArrow(_sketch, "doc_id long, th long, line int, id binary, bands array<long>"), "lines")
    place = F.struct("doc_id", "th", "line")
    first = seen.groupBy("id").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("weight"), F.first("bands").alias("bands"))
    items = scratch.table(first.select(F.monotonically_increasing_id().alias("k"), "id", "place", row_key(F.col("place.doc_id"), F.col("place.th")).alias("key"), "place.line", "weight", "bands"), "line_items")
    texts = d.select(row_key(F.col("doc_id"), F.col("th")).alias("key"), "text")
    linked = neardup.similar(items.select("k", "key", "line", "weight", "bands"), _load(texts, scratch), sets_of, scratch).select("k", "root")
    own = items.select("id", "k", "place", "weight").join(linked, "k", "left").where("root is not null or weight > 1").withColumn("grp", F.coalesce("root", "k"))
    keeper = own.groupBy("grp").agg(F.min("place").alias("keeper"))
    own = scratch.table(own.join(keeper, "grp").select("id", "keeper"), "keepers")
    scratch.drop(items, linked)
    again = lookup_join(seen.select("id", place.alias("place")), own, "id", F.col("place")).where("keeper is not null and place != keeper")
    drop = again.groupBy(row_key(F.col("place.doc_id"), F.col("place.th")).alias("key")).agg(F.collect_set("place.line").alias("drop"))
    out = scratch.table(drop, "dropped_lines")
    scratch.drop(own, seen)
    return out


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """docs with the repeated lines taken out of the text (null stays null), all other columns as they are. With
    counts, also n_lines and n_dropped: the lines (blank ones included) and those taken out."""
    key, drop, all_lines = fresh(docs, "__key", "__drop", "__lines")
    gone = repeats(docs, doc_id, text).select(F.col("key").alias(key), F.col("drop").alias(drop))
    body = docs.withColumn(key, row_key(F.col(doc_id), F.xxhash64(F.coalesce(F.col(text), F.lit("")))))
    lists = gone.agg(F.coalesce(F.sum(F.size(drop)), F.lit(0))).first()[0]
    body = lookup_join(body, gone, key, None, 4 * lists)
    lines = F.split(F.col(text), "\n")
    left = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(drop)))
    new = F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(all_lines), i)), "\n"))
    number = lambda array, name: F.when(F.col(array).isNull(), F.lit(0)).otherwise(F.size(array)).cast("long").alias(name)
    body = body.withColumn(all_lines, lines)
    more = [number(all_lines, "n_lines"), number(drop, "n_dropped")] if counts else []
    return body.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns], *more)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, counts=True).select("doc_id", "n_lines", "n_dropped", "text")


def stage(docs: DataFrame) -> DataFrame:
    """For a pipeline: documents left without a word go, and n_chars follows the text."""
    out = dedup(docs)
    out = out.where(F.size(words_of(F.col("text"))) > 0)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
