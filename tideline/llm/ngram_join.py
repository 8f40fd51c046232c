"""N-gram Jaccard self-join of documents by MinHash banding (operator 3).

Words are runs of characters other than space and 9 to 13; n-grams are five words; documents of fewer words have one
n-gram, all their words. Documents whose n-gram sets have a Jaccard similarity of 0.8 or more are linked. Bands and
rows are chosen for `RECALL` at 0.8, band hashes are shuffled, and pairs are verified on the full n-gram sets (as
64-bit hashes of the n-grams).

Defined cases: documents without a word (null, empty) link to nothing and are classes of their own; equal sets are
one item with as many copies; repeated rows are copies of each other; a doc_id shared by different texts gives one
row for each; an empty table gives an empty result; further columns are ignored by `classes` and kept by `first_of_class`."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from .common import WORD, Scratch, fresh, lookup_join

N = 5
RECALL = 0.999
BANDS, ROWS = neardup.banding(neardup.NUM / neardup.DEN, RECALL, 128)
_STEP = np.uint64(0xA24BAED4963EE407)
_words = re.compile(WORD).findall


class _WordHash(dict):
    """64-bit hashes of words; emptied when it grows, so a worker's memory stays bounded."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) > 300_000:
            self.clear()
        if len(word) < 40:
            self[word] = h
        return h


_hashes = _WordHash()


def hashed_words(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, in order."""
    words = _words(text or "")
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def joined(w: np.ndarray) -> np.ndarray:
    """The hashed n-grams of hashed words, in order; fewer than N words make one, none makes none."""
    n = min(N, len(w))
    if not n:
        return w
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h = (h ^ w[j : len(w) - n + 1 + j]) * _STEP + np.uint64(j)
    return neardup.mix64(h)


def ngrams(text: str | None) -> np.ndarray:
    """The distinct n-grams of a text, hashed and sorted."""
    return np.unique(joined(hashed_words(text)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            b = batch.slice(at, 512)
            sets = [ngrams(t) for t in b.column("text").to_pylist()]
            ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            keys = neardup.band_keys(np.stack([neardup.minhash(s, BANDS * ROWS) for s in sets]), BANDS, ROWS)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(ids, pa.binary()), bands], ["doc_id", "th", "id", "bands"])


def _load(docs: DataFrame):
    """Brings the texts of candidates."""

    def load(items: DataFrame, arrays: int) -> DataFrame:
        wanted = lookup_join(docs, items.select("key", "k", "bands", "weight"), "key", None, arrays).where("k is not null")
        return wanted.select("k", "bands", "weight", "text")

    return load


def sets_of(texts: list[str]) -> neardup.Sets:
    found = [ngrams(t) for t in texts]
    return neardup.coded(np.concatenate(found), np.repeat(np.arange(len(found)), [len(s) for s in found]), len(found))


def row_key(doc_id, th):
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.hex(th))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    return d.withColumn("key", row_key(F.col("doc_id"), F.col("th")))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, th (a hash of its text), grp (equal throughout a class, null for documents that
    link to nothing), class_id (the class's smallest doc_id) and n_links (documents it is similar to, copies counted)."""
    scratch = Scratch(docs.sparkSession)
    d = _keyed(docs, doc_id, text)
    narrow = scratch.table(d.select("doc_id", "th", "text").mapInArrow(_sketch, "doc_id long, th long, id binary, bands array<long>"), "sketches")
    key = row_key(F.col("doc_id"), F.col("th"))
    first = narrow.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("least"), F.min(key).alias("key"), F.count(F.lit(1)).alias("weight"), F.first("bands").alias("bands"))
    items = scratch.table(first.withColumn("k", F.monotonically_increasing_id()), "items")
    linked = neardup.similar(items, _load(d.select("key", "text")), sets_of, scratch, 256)
    own = items.select("id", "k", "least", "weight").join(linked, "k", "left").where("root is not null or weight > 1")
    own = own.select("id", "least", F.coalesce("root", "k").alias("grp"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own = own.join(own.groupBy("grp").agg(F.min("least").alias("class_id")), "grp").select("id", "grp", "class_id", "n_links")
    own = scratch.table(own, "classes")
    out = lookup_join(narrow.drop("bands"), own, "id", F.col("doc_id"))
    return out.select("doc_id", "th", "grp", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def first_of_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of docs with all columns, one of each class: that with the smallest doc_id, then text hash. Of
    rows that repeat both doc_id and text one stays."""
    scratch = Scratch(docs.sparkSession)
    c = scratch.table(classes(docs, doc_id, text), "class_rows")
    best = c.where("grp is not null").groupBy("grp").agg(F.min(F.struct("doc_id", "th")).alias("b")).select("b.*")
    kept = c.where("grp is null").select("doc_id", "th").unionByName(best)
    (key,) = fresh(docs, "__key")
    kept = kept.select(row_key(F.col("doc_id"), F.col("th")).alias(key))
    body = docs.withColumn(key, row_key(F.col(doc_id), F.xxhash64(F.coalesce(F.col(text), F.lit("")))))
    return body.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")
