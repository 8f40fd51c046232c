"""MinHash fingerprints of documents, near pairs by signature bands, and fingerprints of edited texts (operator 13).

Shingles are five words, or all words of a text that has fewer. `HASHES` universal hash functions x -> a * x + b with odd a,
permutations of the 32-bit numbers, are applied to many shingles of a text at once; a signature holds the least value of
each, and a fingerprint 16 mixed bits of each in hex. The likeness of two fingerprints is the share of equal places, which
estimates the Jaccard similarity of the shingle sets. Bands of signatures are joined in Spark, and the pairs that share one
are verified on their whole shingle sets (`neardup.similar`).

A document meets the next one in a single shuffle. The keys alone are range-sorted first; from the first and last keys
of each range follow the ranges, and which document each range needs beside its own. Texts then go to their range, as
zstandard frames, the first one of a range also to the range before, and stream through it in order.

Defined cases: null texts are empty; texts without words have the fingerprint of the empty set, like each other and unlike
any other; null doc_ids come first; documents that share a doc_id follow each other by a hash of the text; rows that
repeat both are one document in the order, and each of them is given its result; the only document is its own next one;
an empty table gives an empty result; columns other than doc_id and text are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import neardup
from .common import BLANKS, Scratch, lookup_join
from .ngram_join import N, hashed_words, joined, sets_of

HASHES = 128
RECALL = 0.999
BANDS, ROWS = neardup.banding(neardup.NUM / neardup.DEN, RECALL, HASHES)
#: Bytes of text of a range, about, and the most ranges: their edges (24 bytes each) go to every task.
RANGE_BYTES = 16 << 20
MOST_RANGES = 200_000
#: Shingles that are hashed at once: with all functions they fit a core's cache.
AT_ONCE = 1024
_LEAST = -(1 << 63)

_A = (neardup.mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (neardup.mix64(np.arange(1001, 1001 + HASHES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The least value of a set of hashed shingles under each function. start: the signature of others that are in it."""
    sig = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32) if start is None else start
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    work = np.empty((HASHES, min(AT_ONCE, max(1, len(x)))), np.uint32)
    for i in range(0, len(x), AT_ONCE):
        some = x[i : i + AT_ONCE]
        part = work[:, : len(some)]
        np.multiply(_A[:, None], some[None, :], out=part)
        np.add(part, _B[:, None], out=part)
        sig = np.minimum(sig, part.min(axis=1))
    return sig


def printed(sig: np.ndarray) -> np.ndarray:
    """A signature's fingerprint: 16 bits of each value."""
    return (neardup.mix64(sig.astype(np.uint64)) >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray, a_empty: bool, b_empty: bool) -> float:
    return float(a_empty == b_empty) if a_empty or b_empty else float(np.mean(a == b))


class Document:
    """A text with its signature, and what an edit of its last quarter leaves of both."""

    def __init__(self, text: str):
        self.text, self.kept = text, len(text) - len(text) // 4
        cut = 1 + max(text.rfind(c, 0, self.kept) for c in BLANKS)  # words in front of it stay
        self.rest = text[cut : self.kept]
        self.words = hashed_words(text[:cut])
        self.start = signature(joined(self.words)) if len(self.words) >= N else None
        self.sig, self.empty = self._of(text[cut:])

    def _of(self, rest: str) -> tuple[np.ndarray, bool]:
        """The signature of the words that stay and those of another rest."""
        all_ = np.concatenate([self.words[1 - N :] if self.start is not None else self.words, hashed_words(rest)])
        new = joined(all_) if self.start is None or len(all_) >= N else all_[:0]
        return signature(new, self.start), self.start is None and not len(all_)

    def edited(self, after: str) -> tuple[str, np.ndarray, bool]:
        """The edited text, its signature and whether it has no words."""
        more = after[: len(self.text) - self.kept]
        return self.text[: self.kept] + more, *self._of(self.rest + more)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, id, bytes, bands): id is a digest of the set of shingles, null for the empty set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            b = batch.slice(at, 512)
            sets = [np.unique(joined(hashed_words(t))) for t in b.column("text").to_pylist()]
            ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            keys = neardup.band_keys(np.stack([signature(s) for s in sets]).astype(np.uint64), BANDS, ROWS)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(ids, pa.binary()), b.column("bytes"), bands], ["doc_id", "th", "id", "bytes", "bands"])


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, th, text, bytes): th is a hash of the text, which is never null."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return d.withColumn("th", F.xxhash64("text")).withColumn("bytes", F.octet_length("text").cast("long"))


def _key(doc_id: Column, th: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.hex(th))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document (doc_id and text): doc_id, th, bytes, copies (rows that repeat it, itself included), class_id
    (the smallest doc_id of its class) and n_links (rows it is similar to)."""
    d, scratch = _documents(docs, doc_id, text), Scratch(docs.sparkSession)
    narrow = scratch.table(d.select("doc_id", "th", "bytes", "text").mapInArrow(_sketch, "doc_id long, th long, id binary, bytes long, bands array<long>"), "sketches")
    key = _key(F.col("doc_id"), F.col("th"))
    first = narrow.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("least"), F.min(key).alias("key"), F.count(F.lit(1)).alias("weight"), F.first("bands").alias("bands"))
    items = scratch.table(first.withColumn("k", F.monotonically_increasing_id()), "items")

    def load(wanted: DataFrame, arrays: int) -> DataFrame:
        found = lookup_join(d.select(key.alias("key"), "text"), wanted.select("key", "k", "bands", "weight"), "key", None, arrays)
        return found.where("k is not null").select("k", "bands", "weight", "text")

    linked = neardup.similar(items, load, sets_of, scratch, 256)
    own = items.select("id", "k", "least", "weight").join(linked, "k", "left").where("root is not null or weight > 1")
    own = scratch.table(own.select("id", "least", F.coalesce("root", "k").alias("grp"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    least = scratch.table(own.groupBy("grp").agg(F.min("least").alias("class_id")), "least")
    own = scratch.table(lookup_join(own, least, "grp", F.col("id")).select("id", "class_id", "n_links"), "classes")
    each = narrow.groupBy("doc_id", "th").agg(F.first("id").alias("id"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies"))
    out = lookup_join(each, own, "id", key).select("doc_id", "th", "bytes", "copies", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return scratch.table(out, "document_classes")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_chars, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            prints = [printed(signature(joined(hashed_words(t)))).tobytes().hex() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(prints, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return _documents(docs, doc_id, text).select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first two and the last of a range's keys, which are distinct."""
    first, last = [], None
    for b in batches:
        if b.num_rows:
            ends = list(zip(b.column("hi").to_pylist(), b.column("th").to_pylist(), strict=True))
            first, last = (first + ends[:2])[:2], ends[-1]
    if last is not None:
        rows = list(zip(first[0], first[-1], last, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for r in rows for x in r], ["hi1", "hi2", "hi3", "th1", "th2", "th3"])


def _ordered(hi: np.ndarray, th: np.ndarray) -> np.ndarray:
    """Keys as 16 bytes that compare as the pairs do."""
    both = np.stack([hi, th], axis=1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def _dealt(d: DataFrame, info: DataFrame, ranges: int) -> DataFrame:
    """Texts and what is known of them in the ranges of their keys, each range sorted: (range, late, hi, th, kind, doc_id,
    class_id, n_links, copies, body). kind 0: what is known, 1: the text. late: of a document that only follows the range's last."""
    keys = info.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("hi"), "th").repartitionByRange(ranges, "hi", "th").sortWithinPartitions("hi", "th")
    ends = keys.mapInArrow(_ends, "hi1 long, hi2 long, hi3 long, th1 long, th2 long, th3 long").orderBy("hi1", "th1").collect()  # a row for each range
    edges = _ordered(np.array([r.hi1 for r in ends], np.int64), np.array([r.th1 for r in ends], np.int64))
    n = len(ends)

    def range_of(hi: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of each key, and the range that it follows, or -1."""
        key = _ordered(hi, th)
        at = np.searchsorted(edges, key, side="right") - 1
        return at, np.where(edges[at] == key, (at - 1) % n, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            if not b.num_rows:
                continue
            at, follows = range_of(b.column("hi").to_numpy(), b.column("th").to_numpy())
            rest = [b.column(c) for c in ("hi", "th", "kind", "doc_id", "class_id", "n_links", "copies")]
            body = pa.array([None if t is None else pack(t.encode()) for t in b.column("body").to_pylist()], pa.binary())
            names = ["range", "late", "hi", "th", "kind", "doc_id", "class_id", "n_links", "copies", "body"]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.zeros(len(at), bool)), *rest, body], names)
            some = pa.array(np.flatnonzero((follows >= 0) & (b.column("kind").to_numpy() == 1)))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(follows, pa.int32()).take(some), pa.array(np.ones(len(some), bool)), *(x.take(some) for x in rest), body.take(some)], names)

    none = F.lit(None).cast("long")
    hi = F.coalesce("doc_id", F.lit(_LEAST)).alias("hi")
    known = info.select(hi, "th", F.lit(0).alias("kind"), "doc_id", "class_id", "n_links", "copies", F.lit(None).cast("string").alias("body"))
    texts = d.select(hi, "th", F.lit(1).alias("kind"), "doc_id", none.alias("class_id"), none.alias("n_links"), none.alias("copies"), F.col("text").alias("body"))
    dealt = known.unionByName(texts).mapInArrow(run, "range int, late boolean, hi long, th long, kind int, doc_id long, class_id long, n_links long, copies long, body binary")
    return dealt.repartitionById(max(n, 1), "range").sortWithinPartitions("late", "hi", "th", "kind")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range in order, a row for each row of each document, once the text after it is known."""
    unpack = zstandard.ZstdDecompressor().decompress
    held = None  # the document whose next one is still to come: its key, what is known of it, its text and signature
    out: list[tuple] = []
    known = None

    def result(of: tuple, doc: Document, after: Document) -> tuple:
        doc_id, class_id, n_links, _ = of
        new, sig, empty = doc.edited(after.text)
        a, b, c = printed(doc.sig), printed(sig), printed(after.sig)
        near = likeness(a, b, doc.empty, empty), likeness(a, c, doc.empty, after.empty)
        return doc_id, len(doc.text), hashlib.sha256(new.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), *near, class_id, n_links

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], _OUT)

    for b in batches:
        for late, hi, th, kind, doc_id, class_id, n_links, copies, body in zip(*(b.column(c).to_pylist() for c in ("late", "hi", "th", "kind", "doc_id", "class_id", "n_links", "copies", "body")), strict=True):
            if kind == 0:
                known = (hi, th), (doc_id, class_id, n_links, copies)
                continue
            if held is not None and held[0] == (hi, th) and not late:  # a row that repeats the last one
                continue
            if held is None and late:  # the text after the last document, again
                continue
            doc = Document(unpack(body).decode())
            if held is not None:
                row = result(*held[1:], doc)
                for _ in range(held[1][3]):
                    out.append(row)
                    if len(out) == 2048:
                        yield batch()
                        out.clear()
            held = None if late else ((hi, th), known[1], doc)
    if out:
        yield batch()


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "n_links"]


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_chars, the fingerprints of the text and of the edited text (whose last quarter
    is replaced by the beginning of the next document's), their likeness, that to the next document's, class_id, n_links."""
    d = _documents(docs, doc_id, text)
    info = classes(docs, doc_id, text)
    size = info.agg(F.sum(F.col("bytes") * F.col("copies"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long, n_links long"
    return _dealt(d, info, ranges).mapInArrow(_edited, schema)


def op13(spark, sf_dir: str) -> DataFrame:
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
