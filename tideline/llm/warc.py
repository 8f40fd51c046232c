"""WARC archives: a writer with revisit records and a splittable reader (operator 2).

Each record is a gzip member of its own. Of records with equal payloads of at least `LEAST` bytes the one with the
smallest page_id is a response, the others are revisits that name it; smaller payloads are all responses.

Reading: a file is cut into byte ranges. A task scans its range for gzip magic, validates a candidate by decoding its
start and looking for a WARC version line and header, and owns every record that starts inside its range, also if it
ends beyond. The record after a valid one starts where that one ends; only after damage is magic searched again.
A gzip member that a payload holds and that a range begins in front of could pass for a record of its own, in archives
of others; what `write` makes can't hold one, as payloads are UTF-8 text and UTF-8 has no gzip magic.

Defined cases: null html is an empty payload; null url leaves the header out; rows that repeat the smallest page_id of
a group are all responses; a null page_id counts as larger than any other; an empty table gives an empty result;
further columns are ignored."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lookup_join, scratch_path

LEAST = 100
SPLIT_BYTES = 4 << 20
MAX_TASKS = 100_000
MAGIC = b"\x1f\x8b\x08"
READ = 256 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def with_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to). The smallest page_id of each repeated payload is
    found by a pre-aggregated grouping of narrow rows; the payloads move once, dealt by digest and salt."""
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2(F.encode("html", "UTF-8"), 256))
    first = p.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = Scratch(pages.sparkSession).table(first.where("n > 1"), "repeated_payloads")
    p = lookup_join(p, first.select("payload_digest", "first"), "payload_digest", F.col("page_id"), counts=first.select("payload_digest", "n"))
    return p.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record as a gzip member. A revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, size, n = TaskContext.get(), None, 0, 0
        fs, path = pafs.FileSystem.from_uri(folder)
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for b in batches:
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            for page_id, url, html, digest, refers_to in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to")], strict=True):
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)
                out.write(data)
                size, n = size + len(data), n + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    return run


def write(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Writes the archives, one for each task; returns the manifest (file, bytes, records). Files of attempts that
    failed are not in it."""
    return Scratch(pages.sparkSession).table(with_types(pages, **columns).mapInArrow(_writer(folder), "file string, bytes long, records long"), "manifest")


class Members:
    """Gzip members of a file that start in [start, stop)."""

    def __init__(self, source, start: int, stop: int):
        self.source, self.stop, self.size = source, min(stop, source.size()), source.size()
        self.at, self.data = start, b""  # data: what follows at

    def _more(self, n: int = READ) -> bool:
        end = self.at + len(self.data)
        if end >= self.size:
            return False
        self.source.seek(end)
        self.data += self.source.read(min(n, self.size - end))
        return True

    def _skip(self, n: int) -> None:
        self.at, self.data = self.at + n, self.data[n:]

    def _valid(self) -> bool:
        """Whether a record starts here: its first bytes decode to a version line and a header."""
        while len(self.data) < 512 and self._more():
            pass
        if not self.data.startswith(MAGIC):
            return False
        try:
            text = zlib.decompressobj(31).decompress(self.data[:4096], 512)
        except zlib.error:
            return False
        first, _, rest = text.partition(b"\r\n")
        return first.startswith(b"WARC/") and re.match(rb"[A-Za-z-]+:", rest) is not None

    def _member(self) -> bytes | None:
        """The record here, decoded, and a step beyond it; None and no step if it is damaged."""
        z, parts, used = zlib.decompressobj(31), [], 0
        try:
            while not z.eof:
                if used == len(self.data) and not self._more():
                    return None
                parts.append(z.decompress(self.data[used:]))
                used = len(self.data) - len(z.unused_data)
        except zlib.error:
            return None
        self._skip(used)
        return b"".join(parts)

    def __iter__(self) -> Iterator[bytes]:
        while self.at < self.stop:
            if self._valid() and (found := self._member()) is not None:
                yield found
                continue
            self._skip(min(1, len(self.data)) or 1)
            while self.at < self.stop:
                i = self.data.find(MAGIC)
                if i >= 0:
                    self._skip(i)
                    break
                self._skip(max(0, len(self.data) - len(MAGIC) + 1))
                if not self._more():
                    return


def parse(data: bytes) -> tuple:
    """A row of SCHEMA from a record's bytes; digest and size of a response are of the payload as read."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
    kind, refers = fields["warc-type"], fields.get("warc-refers-to")
    if kind == "revisit":
        lengths = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, digest, payload = lengths[0], fields["warc-payload-digest"].partition(":")[2], None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return number(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, number(refers) if refers else None, size, digest, payload


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of archives. files: (file, bytes). Each range of split_bytes is read by a task of its own, up to
    MAX_TASKS of them."""
    tasks = min(files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1, MAX_TASKS)
    split = files.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, name = pafs.FileSystem.from_uri(file)
                rows, held = [], 0
                with fs.open_input_file(name) as source:
                    for data in Members(source, start, start + split_bytes):
                        rows.append(parse(data))
                        held += len(data)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return split.repartitionByRange(tasks, "file", "start").mapInArrow(run, SCHEMA)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc"))
    return read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM m"""
