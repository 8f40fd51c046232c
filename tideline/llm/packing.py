"""Best-fit packing of token sequences in bulk-synchronous rounds (operator 1).

Documents become pieces of at most `SIZE` ids. Pieces over half a sequence open one each; the others follow in bands, from
long to short. A round begins with the counts of pieces and gaps by size, at most two numbers for each size, and then has
four steps:

1. The pieces of the band that are left and the gaps that could take one are range-sorted by size, the largest first. A
   gap has a place for each piece of the band that it takes for certain, at least one; gaps that are larger than the
   smallest ones with places for all pieces stand aside, as best fit would not use them.
2. A sweep down the sizes keeps the gaps passed on a stack, so that each piece finds its successor: the smallest gap not
   smaller than it whose places no larger pieces have taken. Each range is swept by its own task. What is open at its end,
   pieces that found the stack empty and gaps with places left, meets over ranges:
3. a range reports how many pieces and places are open, the stack's depth at the start of every range follows from these
   few numbers, and conflicts resolve by rank: the k-th open piece of a range takes the place at the k-th depth from the
   top, the last that an earlier range left there. One depth holds two rows of a range at most.
4. Gaps shrink by what they took and return to the band.

Rounds repeat until no gap takes any piece of the band. Only then sequences are opened, and no more than the pieces need
that are left. Pieces of which the same number fits a sequence, eight at most, open them in sorted order: what such a
sequence leaves takes none of them. Of smaller ones the longest open as many as their lengths add up to, one piece each,
and the next round fills these.

Defined cases: null and empty texts are one piece, the end id alone; repeated rows are packed one by one; an empty
table gives an empty result; documents without a doc_id are packed as others; further columns are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, remove, scratch_path
from .tokens import encoder, vocabulary

SIZE = 4096
END_ID = 1
#: Kinds of rows of a round: a gap (its sequence, its room), a piece that is left, a piece that has its place.
GAP, LEFT, PLACED = 0, 1, 2
ROUND = "kind int, id long, size long, seq long, offset long"
SWEPT = f"{ROUND}, part int, at long, slots long"
ARROW = {"int": pa.int32(), "long": pa.int64()}
#: Rows of a range, about.
RANGE_ROWS = 250_000
#: Bands of lengths end at these parts of a sequence.
PARTS = (2, 3, 4, 6, 12, 48)
#: Pieces of which so many or fewer fit a sequence open sequences in classes.
FEW = 8
#: Into so many parts pieces of one length are dealt where only some of them open sequences.
PARTS_OF_TIES = 1024


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32."""
    path = path or vocabulary()
    end = np.array([end_id], np.uint32).tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at, encoded in enc.batches(batch.column("text")):
                rows, cols = [], ([], [], [], [])
                for row, ids in enumerate(encoded, at):
                    ids += end
                    n = len(ids) // 4
                    for piece, start in enumerate(range(0, n, size)):
                        stop = min(n, start + size)
                        rows.append(row)
                        for c, v in zip(cols, (piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                            c.append(v)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *map(pa.array, cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _ranged(rows: DataFrame, n: int, *order) -> DataFrame:
    """n rows in ranges of about `RANGE_ROWS`, each sorted."""
    ranges = -(-n // RANGE_ROWS)
    return (rows.repartitionByRange(ranges, *order) if ranges > 1 else rows.repartition(1)).sortWithinPartitions(*order)


def _sweep(size: int):
    """A sweep down one range: rows of a round, with the range's number. Pieces that find no gap in the range stay LEFT, at
    says how many such pieces came before. A gap with places left has their number in slots, and in at how many places of
    the range's other open gaps lie below it on the stack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, unmet, stack = TaskContext.get().partitionId(), 0, []
        for b in batches:
            out = []
            for kind, row, length, slots in zip(*(b.column(c).to_pylist() for c in ("kind", "id", "size", "slots")), strict=True):
                if kind == GAP:
                    stack.append([row, length, slots])
                elif not stack:
                    out.append((LEFT, row, length, None, None, part, unmet, 0))
                    unmet += 1
                else:
                    seq, room, places = stack[-1]
                    out.append((PLACED, row, length, seq, size - room, part, 0, 0))
                    stack[-1][1:] = room - length, places - 1
                    if places == 1:
                        stack.pop()
                        if room > length:
                            out.append((GAP, seq, room - length, None, None, part, 0, 0))
            yield _rows(out, SWEPT)
        below, out = 0, []
        for seq, room, places in stack:
            out.append((GAP, seq, room, None, None, part, below, places))
            below += places
        yield _rows(out, SWEPT)

    return run


def _swept(gaps: DataFrame, pieces: DataFrame, n: int, n_gaps: int, longest: int, size: int, scratch: Scratch) -> DataFrame:
    """One sweep over n_gaps gaps and n pieces (both kind, id, size), as rows of a round: pieces placed, pieces left, and the
    gaps with what remains of them."""
    each = F.least(F.greatest(F.floor(F.col("size") / longest), F.lit(1)), F.lit(n)).cast("long")
    u = gaps.select("kind", "id", "size", each.alias("slots")).unionByName(pieces.select("kind", "id", "size"), allowMissingColumns=True)
    u = _ranged(u, n + n_gaps, F.col("size").desc(), "kind", "id").mapInArrow(_sweep(size), SWEPT)
    names = ["kind", "id", "size", "seq", "offset"]
    if n + n_gaps <= RANGE_ROWS:  # one range
        return u.select(*names)
    u = scratch.table(u, "sweep")
    piece, free = F.col("kind") == LEFT, F.col("slots") > 0
    ends = u.groupBy("part").agg(F.count(F.when(piece, 1)).alias("unmet"), F.sum("slots").alias("free")).orderBy("part")
    depth, starts = 0, []
    for r in ends.collect():  # a row for each range: the stack's depth at its start, and below the gaps that it adds
        below = max(depth - r.unmet, 0)
        starts.append((r.part, depth, below))
        depth = below + r.free
    u = u.join(F.broadcast(u.sparkSession.createDataFrame(starts, "part int, depth long, below long")), "part")  # a row for each range
    asks = u.where(piece & (F.col("at") < F.col("depth"))).select("part", "kind", "id", "size", (F.col("depth") - F.col("at")).alias("level"))
    first = F.col("below") + F.col("at") + 1
    stand = u.where(free).select("part", "kind", "id", "size", F.explode(F.sequence(first, first + F.col("slots") - 1)).alias("level"))
    last = F.lag("id").over(Window.partitionBy("level").orderBy("part", F.col("kind").desc()))  # a range takes before it adds
    met = stand.unionByName(asks).withColumn("seq", last).where(piece).select("kind", "id", "size", "seq")
    w = Window.partitionBy(F.coalesce("seq", "id"))
    length, room = F.when(piece, F.col("size")).otherwise(F.lit(0)), F.max(F.when(~piece, F.col("size"))).over(w)
    upto = F.sum(length).over(w.orderBy("kind", F.col("size").desc(), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shrunk = u.where(free).select("kind", "id", "size").unionByName(met, allowMissingColumns=True)
    shrunk = shrunk.select("*", room.alias("room"), upto.alias("upto"), F.sum(length).over(w).alias("taken")).where(piece | (F.col("size") > F.col("taken")))
    shrunk = shrunk.select(
        F.when(piece, F.lit(PLACED)).otherwise(F.lit(GAP)).alias("kind"), "id", F.when(piece, F.col("size")).otherwise(F.col("size") - F.col("taken")).alias("size"),
        "seq", F.when(piece, size - F.col("room") + F.col("upto") - F.col("size")).alias("offset"),
    )
    return u.where(~free & ~(piece & (F.col("at") < F.col("depth")))).select(*names).unionByName(shrunk)


def _filled(pieces: DataFrame, n: int, size: int) -> DataFrame:
    """n pieces open sequences, in sorted order, each range its own: rows of a round, pieces placed and the gaps beside
    them. A sequence has the number of its first piece, below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, fill = 0, size
        for b in batches:
            out = []
            for pid, length in zip(b.column("id").to_pylist(), b.column("size").to_pylist(), strict=True):
                if fill + length > size:
                    if fill < size:
                        out.append((GAP, seq, size - fill, None, None))
                    seq, fill = -1 - pid, 0
                out.append((PLACED, pid, length, seq, fill))
                fill += length
            yield _rows(out, ROUND)
        yield _rows([(GAP, seq, size - fill, None, None)] if fill < size else [], ROUND)

    return _ranged(pieces.select("id", "size"), n, F.col("size").desc(), "id").mapInArrow(run, ROUND)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ARROW[kind]) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def _opened(left: DataFrame, lengths: dict[int, int], size: int) -> DataFrame:
    """Rows of a round: pieces of left that open sequences, the gaps beside them, and those still left. lengths: the counts
    of pieces by length."""
    longest = max(lengths)
    fit = size // longest
    if fit <= FEW:
        least = size // (fit + 1)
        opens, n = F.col("size") > least, sum(c for x, c in lengths.items() if x > least)
    else:
        need, n, above = -(-sum(x * c for x, c in lengths.items()) // size), 0, longest
        for x in sorted(lengths, reverse=True):
            if n + lengths[x] > need:
                break
            n, above = n + lengths[x], x - 1
        opens, one = F.col("size") > above, bool(n)
        if not n:  # the longest are more than that: so many of them, by parts of their numbers
            part = F.pmod(F.xxhash64("id"), F.lit(PARTS_OF_TIES)).cast("int")
            keep = []
            for r in sorted(left.where(F.col("size") == longest).groupBy(part.alias("part")).count().collect(), key=lambda r: (r["count"], r.part)):
                if n + r["count"] > need:
                    break
                n += r["count"]
                keep.append(r.part)
            opens, one = F.col("size") == longest, bool(n)
            if n:
                opens = opens & part.isin(keep)
        if one:  # a sequence for each
            seq, none = -1 - F.col("id"), F.lit(None).cast("long")
            placed = F.struct(F.lit(PLACED).alias("kind"), F.col("id"), F.col("size"), seq.alias("seq"), F.lit(0).cast("long").alias("offset"))
            gap = F.struct(F.lit(GAP).alias("kind"), seq.alias("id"), (size - F.col("size")).alias("size"), none.alias("seq"), none.alias("offset"))
            still = F.struct(F.lit(LEFT).alias("kind"), F.col("id"), F.col("size"), none.alias("seq"), none.alias("offset"))
            return left.select(F.inline(F.when(opens, F.array(placed, gap)).otherwise(F.array(still))))
        n = lengths[longest]
    return _filled(left.where(opens), n, size).unionByName(left.where(~opens), allowMissingColumns=True)


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces with sequence_id and offset. pieces: any DataFrame with a column length, from 1 to size.

    A round is one written table of gaps, pieces left and pieces placed, a folder for each; the first two go when the
    next round is written."""
    spark = pieces.sparkSession
    scratch = Scratch(spark)
    t = scratch.table(pieces.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    p = t.select(F.lit(LEFT).alias("kind"), F.col("pid").alias("id"), F.col("length").cast("long").alias("size"))
    own = p.where(F.col("size") > size // 2)
    gaps = own.where(F.col("size") < size).select(F.lit(GAP).alias("kind"), "id", (size - F.col("size")).alias("size"))
    ends = [size // k for k in PARTS if size // k] + [0]
    bands = [(lo, hi) for hi, lo in zip(ends, ends[1:], strict=False) if lo < hi]
    some = p.where(F.col("size") <= size // 2).groupBy(sum((F.when(F.col("size") <= lo, 1).otherwise(0) for lo, _ in bands), F.lit(0)).alias("band")).count().collect()  # a row for each band
    rounds: list[str] = []
    for band in sorted(r.band for r in some):
        lo, hi = bands[band]
        left = p.where((F.col("size") > lo) & (F.col("size") <= hi))
        while True:
            counts = gaps.where(F.col("size") > lo).unionByName(left).groupBy("kind", "size").count().collect()  # two rows for each size at most
            lengths = {r["size"]: r["count"] for r in counts if r.kind == LEFT}
            if not lengths:
                break
            n, longest = sum(lengths.values()), max(lengths)
            rooms = {r["size"]: r["count"] for r in counts if r.kind == GAP and r["size"] >= min(lengths)}
            if rooms:
                n_gaps, certain, upto = 0, 0, 0
                for room in sorted(rooms):
                    upto, n_gaps = room, n_gaps + rooms[room]
                    certain += min(room // longest, n) * rooms[room]
                    if certain >= n:
                        break
                able = F.col("size").between(min(lengths), upto)
                new = _swept(gaps.where(able), left, n, n_gaps, longest, size, scratch).unionByName(gaps.where(~able), allowMissingColumns=True)
            else:
                new = _opened(left, lengths, size).unionByName(gaps, allowMissingColumns=True)
            path = scratch_path(spark, "round")
            new.write.partitionBy("kind").parquet(path)
            scratch.drop(*scratch.tables("sweep"))
            for kind in (GAP, LEFT) if rounds else ():
                remove(spark, f"{rounds[-1]}/kind={kind}")
            rounds.append(path)
            now = spark.read.schema(ROUND).parquet(path).select("kind", "id", "size")
            gaps, left = now.where(F.col("kind") == GAP), now.where(F.col("kind") == LEFT)
    every = own.select("id", F.col("id").alias("seq"), F.lit(0).cast("long").alias("offset"))
    if rounds:  # each round places a piece at least, so each has that folder
        every = every.unionByName(spark.read.schema("id long, seq long, offset long").parquet(*(f"{r}/kind={PLACED}" for r in rounds)))
    return t.join(every.select(F.col("id").alias("pid"), F.col("seq").alias("sequence_id"), "offset"), "pid").drop("pid")


def op1(spark, sf_dir: str) -> DataFrame:
    return pack(cut(spark.read.parquet(f"{sf_dir}/documents.parquet")))
