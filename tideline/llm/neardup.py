"""MinHash banding, exact verification within bands and distributed union-find, for documents and for lines.

Items are distinct sets (equal ones are collapsed before). An item's band keys are range-sorted, so that a band shared by
many spreads over ranges; bands that exactly the same items share are one, the first. The items of a band are verified
on their full sets, in groups of pairs of blocks where the band is large. A pair that shares several bands is verified
in the first of them, so that each link is found once, and every pair that shares a band is verified, whatever else hangs
on its items. A group returns one row per linked item: how many items it links to there, and its root in a union-find
over the group's links. The roots are joined by a distributed union-find. No pair is ever a row."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup_join

#: A similarity of 0.8 or more links, as a fraction so that it is exact.
NUM, DEN = 4, 5
#: Items and bytes of text of a block, about.
BLOCK_ITEMS = 2048
BLOCK_BYTES = 8 << 20
#: Items and bytes of text of a verifying task, about.
TASK_ITEMS = 20_000
TASK_BYTES = 16 << 20
#: Groups of so many items or fewer are verified together.
FEW = 8
#: Bits of an element's code, and so many owners or pairs as fit above it.
CODE_BITS = 52
OWNERS = 1 << (64 - CODE_BITS)
#: Elements of pairs that are compared at once.
TOGETHER = 1 << 18
#: Bits of a band key below its band's number.
KEY_BITS = 56

#: The sets of texts: their elements as codes, sorted and end to end, and where each set begins, with the end of the last.
#: Codes mean the same throughout one call.
Sets = tuple[np.ndarray, np.ndarray]


def banding(similarity: float, recall: float, most: int) -> tuple[int, int]:
    """Bands and rows: the most rows for which bands that reach the recall at the similarity need `most` hashes or fewer."""
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(items, bands) keys of signatures (items, at least bands * rows): the band's number, from 1, above a hash."""
    cut = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    key = np.zeros(cut.shape[:2], np.uint64)
    for j in range(rows):
        key = mix64(key ^ cut[:, :, j]) + np.uint64(j)
    number = np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(KEY_BITS)
    return (key >> np.uint64(64 - KEY_BITS) | number).view(np.int64)


def coded(values: np.ndarray, owner: np.ndarray, n: int) -> Sets:
    """The sets of n owners from their elements (64-bit hashes), in any order and with repeats. Codes are the upper bits
    of the hashes, or for very many owners their ranks."""
    if n > OWNERS:
        distinct, code = np.unique(values, return_inverse=True)
        both = np.unique(owner * len(distinct) + code)
        return (both % max(len(distinct), 1)).astype(np.uint64), np.searchsorted(both, np.arange(n + 1) * len(distinct))
    both = np.sort(owner.astype(np.uint64) << np.uint64(CODE_BITS) | values >> np.uint64(64 - CODE_BITS))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    sizes = np.bincount((both >> np.uint64(CODE_BITS)).astype(np.int64), minlength=n)
    return both & np.uint64((1 << CODE_BITS) - 1), np.concatenate([[0], np.cumsum(sizes)])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's edges (a, b) as edges from the smallest node to each one that they connect it to."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of edges (a, b): roots are equal iff nodes are connected.

    Tasks first contract the edges that they hold, dealt in ranges by one end, then by the other; a node with many edges
    spreads over ranges. Each round then hooks every node to its smallest neighbour, jumps pointers once, and contracts
    the edges; it ends when no edge is left. All steps are joins and pre-aggregated groupings on narrow rows, each
    written to the shared folder; the joins salt nodes with many edges."""
    e = scratch.table(edges.where(F.col("a") != F.col("b")).select("a", "b"), "edges")
    for first, second in ("ab", "ba"):
        new = scratch.table(e.repartitionByRange(first, second).mapInArrow(_contract, "a long, b long").where("a != b"), "edges")
        scratch.drop(e)
        e = new
    labels = None
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), "hooks")
        jump = lookup_join(up, up.select(F.col("a").alias("p"), F.col("p").alias("q")), "p", F.col("a"))
        jump = scratch.table(jump.select("a", F.coalesce("q", "p").alias("p")), "jumps")
        if labels is None:
            labels = scratch.table(jump.select(F.col("a").alias("node"), F.col("p").alias("root")), "labels")
        else:
            step = lookup_join(labels, jump.select(F.col("a").alias("root"), F.col("p").alias("__p")), "root", F.col("node"))
            new = scratch.table(step.select("node", F.coalesce("__p", "root").alias("root")), "labels")
            scratch.drop(labels)
            labels = new
        left = lookup_join(e, jump.select("a", F.col("p").alias("pa")), "a", F.col("b"))
        left = lookup_join(left, jump.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b", F.col("a"))
        new = scratch.table(left.where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        scratch.drop(up, jump, e)
        e = new
        if e.isEmpty():
            scratch.drop(e)
            return labels


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 2048) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of batches sorted by keys, tables of whole groups of about so many rows or of one group, and where each group
    begins, with the table's end."""
    held: list[pa.RecordBatch] = []
    last = None

    def cut() -> Iterator[tuple[pa.Table, np.ndarray]]:
        t = pa.Table.from_batches(held).combine_chunks()
        k = np.stack([t.column(n).to_numpy() for n in keys], axis=1)
        ends = np.concatenate([np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]])
        at, done = 0, 0
        while at < len(k):
            upto = max(np.searchsorted(ends, at + rows, side="right"), done + 1)
            yield t.slice(at, ends[upto - 1] - at), np.concatenate([[0], ends[done:upto] - at])
            at, done = ends[upto - 1], upto

    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in keys], axis=1)
        new = np.concatenate([[last is not None and (k[0] != last).any()], (k[1:] != k[:-1]).any(axis=1)])
        last = k[-1]
        if new.any():
            start = np.flatnonzero(new)[-1]
            held.append(batch.slice(0, start))
            yield from cut()
            held = [batch.slice(start)]
        else:
            held.append(batch)
    if held:
        yield from cut()


def _verify(batches: Iterator[pa.RecordBatch], decode: Callable[[list[str]], Sets], rows: int) -> Iterator[pa.RecordBatch]:
    for t, cuts in whole_groups(batches, ["band", "x", "y"], rows):
        found = []
        if t.num_rows > 1:
            k, weight, block, band = (t.column(n).to_numpy() for n in ("k", "weight", "block", "band"))
            shared = t.column("bands").combine_chunks()
            shared, at = shared.flatten().to_numpy(), shared.offsets.to_numpy() - shared.offsets[0].as_py()
            codes, starts = decode(t.column("text").to_pylist())
            earlier = lambda i: shared[at[i] : at[i + 1]][shared[at[i] : at[i + 1]] < band[i]]
            found.append(_few(k, weight, block, earlier, (shared[at[:-1]] < band), cuts, codes, starts))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > FEW and (got := _group(k[a:b], weight[a:b], block[a:b], [earlier(i) for i in range(a, b)], codes, starts[a : b + 1])) is not None:
                    found.append(got)
        cols = [np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["k", "links", "root"])


def _few(k: np.ndarray, weight: np.ndarray, block: np.ndarray, earlier: Callable[[int], np.ndarray], some: np.ndarray, cuts: np.ndarray, codes: np.ndarray, starts: np.ndarray):
    """Links within the groups of few items: two rows for each. some: whether an item has earlier bands."""
    first, n = cuts[:-1], np.diff(cuts)
    across = np.logical_or.reduceat(block != np.repeat(block[first], n), first)
    size = np.diff(starts)
    i, j = (np.concatenate(x) for x in zip(*[[(first[n == m, None] + side).ravel() for side in np.triu_indices(m, 1)] for m in range(2, FEW + 1)], strict=True))
    less, more = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    mixed = np.repeat(across, n)[i]
    keep = (k[i] != k[j]) & (NUM * more <= DEN * less) & ~(mixed & (block[i] == block[j]))
    for x in np.flatnonzero(keep & some[i] & some[j]):
        keep[x] = set(earlier(i[x]).tolist()).isdisjoint(earlier(j[x]).tolist())
    i, j = i[keep], j[keep]
    both = size[i] + size[j]
    part = np.maximum(np.cumsum(both) // TOGETHER, np.arange(len(i)) // (OWNERS // 2))
    hit = np.zeros(len(i), bool)
    for a, b in zip(ends := [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(i)], ends[1:], strict=False):
        if a == b:
            continue
        rows = np.stack([i[a:b], j[a:b]], axis=1).ravel()
        length = size[rows]
        at = np.repeat(starts[rows] - np.cumsum(length) + length, length) + np.arange(length.sum())
        keys = np.sort(codes[at] | np.repeat(np.repeat(np.arange(b - a, dtype=np.uint64), 2) << np.uint64(CODE_BITS), length))
        twice = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(CODE_BITS)
        shared = np.bincount(twice.astype(np.int64), minlength=b - a)
        hit[a:b] = DEN * shared >= NUM * (both[a:b] - shared)
    i, j = i[hit], j[hit]
    return np.concatenate([k[i], k[j]]), np.concatenate([weight[j], weight[i]]), np.concatenate([k[i], k[i]])


def _group(k: np.ndarray, weight: np.ndarray, block: np.ndarray, earlier: list[np.ndarray], codes: np.ndarray, starts: np.ndarray):
    """Links among the many items of a pair of blocks: a row for each item that has some. Within
    a block if there is one, else only across; of pairs that share no earlier band."""
    _, first = np.unique(k, return_index=True)
    size = np.diff(starts)
    order = first[np.argsort(size[first], kind="stable")]
    k, weight, block, size = k[order], weight[order], block[order], size[order]
    across = len(np.unique(block)) > 1
    _, own = np.unique(np.concatenate([codes[starts[i] : starts[i + 1]] for i in order]), return_inverse=True)
    ends = np.cumsum(size)
    begin = ends - size
    mark = np.zeros(int(own.max(initial=0)) + 1, bool)
    before = np.zeros((len(k), 1 + max((int(earlier[i][-1] >> KEY_BITS) for i in order if len(earlier[i])), default=0)), np.int64)
    for row, i in enumerate(order):
        before[row, earlier[i] >> KEY_BITS] = earlier[i]
    links, parent = np.zeros(len(k), np.int64), np.arange(len(k))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = np.searchsorted(size, size * DEN // NUM, side="right")  # a larger set can't be similar
    for i in range(len(k) - 1):
        j = reach[i]
        if j <= i + 1:
            continue
        cols = np.flatnonzero(before[i])
        open_ = ~(before[i + 1 : j, cols] == before[i, cols]).any(axis=1)
        if across:
            open_ &= block[i + 1 : j] != block[i]
        todo = np.flatnonzero(open_) + i + 1
        if not len(todo):
            continue
        mark[own[begin[i] : ends[i]]] = True
        if 4 * len(todo) > j - i:
            shared = np.add.reduceat(mark[own[begin[i + 1] : ends[j - 1]]].astype(np.int32), begin[i + 1 : j] - begin[i + 1])[todo - i - 1]
        else:
            shared = np.array([np.count_nonzero(mark[own[begin[m] : ends[m]]]) for m in todo])
        mark[own[begin[i] : ends[i]]] = False
        hit = todo[DEN * shared >= NUM * (size[i] + size[todo] - shared)]
        for m in hit:
            a, b = find(i), find(m)
            parent[max(a, b)] = min(a, b)
        links[i] += weight[hit].sum()
        links[hit] += weight[i]
    some = np.flatnonzero(links)
    return (k[some], links[some], k[[find(i) for i in some]]) if len(some) else None


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by band: those whose band has another row in this range, and all of the range's first and last
    band, which may go on in other ranges."""
    held: pa.RecordBatch | None = None  # the last row so far
    keep = True  # whether it is wanted, whatever follows
    for x in batches:
        if not x.num_rows:
            continue
        rows = pa.Table.from_batches([x] if held is None else [held, x]).combine_chunks().to_batches()[0]
        band = rows.column("band").to_numpy()
        same = band[1:] == band[:-1]
        wanted = np.zeros(len(band), bool)
        wanted[0] = keep
        wanted[1:] |= same
        wanted[:-1] |= same
        held, keep = rows.slice(len(band) - 1), bool(wanted[-1])
        if (at := np.flatnonzero(wanted[:-1])).size:
            yield rows.take(pa.array(at))
    if held is not None:
        yield held


def minhash(grams: np.ndarray, hashes: int) -> np.ndarray:
    """The least value of a set under each of so many hash functions."""
    a = mix64(np.arange(1, hashes + 1, dtype=np.uint64)) | np.uint64(1)
    b = mix64(np.arange(1001, 1001 + hashes, dtype=np.uint64))
    sig = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 2048):
        np.minimum(sig, (a[:, None] * grams[None, i : i + 2048] + b[:, None]).min(axis=1), out=sig)
    return sig


def _members(items: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(k, bands) of the items (k, bands) that share a band with another: the bands that they share, of those with the
    same items the first; and the number of these bands in all."""
    rows = items.select("k", F.explode("bands").alias("band")).repartitionByRange("band", "k").sortWithinPartitions("band", "k")
    rows = scratch.table(rows.mapInArrow(_shared, "k long, band long"), "shared_bands")
    of = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("k")).alias("one"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("two"))
    kept = scratch.table(of.where("n > 1").groupBy("n", "one", "two").agg(F.min("band").alias("band")).select("band", "n"), "bands")
    n = kept.agg(F.sum("n")).first()[0] or 0
    members = lookup_join(rows, kept, "band", F.col("k")).where("n is not null").groupBy("k").agg(F.sort_array(F.collect_list("band")).alias("bands"))
    out = scratch.table(members, "members")
    scratch.drop(rows, kept)
    return out, n


def similar(items: DataFrame, load: Callable[[DataFrame, int], DataFrame], decode: Callable[[list[str]], Sets], scratch: Scratch, rows: int = 2048) -> DataFrame:
    """(k, links, root) of every item that is similar to another: links sums the weights of the items it is similar
    to, and root is the same throughout a component.

    items: a written table (k long, bands array<long>, weight long, ...), k unique. load: takes the items that share
    bands, bands being those, with the bytes of these arrays in all, and gives (k, bands, weight, text). rows: items
    whose sets a task decodes at once, about, where no group holds more."""
    members, n = _members(items, scratch)
    wanted = scratch.table(items.drop("bands").join(members, "k"), "candidates")
    sets = scratch.table(load(wanted, 8 * n), "sets")
    if sets.count() > wanted.count():  # rows that repeat an id and a text
        sets = scratch.table(sets.dropDuplicates(["k"]), "sets")
    each = sets.select(F.explode("bands").alias("band"), F.octet_length("text").cast("long").alias("bytes"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ITEMS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    large = scratch.table(each.groupBy("band").agg(blocks.alias("blocks")).where("blocks > 1"), "large_bands")
    tasks = max(1, -(-n // TASK_ITEMS), -(-(each.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES))
    spread = lookup_join(sets.withColumn("band", F.explode("bands")), large, "band", F.col("k")).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("band", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", "k", "weight", "bands", "text")
    spread = spread.repartition(tasks, "band", "x", "y").sortWithinPartitions("band", "x", "y")
    found = scratch.table(spread.mapInArrow(lambda b: _verify(b, decode, rows), "k long, links long, root long"), "links")
    roots = connected_components(found.select(F.col("k").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("k").agg(F.sum("links").alias("links"), F.min("root").alias("own"))
    out = links.join(roots.withColumnRenamed("node", "k"), "k", "left").select("k", "links", F.coalesce("root", "own").alias("root"))
    out = scratch.table(out, "similar")
    scratch.drop(members, wanted, sets, large, found, roots)
    return out
