"""Text rules: cleaning, parsing of model replies, similarity, and the folding of readings into blocks."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..operators.folds import ordered_fold, pieces

#: Control characters, line separators and the marks that change direction.
CONTROLS = r"[\p{Cc}  ‪-‮⁦-⁩]"
#: The categories of an activity.
CATEGORIES = ("coding", "docs", "comms", "browsing", "meeting", "idle", "other")

#: Words of a request that say nothing about its target.
STOP_WORDS = (
    "focus", "the", "please", "show", "watch", "look", "into", "that", "this", "onto", "lock",
    "grab", "zoom", "capture", "panel", "pane", "window", "region", "screen", "view", "part",
    "section", "area", "thing", "side", "left", "right", "top", "bottom", "middle", "center",
    "centre", "upper", "lower", "first", "second", "third", "fourth", "fifth",
)


def flatten(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, " ")


def strip_reasoning(text: Column) -> Column:
    """What follows the last </think>, or the whole text if that is nothing; trimmed."""
    rest = F.trim(F.substring_index(text, "</think>", -1))
    return F.when(rest != "", rest).otherwise(F.trim(text))


def extract_json(text: Column) -> Column:
    """From the first brace to the last; null without both in order."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def category_from(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(*CATEGORIES), low).otherwise("other")


def chunk_summary(text: Column) -> Column:
    """(category, app, activity, detail) of a reply: its JSON's fields, missing ones empty, or without JSON an activity
    of the first 80 characters and all of it as detail."""
    json = extract_json(text)
    ok = F.try_parse_json(json).isNotNull()
    field = lambda k: F.coalesce(F.get_json_object(json, f"$.{k}"), F.lit(""))
    read = F.struct(category_from(field("category")).alias("category"), *[field(k).alias(k) for k in ("app", "activity", "detail")])
    return F.when(ok, read).otherwise(F.struct(F.lit("other").alias("category"), F.lit("").alias("app"), F.substring(text, 1, 80).alias("activity"), text.alias("detail")))


def session_digest(chunks: DataFrame, by: str, order: str) -> DataFrame:
    """(by, digest) of chunks (by, order, s, e, category, activity), times in microseconds; a line for each, in order."""
    at = lambda c: F.date_format(F.timestamp_micros(c), "HH:mm")
    line = F.concat(F.lit("- "), at("s"), F.lit("–"), at("e"), F.lit(": ["), "category", F.lit("] "), "activity")
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("t")))), lambda x: x["t"]), "\n")  # a session's chunks
    return chunks.groupBy(by).agg(F.concat(F.lit("Session digest ("), F.count(F.lit(1)).cast("string"), F.lit(" chunks):\n"), rows).alias("digest"))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of token arrays as sets; two empty ones are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def distinct_ratio(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.size(F.array_distinct(items)) / F.size(items)).otherwise(F.lit(0.0))


def content_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n"), lambda x: F.btrim(x)), lambda x: x != "")


def content_words(text: Column) -> Column:
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (F.octet_length(w) > 2) & ~w.isin(*STOP_WORDS))


def redact(text: Column) -> Column:
    """Values of key= and tokens that begin as API keys do."""
    return F.regexp_replace(F.regexp_replace(text, r"key=[0-9A-Za-z_-]*", "key=<redacted>"), r"AIza[0-9A-Za-z_-]*", "<redacted>")


def is_uuid4(text: Column) -> Column:
    return text.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9]", "_")


def line_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; two empty lines are alike."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


# -- readings of a screen that scrolls --------------------------------------------------------------------------------

#: Blocks that a reading is compared with, the coverage from which it joins one, and the share of the frame
#: from which only the frame counts.
HISTORY, SAME_BLOCK, STABLE = 5, 0.65, 0.9


def lines(text: str) -> list[str]:
    parts = [x.removesuffix("\r") for x in text.split("\n")]
    return parts[:-1] if parts[-1] == "" else parts


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance of two texts, or a number above `most` if it is larger than that; only cells that near the diagonal
    are looked at."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row.get(j, most) + 1, new.get(j - 1, most) + 1, row.get(j - 1, most + 1) + (x != b[j - 1]))
        if min(new.values(), default=most + 1) > most:
            return most + 1
        row = new
    return row.get(len(b), most + 1)


def same_line(a: str, b: str, least: float = 1.0) -> bool:
    """Whether two lines are the same but for blanks around them, or have a line similarity of `least`."""
    a, b = a.strip(), b.strip()
    if a == b or least >= 1:
        return a == b
    longest = max(len(a), len(b))
    most = next((d for d in range(math.ceil((1 - least) * longest) + 1, -1, -1) if 1 - d / longest >= least), -1)
    if abs(len(a) - len(b)) > most or sum((Counter(a) - Counter(b)).values()) > most:
        return False
    return 1 - _distance(a, b, most) / longest >= least


@dataclass(frozen=True)
class Overlap:
    """How a reading lies over a block: the lines of both; how many are the same at the top and at the bottom, the frame
    that stays while the middle scrolls; and the longest run of lines between that both have, where it begins in the
    reading's middle, and its length (of equal runs the first in the block)."""

    old: list[str]
    new: list[str]
    top: int
    end: int
    start: int
    run: int

    @property
    def added(self) -> list[str]:
        """The reading's lines between top and bottom."""
        return self.new[self.top : len(self.new) - self.end]

    @property
    def coverage(self) -> float:
        """How much of the reading the block holds already."""
        frame, n = self.top + self.end, len(self.new)
        if n == 0:
            return 0.0
        whole = frame == n or 0 < len(self.old) == frame
        return 1.0 if whole else frame / n if frame / n >= STABLE else self.run / (n - frame)

    def merged(self) -> list[str]:
        """The block with what the reading adds to it, above the lines that stay at the bottom."""
        cut = len(self.old) - self.end
        return self.old[:cut] + self.added[: self.start] + self.added[self.start + self.run :] + self.old[cut:]


def _matches(old: list[str], new: list[str], like: float) -> Callable[[str], np.ndarray]:
    """For a line of the old ones, the places of the same lines among the new ones, ascending."""
    places: dict[str, list[int]] = {}
    for i, x in enumerate(new):
        places.setdefault(x, []).append(i)
    none = np.empty(0, np.int64)
    if like >= 1:
        found = {x: np.array(places[x], np.int64) for x in set(old) & set(places)}
    else:
        found = {x: np.sort(np.array([i for y, at in places.items() if same_line(x, y, like) for i in at], np.int64)) for x in set(old)}
    return lambda x: found.get(x, none)


def overlap(block: str, reading: str, like: float = 1.0) -> Overlap:
    """Two rows of lengths and the places of equal lines: memory grows with the lines, not with their pairs."""
    old, new = lines(block), lines(reading)
    a, b = [x.strip() for x in old], [x.strip() for x in new]
    same = (lambda x, y: x == y) if like >= 1 else (lambda x, y: same_line(x, y, like))
    leading = lambda pairs: sum(1 for _ in takewhile(lambda p: same(*p), pairs))
    top = leading(zip(a, b, strict=False))
    end = leading(zip(reversed(a[top:]), reversed(b[top:]), strict=False))
    a, b = a[top : len(a) - end], b[top : len(b) - end]
    at = _matches(a, b, like)
    last, length, best, start = np.empty(0, np.int64), np.zeros(len(b) + 1, np.int64), 0, 0  # of the runs that end at a line of the block and each of the reading
    for x in a:
        here = at(x)
        run = length[here] + 1
        length[last + 1] = 0
        length[here + 1] = run
        last = here
        if len(run) and (n := int(run.max())) > best:
            best, start = n, int(here[run.argmax()]) + 1 - n
    return Overlap(old, new, top, end, start, best)


def coverage(block: str, reading: str, like: float = 1.0) -> float:
    return overlap(block, reading, like).coverage


def merge(block: str, reading: str, like: float = 1.0) -> str:
    o = overlap(block, reading, like)
    return "\n".join(o.merged()) if o.added else block


def with_overlaps(pairs: DataFrame, like: float = 1.0) -> DataFrame:
    """pairs (..., block, text) with coverage and merged, of each text as a reading over its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole)):
            covered, merged = [], []
            for x, y in zip(b.column("block").to_pylist(), b.column("text").to_pylist(), strict=True):
                o = overlap(x or "", y or "", like)
                covered.append(o.coverage)
                merged.append("\n".join(o.merged()) if o.added else x or "")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(covered, pa.float64()), pa.array(merged, pa.string())], [*b.schema.names, "coverage", "merged"])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("coverage", DoubleType()), StructField("merged", StringType())]))


def absorb(blocks: list[str], reading: str, like: float = 1.0) -> int:
    """Adds a reading to the latest blocks' best match, of equal ones the last, or as a block; says which."""
    place = {i: overlap(blocks[i], reading, like) for i in range(max(0, len(blocks) - HISTORY), len(blocks))} if reading.strip() else {}
    best = max(place, key=lambda i: (place[i].coverage, i), default=None)
    if best is None or place[best].coverage < SAME_BLOCK:
        blocks.append(reading)
        return len(blocks) - 1
    if place[best].added:
        blocks[best] = "\n".join(place[best].merged())
    return best


class _Blocks:
    """A stream's blocks; one that no further reading can join is given out."""

    def __init__(self, like: float):
        self.like, self.blocks, self.gone = like, [], 0

    def step(self, seq, text):
        absorb(self.blocks, text or "", self.like)
        more = len(self.blocks) - HISTORY
        out = [(self.gone + i, b) for i, b in enumerate(self.blocks[: max(more, 0)])]
        self.gone, self.blocks = self.gone + len(out), self.blocks[len(out) :]
        return out

    def end(self):
        return [(self.gone + i, b) for i, b in enumerate(self.blocks)]


def blocks_of(readings: DataFrame, like: float = 1.0) -> DataFrame:
    """(stream_id, block, text): the readings (stream_id, seq, text) of each stream folded in order. like: the line
    similarity from which lines are the same, 1 for equal ones; blanks around lines never count."""
    if not 0 < like <= 1:
        raise ValueError(f"like must be in (0, 1], got {like}")
    return ordered_fold(readings.select("stream_id", "seq", "text"), ["stream_id"], ["seq"], lambda: _Blocks(like), "stream_id long, block long, text string")


class _Repeats:
    def __init__(self, limit: float):
        self.limit, self.last = limit, None

    def step(self, seq, text):
        words = set((text or "").split())
        if not words or self.last is not None and len(words & self.last) / len(words | self.last) > self.limit:
            return []
        self.last = words
        return [(seq,)]

    def end(self):
        return []


def drop_repeats(readings: DataFrame, limit: float = 0.85) -> DataFrame:
    """(stream_id, seq) of the readings to keep: blank ones go, and those whose tokens are too like the last kept one's."""
    return ordered_fold(readings.select("stream_id", "seq", "text"), ["stream_id"], ["seq"], lambda: _Repeats(limit), "stream_id long, seq long")


# -- quality ----------------------------------------------------------------------------------------------------------

#: The window, the shortest and longest copy, the candidates looked at, and the bits that a copy costs.
WINDOW, SHORTEST, LONGEST, CHAIN, COPY_BITS = 32 * 1024, 3, 258, 128, 24.0


def compression(data: bytes) -> float:
    """Estimated share to which bytes compress: each is a literal at the bytes' entropy, or part of a copy of what came
    before, where a copy of at least three bytes from the window is the cheaper."""
    n = len(data)
    if not n:
        return 0.0
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    share = share[share > 0]
    literal = float(-(share * np.log2(share)).sum())
    costs = np.full(n, literal)  # of each byte, in the order in which they are added
    for i, length in _copies(data, literal):
        costs[i], costs[i + 1 : i + length] = COPY_BITS, 0.0
    return float(np.cumsum(costs)[-1]) / 8 / n


def _grams(data: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the m-grams (m up to 8) of some bytes in order of gram and place, and whether each but the first has
    the same gram as the one before."""
    codes = np.zeros(max(len(data) - m + 1, 0), np.uint64)
    for k in range(m):
        codes = codes << np.uint64(8) | data[k : k + len(codes)]
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    return order, codes[1:] == codes[:-1]


def _copies(data: bytes, literal: float) -> Iterator[tuple[int, int]]:
    """(place, length) of the copies, from left to right. A place is compared with the last CHAIN earlier ones with its
    first SHORTEST bytes, but only those of them with as many equal bytes (up to 8) as make a copy the cheaper are looked
    at: no other can become a copy."""
    n, least = len(data), SHORTEST
    while least <= LONGEST and not COPY_BITS < least * literal:
        least += 1
    if least > min(LONGEST, n):
        return
    raw = np.frombuffer(data, np.uint8)
    order, same = _grams(raw, SHORTEST)
    at = np.arange(len(order))
    number = np.empty(len(order), np.int64)  # which occurrence of its first bytes a place is
    number[order] = at - np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))
    order, same = _grams(raw, min(least, 8))
    before = np.full(len(order), -1, np.int64)  # the last place with the same bytes
    before[order[1:][same]] = order[:-1][same]
    places = np.flatnonzero(before >= 0)
    near = before[places]
    places = places[(places - near <= WINDOW) & (number[places] - number[near] <= CHAIN)]
    before, number, end = before.tolist(), number.tolist(), 0
    for i in places.tolist():
        most = min(n - i, LONGEST)
        if i < end or most < least:
            continue
        best, c, first, oldest = 0, before[i], i - WINDOW, number[i] - CHAIN
        while c >= 0 and c >= first and number[c] >= oldest and best < most:
            if not best or data[c + best] == data[i + best]:  # else it can't be longer than the best
                low, high = (best if data[c : c + best] == data[i : i + best] else 0), most
                while low < high:  # the longest common beginning, by halves
                    half = (low + high + 1) // 2
                    low, high = (half, high) if data[c : c + half] == data[i : i + half] else (low, half - 1)
                best = max(best, low)
            c = before[c]
        if best >= least:
            yield i, best
            end = i + best


def quality(texts: DataFrame, key: str) -> DataFrame:
    """(key, compression, lines, tokens) of texts (key, text): estimated compression, and the distinct shares of lines
    without the blanks around them and of tokens; all zero for a blank text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole)):
            found = [compression(t.encode("utf-8", "surrogatepass")) if t and t.strip() else 0.0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, "compression"])

    t = texts.select(key, "text")
    t = t.mapInArrow(run, StructType([*t.schema.fields, StructField("compression", DoubleType())]))
    text = F.coalesce("text", F.lit(""))
    return t.select(key, "compression", distinct_ratio(content_lines(text)).alias("lines"), distinct_ratio(tokens(text)).alias("tokens"))
