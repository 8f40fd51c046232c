"""Frames: change detection, alignment with speech, and boxes found on them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold

# -- change detection -------------------------------------------------------------------------------------------------

#: Bounds of a change, by mean difference and by share of pixels, the tolerance of a pixel, and the least deviation.
MAGNITUDE, PROPORTION, TOLERANCE, STD_FLOOR = 6.0, 0.4, 2, 8.0


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x, lambda t: t / F.size(a))


def comparable(a: Column, b: Column) -> Column:
    return F.coalesce((F.size(a) == F.size(b)) & (F.size(a) > 0), F.lit(False))


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Infinite where the buffers can't be compared."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))
    return F.when(comparable(a, b), mean(d)).otherwise(F.lit(float("inf")))


def changed_fraction(a: Column, b: Column, tolerance: int = TOLERANCE) -> Column:
    """Share of pixels that differ by more than the tolerance; 1 where the buffers can't be compared."""
    d = F.zip_with(a, b, lambda x, y: F.when(F.abs(x - y) > tolerance, 1.0).otherwise(0.0))
    return F.when(comparable(a, b), mean(d)).otherwise(F.lit(1.0))


def variance(a: Column) -> Column:
    m, sq = mean(F.transform(a, lambda x: x.cast("double"))), mean(F.transform(a, lambda x: (x * x).cast("double")))
    return F.when(F.size(a) > 0, F.greatest(sq - m * m, F.lit(0.0))).otherwise(F.lit(0.0))


def gray_std(a: Column) -> Column:
    return F.sqrt(variance(a))


def previous(value: Column, held: Column, by: list, order: str) -> Column:
    """The last value before a row, of its group, where `held` holds."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(held, value), True).over(w)


def sharpness(gray: Column, w: int, h: int) -> Column:
    """Variance of the Laplacian of four neighbours over the inner pixels; 0 for buffers too small or too short."""
    if w < 3 or h < 3:
        return F.lit(0.0)
    at = lambda i: F.get(gray, i).cast("double")
    inner = F.array(*[F.lit(y * w + x) for y in range(1, h - 1) for x in range(1, w - 1)]) if w * h <= 400 else F.filter(F.sequence(F.lit(w + 1), F.lit(w * (h - 1) - 2)), lambda i: (i % w).between(1, w - 2))
    lap = F.transform(inner, lambda i: 4 * at(i) - at(i - 1) - at(i + 1) - at(i - w) - at(i + w))
    return F.when(F.size(gray) >= w * h, variance(lap)).otherwise(F.lit(0.0))


def downscale_gray(bgra: Column, w: int, h: int, target: int) -> Column:
    """A frame's nearest pixels at a width of at most target as luma, 299, 587 and 114 parts of red, green and blue in
    whole numbers; empty for malformed frames."""
    tw = max(min(target, w), 1)
    th = max(h * tw // w, 1) if w else 1
    pixel = lambda i: (F.floor(F.floor(i / tw) * h / th) * w + F.floor(i % tw * w / tw)) * 4
    byte = lambda i: F.get(bgra, i.cast("int"))
    out = F.transform(F.sequence(F.lit(0), F.lit(tw * th - 1)), lambda i: F.floor((byte(pixel(i) + 2) * 299 + byte(pixel(i) + 1) * 587 + byte(pixel(i)) * 114) / 1000).cast("int"))
    return F.when((F.size(bgra) >= w * h * 4) & F.lit(target > 0 and w > 0 and h > 0), out).otherwise(F.array().cast("array<int>"))


def report_errors(frames: DataFrame, by: str) -> DataFrame:
    """(by, bad_number, bad_time, ok): the first place at which a report's frame number n isn't its place (pos, from 0),
    and the first at which its time t doesn't come after the one before."""
    before = F.lag("t").over(Window.partitionBy(by).orderBy("pos"))
    f = frames.withColumn("__before", before)
    first = lambda c: F.min(F.when(c, F.col("pos")))
    g = f.groupBy(by).agg(first(F.col("n") != F.col("pos")).alias("bad_number"), first(F.col("t") <= F.col("__before")).alias("bad_time"))
    return g.withColumn("ok", F.col("bad_number").isNull() & F.col("bad_time").isNull())


def verdict(size: Column, std: Column, first: Column, magnitude: Column, fraction: Column) -> Column:
    """The gate's verdict, either measure alone sufficing for a change; bounds are exclusive."""
    changed = (magnitude > MAGNITUDE) | (fraction > PROPORTION)
    return F.when(size == 0, "indeterminate").when(std < STD_FLOOR, "blank").when(first, "first_sight").when(changed, "changed").otherwise("unchanged")


# -- alignment --------------------------------------------------------------------------------------------------------

#: Frames of a bucket that are held together.
CHUNK = 2048


def align(utterances: DataFrame, frames: DataFrame, lead_ms: int = 3000, lag_ms: int = 3000, of: Callable[[Column], dict[str, Column]] = lambda found: {"frames": found}) -> DataFrame:
    """(stream, idx, frames): for each utterance the frames from lead before its start to lag after its end, both ends
    included, in order of time and index; none gives an empty array. of: columns in place of frames, made of that array
    once for all utterances of one window.

    A band join as an equi join: each frame lies in one bucket of time, a window is dealt to the buckets that it meets,
    and a filter decides. Windows that several utterances of a stream share are answered once, and what is shuffled is
    frames and a window's pieces, never pairs; all utterances are kept after. A bucket's frames are sorted and held by
    chunks, so that no bucket is one row, however many frames it has; only chunks at a window's ends are looked through.
    A window's pieces come sorted and are gathered window by window: the last one has all before it."""
    width = lead_ms + lag_ms
    bucket = lambda c: F.floor(c / width)
    low, high = F.greatest(F.col("start_ms") - lead_ms, F.lit(0)), F.col("end_ms") + lag_ms
    u = utterances.select("stream", "idx", low.alias("low"), high.alias("high"))
    window = ["stream", "low", "high"]
    dealt = u.where("high >= low").select(*window).distinct().withColumn("bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))))
    f = frames.select("stream", bucket(F.col("at_ms")).alias("bucket"), "at_ms", F.col("idx").alias("frame"))
    place = F.row_number().over(Window.partitionBy("stream", "bucket").orderBy("at_ms", "frame"))
    f = f.withColumn("chunk", F.floor((place - 1) / CHUNK)).groupBy("stream", "bucket", "chunk")
    f = f.agg(F.min("at_ms").alias("first"), F.max("at_ms").alias("last"), F.sort_array(F.collect_list(F.struct("at_ms", "frame"))).alias("f"))
    f = f.select("stream", "bucket", "chunk", "first", "last", "f.at_ms", "f.frame")
    whole = (F.col("first") >= F.col("low")) & (F.col("last") <= F.col("high"))
    inside = F.filter("frame", lambda _, i: F.get("at_ms", i).between(F.col("low"), F.col("high")))
    pieces = f.join(dealt, ["stream", "bucket"]).where("first <= high and last >= low").select(*window, "bucket", "chunk", F.when(whole, F.col("frame")).otherwise(inside).alias("m"))
    w = Window.partitionBy(*window).orderBy("bucket", "chunk")
    found = pieces.select(*window, F.collect_list("m").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"), F.lead("chunk").over(w).isNull().alias("last")).where("last")
    met = found.select(*window, F.flatten("m").alias("m")).select(*window, *[c.alias(k) for k, c in of(F.col("m")).items()])
    none = of(F.array().cast("array<bigint>"))
    # a sort-merge join gives a window's equal long lists in a row, and Parquet's writer, which takes them for one entry of a
    # dictionary, looks at its memory again only after thousands of others
    return u.join(met.hint("shuffle_hash"), window, "left").select("stream", "idx", *[F.coalesce(k, c).alias(k) for k, c in none.items()])


# -- boxes ------------------------------------------------------------------------------------------------------------


def overlap(a: str, b: str) -> tuple[Column, Column]:
    """Width and height that boxes with these prefixes share, not below 0."""
    side = lambda p, s: F.least(F.col(f"{a}{p}") + F.col(f"{a}{s}"), F.col(f"{b}{p}") + F.col(f"{b}{s}")) - F.greatest(f"{a}{p}", f"{b}{p}")
    return F.greatest(side("x", "w"), F.lit(0)), F.greatest(side("y", "h"), F.lit(0))


def iou(a: str, b: str) -> Column:
    w, h = overlap(a, b)
    both = w * h
    return F.when(both > 0, both / (F.col(f"{a}w") * F.col(f"{a}h") + F.col(f"{b}w") * F.col(f"{b}h") - both)).otherwise(F.lit(0.0)).cast("float")


def parents(regions: DataFrame) -> DataFrame:
    """(frame_id, idx, parent): the smallest box of the same display and of no finer granularity that holds the box and
    isn't equal to it; ties go to the lowest index. Boxes of one frame meet only each other."""
    p = regions.select(*[F.col(c).alias(f"p_{c}") for c in ("frame_id", "idx", "x", "y", "w", "h", "granularity", "display_id")])
    c = F.col
    holds = (c("p_x") <= c("x")) & (c("p_y") <= c("y")) & (c("p_x") + c("p_w") >= c("x") + c("w")) & (c("p_y") + c("p_h") >= c("y") + c("h"))
    equal = (c("p_x") == c("x")) & (c("p_y") == c("y")) & (c("p_w") == c("w")) & (c("p_h") == c("h"))
    cond = (c("frame_id") == c("p_frame_id")) & (c("display_id") == c("p_display_id")) & (c("p_granularity") <= c("granularity")) & (c("idx") != c("p_idx")) & holds & ~equal
    best = F.min(F.when(c("p_idx").isNotNull(), F.struct((c("p_w") * c("p_h")).alias("area"), c("p_idx").alias("i"))))
    return regions.join(p, cond, "left").groupBy("frame_id", "idx").agg(best.alias("b")).select("frame_id", "idx", F.col("b.i").alias("parent"))


def fuse(regions: DataFrame, least: float = 0.7) -> DataFrame:
    """(frame_id, idx, sources): the boxes that stay, each with the sources of those merged into it. In order of trust, a
    box merges into the first kept one of its display and granularity with an IoU of `least` or more."""

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["trust", "idx"], ascending=[False, True], kind="stable")
        kept: list[dict] = []
        for r in rows.to_dict("records"):
            for k in kept:
                if (k["display_id"], k["granularity"]) == (r["display_id"], r["granularity"]) and _iou(k, r) >= np.float32(least):
                    k["sources"] += [r["source"]] * (r["source"] not in k["sources"])
                    break
            else:
                kept.append(r | {"sources": [r["source"]]})
        return pd.DataFrame({"frame_id": [k["frame_id"] for k in kept], "idx": [k["idx"] for k in kept], "sources": [",".join(k["sources"]) for k in kept]})

    return regions.groupBy("frame_id").applyInPandas(frame, "frame_id long, idx long, sources string")


def _iou(a: dict, b: dict) -> np.float32:
    w = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    if w <= 0 or h <= 0:
        return np.float32(0)
    return np.float32(w * h) / np.float32(a["w"] * a["h"] + b["w"] * b["h"] - w * h)


#: Boxes up to which plain lists are faster than arrays.
FEW = 32


def ordered(boxes: list[dict]) -> list[int]:
    """Indexes of boxes (x, y, w, h, display_id) as one reads them: displays apart, then bands from the top, then columns
    from the left, cut wherever a box begins past all before it; what can't be cut goes by (y, x, index)."""
    n = len(boxes)
    if n <= FEW:
        return _ordered_few(boxes)
    x, y, w, h, display = (np.array([b[c] for b in boxes], np.int64) for c in ("x", "y", "w", "h", "display_id"))
    out: list[int] = []
    todo = [np.flatnonzero(display == d) for d in np.unique(display)[::-1]]  # the next group lies on top
    while todo:
        group = todo.pop()
        for start, size, other in ((y, h, x), (x, w, y)):
            line = group[np.lexsort((group, other[group], start[group]))]
            ends = np.maximum.accumulate(start[line] + size[line])
            cuts = np.flatnonzero(start[line[1:]] >= ends[:-1]) + 1
            if len(cuts):  # bands all at once; behind the first column there may be bands again
                todo += np.split(line, cuts if start is y else cuts[:1])[::-1]
                break
        else:
            out += group[np.lexsort((group, x[group], y[group]))].tolist()
    return out if n else []


def _ordered_few(boxes: list[dict]) -> list[int]:
    """`ordered` without arrays, which cost more than they save for a few boxes."""
    x, y, w, h = ([b[c] for b in boxes] for c in "xywh")
    displays: dict = {}
    for i, b in enumerate(boxes):
        displays.setdefault(b["display_id"], []).append(i)
    out: list[int] = []
    todo = [displays[d] for d in sorted(displays, reverse=True)]
    while todo:
        group = todo.pop()
        if len(group) == 1:
            out += group
            continue
        for start, size, other in ((y, h, x), (x, w, y)):
            line = sorted(group, key=lambda i: (start[i], other[i], i))  # noqa: B023
            end, cuts = start[line[0]] + size[line[0]], [0]
            for n, i in enumerate(line[1:], 1):
                if start[i] >= end and (start is y or len(cuts) < 2):
                    cuts.append(n)
                end = max(end, start[i] + size[i])
            if len(cuts) > 1:
                todo += [line[a:b] for a, b in zip(cuts, [*cuts[1:], len(line)], strict=True)][::-1]
                break
        else:
            out += sorted(group, key=lambda i: (y[i], x[i], i))
    return out


class _Reading:
    """A frame's boxes, in order of idx, and at its end their places."""

    def __init__(self):
        self.rows: list[dict] = []

    def step(self, *values):
        self.rows.append(dict(zip(("idx", "x", "y", "w", "h", "display_id", "parent"), values, strict=True)))
        return []

    def end(self):
        ids = {r["idx"]: r for r in self.rows}
        below: dict = {}
        for r in self.rows:
            p = r["parent"]
            below.setdefault(p if p in ids and p != r["idx"] else None, []).append(r)
        out, seen, todo = [], set(), []

        def push(group: list[dict]) -> None:
            todo.extend(group[i] for i in reversed(ordered(group)))

        push(below.get(None, []))
        while todo:
            r = todo.pop()
            if r["idx"] not in seen:
                seen.add(r["idx"])
                out.append(r["idx"])
                push(below.get(r["idx"], []))
        out += [r["idx"] for r in self.rows if r["idx"] not in seen]
        return [(i, place) for place, i in enumerate(out)]


def reading_order(regions: DataFrame) -> DataFrame:
    """(frame_id, idx, place): parents before their children, siblings as `ordered`; every box once, even in a cycle.
    regions: with a column parent (an idx or null)."""
    r = regions.select("frame_id", "idx", "x", "y", "w", "h", "display_id", "parent")
    return ordered_fold(r, ["frame_id"], ["idx"], _Reading, "frame_id long, idx long, place long")


def clipped(x: Column, y: Column, w: Column, h: Column, cx: int, cy: int, cw: int, ch: int) -> tuple[Column, ...]:
    """A box cut to a rectangle and moved into it; w and h are 0 or less if nothing is left."""
    left, top = F.greatest(x, F.lit(cx)), F.greatest(y, F.lit(cy))
    return left - cx, top - cy, F.least(x + w, F.lit(cx + cw)) - left, F.least(y + h, F.lit(cy + ch)) - top


# -- reading ----------------------------------------------------------------------------------------------------------

SIDECAR = "array<struct<idx:bigint,x:bigint,y:bigint,w:bigint,h:bigint,display_id:bigint>>"


def sidecar_regions(text: Column) -> Column:
    """A sidecar's boxes; null if it is missing or can't be read, which is not the same as empty."""
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, SIDECAR))


def routed(calls: DataFrame, key: str, order: list[str], budget: int) -> DataFrame:
    """calls (tier text or reason, reason, ...) with served (the tier, or why it was refused) and escalation (the reason
    of a reasoning call that was served). A call without a reason for reasoning is refused and costs nothing; of the
    others the first `budget` of a key are served."""
    valid = (F.col("tier") == "text") | (F.trim(F.coalesce("reason", F.lit(""))) != "")
    spent = F.sum(F.when(valid, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(*order))
    served = F.when(~valid, "refused:no_reason").when(spent > budget, "refused:budget").otherwise(F.col("tier"))
    c = calls.withColumn("served", served)
    return c.withColumn("escalation", F.when(F.col("served") == "reason", F.col("reason")))


def ladder(samples: DataFrame, texts: DataFrame, display: int, most: int, budget: int) -> DataFrame:
    """For each segment: samples, outcome (read, or refused where samples x most + 1 calls exceed the budget), calls,
    read_whole and text. samples: (segment, frame_id, sidecar); texts: (frame_id, idx, text), what reading a box gives.

    Of a frame's boxes the first `most` count, and of those the display's own are read; a frame without a sidecar, or
    without a box to read, is read whole and counted, one whose sidecar is empty is read whole as it should be."""
    s = samples.withColumn("r", sidecar_regions(F.col("sidecar")))
    own = F.filter(F.slice(F.coalesce("r", F.array().cast(SIDECAR)), 1, most), lambda b: b["display_id"] == display)
    s = s.withColumn("crops", own).withColumn("whole", F.size(own) == 0).withColumn("lost", F.col("whole") & F.coalesce(F.size("r") > 0, F.lit(True)) & (F.col("r").isNull() | (F.size("r") > 0)))
    crops = s.select("frame_id", F.explode("crops").alias("b")).select("frame_id", "b.idx").join(texts, ["frame_id", "idx"])
    mark = "\n---\n"
    parts = lambda order, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), mark)
    read = crops.groupBy("frame_id").agg(parts("idx", "text").alias("text"))  # `most` boxes
    s = s.join(read, "frame_id", "left").withColumn("text", F.coalesce("text", F.concat(F.lit("whole:"), F.col("frame_id").cast("string"))))
    n = F.count(F.lit(1))
    fits = n * max(most, 1) + 1 <= budget
    return s.groupBy("segment").agg(
        n.alias("samples"), F.when(fits, "read").otherwise("refused").alias("outcome"), F.when(fits, F.sum(F.greatest(F.size("crops"), F.lit(1))) + 1).alias("calls"),
        F.when(fits, F.count_if("lost")).alias("read_whole"), F.when(fits, parts("frame_id", "text")).alias("text"),
    )
