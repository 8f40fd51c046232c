"""Raw frames: binary BGRA buffers with width, height and stride beside them, and what is measured on them.

A frame is four columns: w, h, stride (bytes of a row, padding included) and data. Functions that need its bytes take
whole Arrow batches and look at the buffers in place; what follows from their short results (profiles, cells, shifts) is
column work, joins and grouping. Malformed frames give null, and `frame_error` says why."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a tile over all frames of its burst, about; it decides how large tiles are.
TILE_BYTES = 32 << 20
#: The largest side of a tile, in pixels.
TILE = 256

# -- buffers ----------------------------------------------------------------------------------------------------------


def _each(w: pa.Array, h: pa.Array, stride: pa.Array, data: pa.Array) -> Iterator[tuple[int, int, int, np.ndarray] | None]:
    """Width, height, stride and bytes of each frame, without a copy; None where one of them is null."""
    at, raw = np.frombuffer(data.buffers()[1], np.int64 if pa.types.is_large_binary(data.type) else np.int32), data.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8)
    for i, x in enumerate(zip(w.to_pylist(), h.to_pylist(), stride.to_pylist(), data.is_valid().to_pylist(), strict=True)):
        yield None if None in x or not x[3] else (*x[:3], raw[at[data.offset + i] : at[data.offset + i + 1]])


def _pixels(w: int, h: int, stride: int, raw: np.ndarray) -> np.ndarray | None:
    """(h, w, 4) view of a frame, or None if it is malformed."""
    if w <= 0 or h <= 0 or stride < 4 * w or len(raw) < stride * h:
        return None
    return np.ndarray((h, w, 4), np.uint8, raw[: stride * h], strides=(stride, 4, 1))


def _of_frames(f: Callable, kind: T.DataType, arrow: pa.DataType) -> Callable[[Column, Column, Column, Column], Column]:
    """A column of f(pixels) for well-formed frames, null for others."""

    @F.arrow_udf(kind)
    def run(w: pa.Array, h: pa.Array, stride: pa.Array, data: pa.Array) -> pa.Array:
        views = (x and _pixels(*x) for x in _each(w, h, stride, data))
        return pa.array([None if v is None else f(v) for v in views], arrow)

    return run


def frame_error(w: Column, h: Column, stride: Column, data: Column) -> Column:
    """Why a frame can't be read; null if it can."""
    return F.when(w.isNull() | h.isNull() | stride.isNull() | data.isNull(), "missing").when((w <= 0) | (h <= 0), "zero_area").when(stride < 4 * w, "short_stride").when(F.octet_length(data) < stride * h, "short_buffer")


def crop_error(frame: list[Column], rect: list[Column]) -> Column:
    """Why a rectangle (x, y, w, h) can't be cut from a frame (w, h, stride, data); null if it can."""
    (w, h, *_), (x, y, cw, ch) = frame, rect
    outside = (x < 0) | (y < 0) | (x + cw > w) | (y + ch > h)
    return F.when((cw <= 0) | (ch <= 0), "zero_area").when(outside, "out_of_frame").otherwise(frame_error(*frame))


@F.arrow_udf(T.BinaryType())
def _cut(w: pa.Array, h: pa.Array, stride: pa.Array, data: pa.Array, x: pa.Array, y: pa.Array, cw: pa.Array, ch: pa.Array) -> pa.Array:
    out = []
    for frame, a, b, c, d in zip(_each(w, h, stride, data), *(r.to_pylist() for r in (x, y, cw, ch)), strict=True):
        view = None if frame is None or None in (a, b, c, d) or min(a, b) < 0 or min(c, d) <= 0 else _pixels(*frame)
        ok = view is not None and b + d <= view.shape[0] and a + c <= view.shape[1]
        out.append(view[b : b + d, a : a + c].tobytes() if ok else None)
    return pa.array(out, pa.binary())


def crop(frame: list[Column], rect: list[Column]) -> Column:
    """The bytes of a rectangle, tightly packed; null where `crop_error` says why."""
    return _cut(*frame, *[c.cast("int") for c in rect])


@F.arrow_udf(T.BinaryType())
def packed(w: pa.Array, h: pa.Array, data: pa.Array) -> pa.Array:
    """Rows without padding, whose stride is the buffer's length by the height; a short last row ends the frame."""
    out = []
    for x in _each(w, h, w, data):
        if x is None:
            out.append(None)
            continue
        width, height, _, raw = x
        row = 4 * max(width, 0)
        stride = len(raw) // height if height > 0 else row
        if stride == row:
            out.append(raw.tobytes())
        else:
            whole = min(max(height, 0), (len(raw) - row) // stride + 1 if stride and len(raw) >= row else 0)
            out.append(b"".join(raw[i * stride : i * stride + row].tobytes() for i in range(whole)))
    return pa.array(out, pa.binary())


def _luma(v: np.ndarray) -> np.ndarray:
    """Luma of the measuring path: parts of blue, green and red as 32-bit floats, rounded half up."""
    b, g, r = (v[:, :, c].astype(np.float32) for c in range(3))
    parts = np.float32(0.114) * b + np.float32(0.587) * g + np.float32(0.299) * r
    return np.clip(np.floor(parts.astype(np.float64) + 0.5), 0, 255).astype(np.uint8)


gray = _of_frames(lambda v: _luma(v).tobytes(), T.BinaryType(), pa.binary())
column_means = _of_frames(lambda v: (_luma(v).sum(axis=0, dtype=np.int64) / v.shape[0]).tolist(), T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))


def _marked(v: np.ndarray) -> dict | None:
    hit = (v[:, :, 2] > 150) & (v[:, :, 1] < 100) & (v[:, :, 0] < 100)
    y, x = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    return {"x": x[0], "y": y[0], "w": x[-1] - x[0] + 1, "h": y[-1] - y[0] + 1} if len(x) else None


_RECT = pa.struct([(c, pa.int64()) for c in "xywh"])
RECT = T.StructType([T.StructField(c, T.LongType()) for c in "xywh"])
#: The box around all red pixels (red above 150, green and blue below 100), or null.
red_marker = _of_frames(_marked, RECT, _RECT)


def norm_to_pixel(region: list[Column], w: Column, h: Column) -> list[Column]:
    """A region in parts of a frame as pixels (x, y, w, h): cut to the frame, at least a pixel, within the right and lower edge."""
    x, y = (F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) for c in region[:2])
    rw, rh = (F.least(F.greatest(c, F.lit(0.0)), 1 - a) for c, a in zip(region[2:], (x, y), strict=True))
    px, py = (F.round(a * size).cast("long") for a, size in ((x, w), (y, h)))
    side = lambda part, size, start: F.least(F.greatest(F.round(part * size).cast("long"), F.lit(1)), F.greatest(size - start, F.lit(1)))
    return [px, py, side(rw, w, px), side(rh, h, py)]


# -- profiles ---------------------------------------------------------------------------------------------------------

#: Fixed values of panels: half a smoothing window, the threshold's rank, the shortest gutter, the margin in which none
#: counts, and what a panel must be wider than.
HALF, RANK, GUTTER, MARGIN, PANEL = 10, 0.12, 10, 100, 250


def _active(v: np.ndarray) -> list[int]:
    g = v[:, :, :3].sum(axis=2, dtype=np.int64) / 3.0
    n = v.shape[0]
    mean = g.sum(axis=0) / n
    return np.round(np.sqrt(np.maximum((g * g).sum(axis=0) / n - mean * mean, 0)) * 1e9).astype(np.int64).tolist()


#: The standard deviation of each column's pixels in billionths, whole so that sums don't depend on their order.
column_activity = _of_frames(_active, T.ArrayType(T.LongType()), pa.list_(pa.int64()))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, where f's lambdas would do so for each element."""
    return F.get(F.transform(F.array(value), f), 0)


def runs(flags: Column) -> Column:
    """Runs of an array of Booleans that are true, as (first, end), end excluded."""
    no, n = F.array(F.lit(False)), F.greatest(F.size(flags) - 1, F.lit(0))
    at = lambda other, plus: F.filter(F.transform(F.zip_with(flags, other, lambda a, b: a & ~b), lambda x, i: F.when(x, i + plus)), lambda i: i.isNotNull())
    first, end = at(F.concat(no, F.slice(flags, F.lit(1), n)), 0), at(F.concat(F.slice(flags, F.lit(2), n), no), 1)
    return F.when(F.size(flags) > 0, F.arrays_zip(first.alias("first"), end.alias("end"))).otherwise(F.array().cast("array<struct<first:int,end:int>>"))


def smoothed(profile: Column, half: int = HALF) -> Column:
    """Means over a window of 2 * half + 1 that is cut at the ends."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(p: pa.Array) -> pa.Array:
        out = []
        for x in p:
            v = None if x.as_py() is None else x.values.to_numpy(zero_copy_only=False)
            if v is not None:
                i, sums = np.arange(len(v)), np.concatenate([[0], np.cumsum(v)])
                lo, hi = np.maximum(i - half, 0), np.minimum(i + half + 1, len(v))
                v = ((sums[hi] - sums[lo]) / (hi - lo)).tolist()
            out.append(v)
        return pa.array(out, pa.list_(pa.float64()))

    return run(profile)


def panels(frames: DataFrame, profile: str = "profile") -> DataFrame:
    """frames with panels, array of (first, end): the ranges of columns between gutters. A gutter is a run of columns whose
    smoothed activity lies below the order statistic of rank `RANK`; a profile without columns gives no panel."""
    p = F.col(profile)
    n = F.size(p)

    def inner(bound: Column) -> Column:
        below = runs(F.transform("__s", lambda x: x < bound))
        return F.filter(below, lambda r: (r["end"] - r["first"] >= GUTTER) & (r["first"] > MARGIN) & (r["end"] < n - MARGIN))

    def between(ends: Column) -> Column:
        pairs = F.zip_with(F.slice(ends, F.lit(1), F.size(ends) - 1), F.slice(ends, F.lit(2), F.size(ends) - 1), lambda a, b: F.struct(a.alias("first"), b.alias("end")))
        return F.filter(pairs, lambda r: r["end"] - r["first"] > PANEL)

    f = frames.withColumn("__s", F.when(n > 0, smoothed(p)))
    middles = _let(F.get(F.sort_array("__s"), F.floor(n * RANK).cast("int")), lambda t: F.transform(inner(t), lambda r: F.floor((r["first"] + r["end"]) / 2).cast("int")))
    wide = _let(F.concat(F.array(F.lit(0)), middles, F.array(n)), between)
    whole = F.array(F.struct(F.lit(0).alias("first"), n.alias("end")))
    return f.withColumn("panels", F.when(n > 0, _let(wide, lambda x: F.when(F.size(x) > 0, x).otherwise(whole)))).drop("__s")


def gutters(means: Column, h: Column) -> Column:
    """Columns of a grid, counted by dark runs of columns (below half the mean of all) that begin neither at the first nor
    at the last column; null where there is none, or in frames under 8 pixels wide. means: a column of its own."""
    n = F.size(means)
    bound = F.aggregate(means, F.lit(0.0), lambda t, x: t + x) / n * 0.5
    found = _let(bound, lambda t: F.size(F.filter(runs(F.transform(means, lambda x: x < t)), lambda r: (r["first"] > 0) & (r["first"] < n - 1))))
    return F.when((n >= 8) & (h >= 1) & (found > 0), found + 1)


# -- cells ------------------------------------------------------------------------------------------------------------

#: The grid's cells, and the saturation below which a cell is content.
GRID_X, GRID_Y, SATURATION = 80, 45, 0.35


def _content(v: np.ndarray) -> np.ndarray:
    """Which cells of the grid hold little colour, by every second pixel of every second row of a cell."""
    h, w = v.shape[:2]
    cw, ch = max(w // GRID_X, 1), max(h // GRID_Y, 1)
    xs, ys = (np.array([i for i in range(min(g * c, n)) if i % c % 2 == 0], np.int64) for g, c, n in ((GRID_X, cw, w), (GRID_Y, ch, h)))
    p = v[ys[:, None], xs[None, :], :3].astype(np.float64)
    most, least = p.max(axis=2), p.min(axis=2)
    s = np.where(most > 0, (most - least) / np.where(most > 0, most, 1), 0.0)
    cell = ((ys // ch)[:, None] * GRID_X + (xs // cw)[None, :]).ravel()
    n = np.bincount(cell, minlength=GRID_X * GRID_Y)
    total = np.bincount(cell, s.ravel(), minlength=GRID_X * GRID_Y)
    return ((n > 0) & (total < SATURATION * n)).reshape(GRID_Y, GRID_X)


def components(mask: np.ndarray) -> np.ndarray:
    """For each true cell the smallest number of a cell that it is joined to by sides; others get the number of cells.
    Each cell takes the least label of its neighbours, then that of the cell it names, until nothing changes."""
    none = mask.size
    label = np.where(mask, np.arange(none).reshape(mask.shape), none)
    while True:
        near = np.pad(label, 1, constant_values=none)
        new = np.minimum.reduce([label, near[:-2, 1:-1], near[2:, 1:-1], near[1:-1, :-2], near[1:-1, 2:]])
        new = np.where(mask, new, none)
        known = np.append(new.ravel(), none)
        new = np.where(mask, known[new], none)
        if (new == label).all():
            return label
        label = new


def _salient(v: np.ndarray) -> dict | None:
    mask = _content(v)
    if not mask.any():
        return None
    label = components(mask)
    sizes = np.bincount(label[mask])
    y, x = np.nonzero(label == sizes.argmax())  # the first of the largest
    h, w = v.shape[:2]
    cw, ch = max(w // GRID_X, 1), max(h // GRID_Y, 1)
    left, top = int(x.min()) * cw, int(y.min()) * ch
    return {"x": left, "y": top, "w": max(min((int(x.max()) + 1) * cw, w) - left, 1), "h": max(min((int(y.max()) + 1) * ch, h) - top, 1)}


#: The box around the largest connected group of cells with little colour; of equal ones that which begins first.
salient_region = _of_frames(_salient, RECT, _RECT)

# -- edges ------------------------------------------------------------------------------------------------------------

#: The blur's deviation, and the gradients from which an edge goes on and begins.
SIGMA, WEAK, STRONG = 1.4, 30.0, 90.0


def _convolved(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    half = len(kernel) // 2
    wide = np.pad(a, [(half, half) if i == axis else (0, 0) for i in range(2)], mode="edge")
    n = a.shape[axis]
    return sum(k * np.take(wide, range(i, i + n), axis=axis) for i, k in enumerate(kernel))


def edges(g: np.ndarray) -> np.ndarray:
    """Canny's edges of a gray image: blur, Sobel gradients, the largest along the gradient, then what weak pixels are
    joined to strong ones by sides and corners."""
    if min(g.shape) < 3:
        return np.zeros(g.shape, bool)
    half = int(np.ceil(2 * SIGMA))
    kernel = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * SIGMA * SIGMA))
    kernel /= kernel.sum()
    soft = np.round(_convolved(_convolved(g.astype(np.float64), kernel, 1), kernel, 0))
    smooth, slope = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    gx, gy = _convolved(_convolved(soft, slope, 1), smooth, 0), _convolved(_convolved(soft, slope, 0), smooth, 1)
    size = np.hypot(gx, gy)
    turn = np.degrees(np.arctan2(gy, gx)) % 180
    inner = size[1:-1, 1:-1]
    shift = lambda dy, dx: size[1 + dy : size.shape[0] - 1 + dy, 1 + dx : size.shape[1] - 1 + dx]
    turn = turn[1:-1, 1:-1]
    flat, down, steep = (turn < 22.5) | (turn >= 157.5), (turn >= 22.5) & (turn < 67.5), (turn >= 67.5) & (turn < 112.5)
    sides = [(flat, (0, 1)), (down, (1, 1)), (steep, (1, 0)), (~(flat | down | steep), (1, -1))]
    peak = np.zeros(inner.shape, bool)
    for where, (dy, dx) in sides:
        peak |= where & (inner >= shift(dy, dx)) & (inner >= shift(-dy, -dx))
    keep = np.zeros(size.shape, bool)
    keep[1:-1, 1:-1] = peak
    weak, on = keep & (size >= WEAK), keep & (size >= STRONG)
    while True:
        near = np.pad(on, 1)
        grown = weak & np.logical_or.reduce([near[1 + dy : near.shape[0] - 1 + dy, 1 + dx : near.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        if (grown == on).all():
            return on
        on = grown


def snapped(edge: np.ndarray, rect: tuple[int, int, int, int], pad: float) -> tuple[tuple[int, int, int, int], float]:
    """A rough rectangle moved to the columns and rows with most edges within `pad` of its sides around each border, the
    first of the best, and the share of borders that met an edge."""
    (x, y, w, h), (ih, iw) = rect, edge.shape
    reach_x, reach_y = int(np.floor(w * pad + 0.5)), int(np.floor(h * pad + 0.5))
    cols, rows = edge[y : min(y + h, ih)].sum(axis=0), edge[:, x : min(x + w, iw)].sum(axis=1)

    def best(counts: np.ndarray, center: int, reach: int) -> tuple[int, int]:
        lo, hi = max(center - reach, 0), min(center + reach, len(counts) - 1)
        at = lo + int(counts[lo : hi + 1].argmax()) if lo <= hi else 0
        return (at, int(counts[at])) if lo <= hi and counts[at] else (min(max(center, 0), len(counts) - 1), 0)

    (left, a), (right, b) = best(cols, x, reach_x), best(cols, x + w, reach_x)
    (top, c), (bottom, d) = best(rows, y, reach_y), best(rows, y + h, reach_y)
    sx, sw = (left, right - left) if right > left else (x, w)
    sy, sh = (top, bottom - top) if bottom > top else (y, h)
    return (sx, sy, max(sw, 1), max(sh, 1)), sum(n > 0 for n in (a, b, c, d)) / 4


def snap(frame: list[Column], rect: list[Column], pad: float = 0.10) -> Column:
    """(x, y, w, h, alignment) of a rough rectangle snapped to a frame's edges; null for malformed frames."""
    kind = pa.struct([*((c, pa.int64()) for c in "xywh"), ("alignment", pa.float64())])

    @F.arrow_udf(T.StructType([*RECT.fields, T.StructField("alignment", T.DoubleType())]))
    def run(w: pa.Array, h: pa.Array, stride: pa.Array, data: pa.Array, x: pa.Array, y: pa.Array, cw: pa.Array, ch: pa.Array) -> pa.Array:
        out = []
        for frame, *rough in zip(_each(w, h, stride, data), *(r.to_pylist() for r in (x, y, cw, ch)), strict=True):
            view = None if frame is None or None in rough else _pixels(*frame)
            got, alignment = (None, None) if view is None else snapped(edges(_luma(view)), tuple(rough), pad)
            out.append(None if view is None else dict(zip("xywh", got, strict=True)) | {"alignment": alignment})
        return pa.array(out, kind)

    return run(*frame, *[c.cast("long") for c in rect])


def measure(frames: DataFrame, region: list[Column], pad: float = 0.10) -> DataFrame:
    """frames with measured: the region (in parts of the frame) snapped to edges, in parts again, its ratio of width to
    height, how many of its borders met an edge, and the columns of a grid if there are any. A region that isn't in the
    unit square, or has no area, gives null."""
    x, y, rw, rh = region
    valid = x.between(0, 1) & y.between(0, 1) & (rw > 0) & (rh > 0) & (x + rw <= 1 + 1e-9) & (y + rh <= 1 + 1e-9)
    frame = [F.col(c) for c in ("w", "h", "stride", "data")]
    f = frames.withColumn("__s", snap(frame, norm_to_pixel(region, F.col("w"), F.col("h")), pad)).withColumn("__m", column_means(*frame))
    s = F.col("__s")
    parts = [(s["x"] / F.col("w")).alias("x"), (s["y"] / F.col("h")).alias("y"), (s["w"] / F.col("w")).alias("w"), (s["h"] / F.col("h")).alias("h")]
    got = F.struct(*parts, (s["w"] / s["h"]).alias("aspect_ratio"), s["alignment"].alias("confidence"), gutters(F.col("__m"), F.col("h")).alias("grid_columns"))
    return f.withColumn("measured", F.when(F.coalesce(valid, F.lit(False)) & s.isNotNull(), got)).drop("__s", "__m")


# -- bursts -----------------------------------------------------------------------------------------------------------


def tiles(frames: DataFrame, by: str, channels: int, dtype: str) -> DataFrame:
    """(by, n, w, h, ty, tx, top, left, rows, cols, seq, data): each frame of a burst cut into tiles, smaller ones for
    bursts of more frames, so that a tile's pixels over all frames stay near `TILE_BYTES`. All frames of a burst need
    the same w and h; others are in `stack_errors`. frames: (by, seq, w, h, stride, data) of well-formed frames."""
    item = np.dtype(dtype).itemsize * channels
    n = frames.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    side = F.greatest(F.least(F.floor(F.sqrt(F.lit(TILE_BYTES) / (F.col("n") * item))), F.lit(TILE)), F.lit(1)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [by, "n", "w", "h", "ty", "tx", "top", "left", "rows", "cols", "seq", "data"]
        for b in batches:
            rows = []
            keys = zip(*(b.column(c).to_pylist() for c in (by, "n", "side", "seq")), strict=True)
            for (key, count, edge, seq), (w, h, stride, raw) in zip(keys, _each(*(b.column(c) for c in ("w", "h", "stride", "data"))), strict=True):
                v = np.ndarray((h, w * item), np.uint8, raw[: stride * h], strides=(stride, 1))
                for top in range(0, h, edge):
                    for left in range(0, w, edge):
                        part = v[top : top + edge, left * item : (left + edge) * item]
                        rows.append((key, count, w, h, top // edge, left // edge, top, left, part.shape[0], part.shape[1] // item, seq, part.tobytes()))
            if rows:
                kinds = [b.column(by).type, pa.int64(), *[pa.int32()] * 8, b.column("seq").type, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kind = dict(frames.dtypes)
    f = frames.join(n, by).select(by, "n", side.alias("side"), "seq", *[F.col(c).cast("int").alias(c) for c in ("w", "h", "stride")], "data")
    return f.mapInArrow(run, f"{by} {kind[by]}, n long, w int, h int, ty int, tx int, top int, left int, rows int, cols int, seq {kind['seq']}, data binary")


def stack(frames: DataFrame, by: str, reduce: str = "median", channels: int = 4, dtype: str = "u1") -> DataFrame:
    """A row per tile of each burst: (by, n, w, h, top, left, rows, cols, data, off). data: the frames' median (of an even
    number the mean of the middle two) or mean of each pixel and channel, 32-bit floats row by row. off: the sum of the
    frames' absolute differences from it. The tile is the shuffle key, so a frame is never whole anywhere after its cut."""

    def run(t: pa.Table) -> pa.Table:
        shape = t.column("rows")[0].as_py(), t.column("cols")[0].as_py(), channels
        all_ = np.stack([np.frombuffer(x, dtype).reshape(shape) for x in t.column("data").to_pylist()])
        n = len(all_)
        if reduce == "mean":
            one = all_.sum(axis=0, dtype=np.float64) / n
        else:
            line = np.sort(all_, axis=0)
            one = line[n // 2].astype(np.float32) if n % 2 else (line[n // 2 - 1].astype(np.float32) + line[n // 2].astype(np.float32)) / np.float32(2)
        one = one.astype(np.float32)
        off = sum(float(np.abs(x.astype(np.float32) - one).sum(dtype=np.float64)) for x in all_)
        first = t.slice(0, 1).select([by, "n", "w", "h", "top", "left", "rows", "cols"])
        return first.append_column("data", pa.array([one.astype("<f4").tobytes()], pa.binary())).append_column("off", pa.array([off]))

    if reduce not in ("median", "mean"):
        raise ValueError(f"reduce is median or mean, not {reduce}")
    kind = dict(frames.dtypes)[by]
    return tiles(frames, by, channels, dtype).groupBy(by, "ty", "tx").applyInArrow(run, f"{by} {kind}, n long, w int, h int, top int, left int, rows int, cols int, data binary, off double")


def image(stacked: DataFrame, by: str, channels: int) -> DataFrame:
    """(by, n, w, h, values): the tiles of each burst put together, array of floats row by row; one frame at a time."""

    def run(t: pa.Table) -> pa.Table:
        first = t.slice(0, 1).select([by, "n", "w", "h"])
        out = np.empty((first.column("h")[0].as_py(), first.column("w")[0].as_py(), channels), np.float32)
        for top, left, rows, cols, data in zip(*(t.column(c).to_pylist() for c in ("top", "left", "rows", "cols", "data")), strict=True):
            out[top : top + rows, left : left + cols] = np.frombuffer(data, "<f4").reshape(rows, cols, channels)
        return first.append_column("values", pa.array([out.ravel()], pa.list_(pa.float32())))

    kind = dict(stacked.dtypes)[by]
    return stacked.groupBy(by).applyInArrow(run, f"{by} {kind}, n long, w int, h int, values array<float>")


def residual(stacked: DataFrame, by: str, channels: int) -> DataFrame:
    """(by, n, residual_mad): how far the frames lie from their stack, the mean over frames, pixels and channels."""
    return stacked.groupBy(by, "n").agg((F.sum("off") / (F.max("n") * F.max("w") * F.max("h") * channels)).alias("residual_mad"))


def stack_errors(frames: DataFrame, by: str) -> DataFrame:
    """(by, error) of bursts that can't be stacked: fewer than two frames, or frames of different sizes."""
    g = frames.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("w", "h")).alias("a"), F.max(F.struct("w", "h")).alias("b"))
    return g.select(by, F.when(F.col("n") < 2, "too_few_frames").when(F.col("a") != F.col("b"), "different_sizes").alias("error")).where("error is not null")


def _smooth_size(n: int) -> int:
    """The next size with no prime factor above 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def phase_shift(base: np.ndarray, other: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy, response): by how much the second gray image is moved against the first, by phase correlation, from the
    centroid of five by five values around the peak, whose sum is the response. Images without any structure give 0."""
    if base.shape != other.shape or np.ptp(base) == 0 or np.ptp(other) == 0:
        return 0.0, 0.0, 0.0
    shape = tuple(map(_smooth_size, base.shape))
    cross = np.fft.rfft2(base, shape) * np.conj(np.fft.rfft2(other, shape))
    c = np.fft.fftshift(np.fft.irfft2(cross / (np.abs(cross) + np.finfo(np.float32).eps), shape))
    py, px = np.unravel_index(c.argmax(), shape)
    top, left = max(py - 2, 0), max(px - 2, 0)
    win = c[top : min(py + 3, shape[0]), left : min(px + 3, shape[1])]
    total = float(win.sum())
    ys, xs = np.mgrid[top : top + win.shape[0], left : left + win.shape[1]]
    eps = np.finfo(np.float64).eps
    return shape[1] // 2 - float((xs * win).sum()) / (total + eps), shape[0] // 2 - float((ys * win).sum()) / (total + eps), total


def shifts(frames: DataFrame, by: str) -> DataFrame:
    """(by, seq, n, dx, dy, response): each frame of a burst against its middle one, number n // 2 in the order of seq.
    The middle frame meets the others in a join; no task holds a burst."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("seq")) - 1
    order = frames.select(by, "seq", "w", "h").withColumn("__i", place).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    middle = order.where(F.col("__i") == F.floor(F.col("n") / 2)).select(by, "n", F.col("seq").alias("__seq"))
    base = frames.join(middle.withColumnRenamed("__seq", "seq"), [by, "seq"]).select(by, "n", *[F.col(c).alias(f"__{c}") for c in ("w", "h", "stride", "data")])

    @F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("dx", "dy", "response")]))
    def run(w: pa.Array, h: pa.Array, s: pa.Array, data: pa.Array, bw: pa.Array, bh: pa.Array, bs: pa.Array, bdata: pa.Array) -> pa.Array:
        out = []
        for one, base in zip(_each(w, h, s, data), _each(bw, bh, bs, bdata), strict=True):
            a, b = (None if x is None else _pixels(*x) for x in (base, one))
            got = None if a is None or b is None else phase_shift(_luma(a).astype(np.float64), _luma(b).astype(np.float64))
            out.append(got and dict(zip(("dx", "dy", "response"), got, strict=True)))
        return pa.array(out, pa.struct([(c, pa.float64()) for c in ("dx", "dy", "response")]))

    both = frames.join(base, by).withColumn("__d", run(*[F.col(c) for c in ("w", "h", "stride", "data", "__w", "__h", "__stride", "__data")]))
    return both.select(by, "seq", "n", "__d.dx", "__d.dy", "__d.response")


def coherent(moved: DataFrame, medoids: DataFrame, by: str, max_shift: float = 2.0, min_response: float = 0.5) -> DataFrame:
    """A row per burst: (by, frames, kept, max_drift, verdict). moved: (by, seq, dx, dy, response); medoids: (by, seq) of
    the central shift of each. Frames stay whose response is at least that, and whose shift lies within the bound of the
    medoid's on both axes; drift is the largest distance from the medoid. Fewer than two left is a refusal, not a stack."""
    if not (0 <= max_shift < float("inf") and 0 <= min_response < float("inf")):
        raise ValueError("tolerances are finite and not negative")
    center = moved.join(medoids, [by, "seq"]).select(by, F.col("dx").alias("__x"), F.col("dy").alias("__y"))
    m = moved.join(center, by)
    x, y = F.abs(F.col("dx") - F.col("__x")), F.abs(F.col("dy") - F.col("__y"))
    stay = (F.col("response") >= min_response) & (x <= max_shift) & (y <= max_shift)
    kept = F.sort_array(F.collect_list(F.when(stay, F.col("seq"))))
    g = m.groupBy(by).agg(F.count(F.lit(1)).alias("frames"), kept.alias("kept"), F.max(F.sqrt(x * x + y * y)).alias("max_drift"))
    return g.withColumn("verdict", F.when(F.size("kept") < 2, "no_coherent_frames").otherwise("coherent"))
