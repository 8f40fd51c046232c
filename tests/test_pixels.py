"""Raw frames: worked cases and brute force."""

import math
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import rules as R
from tideline.operators import pixels as P

FRAME = "frame_id long, w int, h int, stride int, data binary"


def cols():
    return [F.col(c) for c in ("w", "h", "stride", "data")]


def frame(w, h, at, stride=None):
    """BGRA bytes of a frame from a function (x, y) -> (b, g, r)."""
    stride = stride or 4 * w
    out = bytearray(stride * h)
    for y in range(h):
        for x in range(w):
            out[y * stride + 4 * x : y * stride + 4 * x + 4] = bytes([*at(x, y), 255])
    return bytes(out)


def numbered(w, h, stride=None):
    return frame(w, h, lambda x, y: (x, y, 0), stride)


def table(spark, *frames):
    return spark.createDataFrame([(i, *f) for i, f in enumerate(frames)], FRAME)


# ---- crops


@pytest.mark.parametrize(
    ("w", "h", "stride", "rect", "want"),
    [
        (4, 4, 16, (1, 1, 2, 2), bytes([1, 1, 0, 255, 2, 1, 0, 255, 1, 2, 0, 255, 2, 2, 0, 255])),
        (2, 2, 12, (0, 0, 2, 2), bytes([0, 0, 0, 255, 1, 0, 0, 255, 0, 1, 0, 255, 1, 1, 0, 255])),
        (4, 4, 16, (3, 0, 2, 1), "out_of_frame"), (4, 4, 16, (0, 0, 0, 1), "zero_area"), (4, 4, 16, (-1, 0, 2, 1), "out_of_frame"), (4, 4, 16, (0, 3, 1, 2), "out_of_frame"),
    ],
)
def test_crop(spark, w, h, stride, rect, want):
    rect = [F.lit(v) for v in rect]
    r = table(spark, (w, h, stride, numbered(w, h, stride))).select(P.crop(cols(), rect).alias("c"), P.crop_error(cols(), rect).alias("e")).first()
    assert (r.c, r.e) == ((None, want) if isinstance(want, str) else (want, None))


def test_malformed_frames(spark):
    whole = [F.lit(v) for v in (0, 0, 1, 1)]
    rows = [(2, 2, 4, numbered(2, 2)), (2, 2, 8, numbered(2, 2)[:-1]), (0, 2, 8, b""), (2, 2, 8, None), (None, 2, 8, b"x"), (2, 2, 8, numbered(2, 2))]
    got = table(spark, *rows).orderBy("frame_id").select(P.crop_error(cols(), whole).alias("e"), P.crop(cols(), whole).alias("c"), P.gray(*cols()).alias("g"), P.red_marker(*cols()).alias("m"), P.salient_region(*cols()).alias("s"), P.column_activity(*cols()).alias("a")).collect()
    assert [r.e for r in got] == ["short_stride", "short_buffer", "out_of_frame", "missing", "missing", None]
    assert all(r.c is None and r.g is None and r.m is None and r.s is None and r.a is None for r in got[:5])
    assert got[5].c == bytes([0, 0, 0, 255]) and len(got[5].g) == 4 and got[5].s is not None


def test_named_target_shows_the_right_half(spark):
    rect = P.norm_to_pixel([F.lit(v) for v in (0.5, 0.0, 0.5, 1.0)], F.col("w"), F.col("h"))
    r = table(spark, (4, 2, 16, numbered(4, 2))).select(P.crop(cols(), rect).alias("c"), *[c.alias(n) for c, n in zip(rect, "xywh", strict=True)]).first()
    assert (r.x, r.y, r.w, r.h) == (2, 0, 2, 2) and r.c[:4] == bytes([2, 0, 0, 255]) and len(r.c) == 16


@pytest.mark.parametrize(("region", "want"), [((0.0, 0.0, 1.0, 1.0), (0, 0, 100, 50)), ((0.9, 0.9, 0.5, 0.5), (90, 45, 10, 5)), ((-1.0, 0.5, 0.001, 0.5), (0, 25, 1, 25)), ((1.0, 1.0, 0.5, 0.5), (100, 50, 1, 1)), ((0.0, 0.0, 2.0, 0.0), (0, 0, 100, 1))])
def test_regions_as_pixels(spark, region, want):
    r = spark.range(1).select(*P.norm_to_pixel([F.lit(v) for v in region], F.lit(100), F.lit(50))).first()
    assert tuple(r) == want


def test_packed_rows(spark):
    rows = [(2, 3, 0, numbered(2, 3, 12)), (2, 3, 0, numbered(2, 3)), (2, 3, 0, numbered(2, 3, 12)[:-7]), (2, 3, 0, b""), (2, 3, 0, None)]
    got = [r[0] for r in table(spark, *rows).orderBy("frame_id").select(P.packed(F.col("w"), F.col("h"), F.col("data"))).collect()]

    def by_hand(data, w, h):
        stride, row, out = len(data) // h, 4 * w, b""
        for y in range(h):
            if y * stride + row > len(data):
                break
            out += data[y * stride : y * stride + row]
        return out

    assert got[0] == numbered(2, 3) == got[1] and got[2] == by_hand(rows[2][3], 2, 3) and got[3:] == [b"", None]


# ---- profiles, markers and cells


def test_four_columns_by_gutters(spark):
    dark = {19, 20, 39, 40, 59, 60}
    plain, edge = frame(80, 20, lambda x, y: (0, 0, 0) if x in dark else (255, 255, 255)), frame(80, 20, lambda x, y: (0, 0, 0) if x in (0, 1, 79) else (255, 255, 255))
    f = table(spark, (80, 20, 320, plain), (80, 20, 320, edge), (7, 2, 28, numbered(7, 2)))
    got = f.orderBy("frame_id").select("h", P.column_means(*cols()).alias("m")).select(P.gutters(F.col("m"), F.col("h"))).collect()
    assert [r[0] for r in got] == [4, None, None]


def test_red_marker(spark):
    f = frame(40, 30, lambda x, y: (10, 10, 230) if 5 <= x <= 15 and 8 <= y <= 20 else (200, 200, 200), 180)
    assert tuple(table(spark, (40, 30, 180, f)).select(P.red_marker(*cols())).first()[0]) == (5, 8, 11, 13)


def panels_by_hand(buf, w, h, stride):
    """The rule, loop by loop."""
    act = []
    for x in range(w):
        g = [sum(buf[y * stride + 4 * x + c] for c in range(3)) / 3.0 for y in range(h)]
        m = sum(g) / h
        act.append(math.sqrt(max(sum(v * v for v in g) / h - m * m, 0)))
    sm = [sum(act[max(x - 10, 0) : min(x + 11, w)]) / (min(x + 11, w) - max(x - 10, 0)) for x in range(w)]
    bound = sorted(sm)[int(w * 0.12)] - 1e-7  # sums in another order differ by less
    div, i = [], 0
    while i < w:
        start = i
        while i < w and sm[i] < bound:
            i += 1
        if i - start >= 10 and start > 100 and i < w - 100:
            div.append((start + i) // 2)
        i += i == start
    ends = [0, *div, w]
    return [(a, b) for a, b in zip(ends, ends[1:]) if b - a > 250] or [(0, w)]


@pytest.mark.parametrize("quiet", [[], [(300, 340)], [(300, 345), (620, 660)], [(50, 90)], [(280, 289)], [(400, 440), (500, 560)]])
def test_panels(spark, quiet):
    r, w, h = random.Random(len(quiet)), 940, 12
    still = {x for a, b in quiet for x in range(a, b)}
    buf = frame(w, h, lambda x, y: (90, 90, 90) if x in still else (r.randrange(256),) * 3)
    got = P.panels(table(spark, (w, h, 4 * w, buf)).select(P.column_activity(*cols()).alias("profile"))).first().panels
    assert [tuple(x) for x in got] == panels_by_hand(buf, w, h, 4 * w)


def salient_by_hand(buf, w, h):
    cw, ch = max(w // 80, 1), max(h // 45, 1)
    content = set()
    for gy in range(45):
        for gx in range(80):
            s = []
            for y in range(gy * ch, min((gy + 1) * ch, h), 2):
                for x in range(gx * cw, min((gx + 1) * cw, w), 2):
                    p = buf[4 * (y * w + x) : 4 * (y * w + x) + 3]
                    s.append((max(p) - min(p)) / max(p) if max(p) else 0.0)
            if s and sum(s) / len(s) < 0.35:
                content.add((gy, gx))
    best, seen = [], set()
    for start in sorted(content):
        if start in seen:
            continue
        comp, todo = [], [start]
        seen.add(start)
        while todo:
            y, x = todo.pop()
            comp.append((y, x))
            for n in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if n in content and n not in seen:
                    seen.add(n)
                    todo.append(n)
        if len(comp) > len(best):
            best = comp
    if not best:
        return None
    ys, xs = [y for y, _ in best], [x for _, x in best]
    x, y = min(xs) * cw, min(ys) * ch
    return x, y, min((max(xs) + 1) * cw, w) - x, min((max(ys) + 1) * ch, h) - y


def test_salient_region(spark):
    r, frames = random.Random(2), []
    for w, h, share in ((30, 20, 0.5), (100, 60, 0.4), (330, 190, 0.45), (170, 95, 0.6), (12, 9, 0.0)):
        cw, ch = max(w // 80, 1), max(h // 45, 1)
        pale = {(y, x) for y in range(h // ch + 1) for x in range(w // cw + 1) if r.random() < share}
        frames.append((w, h, frame(w, h, lambda x, y, pale=pale, cw=cw, ch=ch: (120, 130, 125) if (y // ch, x // cw) in pale else (r.randrange(20), 10, 200))))
    frames.append((60, 40, frame(60, 40, lambda x, y: (200, 200, 200) if x < 10 and y < 10 or 30 <= x < 40 and y >= 30 else (0, 0, 250))))  # two of one size
    got = table(spark, *[(w, h, 4 * w, f) for w, h, f in frames]).orderBy("frame_id").select(P.salient_region(*cols()).alias("m")).collect()
    assert [g.m and tuple(g.m) for g in got] == [salient_by_hand(f, w, h) for w, h, f in frames]
    assert got[-1].m.x == 0 and got[-2].m is None


def test_components_of_mazes():
    r = np.random.default_rng(4)
    for share in (0.3, 0.5, 0.59, 0.7, 1.0):
        mask = r.random((45, 80)) < share
        label, seen = P.components(mask), {}
        for i in np.flatnonzero(mask):
            if int(i) not in seen:
                todo = [int(i)]
                while todo:
                    c = todo.pop()
                    if c not in seen:
                        seen[c] = int(i)
                        y, x = divmod(c, 80)
                        todo += [ny * 80 + nx for ny, nx in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= ny < 45 and 0 <= nx < 80 and mask[ny, nx]]
        assert {int(i): int(label.ravel()[i]) for i in np.flatnonzero(mask)} == seen


# ---- edges


def bordered(w, h):
    on = lambda x, y: (x in (20, 60) and 10 <= y <= 50) or (y in (10, 50) and 20 <= x <= 60)
    return frame(w, h, lambda x, y: (0, 0, 0) if on(x, y) else (255, 255, 255))


def test_snaps_to_a_bordered_rectangle(spark):
    f = table(spark, (80, 60, 320, bordered(80, 60)))
    r = f.select(P.snap(cols(), [F.lit(v) for v in (17, 13, 46, 34)], 0.20).alias("s")).first().s
    assert abs(r.x - 20) <= 2 and abs(r.x + r.w - 60) <= 2 and abs(r.y - 10) <= 2 and abs(r.y + r.h - 50) <= 2 and r.alignment == 1.0
    flat = table(spark, (80, 60, 320, frame(80, 60, lambda x, y: (9, 9, 9))))
    assert tuple(flat.select(P.snap(cols(), [F.lit(v) for v in (17, 13, 46, 34)], 0.20).alias("s")).first().s) == (17, 13, 46, 34, 0.0)


def test_measure_end_to_end(spark):
    f = table(spark, (80, 60, 320, bordered(80, 60)))
    m = P.measure(f, [F.lit(v) for v in (0.22, 0.18, 0.5, 0.6)]).first().measured
    assert 0 <= m.x <= 1 and m.x + m.w <= 1 and m.aspect_ratio > 0 and m.confidence == 1 and m.grid_columns == 3
    assert P.measure(f, [F.lit(v) for v in (0.9, 0.18, 0.5, 0.6)]).first().measured is None


def canny_by_hand(g):
    """Canny with loops over pixels."""
    h, w = len(g), len(g[0])
    clip = lambda v, n: min(max(v, 0), n - 1)
    k = [math.exp(-(i * i) / (2 * 1.4 * 1.4)) for i in range(-3, 4)]
    k = [v / sum(k) for v in k]
    a = [[sum(k[i + 3] * g[y][clip(x + i, w)] for i in range(-3, 4)) for x in range(w)] for y in range(h)]
    a = [[round(sum(k[i + 3] * a[clip(y + i, h)][x] for i in range(-3, 4))) for x in range(w)] for y in range(h)]
    at = lambda y, x: a[clip(y, h)][clip(x, w)]
    gx = [[sum(s * (at(y + d, x + 1) - at(y + d, x - 1)) for d, s in ((-1, 1), (0, 2), (1, 1))) for x in range(w)] for y in range(h)]
    gy = [[sum(s * (at(y + 1, x + d) - at(y - 1, x + d)) for d, s in ((-1, 1), (0, 2), (1, 1))) for x in range(w)] for y in range(h)]
    size = [[math.hypot(gx[y][x], gy[y][x]) for x in range(w)] for y in range(h)]
    weak, todo = set(), []
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            t = math.degrees(math.atan2(gy[y][x], gx[y][x])) % 180
            dy, dx = (0, 1) if t < 22.5 or t >= 157.5 else (1, 1) if t < 67.5 else (1, 0) if t < 112.5 else (1, -1)
            if size[y][x] >= size[y + dy][x + dx] and size[y][x] >= size[y - dy][x - dx] and size[y][x] >= 30:
                weak.add((y, x))
                todo += [(y, x)] * (size[y][x] >= 90)
    on = set()
    while todo:
        c = todo.pop()
        if c in weak and c not in on:
            on.add(c)
            todo += [(c[0] + dy, c[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return on


def test_edges_by_hand():
    r = random.Random(7)
    for w, h in ((31, 22), (16, 16), (3, 9), (2, 5)):
        g = [[(200 if (x // 7 + y // 5) % 2 else 40) + r.randrange(30) for x in range(w)] for y in range(h)]
        got = {(int(y), int(x)) for y, x in zip(*np.nonzero(P.edges(np.array(g, np.uint8))), strict=True)}
        assert got == (canny_by_hand(g) if min(w, h) >= 3 else set())


# ---- bursts


def burst(spark, arrays, dtype="<f4", stride=None):
    rows = []
    for i, a in enumerate(arrays):
        a = np.ascontiguousarray(a, dtype)
        line = a.shape[1] * a.shape[2] * a.itemsize
        rows.append((1, i, a.shape[1], a.shape[0], line + 8, b"".join(x.tobytes() + b"\0" * 8 for x in a)))
    return spark.createDataFrame(rows, "burst long, seq long, w int, h int, stride int, data binary")


@pytest.mark.parametrize("n", [2, 4, 5])
@pytest.mark.parametrize("tile", [256, 4])
def test_median_is_that_of_each_pixel(spark, monkeypatch, n, tile):
    """An odd and an even stack, with negatives, ties and zeros; in one tile and in many."""
    monkeypatch.setattr(P, "TILE", tile)
    r = np.random.default_rng(n)
    all_ = [r.integers(-12, 4, (7, 13, 3)).astype(np.float32) for _ in range(n)]
    want = np.array([median(float(a[y, x, c]) for a in all_) for y in range(7) for x in range(13) for c in range(3)], np.float32)
    f = burst(spark, all_)
    stacked = P.stack(f, "burst", "median", 3, "<f4")
    assert P.image(stacked, "burst", 3).first()["values"] == want.tolist()
    off = sum(abs(float(a.ravel()[i]) - float(want[i])) for a in all_ for i in range(len(want))) / (n * len(want))
    assert P.residual(stacked, "burst", 3).first().residual_mad == pytest.approx(off, rel=1e-6)
    mean = P.image(P.stack(f, "burst", "mean", 3, "<f4"), "burst", 3).first()["values"]
    assert np.allclose(mean, np.mean([a.ravel() for a in all_], axis=0), atol=1e-5)


def test_bursts_that_cannot_be_stacked(spark):
    rows = [(1, 0, 2, 2), (2, 0, 2, 2), (2, 1, 2, 3), (3, 0, 2, 2), (3, 1, 2, 2)]
    got = P.stack_errors(spark.createDataFrame(rows, "burst long, seq long, w int, h int"), "burst").collect()
    assert {(r.burst, r.error) for r in got} == {(1, "too_few_frames"), (2, "different_sizes")}


def noise(w, h, moved, seed=1):
    """A view of 96 by 64 or so into one noise, moved to the right."""
    v = np.random.default_rng(seed).integers(0, 256, (h, w + 64))
    return frame(w, h, lambda x, y: (int(v[y, x + 32 - moved]),) * 3)


def group(spark, frames, **bounds):
    f = spark.createDataFrame([(1, i, 96, 64, 384, x) for i, x in enumerate(frames)], "burst long, seq long, w int, h int, stride int, data binary")
    moved = P.shifts(f, "burst")
    center = R.medoids(moved.select("burst", F.col("seq").alias("id"), F.col("dx").alias("x"), F.col("dy").alias("y")), ["burst"]).withColumnRenamed("id", "seq")
    return P.coherent(moved, center, "burst", **bounds).first()


def test_a_burst_that_spans_a_scroll_is_refused(spark):
    apart = [noise(96, 64, 0), noise(96, 64, 20)]
    got = group(spark, apart)
    assert got.verdict == "no_coherent_frames" and len(got.kept) < 2 and got.frames == 2 and got.max_drift > 15
    wide = group(spark, apart, max_shift=25.0, min_response=0.1)
    assert wide.kept == [0, 1] and wide.max_drift == got.max_drift
    same = [noise(96, 64, 0)] * 3
    assert group(spark, same).kept == [0, 1, 2] and group(spark, same, min_response=1.5).kept == []
    for bad in ({"max_shift": float("nan")}, {"min_response": float("nan")}, {"max_shift": -1.0}, {"max_shift": float("inf")}):
        with pytest.raises(ValueError):
            group(spark, same, **bad)


def test_the_larger_cluster_stays(spark):
    got = group(spark, [noise(96, 64, m) for m in (0, 0, 12, 12, 12)], min_response=0.0)
    assert got.kept == [2, 3, 4]


def test_phase_shift_by_the_definition():
    """Against the transform's sums, term by term, on a size that needs no padding."""
    r = np.random.default_rng(1)
    a, b = r.integers(0, 256, (6, 8)).astype(float), r.integers(0, 256, (6, 8)).astype(float)
    h, w = a.shape
    e = lambda n: np.exp(-2j * np.pi * np.outer(np.arange(n), np.arange(n)) / n)
    fa, fb = e(h) @ a @ e(w), e(h) @ b @ e(w)
    p = fa * np.conj(fb)
    c = (np.conj(e(h)) @ (p / (np.abs(p) + np.finfo(np.float32).eps)) @ np.conj(e(w))).real / (h * w)
    c = np.roll(c, (h // 2, w // 2), (0, 1))
    y, x = np.unravel_index(c.argmax(), c.shape)
    cells = [(i, j) for i in range(max(y - 2, 0), min(y + 3, h)) for j in range(max(x - 2, 0), min(x + 3, w))]
    total = sum(c[i, j] for i, j in cells)
    want = w // 2 - sum(j * c[i, j] for i, j in cells) / total, h // 2 - sum(i * c[i, j] for i, j in cells) / total, total
    assert P.phase_shift(a, b) == pytest.approx(want, abs=1e-6)
    assert P.phase_shift(a, np.full_like(a, 3)) == (0.0, 0.0, 0.0)
    dx, dy, response = P.phase_shift(a, np.roll(a, (1, 3), (0, 1)))
    assert (round(dx, 6), round(dy, 6)) == (3, 1) and response > 0.99
