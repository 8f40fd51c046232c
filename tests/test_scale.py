"""Rules that had grown with the square of their input, against their first, plain form; and long inputs."""

import os
import random
import subprocess
import sys
import time
from itertools import accumulate, groupby
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tideline.functions import text as X
from tideline.operators import frames as O
from tideline.operators import timeline as T

SEC = 1_000_000

# ---- reading order


def by_recursion(boxes):
    def run(group):
        if len(group) < 2:
            return group
        displays = sorted({boxes[i]["display_id"] for i in group})
        if len(displays) > 1:
            return [i for d in displays for i in run([i for i in group if boxes[i]["display_id"] == d])]
        for a, b, size in (("y", "x", "h"), ("x", "y", "w")):
            line = sorted(group, key=lambda i: (boxes[i][a], boxes[i][b], i))
            ends = list(accumulate((boxes[i][a] + boxes[i][size] for i in line), max))
            for n in range(1, len(line)):
                if boxes[line[n]][a] >= ends[n - 1]:
                    return run(line[:n]) + run(line[n:])
        return sorted(group, key=lambda i: (boxes[i]["y"], boxes[i]["x"], i))

    return run(list(range(len(boxes))))


def box(r, span, size, displays=2):
    return {"x": r.randrange(span), "y": r.randrange(span), "w": r.randrange(size), "h": r.randrange(size), "display_id": r.randrange(displays)}


@pytest.mark.parametrize(("n", "span", "size"), [(0, 9, 9), (1, 9, 9), (2, 9, 9), (12, 30, 12), (25, 200, 30), (60, 100, 4), (40, 12, 9)])
def test_reading_order_as_by_recursion(n, span, size):
    for seed in range(40):
        r = random.Random(seed)
        boxes = [box(r, span, size) for _ in range(n)]
        assert O.ordered(boxes) == by_recursion(boxes)


def test_reading_order_of_five_thousand_boxes(spark):
    stacked = [{"x": 0, "y": 10 * i, "w": 50, "h": 10, "display_id": 0} for i in range(5000)]
    order = list(range(5000))
    random.Random(1).shuffle(order)
    assert [order[i] for i in O.ordered([stacked[i] for i in order])] == list(range(5000))
    # a staircase of boxes, each cut off on the other axis, is as deep as boxes go
    stairs, x, y, w, h = [], 0, 0, 4000, 4000
    for i in range(1500):
        across = i % 2 == 0
        stairs.append({"x": x, "y": y, "w": w if across else 1, "h": 1 if across else h, "display_id": 0})
        x, y, w, h = (x, y + 1, w, h - 1) if across else (x + 1, y, w - 1, h)
    began = time.time()
    assert O.ordered(stairs) == list(range(1500)) and time.time() - began < 60
    rows = [(1, i, 0, 10 * i, 50, 10, 0, None) for i in range(2000)]
    df = spark.createDataFrame(rows, "frame_id long, idx long, x long, y long, w long, h long, display_id long, parent long")
    assert [r.idx for r in O.reading_order(df).orderBy("place").collect()] == list(range(2000))


# ---- readings


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_same(a, b, like):
    a, b = a.strip(), b.strip()
    return a == b or like < 1 and max(len(a), len(b)) > 0 and 1 - plain_distance(a, b) / max(len(a), len(b)) >= like


def plain_overlap(block, reading, like):
    """All pairs of lines."""
    old, new = X.lines(block), X.lines(reading)
    same = [[plain_same(x, y, like) for y in new] for x in old]
    m, top, end = min(len(old), len(new)), 0, 0
    while top < m and same[top][top]:
        top += 1
    while end < m - top and same[len(old) - 1 - end][len(new) - 1 - end]:
        end += 1
    best, start, last = 0, 0, [0] * (len(new) + 1)
    for i in range(top, len(old) - end):
        now = [0] * (len(new) + 1)
        for j in range(top, len(new) - end):
            if same[i][j]:
                now[j + 1] = (last[j] if j > top else 0) + 1
                if now[j + 1] > best:
                    best, start = now[j + 1], j + 1 - now[j + 1] - top
        last = now
    return top, end, start, best


@pytest.mark.parametrize("like", [1.0, 0.9, 0.7])
def test_overlaps_as_by_all_pairs(like):
    r = random.Random(like)
    words = ["alpha beta", "alpha betb", " alpha beta", "gamma delta eps", "gamma delta", "", "x", "y ", "a longer line of text", "a longer line of test"]
    for _ in range(400):
        block, reading = ("\n".join(r.choice(words) for _ in range(r.randrange(14))) for _ in range(2))
        if r.random() < 0.5:
            cut = r.randrange(8)
            reading = "\n".join([*X.lines(block)[cut:], *X.lines(reading)[: r.randrange(4)]])
        o = X.overlap(block, reading, like)
        assert (o.top, o.end, o.start if o.run else 0, o.run) == plain_overlap(block, reading, like)


def test_same_lines_as_by_distance():
    r = random.Random(3)
    for _ in range(3000):
        a = "".join(r.choice("abc ") for _ in range(r.randrange(12)))
        b = "".join(r.choice("abc ") for _ in range(r.randrange(12))) if r.random() < 0.4 else "".join(c for c in a if r.random() > 0.15) + r.choice(["", "a"])
        for like in (0.5, 0.65, 0.8, 0.95, 1.0):
            assert X.same_line(a, b, like) == plain_same(a, b, like), (a, b, like)


def test_long_readings_take_little_memory():
    import tracemalloc

    block = "\n".join(f"line {i}" for i in range(60_000))
    reading = "\n".join(["head", *(f"line {i}" for i in range(30_000, 60_000)), *(f"new {i}" for i in range(30_000))])
    tracemalloc.start()
    merged = X.merge(block, reading)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert merged.count("\n") == 90_000 and peak < 120e6
    assert X.coverage(block, reading) == pytest.approx(30_000 / 60_001)


# ---- unions of intervals


def test_digest_of_a_crowded_hour(spark):
    """Thousands of spans of many categories in one hour, against a count of seconds."""
    r = random.Random(8)
    rows = [(f"c{r.randrange(4)}", f"a{r.randrange(9)}", s := r.randrange(0, 4000), s + r.choice((0, 1, 5, 40, 700))) for _ in range(3000)]
    df = spark.createDataFrame([(i, c, a, s * SEC, e * SEC) for i, (c, a, s, e) in enumerate(rows)], "id long, category string, activity string, s long, e long")
    got = {x.category: x for x in T.digest(df, 0, 4200 * SEC).collect()}
    of = lambda c: len({t for k, _, s, e in rows if c in (k, None) for t in range(s, min(e, 4200))})
    assert {c: x.seconds for c, x in got.items()} == {c: of(c) for c in {k for k, *_ in rows}}
    assert {x.recorded for x in got.values()} == {of(None)} and sum(x.seconds for x in got.values()) == next(iter(got.values())).attributed


def test_rolling_context_is_a_beginning(spark):
    rows = [(s, i, r, "coding", f"é{i}") for s in (1, 2) for i, r in enumerate((5, 3, 9, 1))]
    df = spark.createDataFrame(rows, "session long, id long, at long, category string, activity string")
    c = T.rolling_context(df, ["session"], ["at", "id"])
    texts = {x.session: x.context for x in T.context_texts(c, ["session"]).collect()}
    for s in (1, 2):
        before = []
        for x in c.where(F.col("session") == s).orderBy("place").collect():
            assert texts[s][: x.context_chars] == "\n".join(before)
            before.append(f"[chunk {x.place}] coding — {x.activity}")
        assert texts[s] == "\n".join(before)


# ---- shuffles


def shuffled_bytes(spark, run):
    """Bytes that the stages of a job write for shuffles."""
    sc = spark.sparkContext
    store, last = sc._jsc.sc().statusStore(), lambda: [sc._jsc.sc().listenerBus().waitUntilEmpty(), store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)][1]
    known = {s.stageId() for s in (x.apply(i) for x in [last()] for i in range(x.size()))}
    run()
    return sum(s.shuffleWriteBytes() for s in (x.apply(i) for x in [last()] for i in range(x.size())) if s.stageId() not in known)


def test_band_join_shuffles_no_pairs(spark):
    """Two thousand utterances of five windows and three thousand frames: six million pairs."""
    u = spark.range(2000).select((F.col("id") % 2).alias("stream"), F.col("id").alias("idx"), (F.col("id") % 5 * 1000).alias("start_ms"), (F.col("id") % 5 * 1000 + 5000).alias("end_ms"))
    f = spark.range(3000).select((F.col("id") % 2).alias("stream"), F.col("id").alias("idx"), (F.col("id") * 7 % 15_000).alias("at_ms"))
    got = {}
    n = shuffled_bytes(spark, lambda: got.update({r.idx: (r.stream, r.frames) for r in O.align(u, f).collect()}))
    assert n < 1_000_000, n
    frames = sorted((i * 7 % 15_000, i) for i in range(3000))
    windows = {(s, k): [i for t, i in frames if i % 2 == s and max(k * 1000 - 3000, 0) <= t <= k * 1000 + 8000] for s in (0, 1) for k in range(5)}
    assert got == {i: (i % 2, windows[i % 2, i % 5]) for i in range(2000)}


DENSE = """
from pyspark.sql import SparkSession, functions as F
from tideline.operators import frames as O
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
f = s.range(4_000_000).select(F.lit(1).alias("stream"), F.col("id").alias("idx"), (F.col("id") * 37 % 6000).alias("at_ms"))
u = s.createDataFrame([(1, i, 0, 3 * i - 3000) for i in range(3)], "stream int, idx long, start_ms long, end_ms long")
print([(r.n, r.first, r.last, r.idx) for r in O.align(u, f, of=lambda m: {"n": F.size(m), "first": F.get(m, 0), "last": F.get(m, F.size(m) - 1)}).orderBy("idx").collect()])
"""


def test_band_join_of_a_dense_bucket_in_little_memory():
    """Four million frames of one bucket, in a JVM of 600 MB; as one row of structs they didn't fit."""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parent.parent), "PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell"}
    run = subprocess.run([sys.executable, "-c", DENSE], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    at = sorted((i * 37 % 6000, i) for i in range(4_000_000) if i * 37 % 6000 <= 6)
    want = [[i for t, i in at if t <= 3 * k] for k in range(3)]
    assert run.stdout.strip() == str([(len(w), w[0], w[-1], k) for k, w in enumerate(want)])


def test_band_join_mixes_windows(spark):
    """Equal lists in a row hide their size from Parquet's writer, which then ran out of memory."""
    u = spark.range(4000).select(F.lit(1).alias("stream"), F.col("id").alias("idx"), (F.col("id") % 40 * 1000).alias("start_ms"), (F.col("id") % 40 * 1000).alias("end_ms"))
    f = spark.range(500).select(F.lit(1).alias("stream"), F.col("id").alias("idx"), (F.col("id") * 100).alias("at_ms"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = O.align(u, f).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 4000 and max(len(list(g)) for _, g in groupby(r.frames for r in rows)) < 20


def test_band_join_cuts_chunks_at_windows_ends(spark, monkeypatch):
    """Chunks of three frames against a filter: equal times over several chunks, windows that end between and within them."""
    monkeypatch.setattr(O, "CHUNK", 3)
    r = random.Random(4)
    frames = [(r.randrange(2), i, r.choice((0, 5, 5, 5, 7, 12, 20, 21, 33, r.randrange(60)))) for i in range(150)]
    spoken = [(r.randrange(3), i, (s := r.randrange(-10, 50)), s + r.choice((-30, -5, 0, 3, 25))) for i in range(80)]
    got = {x.idx: x.frames for x in O.align(spark.createDataFrame(spoken, "stream long, idx long, start_ms long, end_ms long"), spark.createDataFrame(frames, "stream long, idx long, at_ms long"), 4, 3).collect()}
    assert got == {i: [k for t, k in sorted((t, k) for q, k, t in frames if q == p and max(s - 4, 0) <= t <= e + 3)] for p, i, s, e in spoken}


def test_reading_order_of_many_small_frames(spark):
    """A frame took about 8 ms when each was a pandas frame of its own."""
    frames = spark.range(36_000).select(F.floor(F.col("id") / 12).alias("frame_id"), (F.col("id") % 12).alias("idx"), (F.col("id") * 37 % 400).alias("x"), (F.col("id") * 53 % 300).alias("y"), F.lit(30).alias("w"), F.lit(20).alias("h"), F.lit(0).alias("display_id"), F.lit(None).cast("long").alias("parent"))
    frames = frames.coalesce(1).persist()
    frames.count()
    began = time.time()
    got = O.reading_order(frames).groupBy("frame_id").agg(F.sort_array(F.collect_list("place")).alias("p"), F.sort_array(F.collect_list("idx")).alias("i")).where("p = i and size(p) = 12").count()
    assert got == 3000 and time.time() - began < 12


def test_few_boxes_as_many():
    r = random.Random(6)
    for _ in range(500):
        boxes = [box(r, 60, 30) for _ in range(r.randrange(1, 20))]
        assert O._ordered_few(boxes) == by_recursion(boxes)


def test_long_texts_are_folded_by_pieces():
    import pyarrow as pa

    from tideline.operators import folds

    b = pa.RecordBatch.from_pydict({"k": list(range(300)), "text": ["x" * (100_000 if i % 3 else 0) if i % 7 else None for i in range(300)]})
    parts = list(folds.pieces(b))
    assert pa.Table.from_batches(parts).to_pylist() == b.to_pylist() and len(parts) > 3
    assert max(sum(len(t or "") for t in p.column("text").to_pylist()) for p in parts) <= folds.PIECE + 100_000
    assert [p.num_rows for p in folds.pieces(pa.RecordBatch.from_pydict({"text": ["y" * 9_000_000] * 3}))] == [1, 1, 1]
    assert list(folds.pieces(b.slice(0, 0))) == []
