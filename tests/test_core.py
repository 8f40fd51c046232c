"""Worked cases of the operators."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.functions import text as X
from tideline.operators import frames as O
from tideline.operators import lifecycle as L
from tideline.operators import timeline as T
from tideline.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SEC = 1_000_000
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Columns that may have one value: totals beside each row, results of a row, and filters' constants.
ONE_VALUE = {
    "agg1_standup_digest": ("recorded", "attributed", "span"), "agg4_sparse_flag": ("recorded", "span", "sparse"), "agg5_digest_text": ("text",), "agg6_entry_count": ("n",), "agg7_storage_used": ("used",),
    "fil12_range_contains": ("holds",), "src10_orphan_adoption": ("reason",), "stm4_pause": ("sample_count", "reason"),
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    o = duck.execute(ORACLES[name])
    cols = [d[0] for d in o.description]
    rows = o.fetchall()
    assert rows and sorted(cols) == sorted(df.columns)
    assert got == sorted(repr([plain(r[cols.index(c)]) for c in sorted(cols)]) for r in rows)
    assert {c for i, c in enumerate(cols) if len({repr(r[i]) for r in rows}) < 2} <= set(ONE_VALUE.get(name, ()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def entries(spark, rows):
    return spark.createDataFrame([(i, c, a, s * SEC, e * SEC) for i, (c, a, s, e) in enumerate(rows)], "id long, category string, activity string, s long, e long")


@pytest.mark.parametrize(
    ("rows", "to", "recorded", "attributed"),
    [
        ([("coding", "x", 0, 7200)] * 2, 28800, 7200, 7200),
        ([("coding", "x", 0, 3600), ("meeting", "y", 0, 3600)], 3600, 3600, 7200),
        ([("coding", "x", 0, 7200), ("coding", "x", 100, 200), ("coding", "x", 300, 7300)], 10000, 7300, 7300),
        ([("comms", "x", 0, 100), ("comms", "x", 50, 150)], 1000, 150, 150),
    ],
)
def test_digest(spark, rows, to, recorded, attributed):
    d = T.digest(entries(spark, rows), 0, to * SEC).collect()
    assert (d[0].recorded, d[0].attributed) == (recorded, attributed)
    assert abs(sum(r.percent for r in d) - 100) < 0.5


def test_digest_edges(spark):
    rows = entries(spark, [("coding", "yesterdays-task", 0, 600), ("coding", "todays-task", 10000, 11000)])
    d = T.digest(rows, 10000 * SEC, 20000 * SEC).collect()
    assert [(r.entries, r.activities, r.seconds) for r in d] == [(2, "todays-task", 1000)]
    assert T.digest(rows.where("false"), 0, SEC).count() == 0
    assert "No activity" in T.render(T.digest(rows.where("false"), 0, SEC)).first().text
    assert T.render(T.digest(entries(spark, [("coding", "x", 0, 7200)] * 2), 0, 28800 * SEC)).first().text.startswith("Only 2h of 8h")


def test_ranges(spark):
    rows = entries(spark, [("coding", "a", 0, 900), ("coding", "b", 900, 1800), ("coding", "c", 1800, 2700)])
    ids = lambda a, b: [r.activity for r in T.overlapping(rows, a * SEC, b * SEC).orderBy("s").collect()]
    assert ids(600, 1500) == ["a", "b"]
    assert ids(900, 1500) == ["b"]


def test_windows(spark):
    s = spark.createDataFrame([(1, 0, i, t * SEC) for i, t in enumerate((0, 300, 600))], "session_id long, display_id long, id long, at long")
    rows = L.segment_windows(s, 600 * SEC, 700 * SEC).orderBy("sequence").collect()
    assert [(r.sequence, r.s // SEC, r.e // SEC, r.sample_count, r.reason) for r in rows] == [(0, 0, 600, 2, "Boundary"), (1, 600, 700, 1, "Stopped")]
    back = spark.createDataFrame([(1, 0, 0, 1000 * SEC)], s.schema)
    assert L.segment_windows(back, 600 * SEC, 0).first().e == 1000 * SEC


def test_windows_with_controls(spark):
    s = spark.createDataFrame([(1, d, i, at * SEC) for d in (1, 2) for i, at in enumerate((0, 10, 30, 50, 70, 90, 110))], "session_id long, display_id long, id long, at long")
    c = [(20, "pause", "Idle", None), (25, "pause", "UserOff", None), (40, "resume_if_automatic", None, None), (60, "resume", None, None), (80, "interval", None, 600 * SEC), (85, "interval", None, 600 * SEC)]
    c = [(1, None, i, at * SEC, *x) for i, (at, *x) in enumerate(c)] + [(1, 2, 9, 100 * SEC, "remove", None, None), (1, None, 10, 120 * SEC, "stop", None, None)]
    c = spark.createDataFrame(c, "session_id long, display_id long, id long, at long, kind string, cause string, interval long")
    got = [(r.display_id, r.sequence, r.s // SEC, r.e // SEC, r.sample_count, r.reason) for r in L.segment_windows(s, 900 * SEC, controls=c).orderBy("display_id", "sequence").collect()]
    first = [(0, 0, 20, 2, "Paused"), (1, 70, 80, 1, "IntervalChanged")]
    assert got == [(1, *x) for x in [*first, (2, 90, 120, 2, "Stopped")]] + [(2, *x) for x in [*first, (2, 90, 100, 1, "DisplayRemoved"), (3, 110, 120, 1, "Stopped")]]


def test_pause_causes():
    for first, then, resumed in (("Idle", "Locked", True), ("Idle", "SourceEnded", False), ("UserOff", "Idle", False), ("SourceOccluded", None, True)):
        w = L.OpenWindow(900)
        w.control(0, "pause", first)
        if then:
            w.control(1, "pause", then)
        w.control(2, "resume_if_automatic")
        assert (w.paused is None) == resumed
    w = L.OpenWindow(900)
    w.control(0, "pause", "UserOff")
    w.control(1, "pause", "SourceEnded")
    assert w.paused == "UserOff"


def test_windows_stream_like_batch(spark, tmp_path):
    from tideline.sources import adapters as A
    from tideline.streaming.segments import segment_windows

    s = A.samples(spark, SF)
    s.coalesce(1).sortWithinPartitions("at").write.parquet(str(tmp_path / "in"))
    stream = segment_windows(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in")), 900 * SEC)
    q = stream.writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("closed")
    want = L.segment_windows(s, 900 * SEC)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_idle(spark):
    polls = spark.createDataFrame([(1, 0, 0, 299, 0), (1, 1, 1, 301, 10), (1, 2, 2, 310, 20), (1, 3, 3, 320, 15)], "session_id long, id long, at long, idle_for long, since_last long")
    assert [tuple(r) for r in L.idle_transitions(polls, 300, 30).collect()] == [(1, 3, "went_idle")]
    flip = spark.createDataFrame([(1, i, i, 299 + 2 * (i % 2), 5) for i in range(40)], polls.schema)
    assert L.idle_transitions(flip, 300, 30).count() == 0


def test_token_bucket(spark):
    calls = spark.createDataFrame([(k, i, 0) for k in (1, 2) for i in range(11)], "key long, id long, at long")
    assert [r.id for r in L.token_bucket(calls, 10.0, 60.0).where("not allowed").collect()] == [10, 10]


MIB = 1 << 20
SEG = "display_id long, sequence long, closed long, summarized boolean, n_raw long, has_warm boolean, raw_bytes long, warm_bytes long"


@pytest.mark.parametrize(
    ("rows", "now", "budget", "want"),
    [
        ([("seg", 1, 0, False)], 10_000_000, 1, ["keep:not_summarized"]),
        ([("seg", 1, 0, True)], 100, 1 << 60, ["keep:within_budget"]),
        ([("seg", 1, 0, True)], 4000, 1 << 60, ["shrink"]),
        ([("warm", 1, 0, True), ("seg", 2, 100, True), ("seg", 3, 200, True)], 500, 150 * MIB, ["keep:within_budget", "shrink", "keep:within_budget"]),
        ([("warm", 1, 0, True), ("seg", 2, 100, True), ("seg", 3, 200, True)], 500, 1, ["drop_warm", "shrink", "shrink"]),
        ([("seg", 1, 0, True), ("seg", 2, 9500, True)], 10000, 150 * MIB, ["shrink", "keep:within_budget"]),
    ],
)
def test_retention(spark, rows, now, budget, want):
    data = [(0, n, at * SEC, done, int(k == "seg"), k == "warm", 100 * MIB * (k == "seg"), 10 * MIB * (k == "warm")) for k, n, at, done in rows]
    plan = L.retention_plan(spark.createDataFrame(data, SEG), now * SEC, 3600 * SEC, 7200 * SEC, budget)
    assert [r.action for r in plan.orderBy("sequence").collect()] == want


def test_align(spark):
    u = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(((727000, 727800), (729000, 730600), (840000, 842200)))], "stream long, idx long, start_ms long, end_ms long")
    f = spark.createDataFrame([(1, i, 720000 + 5000 * (i - 144)) for i in range(144, 152)], "stream long, idx long, at_ms long")
    assert [list(r.frames) for r in O.align(u, f).orderBy("idx").collect()] == [[145, 146], [146], []]
    one = spark.createDataFrame([(1, 0, 100000, 101000)], u.schema)
    g = spark.createDataFrame([(1, i, t) for i, t in enumerate((95000, 98000, 100500, 103000, 106000))], f.schema)
    for lead, lag, want in ((4, 0, [1, 2]), (0, 4, [2, 3]), (2, 6, [1, 2, 3, 4]), (6, 2, [0, 1, 2, 3])):
        assert list(O.align(one, g, lead * 1000, lag * 1000).first().frames) == want


def test_reading_order():
    box = lambda x, y, w, h, d=0: {"x": x, "y": y, "w": w, "h": h, "display_id": d}
    assert O.ordered([box(640, 12, 300, 500), box(10, 10, 300, 500), box(325, 14, 300, 500)]) == [1, 2, 0]
    assert O.ordered([box(10, 600, 300, 200), box(400, 10, 300, 500), box(10, 10, 300, 500), box(400, 600, 300, 200)]) == [2, 1, 0, 3]
    assert O.ordered([box(10, 500, 300, 200, 1), box(10, 10, 300, 200, 0), box(10, 20, 300, 200, 1), box(10, 700, 300, 200, 0)]) == [1, 3, 2, 0]


def test_identities(spark):
    """The identity of a region and of a source."""
    fields = F.concat(*[S.little_endian(F.lit(v)) for v in (0, 2, 100, 200, 300, 400)])
    text = lambda s: F.array(*[F.lit(b) for b in s])
    source = F.concat(text(b"display"), F.array(F.lit(255)), text(b"DP-1"))
    r = spark.range(1).select(S.fnv1a(fields).alias("a"), S.fnv1a(source).alias("b")).first()
    assert r.a % 2**64 == 0x5ACD062A2F31E657
    assert r.b % 2**64 == 0x434DCC3D75A7294C


def test_merge():
    assert X.merge("a\nb\nc", "b\nc\nd\ne") == "a\nb\nc\nd\ne"
    assert X.merge("a\nb", "a\nb") == "a\nb"
    assert X.merge("", "a\nb") == "a\nb"
    assert (X.coverage("a\nb", "a\nb"), X.coverage("a\nb", "x\ny"), X.coverage("a", ""), X.coverage("", "a")) == (1, 0, 0, 0)
    blocks = []
    assert [X.absorb(blocks, t) for t in ("a\nb\nc\nd", "b\nc\nd\ne", "", "x\ny")] == [0, 0, 1, 2]


def test_merge_like_lines():
    assert X.merge("a\nb\nc", "  b\nc  \nd") == "a\nb\nc\nd"
    assert X.coverage("a\n b\nc", "a\nb \nc") == 1
    blocks = []
    assert [X.absorb(blocks, t) for t in ("a\nb\nc\nd", "  b\n  c\n  d\n  e")] == [0, 0] and blocks == ["a\nb\nc\nd\n  e"]
    old, new = "top\nthe first line\nthe second line", "the f1rst line\nthe second l1ne\nend"
    assert X.merge(old, new) == f"{old}\n{new}"
    assert X.merge(old, new, 0.9) == f"{old}\nend"
    assert X.same_line("kitten", " sitting", 0.57) and not X.same_line("kitten", "sitting", 0.58)


def test_prices(spark):
    from tideline.plans import lifecycle as P

    rows = [(1684, 896, 1369, "gemini-3.8-flash", 0.009757), (300000, 1000, 0, "gemini-3.1-pro-preview", 1.218), (300000, 1000, 0, "gemini-3.8-flash", 0.22875)]
    con = duckdb.connect()
    for i, o, t, m, usd in rows:
        x = dict(zip(("pin", "long", "out", "out_long"), next(p[1:] for p in P.PRICES if p[0] == m), strict=True))
        pin, pout = (x["long"], x["out_long"]) if i > 200_000 else (x["pin"], x["out"])
        assert round((i * pin + (o + t) * pout) / 1e6, 6) == usd
    con.close()


def test_reference_cases(spark):
    """Rules whose result is stated in the rules themselves."""
    from tideline.functions import rules as R

    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(X.redact(F.lit("https://h/v?key=abc-D_1&x=2; AIzaSy12,"))) == "https://h/v?key=<redacted>&x=2; <redacted>,"
    assert value(X.redact(F.lit("key= key=)AIza"))) == "key=<redacted> key=<redacted>)<redacted>"
    assert tuple(value(X.chunk_summary(F.lit('ok {"category": " Docs ", "app": "x"}')))) == ("docs", "x", "", "")
    assert tuple(value(X.chunk_summary(F.lit("w" * 100)))) == ("other", "", "w" * 80, "w" * 100)
    assert value(R.display_name(F.lit(0), F.lit(1920), F.lit(1080), F.lit(True))) == "Display 1 (1920x1080, Primary)"
    assert [value(R.percent_decode(F.lit(x))) for x in ("a+b%20c", "100%", "%zz%41", "%C3%A9")] == ["a b c", "100%", "%zzA", "é"]
    assert value(R.percent_encode(F.lit("a b~*é+%"))) == "a%20b~%2A%C3%A9%2B%25"
    assert [value(R.ordinal(F.lit(x))) for x in ("the second", "pane 3 of 40", "#13 7", "none")] == [2, 3, 7, None]
    assert R.newest_first(spark.createDataFrame([(1, n) for n in ("g-3.8-a", "g-3.10-a", "g-latest", "g-3.8.1-a", "house")], "c long, n string"), ["c"], "n").orderBy("place").select("n").collect() == [("g-latest",), ("house",), ("g-3.10-a",), ("g-3.8.1-a",), ("g-3.8-a",)]


def test_locate(spark):
    from tideline.functions import rules as R

    boxes = [(0, 0, 0, "pane", "Editor"), (1, 500, 0, "pane", "Terminal"), (2, 900, 10, "pane", "Browser"), (3, 0, 600, "window", "Log")]
    regions = spark.createDataFrame([(f, *b, None) for f in range(8) for b in boxes], "frame_id long, idx long, x long, y long, kind string, label string, role string")
    asks = ["the second pane", "rightmost pane", "middle pane", "terminal please", "bottom", "pane 9", "the log window", "zzz"]
    got = R.located(spark.createDataFrame(list(enumerate(asks)), "frame_id long, request string"), regions).orderBy("frame_id").collect()
    assert [r.idx for r in got] == [1, 2, 1, 1, 3, 2, 3, None]


def slow_compression(data):
    """By the definition, every candidate compared byte by byte."""
    n = len(data)
    literal = -sum(c / n * math.log2(c / n) for c in Counter(data).values())
    bits, i = 0.0, 0
    while i < n:
        best, looked = 0, 0
        for c in range(i - 1, -1, -1):
            if i + 3 > n or i - c > 32768 or looked >= 128:
                break
            if data[c : c + 3] == data[i : i + 3]:
                looked += 1
                m = 0
                while i + m < n and m < 258 and data[c + m] == data[i + m]:
                    m += 1
                best = max(best, m)
        copied = best >= 3 and best * literal > 24.0
        bits, i = bits + (24.0 if copied else literal), i + (best if copied else 1)
    return bits / 8 / n


def test_compression():
    r = random.Random(4)
    words = ["".join(r.choice("abcdef ") for _ in range(r.randint(1, 9))) for _ in range(40)]
    for data in (b"a" * 3000, "".join(r.choice(words) for _ in range(500)).encode(), bytes(r.randrange(256) for _ in range(600)), b"x", b"abcabcabcabc" * 40):
        assert abs(X.compression(data) - slow_compression(data)) < 1e-9
    assert X.compression(b"") == 0


def slow_blocks(texts):
    """The folding of readings on plain lists, by trying every alignment."""
    blocks = []
    for t in texts:
        best = None
        new = [x.strip() for x in X.lines(t)]
        for i in range(max(0, len(blocks) - 5), len(blocks)) if t.strip() else ():
            old = [x.strip() for x in blocks[i]]
            top = 0
            while top < min(len(old), len(new)) and old[top] == new[top]:
                top += 1
            end = 0
            while end < min(len(old), len(new)) - top and old[-1 - end] == new[-1 - end]:
                end += 1
            o, m = old[top : len(old) - end], new[top : len(new) - end]
            run = max(((n, -a, -b) for a in range(len(o)) for b in range(len(m)) for n in range(1, min(len(o) - a, len(m) - b) + 1) if o[a : a + n] == m[b : b + n]), default=(0, 0, 0))
            share = 0.0 if not new else 1.0 if not m or old and not o else (top + end) / len(new) if (top + end) / len(new) >= 0.9 else run[0] / len(m)
            if best is None or share >= best[0]:
                best = share, i, top, end, run, m
        if best is None or best[0] < 0.65:
            blocks.append(X.lines(t))
            continue
        share, i, top, end, run, m = best
        raw, block = X.lines(t)[top : len(new) - end], blocks[i]
        if m:
            blocks[i] = block[: len(block) - end] + raw[: -run[2]] + raw[-run[2] + run[0] :] + block[len(block) - end :]
    return ["\n".join(b) for b in blocks]


def test_blocks_by_brute_force(spark):
    r = random.Random(3)
    for seed in range(6):
        page = [f"line {seed} {i} {r.randrange(4)}" for i in range(30)]
        texts = ["\n".join(["menu", *page[a : a + r.randint(3, 9)], "status"]) for a in sorted(r.randrange(22) for _ in range(14))] + ["", "other\ntext"]
        d = spark.createDataFrame([(seed, i, t) for i, t in enumerate(texts)], "stream_id long, seq long, text string")
        assert [x.text for x in X.blocks_of(d).orderBy("block").collect()] == slow_blocks(texts)


def test_fuse_by_brute_force(spark):
    from tideline.sources import adapters as A

    rows = [x.asDict() for x in A.regions(spark, SF).collect()]
    want = Counter()
    for f in {x["frame_id"] for x in rows}:
        kept = []
        for b in sorted((x for x in rows if x["frame_id"] == f), key=lambda x: (-x["trust"], x["idx"])):
            for k, sources in kept:
                w = min(k["x"] + k["w"], b["x"] + b["w"]) - max(k["x"], b["x"])
                h = min(k["y"] + k["h"], b["y"] + b["h"]) - max(k["y"], b["y"])
                share = w * h / (k["w"] * k["h"] + b["w"] * b["h"] - w * h) if w > 0 and h > 0 else 0
                if (k["display_id"], k["granularity"]) == (b["display_id"], b["granularity"]) and share >= 0.7:
                    sources += [b["source"]] if b["source"] not in sources else []
                    break
            else:
                kept.append((b, [b["source"]]))
        want.update((f, k["idx"], ",".join(s)) for k, s in kept)
    assert Counter(tuple(x) for x in O.fuse(A.regions(spark, SF)).collect()) == want


def test_entry_provenance(spark):
    from tideline.sources import adapters as A

    first = {r.frame_id: r.idx for r in QUERIES["geo8_entry_provenance"](spark, SF).collect()}
    order = QUERIES["geo6_reading_order"](spark, SF).collect()
    assert first == {r.frame_id: r.idx for r in order if r.place == 0}
    frames = Counter(r.frame_id for r in order)
    assert frames == Counter(r.frame_id for r in A.regions(spark, SF).collect())
    assert all(sorted(r.place for r in order if r.frame_id == f) == list(range(n)) for f, n in frames.items())


def test_ranges_reach_the_scan(spark):
    for name in ("fil1_timeline_range", "agg1_standup_digest"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "LessThan(ts" in plan


def test_windows_stream_with_controls(spark, tmp_path):
    from tideline.streaming.segments import segment_windows

    rows = [(1, 0, i, at * SEC, None, None, None) for i, at in enumerate((0, 10, 30, 50, 70, 90, 110))]
    rows += [(1, 0, 20 + i, at * SEC, k, c, n) for i, (at, k, c, n) in enumerate([(20, "pause", "Idle", None), (40, "resume", None, None), (80, "interval", None, 600 * SEC), (120, "stop", None, None)])]
    s = spark.createDataFrame(rows, "session_id long, display_id long, id long, at long, kind string, cause string, interval long")
    s.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = segment_windows(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in")), 900 * SEC).writeStream.format("memory").queryName("controlled").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r.s // SEC, r.e // SEC, r.sample_count, r.reason) for r in spark.table("controlled").orderBy("sequence").collect()]
    assert got == [(0, 20, 2, "Paused"), (50, 80, 2, "IntervalChanged"), (90, 120, 2, "Stopped")]


def test_sample_names_keep_long_sequences(spark, tmp_path):
    """Sequences of more than six digits against the SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW old AS SELECT * FROM '{SF}/events.parquet'")
    con.execute(f"COPY (SELECT event_id * 12345 AS event_id, ts, user_id * 54321 AS user_id, * EXCLUDE (event_id, ts, user_id) FROM old) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("src7_sample_filename", "src8_sample_files"):
        df = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want)


def test_identities_against_plain_arithmetic(spark):
    """Random bytes, and codes above 255, which are combined whole."""
    r = random.Random(4)
    rows = [[r.randrange(256) for _ in range(r.randrange(60))] for _ in range(300)] + [[0x4F60, 5, 0x1F600], []]
    want = []
    for row in rows:
        h = 14695981039346656037
        for v in row:
            h = (h ^ v) * 1099511628211 % 2**64
        want.append(h)
    df = spark.createDataFrame(list(enumerate(rows)), "i long, v array<int>")
    assert [x.h % 2**64 for x in df.select("i", S.fnv1a(F.col("v")).alias("h")).orderBy("i").collect()] == want


def test_identities_take_no_decimals(spark):
    """Decimal arithmetic took some hundreds of microseconds a row."""
    plan = spark.range(1).select(S.fnv1a(F.array(F.col("id"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal" not in plan


def test_compression_of_common_beginnings():
    """Each place had 128 earlier ones to be compared with."""
    import time

    r = random.Random(9)
    words = ["".join(r.choice("etaoin") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    data = " ".join(r.choice(words) for _ in range(60_000)).encode()
    began = time.time()
    assert 0 < X.compression(data) < 1 and time.time() - began < 3
    short = data[:3000]
    assert abs(X.compression(short) - slow_compression(short)) < 1e-9


def test_rolling_context_is_given_whole(spark, tmp_path):
    """Crowded days against the SQL: every chunk has the lines of all before it."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id, ts, user_id % 3 AS user_id, * EXCLUDE (event_id, ts, user_id) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = QUERIES["stm14_rolling_context"](spark, str(tmp_path))
    assert df.columns == ["session_id", "id", "context"]
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(con.execute(ORACLES["stm14_rolling_context"]).fetchall()) and any(c.count("\n") > 0 for _, _, c in got)
