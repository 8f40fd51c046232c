"""Providers, models, sample files, versions of tables, frame reports and marks: worked cases."""

import json
import os
import sys
import time
from datetime import datetime, timezone

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tideline.functions import reports as T
from tideline.operators import providers as P
from tideline.sources import migrations as M
from tideline.sources import samples as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

# ---- region providers


def boxes(rows):
    return sorted((r.frame_id, r.source, r.idx, r.x, r.y, r.w, r.h, r.label) for r in rows)


TREE = {"role": "app", "rect": [0, 0, 9, 9], "name": "a", "children": [{"rect": [1, 1, 0, 3], "children": [{"role": "button", "rect": [2, 2, 3, 3], "name": "inner"}]}, {"rect": [1, 2], "name": "odd"}, 7, {"role": "list", "rect": [4, 4, 2, 2], "children": "x"}]}
FRAMES = [(1, "0 0 5 6 first window\nnonsense\n1 1 0 4 flat\n-3 2 7 8 b", json.dumps(TREE)), (2, None, None), (3, "", "{broken"), (4, "1 2 3 4 x", "[]")]
WM = P.RegionProvider("wm", "window", "free", 1.0, P.WindowList, "listing")
TREES = P.RegionProvider("at_spi", "element", "cheap", 0.9, P.ElementTree, "tree")


class Raises:
    def eval(self, x: str):
        raise RuntimeError("it must not run")
        yield


def test_depth_decides_which_providers_run(spark):
    frames = spark.createDataFrame(FRAMES, "frame_id long, listing string, tree string")
    heavy = P.RegionProvider("vlm", "text", "heavy", 0.5, Raises, "listing")
    inner = P.RegionProvider("crop", "window", "free", 0.5, Raises, "listing", ("pane",))
    windows = [(1, "wm", 0, 0, 0, 5, 6, "first window"), (1, "wm", 1, -3, 2, 7, 8, "b"), (4, "wm", 0, 1, 2, 3, 4, "x")]
    elements = [(1, "at_spi", 0, 0, 0, 9, 9, "a"), (1, "at_spi", 1, 2, 2, 3, 3, "inner"), (1, "at_spi", 2, 4, 4, 2, 2, "")]
    every = [heavy, inner, TREES, WM]
    assert boxes(P.detect(frames, every, "pane").collect()) == windows
    got = P.detect(frames, every, "element")
    assert boxes(got.collect()) == sorted(windows + elements)
    assert {(r.source, r.granularity, r.cost, r.trust) for r in got.collect()} == {("wm", "window", "free", 1.0), ("at_spi", "element", "cheap", 0.9)}
    with pytest.raises(ValueError):
        P.detect(frames, [TREES], "window")


# ---- models


class Logged(P.Stub):
    """Notes each prompt in a file, so that calls from workers can be counted."""

    def __init__(self, path, **kw):
        super().__init__(**kw)
        self.path = path
        self.note("made")

    def note(self, x):
        with open(self.path, "a") as f:
            f.write(x + "\n")

    def analyze(self, prompts, subjects):
        for p in prompts:
            self.note(p.splitlines()[0])
        return super().analyze(prompts, subjects)


def test_an_empty_range_never_reaches_the_model(spark, tmp_path):
    log = str(tmp_path / "calls")
    entries = spark.createDataFrame([(1, 10, 100, 200, "coding", None, "a", None), (1, 11, 50, 100, "docs", "x", "b\nc", "s"), (1, 12, 86_400_000_000 * 3 - 5, 86_400_000_000 * 3 + 5, "docs", "", "long", "")], "session_id long, id long, s long, e long, category string, app string, activity string, summary string")
    q = [(1, 1, "what?", 100, 200), (2, 1, "what?", 200, 300), (3, 2, "what?", 0, 10**12), (4, 1, "w x", 0, 86_400_000_000 * 9), (5, 1, "none", 150, 150)]
    questions = spark.createDataFrame(q, "id long, session_id long, question string, s long, e long")
    got = {r.id: r for r in P.asked(questions, entries, lambda: Logged(log)).collect()}
    assert {i: r.grounding for i, r in got.items()} == {1: [10], 2: [], 3: [], 4: [11, 10, 12], 5: []}
    assert all(got[i].answer == P.NO_RECORD and got[i].error is None for i in (2, 3, 5))
    calls = [x for x in open(log).read().splitlines() if x != "made"]
    assert sorted(calls) == ["QUESTION: w x", "QUESTION: what?"]
    only = P.asked(questions.where("id in (2, 3)"), entries, lambda: Logged(log + "2"))
    assert {r.answer for r in only.collect()} == {P.NO_RECORD} and not os.path.exists(log + "2")


class Wrong(P.Stub):
    def __init__(self, how):
        super().__init__()
        self.how = how

    def analyze(self, prompts, subjects):
        if self.how == "raises":
            raise ConnectionError("lane down")
        return super().analyze(prompts, subjects)[1:]


@pytest.mark.parametrize(("make", "error"), [(lambda: P.Stub(ill="no lane"), "unavailable: no lane"), (lambda: Wrong("raises"), "ConnectionError: lane down"), (lambda: Wrong("short"), "ValueError: 2 replies for 3 prompts")])
def test_failures_are_rows(spark, make, error):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "id long, prompt string").coalesce(1)
    got = P.analyzed(rows, "prompt", "id", make).collect()
    assert [(r.reply, r.error) for r in got] == [(None, error)] * 3


def test_one_failing_prompt_leaves_the_others(spark):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "id long, prompt string")
    got = {r.id: r for r in P.analyzed(rows, "prompt", "id", lambda: P.Stub(frozenset({3})), 2).collect()}
    assert got[3].error == "ValueError: unreadable" and got[3].reply is None and all(json.loads(got[i].reply)["category"] in P.X.CATEGORIES for i in (0, 1, 2, 4))
    assert P.analyzed(rows.where("id > 9"), "prompt", "id", lambda: P.Stub()).collect() == []


@pytest.mark.parametrize("at_once", [1, 3, 256])
def test_chunks_know_those_before_them(spark, at_once):
    """Against a chain, one chunk at a time; a failed chunk is left out of the context."""
    rows = [(s, s * 100 + i, (i * 7) % 11) for s in range(5) for i in range(s * 3)]
    failing = frozenset(r[1] for r in rows if r[1] % 4 == 1)
    want = {}
    for s in range(5):
        context = []
        for place, (_, i, _) in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])), 1):
            reply = P.Stub(failing).analyze([P.chunk_prompt("\n".join(context))], [i])[0]
            want[i] = (place, len(context), None if i in failing else reply, "ValueError: unreadable" if i in failing else None)
            if i not in failing:
                f = json.loads(reply)
                context.append(f"[chunk {place}] {f['category']} — {f['activity']}")
    chunks = spark.createDataFrame(rows, "session long, id long, t long").repartition(3)
    got = P.chunk_summaries(chunks, "session", ["t", "id"], "id", lambda: P.Stub(failing), at_once).collect()
    assert {r.id: (r.place, r.context_chunks, r.reply, r.error) for r in got} == want


# ---- sample files


def sample(display, sequence, second):
    return f"d{display}_w{sequence:06d}_20240101T0000{second:02d}123.png"


def test_sample_source_and_stream(spark, tmp_path):
    S.register(spark)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    names = [sample(d, q, q) for d in (2, 0) for q in range(7)]
    S.write(spark.createDataFrame([(n, n.encode()) for n in names], "name string, data binary"), folder)
    for other in ("notes.txt", "d1_w1_x.png", "d1_w000001_20241399T000000000.png"):
        (tmp_path / "in" / other).write_text("x")
    batch = lambda: sorted(tuple(r) for r in spark.read.format("tideline_samples").option("filesPerPartition", 3).load(folder).collect())
    got = batch()
    assert [r[0] for r in got] == sorted(names) and got[0] == (sample(0, 0, 0), 0, 0, got[0][3], len(names[0]), bytearray(sample(0, 0, 0).encode()))
    at = spark.read.format("tideline_samples").load(folder).select("name", F.unix_millis("taken_at").alias("ms")).where(F.col("name") == sample(2, 3, 3)).first().ms
    assert at == int(datetime(2024, 1, 1, 0, 0, 3, tzinfo=timezone.utc).timestamp() * 1000) + 123
    assert spark.read.format("tideline_samples").load(f"file://{folder}").count() == 14

    def streamed():
        q = spark.readStream.format("tideline_samples").load(folder).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    assert streamed() == got
    time.sleep(0.05)
    for n in (sample(0, 0, 59), sample(1, 99, 1)):  # names before and after those that were read
        (tmp_path / "in" / n).write_text(n)
    assert streamed() == batch() and len(batch()) == 16
    assert streamed() == batch()
    assert spark.read.format("tideline_samples").option("withData", "false").load(folder).where("data is null").count() == 16
    assert spark.read.format("tideline_samples").load(str(tmp_path / "none")).count() == 0


def test_packed_samples_are_read_as_single_ones(spark, tmp_path):
    """Packs and single files in one folder; sequences of more than six digits; few files for many samples."""
    S.register(spark)
    folder = str(tmp_path / "in")
    rows = [(sample(i % 3, 999_000 + i, i % 60), f"{i}".encode() if i % 5 else None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "name string, data binary").repartition(3)
    S.pack(df, f"file://{folder}")
    S.write(spark.createDataFrame([(sample(1, 7, 7), b"single")], "name string, data binary"), folder)
    assert len(list((tmp_path / "in").iterdir())) < 10
    got = spark.read.format("tideline_samples").load(folder)
    want = {(n, len(d or b""), bytes(d or b"")) for n, d in [*rows, (sample(1, 7, 7), b"single")]}
    found = got.select("name", "bytes", "data").collect()
    assert len(found) == 20_001 and {(r.name, r.bytes, bytes(r.data)) for r in found} == want
    assert got.where("sequence >= 1000000").count() == 19_000
    bare = spark.read.format("tideline_samples").option("withData", "false").load(folder)
    assert bare.where("data is null").count() == 20_001


# ---- versions


def test_old_tables_are_read_as_new(spark, tmp_path):
    folder = f"file://{tmp_path}"
    old = spark.createDataFrame([("a", "coding"), ("b", None)], "id string, category string")
    new = spark.createDataFrame([("c", "docs", 7, 1)], "id string, category string, region_id long, display_id int")
    M.write(old, M.ENTRIES, folder, 1)
    M.write(new, M.ENTRIES, folder)
    M.write(new.withColumn("id", F.lit("d")), M.ENTRIES, folder)
    got = M.read(spark, M.ENTRIES, folder)
    assert got.columns == [*M.ENTRIES.schema(2).names, "schema_version"]
    assert sorted((r.id, r.category, r.region_id, r.schema_version) for r in got.collect()) == [("a", "coding", None, 1), ("b", None, None, 1), ("c", "docs", 7, 2), ("d", "docs", 7, 2)]
    M.write(spark.createDataFrame([("r",)], "id string"), M.RECORDINGS, folder, 1)
    M.write(spark.createDataFrame([("s", None)], "id string, encoder_mode string"), M.RECORDINGS, folder, 2)
    assert {r.id: r.encoder_mode for r in M.read(spark, M.RECORDINGS, folder).collect()} == {"r": "in_memory_pipe", "s": None}
    with pytest.raises(ValueError, match="region_id"):
        M.write(new, M.ENTRIES, folder, 1)
    for version in (0, 3):
        with pytest.raises(M.UnknownVersion):
            M.write(old, M.ENTRIES, folder, version)
    old.write.parquet(f"{folder}/timeline_entries/schema_version=9")
    with pytest.raises(M.UnknownVersion, match="9"):
        M.read(spark, M.ENTRIES, folder)


# ---- frame reports

GOOD = "".join(f"frame:{i}    pts:{i * 4}       pts_time:{t}\nlavfi.scene_score=0.{i}\n" for i, t in enumerate((0, 1, 4, 5.25, 9)))


@pytest.mark.parametrize(
    ("report", "files", "want"),
    [
        (GOOD, 5, [0.0, 1.0, 4.0, 5.25, 9.0]), ("", 0, []), ("noise\n", 0, []), (None, 0, []), ("frame:+0 pts_time:1e1\r\n", 1, [10.0]),
        (GOOD, 4, "4 frame files but 5 timestamps"), (GOOD, 6, "6 frame files but 5 timestamps"), (None, 2, "2 frame files but 0 timestamps"),
        ("frame:0    pts:0       pts_time:0\nframe:1    pts:4\n", 2, "no readable pts_time"), ("frame:0 pts:0 pts_time:nan\n", 1, "impossible time"), ("frame:0 pts:0 pts_time:-1\n", 1, "impossible time"), ("frame:0 pts_time:inf", 1, "impossible time"),
        ("frame:0 pts:0 pts_time:1\nframe:1 pts:4 pts_time:1\n", 2, "does not come after"), ("frame:0 pts:0 pts_time:0\nframe:5 pts:4 pts_time:1\n", 2, "reported at position 1"),
        ("frame:x pts:0 pts_time:0\n", 1, "unreadable frame number"), ("frame: 0 pts_time:0\n", 1, "unreadable frame number"), ("frame:0 pts_time:x pts_time:1\n", 1, "no readable pts_time"),
        ("frame:0 pts_time:1\nframe:7 pts_time:0\nframe:x\n", 9, "frame 7 reported at position 1"),
    ],
)
def test_a_report_is_whole_or_refused(spark, report, files, want):
    r = spark.createDataFrame([(report, files)], "report string, files int").select(T.frame_report(F.col("report"), F.col("files")).alias("r")).first().r
    assert r.times == want if isinstance(want, list) else r.times is None and want in r.error


# ---- marks


def described(v):
    """The rule, in plain Python."""
    num = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    arr = lambda o, k: o[k] if isinstance(o, dict) and isinstance(o.get(k), list) else None
    text = lambda o, k, d: o[k] if isinstance(o, dict) and isinstance(o.get(k), str) else d
    away = lambda x: int(abs(x) + 0.5) * (1 if x >= 0 else -1)
    size = arr(v, "size") or []
    sw, sh = map(float, size[:2]) if len(size) >= 2 and num(size[0]) and num(size[1]) else (0.0, 0.0)
    sized = sw > 0 and sh > 0
    pt = lambda o, k: [float(x) for x in arr(o, k) or [] if num(x)]
    px = lambda p: "(?)" if len(p) < 2 else f"({away(p[0] * sw)}, {away(p[1] * sh)})" if sized else f"({p[0]:.3f}, {p[1]:.3f})"
    pix = lambda r: f"({away(r[0] * sw)}, {away(r[1] * sh)}) {away(r[2] * sw)}×{away(r[3] * sh)}"
    marks = arr(v, "annotations")
    if marks is not None:
        if not marks:
            return ""
        out = f"The user drew {len(marks)} annotation(s) on this screenshot. Read them as visual direction (where to look, what to change, what to move):\n"
        for a in marks:
            kind, colour = text(a, "type", "mark"), text(a, "color", "red")
            if kind == "arrow":
                out += f"- {colour} ARROW from {px(pt(a, 'from'))} to {px(pt(a, 'to'))} — points toward / indicates moving something to the arrow's head.\n"
            elif kind == "box":
                r = pt(a, "rect")
                out += f"- {colour} BOX at pixels {pix(r)} — a marked region.\n" if len(r) == 4 and sized else f"- {colour} BOX (normalized {r}).\n"
            elif kind == "pen":
                pts = arr(a, "points")
                ends = [[float(p[i]) for p in pts or [] if isinstance(p, list) and len(p) > i and num(p[i])] for i in (0, 1)]
                out += f"- {colour} freehand PEN mark ({len(pts or [])} pts)" + (f" around {px([min(ends[0]), min(ends[1])])}" if all(ends) else "") + ".\n"
            else:
                out += f"- {colour} {kind} annotation.\n"
        return out
    targets = arr(v, "targets")
    if not targets:
        return ""
    out = f"This screenshot has {len(targets)} annotation box(es) drawn in red. Focus on these marked regions:\n"
    for t in targets:
        r = pt(t, "rect")
        if len(r) == 4:
            out += f'- "{text(t, "label", "box")}": normalized [{", ".join(f"{x:.3f}" for x in r)}]' + (f" ≈ pixels {pix(r)}" if sized else "") + "\n"
    return out


SIDECARS = [
    {"size": [200, 100], "annotations": [{"type": "arrow", "from": [0.1, 0.2], "to": [0.5, 1], "color": "blue"}, {"type": "box", "rect": [0, 0.5, 0.25, 0.125]}, {"type": "pen", "points": [[0.5, 0.25], [0.25, 0.75], [], "x", [1]]}, {"type": "cloud", "color": 3}, {}, 5, None]},
    {"annotations": [{"type": "arrow", "from": [0.1, "x", 0.2], "to": []}, {"type": "box", "rect": [0.0625, 1, 0.1875, 2.5]}, {"type": "pen", "points": []}, {"type": "pen"}, {"type": "pen", "points": [[0.0625, 0.3125]]}, {"type": "box"}]},
    {"size": [0, 100], "targets": [{"label": "a \"b\"", "rect": [0.1, 0.25, 0.0625, 1]}, {"rect": [1, 2, 3]}, {"rect": [1, 2, 3, 4], "label": None}]},
    {"size": [1920, 1080], "targets": [{"label": "x", "rect": [0.5, 0.5, 0.25, 0.25]}]}, {"size": [5], "annotations": []}, {"targets": []}, {"annotations": "x", "targets": [{"rect": [0, 0, 1, 1]}]}, {}, [1], {"size": [True, 4], "annotations": [{"type": "arrow", "from": [True, 0.5, 0.25], "to": [0.5, 0.5]}]},
]


@pytest.mark.parametrize("sidecar", SIDECARS, ids=range(len(SIDECARS)))
def test_marks(spark, sidecar):
    assert spark.createDataFrame([(json.dumps(sidecar),)], "s string").select(T.described_marks(F.col("s"))).first()[0] == described(sidecar)


def test_no_marks(spark):
    assert {r[0] for r in spark.createDataFrame([("not json",), ("",), (None,), ("7",)], "s string").select(T.described_marks(F.col("s"))).collect()} == {""}
