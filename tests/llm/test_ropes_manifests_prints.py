"""Operators 11 to 13 against brute force, on small tables with nulls, repeats, ties and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, ROWS, text_of

from tideline.llm import fill_middle, fingerprints, merkle, neardup
from tideline.llm.common import scope

MORE = [
    (20, "a <P> b " * 9, "en", "a", 1), (21, "x<S>" + text_of(8, 20), "en", None, 1), (22, "< P> <M", None, "z", 1), (22, "another text of that id", "en", "z", 1), (23, "ABC é\U0001f600Def" * 40, "en", "a", 1),
    (25, "".join(chr(c) for c in range(1, 600)), "en", "b", 1), (-3, "PS> <P <<M>", "en", "a", 1),
]
ALL = ROWS + MORE


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ALL, DOCS)
    for c in ("tree", "i", "n", "h", "run", "at", "cell", "form", "output", "key", "th", "bytes", "hi", "range", "late", "kind", "k", "bands"):
        d = d.withColumn(c, F.lit("x"))
    return d.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---- operator 11


def middle_moved(doc_id, text, seed=1):
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(docs, empty):
    out = fill_middle.restore(fill_middle.transform(docs)).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out) == Counter((i, *middle_moved(i, t or "")) for i, t, *_ in ALL)
    assert Counter((r.doc_id, r.restored) for r in out) == Counter((i, t or "") for i, t, *_ in ALL)
    assert fill_middle.restore(fill_middle.transform(empty)).collect() == []


def test_fill_middle_forms_and_shares(spark):
    rows = [(i, text_of(i, i % 30 + 1)) for i in range(3000)]
    out = fill_middle.restore(fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id: r.restored for r in out} == dict(rows)
    forms = Counter(r.form for r in out)
    assert 0.08 < forms["plain"] / 3000 < 0.12 and 0.17 < forms["spm"] / (forms["spm"] + forms["psm"]) < 0.23


def test_words_stay_whole(spark):
    """With words as units no output cuts one, and the number of units is that of the words."""
    rows = [(i, text_of(i, 50) + " ") for i in range(60)]
    out = fill_middle.restore(fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"), unit=r"\S+"), unit=r"\S+").collect()
    for r in out:
        assert r.n == 50 and r.restored == dict(rows)[r.doc_id]
        assert Counter(re.sub("<[PSM]>", " ", r.output).split()) == Counter(r.restored.split())


@pytest.mark.parametrize("unit", [fill_middle.UNIT, r"\S+", r"[^\n]*\n"])
def test_rope_splits(unit, monkeypatch):
    monkeypatch.setattr(fill_middle, "LEAF", 3)
    units = fill_middle.Units(unit)
    text = "  one two\nthree  é\U0001f600 x\n\nlast line\n and " + "more " * 11
    starts = list(range(len(text))) if unit == fill_middle.UNIT else [0, *[m.start() for m in re.finditer(unit, text)][1:]]
    rope = units.rope(text)
    assert (rope.units, rope.points, fill_middle.text_of(rope)) == (len(starts), len(text), text)
    for k in range(len(starts) + 1):
        at = starts[k] if k < len(starts) else len(text)
        left, right = units.split(rope, k)
        assert (fill_middle.text_of(left), fill_middle.text_of(right)) == (text[:at], text[at:])
        assert (left.units, left.points, right.units, right.points) == (k, at, len(starts) - k, len(text) - at)
    for k in range(len(text) + 1):
        left, right = units.split(rope, k, True)
        assert (fill_middle.text_of(left), fill_middle.text_of(right)) == (text[:k], text[k:]) and left.points == k


def test_rope_of_a_very_long_text():
    text = "é" * 3_000_000 + "z"
    units = fill_middle.Units()
    left, right = units.split(units.rope(text), 2_999_999)
    assert (left.points, fill_middle.text_of(right)) == (2_999_999, "éz")
    depth = lambda x: 0 if isinstance(x, fill_middle.Leaf) else 1 + max(depth(x.left), depth(x.right))
    assert depth(fill_middle.balanced([left, right])) < 15


# ---- operator 12


def tree_of(hashes):
    """The root, and for each leaf the (before, after) of every level from its own up."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for path, i in zip(paths, at, strict=True):
            run, k = runs[i // 16], i % 16
            path.append(("".join(run[:k]), "".join(run[k + 1 :])))
        at = [i // 16 for i in at]
        level = [sha("".join(r)) for r in runs]
    return level[0], paths


def manifested(rows):
    def leaf(i, text, lang, source, n_chars):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n_chars, text)))

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    sub = {s: tree_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, tops = tree_of([sub[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for (_, _, digest, r), path in zip(sorted(by[s], key=lambda x: x[:3]), sub[s][1], strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            node = leaf(r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), *r[2:]) if tampered else digest
            for before, after in path + top:
                node = sha(before + node + after)
            out.append((r[0], digest, sub[s][0], root, sha("".join(b + a for b, a in path + top)), node, node == root))
    return out


def check_manifest(df, rows):
    with scope(df.sparkSession):
        got = merkle.manifest(df, merkle.tamper(df)).collect()
    assert Counter(map(tuple, got)) == Counter(manifested(rows))
    return got


def test_merkle(docs, empty):
    got = check_manifest(docs, ALL)
    assert {r.verified for r in got} == {True, False}
    assert merkle.manifest(empty, merkle.tamper(empty)).collect() == []
    one = empty.sparkSession.createDataFrame(ROWS[:1], DOCS)
    check_manifest(one, ROWS[:1])


def test_merkle_of_deep_trees(spark):
    """A source of two levels of buckets, sources of one bucket and of some leaves, more sources than a run, no row order."""
    r = random.Random(5)
    rows = [(i, f"T{i}", "en", "hot", i) for i in range(66_000)] + [(100_000 + i, f"t{i}", None, f"s{i % 300}", i) for i in range(700)]
    rows += [(200_000 + i, None, "de", None, i) for i in range(17)] + [(300_000 + i, "U", "de", "￮" if i < 257 else "\U0001f600", i) for i in range(300)]
    r.shuffle(rows)
    check_manifest(spark.createDataFrame(rows, DOCS).repartition(5), rows)


def test_manifest_without_tampering(docs):
    assert {r.verified for r in merkle.manifest(docs).collect()} == {True}


# ---- operator 13


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def plain_print(text):
    """A fingerprint by whole numbers, one function and shingle at a time."""
    grams = [int(g) for g in np.unique(fingerprints.joined(fingerprints.hashed_words(text)))]
    assert len(grams) == len(shingles(text))
    mixed = lambda x: int(neardup.mix64(np.array([x], np.uint64))[0])
    least = [min(((mixed(j) >> 32 | 1) * (g >> 32) + (mixed(j + 1000) >> 32)) % 2**32 for g in grams) if grams else 2**32 - 1 for j in range(1, fingerprints.HASHES + 1)]
    return "".join(f"{mixed(x) >> 48:04x}" for x in least)


def same(a, b):
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / fingerprints.HASHES


def edited_by_hand(rows):
    """The contract over rows whose (doc_id, text) are distinct and in the order of the operator."""
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        new = text[: len(text) - q] + after[:q]
        a, b, c = map(plain_print, (text, new, after))
        near = lambda x, y, s, t: same(x, y) if s and t else float(not s and not t)
        out.append((i, len(text), sha(new), a, b, near(a, b, shingles(text), shingles(new)), near(a, c, shingles(text), shingles(after))))
    return out


def check_edited(spark, df, rows):
    with scope(spark):
        got = fingerprints.edited(df).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter(rows)
    return got


def test_fingerprints_of_edited_texts(spark):
    rows = [(i, t or "") for i, t, *_ in ALL if i is not None and len(t or "") < 3000]
    rows = [r for k, r in enumerate(rows) if r[0] not in {i for i, _ in rows[:k]}]
    want = edited_by_hand(sorted(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit("x")).withColumn("kind", F.lit("y")).repartition(3)
    got = check_edited(spark, df, want)
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(df).collect()} == {r.doc_id: r.fingerprint for r in got}
    check_edited(spark, df.where("doc_id = 9"), edited_by_hand([r for r in rows if r[0] == 9]))
    check_edited(spark, df.where("doc_id < 0 or doc_id = 1"), edited_by_hand(sorted(r for r in rows if r[0] in (-3, 1))))
    assert fingerprints.edited(df.where("doc_id = 4711")).collect() == []


@pytest.mark.parametrize("bytes_", [1 << 30, 500])
def test_repeated_and_null_ids(spark, monkeypatch, bytes_):
    """Rows that repeat are one document in the order; ties go by the hash of the text; null comes first. With few
    ranges and with many."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", bytes_)
    rows = [(i, t or "") for i, t, *_ in ALL if len(t or "") < 3000] + [(30, "hot words of a row that repeats itself")] * 200
    hashed = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(set(rows), key=lambda r: (-(2**63) if r[0] is None else r[0], hashed[r[1]]))
    count, once = Counter(rows), dict(zip(order, edited_by_hand(order), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = check_edited(spark, df, [once[r] for r in order for _ in range(count[r])])
    assert {r.n_links for r in got if r.doc_id == 30} == {199} and {r.class_id for r in got if r.doc_id == 30} == {30}


def test_fingerprint_classes(spark):
    """Classes and links against all pairs of sets, for copies altered so that similarities lie around 0.8."""
    r, rows = random.Random(3), []
    for g in range(30):
        words = text_of(100 + g, 60).split()
        for _ in range(6):
            w = list(words)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"new{r.randrange(99)}"
            rows.append((len(rows), " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    links = {i: [j for j in sets if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in sets}
    with scope(spark):
        got = {x.doc_id: x for x in fingerprints.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i].n_links == len(links[i]) for i in sets) >= 0.98 * len(sets)  # the recall of the bands
    near = {i: got[i].class_id for i in sets}
    assert all(near[i] == near[j] for i in sets for j in links[i] if got[i].n_links == len(links[i]) and got[j].n_links == len(links[j]))
    assert all(near[i] <= i for i in sets)


def test_likeness_estimates_jaccard():
    r, off = random.Random(9), []
    words = text_of(77, 400).split()
    for _ in range(40):
        w = list(words)
        for _ in range(r.randint(1, 60)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        a, b = shingles(" ".join(words)), shingles(" ".join(w))
        x, y = (fingerprints.printed(fingerprints.Document(" ".join(t)).sig) for t in (words, w))
        off.append(fingerprints.likeness(x, y, False, False) - len(a & b) / len(a | b))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06
