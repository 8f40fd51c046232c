"""Fill-in-the-middle transformation over ropes (operator 11).

A text is a rope: leaves hold some of its units and know how many units and code points they have, inner nodes know the
sums. A unit is a match of a pattern, left to right, with the code points up to the next one; by default each code point is
one. Two unit ranks, drawn from a hash of the seed and doc_id, split the tree into prefix, middle and suffix; the parts are
joined in another order with sentinels between them, and only then made a string. `restore` makes a rope of the output,
splits it where the sentinels stand and joins the parts in their first order.

Defined cases: a null text is empty; a null doc_id counts as an empty one in the hash; empty texts, texts that contain a
sentinel and a share drawn by the hash stay plain; repeated rows are transformed one by one and alike; an empty table
gives an empty result; columns other than doc_id and text are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of a hundred texts so many are transformed, and of a hundred of these so many have the suffix first.
RATE, SPM_RATE = 90, 20
#: A unit: any code point.
UNIT = r"(?s:.)"
#: Units of a leaf.
LEAF = 2048


@dataclass(frozen=True, slots=True)
class Leaf:
    text: str
    units: int
    points: int


@dataclass(frozen=True, slots=True)
class Node:
    left: Leaf | Node
    right: Leaf | Node
    units: int
    points: int


Rope = Leaf | Node
EMPTY = Leaf("", 0, 0)


def join(a: Rope, b: Rope) -> Rope:
    if not a.points:
        return b
    return Node(a, b, a.units + b.units, a.points + b.points) if b.points else a


def balanced(parts: list[Rope]) -> Rope:
    """One rope of many, in order, a level at a time."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else EMPTY


class Units:
    """Ropes over one kind of unit."""

    def __init__(self, unit: str = UNIT):
        self.single = unit == UNIT
        self.find = re.compile(unit).finditer

    def _starts(self, text: str) -> list[int]:
        """Where units begin; what stands before the first match belongs to the first unit."""
        at = [m.start() for m in self.find(text)]
        return [0, *at[1:]] if at else []

    def rope(self, text: str) -> Rope:
        if self.single:
            pieces = (text[i : i + LEAF] for i in range(0, len(text), LEAF))
            return balanced([Leaf(p, len(p), len(p)) for p in pieces])
        at = self._starts(text)
        if not at:
            return Leaf(text, 0, len(text))
        ends = [*at[::LEAF], len(text)]
        return balanced([Leaf(text[a:b], min(LEAF, len(at) - i * LEAF), b - a) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))])

    def split(self, rope: Rope, rank: int, by_points: bool = False) -> tuple[Rope, Rope]:
        """What stands before the unit (or the code point) of that rank, and the rest. Goes down one path."""
        above = []  # the halves passed by, and whether they lie to the left
        while isinstance(rope, Node):
            here = rope.left.points if by_points else rope.left.units
            if rank < here:
                above.append((rope.right, False))
                rope = rope.left
            else:
                above.append((rope.left, True))
                rope, rank = rope.right, rank - here
        left, right = self._cut(rope, rank, by_points)
        for half, is_left in reversed(above):
            left, right = (join(half, left), right) if is_left else (left, join(right, half))
        return left, right

    def _cut(self, leaf: Leaf, rank: int, by_points: bool) -> tuple[Rope, Rope]:
        if rank <= 0:
            return EMPTY, leaf
        if rank >= (leaf.points if by_points else leaf.units):
            return leaf, EMPTY
        if self.single:
            return Leaf(leaf.text[:rank], rank, rank), Leaf(leaf.text[rank:], leaf.units - rank, leaf.points - rank)
        at = self._starts(leaf.text)
        point = rank if by_points else at[rank]
        before = sum(a < point for a in at)
        return Leaf(leaf.text[:point], before, point), Leaf(leaf.text[point:], len(at) - before, leaf.points - point)


def text_of(*ropes: Rope) -> str:
    out, todo = [], list(reversed(ropes))
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            todo += (x.right, x.left)
        else:
            out.append(x.text)
    return "".join(out)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four 8-digit groups of the hex sha256 of seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _sentinel(s: str) -> Leaf:
    return Leaf(s, 0, len(s))


def transformed(units: Units, doc_id: int | None, text: str, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output)"""
    rope = units.rope(text)
    one, two, three, four = draws(seed, doc_id)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or three % 100 >= rate:
        return rope.units, "plain", None, None, text
    a, b = sorted((one % (rope.units + 1), two % (rope.units + 1)))
    rest, suffix = units.split(rope, b)
    prefix, middle = units.split(rest, a)
    p, s, m = map(_sentinel, (PREFIX, SUFFIX, MIDDLE))
    if four % 100 < spm_rate:
        form, parts = "spm", [s, suffix, p, prefix, m, middle]
    else:
        form, parts = "psm", [p, prefix, s, suffix, m, middle]
    return rope.units, form, prefix.points, middle.points, text_of(balanced(parts))


def restored(units: Units, form: str, output: str) -> str:
    """The text that an output came from. Its parts hold no sentinel, and none can begin in one part and end in another:
    what follows a part begins with the sentinel's first character, which it has nowhere else."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second, len(first))
    mid = output.index(MIDDLE, at + len(second))
    rest, middle = units.split(units.rope(output), mid + len(MIDDLE), True)
    head, tail = units.split(rest, at, True)
    part = {first: units.split(head, len(first), True)[1]}
    part[second], _ = units.split(units.split(tail, len(second), True)[1], mid - at - len(second), True)
    return text_of(balanced([part[PREFIX], middle, part[SUFFIX]]))


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = UNIT, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """A row per document: doc_id, n (units), form, prefix_chars, middle_chars, output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(unit)
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = [transformed(units, i, t or "", seed, rate, spm_rate) for i, t in zip(ids, b.column("text").to_pylist(), strict=True)]
            cols = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, cols, kinds)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(df: DataFrame, unit: str = UNIT) -> DataFrame:
    """df (form, output, ...) with the column restored, the text of before."""
    schema = StructType([*df.schema.fields, StructField("restored", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(unit)
        for b in batches:
            texts = [restored(units, f, o) for f, o in zip(b.column("form").to_pylist(), b.column("output").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "restored"])

    return df.mapInArrow(run, schema)


def op11(spark, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    out = restore(transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) h FROM documents),
e AS (SELECT *, length(t) n, ('0x' || substr(h, 1, 8))::BIGINT h1, ('0x' || substr(h, 9, 8))::BIGINT h2,
  ('0x' || substr(h, 17, 8))::BIGINT h3, ('0x' || substr(h, 25, 8))::BIGINT h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END form FROM e),
g AS (SELECT *, substr(t, 1, a) p, substr(t, a + 1, b - a) m, substr(t, b + 1) s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END prefix_chars, CASE WHEN form <> 'plain' THEN b - a END middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) output_sha256, sha256(t) restored_sha256
FROM g
"""
