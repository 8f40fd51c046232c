"""Folds over each key's rows in order, where no window or aggregate says the rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of rows that are Python objects at once, about.
PIECE = 4 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows in runs of about PIECE bytes each, one row at least: long texts fill a task's memory many times
    over once they, what is made of them and what is given out are Python objects of a whole batch."""
    size = sum((_sizes(c) for c in batch.columns), np.zeros(batch.num_rows, np.int64))
    number = np.cumsum(size) // PIECE
    for a, b in zip(cuts := [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows], cuts[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value; a mean for values other than texts."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(column), column.nbytes // max(len(column), 1), np.int64)


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], make: Callable[[], object], schema: str) -> DataFrame:
    """What a machine gives for each key's rows: make() builds one, its step(*values) takes the columns that are not keys,
    in the order of rows, and end() follows the last row; both return rows without the keys. schema: keys, then those.

    Keys are dealt and sorted by Spark; a task reads them one after the other in Arrow batches and keeps one machine, so
    a key's rows are never together in memory, however many they are."""
    rest = [c for c in rows.columns if c not in keys]
    n, fields = len(keys), StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, machine, out = None, None, []
        for batch in (p for b in batches for p in pieces(b)):
            for row in zip(*[batch.column(c).to_pylist() for c in (*keys, *rest)], strict=True):
                if row[:n] != key:
                    if machine is not None:
                        out.extend((*key, *r) for r in machine.end())
                    key, machine = row[:n], make()
                out.extend((*key, *r) for r in machine.step(*row[n:]))
            if out:
                yield pack(out)
                out = []
        if machine is not None:
            out.extend((*key, *r) for r in machine.end())
        if out:
            yield pack(out)

    return rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, fields)
