"""Shared pieces: scratch tables in the shared folder, lookups behind a size check, global ranks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and the white space between words: space and the characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

#: Largest side that is broadcast, in bytes as measured; larger sides are joined by a salted shuffle.
BROADCAST_BYTES = 32 << 20
#: Rows of one key that a task takes in a join; keys with more are salted.
HOT_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one in the warehouse."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
        sc.setCheckpointDir(folder)
    folder = folder.removeprefix("file:") if folder.startswith("file:/") and "://" not in folder else folder
    return "file://" + folder if folder.startswith("/") else folder


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tideline/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


#: Folders that scratch tables were written to and are still there, oldest first.
_written: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables and files that were written within, at its end; results must have been written by then.
    Operators return DataFrames that still read theirs, so it is the caller who knows when they can go."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            remove(spark, path)


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def tables(self, name: str) -> list[DataFrame]:
        return [t for t, path in self.paths.values() if path.rsplit("/", 1)[1].startswith(f"{name}-")]

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for t in tables:
            _, path = self.paths.pop(id(t), (None, None))
            if path:
                remove(self.spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def words_of(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def lookup_join(big: DataFrame, small: DataFrame, key: str, spread: Column | None, more: int = 0, counts: DataFrame | None = None) -> DataFrame:
    """Left join to a table with one row per key: a broadcast if its measured size is in bounds, else a shuffle, where
    keys with more than `HOT_ROWS` rows of big are dealt over as many salts as their counts call for.

    spread: any expression that varies over the rows of a hot key, or None where no key is hot (or only by repeated rows,
    which Spark's own splitting of skewed joins covers). more: bytes of arrays in small. counts: (key, n), the rows of
    big with each key, if known."""
    size = small.select(F.sum(F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + F.lit(16 * len(small.columns)))).first()[0] or 0
    if size + more <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), key, "left")
    if spread is None:
        return big.join(small, key, "left")
    salt, salts = fresh(big, "__salt", "__salts")
    n = big.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = Scratch(big.sparkSession).table(n.where(F.col("n") > HOT_ROWS).select(key, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias(salts)), "hot_keys")
    if not 0 < hot.count() * 100 <= BROADCAST_BYTES:
        return big.join(small, key, "left")
    split = small.join(F.broadcast(hot), key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))).drop(salts)
    dealt = big.join(F.broadcast(hot), key, "left").withColumn(salt, F.pmod(F.xxhash64(spread), F.coalesce(salts, F.lit(1))).cast("int")).drop(salts)
    return dealt.join(split, [key, salt], "left").drop(salt)
