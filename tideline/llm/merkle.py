"""Merkle manifest of a dataset: leaves, subroots by source, a root, and proofs (operator 12).

A leaf is the hash of a row's fields. Leaves are range-sorted by source, doc_id and digest, and numbered within their
source from the rows of each range, so a source that holds most rows spreads over ranges. `ALIGNED` consecutive leaves of
a source, from a multiple of that number on, are a bucket: a whole subtree. Some buckets make a cell, an Arrow table of
bounded size, in which DuckDB runs the level queries: an ordered string_agg of each run of `WIDTH` nodes, and its sha256.
Spark combines the buckets' roots, and the sources' subroots, a level at a time, and goes down again with the outer
part of the proofs, which meets the leaves once for each bucket. Runs have at most `WIDTH` nodes on all levels, so no step
gathers more than that, a bucket or a cell.

Defined cases: null and empty fields differ; a null doc_id comes before others and is not tampered with; a null source is
a source, the first one; rows that share source and doc_id follow each other by digest; rows that repeat are leaves of
their own, with the same digest and with proofs by place; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lookup_join

#: Nodes of a run.
WIDTH = 16
#: Levels within a bucket, and its leaves.
LEVELS = 3
ALIGNED = WIDTH**LEVELS
#: Rows of a range, about.
RANGE_ROWS = 250_000
#: Digits of a digest.
DIGITS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*fields: Column) -> Column:
    """The hash of fields: `-` if null, else UTF-8 bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def ranked(rows: DataFrame, tree: str, order: list[str], scratch: Scratch, n: int) -> DataFrame:
    """rows with `i`, the number from 0 within its tree in that order, and `n`, the rows of the tree. No column may have
    these names, `part`, `at` or `run`. n: the rows in all."""
    by = [tree, *order]
    s = rows.repartitionByRange(max(1, -(-n // RANGE_ROWS), min(n // 1000, 64)), *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    s = scratch.table(s.withColumn("run", F.concat_ws(":", F.shiftright("at", 33), tree)), "sorted")  # the id's upper bits are the range's number
    runs = s.groupBy("run", tree).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    w = Window.partitionBy(tree).orderBy("first")  # a row for each range
    runs = runs.select("run", (F.sum("rows").over(w) - F.col("rows") - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy(tree)).alias("n"))
    return lookup_join(s, scratch.table(runs, "runs"), "run", None).withColumn("i", F.col("at") + F.col("shift")).drop("run", "at", "shift")


def _run(nodes: str, level: int) -> str:
    """SQL: the parents of nodes (tree, i, n, h), with the run they are made of. A lone node is its own parent."""
    return f"""SELECT tree, n, i, run, CASE WHEN n > {WIDTH**level} THEN sha256(run) ELSE run END AS h
      FROM (SELECT tree, n, i // {WIDTH} AS i, string_agg(h, '' ORDER BY i) AS run FROM {nodes} GROUP BY tree, n, i // {WIDTH})"""


_LEAVES = "level0 AS MATERIALIZED (SELECT tree, i, n, lower(hex(leaf)) AS h FROM cell)"
_TREE = ", ".join([_LEAVES, *(f"level{k + 1} AS MATERIALIZED ({_run(f'level{k}', k)})" for k in range(LEVELS))])

_con: list[duckdb.DuckDBPyConnection] = []


def _query(sql: str, **tables: pa.Table) -> pa.Table:
    """One connection for each worker, with one thread: Spark runs the tasks beside each other."""
    if not _con:
        _con.append(duckdb.connect(config={"threads": 1}))
    for name, t in tables.items():
        _con[0].register(name, t)
    try:
        return _con[0].execute(sql).to_arrow_table()
    finally:
        for name in tables:
            _con[0].unregister(name)


def _roots(cell: pa.Table) -> pa.Table:
    return _query(f"WITH {_TREE} SELECT tree, i, n, h FROM level{LEVELS}", cell=cell).cast(pa.schema([("tree", pa.string()), ("i", pa.int64()), ("n", pa.int64()), ("h", pa.string())]))


_OUT = [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())]


def _proved(cell: pa.Table, outer: pa.Table) -> pa.Table:
    """The leaves with their proofs and what these fold to. outer: (tree, i, subroot, root, before, after) of the buckets."""
    pieces = [(f"substr(l{k}.run, 1, {DIGITS} * p{k})", f"substr(l{k}.run, {DIGITS} * p{k} + {DIGITS + 1})", f"c.n > {WIDTH**k}") for k in range(LEVELS)]
    deep = max((len(x) for x in outer.column("before").to_pylist()), default=0)
    pieces += [(f"o.before[{k + 1}]", f"o.after[{k + 1}]", f"len(o.before) > {k}") for k in range(deep)]
    places = ", ".join(f"i // {WIDTH**k} % {WIDTH} AS p{k}" for k in range(LEVELS))
    joins = " ".join(f"JOIN level{k + 1} l{k} ON l{k}.tree = c.tree AND l{k}.i = c.i // {WIDTH ** (k + 1)}" for k in range(LEVELS))
    cols = ", ".join(f"CASE WHEN {when} THEN {b} END AS b{k}, CASE WHEN {when} THEN {a} END AS a{k}" for k, (b, a, when) in enumerate(pieces))
    proof = " || ".join(f"coalesce(b{k} || a{k}, '')" for k in range(len(pieces)))
    sql = f"""WITH {_TREE},
      c AS (SELECT tree, i, n, doc_id, lower(hex(leaf)) AS leaf, lower(hex(coalesce(tampered, leaf))) AS node, {places} FROM cell),
      f0 AS (SELECT c.doc_id, c.leaf, c.node, o.subroot, o.root, {cols} FROM c {joins} JOIN outer_part o ON o.tree = c.tree AND o.i = c.i // {ALIGNED})"""
    for k in range(len(pieces)):
        sql += f", f{k + 1} AS (SELECT * REPLACE (CASE WHEN b{k} IS NULL THEN node ELSE sha256(b{k} || node || a{k}) END AS node) FROM f{k})"
    sql += f" SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, node AS folded_root, node = root AS verified FROM f{len(pieces)}"
    return _query(sql, cell=cell, outer_part=outer).cast(pa.schema(_OUT))


def _climb(nodes: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """nodes (tree, i, n, h), n of a tree and `most` of any: (tree, i, root, before, after), the parts of each level's
    run before and after the node, from its own level up."""
    levels = [nodes]
    while most > 1:
        runs = levels[-1].groupBy("tree", "n", F.floor(F.col("i") / WIDTH).alias("up")).agg(F.sort_array(F.collect_list(F.struct("i", "h")))["h"].alias("hs"))  # at most WIDTH
        runs = runs.select("tree", F.col("up").alias("i"), F.ceil(F.col("n") / WIDTH).alias("n"), F.concat_ws("", "hs").alias("run"), (F.col("n") > 1).alias("more"))
        levels.append(scratch.table(runs.withColumn("h", F.when(F.col("more"), F.sha2(F.col("run").cast("binary"), 256)).otherwise(F.col("run"))), "level"))
        most = -(-most // WIDTH)
    none = F.array().cast("array<string>")
    path = levels[-1].select("tree", "i", F.col("h").alias("root"), none.alias("before"), none.alias("after"))
    for below, above in zip(levels[-2::-1], levels[:0:-1], strict=True):
        at = (F.col("i") % WIDTH * DIGITS).cast("int")
        up = path.join(above.select("tree", "i", "run", "more"), ["tree", "i"]).withColumnRenamed("i", "up")
        both = below.select("tree", "i", F.floor(F.col("i") / WIDTH).alias("up")).join(up, ["tree", "up"])  # at most WIDTH rows meet one
        side = lambda part, rest: F.when(F.col("more"), F.concat(F.array(part), rest)).otherwise(F.col(rest))
        path = both.select("tree", "i", "root", side(F.substring("run", F.lit(1), at), "before").alias("before"), side(F.substring("run", at + DIGITS + 1, F.length("run")), "after").alias("after"))
    return scratch.table(path, "paths")


def tamper(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[Column, Column]:
    """Which rows the query tampers with, and the text that it gives them."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.translate(F.col(text), capitals, capitals.lower())


def manifest(docs: DataFrame, tampered: tuple[Column, Column] | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    fields: names of the id, the source, and further columns, the last of them text. tampered: for which rows another
    text is folded with the siblings of the manifest, and that text; nothing but folded_root and verified depends on it."""
    scratch = Scratch(docs.sparkSession)
    own = [F.col(c) for c in fields]
    other = F.when(tampered[0], F.unhex(leaf_digest(*own[:-1], tampered[1]))) if tampered else F.lit(None).cast("binary")
    tree = F.coalesce(F.concat(F.lit("s"), own[1].cast("string")), F.lit("n"))  # sorts as the source does, null first
    leaves = scratch.table(docs.select(tree.alias("tree"), own[0].cast("long").alias("doc_id"), F.unhex(leaf_digest(*own)).alias("leaf"), other.alias("tampered"), F.monotonically_increasing_id().alias("row")), "leaves")
    total = leaves.count()
    bucket = F.floor(F.col("i") / ALIGNED)
    cell = lambda i: F.pmod(F.xxhash64("tree", i), F.lit(max(1, -(-total // ALIGNED)))).alias("cell")
    placed = ranked(leaves, "tree", ["doc_id", "leaf", "row"], scratch, total).select(cell(bucket), "tree", "i", "n", "doc_id", "leaf", "tampered")
    placed = scratch.table(placed, "placed")
    roots = scratch.table(placed.select("cell", "tree", "i", "n", "leaf").groupBy("cell").applyInArrow(lambda t: _roots(t), "tree string, i long, n long, h string"), "roots")
    most, count = roots.agg(F.max("n"), F.count(F.lit(1))).first()
    paths = _climb(roots.withColumn("n", F.ceil(F.col("n") / ALIGNED)), -(-(most or 0) // ALIGNED), scratch)
    sources = scratch.table(paths.where("i = 0").select(F.lit("").alias("all"), "tree", F.col("root").alias("h")), "sources")
    n = sources.count()
    numbered = scratch.table(ranked(sources, "all", ["tree"], scratch, n).select(F.col("all").alias("tree"), "i", "n", "h", F.col("tree").alias("source")), "numbered")
    top = _climb(numbered.drop("source"), n, scratch).drop("tree").join(numbered.select("i", "source"), "i")
    top = scratch.table(top.select(F.col("source").alias("tree"), F.col("root").alias("top"), F.col("before").alias("before_"), F.col("after").alias("after_")), "tops")
    outer = lookup_join(paths, top, "tree", F.col("i"), n * DIGITS * WIDTH * 8)
    outer = outer.select(cell(F.col("i")), "tree", "i", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("before", "before_").alias("before"), F.concat("after", "after_").alias("after"))
    outer = scratch.table(outer, "outer")
    return placed.groupBy("cell").cogroup(outer.groupBy("cell")).applyInArrow(lambda c, o: _proved(c, o), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(docs, tamper(docs))


def _oracle(levels: int = 8) -> str:
    """SQL for DuckDB with so many levels for leaves, and as many for sources."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(map(field, FIELDS[:-1]))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "list_reduce(range(8), lambda t, k: xor(t >> 1, (t & 1) * 3988292384), xor(c, b))"
    crc = f"xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: ascii(substr(doc_id::VARCHAR, j::INT, 1))::BIGINT), lambda c, b: {byte}, 4294967295), 4294967295)"
    sql = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, sha256({head} || {field("text")}) AS leaf,
      CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {field(low)}) END AS other FROM documents),
    a0 AS (SELECT r, source, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM d),
    x0 AS (SELECT d.r, d.doc_id, d.source, d.leaf, i, coalesce(other, d.leaf) AS node, '' AS proof FROM d JOIN a0 USING (r))"""
    for name, by, rest in (("a", "source", ""), ("b", "1", "")):
        if name == "b":
            sql += f""", b0 AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM a{levels}),
            y0 AS (SELECT x.* EXCLUDE (i), b.h AS subroot, b.i FROM x{levels} x JOIN b0 b ON x.source IS NOT DISTINCT FROM b.source)"""
        rows, key = ("x", "source") if name == "a" else ("y", "1")
        part = "source, " if name == "a" else ""
        for k in range(levels):
            on = "x.source IS NOT DISTINCT FROM g.source AND " if name == "a" else ""
            sql += f""", {name}g{k} AS (SELECT {part}i // 16 AS g, string_agg(h, '' ORDER BY i) AS run, any_value(n) AS n FROM
              (SELECT *, count(*) OVER ({"PARTITION BY source" if name == "a" else ""}) AS n FROM {name}{k}) GROUP BY ALL),
            {name}{k + 1} AS (SELECT {part}g AS i, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS h FROM {name}g{k}),
            {rows}{k + 1} AS (SELECT x.* REPLACE (x.i // 16 AS i, CASE WHEN n > 1 THEN sha256(substr(run, 1, 64 * (i % 16)) || node || substr(run, 64 * (i % 16) + 65)) ELSE node END AS node,
              CASE WHEN n > 1 THEN proof || substr(run, 1, 64 * (i % 16)) || substr(run, 64 * (i % 16) + 65) ELSE proof END AS proof) FROM {rows}{k} x JOIN {name}g{k} g ON {on}g.g = x.i // 16)"""
    return sql + f" SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = h AS verified FROM y{levels}, b{levels}"


ORACLE_SQL = _oracle(5)
