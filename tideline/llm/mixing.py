"""Mixing sources to target weights by Sainte-Lague apportionment (operator 9), in DataFrame functions only.

1. Sizes in words are summed by source; targets share the total by weight and stop at `MAX_REPEAT` times a source.
2. The total is cut into blocks of `block_words` words; the blocks go to sources by the highest quotients
   target / (2k + 1). Whole passes over a source are set aside, the rest is a number of blocks below one pass.
3. A source's documents are dealt by hash to shards of about `SHARD_WORDS` words, and its blocks to its shards by
   the same quotients, weighed by the shards' words: an integer quota for each shard.
4. A seed orders a shard's documents; its blocks are cut from that order and drawn from the front, so that at most
   one document of a shard is taken in part.

Sources are the components of a mixture, one row each. Hot sources have many shards; no document's text is moved
for the decisions.

Defined cases: null text has size 0; null source is a source of its own and last; null doc_id counts as ''; repeated
rows are mixed one by one; an empty table gives an empty result; further columns are left alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, Scratch, fresh, lookup_join, words_of

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 20
SEED = "mix-1"


def sainte_lague(parties: DataFrame, group: str, party: str, weight: str, seats: str) -> DataFrame:
    """Adds quota: each group's seats, dealt to its parties by the highest quotients weight / (2k + 1), ties to the
    smaller party. Two bounds on the last quotient leave about four candidate quotients for each party to rank."""
    g = Window.partitionBy(group)
    w, n = F.col(weight).cast("double"), F.col(seats)
    p = parties.withColumn("__all", F.sum(w).over(g)).withColumn("__s", F.count_if(w > 0).over(g))
    share = lambda total: F.when((total > 0) & (w > 0), w * total / F.col("__all")).otherwise(F.lit(0.0))
    p = p.withColumn("__sure", F.greatest(F.floor(share(n - F.col("__s") / 2) - 0.5), F.lit(0)).cast("long"))
    p = p.withColumn("__most", F.when((w > 0) & (n > 0), F.ceil(share(n + F.col("__s") / 2) + 1)).otherwise(F.lit(0)).cast("long"))
    p = p.withColumn("__left", n - F.sum("__sure").over(g))
    ks = F.when(F.col("__most") > F.col("__sure"), F.sequence("__sure", F.col("__most") - 1))
    c = p.select(group, party, weight, "__left", F.explode(ks).alias("__k"))
    rank = F.row_number().over(g.orderBy((w / (2 * F.col("__k") + 1)).desc(), F.col(party)))
    won = c.withColumn("__r", rank).where(F.col("__r") <= F.col("__left")).groupBy(group, party).agg(F.count(F.lit(1)).alias("__won"))
    p = p.join(won, [group, party], "left").withColumn("quota", F.col("__sure") + F.coalesce("__won", F.lit(0)))
    return p.drop("__all", "__s", "__sure", "__most", "__left", "__won")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _hash(seed: str) -> Column:
    """Of a row's doc_id and text, so that a doc_id of many rows, or a null one, spreads over shards and only equal rows tie."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("th")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """A row for each source: source, skey, source_size, target. With the sources in order of cap / weight, those
    that reach their cap are the first ones, and the level of the others is the largest that any prefix gives."""
    t = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    index = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    t = t.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (index % len(weights) + 1).cast("int")).cast("long"))
    t = t.withColumn("__cap", F.col("source_size") * max_repeat)
    full, before = Window.partitionBy(), Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    t = t.withColumn("__level", (F.sum("source_size").over(full) - so_far("__cap")) / (F.sum("__w").over(full) - so_far("__w")))
    target = F.least(F.col("__cap").cast("double"), F.max("__level").over(full) * F.col("__w"))
    return t.select("skey", "source", "source_size", target.alias("target"))


def _plan(sizes: DataFrame, scratch: Scratch, block_words: int, weights: tuple[int, ...], max_repeat: int) -> tuple[DataFrame, DataFrame]:
    """The sources with whole passes and shard counts, and the words to draw from each shard."""
    src = targets(sizes, weights, max_repeat).withColumn("__g", F.lit(0))
    src = src.withColumn("__n", F.round(F.sum("target").over(Window.partitionBy("__g")) / block_words).cast("long"))
    src = sainte_lague(src, "__g", "skey", "target", "__n")
    words = F.least(F.col("quota") * block_words, F.col("source_size") * max_repeat)
    src = src.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    src = src.withColumn("blocks", F.round((words - F.col("passes") * F.col("source_size")) / block_words).cast("long"))
    src = src.withColumn("n_shards", F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.lit(1)).cast("long"))
    src = scratch.table(src.select("skey", "source_size", "target", "passes", "blocks", "n_shards"), "mix_sources")
    parts = _sharded(sizes, src).groupBy("skey", "shard").agg(F.sum("size").alias("words"), F.max("blocks").alias("blocks"))
    parts = sainte_lague(parts, "skey", "shard", "words", "blocks")
    return src, scratch.table(parts.select("shard", F.least(F.col("quota") * block_words, F.col("words")).alias("draw")), "mix_shards")


def _sharded(rows: DataFrame, src: DataFrame) -> DataFrame:
    number = F.pmod(F.conv(F.substring(_hash(SEED + "-shard"), 1, 8), 16, 10).cast("long"), F.col("n_shards"))
    return lookup_join(rows, src, "skey", F.col("th")).withColumn("shard", F.concat(F.col("skey"), F.lit("#"), number.cast("string")))


def _drawn(rows: DataFrame, src: DataFrame, shards: DataFrame) -> DataFrame:
    """Adds passes and part: the words that the last, unfinished pass takes of each row."""
    w = Window.partitionBy("shard").orderBy(_hash(SEED), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = _sharded(rows, src).withColumn("__start", F.sum("size").over(w) - F.col("size"))
    r = lookup_join(r, shards, "shard", F.col("th"))
    return r.withColumn("part", F.greatest(F.least(F.col("size"), F.col("draw") - F.col("__start")), F.lit(0)))


def _sizes(docs: DataFrame, doc_id: str, text: str, source: str, *more: Column) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), source_key(F.col(source)).alias("skey"), F.size(words_of(F.col(text))).cast("long").alias("size"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("th"), *more)


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """A row per document: doc_id, size, source_size, target of its source, and taken, the words the mix takes."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(_sizes(docs, doc_id, text, source), "mix_sizes")
    r = _drawn(rows, *_plan(rows, scratch, block_words, weights, max_repeat))
    return r.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mix itself with the columns of docs: a row for every pass over a document; a document that a block's end
    cuts is kept up to that word. n_chars, if there, follows the text."""
    scratch = Scratch(docs.sparkSession)
    narrow = scratch.table(_sizes(docs, doc_id, text, source), "mix_sizes")
    src, shards = _plan(narrow, scratch, block_words, weights, max_repeat)
    (row,) = fresh(docs, "__row")
    r = _drawn(_sizes(docs, doc_id, text, source, F.struct(*docs.columns).alias(row)), src, shards)
    takes = F.concat(F.array_repeat(F.col("size"), F.col("passes").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    r = r.select(row, "size", F.explode(takes).alias("__take")).where(F.col("__take") > 0)
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(row)[text], F.lit(f"(?:{GAP})?{WORD}"), 0), 1, F.col("__take").cast("int")), "")
    new = F.when(F.col("__take") < F.col("size"), head).otherwise(F.col(row)[text])
    r = r.select(row, new.alias("__text"))
    edits = {text: F.col("__text")} | ({n_chars: F.char_length("__text").cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {})
    return r.select(*[edits.get(c, F.col(row)[c]).alias(c) for c in docs.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    return decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The parts that the pipeline's SQL shares. {docs}: a table with doc_id, source, text.
MIX_SQL = r"""
z AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS skey, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS th FROM {docs}),
t0 AS (SELECT skey, source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM z GROUP BY skey, source),
t1 AS (SELECT *, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS all_w FROM t0),
t2 AS (SELECT *, coalesce(sum(cap) OVER o, 0)::BIGINT AS c0, coalesce(sum(w) OVER o, 0)::BIGINT AS w0 FROM t1
  WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t3 AS (SELECT skey, source_size, least(cap::DOUBLE, max((total - c0) / (all_w - w0)) OVER () * w) AS target FROM t2),
q0 AS (SELECT *, round(sum(target) OVER () / 16)::BIGINT AS n FROM t3),
q1 AS (SELECT skey, target / (2 * k + 1) AS q, n FROM q0, unnest(range(0, CASE WHEN target > 0 THEN ceil(target / 16)::BIGINT + 2 + (SELECT count(*) FROM q0) ELSE 0 END)) AS u(k)),
q2 AS (SELECT skey, count(*) AS quota FROM (SELECT skey, n, row_number() OVER (ORDER BY q DESC, skey) AS r FROM q1) WHERE r <= n GROUP BY skey),
s0 AS (SELECT q0.*, least(coalesce(quota, 0) * 16, 3 * source_size) AS words FROM q0 LEFT JOIN q2 USING (skey)),
s1 AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes, greatest(ceil(source_size / 1048576), 1)::BIGINT AS n_shards FROM s0),
s2 AS (SELECT *, round((words - passes * source_size) / 16)::BIGINT AS blocks FROM s1),
d0 AS (SELECT z.*, source_size, target, passes, blocks,
  z.skey || '#' || (('0x' || md5('mix-1-shard:' || coalesce(doc_id::VARCHAR, '') || ':' || th)[1:8])::BIGINT % n_shards) AS shard, md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || th) AS h
  FROM z JOIN s2 USING (skey)),
p0 AS (SELECT skey, shard, sum(size)::BIGINT AS words, max(blocks) AS blocks FROM d0 GROUP BY skey, shard),
p1 AS (SELECT p0.*, words / (2 * k + 1) AS q FROM p0, unnest(range(0, CASE WHEN words > 0 THEN words // 16 + 2 ELSE 0 END)) AS u(k)),
p2 AS (SELECT shard, count(*) AS quota FROM (SELECT shard, blocks, row_number() OVER (PARTITION BY skey ORDER BY q DESC, shard) AS r FROM p1) WHERE r <= blocks GROUP BY shard),
p3 AS (SELECT shard, least(coalesce(quota, 0) * 16, words) AS draw FROM p0 LEFT JOIN p2 USING (shard)),
m AS (SELECT d0.*, greatest(least(size, draw - (sum(size) OVER (PARTITION BY d0.shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)), 0)::BIGINT AS part
  FROM d0 JOIN p3 USING (shard))"""

ORACLE_SQL = "WITH " + MIX_SQL.replace("{docs}", "documents") + """
SELECT doc_id, size, source_size, target, (passes * size + part)::BIGINT AS taken FROM m"""
