"""Queries of scalar rules, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import adapters as A
from .registry import query


def _events(spark, sf_dir):
    return A.table(spark, sf_dir, "events")


@query("mth2_backoff", "SELECT event_id, least(30 * pow(2, least(event_id % 12, 6)), 1800)::BIGINT AS seconds FROM events")
def backoff(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.backoff_seconds(F.col("event_id") % 12).alias("seconds"))


@query("mth3_call_budget", "SELECT event_id, (greatest(user_id % 4, 1) * greatest(event_id % 7, 1) * greatest(ceil(600 / greatest(event_id % 400, 1)), 1) * 2)::BIGINT AS calls FROM events")
def call_budget(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.call_budget(F.col("user_id") % 4, F.col("event_id") % 7, F.col("event_id") % 400).alias("calls"))


@query("mth4_recommended_fps", "SELECT o_orderkey AS id, CASE WHEN s <= 30 THEN 15.0 WHEN s <= 900 THEN 1.0 WHEN s <= 7200 THEN 0.5 ELSE 0.2 END::DOUBLE AS fps FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 60 WHEN 1 THEN o_orderkey % 1800 ELSE o_orderkey % 14400 END AS s FROM orders)")
def recommended_fps(spark, sf_dir):
    k = F.col("o_orderkey")
    seconds = F.when(k % 3 == 0, k % 60).when(k % 3 == 1, k % 1800).otherwise(k % 14400)
    return A.table(spark, sf_dir, "orders").select(k.alias("id"), S.recommended_fps(seconds).cast("double").alias("fps"))


@query("mth5_memory_pressure", "SELECT event_id, CASE WHEN (event_id % 101) / 100 >= 0.9 THEN 'critical' WHEN (event_id % 101) / 100 >= 0.8 THEN 'high' ELSE 'normal' END AS pressure FROM events")
def memory_pressure(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.memory_pressure(F.col("event_id") % 101, F.lit(100)).alias("pressure"))


@query("mth6_plan_chunks", "SELECT o_orderkey AS id, i AS chunk, i * 600 AS s, least((i + 1) * 600, o_orderkey % 4000) AS e FROM orders, unnest(range(0, ceil((o_orderkey % 4000) / 600)::BIGINT)) AS u(i)")
def plan_chunks(spark, sf_dir):
    """A recording's seconds in pieces of ten minutes, the last one short."""
    total = F.col("o_orderkey") % 4000
    o = A.table(spark, sf_dir, "orders").where(total > 0).select(F.col("o_orderkey").alias("id"), total.alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(total / 600) - 1)).alias("chunk"))
    return o.select("id", "chunk", (F.col("chunk") * 600).alias("s"), F.least((F.col("chunk") + 1) * 600, F.col("total")).alias("e"))


@query("mth7_keep_alive", "SELECT event_id, 2 * (event_id % 600) + 60 AS seconds FROM events")
def keep_alive(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.keep_alive(F.col("event_id") % 600).alias("seconds"))


@query("mth8_elapsed", f"WITH {A.ENTRIES_SQL} SELECT id, greatest((e - s) // 1000 - 5000, 0) AS elapsed_ms FROM entries")
def elapsed(spark, sf_dir):
    return A.entries(spark, sf_dir).select("id", F.greatest(F.floor((F.col("e") - F.col("s")) / 1000) - 5000, F.lit(0)).alias("elapsed_ms"))


@query("mth10_resume_decision", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'fresh' WHEN o_orderdate::DATE = DATE '1997-05-28' THEN 'resumed' ELSE 'new_day' END AS decision FROM orders")
def resume_decision(spark, sf_dir):
    saved = F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate"))
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(saved.isNull(), "fresh").when(saved == F.lit("1997-05-28").cast("date"), "resumed").otherwise("new_day").alias("decision"))


@query("src24_byte_range", """WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bytes=' || (event_id % 900) || '-' || (event_id % 1700) WHEN 1 THEN 'bytes=' || (event_id % 1300) || '-' WHEN 2 THEN 'bytes=-' || (event_id % 1500) ELSE 'items=1-2' END AS h FROM events),
p AS (SELECT event_id, regexp_matches(h, '^bytes=[0-9]*-[0-9]*$') AS ok, try_cast(regexp_extract(h, '^bytes=([0-9]*)-', 1) AS BIGINT) AS a, try_cast(regexp_extract(h, '-([0-9]*)$', 1) AS BIGINT) AS b FROM r),
f AS (SELECT event_id, CASE WHEN ok AND a IS NOT NULL THEN a WHEN ok AND b IS NOT NULL THEN greatest(1000 - b, 0) END AS first, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(b, 999) ELSE 999 END AS last FROM p)
SELECT event_id, CASE WHEN first < 1000 AND first <= last THEN first END AS first, CASE WHEN first < 1000 AND first <= last THEN last END AS last FROM f""")  # fmt: skip
def byte_range(spark, sf_dir):
    i = F.col("event_id")
    n = lambda m: (i % m).cast("string")
    header = F.when(i % 4 == 0, F.concat(F.lit("bytes="), n(900), F.lit("-"), n(1700))).when(i % 4 == 1, F.concat(F.lit("bytes="), n(1300), F.lit("-"))).when(i % 4 == 2, F.concat(F.lit("bytes=-"), n(1500))).otherwise(F.lit("items=1-2"))
    r = S.byte_range(header, F.lit(1000).cast("long"))
    return _events(spark, sf_dir).select("event_id", r["first"].alias("first"), r["last"].alias("last"))


@query("src7_sample_filename", """WITH n AS (SELECT event_id, 'd' || (user_id % 3) || '_w' || printf('%06d', event_id) || '_' || strftime(ts, '%Y%m%dT%H%M%S%g') || '.png' AS name FROM events)
SELECT event_id, name, regexp_extract(name, '^d([0-9]+)_w([0-9]+)_', 1)::BIGINT AS display_id, regexp_extract(name, '^d([0-9]+)_w([0-9]+)_', 2)::BIGINT AS sequence FROM n""")  # fmt: skip
def sample_filename(spark, sf_dir):
    name = F.concat(S.sample_stem(F.col("user_id") % 3, F.col("event_id"), F.col("ts")), F.lit(".png"))
    e = _events(spark, sf_dir).select("event_id", name.alias("name"))
    part = lambda i: F.regexp_extract("name", r"^d(\d+)_w(\d+)_", i).cast("long")
    return e.select("event_id", "name", part(1).alias("display_id"), part(2).alias("sequence"))


@query("src20_even_sampling", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5000 > 0 THEN least(greatest(30 / (o_orderkey % 5000), 0.05), 2) ELSE 1 END::DOUBLE AS fps FROM orders")
def even_sampling(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.even_fps(F.col("o_orderkey") % 5000, 30.0, 2.0).alias("fps"))


STICKY = 2**32 - 1


@query("fil8_window_visibility", f"""WITH w AS (SELECT event_id, event_id % 5 = 0 AS hidden, CASE user_id % 4 WHEN 3 THEN NULL WHEN 2 THEN {STICKY} ELSE user_id % 4 END AS desktop, CASE WHEN event_id % 7 <> 0 THEN 1 END AS current FROM events)
SELECT event_id, CASE WHEN hidden THEN FALSE WHEN desktop IS NULL OR current IS NULL THEN TRUE ELSE desktop = {STICKY} OR desktop = current END AS visible FROM w""")  # fmt: skip
def window_visibility(spark, sf_dir):
    """Hidden windows aren't visible; else those of the current desktop or of all, and any where either is unknown."""
    d = F.col("user_id") % 4
    desktop, current = F.when(d == 2, STICKY).when(d != 3, d), F.when(F.col("event_id") % 7 != 0, 1)
    shown = F.coalesce((desktop == STICKY) | (desktop == current), F.lit(True)) | desktop.isNull() | current.isNull()
    return _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 5 == 0, False).otherwise(shown).alias("visible"))


@query("agg16_tick_counters", "SELECT user_id, count(*) AS frames, count(*) FILTER (WHERE event_type = 'view') AS whole_reads, count(*) FILTER (WHERE event_type = 'error') AS drops FROM events GROUP BY user_id")
def tick_counters(spark, sf_dir):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), kind("view").alias("whole_reads"), kind("error").alias("drops"))


@query("fil14_unrecovered_drops", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND event_id % 3 <> 0 GROUP BY user_id")
def unrecovered_drops(spark, sf_dir):
    return _events(spark, sf_dir).where("event_type = 'error' and event_id % 3 != 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("agg14_segment_latency", """WITH c AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT user_id, count(*) AS n, round(sum(value) FILTER (WHERE i > 1), 6) AS rest, max(value) FILTER (WHERE i = 1) AS first FROM c GROUP BY user_id)
SELECT user_id, CASE WHEN n > 1 THEN round(rest / (n - 1), 4) ELSE 0 END::DOUBLE AS warm, coalesce(n > 1 AND rest > 0 AND first > 3 * (rest / (n - 1)), FALSE) AS cold FROM g""")  # fmt: skip
def segment_latency(spark, sf_dir):
    """The mean of the calls after the first, and whether the first was cold: over three times that."""
    from pyspark.sql import Window

    c = _events(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    g = c.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(F.col("i") > 1, F.col("value"))), 6).alias("rest"), F.max(F.when(F.col("i") == 1, F.col("value"))).alias("first"))
    warm = F.when(F.col("n") > 1, F.col("rest") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return g.select("user_id", F.round(warm, 4).alias("warm"), F.coalesce((F.col("rest") > 0) & (F.col("first") > 3 * warm), F.lit(False)).alias("cold"))
