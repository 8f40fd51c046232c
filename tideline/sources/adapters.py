"""Domain tables from the driver's tables, and the same tables as SQL for DuckDB.

Times are microseconds since 1970 in both (columns s and e), so that no session's zone enters a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = {"click": "coding", "view": "browsing", "purchase": "docs", "signup": "meeting", "error": "other"}
CAUSES = ("idle", "locked", "display_sleep", "user_off", "source_occluded", "source_ended", "daemon_restart")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def started_before(df: DataFrame, c: str, at: int) -> DataFrame:
    """Rows whose time column is before a moment in microseconds: a filter on the column itself, which reaches the scan."""
    zone = "timestamp_ntz" if dict(df.dtypes)[c] == "timestamp_ntz" else "timestamp"
    return df.where(F.col(c) < F.timestamp_micros(F.lit(at)).cast(zone))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, display_id, id, at): a sample of a display."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session_id"), (F.col("user_id") % 3).alias("display_id"), F.col("event_id").alias("id"), micros("ts").alias("at"))


SAMPLES_SQL = "samples AS (SELECT user_id AS session_id, user_id % 3 AS display_id, event_id AS id, epoch_us(ts) AS at FROM events)"


def entries(spark: SparkSession, sf_dir: str, before: int | None = None) -> DataFrame:
    """(id, session_id, display_id, s, e, category, activity): timeline entries, those that start before a moment if one
    is given."""
    e = table(spark, sf_dir, "events")
    e = e if before is None else started_before(e, "ts", before)
    kinds = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    s = micros("ts")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), (F.col("user_id") % 3).alias("display_id"), s.alias("s"),
        (s + F.floor("value") * 1_000_000).alias("e"), F.coalesce(kinds[F.col("event_type")], F.lit("other")).alias("category"),
        F.regexp_extract("props", r'"k": ?([0-9]+)', 1).alias("activity"),
    )


ENTRIES_SQL = """entries AS (SELECT event_id AS id, user_id AS session_id, user_id % 3 AS display_id, epoch_us(ts) AS s,
  epoch_us(ts) + floor(value)::BIGINT * 1000000 AS e,
  CASE event_type WHEN 'click' THEN 'coding' WHEN 'view' THEN 'browsing' WHEN 'purchase' THEN 'docs' WHEN 'signup' THEN 'meeting' ELSE 'other' END AS category,
  regexp_extract(props, '"k": ?([0-9]+)', 1) AS activity FROM events)"""


def pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, session_id, s, e, cause): recorded gaps; the last of a session is still open (e is null)."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    s = micros("ts")
    last = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).isNull()
    end = F.when(~last, s + F.floor("value") * 1_000_000)
    cause = F.element_at(F.array(*map(F.lit, CAUSES)), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select(F.concat_ws(":", F.col("user_id").cast("string"), s.cast("string")).alias("id"), F.col("user_id").alias("session_id"), s.alias("s"), end.alias("e"), cause.alias("cause"))


PAUSES_SQL = """pauses AS (SELECT user_id || ':' || epoch_us(ts) AS id, user_id AS session_id, epoch_us(ts) AS s,
  CASE WHEN lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL THEN epoch_us(ts) + floor(value)::BIGINT * 1000000 END AS e,
  ['idle', 'locked', 'display_sleep', 'user_off', 'source_occluded', 'source_ended', 'daemon_restart'][event_id % 7 + 1] AS cause
  FROM events WHERE event_type = 'error')"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, status, s, bytes, display)."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 2 == 0, "recording").otherwise("finalizing")).otherwise("error")
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), micros("o_orderdate").alias("s"), F.when(F.col("o_orderkey") % 5 != 0, F.floor("o_totalprice")).cast("long").alias("bytes"), F.col("o_orderpriority").alias("display"))


RECORDINGS_SQL = """recordings AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'recording' ELSE 'finalizing' END ELSE 'error' END AS status,
  epoch_us(o_orderdate) AS s, CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice)::BIGINT END AS bytes, o_orderpriority AS display FROM orders)"""


def segments(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    """(display_id, sequence, closed, summarized, n_raw, has_warm, raw_bytes, warm_bytes). more: further sums, counts and
    so on of a segment's lines, by name."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("display_id"), F.col("l_orderkey").alias("sequence"))
    t = g.agg(
        F.max(micros("l_shipdate")).alias("closed"), (F.min(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)) == 1).alias("summarized"),
        F.count(F.lit(1)).alias("n"), F.sum(F.floor("l_extendedprice").cast("long")).alias("b"), F.min("l_suppkey").alias("k"),
        *[c.alias(name) for name, c in more.items()],
    )
    hot, warm = F.col("k") % 4 != 0, F.col("k") % 3 == 0
    zero = F.lit(0).cast("long")
    return t.select("display_id", "sequence", "closed", "summarized", F.when(hot, F.col("n")).otherwise(zero).alias("n_raw"), warm.alias("has_warm"), F.when(hot, F.col("b")).otherwise(zero).alias("raw_bytes"), F.when(warm, F.floor(F.col("b") / 10)).otherwise(zero).alias("warm_bytes"), *more)


SEGMENTS_SQL = """segments AS (SELECT display_id, sequence, closed, summarized, CASE WHEN k % 4 <> 0 THEN n ELSE 0 END AS n_raw, k % 3 = 0 AS has_warm,
  CASE WHEN k % 4 <> 0 THEN b ELSE 0 END AS raw_bytes, CASE WHEN k % 3 = 0 THEN b // 10 ELSE 0 END AS warm_bytes
  FROM (SELECT l_linenumber::BIGINT AS display_id, l_orderkey AS sequence, max(epoch_us(l_shipdate)) AS closed, bool_and(l_linestatus = 'F') AS summarized,
    count(*) AS n, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS b, min(l_suppkey) AS k FROM lineitem GROUP BY 1, 2))"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(burst, model, served, tokens_in, tokens_out, thinking): a line of the usage log."""
    li = table(spark, sf_dir, "lineitem")
    model = F.when(F.col("l_returnflag") == "A", "gemini-3.1-pro-preview").when(F.col("l_returnflag") == "N", "gemini-3.8-flash").otherwise("house-model")
    q = F.col("l_quantity").cast("long")
    return li.select(
        F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit("b"), (F.col("l_suppkey") % 20).cast("string"))).alias("burst"), model.alias("model"),
        F.when(F.col("l_orderkey") % 2 == 0, F.lit("gemini-3.8-flash")).alias("served"), (q * 9000).alias("tokens_in"), (q * 11).alias("tokens_out"), (q * 7).alias("thinking"),
    )


USAGE_SQL = """usage AS (SELECT CASE WHEN l_linenumber % 4 <> 0 THEN 'b' || (l_suppkey % 20) END AS burst,
  CASE l_returnflag WHEN 'A' THEN 'gemini-3.1-pro-preview' WHEN 'N' THEN 'gemini-3.8-flash' ELSE 'house-model' END AS model,
  CASE WHEN l_orderkey % 2 = 0 THEN 'gemini-3.8-flash' END AS served,
  l_quantity::BIGINT * 9000 AS tokens_in, l_quantity::BIGINT * 11 AS tokens_out, l_quantity::BIGINT * 7 AS thinking FROM lineitem)"""


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, idx, start_ms, end_ms): spoken lines."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 5000 + (F.col("conv_id") % 7) * 300
    return c.select((F.col("conv_id") % 50).alias("stream"), (F.col("conv_id") * 100 + F.col("turn")).alias("idx"), start.alias("start_ms"), (start + 800 + F.col("turn") * 10).alias("end_ms"))


UTTERANCES_SQL = """utterances AS (SELECT conv_id % 50 AS stream, conv_id * 100 + turn AS idx, turn * 5000 + (conv_id % 7) * 300 AS start_ms,
  turn * 5000 + (conv_id % 7) * 300 + 800 + turn * 10 AS end_ms FROM conversations)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, idx, at_ms): frames of a clip."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 50).alias("stream"), F.col("event_id").alias("idx"), ((F.col("event_id") * 37) % 60000).alias("at_ms"))


FRAMES_SQL = "frames AS (SELECT user_id % 50 AS stream, event_id AS idx, (event_id * 37) % 60000 AS at_ms FROM events)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, idx, x, y, w, h, granularity, trust, display_id, source): boxes found on a frame."""
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey"), F.col("p_size")
    return p.select(
        F.floor(k / 12).alias("frame_id"), (k % 12).alias("idx"), ((k * 37) % 400).alias("x"), ((k * 53) % 300).alias("y"), (n * 9 + 5).cast("long").alias("w"), (n * 7 + 3).cast("long").alias("h"),
        (k % 5).alias("granularity"), ((k * 7) % 10).alias("trust"), F.floor(k / 12 % 2).alias("display_id"), F.element_at(F.array(*map(F.lit, ("wm", "at_spi", "ocr"))), ((k + F.floor(k / 12)) % 3 + 1).cast("int")).alias("source"),
    )


REGIONS_SQL = """regions AS (SELECT p_partkey // 12 AS frame_id, p_partkey % 12 AS idx, (p_partkey * 37) % 400 AS x, (p_partkey * 53) % 300 AS y, (p_size * 9 + 5)::BIGINT AS w, (p_size * 7 + 3)::BIGINT AS h,
  p_partkey % 5 AS granularity, (p_partkey * 7) % 10 AS trust, (p_partkey // 12) % 2 AS display_id, ['wm', 'at_spi', 'ocr'][(p_partkey + p_partkey // 12) % 3 + 1] AS source FROM part)"""


def _bytes(pixels):
    return F.unhex(F.array_join(F.transform(pixels, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def _level(scale: int):
    return F.transform("embedding", lambda x: F.least(F.greatest(F.round(128 + scale * x.cast("double")), F.lit(0)), F.lit(255)).cast("int"))


def _level_sql(scale: int) -> str:
    return f"list_transform(embedding, lambda x: least(greatest(round(128 + {scale} * x::DOUBLE), 0), 255)::INT)"


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, burst, seq, w, h, stride, data): small BGRA frames, some with padded rows, in bursts of up to eight."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 11 <> 0")
    burst = F.floor(F.col("vec_id") / 8)
    return e.select(F.col("vec_id").alias("frame_id"), burst.alias("burst"), (F.col("vec_id") % 8).alias("seq"), (3 + burst % 2).cast("int").alias("w"), F.lit(4).alias("h"), F.lit(16).alias("stride"), _bytes(_level(300)).alias("data"))


SHOTS_SQL = f"""shots AS (SELECT vec_id AS frame_id, vec_id // 8 AS burst, vec_id % 8 AS seq, 3 + (vec_id // 8) % 2 AS w, 4 AS h, 16 AS stride, {_level_sql(300)} AS px
  FROM embeddings WHERE vec_id % 11 <> 0)"""


def _rows(spark: SparkSession, sf_dir: str, rows: int, pixels) -> DataFrame:
    """(frame_id, h, data): frames whose rows are those of consecutive vectors."""
    r = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / rows).alias("frame_id"), F.hex(_bytes(pixels)).alias("row"))
    whole = F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "row"))), lambda x: x["row"]), ""))
    return r.groupBy("frame_id").agg(F.count(F.lit(1)).cast("int").alias("h"), whole.alias("data"))


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, w, h, stride, data): BGRA frames of 16 by 16 pixels, the last one lower."""
    return _rows(spark, sf_dir, 16, _level(300)).select("frame_id", F.lit(16).alias("w"), "h", F.lit(64).alias("stride"), "data")


SCREENS_SQL = f"""screens AS (SELECT vec_id // 16 AS frame_id, count(*) AS h, list({_level_sql(300)} ORDER BY vec_id) AS px FROM embeddings GROUP BY 1)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, w, h, stride, data): BGRA frames of eight rows of 640 gray pixels, ten alike beside each other."""
    pixels = F.flatten(F.transform(_level(600), lambda v: F.array_repeat(v, 40)))
    return _rows(spark, sf_dir, 8, pixels).select("frame_id", F.lit(640).alias("w"), "h", F.lit(2560).alias("stride"), "data")


WIDE_SQL = f"""wide AS (SELECT vec_id // 8 AS frame_id, i, count(*) AS n, sum(px[i + 1])::BIGINT AS s, sum(px[i + 1] * px[i + 1])::BIGINT AS q
  FROM (SELECT vec_id, {_level_sql(600)} AS px FROM embeddings), range(64) t(i) GROUP BY ALL)"""
#: How far a burst's frames are moved to the right.
_MOVED_SQL = "CASE WHEN {b} % 5 = 0 THEN 20 * {k} WHEN ({b} * 7 + {k} * 5) % 4 = 3 THEN 9 ELSE ({b} + {k}) % 2 END"
_FRAMES_SQL = "CASE WHEN {b} % 5 = 0 THEN 2 ELSE 4 + {b} % 3 END"


def moved_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(burst, seq, w, h, stride, data): bursts of 64 by 16 gray pixels that go round to the right from frame to frame."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 16).alias("burst"), _level(300).alias("px"))
    rows = rows.withColumn("seq", F.explode(F.sequence(F.lit(0), F.expr(_FRAMES_SQL.format(b="burst")).cast("int") - 1))).withColumn("by", F.expr(_MOVED_SQL.format(b="burst", k="seq")).cast("int"))
    px = F.concat(F.slice("px", 65 - F.col("by"), F.col("by")), F.slice("px", F.lit(1), 64 - F.col("by")))
    bgra = F.flatten(F.transform(px, lambda v: F.array_repeat(v, 4)))
    rows = rows.select("vec_id", "burst", "seq", F.hex(_bytes(bgra)).alias("row"))
    whole = F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "row"))), lambda x: x["row"]), ""))
    f = rows.groupBy("burst", "seq").agg(F.count(F.lit(1)).cast("int").alias("h"), whole.alias("data")).where("h = 16")
    return f.select("burst", F.col("seq").cast("long").alias("seq"), F.lit(64).alias("w"), "h", F.lit(256).alias("stride"), "data")


MOVED_SQL = f"""moved AS (SELECT b AS burst, k AS seq, {_MOVED_SQL.format(b="b", k="k")} AS by, {_FRAMES_SQL.format(b="b")} AS n
  FROM (SELECT vec_id // 16 AS b FROM embeddings GROUP BY 1 HAVING count(*) = 16), range(6) t(k) WHERE k < {_FRAMES_SQL.format(b="b")})"""
