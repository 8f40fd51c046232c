"""Queries of rules on requests, replies, names, displays, selections and sidecars, each over a whole table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from ..functions import text as X
from ..operators import frames as O
from ..sources import adapters as A
from .frames import PARENTS_SQL
from .registry import query


def _t(spark, sf_dir, name):
    return A.table(spark, sf_dir, name)


def _pick(values, i):
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# -- lines and paths --------------------------------------------------------------------------------------------------


@query("str4_line_matches", """WITH p AS (SELECT a.p_partkey, trim(a.p_name) AS x, trim(CASE WHEN a.p_partkey % 4 = 0 THEN '  ' || a.p_name || ' ' WHEN a.p_partkey % 4 = 1 THEN a.p_name || 's' ELSE b.p_name END) AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, x = y AS same, x = y OR 1 - levenshtein(x, y) / greatest(length(x), length(y)) >= 0.6 AS alike FROM p""")  # fmt: skip
def line_matches(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    k = F.col("p_partkey") % 4
    y = F.when(k == 0, F.concat(F.lit("  "), "p_name", F.lit(" "))).when(k == 1, F.concat("p_name", F.lit("s"))).otherwise(F.col("next"))
    return p.join(n, "p_partkey").select("p_partkey", R.matches(F.col("p_name"), y, 1.0).alias("same"), R.matches(F.col("p_name"), y, 0.6).alias("alike"))


@query("str15_percent_coding", r"""WITH d AS (SELECT doc_id, url_encode(coalesce(text, '')) AS e, coalesce(text, '') AS t FROM documents)
SELECT doc_id, md5(e) AS encoded, md5(t) AS decoded, replace(replace(replace('a%zz+' || source || '%', '+', ' '), '%41', 'A'), '%%', '%%') AS odd FROM d JOIN documents USING (doc_id)""")  # fmt: skip
def percent_coding(spark, sf_dir):
    """Whole texts there and back, and a text with bad escapes, which stay."""
    t = F.coalesce("text", F.lit(""))
    odd = R.percent_decode(F.concat(F.lit("a%zz+"), "source", F.lit("%")))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(R.percent_encode(t)).alias("encoded"), F.md5(R.percent_decode(R.percent_encode(t))).alias("decoded"), odd.alias("odd"))


_PATHS = ("/data/out/x.mp4", "clips/./a.png", "/data/../etc/passwd", "/etc/passwd", "/tmp/cap//b.png", "/data", "../x", "/database/x")


@query("str17_path_validation", f"""WITH p AS (SELECT event_id, {_list(_PATHS)}[event_id % 8 + 1] AS p FROM events), a AS (SELECT event_id, p, '/' || array_to_string(list_filter(string_split(CASE WHEN p LIKE '/%' THEN p ELSE '/data/' || p END, '/'), lambda x: x <> '' AND x <> '.'), '/') AS c FROM p)
SELECT event_id, CASE WHEN NOT list_contains(string_split(p, '/'), '..') AND (c IN ('/data', '/tmp/cap') OR c LIKE '/data/%' OR c LIKE '/tmp/cap/%') THEN c END AS path FROM a""")  # fmt: skip
def path_validation(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", R.allowed_path(_pick(_PATHS, F.col("event_id")), ["/data", "/tmp/cap"]).alias("path"))


@query("str2_day_prompt", f"""WITH {A.ENTRIES_SQL}, d AS (SELECT session_id, s // 86400000000 AS day, id, s, '- ' || strftime(make_timestamp(s), '%Y-%m-%d %H:%M') || ' to ' || strftime(make_timestamp(e), '%Y-%m-%d %H:%M') || ' | ' || category || ' |  | ' || activity || ' | ' AS line FROM entries)
SELECT session_id, day, md5('QUESTION: what  now?' || chr(10) || '===BEGIN RECORDED ACTIVITY===' || chr(10) || string_agg(line || chr(10), '' ORDER BY s, id) || '===END RECORDED ACTIVITY===' || chr(10)) AS prompt FROM d GROUP BY ALL""")  # fmt: skip
def day_prompt(spark, sf_dir):
    """The question first, then the day's entries between marks, each field on one line."""
    flat = lambda c: X.flatten(F.coalesce(c, F.lit("")))
    at = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm")
    e = A.entries(spark, sf_dir)
    line = F.concat(F.lit("- "), at("s"), F.lit(" to "), at("e"), F.lit(" | "), "category", F.lit(" |  | "), flat(F.col("activity")), F.lit(" | \n"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "id", line.alias("l")))), lambda x: x["l"]), "")  # a session's day
    text = F.concat(F.lit("QUESTION: "), X.flatten(F.lit("what\n\tnow?")), F.lit("\n===BEGIN RECORDED ACTIVITY===\n"), rows, F.lit("===END RECORDED ACTIVITY===\n"))
    return e.groupBy("session_id", F.floor(F.col("s") / 86_400_000_000).alias("day")).agg(F.md5(text).alias("prompt"))


# -- replies of models ------------------------------------------------------------------------------------------------

REPLIES_SQL = """r AS (SELECT event_id AS id, event_id % 5 AS k, user_id AS u, (event_id * 13) % 5000 AS n FROM events)"""


def _replies(spark, sf_dir):
    """JSON bodies: with an error, without text, and whole ones with and without counts; some are no JSON."""
    i = F.col("event_id")
    k, n, u = i % 5, (i * 13) % 5000, F.col("user_id").cast("string")
    error = F.to_json(F.struct(F.struct(F.lit(429).alias("code"), F.concat(F.lit("quota "), u).alias("message")).alias("error")))
    parts = F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("seen "), u).alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    usage = F.struct(n.alias("promptTokenCount"), F.when(k == 2, n % 7).alias("candidatesTokenCount"), (n + 1).alias("totalTokenCount"))
    whole = F.to_json(F.struct(parts["candidates"].alias("candidates"), usage.alias("usageMetadata"), F.lit("gemini-3.8-flash").alias("modelVersion")))
    body = F.when(k == 0, error).when(k == 1, F.lit('{"candidates": []}')).when(k == 4, F.lit("<html>502</html>")).otherwise(whole)
    return _t(spark, sf_dir, "events").select(i.alias("id"), body.alias("body"))


@query("str20_reply_parse", f"WITH {REPLIES_SQL} SELECT id, CASE WHEN k IN (2, 3) THEN 'seen ' || u END AS text, CASE WHEN k IN (2, 3) THEN n + 1 END AS tokens, CASE WHEN k = 0 THEN 'quota ' || u WHEN k IN (1, 4) THEN 'no text in the reply' END AS error FROM r")
def reply_parse(spark, sf_dir):
    text, tokens, error = R.hosted_reply(F.col("body"))
    return _replies(spark, sf_dir).select("id", text.alias("text"), tokens.alias("tokens"), error.alias("error"))


@query("str21_error_class", f"""WITH {REPLIES_SQL}, s AS (SELECT *, [200, 401, 403, 429, 500, 503][id % 6 + 1] AS status FROM r)
SELECT id, CASE WHEN status IN (401, 403) THEN 'authentication_failed' WHEN status = 429 THEN 'rate_limited' ELSE 'api_error' END AS kind, CASE WHEN status <> 429 AND k = 0 THEN 'quota ' || u WHEN status <> 429 AND k = 4 THEN '<html>502</html>' WHEN status <> 429 AND k = 1 THEN '{{"candidates": []}}' END AS message,
  CASE WHEN status = 429 THEN 60 END AS retry_after FROM s WHERE k NOT IN (2, 3)""")  # fmt: skip
def error_class(spark, sf_dir):
    e = R.classified(_pick((200, 401, 403, 429, 500, 503), F.col("id")), F.col("body"))
    return _replies(spark, sf_dir).where("id % 5 not in (2, 3)").select("id", e["kind"].alias("kind"), e["message"].alias("message"), e["retry_after"].alias("retry_after"))


@query("str22_parse_usage", f"WITH {REPLIES_SQL} SELECT id, CASE WHEN k IN (2, 3) THEN n END AS input, CASE k WHEN 2 THEN n % 7 WHEN 3 THEN 0 END AS output, CASE WHEN k IN (2, 3) THEN 0 END::BIGINT AS thinking, CASE WHEN k IN (2, 3) THEN 'gemini-3.8-flash' END AS version FROM r")
def parse_usage(spark, sf_dir):
    u = R.usage_of(F.col("body"))
    return _replies(spark, sf_dir).select("id", *[u[c].alias(c) for c in ("input", "output", "thinking", "version")])


@query("src18_usage_log", f"WITH {A.USAGE_SQL} SELECT burst, count(*) AS calls, sum(tokens_in)::BIGINT AS input FROM usage WHERE burst IS NOT NULL AND tokens_out % 5 <> 0 GROUP BY burst")
def usage_log(spark, sf_dir):
    """A log of one JSON object a line, scanned for bursts; lines that can't be read are passed over."""
    u = A.usage(spark, sf_dir)
    line = F.when(F.col("tokens_out") % 5 == 0, F.lit('{"burst": "b1", "inp')).otherwise(F.to_json(F.struct("burst", "model", F.col("tokens_in").alias("input"))))
    log = u.select(F.from_json(line, "burst string, model string, input long").alias("r")).select("r.*").where("burst is not null and input is not null")
    return log.groupBy("burst").agg(F.count(F.lit(1)).alias("calls"), F.sum("input").alias("input"))


_MODELS = ("gemini-3.8-flash", "gemini-3.10-flash", "gemini-flash-latest", "gemini-3.8.1-pro", "gemini-2.5-pro-preview-0605", "house", "gemini-3-x", "gemini-3.8-air")


@query("str19_version_order", f"""WITH v AS (SELECT DISTINCT p_size AS catalog, {_list(_MODELS)}[p_partkey % 8 + 1] AS name FROM part)
SELECT catalog, name, row_number() OVER (PARTITION BY catalog ORDER BY CASE name WHEN 'gemini-flash-latest' THEN 0 WHEN 'house' THEN 1 WHEN 'gemini-3.10-flash' THEN 2 WHEN 'gemini-3.8.1-pro' THEN 3 WHEN 'gemini-3.8-air' THEN 4 WHEN 'gemini-3.8-flash' THEN 5 WHEN 'gemini-3-x' THEN 6 ELSE 7 END)::INTEGER AS place FROM v""")  # fmt: skip
def version_order(spark, sf_dir):
    m = _t(spark, sf_dir, "part").select(F.col("p_size").alias("catalog"), _pick(_MODELS, F.col("p_partkey")).alias("name")).distinct()
    return R.newest_first(m, ["catalog"], "name").select("catalog", "name", "place")


@query("src25_model_catalog", "SELECT p_partkey, p_brand AS name, p_partkey % 2 = 0 AS thinking FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0")
def model_catalog(spark, sf_dir):
    """Models with vision, of a listing and what is told of each; a body that can't be read gives none."""
    k = F.col("p_partkey")
    able = F.array_compact(F.array(F.lit("completion"), F.when(k % 3 != 0, F.lit("vision")), F.when(k % 2 == 0, F.lit("thinking"))))
    tags = F.to_json(F.struct(F.array(F.struct(F.col("p_brand").alias("name"))).alias("models")))
    shown = F.when(k % 7 == 0, F.lit("{oops")).otherwise(F.to_json(F.struct(able.alias("capabilities"))))
    t = _t(spark, sf_dir, "part").select("p_partkey", F.explode(F.from_json(tags, "models array<struct<name:string>>")["models"]["name"]).alias("name"), F.from_json(shown, "capabilities array<string>")["capabilities"].alias("able"))
    return t.where(F.array_contains("able", "vision")).select("p_partkey", "name", F.array_contains("able", "thinking").alias("thinking"))


@query("fil11_vision_models", "SELECT p_partkey FROM part WHERE p_size % 3 = 1 OR p_size % 5 = 0")
def vision_models(spark, sf_dir):
    """Listed models that answer: by a vision capability, or by the generating method among those they support."""
    n = F.col("p_size")
    local, hosted = F.array(F.when(n % 3 == 1, "vision").otherwise("tools")), F.array(F.lit("embedContent"), F.when(n % 5 == 0, "generateContent").otherwise("countTokens"))
    return _t(spark, sf_dir, "part").where(F.array_contains(local, "vision") | F.array_contains(hosted, "generateContent")).select("p_partkey")


# -- sources and files ------------------------------------------------------------------------------------------------


@query("src2_row_decode", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'status' WHEN o_orderkey % 11 = 0 THEN 'start_time' END AS bad, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 0 THEN epoch_us(o_orderdate) END AS end_time FROM orders""")
def row_decode(spark, sf_dir):
    """Text columns to values: a bad status or start makes the row bad, a bad end only a null."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = _t(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 7 == 0, "lost").otherwise("completed").alias("status"), F.when(k % 11 == 0, "soon").otherwise(day).alias("start"), F.when(k % 5 == 0, "never").otherwise(day).alias("end"))
    when = lambda c: F.unix_micros(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    bad = F.when(~F.col("status").isin("recording", "finalizing", "completed", "error", "cancelled"), "status").when(when("start").isNull(), "start_time")
    return raw.select("id", bad.alias("bad"), F.when(bad.isNull(), when("end")).alias("end_time"))


def _sidecars(spark, sf_dir):
    """(frame_id, sidecar): boxes of a frame as JSON; some are cut short, some missing, some empty."""
    box = F.struct("idx", "x", "y", "w", "h", "display_id")
    text = F.to_json(F.sort_array(F.collect_list(box)))  # a frame's boxes
    f = F.col("frame_id")
    return A.regions(spark, sf_dir).groupBy("frame_id").agg(text.alias("t")).select("frame_id", F.when(f % 5 == 0, F.substring("t", 1, 30)).when(f % 7 == 0, F.lit("[]")).when(f % 11 != 0, F.col("t")).alias("sidecar"))


@query("src6_region_sidecars", f"""WITH {A.REGIONS_SQL}, g AS (SELECT frame_id, count(*) AS n FROM regions GROUP BY frame_id)
SELECT frame_id, CASE WHEN frame_id % 5 = 0 THEN NULL WHEN frame_id % 7 = 0 THEN 0 WHEN frame_id % 11 <> 0 THEN n END AS boxes, frame_id % 5 = 0 OR (frame_id % 7 <> 0 AND frame_id % 11 = 0) AS read_whole FROM g""")  # fmt: skip
def region_sidecars(spark, sf_dir):
    """A sidecar that is missing or can't be read leaves the whole frame to read; an empty one is an answer."""
    s = _sidecars(spark, sf_dir).withColumn("r", O.sidecar_regions(F.col("sidecar")))
    return s.select("frame_id", F.size("r").cast("long").alias("boxes"), F.col("r").isNull().alias("read_whole")).withColumn("boxes", F.when(~F.col("read_whole"), F.col("boxes")))


@query("src8_sample_files", """WITH n AS (SELECT user_id % 3 AS display_id, user_id AS sequence, 'd' || (user_id % 3) || '_w' || printf('%06d', user_id) || '_' || strftime(ts, '%Y%m%dT%H%M%S%g') || CASE WHEN event_id % 4 = 0 THEN '.json' ELSE '.png' END AS name FROM events)
SELECT display_id, sequence, name, row_number() OVER (PARTITION BY display_id, sequence ORDER BY name)::INTEGER AS place FROM n WHERE name LIKE '%.png'""")  # fmt: skip
def sample_files(spark, sf_dir):
    """The image files of each window, told by the prefix of their names, in order."""
    i = F.col("user_id")
    name = F.concat(S.sample_stem(i % 3, i, F.col("ts")), F.when(F.col("event_id") % 4 == 0, ".json").otherwise(".png"))
    part = lambda n: F.regexp_extract("name", r"^d(\d+)_w(\d+)_.*\.png$", n)
    f = _t(spark, sf_dir, "events").select(name.alias("name")).where(part(1) != "").select(part(1).cast("long").alias("display_id"), part(2).cast("long").alias("sequence"), "name")
    return f.withColumn("place", F.row_number().over(Window.partitionBy("display_id", "sequence").orderBy("name")))


@query("src16_source_spec", """SELECT event_id, CASE WHEN (event_id % 2 = 0)::INT + (event_id % 3 = 0)::INT + (event_id % 5 = 0)::INT + (event_id % 7 = 0)::INT > 1 THEN 'error' WHEN event_id % 2 = 0 THEN 'window' WHEN event_id % 3 = 0 THEN 'target' WHEN event_id % 5 = 0 THEN 'input' WHEN event_id % 7 = 0 THEN 'displays' ELSE 'all_displays' END AS source FROM events""")
def source_spec(spark, sf_dir):
    i = F.col("event_id")
    displays = F.when(i % 7 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return _t(spark, sf_dir, "events").select("event_id", R.source_spec(F.when(i % 2 == 0, "editor").otherwise("  "), F.when(i % 3 == 0, "board"), F.when(i % 5 == 0, "rtsp://x"), displays).alias("source"))


_NAMES = ("a.PNG", "b.mp4", "c.txt", "d.jpeg", "e", "f.webm")


@query("src23_capture_discovery", f"""WITH c AS (SELECT o_orderkey AS id, o_orderpriority AS folder, epoch_us(o_orderdate) AS modified, {_list(_NAMES)}[o_orderkey % 6 + 1] AS name FROM orders), k AS (SELECT *, CASE WHEN lower(name) SIMILAR TO '.*\\.(png|jpg|jpeg|webp|bmp|gif)' THEN 'image' WHEN lower(name) SIMILAR TO '.*\\.(mp4|mkv|mov|webm|avi|m4v)' THEN 'video' END AS kind FROM c)
SELECT folder, id, kind FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY folder ORDER BY modified DESC, id) <= 5""")  # fmt: skip
def capture_discovery(spark, sf_dir):
    """The five newest images and videos of each folder, told by their extension."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    kind = F.when(ext.isin("png", "jpg", "jpeg", "webp", "bmp", "gif"), "image").when(ext.isin("mp4", "mkv", "mov", "webm", "avi", "m4v"), "video")
    c = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("folder"), "o_orderdate", _pick(_NAMES, F.col("o_orderkey")).alias("name")).withColumn("kind", kind).where("kind is not null")
    return c.withColumn("n", F.row_number().over(Window.partitionBy("folder").orderBy(F.col("o_orderdate").desc(), "id"))).where("n <= 5").select("folder", "id", "kind")


@query("src26_sidecar_listing", "SELECT o_orderpriority AS folder, o_orderkey AS id, 'p' || o_orderkey || '.json' AS path FROM orders WHERE o_orderkey % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def sidecar_listing(spark, sf_dir):
    """The newest readable sidecars, with the path each was read from."""
    k = F.col("o_orderkey")
    body = F.when(k % 4 == 0, F.lit("{")).otherwise(F.to_json(F.struct(k.alias("id"))))
    c = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("folder"), F.from_json(body, "id long")["id"].alias("id"), "o_orderdate", F.concat(F.lit("p"), k.cast("string"), F.lit(".json")).alias("path")).where("id is not null")
    return c.withColumn("n", F.row_number().over(Window.partitionBy("folder").orderBy(F.col("o_orderdate").desc(), "id"))).where("n <= 3").select("folder", "id", "path")


@query("src20_frame_times", "SELECT o_orderkey AS id, k, round(o_orderkey % 100 + k / least(greatest(8 / (o_orderkey % 500 + 1), 0.05), 2), 6) AS \"at\" FROM orders, unnest(range(0, least(ceil((o_orderkey % 500 + 1) * least(greatest(8 / (o_orderkey % 500 + 1), 0.05), 2)), 12)::BIGINT)) AS u(k)")
def frame_times(spark, sf_dir):
    """The times of evenly sampled frames of a clip, twelve at most, from its start."""
    d, start = F.col("o_orderkey") % 500 + 1, F.col("o_orderkey") % 100
    fps = S.even_fps(d, 8.0, 2.0)
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), start.alias("start"), fps.alias("fps"), F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.ceil(d * fps), F.lit(12)) - 1)).alias("k"))
    return o.select("id", "k", F.round(F.col("start") + F.col("k") / F.col("fps"), 6).alias("at"))


@query("win7_report_check", """WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, epoch_us(ts) // 1000 - CASE WHEN event_id % 97 = 0 THEN 100000000 ELSE 0 END AS t FROM events),
c AS (SELECT *, CASE WHEN event_id % 89 = 0 THEN pos + 1 ELSE pos END AS n, lag(t) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM o),
b AS (SELECT user_id, min(pos) FILTER (WHERE n <> pos) AS bad_number, min(pos) FILTER (WHERE t <= before) AS bad_time FROM c GROUP BY user_id)
SELECT user_id, bad_number, bad_time, bad_number IS NULL AND bad_time IS NULL AS ok FROM b""")  # fmt: skip
def report_check(spark, sf_dir):
    """A report of frames holds if their numbers are their places and their times only rise."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    i = F.col("event_id")
    o = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.row_number().over(w) - 1).cast("long").alias("pos"), (F.floor(A.micros("ts") / 1000) - F.when(i % 97 == 0, 100_000_000).otherwise(0)).alias("t"))
    return O.report_errors(o.withColumn("n", F.when(i % 89 == 0, F.col("pos") + 1).otherwise(F.col("pos"))), "user_id")


# -- displays and windows ---------------------------------------------------------------------------------------------


@query("fil9_zero_area", f"WITH {A.REGIONS_SQL} SELECT frame_id, idx FROM regions WHERE w % 32 <> 0 AND h % 17 <> 0")
def zero_area(spark, sf_dir):
    r = A.regions(spark, sf_dir).withColumn("w", F.col("w") % 32).withColumn("h", F.col("h") % 17)
    return r.where("w != 0 and h != 0").select("frame_id", "idx")


_WORDS = ("primary", " Portrait", "ultrawide", "landscape", "display 2 (3440x1440)", "none", "MAIN", "display 3 (1080x2560)")
_DISPLAYS = ((0, 1920, 1080, True), (1, 3440, 1440, False), (2, 1080, 2560, False))
_MET = {"primary": (0,), " Portrait": (2,), "ultrawide": (1,), "landscape": (0,), "display 2 (3440x1440)": (1,), "none": (), "MAIN": (0,), "display 3 (1080x2560)": (2,)}
_MET_SQL = "m(word, display) AS (VALUES " + ", ".join(f"('{w}', {d})" for w, ds in _MET.items() for d in ds) + ")"


@query("fil15_display_selection", f"""WITH {_MET_SQL}, w AS (SELECT event_id AS id, unnest([1, 2, 3]) AS n, unnest([{_list(_WORDS)}[event_id % 8 + 1], {_list(_WORDS)}[event_id // 3 % 8 + 1], {_list(_WORDS)}[event_id // 7 % 8 + 1]]) AS word FROM events),
f AS (SELECT id, display, min(n) AS n FROM w JOIN m USING (word) GROUP BY ALL) SELECT id, string_agg(display::VARCHAR, ',' ORDER BY n, display) AS displays FROM f GROUP BY id""")  # fmt: skip
def display_selection(spark, sf_dir):
    """Words resolved against the attached displays; a selection that matches none gives no row."""
    i = F.col("event_id")
    words = F.array(_pick(_WORDS, i), _pick(_WORDS, F.floor(i / 3)), _pick(_WORDS, F.floor(i / 7)))
    d = spark.createDataFrame(list(_DISPLAYS), "index long, w long, h long, primary boolean")  # the attached displays
    d = d.withColumn("name", R.display_name(F.col("index"), F.col("w"), F.col("h"), F.col("primary")))
    return R.selected_displays(_t(spark, sf_dir, "events").select(i.alias("id"), words.alias("words")), d).select("id", F.array_join(F.transform("displays", lambda x: x.cast("string")), ",").alias("displays"))


_ROLES = ("frame", "scroll pane", "label", "push button", "viewport", "dialog", "")


@query("str27_role_granularity", f"SELECT event_id, CASE WHEN r IN ('frame', 'dialog') THEN 'window' WHEN r IN ('scroll pane', 'viewport') THEN 'pane' WHEN r = 'label' THEN 'text' ELSE 'element' END AS granularity FROM (SELECT event_id, {_list(_ROLES)}[event_id % 7 + 1] AS r FROM events)")
def role_granularity(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", R.role_granularity(_pick(_ROLES, F.col("event_id"))).alias("granularity"))


@query("mth12_intent", "SELECT event_id, event_id % 3 = 0 AS keeps_text, event_id % 3 = 0 AS aggregates_text, event_id % 3 <> 0 AS discards_stills FROM events")
def intent(spark, sf_dir):
    """Content keeps and merges what was on screen; activity lets the stills go once they are summarised."""
    return _t(spark, sf_dir, "events").select("event_id", *S.intent(F.when(F.col("event_id") % 3 == 0, "content").otherwise("activity")))


@query("mth14_stack_memory", """WITH b AS (SELECT event_id, (event_id % 40)::HUGEINT AS f, (CASE WHEN event_id % 9 = 0 THEN 2000000000 ELSE event_id % 4000 END)::HUGEINT AS w, (user_id + 700)::HUGEINT AS h, (CASE WHEN event_id % 9 = 0 THEN 2000 ELSE event_id % 4 END)::HUGEINT AS s FROM events),
p AS (SELECT *, least(w * s * h * s, 18446744073709551615::HUGEINT) AS px FROM b) SELECT event_id, least(least(f * px, 18446744073709551615::HUGEINT) * 12 + least(px * 192, 18446744073709551615::HUGEINT), 18446744073709551615::HUGEINT)::VARCHAR AS bytes FROM p""")  # fmt: skip
def stack_memory(spark, sf_dir):
    i, odd = F.col("event_id"), F.col("event_id") % 9 == 0
    n = R.stack_bytes(i % 40, F.when(odd, 2_000_000_000).otherwise(i % 4000), F.col("user_id") + 700, F.when(odd, 2000).otherwise(i % 4))
    return _t(spark, sf_dir, "events").select("event_id", n.cast("string").alias("bytes"))


@query("geo15_contact_sheets", "WITH o AS (SELECT user_id, event_id, (event_id * 37) % 60000 AS \"at\", row_number() OVER (PARTITION BY user_id ORDER BY (event_id * 37) % 60000, event_id) - 1 AS k FROM events) SELECT user_id, (k // 12)::BIGINT AS sheet, count(*) AS tiles, min(\"at\") AS s, max(\"at\") AS e FROM o GROUP BY ALL")
def contact_sheets(spark, sf_dir):
    """Frames twelve to a sheet, in order, with the span of time of each sheet."""
    at = (F.col("event_id") * 37) % 60000
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(at, "event_id")) - 1
    o = _t(spark, sf_dir, "events").select("user_id", at.alias("at"), F.floor(k / 12).cast("long").alias("sheet"))
    return o.groupBy("user_id", "sheet").agg(F.count(F.lit(1)).alias("tiles"), F.min("at").alias("s"), F.max("at").alias("e"))


# -- perception -------------------------------------------------------------------------------------------------------


@query("txt7_tier_routing", """WITH c AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN 'reason' ELSE 'text' END AS tier, CASE WHEN event_id % 6 = 0 THEN '  ' ELSE 'why ' || event_type END AS reason FROM events),
v AS (SELECT *, tier = 'text' OR trim(reason) <> '' AS valid FROM c), n AS (SELECT *, count(*) FILTER (WHERE valid) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spent FROM v)
SELECT event_id, CASE WHEN NOT valid THEN 'refused:no_reason' WHEN spent > 20 THEN 'refused:budget' ELSE tier END AS served, CASE WHEN valid AND spent <= 20 AND tier = 'reason' THEN reason END AS escalation FROM n""")  # fmt: skip
def tier_routing(spark, sf_dir):
    """Text or reasoning: an escalation must say why, before any budget is spent; both count; escalations are kept."""
    i = F.col("event_id")
    c = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(i % 3 == 0, "reason").otherwise("text").alias("tier"), F.when(i % 6 == 0, F.lit("  ")).otherwise(F.concat(F.lit("why "), "event_type")).alias("reason"))
    return O.routed(c, "user_id", ["ts", "event_id"], 20).select("event_id", "served", "escalation")


@query("txt6_segment_ladder", f"""WITH {A.REGIONS_SQL}, x AS (SELECT frame_id, idx, row_number() OVER (PARTITION BY frame_id ORDER BY idx) AS n, display_id = 1 AS own, source FROM regions),
g AS (SELECT frame_id, count(*) FILTER (WHERE n <= 4 AND own) AS crops, string_agg(source || ':' || idx, chr(10) || '---' || chr(10) ORDER BY idx) FILTER (WHERE n <= 4 AND own) AS text FROM x GROUP BY frame_id),
s AS (SELECT frame_id, frame_id // 4 AS segment, frame_id % 5 = 0 OR (frame_id % 7 <> 0 AND frame_id % 11 = 0) AS lost, frame_id % 5 <> 0 AND frame_id % 7 = 0 AS none, crops, text FROM g),
t AS (SELECT *, NOT lost AND NOT none AND crops > 0 AS cropped FROM s)
SELECT segment, count(*) AS samples, CASE WHEN count(*) * 4 + 1 > 13 THEN 'refused' ELSE 'read' END AS outcome, CASE WHEN count(*) * 4 + 1 <= 13 THEN sum(CASE WHEN cropped THEN crops ELSE 1 END)::BIGINT + 1 END AS calls,
  CASE WHEN count(*) * 4 + 1 <= 13 THEN count(*) FILTER (WHERE NOT cropped AND NOT none) END AS read_whole, CASE WHEN count(*) * 4 + 1 <= 13 THEN md5(string_agg(CASE WHEN cropped THEN text ELSE 'whole:' || frame_id END, chr(10) || '---' || chr(10) ORDER BY frame_id)) END AS text
FROM t GROUP BY segment""")  # fmt: skip
def segment_ladder(spark, sf_dir):
    """What is read of a segment's samples: their boxes, four at most, or the whole frame; a segment that could never
    fit the budget is refused at once. Reading itself is a column that the caller gives; here it names the box."""
    s = _sidecars(spark, sf_dir).withColumn("segment", F.floor(F.col("frame_id") / 4))
    s = s.where("frame_id >= 0")
    src = A.regions(spark, sf_dir).select("frame_id", "idx", F.concat_ws(":", "source", F.col("idx").cast("string")).alias("text"))
    out = O.ladder(s, src, display=1, most=4, budget=13)
    return out.select("segment", "samples", "outcome", "calls", "read_whole", F.md5("text").alias("text"))


@query("txt5_text_quality")
def text_quality(spark, sf_dir):
    """Distinct lines, distinct tokens and estimated compression of every text."""
    return X.quality(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


# -- boxes ------------------------------------------------------------------------------------------------------------

_REQUESTS = ("focus the second pane", "the rightmost box", "upper left label", "show the ocr thing", "top window", "pane 3", "middle of the screen", "zzz", "the wm icon", "last text")


@query("str12_ordinal", f"SELECT event_id, [2, NULL, NULL, NULL, NULL, 3, NULL, NULL, NULL, NULL][event_id % 10 + 1] AS n FROM events")
def ordinal(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", R.ordinal(F.lower(_pick(_REQUESTS, F.col("event_id")))).alias("n"))


LOCATE_SQL = f"""{A.REGIONS_SQL}, q AS (SELECT DISTINCT frame_id, {_list(_REQUESTS)}[frame_id % 10 + 1] AS low, [2, -1, 4, -1, 1, 2, -1, -1, 3, 4][frame_id % 10 + 1] AS want FROM regions),
a AS (SELECT r.*, low, want, frame_id % 10 AS k, coalesce(want = granularity, FALSE) AS hit, max(coalesce(want = granularity, FALSE)) OVER (PARTITION BY frame_id) AS anyhit FROM regions r JOIN q USING (frame_id)),
p AS (SELECT *, count(*) OVER f AS n, row_number() OVER (PARTITION BY frame_id ORDER BY CASE WHEN k IN (2, 4) THEN y ELSE x END, CASE WHEN k IN (2, 4) THEN x ELSE y END, idx) - 1 AS place FROM a WHERE hit OR NOT anyhit WINDOW f AS (PARTITION BY frame_id)),
t AS (SELECT *, CASE k WHEN 0 THEN least(2, n) - 1 WHEN 1 THEN n - 1 WHEN 2 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN least(3, n) - 1 WHEN 6 THEN n // 2 WHEN 9 THEN n - 1 END AS "at",
  CASE WHEN k = 3 AND source = 'ocr' THEN 4 WHEN k = 8 AND source = 'wm' THEN 3 ELSE 0 END AS score FROM p)"""


@query("str11_locate", f"""WITH {LOCATE_SQL}, l AS (SELECT frame_id, max("at") AS "at", max(CASE WHEN place = "at" THEN idx END) AS picked, arg_min(idx, -score * 1000 + idx) FILTER (WHERE score > 0) AS named FROM t GROUP BY frame_id)
SELECT frame_id, CASE WHEN "at" IS NOT NULL THEN picked ELSE named END AS idx FROM l""")  # fmt: skip
def locate(spark, sf_dir):
    """A region for what was asked, by number, side or name."""
    r = A.regions(spark, sf_dir)
    kind = _pick(("monitor", "window", "pane", "element", "text"), F.col("granularity"))
    regions = r.select("frame_id", "idx", "x", "y", kind.alias("kind"), F.col("source").alias("label"), F.lit(None).cast("string").alias("role"))
    return R.located(r.select("frame_id", _pick(_REQUESTS, F.col("frame_id")).alias("request")).distinct(), regions)


@query("str13_label_score", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE (CASE WHEN p_partkey % 4 = 1 THEN 1 ELSE 0 END) + (CASE WHEN p_partkey % 4 IN (1, 2) THEN 3 ELSE 0 END) END::INTEGER AS score FROM part""")
def label_score(spark, sf_dir):
    """Words of a request in a region's label or role."""
    k = F.col("p_partkey") % 4
    label = F.when(k == 0, F.lit(None)).when(k == 1, "Inbox").when(k == 2, "my").otherwise("Sent")
    return _t(spark, sf_dir, "part").select("p_partkey", R.label_score(F.lit("open my inbox"), label, F.lit("")).cast("int").alias("score"))


@query("agg17_medoid", f"""WITH {A.REGIONS_SQL}, c AS (SELECT a.frame_id, a.idx AS id, round(sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS cost FROM regions a JOIN regions b USING (frame_id) GROUP BY ALL)
SELECT frame_id, arg_min(id, cost * 100000 + id) AS id FROM c GROUP BY frame_id""")  # fmt: skip
def medoid(spark, sf_dir):
    return R.medoids(A.regions(spark, sf_dir).select("frame_id", F.col("idx").alias("id"), "x", "y"), ["frame_id"])


@query("geo5_crop_rect", f"""WITH {A.REGIONS_SQL}, c AS (SELECT frame_id, idx, greatest(x - 60, 0) AS x, greatest(y - 40, 0) AS y, least(x - 60 + w, 200) AS x1, least(y - 40 + h, 150) AS y1 FROM regions)
SELECT frame_id, idx, x, y, x1 - x AS w, y1 - y AS h FROM c WHERE x1 > x AND y1 > y""")  # fmt: skip
def crop_rect(spark, sf_dir):
    """Boxes cut to a frame; one that doesn't meet the frame is skipped, never moved to its edge."""
    x, y, w, h = O.clipped(F.col("x") - 60, F.col("y") - 40, F.col("w"), F.col("h"), 0, 0, 200, 150)
    return A.regions(spark, sf_dir).select("frame_id", "idx", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")).where("w > 0 and h > 0")


FNV_SQL = "list_reduce([14695981039346656037::UHUGEINT] || list_transform({bytes}, lambda b: b::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
SIGNED_SQL = "(CASE WHEN {h} >= 9223372036854775808::UHUGEINT THEN {h}::HUGEINT - 18446744073709551616::HUGEINT ELSE {h}::HUGEINT END)::BIGINT"
_BYTES = "flatten(list_transform([display_id, granularity, x, y, w, h], lambda v: list_transform(range(0, 8), lambda i: (v >> (8 * i)) & 255)))"
IDENTITY_SQL = f"ident AS (SELECT frame_id, idx, {SIGNED_SQL.format(h='f')} AS identity FROM (SELECT frame_id, idx, {FNV_SQL.format(bytes=_BYTES)} AS f FROM regions))"


def _identity():
    return S.fnv1a(F.concat(*[S.little_endian(F.col(c)) for c in ("display_id", "granularity", "x", "y", "w", "h")]))


@query("mth11_region_identity", f"WITH {A.REGIONS_SQL}, {IDENTITY_SQL} SELECT * FROM ident")
def region_identity(spark, sf_dir):
    """FNV-1a over display, granularity and box as little-endian numbers."""
    return A.regions(spark, sf_dir).select("frame_id", "idx", _identity().alias("identity"))


@query("jn3_parent_identity", f"WITH {PARENTS_SQL}, {IDENTITY_SQL} SELECT p.frame_id, p.idx, identity AS parent_identity FROM parents p LEFT JOIN ident i ON i.frame_id = p.frame_id AND i.idx = p.parent")
def parent_identity(spark, sf_dir):
    """The parent's identity beside each box; a parent that isn't there gives null."""
    r = A.regions(spark, sf_dir)
    up = r.select("frame_id", F.col("idx").alias("parent"), _identity().alias("parent_identity"))
    return O.parents(r).join(up, ["frame_id", "parent"], "left").select("frame_id", "idx", "parent_identity")


_KEY_BYTES = "list_transform(range(1, length(p_name) + 9), lambda i: CASE WHEN i <= 7 THEN ascii(substr('display', i::INT, 1)) WHEN i = 8 THEN 255 ELSE ascii(substr(p_name, (i - 8)::INT, 1)) END)"


@query("src17_source_identity", f"SELECT p_partkey, {SIGNED_SQL.format(h='f')} AS identity FROM (SELECT p_partkey, {FNV_SQL.format(bytes=_KEY_BYTES)} AS f FROM part)")
def source_identity(spark, sf_dir):
    """FNV-1a over a source's kind, a byte 255 and its key."""
    code = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x))
    return _t(spark, sf_dir, "part").select("p_partkey", S.fnv1a(F.concat(code(F.lit("display")), F.array(F.lit(255)), code(F.col("p_name")))).alias("identity"))


@query("geo7_provenance_order")
def provenance_order(spark, sf_dir):
    """Boxes in reading order with their identities and places; geo6's order, held by a test."""
    r = A.regions(spark, sf_dir)
    order = O.reading_order(r.join(O.parents(r), ["frame_id", "idx"]))
    return order.join(r.select("frame_id", "idx", _identity().alias("identity")), ["frame_id", "idx"])


QUADS_SQL = """c AS (SELECT event_id, (event_id * 17) % 300 AS x, (event_id * 29) % 200 AS y, 40 + event_id % 160 AS w, 30 + event_id % 90 AS h, event_id % 4 AS k FROM events)"""


def _quads(spark, sf_dir):
    """Four corners in some order; every fourth a bow or with equal corners."""
    i = F.col("event_id")
    x, y, w, h, k = (i * 17) % 300, (i * 29) % 200, 40 + i % 160, 30 + i % 90, i % 4
    p = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    a, b, c, d = p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h)
    return _t(spark, sf_dir, "events").select("event_id", F.when(k == 0, F.array(c, a, d, b)).when(k == 1, F.array(b, c, d, a)).when(k == 2, F.array(a, a, c, d)).otherwise(F.array(d, c, b, a)).alias("q"))


def _ordered(spark, sf_dir):
    """A generator between, so that the order is made once for the many expressions that read it."""
    return _quads(spark, sf_dir).select("event_id", F.explode(F.array(R.ordered_quad(F.col("q")))).alias("o"))


@query("geo12_quad_order", f"WITH {QUADS_SQL} SELECT event_id, k <> 2 AS valid, CASE WHEN k <> 2 THEN x || ',' || y || ' ' || (x + w) || ',' || y || ' ' || (x + w) || ',' || (y + h) || ' ' || x || ',' || (y + h) END AS corners FROM c")
def quad_order(spark, sf_dir):
    """Corners clockwise from the top left, if they make a convex quad."""
    q = _ordered(spark, sf_dir).withColumn("valid", R.valid_quad(F.col("o")))
    whole = lambda c: c.cast("long").cast("string")
    text = F.array_join(F.transform("o", lambda p: F.concat_ws(",", whole(p["x"]), whole(p["y"]))), " ")
    return q.select("event_id", "valid", F.when(F.col("valid"), text).alias("corners"))


@query("fil13_clipped_corners", f"""WITH {QUADS_SQL}, e AS (SELECT event_id, x <= 10 AS l, x + w >= 429 AS r, y <= 10 AS t, y + h >= 289 AS b FROM c WHERE k <> 2)
SELECT event_id, array_to_string(list_filter([CASE WHEN l OR t THEN 'top_left' END, CASE WHEN r OR t THEN 'top_right' END, CASE WHEN r OR b THEN 'bottom_right' END, CASE WHEN l OR b THEN 'bottom_left' END], lambda x: x IS NOT NULL), ',') AS clipped FROM e""")  # fmt: skip
def clipped(spark, sf_dir):
    q = _ordered(spark, sf_dir).where(R.valid_quad(F.col("o")))
    return q.select("event_id", F.array_join(R.clipped_corners(F.col("o"), 440, 300, 10.0), ",").alias("clipped"))


@query("jn7_previous_frame", "WITH b AS (SELECT vec_id AS id, label, vec_id // 100 AS session, vec_id % 6 = 0 AS blank FROM embeddings) SELECT id, last_value(CASE WHEN NOT blank THEN id END IGNORE NULLS) OVER (PARTITION BY label, session ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM b")
def previous_frame(spark, sf_dir):
    """The last buffer before that isn't empty, of the same session and display."""
    b = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.floor(F.col("vec_id") / 100).alias("session"), F.when(F.col("vec_id") % 6 != 0, F.col("embedding")).otherwise(F.array().cast("array<float>")).alias("g"))
    return b.select("id", O.previous(F.col("id"), F.size("g") > 0, ["label", "session"], "id").alias("previous"))


@query("win6_previous_frame", "WITH b AS (SELECT vec_id AS id, label, vec_id // 100 AS session FROM embeddings) SELECT id, lag(id) OVER (PARTITION BY label, session ORDER BY id) AS previous FROM b")
def previous_of_all(spark, sf_dir):
    """Blank frames become previous ones as well; only those without a buffer don't."""
    b = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.floor(F.col("vec_id") / 100).alias("session"), "embedding")
    return b.select("id", O.previous(F.col("id"), F.size("embedding") > 0, ["label", "session"], "id").alias("previous"))


@query("win8_reading_rank", f"WITH {A.REGIONS_SQL} SELECT frame_id, idx, row_number() OVER (PARTITION BY frame_id ORDER BY y, x, idx) - 1 AS place FROM regions")
def reading_rank(spark, sf_dir):
    """Places from zero within a capture, for boxes that no cut parts."""
    place = F.row_number().over(Window.partitionBy("frame_id").orderBy("y", "x", "idx")) - 1
    return A.regions(spark, sf_dir).select("frame_id", "idx", place.cast("long").alias("place"))


@query("top3_first_and_last_of_ties", f"WITH {A.REGIONS_SQL} SELECT frame_id, arg_min(idx, trust * 100 + idx) AS first_least, arg_max(idx, trust * 100 + idx) AS last_most FROM regions GROUP BY frame_id")
def ties(spark, sf_dir):
    """The least with ties to the first, the most with ties to the last."""
    return A.regions(spark, sf_dir).groupBy("frame_id").agg(F.min(F.struct("trust", "idx"))["idx"].alias("first_least"), F.max(F.struct("trust", "idx"))["idx"].alias("last_most"))


@query("top4_cap_per_group", f"WITH {A.REGIONS_SQL} SELECT frame_id, idx FROM regions QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY idx) <= 6")
def cap_per_group(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("frame_id").orderBy("idx"))
    return A.regions(spark, sf_dir).withColumn("n", n).where("n <= 6").select("frame_id", "idx")


@query("set2_token_sets", r"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS w FROM conversations)
SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) AS shared, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS either FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")  # fmt: skip
def token_sets(spark, sf_dir):
    t = _t(spark, sf_dir, "conversations").select("conv_id", "turn", X.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return t.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_intersect("w", "v")).cast("long").alias("shared"), F.size(F.array_union("w", "v")).cast("long").alias("either"))


# -- pixels -----------------------------------------------------------------------------------------------------------

_GRAY = "list_transform(embedding, lambda x: round((x::DOUBLE + 1) * 127.5)::INT)"


def _gray(spark, sf_dir, *more):
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *more, F.transform("embedding", lambda x: F.round((x.cast("double") + 1) * 127.5).cast("int")).alias("g"))


@query("agg12_pixel_stats", f"WITH b AS (SELECT vec_id AS id, {_GRAY} AS g FROM embeddings) SELECT id, round(m, 4) AS mean, round(q - m * m, 3) AS variance, round(sqrt(q - m * m), 4) AS std FROM (SELECT id, list_avg(g) AS m, list_avg(list_transform(g, lambda x: (x * x)::DOUBLE)) AS q FROM b)")
def pixel_stats(spark, sf_dir):
    g = F.col("g")
    return _gray(spark, sf_dir).select("id", F.round(O.mean(g), 4).alias("mean"), F.round(O.variance(g), 3).alias("variance"), F.round(O.gray_std(g), 4).alias("std"))


@query("agg13_sharpness", f"""WITH b AS (SELECT vec_id AS id, {_GRAY} AS g FROM embeddings),
l AS (SELECT id, list_transform(list_filter(range(9, 56), lambda i: i % 8 BETWEEN 1 AND 6), lambda i: 4 * g[i + 1] - g[i] - g[i + 2] - g[i - 7] - g[i + 9]) AS v FROM b)
SELECT id, round(list_avg(list_transform(v, lambda x: (x * x)::DOUBLE)) - list_avg(v) * list_avg(v), 3) AS sharpness FROM l""")  # fmt: skip
def sharpness(spark, sf_dir):
    """Buffers as 8 by 8 pixels."""
    return _gray(spark, sf_dir).select("id", F.round(O.sharpness(F.col("g"), 8, 8), 3).alias("sharpness"))


@query("gat1_downscale_gray", f"""WITH b AS (SELECT vec_id AS id, {_GRAY} AS g FROM embeddings)
SELECT id, array_to_string(list_transform(range(0, 9), lambda i: (g[((i // 3) * 4 // 3 * 4 + (i % 3) * 4 // 3) * 4 + 3] * 299 + g[((i // 3) * 4 // 3 * 4 + (i % 3) * 4 // 3) * 4 + 2] * 587 + g[((i // 3) * 4 // 3 * 4 + (i % 3) * 4 // 3) * 4 + 1] * 114) // 1000), ',') AS gray FROM b""")
def downscale_gray(spark, sf_dir):
    """Buffers as 4 by 4 pixels of blue, green, red and alpha, made 3 wide."""
    return _gray(spark, sf_dir).select("id", F.array_join(F.transform(O.downscale_gray(F.col("g"), 4, 4, 3), lambda x: x.cast("string")), ",").alias("gray"))


@query("gat3_changed_fraction", f"""WITH b AS (SELECT vec_id AS id, label, {_GRAY} AS g FROM embeddings), o AS (SELECT *, lag(g) OVER (PARTITION BY label, id // 100 ORDER BY id) AS p FROM b)
SELECT id, CASE WHEN p IS NULL THEN 1 ELSE round(list_avg(list_transform(list_zip(g, p), lambda z: CASE WHEN abs(z[1] - z[2]) > 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)), 6) END::DOUBLE AS fraction FROM o""")  # fmt: skip
def changed_fraction(spark, sf_dir):
    """The share of pixels that differ by more than the tolerance; all, where there is nothing to compare with."""
    b = _gray(spark, sf_dir, "label")
    p = O.previous(F.col("g"), F.size("g") > 0, ["label", F.floor(F.col("id") / 100)], "id")
    return b.withColumn("p", p).select("id", F.round(O.changed_fraction(F.col("g"), F.col("p")), 6).alias("fraction"))
