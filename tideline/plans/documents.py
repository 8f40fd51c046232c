"""Queries of text rules, over all of documents, pages or conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..sources import adapters as A
from .registry import query


def _docs(spark, sf_dir):
    return A.table(spark, sf_dir, "documents")


def _readings(spark, sf_dir):
    """Readings of a screen: fifty documents in a row make a stream."""
    return _docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 50).alias("stream_id"), F.col("doc_id").alias("seq"), "text")


@query("str1_flatten", r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x1f\x7f-\x{9f}\x{2028}\x{2029}\x{202a}-\x{202e}\x{2066}-\x{2069}]', ' ', 'g')) AS flat FROM documents")
def flatten(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.flatten(F.col("text"))).alias("flat"))


@query("str6_strip_reasoning", "WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a</think>b</think> ' || coalesce(text, '') || ' ' WHEN 1 THEN coalesce(text, '') || '</think>  ' ELSE ' ' || coalesce(text, '') END AS t FROM documents) SELECT doc_id, md5(CASE WHEN trim(string_split(t, '</think>')[-1]) <> '' THEN trim(string_split(t, '</think>')[-1]) ELSE trim(t) END) AS answer FROM r")
def strip_reasoning(spark, sf_dir):
    k, text = F.col("doc_id") % 3, F.coalesce("text", F.lit(""))
    t = F.when(k == 0, F.concat(F.lit("a</think>b</think> "), text, F.lit(" "))).when(k == 1, F.concat(text, F.lit("</think>  "))).otherwise(F.concat(F.lit(" "), text))
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.strip_reasoning(t)).alias("answer"))


@query("str7_extract_json", r"SELECT doc_id, md5(CASE WHEN regexp_matches(t, '(?s)\{.*\}') THEN regexp_extract(t, '(?s)\{.*\}') END) AS json FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'so: {' || coalesce(text, '') || '} ' || source ELSE '} ' || coalesce(text, '') END AS t FROM documents)")
def extract_json(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("so: {"), text, F.lit("} "), "source")).otherwise(F.concat(F.lit("} "), text))
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.extract_json(t)).alias("json"))


@query("str8_parse_chunk_summary", """WITH r AS (SELECT doc_id, doc_id % 4 AS k, source, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CASE WHEN k = 0 AND doc_id % 3 = 0 THEN 'coding' ELSE 'other' END AS category, CASE WHEN k IN (0, 1) THEN coalesce(source, '') ELSE '' END AS app, CASE WHEN k = 0 THEN md5(t) WHEN k = 1 THEN '' ELSE substr(t, 1, 80) END AS activity,
  CASE WHEN k = 0 THEN '' WHEN k = 1 THEN md5(t) ELSE md5(t) END AS detail FROM r""")  # fmt: skip
def parse_chunk_summary(spark, sf_dir):
    """A reply in JSON gives its fields, missing ones empty; others become an activity of their first 80 characters."""
    k, t = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    whole = F.to_json(F.struct(F.when(F.col("doc_id") % 3 == 0, F.lit(" Coding")).otherwise(F.lit("chess")).alias("category"), F.col("source").alias("app"), F.md5(t).alias("activity")))
    part = F.to_json(F.struct(F.col("source").alias("app"), F.md5(t).alias("detail")))
    d = _docs(spark, sf_dir).select("doc_id", F.when(k == 0, F.concat(F.lit("Sure: "), whole)).when(k == 1, part).otherwise(t).alias("t"))
    c = X.chunk_summary(F.col("t"))
    return d.select("doc_id", c["category"].alias("category"), c["app"].alias("app"), c["activity"].alias("activity"), F.when(k > 1, F.md5(c["detail"])).otherwise(c["detail"]).alias("detail"))


@query("str9_category_from", "SELECT event_id, CASE WHEN lower(trim(c)) IN ('coding', 'docs', 'comms', 'browsing', 'meeting', 'idle', 'other') THEN lower(trim(c)) ELSE 'other' END AS category FROM (SELECT event_id, [' Coding', 'DOCS ', 'chess', 'idle', '', 'Meeting', 'comms'][event_id % 7 + 1] AS c FROM events)")
def category_from(spark, sf_dir):
    c = F.element_at(F.array(*map(F.lit, (" Coding", "DOCS ", "chess", "idle", "", "Meeting", "comms"))), (F.col("event_id") % 7 + 1).cast("int"))
    return A.table(spark, sf_dir, "events").select("event_id", X.category_from(c).alias("category"))


@query("str5_text_similarity", r"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS x, len(b.w) AS y FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN x + y = 0 THEN 1 ELSE i / (x + y - i) END, 6) AS similarity FROM p""")  # fmt: skip
def text_similarity(spark, sf_dir):
    """Each turn and the next."""
    t = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return t.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))


@query("agg11_distinct_ratios", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, round(CASE WHEN len(l) > 0 THEN len(list_distinct(l)) / len(l) ELSE 0 END, 6) AS lines, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END, 6) AS tokens FROM l""")  # fmt: skip
def distinct_ratios(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    d = _docs(spark, sf_dir).select("doc_id", X.content_lines(t).alias("l"), X.tokens(t).alias("w"))
    return d.select("doc_id", F.round(X.distinct_ratio(F.col("l")), 6).alias("lines"), F.round(X.distinct_ratio(F.col("w")), 6).alias("tokens"))


@query("str10_content_words", "SELECT doc_id, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: octet_length(encode(w)) > 2 AND w NOT IN ("
       + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "))) AS n FROM documents")
def content_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(X.content_words(F.coalesce("text", F.lit("")))).cast("long").alias("n"))


@query("str14_redact", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text || ' key=' || source || ';b key= AIza, AIza' || lang, 'key=[0-9A-Za-z_-]*', 'key=<redacted>', 'g'), 'AIza[0-9A-Za-z_-]*', '<redacted>', 'g')) AS clean FROM documents""")
def redact(spark, sf_dir):
    t = F.concat("text", F.lit(" key="), "source", F.lit(";b key= AIza, AIza"), "lang")
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.redact(t)).alias("clean"))


@query("str16_uuid_check", "WITH u AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) ELSE h END AS u FROM (SELECT event_id, md5(event_id::VARCHAR) AS h FROM events)) SELECT event_id, regexp_full_match(u, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}') AS ok FROM u")
def uuid_check(spark, sf_dir):
    h = F.md5(F.col("event_id").cast("string"))
    s = lambda a, n: F.substring(h, a, n)
    u = F.when(F.col("event_id") % 2 == 0, F.concat(F.concat_ws("-", s(1, 8), s(9, 4)), F.lit("-4"), F.concat_ws("-", s(14, 3), s(17, 4), s(21, 12)))).otherwise(h)
    return A.table(spark, sf_dir, "events").select("event_id", X.is_uuid4(u).alias("ok"))


@query("str18_slug", "SELECT p_partkey, regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9]', '_', 'g') AS slug FROM part")
def slug(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("str3_line_similarity", "SELECT a.p_partkey, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def line_similarity(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    return p.join(n, "p_partkey").select("p_partkey", F.round(X.line_similarity(F.col("p_name"), F.col("next")), 6).alias("similarity"))


@query("str26_display_name", "SELECT event_id, 'Display ' || (user_id + 1) || ' (' || (640 + user_id * 10) || 'x' || 480 || CASE WHEN user_id = 0 THEN ', Primary' ELSE '' END || ')' AS name FROM events")
def display_name(spark, sf_dir):
    u = F.col("user_id")
    return A.table(spark, sf_dir, "events").select("event_id", R.display_name(u, 640 + u * 10, F.lit(480), u == 0).alias("name"))


@query("txt3_reading_blocks")
def reading_blocks(spark, sf_dir):
    return X.blocks_of(_readings(spark, sf_dir))


@query("txt4_drop_repeats", r"""WITH RECURSIVE d AS (SELECT doc_id // 50 AS stream_id, doc_id AS seq, list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS w FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS n FROM d WHERE len(w) > 0),
r AS (SELECT stream_id, seq, n, w, TRUE AS kept FROM o WHERE n = 1
 UNION ALL SELECT o.stream_id, o.seq, o.n, CASE WHEN fresh THEN o.w ELSE r.w END, fresh FROM r JOIN o ON o.stream_id = r.stream_id AND o.n = r.n + 1,
  LATERAL (SELECT len(list_intersect(o.w, r.w)) / (len(o.w) + len(r.w) - len(list_intersect(o.w, r.w))) <= 0.85 AS fresh))
SELECT stream_id, seq FROM r WHERE kept""")  # fmt: skip
def drop_repeats(spark, sf_dir):
    return X.drop_repeats(_readings(spark, sf_dir))


@query("agg21_session_digest", """SELECT conv_id, 'Session digest (' || count(*) || ' chunks):' || chr(10) || string_agg('- ' || strftime(make_timestamp(turn * 300000000), '%H:%M') || '–' || strftime(make_timestamp(turn * 300000000 + 300000000), '%H:%M') || ': [' || CASE role WHEN 'user' THEN 'comms' ELSE 'other' END || '] ' || role, chr(10) ORDER BY turn) AS digest
FROM conversations GROUP BY conv_id""")  # fmt: skip
def session_digest(spark, sf_dir):
    """A line for each chunk of a session, in order."""
    s, e = F.col("turn") * 300_000_000, F.col("turn") * 300_000_000 + 300_000_000
    c = A.table(spark, sf_dir, "conversations").select(F.col("conv_id"), "turn", s.alias("s"), e.alias("e"), F.when(F.col("role") == "user", "comms").otherwise("other").alias("category"), F.col("role").alias("activity"))
    return X.session_digest(c, "conv_id", "turn")


@query("txt1_coverage")
def coverage(spark, sf_dir):
    """How much of a reading the one before holds already."""
    return X.with_overlaps(_pairs(spark, sf_dir)).select("stream_id", "seq", "coverage")


@query("txt2_merge_scroll")
def merge_scroll(spark, sf_dir):
    """A reading merged into the one before."""
    return X.with_overlaps(_pairs(spark, sf_dir)).select("stream_id", "seq", "merged")


def _pairs(spark, sf_dir):
    """Readings, null ones empty, with the first three lines of the one before above their own, so that they overlap; the
    first of a stream has an empty block."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    text = F.coalesce("text", F.lit(""))
    r = _readings(spark, sf_dir).withColumn("text", text).withColumn("block", F.coalesce(F.lag("text").over(w), F.lit("")))
    tail = F.array_join(F.slice(F.split("block", "\n"), 2, 3), "\n")
    return r.select("stream_id", "seq", "block", F.concat_ws("\n", tail, "text").alias("text"))
