"""Queries over timeline entries, pauses and recordings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import timeline as T
from ..sources import adapters as A
from .registry import query

DAY = 86_400 * T.SECOND
#: 10 January 2024, 00:00 to 24:00.
FROM = 1_704_844_800 * T.SECOND
TO = FROM + DAY

DIGEST_SQL = f"""WITH {A.ENTRIES_SQL},
c AS (SELECT category, activity, greatest(s, {FROM}) AS s, least(e, {TO}) AS e FROM entries WHERE e > {FROM} AND s < {TO}),
d AS (SELECT *, CASE WHEN e > s THEN (e - s) // 1000000 ELSE 0 END AS secs FROM c),
u AS (SELECT category AS g, s, e FROM d WHERE secs > 0 UNION ALL SELECT '*', s, e FROM d WHERE secs > 0),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM u),
i AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
j AS (SELECT g, (max(e) - min(s)) // 1000000 AS secs FROM i GROUP BY g, k),
t AS (SELECT g, sum(secs)::BIGINT AS seconds FROM j GROUP BY g),
l AS (SELECT category, activity, max(secs) AS m FROM d WHERE secs > 0 AND activity <> '' GROUP BY ALL),
a AS (SELECT category, string_agg(activity, ', ' ORDER BY m DESC, activity) AS activities FROM l GROUP BY category),
n AS (SELECT category, count(*) AS entries FROM d GROUP BY category),
o AS (SELECT category, coalesce(seconds, 0)::BIGINT AS seconds, entries, coalesce(activities, '') AS activities FROM n LEFT JOIN t ON g = category LEFT JOIN a USING (category))
SELECT category, seconds, CASE WHEN sum(seconds) OVER () > 0 THEN round(seconds / sum(seconds) OVER () * 1000) / 10 ELSE 0.0 END AS percent, entries, activities,
  coalesce((SELECT seconds FROM t WHERE g = '*'), 0)::BIGINT AS recorded, (sum(seconds) OVER ())::BIGINT AS attributed, {(TO - FROM) // T.SECOND}::BIGINT AS span,
  row_number() OVER (ORDER BY seconds DESC, category) AS rank FROM o"""


def _digest(spark, sf_dir):
    return T.digest(T.overlapping(A.entries(spark, sf_dir, TO), FROM, TO), FROM, TO)


query("agg1_standup_digest", DIGEST_SQL)(_digest)


@query("agg4_sparse_flag", f"SELECT max(recorded) AS recorded, max(span) AS span, max(recorded) * 2 < max(span) AS sparse FROM ({DIGEST_SQL})")
def sparse(spark, sf_dir):
    return _digest(spark, sf_dir).agg(F.max("recorded").alias("recorded"), F.max("span").alias("span")).withColumn("sparse", T.is_sparse(F.col("recorded"), F.col("span")))


def _human(x: str) -> str:
    return f"CASE WHEN {x} < 60 THEN {x} || 's' WHEN {x} < 3600 THEN ({x} // 60) || 'm' WHEN {x} // 60 % 60 = 0 THEN ({x} // 3600) || 'h' ELSE ({x} // 3600) || 'h ' || ({x} // 60 % 60) || 'm' END"


@query(
    "agg5_digest_text",
    f"""SELECT CASE WHEN max(recorded) * 2 < max(span) THEN 'Only ' || {_human("max(recorded)")} || ' of ' || {_human("max(span)")} || ' were recorded — this covers the captured fragments, not the whole period.' || chr(10) || chr(10) ELSE '' END
 || CASE WHEN max(attributed) > max(recorded) THEN {_human("max(attributed)")} || ' of activity across ' || {_human("max(recorded)")} || ' of wall-clock — displays were showing different things at once.' || chr(10) || chr(10) ELSE '' END
 || string_agg('- ' || category || ' — ' || {_human("seconds")} || ' (' || printf('%.1f', percent) || '%, ' || entries || CASE WHEN entries = 1 THEN ' entry)' ELSE ' entries)' END || CASE WHEN activities <> '' THEN ': ' || activities ELSE '' END || chr(10), '' ORDER BY rank) AS text FROM ({DIGEST_SQL})""",
)
def digest_text(spark, sf_dir):
    return T.render(_digest(spark, sf_dir))


@query("agg2_interval_union", f"""WITH {A.ENTRIES_SQL}, u AS (SELECT session_id, s, e FROM entries WHERE e > s),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM u),
i AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
j AS (SELECT session_id, (max(e) - min(s)) // 1000000 AS secs FROM i GROUP BY session_id, k)
SELECT session_id, sum(secs)::BIGINT AS seconds FROM j GROUP BY session_id""")  # fmt: skip
def interval_union(spark, sf_dir):
    return T.covered_seconds(A.entries(spark, sf_dir).where("e > s").select("session_id", "s", "e"), ["session_id"])


@query("fil1_timeline_range", f"WITH {A.ENTRIES_SQL} SELECT id, s, e, category FROM entries WHERE e > {FROM} AND s < {TO}")
def timeline_range(spark, sf_dir):
    return T.overlapping(A.entries(spark, sf_dir, TO), FROM, TO).select("id", "s", "e", "category")


@query("fil2_gap_query", f"WITH {A.PAUSES_SQL} SELECT id, s, e, cause FROM pauses WHERE (e IS NULL OR e > {FROM}) AND s < {TO}")
def gap_query(spark, sf_dir):
    return T.open_overlapping(A.pauses(spark, sf_dir), FROM, TO).select("id", "s", "e", "cause")


@query("fil3_timeline_slice", f"""WITH {A.ENTRIES_SQL}, {A.PAUSES_SQL} SELECT 'entry' AS kind, id::VARCHAR AS id, s, e FROM entries WHERE e > {FROM} AND s < {TO}
UNION ALL SELECT 'gap', id, s, e FROM pauses WHERE (e IS NULL OR e > {FROM}) AND s < {TO}""")  # fmt: skip
def timeline_slice(spark, sf_dir):
    e = T.overlapping(A.entries(spark, sf_dir, TO), FROM, TO).select(F.lit("entry").alias("kind"), F.col("id").cast("string").alias("id"), "s", "e")
    return e.unionByName(T.open_overlapping(A.pauses(spark, sf_dir), FROM, TO).select(F.lit("gap").alias("kind"), "id", "s", "e"))


@query("fil4_default_range", f"WITH {A.ENTRIES_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN (e // {DAY}) * {DAY} ELSE s END AS range_from, e AS range_to FROM entries")
def default_range(spark, sf_dir):
    """A missing start is midnight of the end's day."""
    asked = F.when(F.col("id") % 3 != 0, F.col("s"))
    return A.entries(spark, sf_dir).select("id", F.coalesce(asked, F.floor(F.col("e") / DAY) * DAY).alias("range_from"), F.col("e").alias("range_to"))


@query("fil5_status_filter", f"WITH {A.RECORDINGS_SQL} SELECT id, status FROM recordings WHERE status IN ('recording', 'finalizing')")
def status_filter(spark, sf_dir):
    """The domain status `recording` also takes in what is being finalised."""
    return A.recordings(spark, sf_dir).where(F.col("status").isin("recording", "finalizing")).select("id", "status")


AGE = 880_000_000 * T.SECOND


@query("fil6_age_delete", f"WITH {A.RECORDINGS_SQL} SELECT id, s FROM recordings WHERE s >= {AGE}")
def age_delete(spark, sf_dir):
    return A.recordings(spark, sf_dir).where(F.col("s") >= AGE).select("id", "s")


@query("fil7_provenance", "SELECT id, CASE WHEN x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL THEN x || ',' || y || ',' || w END AS provenance FROM (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN user_id END AS x, CASE WHEN event_id % 3 = 0 THEN event_id END AS y, CASE WHEN event_id % 5 = 0 THEN 7 END AS w FROM events)")
def provenance(spark, sf_dir):
    """All of it or none: one part that is missing makes the whole null. concat is null if any part is."""
    i = F.col("event_id")
    x, y, w = F.when(i % 2 == 0, F.col("user_id")), F.when(i % 3 == 0, i), F.when(i % 5 == 0, F.lit(7))
    return A.table(spark, sf_dir, "events").select(i.alias("id"), F.concat(x.cast("string"), F.lit(","), y.cast("string"), F.lit(","), w.cast("string")).alias("provenance"))


@query("fil12_range_contains", f"WITH {A.ENTRIES_SQL} SELECT id, s >= 0 AND e > s AS valid, {FROM} BETWEEN s AND e AS holds FROM entries")
def range_contains(spark, sf_dir):
    return A.entries(spark, sf_dir).select("id", ((F.col("s") >= 0) & (F.col("e") > F.col("s"))).alias("valid"), F.lit(FROM).between(F.col("s"), F.col("e")).alias("holds"))


@query("src3_upsert_entry", f"WITH {A.ENTRIES_SQL}, r AS (SELECT session_id, category, id, e, row_number() OVER (PARTITION BY session_id, category ORDER BY id DESC) AS n FROM entries) SELECT session_id, category, id, e FROM r WHERE n = 1")
def upsert_entry(spark, sf_dir):
    return T.latest(A.entries(spark, sf_dir), ["session_id", "category"], "id").select("session_id", "category", "id", "e")


@query("src4_upsert_pause", f"WITH {A.PAUSES_SQL} SELECT id, min(s) AS s, max(e) AS e FROM pauses GROUP BY id")
def upsert_pause(spark, sf_dir):
    """An open pause that is recorded again when it closes stays one row, keyed by session and start."""
    p = A.pauses(spark, sf_dir)
    both = p.withColumn("e", F.lit(None).cast("long")).withColumn("v", F.lit(0)).unionByName(p.withColumn("v", F.lit(1)))
    return T.latest(both, ["id"], "v").select("id", "s", "e")


@query("src5_save_recording", f"WITH {A.RECORDINGS_SQL} SELECT id, CASE WHEN id % 10 = 0 THEN 'cancelled' ELSE status END AS status FROM recordings")
def save_recording(spark, sf_dir):
    r = A.recordings(spark, sf_dir).select("id", "status")
    return T.upsert(r, r.where("id % 10 = 0").withColumn("status", F.lit("cancelled")), ["id"])


@query("agg6_entry_count", f"WITH {A.ENTRIES_SQL} SELECT count(*) AS n FROM entries")
def entry_count(spark, sf_dir):
    return A.entries(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query("agg7_storage_used", f"WITH {A.RECORDINGS_SQL} SELECT greatest(coalesce(sum(bytes), 0), 0)::BIGINT AS used FROM recordings")
def storage_used(spark, sf_dir):
    return A.recordings(spark, sf_dir).agg(F.greatest(F.coalesce(F.sum("bytes"), F.lit(0)), F.lit(0)).cast("long").alias("used"))


@query("agg8_recording_total", f"WITH {A.RECORDINGS_SQL} SELECT status, count(*) AS n FROM recordings GROUP BY status")
def recording_total(spark, sf_dir):
    return A.recordings(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("top1_page_recordings", f"WITH {A.RECORDINGS_SQL} SELECT id, s FROM recordings ORDER BY s DESC, id LIMIT 20 OFFSET 40")
def page_recordings(spark, sf_dir):
    return A.recordings(spark, sf_dir).select("id", "s").orderBy(F.col("s").desc(), "id").offset(40).limit(20)


@query("top2_newest_capture", f"WITH {A.RECORDINGS_SQL} SELECT id, display, s FROM (SELECT *, row_number() OVER (PARTITION BY display ORDER BY s DESC, id) AS n FROM recordings) WHERE n <= 3")
def newest_capture(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("display").orderBy(F.col("s").desc(), "id"))
    return A.recordings(spark, sf_dir).withColumn("n", rank).where("n <= 3").select("id", "display", "s")


@query("jn9_request_result", "WITH a AS (SELECT o_orderkey, o_custkey FROM orders) SELECT c_custkey AS request, count(o_orderkey) AS results FROM customer LEFT JOIN a ON o_custkey = c_custkey GROUP BY c_custkey")
def request_result(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"))
    o = A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("request")).agg(F.count(F.lit(1)).alias("results"))
    return c.join(o, "request", "left").select("request", F.coalesce("results", F.lit(0)).cast("long").alias("results"))


@query("stm14_rolling_context", f"""WITH {A.ENTRIES_SQL}, n AS (SELECT session_id, s // {DAY} AS day, id, row_number() OVER (PARTITION BY session_id, s // {DAY} ORDER BY s, id) AS i, category, activity FROM entries)
SELECT b.session_id, b.id, coalesce(string_agg('[chunk ' || a.i || '] ' || a.category || ' — ' || a.activity, chr(10) ORDER BY a.i), '') AS context
FROM n b LEFT JOIN n a ON a.session_id = b.session_id AND a.day = b.day AND a.i < b.i GROUP BY ALL""")  # fmt: skip
def rolling_context(spark, sf_dir):
    """What came before a chunk in its day's run, in order: the beginning of its day's text, which is gathered and
    shuffled once a day and cut for each chunk."""
    by = ["session_id", "day"]
    c = T.rolling_context(A.entries(spark, sf_dir).withColumn("day", F.floor(F.col("s") / DAY)), by, ["s", "id"])
    texts = T.context_texts(c, by).withColumnRenamed("context", "day_text")
    return c.join(texts, by).select("session_id", "id", F.substr("day_text", F.lit(1), F.col("context_chars").cast("int")).alias("context"))
