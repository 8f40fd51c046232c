"""Queries over control events: pauses, resumes, interval changes, outages, restarts and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..sources import adapters as A
from .registry import query

INTERVAL, OTHER = 900 * 1_000_000, 600 * 1_000_000
NOW = 1_704_931_200 * 1_000_000

EVENTS_SQL = f"""ev AS (SELECT user_id AS session_id, user_id % 3 AS display_id, event_id AS id, epoch_us(ts) AS at,
  CASE WHEN event_type = 'error' THEN ['pause', 'resume_if_automatic', 'pause', 'resume', 'interval', 'remove', 'stop'][event_id % 7 + 1] END AS kind,
  CASE event_id % 7 WHEN 0 THEN 'Idle' WHEN 2 THEN 'UserOff' END AS cause, CASE WHEN event_id % 2 = 0 THEN {INTERVAL} ELSE {OTHER} END AS new_interval FROM events)"""

#: The window machine as a recursion over each display's events in order.
MACHINE_SQL = f"""{EVENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id, display_id ORDER BY "at", kind IS NOT NULL, id) AS n FROM ev),
r AS (SELECT session_id, display_id, 0::BIGINT AS n, NULL::BIGINT AS "at", NULL::BIGINT AS start, 0::BIGINT AS seq, 0::BIGINT AS cnt, NULL::BIGINT AS last_at, NULL::VARCHAR AS paused, {INTERVAL}::BIGINT AS ival,
  NULL::VARCHAR AS reason, NULL::BIGINT AS c_start, NULL::BIGINT AS c_cnt, NULL::BIGINT AS c_last FROM (SELECT DISTINCT session_id, display_id FROM ev)
 UNION ALL SELECT session_id, display_id, n, "at", CASE WHEN active THEN CASE WHEN start IS NULL OR closing IS NOT NULL THEN "at" ELSE start END WHEN closing IS NOT NULL THEN NULL ELSE start END,
  CASE WHEN closing IS NOT NULL THEN seq + 1 ELSE seq END, CASE WHEN active THEN CASE WHEN start IS NULL OR closing IS NOT NULL THEN 1 ELSE cnt + 1 END ELSE cnt END,
  CASE WHEN active THEN "at" WHEN closing IS NOT NULL THEN NULL ELSE last_at END,
  CASE WHEN kind = 'pause' THEN CASE WHEN paused IS NULL OR (cause = 'UserOff' AND paused <> 'UserOff') THEN cause ELSE paused END
    WHEN kind IN ('resume', 'stop') OR (kind = 'resume_if_automatic' AND paused <> 'UserOff') THEN NULL ELSE paused END,
  CASE WHEN kind = 'interval' THEN new_interval ELSE ival END, closing, CASE WHEN closing IS NOT NULL THEN start END, CASE WHEN closing IS NOT NULL THEN cnt END, CASE WHEN closing IS NOT NULL THEN last_at END
  FROM (SELECT o.*, r.start, r.seq, r.cnt, r.last_at, r.paused, r.ival, o.kind IS NULL AND r.paused IS NULL AS active,
    CASE WHEN r.start IS NULL THEN NULL WHEN o.kind IS NULL AND r.paused IS NULL AND o."at" - r.start >= r.ival THEN 'Boundary' WHEN o.kind = 'pause' AND r.paused IS NULL THEN 'Paused'
      WHEN o.kind = 'interval' AND o.new_interval <> r.ival THEN 'IntervalChanged' WHEN o.kind = 'remove' THEN 'DisplayRemoved' WHEN o.kind = 'stop' THEN 'Stopped' END AS closing
    FROM r JOIN o ON o.session_id = r.session_id AND o.display_id = r.display_id AND o.n = r.n + 1)),
controlled AS (SELECT session_id, display_id, seq - 1 AS sequence, c_start AS s, greatest("at", c_start) AS e, c_cnt AS sample_count, c_last AS last_sample, reason FROM r WHERE reason IS NOT NULL)"""


def _events(spark, sf_dir):
    """Samples, and errors as control events of their session."""
    e, i = A.table(spark, sf_dir, "events"), F.col("event_id")
    failed = F.col("event_type") == "error"
    kind = F.when(failed, F.element_at(F.array(*map(F.lit, ("pause", "resume_if_automatic", "pause", "resume", "interval", "remove", "stop"))), (i % 7 + 1).cast("int")))
    cause = F.when(i % 7 == 0, "Idle").when(i % 7 == 2, "UserOff")
    d = e.select(F.col("user_id").alias("session_id"), (F.col("user_id") % 3).alias("display_id"), i.alias("id"), A.micros("ts").alias("at"), kind.alias("kind"), cause.alias("cause"), F.when(i % 2 == 0, INTERVAL).otherwise(OTHER).cast("long").alias("interval"))
    return d.where("kind is null"), d.where("kind is not null")


def _windows(spark, sf_dir):
    samples, controls = _events(spark, sf_dir)
    return L.segment_windows(samples, INTERVAL, controls=controls)


@query("stm4_pause", f"WITH RECURSIVE {MACHINE_SQL} SELECT * FROM controlled WHERE reason = 'Paused'")
def pause(spark, sf_dir):
    """A pause closes the open windows; no sample counts until it is lifted."""
    return _windows(spark, sf_dir).where("reason = 'Paused'")


@query("stm5_resume", f"WITH RECURSIVE {MACHINE_SQL} SELECT session_id, display_id, sequence, s, sample_count FROM controlled WHERE sequence > 0")
def resume(spark, sf_dir):
    """After a resume the next sample opens a window of its own: none spans the gap."""
    return _windows(spark, sf_dir).where("sequence > 0").select("session_id", "display_id", "sequence", "s", "sample_count")


@query("stm6_interval_removed_stop", f"WITH RECURSIVE {MACHINE_SQL} SELECT * FROM controlled WHERE reason IN ('IntervalChanged', 'DisplayRemoved', 'Stopped')")
def interval_removed_stop(spark, sf_dir):
    return _windows(spark, sf_dir).where(F.col("reason").isin("IntervalChanged", "DisplayRemoved", "Stopped"))


@query("stm4_pause_ledger", f"""WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY "at", id) AS n FROM ev WHERE kind IS NOT NULL),
r AS (SELECT session_id, 0::BIGINT AS n, NULL::BIGINT AS since, NULL::VARCHAR AS cause, NULL::BIGINT AS s, NULL::BIGINT AS e, NULL::VARCHAR AS was FROM (SELECT DISTINCT session_id FROM o)
 UNION ALL SELECT session_id, n, CASE WHEN kind = 'pause' THEN coalesce(since, "at") WHEN lifts THEN NULL ELSE since END,
  CASE WHEN kind = 'pause' AND (since IS NULL OR (cause = 'UserOff' AND held <> 'UserOff')) THEN cause ELSE held END, CASE WHEN lifts THEN since END, CASE WHEN lifts THEN "at" END, CASE WHEN lifts THEN held END
  FROM (SELECT o.*, r.since, r.cause AS held, r.since IS NOT NULL AND (o.kind IN ('resume', 'stop') OR (o.kind = 'resume_if_automatic' AND r.cause <> 'UserOff')) AS lifts FROM r JOIN o ON o.session_id = r.session_id AND o.n = r.n + 1)),
z AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC) AS back FROM r)
SELECT session_id, s, e, was AS cause FROM r WHERE s IS NOT NULL UNION ALL SELECT session_id, since, NULL, cause FROM z WHERE back = 1 AND since IS NOT NULL""")  # fmt: skip
def pause_ledger(spark, sf_dir):
    return L.pause_ledger(_events(spark, sf_dir)[1])


@query("stm7_clock_skew", f"""WITH {A.SAMPLES_SQL}, f AS (SELECT session_id, display_id, min("at") AS s FROM samples GROUP BY ALL), l AS (SELECT *, CASE WHEN session_id % 2 = 0 THEN s - 5000000 ELSE s + 5000000 END AS now FROM f)
SELECT session_id, display_id, s, greatest(now, s) AS e, now < s AS clock_anomaly FROM l""")  # fmt: skip
def clock_skew(spark, sf_dir):
    """A clock that stands before the start when a window closes gives a window without length, and says so."""
    f = A.samples(spark, sf_dir).groupBy("session_id", "display_id").agg(F.min("at").alias("s"))
    now = F.col("s") + F.when(F.col("session_id") % 2 == 0, -5_000_000).otherwise(5_000_000)
    return f.select("session_id", "display_id", "s", F.greatest(now, F.col("s")).alias("e"), (now < F.col("s")).alias("clock_anomaly"))


@query("stm11_source_outage", """WITH t AS (SELECT user_id % 20 AS session_id, epoch_us(ts) // 3600000000 AS "at", user_id, bool_or(event_type <> 'error') AS produced, bool_and(event_id % 3 <> 0) AS retired FROM events GROUP BY ALL),
g AS (SELECT session_id, "at", bool_or(produced) AS any_frame, bool_and(retired) AS all_retired FROM t GROUP BY ALL)
SELECT session_id, "at", CASE WHEN all_retired THEN 'source_ended' ELSE 'source_occluded' END AS cause FROM g WHERE NOT any_frame""")  # fmt: skip
def source_outage(spark, sf_dir):
    """Hours in which no source of a session gave a frame."""
    e = A.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("session_id"), F.floor(A.micros("ts") / 3_600_000_000).alias("at"), "user_id")
    return L.outages(e.agg(F.max(F.col("event_type") != "error").alias("produced"), F.min(F.col("event_id") % 3 != 0).alias("retired")))


#: A restart on the last day that has samples.
RESTART = 1_706_616_000_000_000


@query("stm19_resume_from_state", f"""WITH {A.SAMPLES_SQL}, s AS (SELECT session_id, display_id, CASE WHEN session_id % 7 <> 0 THEN max("at") END AS updated_at, count(*) % 10 AS sequence FROM samples GROUP BY session_id, display_id),
d AS (SELECT session_id, display_id, max(id % 12) AS disk FROM samples WHERE session_id % 4 <> 1 GROUP BY ALL),
x AS (SELECT *, updated_at IS NOT NULL AND updated_at // 86400000000 = {RESTART} // 86400000000 AS same FROM s LEFT JOIN d USING (session_id, display_id))
SELECT session_id, display_id, CASE WHEN updated_at IS NULL THEN 'fresh' WHEN same THEN 'resumed' ELSE 'new_day' END AS decision, CASE WHEN same AND updated_at < {RESTART} THEN updated_at END AS gap_from,
  CASE WHEN same AND updated_at < {RESTART} THEN {RESTART} END AS gap_to, CASE WHEN same THEN greatest(sequence, coalesce(disk, -1)) + 1 ELSE 0 END::BIGINT AS next_sequence FROM x""")  # fmt: skip
def resume_from_state(spark, sf_dir):
    """A start continues a session of the same day, above the sequences in its state and on disk, and records the gap."""
    s = A.samples(spark, sf_dir)
    states = s.groupBy("session_id", "display_id").agg(F.when(F.col("session_id") % 7 != 0, F.max("at")).alias("updated_at"), (F.count(F.lit(1)) % 10).alias("sequence"))
    return L.resumed(states, s.where("session_id % 4 != 1").select("session_id", "display_id", (F.col("id") % 12).alias("sequence")), RESTART)


@query("mth15_rate_control", f"""WITH RECURSIVE {A.SAMPLES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY "at", id) AS n FROM samples),
r AS (SELECT session_id, n, id, "at", TRUE AS taken, "at" + {INTERVAL} AS due FROM o WHERE n = 1
 UNION ALL SELECT o.session_id, o.n, o.id, o."at", o."at" >= r.due, CASE WHEN o."at" >= r.due THEN CASE WHEN r.due + {INTERVAL} <= o."at" THEN o."at" + {INTERVAL} ELSE r.due + {INTERVAL} END ELSE r.due END
  FROM r JOIN o ON o.session_id = r.session_id AND o.n = r.n + 1)
SELECT session_id AS key, id, "at" FROM r WHERE taken""")  # fmt: skip
def rate_control(spark, sf_dir):
    return L.rate_controlled(A.samples(spark, sf_dir).select(F.col("session_id").alias("key"), "id", "at"), INTERVAL)


@query("agg15_high_water", f"""WITH {A.SEGMENTS_SQL}, h AS (SELECT display_id, max(sequence) AS seen FROM segments GROUP BY display_id)
SELECT display_id, greatest(seen, display_id * 9000) + 1 AS next_sequence FROM h""")  # fmt: skip
def high_water(spark, sf_dir):
    """A seed only ever raises a display's sequence."""
    h = A.segments(spark, sf_dir).groupBy("display_id").agg(F.max("sequence").alias("seen"))
    return h.select("display_id", (F.greatest(F.col("seen"), F.col("display_id") * 9000) + 1).alias("next_sequence"))


@query("jn6_orphan_files", f"WITH {A.SAMPLES_SQL}, {A.SEGMENTS_SQL} SELECT display_id, id AS sequence FROM samples WHERE NOT EXISTS (SELECT 1 FROM segments g WHERE g.display_id = samples.display_id AND g.sequence = samples.id)")
def orphan_files(spark, sf_dir):
    """Files whose (display, sequence) no window has."""
    files = A.samples(spark, sf_dir).select("display_id", F.col("id").alias("sequence"))
    return files.join(A.segments(spark, sf_dir), ["display_id", "sequence"], "left_anti")


@query("jn4_window_samples", f"""WITH {A.SEGMENTS_SQL}, f AS (SELECT l_linenumber::BIGINT AS display_id, l_orderkey AS sequence, count(*) AS files, min(l_partkey) AS first, max(l_partkey) AS last FROM lineitem WHERE l_quantity > 10 GROUP BY ALL)
SELECT g.display_id, g.sequence, coalesce(files, 0) AS files, first, last FROM segments g LEFT JOIN f USING (display_id, sequence)""")  # fmt: skip
def window_samples(spark, sf_dir):
    """The sample files of each window, by (display, sequence): the durable identity; a window may have none left."""
    left = F.col("l_quantity") > 10  # the others' files are gone
    part = F.when(left, F.col("l_partkey"))
    return A.segments(spark, sf_dir, files=F.count_if(left), first=F.min(part), last=F.max(part)).select("display_id", "sequence", "files", "first", "last")


@query("mth9_health", """WITH l AS (SELECT event_id, event_id % 10 = 0 AS stopped, [NULL, 'idle', 'locked', 'display_sleep', 'user_off', 'source_occluded', 'source_ended', 'daemon_restart'][event_id % 8 + 1] AS cause,
  CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) END AS last_at, epoch_us(ts) - 500000000 AS since, epoch_us(ts) + (event_id % 900) * 1000000 AS now FROM events)
SELECT event_id, CASE WHEN stopped THEN 'stopped' WHEN cause = 'user_off' THEN 'off' WHEN cause IN ('source_ended', 'daemon_restart') THEN 'degraded' WHEN cause IS NOT NULL THEN 'paused'
  WHEN (now - greatest(coalesce(last_at, since), since)) // 1000000 < 600 THEN 'healthy' ELSE 'degraded' END AS health FROM l""")  # fmt: skip
def health(spark, sf_dir):
    i, at = F.col("event_id"), A.micros("ts")
    cause = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, A.CAUSES)), (i % 8 + 1).cast("int"))
    h = S.health(i % 10 == 0, cause, at + (i % 900) * 1_000_000, F.when(i % 3 != 0, at), at - 500_000_000, F.lit(300))
    return A.table(spark, sf_dir, "events").select("event_id", h.alias("health"))


TIERS_SQL = f"""{A.SEGMENTS_SQL}, t AS (SELECT *, CASE WHEN n_raw > 0 THEN 'hot' WHEN has_warm THEN 'warm' ELSE 'cold' END AS tier FROM segments)"""


@query("win4_tier", f"WITH {TIERS_SQL} SELECT display_id, sequence, tier FROM t")
def tier(spark, sf_dir):
    return A.segments(spark, sf_dir).select("display_id", "sequence", L.tier().alias("tier"))


@query("win3_shrink_credit", f"WITH {TIERS_SQL} SELECT display_id, sequence, CASE tier WHEN 'hot' THEN raw_bytes - raw_bytes // 10 WHEN 'warm' THEN warm_bytes ELSE 0 END::BIGINT AS credit FROM t")
def shrink_credit(spark, sf_dir):
    """What a step frees: nine tenths of a hot segment's raw bytes, all of a warm one's artifact."""
    return A.segments(spark, sf_dir).withColumn("tier", L.tier()).select("display_id", "sequence", L.credit().alias("credit"))


@query("win5_age", f"WITH {A.SEGMENTS_SQL} SELECT display_id, sequence, greatest(883612800000000 - closed, 0) AS age, greatest(883612800000000 - closed, 0) >= 86400000000 AS old FROM segments")
def age(spark, sf_dir):
    """Age is never below zero, for windows that close in the future; bounds are inclusive."""
    a = L.age(883_612_800_000_000)
    return A.segments(spark, sf_dir).select("display_id", "sequence", a.alias("age"), (a >= 86_400_000_000).alias("old"))


@query("top5_ordered_drain", f"WITH {A.SEGMENTS_SQL} SELECT display_id, sequence, row_number() OVER (PARTITION BY closed // 86400000000 ORDER BY closed, display_id, sequence) AS place FROM segments")
def ordered_drain(spark, sf_dir):
    """A day's windows in the order in which a queue gives them out."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.floor(F.col("closed") / 86_400_000_000)).orderBy("closed", "display_id", "sequence"))
    return A.segments(spark, sf_dir).select("display_id", "sequence", place.cast("long").alias("place"))


@query("win9_failure_streak", """WITH o AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT event_id, CASE WHEN failed THEN sum(failed::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) ELSE 0 END::BIGINT AS streak FROM o""")  # fmt: skip
def streak(spark, sf_dir):
    return L.with_streaks(A.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "streak")


@query("gat7_drop_retry", """WITH a AS (SELECT user_id AS display_id, epoch_us(ts) // 21600000000 AS sequence, ts, event_id, CASE event_type WHEN 'error' THEN 'malformed_frame' WHEN 'purchase' THEN 'write_failed' END AS failure FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY display_id, sequence ORDER BY ts, event_id) AS attempt FROM a WHERE TRUE QUALIFY attempt <= 3),
f AS (SELECT display_id, sequence, min(attempt) FILTER (WHERE failure IS NULL) AS good, max(attempt) AS tried FROM n GROUP BY ALL),
g AS (SELECT *, coalesce(good, tried) AS attempts FROM f)
SELECT g.display_id, g.sequence, g.attempts, good IS NOT NULL AS recovered, n.failure AS reason FROM g JOIN n ON n.display_id = g.display_id AND n.sequence = g.sequence AND n.attempt = CASE WHEN good IS NULL THEN tried ELSE good - 1 END""")  # fmt: skip
def drop_retry(spark, sf_dir):
    """Intervals at risk: three attempts at most; a good one after a bad one recovers the interval, none drops it. The
    reason is that of the last failure."""
    kind = F.when(F.col("event_type") == "error", "malformed_frame").when(F.col("event_type") == "purchase", "write_failed")
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("display_id"), F.floor(A.micros("ts") / 21_600_000_000).alias("sequence"), "ts", "event_id", kind.alias("failure"))
    return L.drops(e, ["display_id", "sequence"], ["ts", "event_id"], 3)


@query("win1_running_max_end", f"""WITH {A.ENTRIES_SQL} SELECT id, max(e) OVER w AS reached, coalesce(s > max(e) OVER w, TRUE) AS new_island FROM entries WINDOW w AS (PARTITION BY session_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_max_end(spark, sf_dir):
    """How far the entries before reach; one that starts beyond begins an island."""
    from pyspark.sql import Window

    reached = F.max("e").over(Window.partitionBy("session_id").orderBy("s", "e", "id").rowsBetween(Window.unboundedPreceding, -1))
    return A.entries(spark, sf_dir).select("id", reached.alias("reached"), F.coalesce(F.col("s") > reached, F.lit(True)).alias("new_island"))


@query("agg3_activity_labels", f"""WITH {A.ENTRIES_SQL}, l AS (SELECT session_id, category, activity, max((e - s) // 1000000) AS m FROM entries WHERE e - s >= 1000000 AND activity <> '' GROUP BY ALL)
SELECT session_id, category, string_agg(activity, ', ' ORDER BY m DESC, activity) AS activities FROM l GROUP BY ALL""")  # fmt: skip
def activity_labels(spark, sf_dir):
    """A label's place is that of its longest single entry; blank ones and entries without a whole second are out."""
    e = A.entries(spark, sf_dir).withColumn("secs", F.floor((F.col("e") - F.col("s")) / 1_000_000))
    return T.activity_labels(e, ["session_id", "category"]).select("session_id", "category", F.array_join("labels", ", ").alias("activities"))


from ..functions import scalars as S  # noqa: E402
from ..operators import timeline as T  # noqa: E402
