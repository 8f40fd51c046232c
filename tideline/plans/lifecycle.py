"""Queries over samples, windows, pauses, segments and the usage ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..sources import adapters as A
from .registry import query

INTERVAL = 900 * 1_000_000
STOP = 1_706_745_600 * 1_000_000

#: Windows as a recursion over each display's samples in order.
WINDOWS_SQL = f"""{A.SAMPLES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id, display_id ORDER BY "at", id) AS n FROM samples),
r AS (SELECT session_id, display_id, n, "at", "at" AS start, 0::BIGINT AS seq, 1::BIGINT AS cnt, NULL::BIGINT AS c_start, NULL::BIGINT AS c_cnt, NULL::BIGINT AS c_last FROM o WHERE n = 1
 UNION ALL SELECT o.session_id, o.display_id, o.n, o."at", CASE WHEN o."at" - r.start >= {INTERVAL} THEN o."at" ELSE r.start END, CASE WHEN o."at" - r.start >= {INTERVAL} THEN r.seq + 1 ELSE r.seq END,
  CASE WHEN o."at" - r.start >= {INTERVAL} THEN 1 ELSE r.cnt + 1 END, CASE WHEN o."at" - r.start >= {INTERVAL} THEN r.start END, CASE WHEN o."at" - r.start >= {INTERVAL} THEN r.cnt END, CASE WHEN o."at" - r.start >= {INTERVAL} THEN r."at" END
  FROM r JOIN o ON o.session_id = r.session_id AND o.display_id = r.display_id AND o.n = r.n + 1),
z AS (SELECT *, row_number() OVER (PARTITION BY session_id, display_id ORDER BY n DESC) AS back FROM r),
windows AS (SELECT session_id, display_id, seq - 1 AS sequence, c_start AS s, "at" AS e, c_cnt AS sample_count, c_last AS last_sample, 'Boundary' AS reason FROM r WHERE c_start IS NOT NULL
 UNION ALL SELECT session_id, display_id, seq, start, greatest({STOP}, start), cnt, "at", 'Stopped' FROM z WHERE back = 1)"""


def _windows(spark, sf_dir):
    return L.segment_windows(A.samples(spark, sf_dir), INTERVAL, STOP)


@query("stm1_segment_windows", f"WITH RECURSIVE {WINDOWS_SQL} SELECT * FROM windows")
def segment_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


@query("stm2_boundary_sample", f"""WITH RECURSIVE {WINDOWS_SQL} SELECT session_id, display_id, e AS "at", sequence AS file_seq, sequence + 1 AS window_seq FROM windows WHERE reason = 'Boundary'""")
def boundary_sample(spark, sf_dir):
    """The sample that closes a window is filed under it but counted in the next."""
    return _windows(spark, sf_dir).where("reason = 'Boundary'").select("session_id", "display_id", F.col("e").alias("at"), F.col("sequence").alias("file_seq"), (F.col("sequence") + 1).alias("window_seq"))


@query("stm3_sequence_numbers", f"WITH RECURSIVE {WINDOWS_SQL} SELECT display_id, max(sequence) AS high, count(*) AS n FROM windows GROUP BY display_id")
def sequence_numbers(spark, sf_dir):
    return _windows(spark, sf_dir).groupBy("display_id").agg(F.max("sequence").alias("high"), F.count(F.lit(1)).alias("n"))


LIMIT = 8 * 3600 * 1_000_000


@query("stm8_session_limit", f"""WITH {A.SAMPLES_SQL} SELECT session_id, min("at") AS s, CASE WHEN session_id % 3 = 0 THEN max("at") ELSE least(min("at") + {LIMIT}, max("at")) END AS e FROM samples GROUP BY session_id""")
def session_limit(spark, sf_dir):
    """A session stops after eight hours at the latest; a daemon (here every third) has no limit."""
    last = F.max("at")
    e = F.when(F.col("session_id") % 3 == 0, last).otherwise(F.least(F.min("at") + LIMIT, last))
    return A.samples(spark, sf_dir).groupBy("session_id").agg(F.min("at").alias("s"), e.alias("e"))


@query("stm9_unselected_display", f"""WITH {A.SAMPLES_SQL}, selected AS (SELECT DISTINCT user_id AS session_id, unnest(CASE WHEN user_id % 4 = 0 THEN [0, 1, 2] ELSE [0, 2] END) AS display_id FROM events)
SELECT session_id, display_id, count(*) AS n FROM samples JOIN selected USING (session_id, display_id) GROUP BY ALL""")  # fmt: skip
def unselected_display(spark, sf_dir):
    """Samples of displays that their session has selected; others are ignored."""
    s = A.samples(spark, sf_dir)
    displays = F.when(F.col("session_id") % 4 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(2)))
    selected = s.select("session_id").distinct().select("session_id", F.explode(displays.cast("array<bigint>")).alias("display_id"))
    return s.join(selected, ["session_id", "display_id"], "left_semi").groupBy("session_id", "display_id").agg(F.count(F.lit(1)).alias("n"))


POLLS_SQL = f"""{A.SAMPLES_SQL}, polls AS (SELECT session_id, id, "at", CASE WHEN id % 11 <> 0 THEN (id * 31) % 600 END AS idle_for,
  coalesce(("at" - lag("at") OVER (PARTITION BY session_id ORDER BY "at", id)) // 1000000, 0) AS since, row_number() OVER (PARTITION BY session_id ORDER BY "at", id) AS n FROM samples)"""


@query("stm10_idle_hysteresis", f"""WITH RECURSIVE {POLLS_SQL},
r AS (SELECT session_id, 0::BIGINT AS n, NULL::BIGINT AS id, FALSE AS state, NULL::BOOLEAN AS seen, 0::BIGINT AS held, FALSE AS turned FROM (SELECT DISTINCT session_id FROM polls)
 UNION ALL SELECT session_id, n, id, CASE WHEN turns THEN wants ELSE state END, CASE WHEN wants = state OR turns THEN NULL ELSE wants END, CASE WHEN wants = state THEN held WHEN seen IS DISTINCT FROM wants THEN 0 ELSE held + since END, turns
  FROM (SELECT x.*, wants <> state AND seen IS NOT DISTINCT FROM wants AND held + since >= 30 AS turns FROM
   (SELECT p.session_id, p.n, p.id, p.since, coalesce(p.idle_for >= 300, FALSE) AS wants, r.state, r.seen, r.held FROM r JOIN polls p ON p.session_id = r.session_id AND p.n = r.n + 1) x))
SELECT session_id, id, CASE WHEN state THEN 'went_idle' ELSE 'became_active' END AS transition FROM r WHERE turned""")  # fmt: skip
def idle(spark, sf_dir):
    s = A.samples(spark, sf_dir)
    since = F.coalesce(F.floor((F.col("at") - F.lag("at").over(Window.partitionBy("session_id").orderBy("at", "id"))) / 1_000_000), F.lit(0))
    polls = s.select("session_id", "id", "at", F.when(F.col("id") % 11 != 0, (F.col("id") * 31) % 600).alias("idle_for"), since.alias("since_last"))
    return L.idle_transitions(polls, 300, 30)


@query("stm12_source_retirement", "WITH f AS (SELECT user_id, min(ts) AS at FROM events WHERE event_type = 'error' AND event_id % 5 = 0 GROUP BY user_id) SELECT e.event_id FROM events e LEFT JOIN f USING (user_id) WHERE f.at IS NULL OR e.ts < f.at")
def source_retirement(spark, sf_dir):
    """After its first failure that can't be retried a source gives no more samples."""
    e = A.table(spark, sf_dir, "events")
    first = e.where("event_type = 'error' and event_id % 5 = 0").groupBy("user_id").agg(F.min("ts").alias("at"))
    return e.join(first, "user_id", "left").where("at is null or ts < at").select("event_id")


DUE = 1_704_844_800 * 1_000_000


@query("stm13_summary_queue", f"""WITH RECURSIVE {WINDOWS_SQL}, q AS (SELECT *, sequence % 3 AS failures FROM windows WHERE sample_count > 1 AND e <= {DUE})
SELECT session_id, display_id, sequence, row_number() OVER (PARTITION BY session_id ORDER BY s, display_id, sequence) AS place FROM q WHERE failures = 0 OR e + least(30 * pow(2, least(failures, 6)), 1800)::BIGINT * 60000000 <= {DUE}""")
def summary_queue(spark, sf_dir):
    """The work that is due at a moment, in time order: what failed waits until its back-off (here in minutes) is over
    and keeps its place; windows without anything to tell settle silently."""
    failures = F.col("sequence") % 3
    ready = (failures == 0) | (F.col("e") + S.backoff_seconds(failures) * 60_000_000 <= DUE)
    w = _windows(spark, sf_dir).where("sample_count > 1").where(F.col("e") <= DUE).where(ready)
    return w.select("session_id", "display_id", "sequence", F.row_number().over(Window.partitionBy("session_id").orderBy("s", "display_id", "sequence")).cast("long").alias("place"))


@query("stm15_token_bucket", f"""WITH RECURSIVE {A.SAMPLES_SQL}, c AS (SELECT session_id AS key, id, "at" // 20000 AS "at", row_number() OVER (PARTITION BY session_id ORDER BY "at" // 20000, id) AS n FROM samples),
r AS (SELECT key, id, n, "at", TRUE AS allowed, 9.0::DOUBLE AS tokens, 0.0::DOUBLE AS wait FROM c WHERE n = 1
 UNION ALL SELECT key, id, n, "at", have >= 1, CASE WHEN have >= 1 THEN have - 1 ELSE have END, CASE WHEN have >= 1 THEN 0.0 ELSE (1.0 - have) / (10.0::DOUBLE / 60.0::DOUBLE) END
  FROM (SELECT c.*, least(10.0::DOUBLE, r.tokens + greatest(c."at" - r."at", 0) / 1000000.0::DOUBLE * (10.0::DOUBLE / 60.0::DOUBLE)) AS have FROM r JOIN c ON c.key = r.key AND c.n = r.n + 1))
SELECT key, id, allowed, wait AS retry_after FROM r""")  # fmt: skip
def bucket(spark, sf_dir):
    calls = A.samples(spark, sf_dir).select(F.col("session_id").alias("key"), "id", (F.floor(F.col("at") / 20_000)).alias("at"))
    return L.token_bucket(calls, 10.0, 60.0)


@query("stm16_liveness", f"""WITH RECURSIVE {WINDOWS_SQL}, l AS (SELECT session_id, max(last_sample) AS last_at, min(s) AS since FROM windows GROUP BY session_id)
SELECT session_id, CASE WHEN session_id % 10 = 0 THEN 'stopped' WHEN session_id % 10 = 1 THEN 'off' WHEN session_id % 10 IN (2, 3) THEN 'degraded' WHEN session_id % 10 IN (4, 5) THEN 'paused'
  WHEN {STOP} - greatest(last_at, since) < {2 * 3600 * 24 * 1_000_000} THEN 'healthy' ELSE 'degraded' END AS health FROM l""")  # fmt: skip
def liveness(spark, sf_dir):
    """Intent explains silence (stopped, user off, source ended, restart, idle, locked); else evidence decides."""
    w = _windows(spark, sf_dir).groupBy("session_id").agg(F.max("last_sample").alias("last_at"), F.min("s").alias("since"))
    k = F.col("session_id") % 10
    cause = F.when(k == 1, "user_off").when(k == 2, "source_ended").when(k == 3, "daemon_restart").when(k == 4, "idle").when(k == 5, "locked")
    return w.select("session_id", S.health(k == 0, cause, F.lit(STOP), F.col("last_at"), F.col("since"), F.lit(3600 * 24)).alias("health"))


@query("src9_max_sequence", f"WITH {A.SEGMENTS_SQL} SELECT display_id, max(sequence) AS high FROM segments GROUP BY display_id")
def max_sequence(spark, sf_dir):
    return A.segments(spark, sf_dir).groupBy("display_id").agg(F.max("sequence").alias("high"))


@query("src10_orphan_adoption", f"""WITH RECURSIVE {WINDOWS_SQL}, f AS (SELECT session_id, display_id, "at", (row_number() OVER (PARTITION BY session_id, display_id ORDER BY "at", id) - 1) // 3 AS sequence FROM samples)
SELECT session_id, display_id, sequence, min("at") AS s, max("at") AS e, count(*) AS sample_count, 'Stopped' AS reason FROM f
WHERE NOT EXISTS (SELECT 1 FROM windows w WHERE w.session_id = f.session_id AND w.display_id = f.display_id AND w.sequence = f.sequence AND w.sample_count > 1) GROUP BY ALL""")  # fmt: skip
def orphan_adoption(spark, sf_dir):
    """Files, three to a sequence here, whose (display, sequence) no window owns become closed windows of their own."""
    owned = _windows(spark, sf_dir).where("sample_count > 1").select("session_id", "display_id", "sequence")
    n = F.row_number().over(Window.partitionBy("session_id", "display_id").orderBy("at", "id")) - 1
    files = A.samples(spark, sf_dir).withColumn("sequence", F.floor(n / 3))
    left = files.join(owned, ["session_id", "display_id", "sequence"], "left_anti")
    return left.groupBy("session_id", "display_id", "sequence").agg(F.min("at").alias("s"), F.max("at").alias("e"), F.count(F.lit(1)).alias("sample_count"), F.lit("Stopped").alias("reason"))


GIVE_UP = 10


@query("src14_failure_streak", f"""WITH o AS (SELECT event_id, ts, user_id, event_type NOT IN ('view', 'click') AS failed, count(*) FILTER (WHERE event_type IN ('view', 'click')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
n AS (SELECT *, CASE WHEN failed THEN sum(failed::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) ELSE 0 END AS streak FROM o)
SELECT event_id, streak::BIGINT AS streak, CASE WHEN streak = 0 THEN 'available' WHEN streak >= {GIVE_UP} THEN 'ended' ELSE 'occluded' END AS state FROM n""")  # fmt: skip
def failure_streak(spark, sf_dir):
    """Failures in a row: some leave a source occluded, ten end it; a success resets."""
    e = L.with_streaks(A.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ~F.col("event_type").isin("view", "click"))
    streak = F.col("streak")
    return e.select("event_id", "streak", F.when(streak == 0, "available").when(streak >= GIVE_UP, "ended").otherwise("occluded").alias("state"))


NOW, HOT, WARM, BUDGET = 960_000_000_000_000, 40_000_000_000_000, 80_000_000_000_000, 300_000_000


@query("win2_retention_plan", f"""WITH {A.SEGMENTS_SQL},
t AS (SELECT *, CASE WHEN n_raw > 0 THEN 'hot' WHEN has_warm THEN 'warm' ELSE 'cold' END AS tier, greatest({NOW} - closed, 0) AS age FROM segments),
c AS (SELECT *, CASE tier WHEN 'hot' THEN raw_bytes - raw_bytes // 10 WHEN 'warm' THEN warm_bytes ELSE 0 END AS credit,
  summarized AND ((tier = 'hot' AND age >= {HOT}) OR (tier = 'warm' AND age >= {WARM})) AS aged FROM t),
d AS (SELECT *, summarized AND NOT aged AND tier <> 'cold' AS op FROM c),
b AS (SELECT *, coalesce(sum(CASE WHEN op THEN credit ELSE 0 END) OVER (ORDER BY tier, closed, display_id, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(raw_bytes + warm_bytes) OVER () - coalesce(sum(credit) FILTER (WHERE aged) OVER (), 0) AS left_over FROM d),
g AS (SELECT *, aged OR (op AND left_over - before > {BUDGET}) AS goes FROM b)
SELECT display_id, sequence, CASE WHEN goes AND tier = 'hot' THEN 'shrink' WHEN goes THEN 'drop_warm' WHEN NOT summarized THEN 'keep:not_summarized' WHEN tier = 'cold' THEN 'keep:nothing_to_reclaim' ELSE 'keep:within_budget' END AS action FROM g""")  # fmt: skip
def retention_plan(spark, sf_dir):
    return L.retention_plan(A.segments(spark, sf_dir), NOW, HOT, WARM, BUDGET)


@query("jn5_segment_ledger", f"""WITH {A.SEGMENTS_SQL}, x AS (SELECT l_orderkey AS sequence, l_linenumber::BIGINT AS display_id, sum(l_quantity::BIGINT)::BIGINT AS bytes FROM lineitem GROUP BY ALL)
SELECT g.display_id, g.sequence, coalesce(bytes, 0)::BIGINT AS bytes, g.sequence IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS settled FROM segments g LEFT JOIN x USING (display_id, sequence)""")  # fmt: skip
def segment_ledger(spark, sf_dir):
    """Closed windows with the bytes of their samples and whether they were summarised."""
    done = A.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("sequence"), F.lit(True).alias("settled")).distinct()
    g = A.segments(spark, sf_dir, bytes=F.sum(F.col("l_quantity").cast("long")))
    return g.join(done, "sequence", "left").select("display_id", "sequence", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("settled", F.lit(False)).alias("settled"))


#: Dollars for a million tokens: model, input, long input (over 200,000 tokens), output, long output.
PRICES = (
    ("gemini-3-flash-preview", 0.5, 0.5, 3.0, 3.0),
    ("gemini-3.1-flash-lite", 0.25, 0.25, 1.5, 1.5),
    ("gemini-3.5-flash-lite", 0.3, 0.3, 2.5, 2.5),
    ("gemini-3.6-flash", 0.75, 0.75, 3.75, 3.75),
    ("gemini-3.8-flash", 0.75, 0.75, 3.75, 3.75),
    ("gemini-3.1-pro-preview", 2.0, 4.0, 12.0, 18.0),
)
_PRICES_SQL = "prices AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for m, a, b, c, d in PRICES) + ") AS v(model, pin, pin_long, pout, pout_long))"
PRICED_SQL = f"""{A.USAGE_SQL}, {_PRICES_SQL},
priced AS (SELECT burst, u.model, tokens_in, round((tokens_in * CASE WHEN tokens_in > 200000 THEN coalesce(p.pin_long, q.pin_long) ELSE coalesce(p.pin, q.pin) END
  + (tokens_out + thinking) * CASE WHEN tokens_in > 200000 THEN coalesce(p.pout_long, q.pout_long) ELSE coalesce(p.pout, q.pout) END) / 1000000, 6) AS usd
  FROM usage u LEFT JOIN prices p ON p.model = u.model LEFT JOIN prices q ON q.model = u.served)"""


def _priced(spark, sf_dir):
    """The price of each call by its model, else by the model that served it; unlisted ones have none."""
    prices = spark.createDataFrame(list(PRICES), "model string, pin double, pin_long double, pout double, pout_long double")  # the price list
    served = prices.select(F.col("model").alias("served"), *[F.col(c).alias(f"s_{c}") for c in prices.columns[1:]])
    u = A.usage(spark, sf_dir).join(F.broadcast(prices), "model", "left").join(F.broadcast(served), "served", "left")
    rate = lambda c: F.when(F.col("tokens_in") > 200_000, F.coalesce(f"{c}_long", f"s_{c}_long")).otherwise(F.coalesce(c, f"s_{c}"))
    usd = F.round((F.col("tokens_in") * rate("pin") + (F.col("tokens_out") + F.col("thinking")) * rate("pout")) / 1_000_000, 6)
    return u.select("burst", "model", "tokens_in", usd.alias("usd"))


@query("mth1_price_usd", f"WITH {PRICED_SQL} SELECT model, tokens_in, max(usd) AS usd, count(usd) AS priced, count(*) AS calls FROM priced GROUP BY ALL")
def price_usd(spark, sf_dir):
    return _priced(spark, sf_dir).groupBy("model", "tokens_in").agg(F.max("usd").alias("usd"), F.count("usd").alias("priced"), F.count(F.lit(1)).alias("calls"))


@query("agg9_burst_spend", f"WITH {PRICED_SQL} SELECT burst, round(sum(coalesce(usd, 0)), 4) AS spent FROM priced WHERE burst IS NOT NULL GROUP BY burst")
def burst_spend(spark, sf_dir):
    return _priced(spark, sf_dir).where("burst is not null").groupBy("burst").agg(F.round(F.sum(F.coalesce("usd", F.lit(0.0))), 4).alias("spent"))


@query("agg10_spend_guard", f"""WITH {PRICED_SQL}, g AS (SELECT burst, sum(coalesce(usd, 0)) AS spent FROM priced GROUP BY burst)
SELECT burst, CASE WHEN burst IS NULL THEN TRUE WHEN substr(burst, 2)::INT % 3 = 0 THEN FALSE ELSE spent < 90 * (substr(burst, 2)::INT % 4) END AS allowed FROM g""")  # fmt: skip
def spend_guard(spark, sf_dir):
    """No burst: allowed. A burst without a cap, or at it: refused."""
    g = _priced(spark, sf_dir).groupBy("burst").agg(F.sum(F.coalesce("usd", F.lit(0.0))).alias("spent"))
    n = F.substring("burst", 2, 9).cast("int")
    cap = F.when(n % 3 != 0, 90.0 * (n % 4))
    return g.select("burst", F.when(F.col("burst").isNull(), True).otherwise(F.coalesce(F.col("spent") < cap, F.lit(False))).alias("allowed"))


from ..functions import scalars as S  # noqa: E402
