"""Windows of samples, idleness, token buckets and the retention plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold

WINDOWS = "session_id long, display_id long, sequence long, s long, e long, sample_count long, last_sample long, reason string"

#: Control events and the reason with which they close a window. A pause of any cause but these is automatic.
CONTROLS = {"pause": "Paused", "resume": None, "resume_if_automatic": None, "interval": "IntervalChanged", "remove": "DisplayRemoved", "stop": "Stopped"}
DELIBERATE = ("UserOff", "SourceEnded")


class OpenWindow:
    """The open window of one display. It opens on its first sample, not on a clock boundary; a sample that comes
    `interval` after the start closes it and counts in the next. A clock that runs backwards never closes one.
    While paused no sample counts; after it the next sample opens a window."""

    def __init__(self, interval: int, start: int | None = None, count: int = 0, last: int | None = None, sequence: int = 0, paused: str | None = None):
        self.interval, self.start, self.count, self.last, self.sequence, self.paused = interval, start, count, last, sequence, paused

    def sample(self, at: int) -> tuple | None:
        if self.paused is not None:
            return None
        closed = None
        if self.start is None:
            self.start, self.count = at, 0
        elif at - self.start >= self.interval:
            closed = self.close(at, "Boundary")
            self.start, self.count = at, 0
        self.count, self.last = self.count + 1, at
        return closed

    def control(self, at: int, kind: str, cause: str | None = None, interval: int | None = None) -> tuple | None:
        """A control event; the window that it closes, if any."""
        reason = CONTROLS[kind]
        if kind == "pause":
            if self.paused is not None:
                self.paused = cause if cause in DELIBERATE and self.paused not in DELIBERATE else self.paused
                return None
            self.paused = cause
        elif kind == "interval":
            if interval == self.interval:
                return None
            self.interval = interval
        elif kind in ("resume", "stop") or kind == "resume_if_automatic" and self.paused not in DELIBERATE:
            self.paused = None
        return self.close(at, reason) if reason and self.start is not None else None

    def close(self, at: int, reason: str) -> tuple:
        """(sequence, s, e, sample_count, last_sample, reason); an end before the start is the start."""
        row = (self.sequence, self.start, max(at, self.start), self.count, self.last if self.count else None, reason)
        self.sequence, self.start, self.last = self.sequence + 1, None, None
        return row


def with_controls(samples: DataFrame, controls: DataFrame) -> DataFrame:
    """The samples and each display's control events, told by kind."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("cause", "string"), ("interval", "long"))]
    own = samples.select("session_id", "display_id", "id", "at", *none)
    shown = samples.select("session_id", "display_id").distinct()
    c = controls.withColumnRenamed("display_id", "only").join(shown, "session_id").where("only is null or only = display_id")
    return own.unionByName(c.select("session_id", "display_id", "id", "at", "kind", "cause", F.col("interval").cast("long").alias("interval")))


class _Windows:
    """The windows of one display, as ordered_fold asks for them."""

    def __init__(self, interval: int, stop_at: int | None):
        self.window, self.stop_at = OpenWindow(interval), stop_at

    def step(self, id_, at, kind=None, cause=None, interval=None, late=None):
        closed = self.window.sample(at) if kind is None else self.window.control(at, kind, cause, interval)
        return [closed] if closed else []

    def end(self):
        return [self.window.close(self.stop_at, "Stopped")] if self.stop_at is not None and self.window.start is not None else []


def segment_windows(samples: DataFrame, interval: int, stop_at: int | None = None, controls: DataFrame | None = None) -> DataFrame:
    """The closed windows of every session's displays, in the order of their samples; at stop_at the open ones close
    as Stopped. samples: (session_id, display_id, id, at), times in microseconds. controls: (session_id, display_id, id,
    at, kind, cause, interval), kinds as in CONTROLS, display_id null for all displays; at equal times samples come first."""
    events = samples.select("session_id", "display_id", "id", "at") if controls is None else with_controls(samples, controls).withColumn("late", F.col("kind").isNotNull())
    return ordered_fold(events, ["session_id", "display_id"], ["at", *(["late"] if controls is not None else []), "id"], lambda: _Windows(interval, stop_at), WINDOWS)


class _Pauses:
    """A session's pauses: one opens when nothing is paused, a deliberate cause replaces an automatic one, and what lifts
    it closes it."""

    def __init__(self):
        self.since = self.cause = None

    def step(self, id_, at, kind, cause):
        if kind == "pause":
            if self.since is None:
                self.since, self.cause = at, cause
            elif cause in DELIBERATE and self.cause not in DELIBERATE:
                self.cause = cause
        elif self.since is not None and (kind in ("resume", "stop") or kind == "resume_if_automatic" and self.cause not in DELIBERATE):
            closed, self.since = (self.since, at, self.cause), None
            return [closed]
        return []

    def end(self):
        return [(self.since, None, self.cause)] if self.since is not None else []


def pause_ledger(controls: DataFrame) -> DataFrame:
    """(session_id, s, e, cause): the recorded pauses of each session; one that nothing lifted has no end."""
    return ordered_fold(controls.select("session_id", "id", "at", "kind", "cause"), ["session_id"], ["at", "id"], _Pauses, "session_id long, s long, e long, cause string")


def outages(ticks: DataFrame) -> DataFrame:
    """(session_id, at, cause) of the ticks at which no source of a session gave a frame: source_ended when all are
    retired, else source_occluded. ticks: (session_id, at, produced boolean, retired boolean), a row for each source."""
    t = ticks.groupBy("session_id", "at").agg(F.max("produced").alias("any"), F.min("retired").alias("all"))
    return t.where("not any").select("session_id", "at", F.when(F.col("all"), "source_ended").otherwise("source_occluded").alias("cause"))


class _Idle:
    def __init__(self, threshold: int, dwell: int):
        self.threshold, self.dwell, self.state, self.seen, self.held = threshold, dwell, False, None, 0

    def step(self, id_, at, idle_for, since_last):
        wants = idle_for is not None and idle_for >= self.threshold
        if wants == self.state:
            self.seen = None
        elif self.seen != wants:
            self.seen, self.held = wants, 0
        else:
            self.held += since_last
            if self.held >= self.dwell:
                self.state, self.seen = wants, None
                return [(id_, "went_idle" if wants else "became_active")]
        return []

    def end(self):
        return []


def idle_transitions(polls: DataFrame, threshold: int, dwell: int) -> DataFrame:
    """(session_id, id, transition): changes between active and idle. polls: (session_id, id, at, idle_for, since_last).

    Idle is idle_for >= threshold, unknown is active. The other state must last for `dwell` of poll time, counted from
    the poll after the one that first showed it."""
    return ordered_fold(polls.select("session_id", "id", "at", "idle_for", "since_last"), ["session_id"], ["at", "id"], lambda: _Idle(threshold, dwell), "session_id long, id long, transition string")


class _Bucket:
    def __init__(self, capacity: float, rate: float):
        self.capacity, self.rate, self.tokens, self.last = capacity, rate, capacity, None

    def step(self, id_, at):
        if self.last is not None:
            self.tokens = min(self.capacity, self.tokens + max(0, at - self.last) / 1e6 * self.rate)
        self.last = at
        allowed = self.tokens >= 1.0
        wait = 0.0 if allowed else (1.0 - self.tokens) / self.rate
        self.tokens -= allowed
        return [(id_, allowed, wait)]

    def end(self):
        return []


def token_bucket(calls: DataFrame, capacity: float, window: float) -> DataFrame:
    """(key, id, allowed, retry_after): calls against a bucket for each key that refills over `window` seconds.
    calls: (key, id, at), at in microseconds."""
    return ordered_fold(calls.select("key", "id", "at"), ["key"], ["at", "id"], lambda: _Bucket(capacity, capacity / window), "key long, id long, allowed boolean, retry_after double")


class _Rate:
    """Captures at a fixed rate: one is due at the first tick at or after the deadline, which then moves on by an
    interval, or to an interval from now where that has passed."""

    def __init__(self, interval: int):
        self.interval, self.next = interval, None

    def step(self, id_, at):
        if self.next is None:
            self.next = at
        if at < self.next:
            return []
        self.next += self.interval
        if self.next <= at:
            self.next = at + self.interval
        return [(id_, at)]

    def end(self):
        return []


def rate_controlled(ticks: DataFrame, interval: int) -> DataFrame:
    """(key, id, at) of the ticks (key, id, at) that a rate of one each interval captures."""
    return ordered_fold(ticks.select("key", "id", "at"), ["key"], ["at", "id"], lambda: _Rate(interval), "key long, id long, at long")


def resumed(states: DataFrame, on_disk: DataFrame, now: int) -> DataFrame:
    """What a start at `now` does with each saved session: session_id, decision (fresh without a state, resumed on the
    same UTC day, else new_day), gap_from and gap_to of the interruption to record (cause daemon_restart), and for each
    display next_sequence, above both the state's and the files'. states: (session_id, display_id, updated_at, sequence);
    on_disk: (session_id, display_id, sequence)."""
    day = lambda c: F.floor(c / 86_400_000_000)
    files = on_disk.groupBy("session_id", "display_id").agg(F.max("sequence").alias("disk"))
    s = states.join(files, ["session_id", "display_id"], "left")
    same = F.col("updated_at").isNotNull() & (day(F.col("updated_at")) == day(F.lit(now)))
    decision = F.when(F.col("updated_at").isNull(), "fresh").when(same, "resumed").otherwise("new_day")
    gap = same & (F.col("updated_at") < now)
    return s.select(
        "session_id", "display_id", decision.alias("decision"), F.when(gap, F.col("updated_at")).alias("gap_from"), F.when(gap, F.lit(now)).alias("gap_to"),
        F.when(same, F.greatest(F.col("sequence"), F.coalesce("disk", F.lit(-1))) + 1).otherwise(F.lit(0)).cast("long").alias("next_sequence"),
    )


def with_streaks(rows: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """rows with streak: the failures in a row up to each one; a success resets it to zero."""
    w = Window.partitionBy(key).orderBy(*order)
    good = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    r = rows.withColumn("__good", good)
    run = F.sum(F.when(failed, 1).otherwise(0)).over(Window.partitionBy(key, "__good").orderBy(*order))
    return r.withColumn("streak", F.when(failed, run).otherwise(F.lit(0)).cast("long")).drop("__good")


def drops(attempts: DataFrame, interval: list[str], order: list[str], most: int) -> DataFrame:
    """(interval, attempts, recovered, reason) of the intervals whose first attempt failed: of at most so many attempts
    (interval, order, failure), tried until one is good; reason is the last failure."""
    n = F.row_number().over(Window.partitionBy(*interval).orderBy(*order))
    a = attempts.withColumn("__n", n).where(F.col("__n") <= most)
    tries = a.groupBy(*interval).agg(F.sort_array(F.collect_list(F.struct(F.col("__n").alias("n"), "failure"))).alias("t"))  # `most` at most
    good = F.array_min(F.transform(F.filter("t", lambda x: x["failure"].isNull()), lambda x: x["n"]))
    done = F.coalesce(good, F.size("t"))
    last = F.element_at("t", F.when(good.isNull(), done).otherwise(F.greatest(good - 1, F.lit(1))))["failure"]
    return tries.where(F.coalesce(good, F.lit(0)) != 1).select(*interval, done.cast("long").alias("attempts"), good.isNotNull().alias("recovered"), last.alias("reason"))


def tier() -> Column:
    """Hot while raw files are there, then warm while an artifact is, else cold."""
    return F.when(F.col("n_raw") > 0, "hot").when(F.col("has_warm"), "warm").otherwise("cold")


def age(now: int) -> Column:
    return F.greatest(F.lit(now) - F.col("closed"), F.lit(0))


def credit() -> Column:
    """Bytes that the next step for a segment of a tier frees; shrinking keeps a tenth."""
    return F.when(F.col("tier") == "hot", F.col("raw_bytes") - F.floor(F.col("raw_bytes") / 10)).when(F.col("tier") == "warm", F.col("warm_bytes")).otherwise(F.lit(0)).cast("long")


def retention_plan(segments: DataFrame, now: int, hot_age: int, warm_age: int, budget: int) -> DataFrame:
    """(display_id, sequence, action): shrink, drop_warm, or keep with its reason.

    By age first; if what is left is still over the budget, summarised hot segments and then warm ones go, oldest
    first, while it is over. As each step frees no less than nothing, a segment goes iff the bytes freed before it
    don't suffice: a running sum. The sum is taken in two steps, over hours and within them, so that no window holds
    more than an hour and tier of segments."""
    s = segments.withColumn("tier", tier()).withColumn("age", age(now))
    aged = F.col("summarized") & (((F.col("tier") == "hot") & (F.col("age") >= hot_age)) | ((F.col("tier") == "warm") & (F.col("age") >= warm_age)))
    s = s.withColumn("credit", credit()).withColumn("aged", aged).withColumn("hour", F.floor(F.col("closed") / 3_600_000_000))
    open_ = F.col("summarized") & ~F.col("aged") & (F.col("tier") != "cold")
    s = s.withColumn("open", open_).withColumn("give", F.when(open_, F.col("credit")).otherwise(F.lit(0)))
    totals = s.agg((F.coalesce(F.sum(F.col("raw_bytes") + F.col("warm_bytes")), F.lit(0)) - F.coalesce(F.sum(F.when(F.col("aged"), F.col("credit"))), F.lit(0))).alias("left"))
    hours = s.groupBy("tier", "hour").agg(F.sum("give").alias("given"))
    before = F.coalesce(F.sum("given").over(Window.orderBy("tier", "hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.select("tier", "hour", before.alias("hour_before"))  # three rows for each hour; hot sorts before warm
    own = F.coalesce(F.sum("give").over(Window.partitionBy("tier", "hour").orderBy("closed", "display_id", "sequence").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("own_before", own).join(hours, ["tier", "hour"]).crossJoin(F.broadcast(totals))  # one row
    goes = F.col("aged") | (F.col("open") & (F.col("left") - F.col("hour_before") - F.col("own_before") > budget))
    action = F.when(goes & (F.col("tier") == "hot"), "shrink").when(goes, "drop_warm").when(~F.col("summarized"), "keep:not_summarized").when(F.col("tier") == "cold", "keep:nothing_to_reclaim").otherwise("keep:within_budget")
    return s.select("display_id", "sequence", action.alias("action"))
