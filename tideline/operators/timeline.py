"""Range and gap queries, upserts and the daily digest over timeline entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def overlapping(entries: DataFrame, start: int, end: int) -> DataFrame:
    """Entries that share time with [start, end): one that only touches start is out."""
    return entries.where((F.col("e") > start) & (F.col("s") < end))


def open_overlapping(gaps: DataFrame, start: int, end: int) -> DataFrame:
    """As overlapping, a null end being still open."""
    return gaps.where((F.col("e").isNull() | (F.col("e") > start)) & (F.col("s") < end))


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """Last write wins: of rows with equal keys the one with the largest version."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(version).desc()))
    return rows.withColumn("__n", rank).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new hasn't."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def islands(spans: DataFrame, by: list[str]) -> DataFrame:
    """The union of intervals (s, e) within each group: (by, s, e) of each merged one; intervals that touch merge."""
    w = Window.partitionBy(*by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("s") <= F.max("e").over(w), 0).otherwise(1)
    n = F.sum("__new").over(Window.partitionBy(*by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("__new", new).withColumn("__n", n).groupBy(*by, "__n").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("__n")


def whole_seconds(start: Column, end: Column) -> Column:
    return F.floor((end - start) / SECOND).cast("long")


def early_islands(spans: DataFrame, by: list[str]) -> DataFrame:
    """(by, s, e): intervals of a group that start in the same minute, merged. What meets in one place for a group after
    that is a few islands for each minute, whatever the number of intervals."""
    return islands(spans.withColumn("__minute", F.floor(F.col("s") / (60 * SECOND))), [*by, "__minute"]).select(*by, "s", "e")


def covered_seconds(spans: DataFrame, by: list[str]) -> DataFrame:
    """(by, seconds) that the union of intervals covers, each merged interval cut to whole seconds."""
    return islands(early_islands(spans, by), by).groupBy(*by).agg(F.sum(whole_seconds(F.col("s"), F.col("e"))).alias("seconds"))


def activity_labels(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, labels): the activities of entries of at least a whole second (secs), by their longest single entry, then
    name; blank ones are left out."""
    best = entries.where("secs > 0 and activity != ''").groupBy(*by, "activity").agg(F.max("secs").alias("m"))
    names = F.sort_array(F.collect_list(F.struct((-F.col("m")).alias("m"), "activity")))
    return best.groupBy(*by).agg(F.transform(names, lambda x: x["activity"]).alias("labels"))


def digest(entries: DataFrame, start: int, end: int) -> DataFrame:
    """A row for each category: seconds, percent of attributed time, entries and activities, with the totals recorded,
    attributed and span on each row, and its rank (most seconds first, then name).

    Entries are clipped to the range. One without a whole second there counts as an entry but gives neither time nor
    label. Seconds are of the union of intervals, for the category and, as recorded, for all."""
    c = entries.select("category", "activity", F.greatest("s", F.lit(start)).alias("s"), F.least("e", F.lit(end)).alias("e"))
    c = c.withColumn("secs", F.greatest(F.when(F.col("e") > F.col("s"), whole_seconds(F.col("s"), F.col("e"))), F.lit(0)))
    labels = c.groupBy("category", "activity").agg(F.count(F.lit(1)).alias("n"), F.max("secs").alias("m"))
    label = F.when((F.col("m") > 0) & (F.col("activity") != ""), F.struct((-F.col("m")).alias("m"), "activity"))
    names = labels.groupBy("category").agg(F.sum("n").alias("entries"), F.transform(F.sort_array(F.collect_list(label)), lambda x: x["activity"]).alias("labels"))
    # the islands of each category count for it and, under null, for all
    early = early_islands(c.where("secs > 0").select("category", "s", "e"), ["category"])
    both = early.select(F.explode(F.array("category", F.lit(None).cast("string"))).alias("__of"), "s", "e")
    seconds = islands(both, ["__of"]).groupBy("__of").agg(F.sum(whole_seconds(F.col("s"), F.col("e"))).alias("seconds"))
    out = names.join(seconds, F.col("category") == F.col("__of"), "full")  # a row for each category, and one for all
    recorded = F.coalesce(F.max(F.when(F.col("category").isNull(), F.col("seconds"))).over(Window.partitionBy()), F.lit(0))
    out = out.withColumn("recorded", recorded).where("category is not null")
    zero = F.coalesce("seconds", F.lit(0))
    all_ = F.sum(zero).over(Window.partitionBy())
    percent = F.when(all_ > 0, F.round(zero / all_ * 1000) / 10).otherwise(F.lit(0.0))
    rank = F.row_number().over(Window.orderBy(zero.desc(), "category"))
    return out.select(
        "category", zero.cast("long").alias("seconds"), percent.alias("percent"), F.col("entries").cast("long").alias("entries"),
        F.coalesce(F.array_join("labels", ", "), F.lit("")).alias("activities"),
        F.col("recorded").cast("long").alias("recorded"), all_.cast("long").alias("attributed"), F.lit(max(end - start, 0) // SECOND).cast("long").alias("span"), rank.cast("long").alias("rank"),
    )


def human(seconds: Column) -> Column:
    h, m = F.floor(seconds / 3600), F.floor(seconds / 60) % 60
    return (
        F.when((h == 0) & (m == 0), F.concat(seconds.cast("string"), F.lit("s")))
        .when(h == 0, F.concat(m.cast("string"), F.lit("m")))
        .when(m == 0, F.concat(h.cast("string"), F.lit("h")))
        .otherwise(F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
    )


def is_sparse(recorded: Column, span: Column) -> Column:
    """Whether less than half of a range was recorded."""
    return (span > 0) & (recorded * 2 < span)


def render(d: DataFrame) -> DataFrame:
    """The digest as one text; an empty one says so."""
    share = F.format_number("percent", 1)
    line = F.concat(F.lit("- "), "category", F.lit(" — "), human(F.col("seconds")), F.lit(" ("), share, F.lit("%, "), F.col("entries").cast("string"), F.when(F.col("entries") == 1, F.lit(" entry)")).otherwise(F.lit(" entries)")), F.when(F.col("activities") != "", F.concat(F.lit(": "), "activities")).otherwise(F.lit("")), F.lit("\n"))
    r, a, s = F.max("recorded"), F.max("attributed"), F.max("span")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "")
    sparse = F.when(is_sparse(r, s), F.concat(F.lit("Only "), human(r), F.lit(" of "), human(s), F.lit(" were recorded — this covers the captured fragments, not the whole period.\n\n"))).otherwise(F.lit(""))
    many = F.when(a > r, F.concat(human(a), F.lit(" of activity across "), human(r), F.lit(" of wall-clock — displays were showing different things at once.\n\n"))).otherwise(F.lit(""))
    return d.agg(F.when(F.count(F.lit(1)) == 0, F.lit("No activity was recorded for that period.")).otherwise(F.concat(sparse, many, lines)).alias("text"))


def rolling_context(chunks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """chunks (by, order, category, activity, ...) with place (from 1) and context_chars: the context of a chunk is that
    many first code points of its group's text in `context_texts`. A chunk's own line, and the break before it, come after."""
    w = Window.partitionBy(*by).orderBy(*order)
    c = chunks.withColumn("place", F.row_number().over(w))
    upto = F.sum(F.char_length(context_line()) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return c.withColumn("context_chars", F.coalesce(upto - 1, F.lit(0)).cast("long"))


def context_line() -> Column:
    return F.concat(F.lit("[chunk "), F.col("place").cast("string"), F.lit("] "), "category", F.lit(" — "), "activity")


def context_texts(placed: DataFrame, by: list[str]) -> DataFrame:
    """(by, context): a line for each chunk of a group, in order; once for a group, not once for each chunk."""
    lines = F.sort_array(F.collect_list(F.struct("place", context_line().alias("line"))))
    return placed.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))
