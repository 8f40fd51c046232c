"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def backoff_seconds(attempt: Column) -> Column:
    """30 s, doubled for each attempt up to the sixth, at most half an hour."""
    return F.least(F.lit(30) * F.pow(F.lit(2), F.least(attempt, F.lit(6))), F.lit(1800)).cast("long")


def call_budget(displays: Column, regions: Column, interval: Column) -> Column:
    """Calls that ten minutes may take: two for each display, region and interval, each at least one."""
    one = lambda c: F.greatest(c, F.lit(1))
    return (one(displays) * one(regions) * one(F.ceil(600 / one(interval))) * 2).cast("long")


def recommended_fps(seconds: Column) -> Column:
    return F.when(seconds <= 30, 15.0).when(seconds <= 900, 1.0).when(seconds <= 7200, 0.5).otherwise(0.2)


def even_fps(seconds: Column, frames: float, most: float) -> Column:
    """The rate at which so many frames span a clip, from 0.05 to `most`; 1 for a clip of no length."""
    return F.when(seconds > 0, F.least(F.greatest(F.lit(frames) / seconds, F.lit(0.05)), F.lit(most))).otherwise(F.lit(1.0))


def intent(kind: Column) -> list[Column]:
    """What a recording's intent, content or activity, means for texts and stills."""
    content = kind == "content"
    return [content.alias("keeps_text"), content.alias("aggregates_text"), (~content).alias("discards_stills")]


def memory_pressure(used: Column, total: Column) -> Column:
    share = F.when(total > 0, used / total).otherwise(F.lit(0.0))
    return F.when(share >= 0.9, "critical").when(share >= 0.8, "high").otherwise("normal")


def keep_alive(cadence: Column) -> Column:
    return 2 * cadence + 60


def health(stopped: Column, cause: Column, now: Column, last_at: Column, since: Column, segment_seconds: Column) -> Column:
    """Health of a recorder; a null cause is no pause. Times in microseconds; silence of two segments is degraded."""
    ref = F.greatest(F.coalesce(last_at, since), since)
    fresh = F.floor((now - ref) / 1_000_000) < 2 * segment_seconds
    return (
        F.when(stopped, "stopped").when(cause == "user_off", "off").when(cause.isin("source_ended", "daemon_restart"), "degraded")
        .when(cause.isNotNull(), "paused").when(fresh, "healthy").otherwise("degraded")
    )


def byte_range(header: Column, size: Column) -> Column:
    """bytes=a-b, a- or -n as (first, last), both inclusive; null if it can't be met."""
    a, b = (F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", i) for i in (1, 2))
    number = lambda c: F.when(c != "", c).cast("long")
    first = F.when(a != "", number(a)).when(b != "", F.greatest(size - number(b), F.lit(0)))
    last = F.when((a != "") & (b != ""), F.least(number(b), size - 1)).otherwise(size - 1)
    return F.when(first.isNotNull() & (first < size) & (first <= last), F.struct(first.alias("first"), last.alias("last")))


def sample_stem(display: Column, sequence: Column, at: Column) -> Column:
    """A sample's file name without its ending; the sequence has six digits at least, and all that it has."""
    number = F.when(sequence.isNotNull(), F.format_string("%06d", sequence))
    return F.concat(F.lit("d"), display.cast("string"), F.lit("_w"), number, F.lit("_"), F.date_format(at, "yyyyMMdd'T'HHmmssSSS"))


def fnv1a(values: Column) -> Column:
    """FNV-1a of an array of byte values as a signed 64-bit number. The product is taken by halves of 32 bits, none of
    which overflows, since ANSI arithmetic refuses to wrap. Fixed values: offset and prime."""
    half = F.lit(2**32 - 1)

    def step(h: Column, v: Column) -> Column:
        mixed = h.bitwiseXOR(v.cast("long"))
        low, high = mixed.bitwiseAND(half), F.shiftrightunsigned(mixed, 32)
        # prime = 2^40 + 435: of the first product only what is shifted inside the upper half stays
        product = low * 435
        upper = high * 435 + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)
        return F.shiftleft(upper, 32).bitwiseOR(product.bitwiseAND(half))

    return F.aggregate(values, F.lit(14695981039346656037 - 2**64), step)


def little_endian(value: Column, n: int = 8) -> Column:
    """The bytes of a number, lowest first."""
    return F.array(*[F.shiftrightunsigned(value.cast("long"), 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(n)])
