"""Times, durations and day windows as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME_LINE = r"((?:\d{1,2}:)?\d{2}:\d{2}[.,]\d{3})\s*-->\s*((?:\d{1,2}:)?\d{2}:\d{2}[.,]\d{3})"


def _group(text: Column, pattern: str, n: int) -> Column:
    found = F.regexp_extract(text, pattern, n)
    return F.when(found != "", found)


def parse_timestamp(text: Column) -> Column:
    """[H:]MM:SS and a point or comma with three digits, in seconds, hours of as many digits as `srt_time` writes; null if it is anything else."""
    pattern = r"^(?:(\d{1,12}):)?(\d{2}):(\d{2})[.,](\d{3})$"
    hours = F.coalesce(_group(text, pattern, 1).cast("bigint"), F.lit(0))
    whole = hours * 3600 + _group(text, pattern, 2).cast("int") * 60 + _group(text, pattern, 3).cast("int")
    return (whole * 1000 + _group(text, pattern, 4).cast("int")) / F.lit(1000.0)


def parse_strict(text: Column) -> Column:
    """H:MM:SS and milliseconds, minutes and seconds up to 59; else null."""
    pattern = r"^(\d+):(\d{1,2}):(\d{1,2})[.,](\d{3})$"
    h, m, s, ms = (_group(text, pattern, k).cast("bigint") for k in (1, 2, 3, 4))
    return F.when((m <= 59) & (s <= 59), ((h * 3600 + m * 60 + s) * 1000 + ms) / F.lit(1000.0))


def srt_time(seconds: Column) -> Column:
    ms = F.greatest(F.round(seconds * 1000).cast("bigint"), F.lit(0))
    part = lambda size, most: F.lpad((F.floor(ms / size) % most).cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000).cast("bigint")
    return F.concat(F.when(hours < 10, F.lpad(hours.cast("string"), 2, "0")).otherwise(hours.cast("string")), F.lit(":"), part(60_000, 60), F.lit(":"), part(1000, 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def ass_time(seconds: Column) -> Column:
    cs = F.greatest(F.round(seconds * 100).cast("bigint"), F.lit(0))
    part = lambda size, most: F.lpad((F.floor(cs / size) % most).cast("string"), 2, "0")
    return F.concat(F.floor(cs / 360_000).cast("string"), F.lit(":"), part(6000, 60), F.lit(":"), part(100, 60), F.lit("."), F.lpad((cs % 100).cast("string"), 2, "0"))


def clock(seconds: Column) -> Column:
    """MM:SS, with hours in front from one hour on."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0))
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    short = F.concat(two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))
    return F.when(hours > 0, F.concat(two(hours), F.lit(":"), short)).otherwise(short)


def iso_duration(text: Column) -> Column:
    """Seconds of P[nD][T[nH][nM][nS]]; 0 for anything else."""
    pattern = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    d, h, m, s = (F.coalesce(_group(text, pattern, k).try_cast("bigint"), F.lit(0)) for k in (1, 2, 3, 4))
    return F.when(text.rlike(pattern), d * 86_400 + h * 3600 + m * 60 + s).otherwise(F.lit(0)).cast("bigint")


def day_start(day: Column, zone: str) -> Column:
    """The instant at which a local day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def day_end(day: Column, zone: str, now: Column | None = None) -> Column:
    """The last microsecond of a local day, or now while the day lasts; null for a day to come."""
    last = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone) - F.expr("INTERVAL 1 MICROSECOND")
    return last if now is None else F.when(day_start(day, zone) <= now, F.least(last, now))


def snapshot_date(name: Column, upload: Column, today: Column) -> Column:
    """The date in a file name, else the eight-digit upload date, else today."""
    return F.coalesce(F.try_to_date(_group(name, r"(\d{4}-\d{2}-\d{2})", 1)), F.try_to_date(_group(upload, r"^(\d{8})$", 1), "yyyyMMdd"), today)
