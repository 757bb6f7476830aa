"""Dates, times of day and durations as Column expressions. Values that can't be read become null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_clock_to_utc(text: Column, zone: str = "America/Chicago") -> Column:
    """Text that names local wall-clock time but ends in Z, as the UTC timestamp it means."""
    local = F.try_to_timestamp(F.regexp_replace(text, "Z+$", ""))
    return F.to_utc_timestamp(local, zone)


def utc_time_of_day(text: Column, zone: str = "America/Chicago") -> Column:
    return F.date_format(wall_clock_to_utc(text, zone), "HH:mm:ss")


def iso_duration_seconds(text: Column) -> Column:
    """PT#H#M#S, and P0D as 0; forms with days are null."""

    def part(unit: str) -> Column:
        found = F.regexp_extract(text, rf"^PT(?:\d+H)?(?:\d+M)?(?:\d+S)?$", 0)
        return F.coalesce(F.regexp_extract(found, rf"(\d+){unit}", 1).try_cast("int"), F.lit(0))

    known = text.rlike(r"^PT(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+S)?$")
    return F.when(text == "P0D", F.lit(0)).when(known, part("H") * 3600 + part("M") * 60 + part("S"))


def day_month_year(text: Column) -> Column:
    """'2 November 200009:21', without a space between year and hour."""
    return F.try_to_timestamp(text, F.lit("d MMMM yyyyHH:mm"))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def month_name_date(text: Column) -> Column:
    """'Sep. 5, 2023' or 'September 5, 2023' as an ISO date; other text stays as it is."""
    mended = F.replace(F.replace(text, F.lit("Sept."), F.lit("Sep.")), F.lit("Nov, "), F.lit("Nov. "))
    read = F.coalesce(F.try_to_timestamp(mended, F.lit("MMM. d, yyyy")), F.try_to_timestamp(mended, F.lit("MMMM d, yyyy")))
    return F.coalesce(F.date_format(read, "yyyy-MM-dd"), text)


def compact_time(day: Column, time: Column) -> Column:
    """yyyyMMdd and HHmmss as ISO text, or the day as it is."""
    whole = F.when((F.length(day) == 8) & (F.length(time) == 6), F.concat(day, time))
    return F.coalesce(iso_z(F.try_to_timestamp(whole, F.lit("yyyyMMddHHmmss"))), day)


def hms_seconds(text: Column) -> Column:
    """Seconds of the day of HH:mm:ss."""
    p = F.split(text, ":")
    return F.get(p, F.lit(0)).try_cast("int") * 3600 + F.get(p, F.lit(1)).try_cast("int") * 60 + F.get(p, F.lit(2)).try_cast("int")


def hms_normal(text: Column) -> Column:
    return F.date_format(F.try_to_timestamp(text, F.lit("H:m:s")), "HH:mm:ss")


def leading_int(text: Column) -> Column:
    """The whole number that text begins with, whatever follows."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def is_hms(text: Column) -> Column:
    """Three parts that begin with numbers in the ranges of hours, minutes and seconds."""
    p = F.split(text, ":", -1)
    fits = [F.coalesce(leading_int(F.get(p, F.lit(i))).between(0, most), F.lit(False)) for i, most in enumerate((23, 59, 59))]
    return (F.size(p) == 3) & fits[0] & fits[1] & fits[2]


def checked_day(text: Column) -> Column:
    """Text of the form yyyy-mm-dd as a date (null if there is no such day); other text raises."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text)).otherwise(F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date"))


def padded_month(day: Column) -> tuple[Column, Column]:
    """From the day before a month to the second day of the next one."""
    first = F.trunc(day, "MM")
    return F.date_sub(first, 1), F.date_add(F.add_months(first, 1), 1)


def archive_date(name: Column) -> Column:
    """The ISO date of a name that begins with m-d-yy, padded or not."""
    def part(i: int) -> Column:
        return F.lpad(F.regexp_extract(name, r"^(\d{1,2})-(\d{1,2})-(\d{2})", i), 2, "0")

    return F.when(name.rlike(r"^\d{1,2}-\d{1,2}-\d{2}"), F.concat(F.lit("20"), part(3), F.lit("-"), part(1), F.lit("-"), part(2)))


def playback_clock(start: Column, started_ms: Column, now_ms: Column) -> Column:
    """HH:MM:SS.mmm of a clock that showed start (HH:mm:ss, with a fraction or not) at started_ms; hours go beyond 23."""
    base = hms_seconds(F.substring_index(start, ".", 1)).cast("long") * 1000
    fraction = F.regexp_extract(start, r"\.(\d+)$", 1)
    base = base + F.coalesce(F.substring(F.rpad(fraction, 3, "0"), 1, 3).try_cast("long"), F.lit(0))
    ms = base + now_ms - started_ms
    hours = F.floor(ms / 3600000)
    return F.format_string("%02d:%02d:%02d.%03d", hours, F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def clock_seed(ts: Column) -> Column:
    """Five seconds before, as time of day."""
    return F.date_format(ts - F.expr("INTERVAL 5 SECONDS"), "HH:mm:ss")


def since(at: Column, first: str) -> Column:
    """Whether a time is not before a day's beginning; a missing one is not."""
    return F.coalesce(at >= F.lit(f"{first} 00:00:00").cast("timestamp"), F.lit(False))
