from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# Day-month-year text; anything after the year is ignored.
_DMY = r"^\s*(\d{1,2}/\d{1,2}/\d{4})"


def parse_dmy(col: Column, data_type: str = "string") -> Column:
    """Text ``d/m/yyyy`` to date; bad text is NULL. A column already typed is only cast.

    Two-digit years are not guessed: they are NULL, and ``ingest.unread_counts`` counts them.
    """
    if data_type != "string":
        return col.cast("date")
    # The pattern is only matched where the plain parse fails.
    return F.coalesce(
        F.try_to_date(col, "d/M/yyyy"),
        F.try_to_date(F.regexp_extract(col, _DMY, 1), "d/M/yyyy"),
    )


# Year, month, day, clock in this order, with any separators or none, and a zone offset.
_YMD_HMS = (
    r"^\s*(\d{4})[^0-9]*(\d{1,2}(?=[^0-9])|\d{2})[^0-9]*(\d{1,2}(?=[^0-9])|\d{2})[^0-9]*(\d{1,2}(?=[^0-9])|\d{2})"
    r"[^0-9]*(\d{1,2}(?=[^0-9])|\d{2})[^0-9]*(\d{1,2}(?:[.]\d{1,6})?)\s*(?:([Zz])|([+-])(\d{2}):?(\d{2})?)?\s*$"
)
# The usual forms, which a cast reads as they are.
_READY = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:[+-]\d\d:\d\d)?$"
# An offset in the rewritten form.
_OFFSET = r":\d+(?:[.]\d+)?[Zz+-]"
# Text in any other form, so that its rewritten form holds no digit.
_OTHER = r"|^(?s:.*)$"


def parse_ymd_hms(col: Column, data_type: str = "string") -> Column:
    """Text ``y-m-d h:m:s`` to a zone-free timestamp in UTC; bad text is NULL.

    Any separators or none will do. Text with an offset (``+02:00``, ``+0200``, ``+02``,
    ``Z``) is moved to UTC before the zone is dropped. Two-digit years are not guessed:
    they are NULL, and ``ingest.unread_counts`` counts them.
    """
    if data_type != "string":
        return col.cast("timestamp_ntz")

    # One match rewrites other text into a form that a cast reads, with its offset if any.
    # Both branches and the condition share it, so Spark evaluates it once for each value.
    usual = F.upper(F.regexp_replace(col, _YMD_HMS + _OTHER, "$1-$2-$3 $4:$5:$6$7$8$9$10"))
    text = F.when(col.rlike(_READY), col).otherwise(usual)
    local, at = text.try_cast("timestamp_ntz"), text.try_cast("timestamp")
    return F.when(text.rlike(_OFFSET), _utc(at)).otherwise(local)


def _utc(ts: Column) -> Column:
    """A moment as zone-free timestamp in UTC, whatever the session's zone."""
    start = F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), start)


def span_days(start: Column, end: Column) -> Column:
    """Whole days between two dates."""
    return F.datediff(end, start)


def span_micros(start: Column, end: Column) -> Column:
    """Exact span between two timestamps in microseconds."""
    return F.timestamp_diff("MICROSECOND", start, end)


def micros_to_days(micros: Column) -> Column:
    return micros / F.lit(float(MICROS_PER_DAY))


def week_start(date: Column) -> Column:
    """The Monday of the week, by date arithmetic only (no session zone involved)."""
    return F.date_sub(date, F.weekday(date))


def monday_of(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=day.weekday())


def reporting_window(cutoff: dt.date) -> tuple[dt.date, dt.date]:
    """The seven days that end on the cutoff. A calendar week only for a Sunday cutoff."""
    return cutoff - dt.timedelta(days=6), cutoff


def day_text(date: Column) -> Column:
    return F.date_format(date, "dd/MM/yyyy")


def week_label(date: Column) -> Column:
    """Short label of a week. Labels repeat across years: order and key by the date."""
    return F.date_format(date, "dd MMM")


def age_months(birth: Column, at: Column) -> Column:
    """Completed months, rounded down (negative when birth is later)."""
    return F.floor(F.months_between(at, birth)).cast("int")
