"""Dates of registers: ISO or day first, calendar shifts and whole days. All results are dates, never timestamps."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layouts beside ISO that are read, the day before the month. Other layouts count as unreadable.
DAY_FIRST = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy", "d-M-yy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "yyyy/M/d", "yyyyMMdd")
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[ T].*)?$"


def parse_date(raw: Column) -> Column:
    """The day of a text, null for a blank or unreadable one. A time after the day is dropped."""
    text = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    day = F.regexp_replace(text, r"[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?$", "")
    other = F.coalesce(*(F.try_to_date(day, layout) for layout in DAY_FIRST))
    return F.when(text.rlike(_ISO), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")).when(text != "", other)


def date_is_invalid(raw: Column) -> Column:
    """Whether a filled cell holds no date."""
    return (F.trim(F.coalesce(raw.cast("string"), F.lit(""))) != "") & parse_date(raw).isNull()


def observation_day(value: str | dt.date | dt.datetime) -> dt.date:
    """A driver-side date: of a datetime its day, of a text ISO or day first; anything else raises."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    text = value.strip()
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}(?:[ T].*)?", text):
        return dt.date.fromisoformat(text[:10])
    for layout in ("%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%d %b %Y", "%d %B %Y"):
        try:
            return dt.datetime.strptime(text, layout).date()
        except ValueError:
            continue
    raise ValueError(f"observation date {value!r} can't be read")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def months_before(day: Column, months: int) -> Column:
    """The same day so many months earlier, or that month's last day."""
    return F.add_months(day, -months)


def year_text(day: Column, missing: str = "missing") -> Column:
    return F.coalesce(F.year(day).cast("string"), F.lit(missing))
