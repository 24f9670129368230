"""Dates: ISO first, then day-first; ages, retention and report deadlines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from pullwise import dims

ISO_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm",
               "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSSSSS")
DAY_FIRST = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm",
             "d-M-yyyy HH:mm:ss", "d-M-yyyy HH:mm")
BASIC = ("yyyyMMdd", "yyyyMMdd'T'HHmmss", "yyyyMMdd'T'HHmm")
NAMED = ("d MMMM yyyy", "d MMM yyyy", "d-MMM-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss",
         "d MMMM yyyy HH:mm", "d MMM yyyy HH:mm")
# a time's fraction and zone; the clock as written is what is kept
ZONE = r"^([0-9]{4}-?[0-9]{2}-?[0-9]{2}[T ][0-9]{2}:?[0-9]{2}(?::?[0-9]{2})?)(?:[.,][0-9]+)?\s*(?:Z|z|UTC|[+-][0-9]{2}(?::?[0-9]{2})?)?$"
MONTH_FIRST = ("M/d/yyyy", "M-d-yyyy", "M.d.yyyy", "M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm",
               "M-d-yyyy HH:mm:ss", "M-d-yyyy HH:mm")


def parse_timestamp(value: Column, dayfirst: bool = True) -> Column:
    formats = ISO_FORMATS + (DAY_FIRST if dayfirst else MONTH_FIRST) + BASIC + NAMED
    clock = F.regexp_replace(F.trim(value), ZONE, "$1")
    return F.coalesce(*[F.try_to_timestamp(clock, F.lit(f)) for f in formats])


def normalise_date(value: Column, with_time: bool, dayfirst: bool = True) -> Column:
    """ISO text; what cannot be parsed stays as written."""
    parsed = parse_timestamp(value, dayfirst)
    out = "yyyy-MM-dd'T'HH:mm:ss" if with_time else "yyyy-MM-dd"
    return F.coalesce(F.date_format(parsed, out), value)


def unparsed_date(value: Column, dayfirst: bool = True) -> Column:
    return value.isNotNull() & parse_timestamp(value, dayfirst).isNull()


def hl7_date(value: Column) -> Column:
    return F.when(value != "", F.substring(F.regexp_replace(value, "[-:T]", ""), 1, 14))


def age_on(dob: Column, today: date) -> Column:
    """Whole years from an ISO date of birth or a bare year; null when unreadable."""
    text = F.trim(dob)
    born = F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    before_birthday = (F.month(born) * 100 + F.dayofmonth(born)) > (today.month * 100 + today.day)
    return F.when(text.rlike("^[0-9]{4}$"), F.lit(today.year) - text.try_cast("int")).otherwise(
        F.lit(today.year) - F.year(born) - before_birthday.cast("int"))


def minor(dob: Column, today: date) -> Column:
    return F.coalesce(age_on(dob, today) < dims.ADULT_AGE, F.lit(False))


def delete_after(written_at: Column, retention_days: Column) -> Column:
    return F.timestamp_add("DAY", retention_days, written_at)


def due(delete_at: Column, now: Column) -> Column:
    """The erasure date has come; no date is never due."""
    return F.coalesce(now >= delete_at, F.lit(False))


def overdue(delete_at: Column, now: Column) -> Column:
    """The erasure date has passed (strictly)."""
    return F.coalesce(delete_at < now, F.lit(False))


def report_due(discovered_at: Column) -> Column:
    return F.timestamp_add("HOUR", F.lit(dims.REPORT_WINDOW_HOURS), discovered_at)
