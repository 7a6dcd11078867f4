"""Dates as strings YYYY-MM-DD, compared as strings. The run date is a parameter everywhere."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from brevier.functions.text import column, strip

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ANY_MONTH = "(" + "|".join(MONTHS) + ")"
#: Date shapes in the order in which they are tried, with the groups of year, month and day.
SHAPES = [
    (r"(?U)(\d{4})-(\d{1,2})-(\d{1,2})", (1, 2, 3)),
    (rf"(?iU)\b{ANY_MONTH}[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b", (3, 1, 2)),
    (rf"(?iU)\b(\d{{1,2}})\s+{ANY_MONTH}[a-z]*\.?\s+(\d{{4}})\b", (3, 2, 1)),
    (r"(?U)\b(\d{1,2})/(\d{1,2})/(\d{4})\b", (3, 1, 2)),
]
#: Offsets of the zone names that mail dates use.
ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
YEARS = (2000, 2035)


def month_number(text: Column) -> Column:
    """1 to 12 for a month's name or number."""
    low = F.substring(F.lower(text), 1, 3)
    found = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), low)
    return F.when(found > 0, found.cast("int")).otherwise(text.try_cast("int"))


def mail_time(text: Column | str) -> Column:
    """Timestamp of an RFC 822 date; a missing zone is UTC, zone names have fixed offsets."""
    bare = F.regexp_replace(strip(text), r"^[A-Za-z]+,\s*", "")
    zone = F.regexp_extract(bare, r"\s([A-Z]{2,4})$", 1)
    offset = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for n, h in ZONES.items() for x in (n, f"{'-' if h < 0 else '+'}{abs(h):02d}00")]), zone),
        F.lit("+0000"),
    )
    named = F.concat(F.regexp_replace(bare, r"\s+[A-Z]{2,4}$", " "), offset)
    numeric = F.when(zone != "", named).when(bare.rlike(r"[+-]\d{4}$"), bare).otherwise(F.concat(bare, F.lit(" +0000")))
    with_seconds = F.regexp_replace(numeric, r"(\s\d{1,2}:\d{2})\s", "$1:00 ")
    return F.try_to_timestamp(with_seconds, F.lit("d MMM yyyy H:mm:ss Z"))


def mail_date(text: Column | str) -> Column:
    """UTC date of an RFC 822 date, null where it is none. The session's time zone must be UTC."""
    return F.date_format(mail_time(text), "yyyy-MM-dd")


def published_date(published: Column | str, updated: Column | str) -> Column:
    """UTC date of publication, else of the last change, else null."""
    return F.coalesce(mail_date(published), mail_date(updated))


def normalise_date(text: Column | str, run_date: str) -> Column:
    """YYYY-MM-DD of the first shape that the text has, null where it is out of range or after the run date.

    A shape that matches but is out of range ends the search. There is no check of the calendar, so that
    2026-02-31 is a date.
    """
    value = column(text)
    wall = F.regexp_extract(value, r"(?i)^\s*(?:[A-Za-z]+,\s*)?(\d{1,2}\s+[A-Za-z]{3}\s+\d{4})\s", 1)
    mail = F.date_format(F.try_to_timestamp(wall, F.lit("d MMM yyyy")), "yyyy-MM-dd")
    parts = F.when(F.lit(False), F.array(F.lit(0)))
    for pattern, groups in SHAPES:
        y, m, d = (F.regexp_extract(value, pattern, g) for g in groups)
        parts = parts.when(value.rlike(pattern), F.array(y.try_cast("int"), month_number(m), d.try_cast("int")))
    parts = parts.when(mail.isNotNull(), F.array(*[F.substring(mail, a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2))]))
    y, m, d = (F.get(parts, k) for k in range(3))
    made = F.format_string("%04d-%02d-%02d", y, m, d)
    valid = y.between(*YEARS) & m.between(1, 12) & d.between(1, 31) & (made <= run_date)
    return F.when(valid, made)


def cutoff(run_date: str, max_age_days: int = 740) -> str:
    """The oldest date that is not too old."""
    return (date.fromisoformat(run_date) - timedelta(days=max_age_days)).isoformat()


def is_too_old(day: Column | str, run_date: str, max_age_days: int = 740) -> Column:
    return column(day) < cutoff(run_date, max_age_days)


def is_same_day(day: Column | str, run_date: str) -> Column:
    return F.coalesce(column(day) == run_date, F.lit(False))


def is_within_days(day: Column | str, run_date: str, n: int) -> Column:
    """From n - 1 days before the run date up to it; false for what is no date."""
    age = F.datediff(F.lit(run_date).cast("date"), F.try_to_date(column(day)))
    return F.coalesce(age.between(0, n - 1), F.lit(False))
