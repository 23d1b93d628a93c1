"""Dates as they come out of free text, and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from careerloom.functions.text import _c


def _try_date(c: Column, pattern: str, fmt: str) -> Column:
    return F.when(c.rlike(pattern), F.to_date(F.try_to_timestamp(c, F.lit(fmt))))


def parse_partial_date(c: Column | str) -> Column:
    """yyyy-MM-dd, yyyy-MM or yyyy; 'null', 'present' and anything else is null."""
    c = _c(c)
    return F.coalesce(
        _try_date(c, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        _try_date(c, r"^\d{4}-\d{1,2}$", "yyyy-M"),
        _try_date(c, r"^\d{4}$", "yyyy"),
    )


def parse_any_date(c: Column | str) -> Column:
    """ISO date or timestamp first, then month/day/year, then day/month/year."""
    c = _c(c)
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    day = F.substring(c, 1, 10)
    return F.coalesce(
        F.when(c.rlike(iso), F.to_date(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))),
        _try_date(c, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        _try_date(c, r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        _try_date(c, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
        _try_date(c, r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    )


def parse_any_timestamp(c: Column | str) -> Column:
    """Wall-clock timestamp of the forms above; a bare date means midnight."""
    c = _c(c)
    naive = F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", "")
    naive = F.when(c.contains(":"), F.replace(naive, F.lit("T"), F.lit(" "))).otherwise(c)
    shaped = naive.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?$")
    full = F.when(naive.rlike(r":\d{1,2}:\d{1,2}"), naive).otherwise(F.concat(naive, F.lit(":00")))
    return F.coalesce(
        F.when(shaped, full.try_cast("timestamp_ntz")),
        parse_any_date(c).cast("timestamp_ntz"),
    )


def duration_months(start: Column | str, end: Column | str, as_of: Column | str) -> Column:
    """Calendar-month difference, days ignored; an open end counts to ``as_of``."""
    s, e = _c(start), F.coalesce(_c(end), _c(as_of))
    months = (F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)
    return F.when(s.isNotNull(), F.greatest(F.lit(0), months))


def duration_years(start: Column | str, end: Column | str, as_of: Column | str) -> Column:
    return F.bround(duration_months(start, end, as_of) / F.lit(12.0), 1)


def is_expired(expiration: Column | str, as_of: Column | str) -> Column:
    return F.coalesce(_c(expiration) < _c(as_of), F.lit(False))


def dates_within_days(a: Column | str, b: Column | str, days: int = 30) -> Column:
    """Both missing counts as close, one missing as far."""
    a, b = _c(a), _c(b)
    return (
        F.when(a.isNull() & b.isNull(), F.lit(True))
        .when(a.isNull() | b.isNull(), F.lit(False))
        .otherwise(F.abs(F.datediff(a, b)) <= days)
    )
