"""Date functions: timeframes, windows and buckets, all relative to a given time."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def since(recent: str, as_of: Column) -> Column:
    """F-DATE5: start of a timeframe such as ``48h`` or ``7d``."""
    m = re.fullmatch(r"(\d+)([hd])", recent.strip())
    if not m:
        raise ValueError(f"not a timeframe: {recent!r}")
    unit = "HOUR" if m[2] == "h" else "DAY"
    return as_of - F.expr(f"INTERVAL {int(m[1])} {unit}")


def within(moment: Column, as_of: Column, recent: str | None = None, since_year: int | None = None, date_range: tuple[str, str] | None = None) -> Column:
    """P5: true inside one kind of timeframe; false for a null moment."""
    if recent:
        test = moment >= since(recent, as_of)
    elif since_year is not None:
        test = F.year(moment) >= since_year
    elif date_range:
        test = F.to_date(moment).between(F.lit(date_range[0]).cast("date"), F.lit(date_range[1]).cast("date"))
    else:
        test = F.lit(True)
    return F.coalesce(test & moment.isNotNull(), F.lit(False))


def incremental_start(last_success: Column, default: Column) -> Column:
    """M5: an hour before the last success, else the default."""
    return F.coalesce(last_success - F.expr("INTERVAL 1 HOUR"), default)


def backfill_window(cursor: Column, created: Column, today: Column, most_days: int, step: int = 7) -> tuple[Column, Column]:
    """F-DATE6: the step of days before the cursor, not before the subscription or the horizon."""
    return F.greatest(F.date_sub(cursor, step), created, F.date_sub(today, most_days)), cursor


def bucket(period: Column, unit: str) -> tuple[Column, Column]:
    """F-DATE7: first and last day of the day, ISO week or calendar month."""
    start = F.to_date(F.date_trunc({"daily": "day", "weekly": "week", "monthly": "month"}[unit], period))
    end = {"daily": start, "weekly": F.date_add(start, 6), "monthly": F.last_day(start)}[unit]
    return start, end
