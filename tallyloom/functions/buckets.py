"""Time buckets: truncation and the dense list of a range's buckets; weeks start on Monday.

Times are without a zone. Everything here stays so: a way over timestamps with a zone would move times by the session's zone
where its clocks change."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import TimeRange, Unit

LABEL = "%Y-%m-%dT%H:%M:%S"


EPOCH = datetime(1970, 1, 1)


def instant(t: datetime | None) -> Column:
    """t as a literal without a zone; a datetime given to lit() itself would go through the session's zone."""
    return F.lit(None if t is None else t.isoformat(sep=" ")).cast("timestamp_ntz")


def bucket(column: Column, unit: Unit) -> Column:
    if unit == "hour":
        return F.to_date(column).cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(column))
    return F.trunc(F.to_date(column), unit).cast("timestamp_ntz") if unit != "day" else F.to_date(column).cast("timestamp_ntz")


def micros(column: Column) -> Column:
    """Microseconds since 1970 of a time without a zone."""
    since = column - instant(EPOCH)
    part = lambda name: F.extract(F.lit(name), since)
    return part("DAY").cast("long") * 86_400_000_000 + part("HOUR").cast("long") * 3_600_000_000 + part("MINUTE").cast("long") * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")


def from_micros(column: Column) -> Column:
    seconds = (column.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return instant(EPOCH) + F.make_dt_interval(secs=seconds)


def floor(t: datetime, unit: Unit) -> datetime:
    t = t.replace(minute=0, second=0, microsecond=0)
    if unit == "hour":
        return t
    t = t.replace(hour=0)
    if unit == "week":
        return t - timedelta(days=t.weekday())
    return t if unit == "day" else t.replace(day=1) if unit == "month" else t.replace(month=1, day=1)


def following(t: datetime, unit: Unit) -> datetime:
    if unit in ("hour", "day", "week"):
        return t + timedelta(**{f"{unit}s": 1})
    if unit == "year":
        return t.replace(year=t.year + 1)
    return t.replace(year=t.year + t.month // 12, month=t.month % 12 + 1)


def bucket_list(time: TimeRange, unit: Unit) -> list[datetime]:
    """The buckets from the one of start to the one of end, both inclusive."""
    if time.start is None or time.end is None:
        raise ValueError("a list of buckets needs both ends")
    out, t = [], floor(time.start, unit)
    while t <= time.end:
        out.append(t)
        t = following(t, unit)
    return out


def moved(t: datetime | None, n: int, unit: Unit) -> datetime | None:
    """t moved by n units of the calendar; the day is cut to its month's last."""
    if t is None or unit in ("hour", "day", "week"):
        return t and t + timedelta(**{f"{unit}s": n})
    months = t.year * 12 + t.month - 1 + n * (12 if unit == "year" else 1)
    first = t.replace(year=months // 12, month=months % 12 + 1, day=1)
    return first.replace(day=min(t.day, (following(first, "month") - timedelta(days=1)).day))


def shift(column: Column, n: int, unit: Unit) -> Column:
    """column moved by n units of the calendar."""
    hours, days, months = {"hour": (n, 0, 0), "day": (0, n, 0), "week": (0, 7 * n, 0), "month": (0, 0, n), "year": (0, 0, 12 * n)}[unit]
    return (column + F.make_interval(months=F.lit(months), days=F.lit(days), hours=F.lit(hours))).cast("timestamp_ntz")
