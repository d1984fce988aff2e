"""ISO-8601 durations, as driver literals and as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ISO-8601 duration format, one group per unit.
_NUMBER = r"(?:(\d+(?:\.\d+)?){unit})?"
_DATE_UNITS = ("Y", "M", "W", "D")
_TIME_UNITS = ("H", "M", "S")
DURATION_PATTERN = (
    "^P(?=.)"
    + "".join(_NUMBER.replace("{unit}", u) for u in _DATE_UNITS)
    + r"(?:T(?=\d)"
    + "".join(_NUMBER.replace("{unit}", u) for u in _TIME_UNITS)
    + ")?$"
)
_SECONDS = {3: 7 * 86400, 4: 86400, 5: 3600, 6: 60, 7: 1}


@dataclass(frozen=True)
class Duration:
    """Calendar months plus an exact span; ``P1Y2M3DT4H`` is 14 months and 3 d 4 h."""

    months: int
    span: timedelta

    @property
    def is_fixed(self) -> bool:
        return self.months == 0

    def times(self, n: int) -> Duration:
        return Duration(self.months * n, self.span * n)

    def after(self, start: datetime) -> datetime:
        """``start`` moved by this duration; month steps clip to the month's last day."""
        if not self.months:
            return start + self.span
        year, month0 = divmod(start.year * 12 + start.month - 1 + self.months, 12)
        first = start.replace(year=year, month=month0 + 1, day=1)
        next_first = (first.replace(day=28) + timedelta(days=4)).replace(day=1)
        last_day = (next_first - timedelta(days=1)).day
        return first.replace(day=min(start.day, last_day)) + self.span


def parse_duration(text: str) -> Duration:
    match = re.match(DURATION_PATTERN, text)
    if match is None:
        raise ValueError(f"{text!r} is not an ISO-8601 duration")
    years, months = (float(match.group(i) or 0) for i in (1, 2))
    if years % 1 or months % 1:
        raise ValueError(f"{text!r}: years and months must be whole numbers")
    seconds = sum(float(match.group(i) or 0) * s for i, s in _SECONDS.items())
    return Duration(int(years) * 12 + int(months), timedelta(seconds=seconds))


def fixed_seconds(text: str) -> float:
    """Length in seconds; durations with years or months have none."""
    duration = parse_duration(text)
    if not duration.is_fixed:
        raise ValueError(f"{text!r}: years and months have no fixed length")
    return duration.span.total_seconds()


def _parts(text: Column) -> Column:
    """The seven numbers of a duration, found in one pass; NULL where the text is none."""
    groups = ",".join(f"${i}" for i in range(1, 8))
    found = F.when(text.rlike(DURATION_PATTERN), F.regexp_replace(text, DURATION_PATTERN, groups))
    return F.split(found, ",")


def _number(parts: Column, group: int) -> Column:
    part = F.nullif(F.get(parts, group - 1), F.lit(""))
    return F.coalesce(part.cast("double"), F.lit(0.0))


# The numbers are added outside any condition, so that Spark evaluates their shared regex once.


def duration_seconds(text: Column) -> Column:
    """Seconds in the fixed part of a duration column; NULL where the text is no duration."""
    parts = _parts(text)
    total = sum((_number(parts, i) * s for i, s in _SECONDS.items()), F.lit(0.0))
    return total + F.when(parts.isNotNull(), F.lit(0.0))


def duration_months(text: Column) -> Column:
    """Months in the calendar part of a duration column."""
    parts = _parts(text)
    months = (_number(parts, 1) * 12 + _number(parts, 2)).cast("long")
    return months + F.when(parts.isNotNull(), F.lit(0))
