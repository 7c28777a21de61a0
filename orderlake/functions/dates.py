"""Calendar literals: driver-side parsing and the same reading as a column.

Accepted: YYYY, YYYY-MM, YYYY-MM-DD, and a day with T or blank, HH:MM, optional
:SS, optional fraction, optional Z or +HH:MM. Days 29 to 31 of shorter months
roll into the next one. Times without a zone are UTC.
"""

from __future__ import annotations

import datetime
import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = r"^([0-9]{4})(?:-(0[1-9]|1[0-2])(?:-(0[1-9]|[12][0-9]|3[01])(?:[Tt ]([01][0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9]))?(?:\.[0-9]*)?(?:[Zz]|([+-])([01][0-9]|2[0-3]):([0-5][0-9]))?)?)?)?\z"
_PY = re.compile(SHAPE.replace(r"\z", r"\Z"))
DAY = 86_400


class DateLiteral(NamedTuple):
    """UTC seconds of the start, and of the start of the next unit of the literal's precision."""

    start: int
    after: int
    only_year: bool


def _midnight(year: int, month: int, day: int) -> int:
    # 400 years are a whole number of weeks and leap cycles, so year 0 can be moved up
    shift = 400 if year < 1 else 0
    days = datetime.date(year + shift, month, 1).toordinal() - datetime.date(1970, 1, 1).toordinal()
    return (days - (146_097 if shift else 0) + day - 1) * DAY


def parse_date(text: str) -> DateLiteral | None:
    m = _PY.match(text)
    if not m:
        return None
    year, month, day, hour, minute, second, sign, zone_h, zone_m = m.groups()
    y, mo, d = int(year), int(month or 1), int(day or 1)
    start = _midnight(y, mo, d)
    if hour is not None:
        start += int(hour) * 3600 + int(minute) * 60 + int(second or 0)
        if sign:
            start -= (1 if sign == "+" else -1) * (int(zone_h) * 3600 + int(zone_m) * 60)
        return DateLiteral(start, start + (60 if second is None else 1), False)
    if day:
        return DateLiteral(start, start + DAY, False)
    if month:
        return DateLiteral(start, _midnight(y + mo // 12, mo % 12 + 1, 1), False)
    return DateLiteral(start, _midnight(y + 1, 1, 1) if y < 9999 else start + 365 * DAY, True)


def date_seconds(text: Column) -> Column:
    """UTC seconds of a string that is a calendar literal, else null."""
    part = lambda k: F.regexp_extract(text, SHAPE, k)
    number = lambda k, other: F.when(part(k) == "", F.lit(other)).otherwise(F.try_to_number(part(k), F.lit("9999")).cast("int"))
    days = F.unix_date(F.make_date(number(1, 1970), number(2, 1), F.lit(1))) + number(3, 1) - 1
    seconds = days.cast("long") * DAY + number(4, 0) * 3600 + number(5, 0) * 60 + number(6, 0)
    offset = number(8, 0) * 3600 + number(9, 0) * 60
    zone = F.when(part(7) == "+", -offset).when(part(7) == "-", offset).otherwise(F.lit(0))
    return F.when(text.rlike(SHAPE), (seconds + zone).cast("long"))
