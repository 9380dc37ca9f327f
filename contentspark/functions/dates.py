"""Feed dates: the wall-clock reading is kept, the offset is dropped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentspark.functions.binding import let

# Day and month names of the mail date format.
WEEKDAYS = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"

MAIL = (
    rf"(?i)^(?:({WEEKDAYS}), )?(\d{{1,2}}) ({MONTHS}) (\d{{4}}) "
    r"(\d{2}):(\d{2})(?::(\d{2}))? (GMT|[+-](?:0\d|1[0-8])[0-5]\d)$"
)
ISO = (
    r"(?i)^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?"
    r"(?:(?:Z|[+-](?:0\d|1[0-8]):[0-5]\d(?::[0-5]\d)?)(?:\[[A-Za-z0-9_/+:-]+\])?)?$"
)


def _groups(text: Column, pattern: str, count: int) -> Column:
    """All groups of a whole-text pattern from one match, missing ones as empty text."""
    joined = F.regexp_replace(text, pattern, "|".join(f"${i}" for i in range(1, count + 1)))
    return F.split(joined, "[|]")


def _int(part: Column) -> Column:
    return part.try_cast("int")


def _month_number(name: Column) -> Column:
    found = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS.split("|")]), F.lower(name))
    return F.when(found > 0, found.cast("int"))


def _mail_date(g: Column) -> Column:
    year, month = _int(g[3]), _month_number(g[2])
    second = F.when(g[6] == "", F.lit(0)).otherwise(_int(g[6]))
    # A day past the end of a short month means its last day: the mail format is read leniently.
    last = F.dayofmonth(F.last_day(F.try_make_timestamp_ntz(
        year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")))
    day = F.when(_int(g[1]).between(1, 31), F.least(_int(g[1]), last))
    moment = F.when(second < 60, F.try_make_timestamp_ntz(year, month, day, _int(g[4]), _int(g[5]), second))
    named_day = F.array_position(F.array(*[F.lit(d.lower()) for d in WEEKDAYS.split("|")]), F.lower(g[0])) - 1
    return let(moment, lambda ts: F.when((g[0] == "") | (named_day == F.weekday(ts.cast("date"))), ts))


def _iso_date(g: Column) -> Column:
    second = F.concat(
        F.when(g[5] == "", F.lit("00")).otherwise(g[5]), F.lit("."), F.rpad(F.substring(g[6], 1, 6), 6, "0"),
    ).try_cast("decimal(8,6)")
    return let(second, lambda sec: F.when(sec < 60, F.try_make_timestamp_ntz(
        _int(g[0]), _int(g[1]), _int(g[2]), _int(g[3]), _int(g[4]), sec)))


def parse_feed_date(text: Column) -> Column:
    """Mail format first, then ISO with or without zone; NULL when neither fits."""
    return F.when(text.rlike(MAIL), let(_groups(text, MAIL, 7), _mail_date)).when(
        text.rlike(ISO), let(_groups(text, ISO, 7), _iso_date))
