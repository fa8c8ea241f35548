"""Time stamps found in log lines, as TIMESTAMP_NTZ wall clock.

Fields are cut out by regular expression and added up, so that values beyond
their range roll over (February 31 is March 3) and nothing depends on the
session time zone. A line without a stamp yields NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens.model import POOL, SYSLOG, VIOCMD

# The month names line stamps may carry.
LINE_MONTHS = "Jan|Feb|March|April|May|June|July|Aug|Sep|Oct|Nov|Dec"

# Every English month name, short or long.
ALL_MONTHS = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?"
    "|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)
WEEKDAYS = (
    "Sun(?:day)?|Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?"
    "|Sat(?:urday)?"
)

# The shapes of the stamps.
EPOCH_STAMP = r":(\d{10}):"
DATED_STAMP = r"(?:{months})\s+\d{{1,2}}\s+\d{{4}},\s+\d{{2}}:\d{{2}}:\d{{2}}"
YEARLESS_STAMP = r"(?:{months})\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}"
COMMAND_STAMP = (
    rf"(?i:{ALL_MONTHS})  [ \t]*\d+ [ \t]*\d+, (?i:{WEEKDAYS}), "
    r"[ \t]*\d+:[ \t]*\d+:[ \t]*\d+"
)
STARTED = "Started at"
ENDED = "Ended at"
ARROW = ">>>>>>"

EPOCH_YEAR = 1970
MAX_SECONDS = 10**12  # what an interval of seconds may hold
LEAP_YEAR = 2000  # keeps February 29 until the real year is known
_MONTH_ORDER = "janfebmaraprmayjunjulaugsepoctnovdec"


def dated_pattern(all_months: bool = False) -> str:
    return DATED_STAMP.format(months=ALL_MONTHS if all_months else LINE_MONTHS)


def yearless_pattern(all_months: bool = False) -> str:
    return YEARLESS_STAMP.format(months=ALL_MONTHS if all_months else LINE_MONTHS)


def command_pattern(verb: str) -> str:
    """The stamp behind the last verb and, from there, behind the last arrow.

    A verb or arrow counts if anything but its like follows to the end of the line.
    """

    def no_later(token: str) -> str:
        return f"(?!.*{token}(?!(?:{token})*$))"

    return f"{verb}{no_later(verb)}(?:.*{ARROW})?{no_later(ARROW)} ({COMMAND_STAMP})(?:\\D|$)"


def _month_number(name: Column) -> Column:
    short = F.lower(F.left(name, F.lit(3)))
    return ((F.position(short, F.lit(_MONTH_ORDER)) + 2) / 3).cast("int")


def _wall_clock(
    year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column
) -> Column:
    zero = F.lit(0)
    month_start = F.try_make_timestamp_ntz(year.cast("int"), month, F.lit(1), zero, zero, zero)
    # Days are counted in seconds like the rest; a sum beyond all times is NULL.
    seconds = ((day - 1) * 24 + hour) * 3600 + minute * 60 + second
    shift = F.when(F.abs(seconds) < MAX_SECONDS, seconds).cast("decimal(18,6)")
    return F.try_add(month_start, F.make_dt_interval(zero, zero, zero, shift))


def _from_fields(text: Column, build: Callable[[Column, Callable[[int], Column]], Column]) -> Column:
    """Split a stamp into its fields once and build the time from them."""
    fields = F.split(text, r"[\s,:]+")
    one = F.transform(
        F.array(fields), lambda parts: build(parts, lambda i: F.get(parts, F.lit(i)).try_cast("int").cast("bigint"))
    )
    return F.get(one, F.lit(0))


def epoch_ts(line: Column) -> Column:
    """First ``:<ten digits>:`` as seconds since 1970."""
    digits = F.nullif(F.regexp_extract(line, EPOCH_STAMP, 1), F.lit(""))
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), digits.cast("decimal(18,6)"))
    return F.lit("1970-01-01").cast("timestamp_ntz") + seconds


def dated_ts(line: Column, all_months: bool = False) -> Column:
    """First ``Mon d yyyy, HH:MM:SS``."""
    return _from_fields(
        F.regexp_extract(line, dated_pattern(all_months), 0),
        lambda parts, number: _wall_clock(
            number(2), _month_number(parts[0]), number(1), number(3), number(4), number(5)
        ),
    )


def yearless_ts(line: Column, all_months: bool = False, year: int = EPOCH_YEAR) -> Column:
    """First ``Mon d HH:MM:SS``, in the given year."""
    return _from_fields(
        F.regexp_extract(line, yearless_pattern(all_months), 0),
        lambda parts, number: _wall_clock(
            F.lit(year), _month_number(parts[0]), number(1), number(2), number(3), number(4)
        ),
    )


def command_ts(line: Column, verb: str, fix_noon: bool = False) -> Column:
    """The stamp ``Mon  dd yyyy, EEE, hh:mm:ss`` behind a command marker.

    The hours are those of a 12-hour clock without AM or PM: 12 reads as 0
    unless ``fix_noon``, while 13 to 23 stay as they are.
    """

    def build(parts: Column, number: Callable[[int], Column]) -> Column:
        hour = number(4) if fix_noon else F.when(number(4) == 12, 0).otherwise(number(4))
        return _wall_clock(
            number(2), _month_number(parts[0]), number(1), hour, number(5), number(6)
        )

    return _from_fields(F.regexp_extract(line, command_pattern(verb), 1), build)


def project_yearless(stamp: Column) -> Column:
    """Move an instant to the year 1970, cut to seconds; February 29 becomes March 1."""
    return _wall_clock(
        F.lit(EPOCH_YEAR),
        F.month(stamp),
        F.dayofmonth(stamp),
        F.hour(stamp),
        F.minute(stamp),
        F.floor(F.second(stamp)),
    )


def move_to_year(stamp: Column, year: Column) -> Column:
    """Move a stamp to another year; February 29 becomes March 1 where there is none."""
    return _wall_clock(
        year, F.month(stamp), F.dayofmonth(stamp), F.hour(stamp), F.minute(stamp), F.second(stamp)
    )


def line_stamps(
    line: Column, all_months: bool = False, infer_year: bool = False
) -> dict[str, Column]:
    """The stamp of every layer that is filtered by time."""
    return {
        POOL: epoch_ts(line),
        VIOCMD: dated_ts(line, all_months),
        SYSLOG: yearless_ts(line, all_months, LEAP_YEAR if infer_year else EPOCH_YEAR),
    }
