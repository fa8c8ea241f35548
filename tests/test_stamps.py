from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultlens.functions import stamps

AT = datetime


def check(apply, function, cases):
    assert dict(zip(cases, apply(function, cases))) == cases


def test_epoch(apply):
    check(
        apply,
        stamps.epoch_ts,
        {
            "p:1444444444: op": AT(2015, 10, 10, 2, 34, 4),
            "p:2147483648: op": AT(2038, 1, 19, 3, 14, 8),
            "a:0000000001: b:1444444444:": AT(1970, 1, 1, 0, 0, 1),
            "p:144444444: nine": None,
            "p:14444444444: eleven": None,
            "1444444444": None,
        },
    )


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_stamps_do_not_depend_on_the_session_zone(spark, apply, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        check(apply, stamps.epoch_ts, {":1444444444:": AT(2015, 10, 10, 2, 34, 4)})
        # an hour that does not exist in New York
        check(
            apply, stamps.dated_ts, {"March 8 2015, 02:30:00": AT(2015, 3, 8, 2, 30)}
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


DATED = {
    "Oct 10 2015, 03:12:00 vio": AT(2015, 10, 10, 3, 12),
    "xOct  1   2015,  23:59:59": AT(2015, 10, 1, 23, 59, 59),
    "Feb 31 2015, 25:61:61": AT(2015, 3, 4, 2, 2, 1),
    "Feb 29 2016, 00:00:00": AT(2016, 2, 29),
    "Oct\t10\t2015,\t03:12:00": AT(2015, 10, 10, 3, 12),
    "Oct 00 2015, 00:00:00": AT(2015, 9, 30),
    "Jan 5 2015, 01:02:03 Feb 6 2016, 01:02:03": AT(2015, 1, 5, 1, 2, 3),
    "Oct 10 2015 03:12:00": None,
    "Oct 10 15, 03:12:00": None,
    "oct 10 2015, 03:12:00": None,
    "Oct 10 2015, 3:12:00": None,
    "": None,
}


def test_dated(apply):
    check(apply, stamps.dated_ts, DATED)


MONTHS = "January February March April May June July August September October November December"


def test_months_in_line_stamps(apply):
    long = MONTHS.split()
    texts = [f"{name} 3 2015, 00:00:00" for name in long] + [
        f"{name[:3]} 3 2015, 00:00:00" for name in long
    ]
    found = [t.month if t else None for t in apply(stamps.dated_ts, texts)]
    assert found[:12] == [None, None, 3, 4, 5, 6, 7, None, None, None, None, None]
    assert found[12:] == [1, 2, None, None, 5, None, None, 8, 9, 10, 11, 12]
    everything = apply(lambda line: stamps.dated_ts(line, all_months=True), texts)
    assert [t.month for t in everything] == [*range(1, 13), *range(1, 13)]


def test_yearless(apply):
    check(
        apply,
        stamps.yearless_ts,
        {
            "Oct 10 03:12:30 host": AT(1970, 10, 10, 3, 12, 30),
            "Feb 29 01:00:00": AT(1970, 3, 1, 1),
            "Dec 31 24:00:00": AT(1971, 1, 1),
            "Oct 10 2015, 03:12:30": None,
            "Apr 3 00:00:00": None,
        },
    )


START = {
    "Command pv  Started at >>>>>> Oct  10 2015, Sat, 03:11:12": AT(2015, 10, 10, 3, 11, 12),
    "Command pv  Started at Oct  10 2015, Sat, 03:11:12>>>>>>": AT(2015, 10, 10, 3, 11, 12),
    "Command pv  Started at Oct  10 2015, Sat, 03:11:12 ": AT(2015, 10, 10, 3, 11, 12),
    "Started at x Started at Oct  10 2015, Sat, 03:11:12": AT(2015, 10, 10, 3, 11, 12),
    "Started at anything >>>>>> Oct  10 2015, Sat, 03:11:12": AT(2015, 10, 10, 3, 11, 12),
    # wrong weekday, long and upper-case names, more blanks after the month
    "Started at Oct  10 2015, Mon, 03:11:12": AT(2015, 10, 10, 3, 11, 12),
    "Started at OCTOBER    7 2015, saturday, 3:1:2": AT(2015, 10, 7, 3, 1, 2),
    # a 12-hour clock without AM and PM
    "Started at Oct  10 2015, Sat, 12:30:00": AT(2015, 10, 10, 0, 30),
    "Started at Oct  10 2015, Sat, 13:30:00": AT(2015, 10, 10, 13, 30),
    "Started at Oct  10 2015, Sat, 00:30:00": AT(2015, 10, 10, 0, 30),
    "Started at Oct  10 2015, Sat, 24:00:00": AT(2015, 10, 11),
    "Started at Feb  31 2015, Sat, 01:00:00": AT(2015, 3, 3, 1),
    "Started at Oct  00010 2015, Sat, 000003:11:12": AT(2015, 10, 10, 3, 11, 12),
    "Started at Oct  10 2015, Sat, 00:00:100000": AT(2015, 10, 11, 3, 46, 40),
    "Started at Oct  99999999999 2015, Sat, 03:11:12": None,
    # unreadable
    "Started at  Oct  10 2015, Sat, 03:11:12": None,
    "Started at Oct 10 2015, Sat, 03:11:12": None,
    "Started at Oct  10 2015, Xyz, 03:11:12": None,
    "Started at Oct  10 2015,  Sat, 03:11:12": None,
    "Started at Foo  10 2015, Sat, 03:11:12": None,
    "Started at Oct  10 2015, Sat": None,
    "Started at ": None,
}


def test_command_stamp(apply):
    check(apply, lambda line: stamps.command_ts(line, stamps.STARTED), START)


def test_noon_can_be_fixed(apply):
    line = "Command pv Ended at >>>>>> Oct  10 2015, Sat, 12:30:00"
    read = lambda column: stamps.command_ts(column, stamps.ENDED, fix_noon=True)
    assert apply(read, [line]) == [AT(2015, 10, 10, 12, 30)]


def test_projection_to_1970(apply):
    check(
        apply,
        lambda text: stamps.project_yearless(text.cast("timestamp_ntz")),
        {
            "2015-10-10 03:11:12": AT(1970, 10, 10, 3, 11, 12),
            "2016-02-29 10:00:00": AT(1970, 3, 1, 10),
            "2015-12-31 23:59:59.750": AT(1970, 12, 31, 23, 59, 59),
        },
    )


def test_move_to_year(apply):
    moved = apply(
        lambda text: stamps.move_to_year(text.cast("timestamp_ntz"), F.lit(2016)),
        ["2000-02-29 01:02:03"],
    )
    assert moved == [AT(2016, 2, 29, 1, 2, 3)]
