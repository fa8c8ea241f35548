from datetime import datetime

from pyspark.sql import functions as F

from faultlens.functions import rules

IOSCLI = {
    "rc = 10": True,
    "rc = -1": True,
    "rc = 5": False,
    "rc =  5": True,
    "rc =  0": True,
    "rc = 0": False,
    "rc = x9": True,
    "src = 22": True,
    "rc= 22": False,
    "RC = 22": False,
    "rc\t=\t22": True,
    "nothing": False,
    "": False,
}
POOL = {
    "rc=1 done": True,
    "rc=1": False,
    "rc=10 done": False,
    "rc=-1 done": False,
    "rc=  x": True,
    "rc=0 done": False,
    "rc = 1 done": False,
    "rc=0 then rc=7 done": True,
}
VIOCMD = {
    "rc 10": True,
    "rc -1": True,
    "rc 5": False,
    "rc  5": True,
    "rc  0": True,
    "rc 0": False,
    "rc = 10": False,
    "rc=10": False,
}
STRICT = {
    "rc = 5": True,
    "rc=1": True,
    "rc 22": True,
    "rc=-3": True,
    "rc = 0": False,
    "rc=000": False,
    "rc=007": True,
    "rc  0": False,
    "src = 5": False,
    "rc = x9": False,
    "rc=99999999999999999999": True,
}


def check(apply, rule, cases):
    assert dict(zip(cases, apply(rule, cases))) == cases


def test_ioscli_errors(apply):
    check(apply, rules.ioscli_error, IOSCLI)


def test_pool_errors(apply):
    check(apply, rules.pool_error, POOL)


def test_viocmd_errors(apply):
    check(apply, rules.viocmd_error, VIOCMD)


def test_strict_errors(apply):
    for rule in (rules.ioscli_error, rules.pool_error, rules.viocmd_error):
        check(
            apply,
            lambda line: rule(line, strict=True),
            {k: v for k, v in STRICT.items() if rule is not rules.pool_error or "rc=" in k},
        )


def test_marks_are_case_sensitive(apply):
    check(apply, rules.syslog_error, {"x caa:err y": True, "CAA:ERR": False, "caa:error": True})
    check(apply, rules.cfglog_error, {"an Error": True, "error": False, "ERROR": False})


def test_command_markers(apply):
    cases = {
        "Command pv  Started at >>>>>> x": True,
        "Command pv Started at x": None,
        "Command pv  Started at": None,
        "Command pv Ended at x": False,
        "Command pv  Ended at x": None,
        "Command lv  Started at x": None,
        "Command pv Ended at Command pv  Started at ": True,
        "other": None,
    }
    check(apply, lambda line: rules.command_marker(line, "pv"), cases)


def test_command_name_is_literal(apply):
    check(
        apply,
        lambda line: rules.is_command_start(line, "p.v*"),
        {"Command p.v*  Started at ": True, "Command pxvv  Started at ": False},
    )


def test_first_match(apply):
    found = apply(lambda line: rules.first_match(line, r"\d+"), ["a 12 b 34", "none"])
    assert found == ["12", None]


def test_window_includes_its_ends(spark):
    day = [datetime(2024, 1, n) for n in range(1, 6)]
    cases = [
        (day[0], day[1], day[3], False),
        (day[1], day[1], day[3], True),
        (day[2], day[1], day[3], True),
        (day[3], day[1], day[3], True),
        (day[4], day[1], day[3], False),
        # backwards: the two ends only
        (day[1], day[3], day[1], True),
        (day[2], day[3], day[1], False),
        (day[3], day[3], day[1], True),
    ]
    rows = spark.createDataFrame(
        cases, "t timestamp_ntz, s timestamp_ntz, e timestamp_ntz, expected boolean"
    )
    inside = rules.in_window(F.col("t"), F.col("s"), F.col("e"))
    assert rows.filter(inside != F.col("expected")).count() == 0


def test_unknown_layer_has_no_rule(apply):
    found = apply(
        lambda layer: rules.by_layer(layer, rules.error_rules(F.lit("Error"))),
        ["cfglog", "pool.log", "other"],
    )
    assert found == [True, False, None]
