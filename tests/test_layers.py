import pytest
from pyspark.sql import functions as F

from faultlens.model import CFGLOG, IOSCLI, LAYERS, POOL, SYSLOG, VIOCMD, Options
from faultlens.plans.layers import analyze_layer, dispatch_errors

AS_OF = "2020-01-01 00:00:00"
SPAN = ("2015-10-10 03:00:00", "2015-10-10 04:00:00")
START = "Command pv  Started at >>>>>> Oct  10 2015, Sat, 03:00:00"
END = "Command pv Ended at >>>>>> Oct  10 2015, Sat, 04:00:00"

LOGS = {
    "d1/ioscli_global.trace.n1": [
        "before rc = 22", START, "a rc = 22", "b rc = 0", END, "c rc = 22", START, "d rc = 33",
    ],
    # 1444446000 is 03:00, 1444449600 is 04:00
    "d1/pool.log.n1": [
        "p:1444445999: rc=1 x", "p:1444446000: rc=1 x", "p:1444447000: rc=0 x",
        "p:1444449600: rc=1 x", "p:1444449601: rc=1 x", "rc=1 x",
    ],
    "d1/vioCmd.log.n1": [
        "Oct 10 2015, 02:59:59 rc 22", "Oct 10 2015, 03:00:00 rc 22",
        "Oct 10 2015, 03:30:00 rc 0", "Oct 10 2014, 03:30:00 rc 22", "rc 22",
    ],
    "d1/syslog.caa.n1": [
        "Oct 10 02:59:59 caa:err", "Oct 10 03:30:00 caa:err", "Oct 10 03:30:00 caa:info",
        "caa:err",
    ],
    "d1/cfglog.n1": ["an Error", "no error", "Error again"],
    "d1/other.log.n1": ["an Error rc = 22 caa:err", START],
    # no command trace: only the configuration log reports
    "d2/pool.log.n2": ["p:1444446000: rc=1 x"],
    "d2/vioCmd.log.n2": ["Jan 1 2020, 00:00:00 rc 22", "Jan 1 2020, 00:00:01 rc 22"],
    "d2/syslog.caa.n2": ["Jan 1 00:00:00 caa:err", "Jan 2 00:00:00 caa:err"],
    "d2/cfglog.n2": ["Error"],
}
WANTED = {
    ("n1", IOSCLI): [2, 7],
    ("n1", POOL): [1, 3],
    ("n1", VIOCMD): [1],
    ("n1", SYSLOG): [1],
    ("n1", CFGLOG): [0, 2],
    # exactly "now" still counts
    ("n2", VIOCMD): [0],
    ("n2", SYSLOG): [0],
    ("n2", CFGLOG): [0],
}


def found(errors):
    rows = {}
    for row in errors.select("node", "layer", "row_id").collect():
        rows.setdefault((row.node, row.layer), []).append(row.row_id)
    return {key: sorted(ids) for key, ids in rows.items()}


def test_dispatch(log_table):
    errors = dispatch_errors(log_table(LOGS), as_of=AS_OF)
    assert found(errors) == WANTED


@pytest.mark.parametrize("layer", LAYERS)
def test_one_layer(log_table, layer):
    errors = found(analyze_layer(log_table(LOGS), layer, as_of=AS_OF))
    assert errors == {key: ids for key, ids in WANTED.items() if key[1] == layer}


def test_unknown_layer_yields_nothing(log_table):
    errors = analyze_layer(log_table(LOGS), "other.log", as_of=AS_OF)
    assert errors.count() == 0
    assert "event_ts" in errors.columns


def test_given_span_is_that_of_all_directories(log_table):
    errors = found(dispatch_errors(log_table(LOGS), bounds=SPAN))
    assert errors[("n2", POOL)] == [0]
    assert ("n2", VIOCMD) not in errors
    assert errors[("n1", POOL)] == [1, 3]


def syslog(log_table, lines, span, **options):
    errors = dispatch_errors(
        log_table({"d/syslog.caa.n": lines}), bounds=span, options=Options(**options)
    )
    return [(row.row_id, str(row.event_ts)) for row in errors.orderBy("row_id").collect()]


NEW_YEAR = ("2015-12-31 12:00:00", "2016-01-01 12:00:00")
AROUND = [
    "Dec 31 11:00:00 caa:err", "Dec 31 12:00:00 caa:err", "Dec 31 13:00:00 caa:err",
    "Jan 1 11:00:00 caa:err", "Jan 1 12:00:00 caa:err", "Jan 1 13:00:00 caa:err",
]


def test_span_over_new_year_matches_its_ends_only(log_table):
    assert syslog(log_table, AROUND, NEW_YEAR) == [
        (1, "1970-12-31 12:00:00"), (4, "1970-01-01 12:00:00"),
    ]


def test_year_can_be_inferred(log_table):
    assert syslog(log_table, AROUND, NEW_YEAR, infer_year=True) == [
        (1, "2015-12-31 12:00:00"), (2, "2015-12-31 13:00:00"),
        (3, "2016-01-01 11:00:00"), (4, "2016-01-01 12:00:00"),
    ]
    leap = ("2016-02-28 00:00:00", "2016-03-02 00:00:00")
    day = ["Feb 29 10:00:00 caa:err"]
    assert syslog(log_table, day, leap, infer_year=True) == [(0, "2016-02-29 10:00:00")]
    assert syslog(log_table, day, leap) == [(0, "1970-03-01 10:00:00")]


def test_options_reach_the_rules(log_table):
    logs = {
        "d/vioCmd.log.n": ["September 3 2015, 00:00:00 rc 22", "Sep 3 2015, 00:00:00 rc 5"],
        "d/ioscli_global.trace.n": [
            START, "rc = 5", "Command pv Ended at >>>>>> Oct  10 2015, Sat, 12:30:00",
        ],
        "d/pool.log.n": ["p:1444478400: rc=1 x"],  # 12:00
    }
    lines = log_table(logs)
    span = ("2015-09-01", "2015-09-30")
    assert (
        found(dispatch_errors(lines, bounds=span, options=Options(all_months=True)))
        == {("n", VIOCMD): [0]}
    )
    strict = found(dispatch_errors(lines, bounds=span, options=Options(strict=True)))
    assert strict == {("n", VIOCMD): [1], ("n", IOSCLI): [1]}
    assert ("n", POOL) not in found(dispatch_errors(lines, as_of=AS_OF))
    noon = found(dispatch_errors(lines, as_of=AS_OF, options=Options(fix_noon=True)))
    assert noon == {("n", POOL): [0]}


def test_hot_directory_keeps_every_line(spark, log_table):
    lines = log_table({"hot/cfglog.n": [f"Error {n}" for n in range(3000)]})
    errors = dispatch_errors(lines, as_of=AS_OF)
    assert errors.count() == 3000
    assert errors.select("row_id").distinct().count() == 3000
    assert errors.filter(F.col("event_ts").isNotNull()).count() == 0


def test_marker_logs_without_markers_count_in_one_pass(log_table):
    logs = LOGS | {"d1/zz_ioscli.n1": ["no marker"]}
    # the log listed last has no markers, so both bounds are "now"
    found = analyze_layer(log_table(logs), POOL, as_of=AS_OF).collect()
    assert found == [] and analyze_layer(log_table(LOGS), POOL, as_of=AS_OF).count() == 2
    assert analyze_layer(log_table({"d/cfglog.n": ["Error"]}), POOL, as_of=AS_OF).count() == 0
