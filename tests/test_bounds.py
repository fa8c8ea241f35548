from datetime import datetime, timezone

from pyspark.sql import functions as F

from faultlens.operators.bounds import command_bounds, with_bounds

AS_OF = "2020-01-01 00:00:00"
NOW = datetime(2020, 1, 1)


def start(hour, day=10):
    return f"Command pv  Started at >>>>>> Oct  {day} 2015, Sat, {hour:02}:00:00"


def end(hour, day=10):
    return f"Command pv Ended at >>>>>> Oct  {day} 2015, Sat, {hour:02}:00:00"


def at(hour):
    return datetime(2015, 10, 10, hour)


def spans(found):
    return {
        row.source_dir: (row.node, row.start_ts, row.end_ts)
        for row in found.collect()
    }


LOGS = {
    "both/ioscli_global.trace.n1": ["x", start(3), "y", end(4), start(1), end(9)],
    "end-first/ioscli_global.trace.n2": [end(2), start(3), end(4)],
    "no-end/ioscli_global.trace.n3": [start(3)],
    "no-start/ioscli_global.trace.n4": [end(3)],
    "no-markers/ioscli_global.trace.n5": ["x"],
    "unreadable/ioscli_global.trace.n6": ["Command pv  Started at sometime", start(3), end(5)],
    "two-logs/ioscli_a.n7": [start(1), end(2)],
    "two-logs/ioscli_b.n8": [start(5), end(6)],
    "last-empty/ioscli_a.n9": [start(1), end(2)],
    "last-empty/ioscli_b.n9": ["x"],
    "no-marker-log/pool.log.n1": [start(3), end(4)],
}
WANTED = {
    "both": ("n1", at(3), at(4)),
    "end-first": ("n2", at(3), at(2)),
    "no-end": ("n3", at(3), NOW),
    "no-start": ("n4", NOW, at(3)),
    "no-markers": ("n5", NOW, NOW),
    "unreadable": ("n6", NOW, at(5)),
    "two-logs": ("n8", at(5), at(6)),
    "last-empty": ("n9", NOW, NOW),
}


def test_command_bounds(log_table):
    assert spans(command_bounds(log_table(LOGS), as_of=AS_OF)) == WANTED


def test_order_goes_over_blocks_and_parts(log_table):
    lines = log_table({"d/ioscli.n1": [start(1), start(2), start(3), start(4)]})
    hour = F.col("row_id")
    # lines in reverse: the later, the smaller the part and the block
    shuffled = lines.withColumns(
        {
            "part": F.when(hour < 2, "part-1").otherwise("part-0"),
            "block_start": F.when(hour % 2 == 0, 100).otherwise(0).cast("bigint"),
        }
    )
    assert spans(command_bounds(shuffled, as_of=AS_OF)) == {"d": ("n1", at(4), NOW)}


def test_catalogue_adds_logs_without_lines(spark, log_table):
    lines = log_table({"d/ioscli_a.n1": [start(1), end(2)]})
    catalog = spark.createDataFrame(
        [
            ("d", "d/ioscli_a.n1", "ioscli_a.n1"),
            ("d", "d/ioscli_z.n1", "ioscli_z.n1"),
            ("e", "e/ioscli_a.n2", "ioscli_a.n2"),
            ("f", "f/pool.log.n2", "pool.log.n2"),
        ],
        "source_dir string, path string, file_name string",
    )
    found = spans(command_bounds(lines, as_of=AS_OF, catalog=catalog))
    assert found == {"d": ("n1", NOW, NOW), "e": ("n2", NOW, NOW)}


def test_now_stands_in_without_as_of(log_table):
    found = command_bounds(log_table({"d/ioscli.n1": [start(1)]})).collect()[0]
    assert found.start_ts == at(1)
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    assert abs((now - found.end_ts).total_seconds()) < 600


def test_every_line_gets_the_bounds_of_its_directory(log_table):
    lines = log_table(LOGS)
    found = with_bounds(lines, command_bounds(lines, as_of=AS_OF), AS_OF)
    rows = found.select("path", "source_dir", "row_id", "start_ts", "end_ts").collect()
    assert len(rows) == sum(map(len, LOGS.values()))
    for row in rows:
        wanted = WANTED.get(row.source_dir, ("", NOW, NOW))
        assert (row.start_ts, row.end_ts) == wanted[1:]
