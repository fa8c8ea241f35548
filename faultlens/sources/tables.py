"""Log lines rendered from tables, for queries that start from parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions.rules import by_layer
from faultlens.model import CFGLOG, IOSCLI, LINE_COLUMNS, POOL, SYSLOG, VIOCMD
from faultlens.runtime import computed_once

NODES = 4  # nodes in the rendered logs, and directories, as one belongs to each
RUNS = 3  # directories that hold a log of each node and layer in turn

# In the lines of a long command, its end is not marked before this, and on the
# last node not at all; one node has no errors in its configuration log.
LATE_END = "2024-01-16 00:00:00"

CATALOG_COLUMNS = ("source_dir", "path", "file_name", "node", "layer")


def _log_names(rows: DataFrame) -> DataFrame:
    """Add the names of the log ``layer.node`` to rows with node and layer."""
    path = F.concat_ws(".", "layer", "node")
    return rows.withColumns({"source_dir": F.col("node"), "path": path, "file_name": path})


def _log_lines(rows: DataFrame, line: Column) -> DataFrame:
    """Named rows with ``row_id`` as log lines in one block per log."""
    placed = rows.withColumns({"part": F.lit(""), "block_start": F.lit(0).cast("bigint")})
    return computed_once(placed, "line", line).select(*LINE_COLUMNS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        "ts",
        "event_type",
        (F.col("user_id") % NODES).alias("node_number"),
        (F.col("event_id") % 5).alias("layer_number"),
    )


def _named(events: DataFrame) -> DataFrame:
    number = F.col("layer_number")
    layer = (
        F.when(number == 0, POOL)
        .when(number == 1, IOSCLI)
        .when(number == 2, VIOCMD)
        .when(number == 3, SYSLOG)
        .otherwise(CFGLOG)
    )
    node = F.concat(F.lit("node"), (F.col("node_number") + 1).cast("string"))
    return _log_names(events.withColumns({"node": node, "layer": layer}))


def event_log_lines(spark: SparkSession, sf_dir: str, long_command: bool = False) -> DataFrame:
    """One log line per event: five layers, four nodes, positions from the event id."""
    events = _named(_events(spark, sf_dir)).withColumn("row_id", F.col("event_id"))
    return _log_lines(events, _event_line(long_command))


def _event_line(long_command: bool = False) -> Column:
    """The text of an event's line. ``long_command``: first start and first end lie far apart."""
    ts, kind = F.col("ts"), F.col("event_type")
    failed = kind == "error"
    if long_command:
        failed = failed & ~((F.col("layer_number") == 4) & (F.col("node_number") == 2))
    code = F.when(failed, 10 + F.col("event_id") % 89).otherwise(0).cast("string")
    command = F.date_format(ts, "MMM  dd yyyy, EEE, HH:mm:ss")
    midnight = F.unix_date(F.to_date(ts)).cast("bigint") * 86400
    ends = kind == "purchase"
    if long_command:
        late = ts >= F.lit(LATE_END).cast("timestamp_ntz")
        ends = ends & late & (F.col("node_number") < NODES - 1)
    epoch = (midnight + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("string")
    shapes = {
        POOL: F.concat(
            F.lit("p:"), epoch, F.lit(": op rc="), F.when(failed, "1").otherwise("0"), F.lit(" done")
        ),
        IOSCLI: F.when(
            kind == "signup", F.concat(F.lit("Command pv  Started at >>>>>> "), command)
        )
        .when(ends, F.concat(F.lit("Command pv Ended at >>>>>> "), command))
        .otherwise(F.concat(F.lit("call rc = "), code)),
        VIOCMD: F.concat(F.date_format(ts, "MMM d yyyy, HH:mm:ss"), F.lit(" vio rc "), code),
        SYSLOG: F.concat(
            F.date_format(ts, "MMM d HH:mm:ss"),
            F.lit(" host "),
            F.when(failed, "caa:err").otherwise("caa:info"),
            F.lit(" x"),
        ),
        CFGLOG: F.concat(F.lit("cfg "), F.when(failed, "Error").otherwise("ok")),
    }
    return by_layer(F.col("layer"), shapes)


def latest_run_lines(
    spark: SparkSession, sf_dir: str, latest: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Lines of logs spread over the directories of several runs, of the latest logs only.

    The logs are told apart and chosen by numbers, before a line is rendered.
    """
    run = (F.col("event_id") % RUNS).alias("run_number")
    keys = ["node_number", "layer_number", "run_number"]
    events = _events(spark, sf_dir).select("*", run)

    def placed(rows: DataFrame) -> DataFrame:
        source = F.concat(F.lit("run"), (F.col("run_number") + 1).cast("string"))
        return _named(rows).withColumns({"source_dir": source, "path": F.concat_ws("/", source, "path")})

    catalog = placed(events.select(*keys).distinct())
    kept = catalog.select(*keys, "node", "layer", "path")
    kept = kept.join(latest(catalog), ["node", "layer", "path"], "left_semi").select(*keys)
    chosen = placed(events.join(kept, keys, "left_semi")).withColumn("row_id", F.col("event_id"))
    return _log_lines(chosen, _event_line())


def run_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the logs of several runs, a directory each: every run has all nodes and
    layers, but for the first one, whose last node has no logs."""
    run = F.col("event_id") % RUNS
    events = _events(spark, sf_dir).withColumn("run_number", run)
    events = events.filter((run > 0) | (F.col("node_number") < NODES - 1))
    source = F.concat(F.lit("run"), (F.col("run_number") + 1).cast("string"))
    named = _named(events).withColumns({"source_dir": source, "path": F.concat_ws("/", source, "path")})
    return _log_lines(named.withColumn("row_id", F.col("event_id")), _event_line(True))


def event_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs of :func:`event_log_lines`, told apart by number before they are named."""
    logs = _events(spark, sf_dir).select("node_number", "layer_number").distinct()
    return _named(logs).select(*CATALOG_COLUMNS)


def order_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dated line per order, with short and long month names in turn."""
    key = F.col("o_orderkey")
    zero = F.lit(0)
    ts = F.col("o_orderdate") + F.make_dt_interval(zero, zero, zero, key % 86400)
    stamp = F.when(key % 2 == 0, F.date_format(ts, "MMM d yyyy, HH:mm:ss")).otherwise(
        F.date_format(ts, "MMMM d yyyy, HH:mm:ss")
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey",
        "o_orderdate",
        F.concat(F.lit("node"), (F.col("o_custkey") % NODES + 1).cast("string")).alias("node"),
        F.lit(VIOCMD).alias("layer"),
        key.alias("row_id"),
    )
    return _log_lines(_log_names(orders), F.concat(stamp, F.lit(" vio rc 11")))
