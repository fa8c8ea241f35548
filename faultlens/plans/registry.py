"""Every operator as a query over the tables of one directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.functions.names import layer_of, node_of
from faultlens.functions.rules import (
    by_layer,
    error_rules,
    first_match,
    in_window,
    is_command_end,
    is_command_start,
)
from faultlens.functions.stamps import (
    ENDED,
    STARTED,
    command_ts,
    dated_pattern,
    dated_ts,
    epoch_ts,
    project_yearless,
    yearless_ts,
)
from faultlens.model import CFGLOG, DEFAULT_COMMAND, IOSCLI, POOL, SYSLOG, VIOCMD
from faultlens.operators import timed, views
from faultlens.operators.bounds import command_bounds, wall_clock, with_bounds
from faultlens.operators.brackets import within_command
from faultlens.plans import layers
from faultlens.plans.report import FaultReport, analyze_conf
from faultlens.runtime import new_shared_path, pin, written_once
from faultlens.sources import logs, sinks
from faultlens.sources.tables import (
    event_catalog,
    event_log_lines,
    latest_run_lines,
    order_log_lines,
    run_log_lines,
)

Query = Callable[[SparkSession, str], DataFrame]

# The span of the time filters, and the time that stands in for missing bounds.
SPAN = ("2024-01-05 00:00:00", "2024-01-20 00:00:00")
AS_OF = "2024-02-01 00:00:00"

# Lines per chunk of the bracket query: several chunks in each log.
BRACKET_CHUNK_BITS = 8


def as_text(stamp: str | Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")


def _rows(lines: DataFrame, *columns: str | Column) -> DataFrame:
    return lines.select("node", "layer", "row_id", *columns, "line")


def _stamped(lines: DataFrame) -> DataFrame:
    return _rows(lines, as_text("event_ts").alias("event_ts"))


def _of_layer(spark: SparkSession, sf_dir: str, layer: str) -> DataFrame:
    return event_log_lines(spark, sf_dir).filter(F.col("layer") == layer)


# Sources


def _rendered(
    spark: SparkSession, kind: str, sf_dir: str, lines: Callable[[], DataFrame], backwards: bool = False
) -> tuple[str, str]:
    """Lines as log directories, written once in a session; the root, and a file that lists the directories.

    ``backwards``: the list names the directories from the last to the first.
    """

    def write() -> tuple[str, str]:
        rows = lines()
        root, conf = (new_shared_path(spark, name) for name in ("logs", "dir-list"))
        sinks.write_log_dirs(rows, root)
        listed = F.concat(F.lit(f"{root}/source_dir="), "source_dir").alias("value")
        order = F.desc("value") if backwards else F.asc("value")
        # One file, a row per directory, in order.
        rows.select(listed).distinct().coalesce(1).sortWithinPartitions(order).write.text(conf)
        return root, conf

    return written_once(spark, (kind, sf_dir), write)


def _listed(spark: SparkSession, conf: str) -> list[str]:
    return [row.source_dir for row in logs.read_dir_list(spark, conf).collect()]


def scan_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written in many parts and scanned, numbered in their logs."""
    _, conf = _rendered(spark, "scan", sf_dir, lambda: event_log_lines(spark, sf_dir).repartition(8))
    found = logs.list_logs(spark, _listed(spark, conf)).select("path", "in_parts").collect()
    numbered = logs.number_lines(logs.scan_listed(spark, map(tuple, found)))
    return numbered.select("node", "layer", "line_number", "line")


def log_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with sizes, one of them empty, beside a nested backup that does not count."""

    def lines() -> DataFrame:
        return event_log_lines(spark, sf_dir).filter("path <> 'cfglog.node1'")

    def write() -> str:
        root, conf = _rendered(spark, "some", sf_dir, lines)
        node = f"{root}/source_dir=node1"
        nothing = spark.createDataFrame([], "value string")
        nothing.coalesce(1).write.text(f"{node}/log=cfglog.node1")
        backup = lines().filter("path = 'pool.log.node1'").select(F.col("line").alias("value"))
        backup.write.text(f"{node}/old/log=pool.log.node1")
        return conf

    conf = written_once(spark, ("catalog", sf_dir), write)
    found = logs.log_catalog(spark, _listed(spark, conf))
    return found.select("file_name", "node", "layer", "size")


def read_dir_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = new_shared_path(spark, "dir-list")
    found = event_catalog(spark, sf_dir).select("source_dir").distinct()
    found.write.text(conf)
    return logs.read_dir_list(spark, conf)


# Names


def _file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of several shapes, one per event."""
    node = F.concat(F.lit("node"), (F.col("user_id") % 12 + 1).cast("string"))
    shape = F.col("event_id") % 6
    name = (
        F.when(shape == 0, F.concat(F.lit("pool.log."), node))
        .when(shape == 1, F.concat(F.lit("a."), node, F.lit(".")))
        .when(shape == 2, F.concat(F.lit("x."), node, F.lit("0."), node))
        .when(shape == 3, F.concat(F.lit("x."), node, F.lit(".log."), node, F.lit("..")))
        .when(shape == 4, F.concat(F.lit("cfg"), node))
        .otherwise(F.concat(F.lit("syslog.caa."), node))
    )
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", name.alias("file_name"))


def derive_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_names(spark, sf_dir).withColumn("node", node_of(F.col("file_name")))


def derive_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_names(spark, sf_dir).withColumn("layer", layer_of(F.col("file_name")))


# Line rules


def command_start_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_log_lines(spark, sf_dir)
    return _rows(lines.filter(is_command_start(F.col("line"), DEFAULT_COMMAND)))


def command_end_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_log_lines(spark, sf_dir)
    return _rows(lines.filter(is_command_end(F.col("line"), DEFAULT_COMMAND)))


def _rule_query(layer: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = error_rules(F.col("line"))[layer]
        return _rows(_of_layer(spark, sf_dir, layer).filter(rule))

    return query


def first_regex_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = order_log_lines(spark, sf_dir)
    return lines.select("row_id", first_match(F.col("line"), dated_pattern()).alias("found"))


# Time


def pool_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _of_layer(spark, sf_dir, POOL)
    return _stamped(timed.pool_in_window(lines, *map(wall_clock, SPAN)))


def viocmd_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _of_layer(spark, sf_dir, VIOCMD)
    return _stamped(timed.viocmd_in_window(lines, *map(wall_clock, SPAN)))


def syslog_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _of_layer(spark, sf_dir, SYSLOG)
    return _stamped(timed.syslog_in_window(lines, *map(wall_clock, SPAN)))


def inclusive_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on whole days against a span that runs backwards for odd users."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    early, late = map(wall_clock, SPAN)
    forward = F.col("user_id") % 2 == 0
    spans = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        day.alias("day"),
        F.when(forward, early).otherwise(late).alias("start_ts"),
        F.when(forward, late).otherwise(early).alias("end_ts"),
    )
    inside = in_window(F.col("day"), F.col("start_ts"), F.col("end_ts"))
    return spans.filter(inside).select("event_id", as_text("day").alias("day"))


def parse_command_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    stamp = F.when(is_command_start(line, DEFAULT_COMMAND), command_ts(line, STARTED)).when(
        is_command_end(line, DEFAULT_COMMAND), command_ts(line, ENDED)
    )
    lines = _of_layer(spark, sf_dir, IOSCLI)
    return _rows(lines, as_text(stamp).alias("event_ts"))


def parse_epoch_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _of_layer(spark, sf_dir, POOL)
    return _rows(lines, as_text(epoch_ts(F.col("line"))).alias("event_ts"))


def parse_dated_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = order_log_lines(spark, sf_dir)
    return _rows(lines, as_text(dated_ts(F.col("line"))).alias("event_ts"))


def parse_yearless_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    undated = F.regexp_replace("line", r" \d{4},", "")
    lines = order_log_lines(spark, sf_dir).withColumn("line", undated)
    return _rows(lines, as_text(yearless_ts(F.col("line"))).alias("event_ts"))


def project_yearless_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0)
    moment = F.col("o_orderdate") + F.make_dt_interval(
        zero, zero, zero, F.col("o_orderkey") % 86400
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", as_text(project_yearless(moment)).alias("projected"))


# Command span and brackets


def command_bounds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = command_bounds(event_log_lines(spark, sf_dir, True), as_of=AS_OF)
    return bounds.select(
        "source_dir",
        "node",
        "command",
        as_text("start_ts").alias("start_ts"),
        as_text("end_ts").alias("end_ts"),
    )


def lines_with_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_log_lines(spark, sf_dir, True)
    bounded = with_bounds(lines, command_bounds(lines, as_of=AS_OF), AS_OF)
    return _rows(
        bounded, as_text("start_ts").alias("start_ts"), as_text("end_ts").alias("end_ts")
    )


def within_command_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pin(_of_layer(spark, sf_dir, IOSCLI))
    return _rows(within_command(lines, chunk_bits=BRACKET_CHUNK_BITS))


# Error lines


def _layer_query(layer: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = event_log_lines(spark, sf_dir)
        return _stamped(layers.analyze_layer(lines, layer, bounds=SPAN))

    return query


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.dispatch_errors(event_log_lines(spark, sf_dir), bounds=SPAN)


def _run_errors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Errors within the spans found in the logs themselves, and the logs."""
    lines = event_log_lines(spark, sf_dir, True)
    catalog = event_catalog(spark, sf_dir)
    return layers.dispatch_errors(lines, as_of=AS_OF, catalog=catalog), catalog


def _file_report(spark: SparkSession, sf_dir: str) -> FaultReport:
    """The whole run over files: lines written out of order in many parts, a directory list."""
    _, conf = _rendered(spark, "run", sf_dir, lambda: event_log_lines(spark, sf_dir, True).repartition(8))
    return analyze_conf(spark, conf, as_of=AS_OF)


def dispatch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(_errors(spark, sf_dir))


def dispatch_errors_in_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(_run_errors(spark, sf_dir)[0])


def errors_for_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(views.errors_for_node(_errors(spark, sf_dir), "node1"))


def errors_for_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup by layer asks for that layer alone."""
    lines = event_log_lines(spark, sf_dir)
    return _stamped(views.errors_for_layer(layers.analyze_layer(lines, POOL, bounds=SPAN), POOL))


def errors_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors, catalog = _run_errors(spark, sf_dir)
    return views.errors_by_node(errors, "node4", catalog)


def errors_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors per node of the system log, nodes without any included."""
    lines = event_log_lines(spark, sf_dir, True)
    errors = layers.analyze_layer(lines, SYSLOG, as_of=AS_OF)
    return views.errors_by_layer(errors, SYSLOG, event_catalog(spark, sf_dir))


def error_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.error_matrix(_errors(spark, sf_dir))


def error_matrix_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.error_matrix(*_run_errors(spark, sf_dir))


def count_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.count_report(views.error_matrix(*_run_errors(spark, sf_dir)))


def count_report_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as it stands in the files of a run."""
    out = new_shared_path(spark, "report")
    sinks.write_count_report(views.error_matrix(*_run_errors(spark, sf_dir)), out)
    return spark.read.text(out).select("view", "heading", F.col("value").alias("report_line"))


def error_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = views.error_details(_errors(spark, sf_dir))
    return details.select(
        "heading", "node", "layer", "row_id", as_text("event_ts").alias("event_ts"), "line"
    )


def error_details_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error lines written as text and read back, numbered as they stand in the files."""
    out = new_shared_path(spark, "details")
    sinks.write_error_details(_run_errors(spark, sf_dir)[0], out, "text")
    read = spark.read.text(out).select(
        "node",
        "layer",
        logs.part_key(F.col("_metadata.file_name")).alias("part"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("value").alias("line"),
    )
    order = Window.partitionBy("node", "layer").orderBy("part", "block_start", "row_id")
    return pin(read).withColumn("nth", F.row_number().over(order).cast("bigint")).select("node", "layer", "nth", "line")


def ioscli_error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_log_lines(spark, sf_dir)
    found = views.ioscli_error_lines(layers.analyze_layer(lines, IOSCLI))
    return found.select("node", "row_id", "line")


def latest_file_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error lines by rule alone, of the latest of the logs in the directories of three runs."""
    lines = latest_run_lines(spark, sf_dir, views.latest_logs)
    return _rows(lines.filter(by_layer(F.col("layer"), error_rules(F.col("line")))), "path")


def last_wins_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the directories of several runs that hold the same logs, listed from the last to the
    first: of each node and layer, the log of the directory listed last counts."""
    lines = lambda: run_log_lines(spark, sf_dir).repartition(8)
    _, conf = _rendered(spark, "runs", sf_dir, lines, backwards=True)
    report = analyze_conf(spark, conf, as_of=AS_OF, on_duplicate="last")
    run = F.regexp_extract("source_dir", r"source_dir=([^/]*)$", 1).alias("run")
    return report.details().join(report.catalog.select("source_dir", "path"), "path").select("node", "layer", run, "line")


def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a run over log files, from the list of directories to both views."""
    return _file_report(spark, sf_dir).counts()


def full_run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table of lines."""
    return views.count_report(views.error_matrix(*_run_errors(spark, sf_dir)))


def full_run_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error lines of the run over log files, each pair numbered in line order."""
    details = _file_report(spark, sf_dir).details()
    order = Window.partitionBy("node", "layer").orderBy("path", "part", "block_start", "row_id")
    return details.withColumn("nth", F.row_number().over(order).cast("bigint")).select("node", "layer", "nth", "line")


def full_run_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors kept once and used twice: the lines of each layer beside their count."""
    with _file_report(spark, sf_dir).persist() as report:
        counts = report.matrix().withColumnRenamed("errors", "of_pair")
        both = report.details().select("node", "layer", "line").join(counts, ["node", "layer"])
        return pin(both)


QUERIES: dict[str, Query] = {
    "scan_log_lines": scan_log_lines,
    "log_catalog": log_catalog,
    "read_dir_list": read_dir_list,
    "derive_node": derive_node,
    "derive_layer": derive_layer,
    "command_start_lines": command_start_lines,
    "command_end_lines": command_end_lines,
    "ioscli_rc_errors": _rule_query(IOSCLI),
    "pool_rc_errors": _rule_query(POOL),
    "viocmd_rc_errors": _rule_query(VIOCMD),
    "syslog_caa_errors": _rule_query(SYSLOG),
    "cfglog_errors": _rule_query(CFGLOG),
    "first_regex_match": first_regex_match,
    "pool_in_window": pool_in_window,
    "viocmd_in_window": viocmd_in_window,
    "syslog_in_window": syslog_in_window,
    "inclusive_window": inclusive_window,
    "parse_command_ts": parse_command_ts,
    "parse_epoch_ts": parse_epoch_ts,
    "parse_dated_ts": parse_dated_ts,
    "parse_yearless_ts": parse_yearless_ts,
    "project_yearless": project_yearless_ts,
    "command_bounds": command_bounds_query,
    "lines_with_bounds": lines_with_bounds,
    "within_command": within_command_query,
    "analyze_ioscli": _layer_query(IOSCLI),
    "analyze_pool": _layer_query(POOL),
    "analyze_viocmd": _layer_query(VIOCMD),
    "analyze_syslog": _layer_query(SYSLOG),
    "analyze_cfglog": _layer_query(CFGLOG),
    "dispatch_errors": dispatch_errors,
    "dispatch_errors_in_run": dispatch_errors_in_run,
    "errors_for_node": errors_for_node,
    "errors_for_layer": errors_for_layer,
    "errors_by_node": errors_by_node,
    "errors_by_layer": errors_by_layer,
    "error_matrix": error_matrix,
    "error_matrix_zero_filled": error_matrix_zero_filled,
    "count_report": count_report,
    "count_report_written": count_report_written,
    "error_details": error_details,
    "error_details_written": error_details_written,
    "ioscli_error_lines": ioscli_error_lines,
    "latest_file_per_pair": latest_file_per_pair,
    "last_wins_files": last_wins_files,
    "full_run": full_run,
    "full_run_table": full_run_table,
    "full_run_details": full_run_details,
    "full_run_persisted": full_run_persisted,
}
