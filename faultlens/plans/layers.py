"""Error lines of each layer, and of all layers in one go."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from faultlens.functions.rules import (
    by_layer,
    error_rules,
    is_command_end,
    is_command_start,
)
from faultlens.functions.stamps import line_stamps
from faultlens.model import (
    CFGLOG,
    DEFAULT_COMMAND,
    ERROR_COLUMNS,
    IOSCLI,
    LINE_COLUMNS,
    POOL,
    SYSLOG,
    TIMED_LAYERS,
    VIOCMD,
    Options,
)
from faultlens.operators.bounds import command_bounds, is_marker_log, one_span, wall_clock
from faultlens.operators.brackets import within_command
from faultlens.operators.timed import in_command_span
from faultlens.runtime import computed_once, pin

Span = tuple[datetime | str, datetime | str]


def is_trace_line(command: str, options: Options) -> Column:
    """Lines of a command trace that matter later: markers and error lines."""
    line = F.col("line")
    marker = is_command_start(line, command) | is_command_end(line, command)
    return marker | error_rules(line, options.strict)[IOSCLI]


def stamp_errors(errors: DataFrame, options: Options) -> DataFrame:
    """Add the stamp each layer is filtered by; NULL for layers without one."""
    stamps = line_stamps(F.col("line"), options.all_months, options.infer_year)
    return errors.withColumn("event_ts", by_layer(F.col("layer"), stamps))


def trace_errors(trace: DataFrame, command: str, options: Options) -> DataFrame:
    """Error lines inside the command brackets of the traces."""
    rule = error_rules(F.col("line"), options.strict)[IOSCLI]
    inside = within_command(trace.filter(F.col("layer") == IOSCLI), command, where=rule)
    no_stamp = F.lit(None).cast("timestamp_ntz")
    return inside.withColumn("event_ts", no_stamp).select(*ERROR_COLUMNS)


def windowed_errors(
    errors: DataFrame,
    bounds: DataFrame | Span,
    as_of: datetime | str | None,
    options: Options,
) -> DataFrame:
    """Stamped error lines inside the command span of their directory."""
    if isinstance(bounds, tuple):
        bounds = one_span(errors.sparkSession, *bounds)
    inside = in_command_span(errors, bounds, wall_clock(as_of), options.infer_year)
    return inside.select(*ERROR_COLUMNS)


def assembled(
    trace: DataFrame,
    others: DataFrame,
    command: str,
    as_of: datetime | str | None,
    bounds: DataFrame | Span | None,
    catalog: DataFrame | None,
    options: Options,
    kept: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | Span]:
    """Errors of all layers, and the bounds used.

    ``trace`` has the markers and error lines of the marker logs and command traces,
    ``others`` the error lines of the other layers by rule alone. ``kept`` has the paths of
    the traces whose errors count; bounds come from all of them. Tables
    and files both end here.
    """
    if bounds is None:
        bounds = command_bounds(trace, command, as_of, catalog, options.fix_noon)
    if kept is not None:
        trace = trace.join(kept, "path", "left_semi").select(*trace.columns)
    stamped = stamp_errors(others, options)
    errors = trace_errors(trace, command, options).unionByName(
        windowed_errors(stamped, bounds, as_of, options)
    )
    return errors, bounds


def dispatch_errors(
    lines: DataFrame,
    command: str = DEFAULT_COMMAND,
    as_of: datetime | str | None = None,
    bounds: DataFrame | Span | None = None,
    catalog: DataFrame | None = None,
    options: Options = Options(),
) -> DataFrame:
    """Error lines of every layer of a table of log lines, each by its own rule.

    Other layers yield nothing. Bounds may be given; otherwise they are found in
    the marker logs. One pass over the table keeps markers and lines that some rule
    hits; they are written once with what they hit, and bounds, brackets and windows read only
    them. The same pass lists the marker logs, unless a catalogue does.
    """
    layer = F.col("layer")
    rules = error_rules(F.col("line"), options.strict)
    del rules[IOSCLI]
    of_trace = (layer == IOSCLI) | is_marker_log(F.col("file_name"))
    tracked = of_trace & is_trace_line(command, options)
    trace, others, found = _one_pass(lines, tracked, by_layer(layer, rules), bounds is None and catalog is None)
    return assembled(trace, others, command, as_of, bounds, catalog if found is None else found, options)[0]


def _one_pass(
    lines: DataFrame, tracked: Column, hit: Column, list_logs: bool
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Lines that are tracked, lines that are hits, and the marker logs if asked for.

    The table is read once, and each rule tested once on a line; the lines that either test
    keeps are written with both results. Marker logs are observed on the way, as those
    without markers matter too: they are a row per directory.
    """
    spark = lines.sparkSession
    names = ["source_dir", "path", "file_name"]
    seen = Observation() if list_logs else None
    if seen is not None:
        log = F.when(is_marker_log(F.col("file_name")), F.struct(*names))
        lines = lines.observe(seen, F.collect_set(log).alias("logs"))
    marks = F.struct(F.coalesce(tracked, F.lit(False)).alias("tracked"), F.coalesce(hit, F.lit(False)).alias("hit"))
    marked = computed_once(lines.select(*LINE_COLUMNS), "_is", marks)
    kept = pin(marked.filter("_is.tracked or _is.hit"), compact=True)
    logs = None
    if seen is not None:
        columns = zip(*seen.get["logs"], strict=True) if seen.get["logs"] else [()] * len(names)
        logs = spark.createDataFrame(pa.table([pa.array(c, pa.string()) for c in columns], names=names))
    return kept.filter("_is.tracked").drop("_is"), kept.filter("_is.hit").drop("_is"), logs


def analyze_layer(
    lines: DataFrame,
    layer: str,
    command: str = DEFAULT_COMMAND,
    as_of: datetime | str | None = None,
    bounds: DataFrame | Span | None = None,
    options: Options = Options(),
) -> DataFrame:
    """Error lines of one layer; only what that layer needs is computed.

    Without bounds, one pass over the table gives the markers and the layer's hits together.
    """
    own = F.col("layer") == layer
    if layer == IOSCLI:
        trace = lines.filter(own & is_trace_line(command, options))
        return trace_errors(pin(trace.select(*LINE_COLUMNS), compact=True), command, options)
    rule = own & error_rules(F.col("line"), options.strict).get(layer, F.lit(False))
    if layer not in TIMED_LAYERS:
        return stamp_errors(lines.filter(rule), options).select(*ERROR_COLUMNS)
    if bounds is not None:
        errors = lines.filter(rule)
    else:
        marker = is_command_start(F.col("line"), command) | is_command_end(F.col("line"), command)
        markers, errors, logs = _one_pass(lines, is_marker_log(F.col("file_name")) & marker, rule, True)
        bounds = command_bounds(markers, command, as_of, logs, options.fix_noon)
    return windowed_errors(stamp_errors(errors, options), bounds, as_of, options)


def analyze_ioscli(lines: DataFrame, command: str = DEFAULT_COMMAND, **more) -> DataFrame:
    """Command trace errors inside the brackets of the command."""
    return analyze_layer(lines, IOSCLI, command, **more)


def analyze_pool(lines: DataFrame, command: str = DEFAULT_COMMAND, **more) -> DataFrame:
    """Pool log errors in the span of the command."""
    return analyze_layer(lines, POOL, command, **more)


def analyze_viocmd(lines: DataFrame, command: str = DEFAULT_COMMAND, **more) -> DataFrame:
    """Errors of the vioCmd log in the span of the command."""
    return analyze_layer(lines, VIOCMD, command, **more)


def analyze_syslog(lines: DataFrame, command: str = DEFAULT_COMMAND, **more) -> DataFrame:
    """Cluster errors of the system log in the span of the command."""
    return analyze_layer(lines, SYSLOG, command, **more)


def analyze_cfglog(lines: DataFrame, command: str = DEFAULT_COMMAND, **more) -> DataFrame:
    """Configuration log errors, at any time."""
    return analyze_layer(lines, CFGLOG, command, **more)
