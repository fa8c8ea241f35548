"""The time span of a command, and its use on the lines of the same directory."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions.names import node_of
from faultlens.functions.rules import is_command_end, is_command_start
from faultlens.functions.stamps import ENDED, STARTED, command_ts
from faultlens.model import DEFAULT_COMMAND, MARKER_LOG


def wall_clock(as_of: datetime | str | None) -> Column:
    """``as_of`` as a TIMESTAMP_NTZ; the current time if none is given."""
    if as_of is None:
        return F.localtimestamp()
    return F.lit(str(as_of)).cast("timestamp_ntz")


def one_span(spark: SparkSession, start: datetime | str, end: datetime | str) -> DataFrame:
    """Bounds that are the same for every directory."""
    return spark.range(1).select(
        wall_clock(start).alias("start_ts"), wall_clock(end).alias("end_ts")
    )


def is_marker_log(file_name: Column) -> Column:
    return file_name.contains(MARKER_LOG)


def command_bounds(
    lines: DataFrame,
    command: str = DEFAULT_COMMAND,
    as_of: datetime | str | None = None,
    catalog: DataFrame | None = None,
    fix_noon: bool = False,
) -> DataFrame:
    """Start and end of the command per directory.

    The first start marker and the first end marker of the directory's marker
    log count, each for itself; a missing or unreadable one becomes ``as_of``.
    Of several marker logs the one listed last by path counts, whether it has
    markers or not. Logs without lines are known only through ``catalog``.
    """
    line, row_id = F.col("line"), F.col("row_id")
    starts, ends = is_command_start(line, command), is_command_end(line, command)
    log = ["source_dir", "path", "file_name"]

    # Numbers only, so that the aggregate stays in a hash table; a stamp is read
    # only when its line comes before those seen so far.
    start_row, end_row = F.when(starts, row_id), F.when(ends, row_id)
    per_block = (
        lines.filter(is_marker_log(F.col("file_name")))
        .groupBy(*log, "part", "block_start")
        .agg(
            F.min(start_row).alias("start_row"),
            F.min_by(command_ts(line, STARTED, fix_noon), start_row).alias("start_ts"),
            F.min(end_row).alias("end_row"),
            F.min_by(command_ts(line, ENDED, fix_noon), end_row).alias("end_ts"),
        )
    )
    block = F.struct("part", "block_start")
    per_log = per_block.groupBy(*log).agg(
        F.min_by("start_ts", F.when(F.col("start_row").isNotNull(), block)).alias("start_ts"),
        F.min_by("end_ts", F.when(F.col("end_row").isNotNull(), block)).alias("end_ts"),
    )
    if catalog is not None:
        marker_logs = catalog.filter(is_marker_log(F.col("file_name"))).select(*log).distinct()
        per_log = marker_logs.join(per_log, log, "left")

    now = wall_clock(as_of)
    span = F.struct("file_name", "start_ts", "end_ts")
    return (
        per_log.groupBy("source_dir")
        .agg(F.max_by(span, "path").alias("span"))
        .select(
            "source_dir",
            node_of(F.col("span.file_name")).alias("node"),
            F.lit(command).alias("command"),
            F.coalesce("span.start_ts", now).alias("start_ts"),
            F.coalesce("span.end_ts", now).alias("end_ts"),
        )
    )


def with_bounds(
    lines: DataFrame,
    bounds: DataFrame,
    as_of: datetime | str | None = None,
) -> DataFrame:
    """Add ``start_ts`` and ``end_ts`` of the line's directory to every line.

    A plain join: Spark broadcasts the bounds if they are small when it comes to it,
    and else splits a directory that holds a large share of the lines.
    """
    now = wall_clock(as_of)
    spans = bounds.select("source_dir", "start_ts", "end_ts")
    return lines.join(spans, ["source_dir"], "left").withColumns(
        {"start_ts": F.coalesce("start_ts", now), "end_ts": F.coalesce("end_ts", now)}
    )
