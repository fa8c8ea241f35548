"""Writers for reports, error lines and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.model import POSITION
from faultlens.operators.views import count_report, error_details
from faultlens.runtime import Scratch, pin


def write_count_report(matrix: DataFrame, path: str) -> None:
    """Write the ``key-->count`` lines as text, a directory per view and heading.

    The report has one row per node and layer in each view and is sorted.
    """
    (
        count_report(matrix)
        .orderBy("view", "heading", "key")
        .select("view", "heading", F.col("report_line").alias("value"))
        .write.partitionBy("view", "heading")
        .text(path)
    )


def write_error_details(errors: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write the error lines, a directory per node and layer, in line order.

    The errors are evaluated once, into a copy that goes when the lines are
    written: the ranges are found in the copy. Lines are dealt out in ranges of node,
    layer and position, so a pair is a few files, whose numbers follow the lines, and a pair
    with most of the lines is several tasks. Text output holds the lines alone.
    """
    order = ["node", "layer", "path", *POSITION]
    with Scratch(errors.sparkSession).collecting() as own:
        details = pin(error_details(errors).drop("heading"), compact=True)
        details = details.repartitionByRange(*order).sortWithinPartitions(*order)
        if file_format == "text":
            details = details.select("node", "layer", F.col("line").alias("value"))
        details.write.partitionBy("node", "layer").format(file_format).save(path)
        own.close()


def write_log_dirs(lines: DataFrame, path: str) -> None:
    """Write log lines as text: a directory per source and log, in part files.

    The order of lines in a log is kept whatever the partitions of ``lines``: they
    are dealt out in ranges of log and position, so the numbers of part files
    follow the positions.
    """
    named = lines.select("source_dir", F.col("file_name").alias("log"), *POSITION, F.col("line").alias("value"))
    order = ["source_dir", "log", *POSITION]
    named = named.repartitionByRange(*order).sortWithinPartitions(*order)
    named.select("source_dir", "log", "value").write.partitionBy("source_dir", "log").text(path)
