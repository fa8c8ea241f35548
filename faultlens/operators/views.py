"""Error counts per layer of a node, per node of a layer, and error listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.model import IOSCLI, LAYERS, POSITION


def error_matrix(errors: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Errors per node and layer; with a catalogue, also pairs without errors.

    Counting starts before the shuffle, so a pair holding most of the errors
    sends one row per task.
    """
    counts = errors.groupBy("node", "layer").agg(F.count("*").alias("errors"))
    if catalog is None:
        return counts
    known = catalog.filter(F.col("layer").isin(*LAYERS)).select("node", "layer").distinct()
    return known.join(counts, ["node", "layer"], "left").withColumn(
        "errors", F.coalesce("errors", F.lit(0).cast("bigint"))
    )


def errors_for_node(errors: DataFrame, node: str) -> DataFrame:
    """The error lines of one node; none if the node is unknown."""
    return errors.filter(F.col("node") == node)


def errors_for_layer(errors: DataFrame, layer: str) -> DataFrame:
    """The error lines of one layer; none if the layer is unknown."""
    return errors.filter(F.col("layer") == layer)


def errors_by_node(errors: DataFrame, node: str, catalog: DataFrame | None = None) -> DataFrame:
    """Vertical view: errors per layer of one node."""
    logs = None if catalog is None else errors_for_node(catalog, node)
    return error_matrix(errors_for_node(errors, node), logs).select("layer", "errors")


def errors_by_layer(errors: DataFrame, layer: str, catalog: DataFrame | None = None) -> DataFrame:
    """Horizontal view: errors per node of one layer."""
    logs = None if catalog is None else errors_for_layer(catalog, layer)
    return error_matrix(errors_for_layer(errors, layer), logs).select("node", "errors")


def count_report(matrix: DataFrame) -> DataFrame:
    """Both views of an error matrix as ``key-->count`` lines under headings."""
    vertical = F.struct(
        F.lit("vertical").alias("view"),
        F.upper("node").alias("heading"),
        F.col("layer").alias("key"),
        "errors",
    )
    horizontal = F.struct(
        F.lit("horizontal").alias("view"),
        F.col("layer").alias("heading"),
        F.col("node").alias("key"),
        "errors",
    )
    return matrix.select(F.inline(F.array(vertical, horizontal))).withColumn(
        "report_line", F.format_string("%s-->%d", "key", "errors")
    )


def error_details(errors: DataFrame) -> DataFrame:
    """The error lines with the upper-case node heading, ready to be written."""
    return errors.select(
        F.upper("node").alias("heading"), "node", "layer", "path", *POSITION, "event_ts", "line"
    )


def ioscli_error_lines(errors: DataFrame) -> DataFrame:
    """The error lines of the command trace alone."""
    return errors_for_layer(errors, IOSCLI).select("node", "path", *POSITION, "line")


def latest_logs(catalog: DataFrame) -> DataFrame:
    """Of several logs of one node and layer, the one processed last.

    That is the one of the last directory in ``dir_index``, or where the catalogue has no
    such column, and within a directory, the last by path.
    """
    last = ["dir_index", "path"] if "dir_index" in catalog.columns else ["path"]
    return catalog.groupBy("node", "layer").agg(F.max_by("path", F.struct(*last)).alias("path"))


def keep_latest_logs(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Lines of the log of each node and layer that was processed last."""
    return lines.join(latest_logs(catalog), ["node", "layer", "path"], "left_semi")
