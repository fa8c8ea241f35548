"""Lines whose own stamp lies in a time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.rules import in_window
from faultlens.functions.stamps import (
    dated_ts,
    epoch_ts,
    move_to_year,
    project_yearless,
    yearless_ts,
)
from faultlens.model import CFGLOG, POOL, SYSLOG, VIOCMD
from faultlens.runtime import computed_once


def _keep_in_window(lines: DataFrame, stamp: Column, start: Column, end: Column) -> DataFrame:
    stamped = computed_once(lines, "event_ts", stamp)
    return stamped.filter(in_window(F.col("event_ts"), start, end))


def pool_in_window(lines: DataFrame, start: Column, end: Column) -> DataFrame:
    """Lines with an epoch stamp in the window."""
    return _keep_in_window(lines, epoch_ts(F.col("line")), start, end)


def viocmd_in_window(
    lines: DataFrame, start: Column, end: Column, all_months: bool = False
) -> DataFrame:
    """Lines with a dated stamp in the window."""
    return _keep_in_window(lines, dated_ts(F.col("line"), all_months), start, end)


def syslog_in_window(
    lines: DataFrame, start: Column, end: Column, all_months: bool = False
) -> DataFrame:
    """Lines with a year-less stamp in the window, all moved to the year 1970."""
    stamp = yearless_ts(F.col("line"), all_months)
    return _keep_in_window(lines, stamp, project_yearless(start), project_yearless(end))


def layer_spans(bounds: DataFrame, infer_year: bool = False) -> DataFrame:
    """What ``start_ts`` and ``end_ts`` mean for each layer, as ``span_start``, ``span_end``.

    Year-less stamps are compared in 1970, so their bounds are moved there, once
    per directory rather than once per line.
    """
    start, end = F.col("start_ts"), F.col("end_ts")
    moved = (start, end) if infer_year else (project_yearless(start), project_yearless(end))
    spans = [
        F.struct(
            F.lit(layer).alias("layer"), first.alias("span_start"), last.alias("span_end")
        )
        for layer, (first, last) in (
            (POOL, (start, end)),
            (VIOCMD, (start, end)),
            (SYSLOG, moved),
        )
    ]
    kept = [name for name in bounds.columns if name == "source_dir"]
    return bounds.select(*kept, F.inline(F.array(*spans)))


def in_command_span(
    errors: DataFrame,
    bounds: DataFrame,
    as_of: Column,
    infer_year: bool = False,
) -> DataFrame:
    """Of stamped error lines, those inside the span of the command.

    Bounds without ``source_dir`` are one span for all directories. Lines of
    directories without bounds are held against ``as_of`` alone. Lines of the
    configuration log are kept whatever their time. With ``infer_year``, a
    year-less stamp counts in whichever year of the span it fits.
    """
    if "source_dir" in bounds.columns:
        key = ["source_dir", "layer"]
    else:
        key = ["layer"]
    spans = layer_spans(bounds, infer_year)

    layer, stamp = F.col("layer"), F.col("event_ts")
    moved = as_of if infer_year else project_yearless(as_of)
    missing = F.when(layer == SYSLOG, moved).otherwise(as_of)
    start, end = F.col("span_start"), F.col("span_end")
    bounded = errors.join(spans, key, "left").withColumns(
        {"span_start": F.coalesce(start, missing), "span_end": F.coalesce(end, missing)}
    )
    if infer_year:
        fitting = F.filter(
            F.transform(
                F.sequence(F.year(start), F.year(end)), lambda year: move_to_year(stamp, year)
            ),
            lambda t: in_window(t, start, end),
        )
        fitted = F.when(layer == SYSLOG, F.get(fitting, F.lit(0))).otherwise(stamp)
        bounded = computed_once(bounded, "event_ts", fitted)
    return bounded.filter((layer == CFGLOG) | in_window(stamp, start, end))
