"""Full runs: from log directories to error reports."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions.rules import error_rules
from faultlens.model import DEFAULT_COMMAND, IOSCLI, LAYERS, Options
from faultlens.operators import views
from faultlens.operators.bounds import is_marker_log
from faultlens.plans.layers import assembled, is_trace_line
from faultlens.runtime import Scratch, pin
from faultlens.sources.logs import list_logs, read_dir_list, scan_listed
from faultlens.sources.sinks import write_count_report, write_error_details


@dataclass(frozen=True)
class FaultReport:
    """The errors found, the logs looked at and the command spans used."""

    errors: DataFrame
    catalog: DataFrame
    bounds: DataFrame
    # What the run has written to the shared folder.
    scratch: Scratch | None = None

    def matrix(self) -> DataFrame:
        """Errors per node and layer, zeros included."""
        return views.error_matrix(self.errors, self.catalog)

    def by_node(self, node: str) -> DataFrame:
        """Vertical view: errors per layer of a node."""
        return views.errors_by_node(self.errors, node, self.catalog)

    def by_layer(self, layer: str) -> DataFrame:
        """Horizontal view: errors per node of a layer."""
        return views.errors_by_layer(self.errors, layer, self.catalog)

    def counts(self) -> DataFrame:
        """Both views as ``key-->count`` lines."""
        return views.count_report(self.matrix())

    def details(self) -> DataFrame:
        """The error lines."""
        return views.error_details(self.errors)

    def write(self, path: str, details_format: str = "parquet") -> None:
        """Write counts and error lines below ``path``, from one evaluation of the errors."""
        with Scratch(self.errors.sparkSession).collecting() as own:
            errors = pin(self.errors, compact=True)
            write_count_report(views.error_matrix(errors, self.catalog), f"{path}/counts")
            write_error_details(errors, f"{path}/details", details_format)
            own.close()

    def persist(self) -> FaultReport:
        """Keep the errors for several views; the logs are then read once."""
        self.errors.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        self.errors.unpersist()

    def share(self) -> FaultReport:
        """The same report for one more user, who closes it too."""
        if self.scratch is not None:
            self.scratch.share()
        return self

    def close(self) -> None:
        """Drop kept errors and, with the last user, what the run has written.

        Other reports are not touched, in whatever order they are closed.
        """
        if self.scratch is None or self.scratch.users <= 1:
            self.unpersist()
        if self.scratch is not None:
            self.scratch.close()

    def __enter__(self) -> FaultReport:
        return self

    def __exit__(self, *error) -> None:
        self.close()


def _now(spark: SparkSession) -> str:
    """The wall clock of the session, taken once so that a run has one "now"."""
    zone = ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))
    return datetime.now(zone).replace(tzinfo=None).isoformat(sep=" ")


def analyze_directories(
    spark: SparkSession,
    dirs: Iterable[str],
    command: str = DEFAULT_COMMAND,
    as_of: datetime | str | None = None,
    on_duplicate: str = "union",
    options: Options = Options(),
    nested: bool = False,
) -> FaultReport:
    """Find the errors of all logs in the given directories.

    Logs are files directly in a directory, or directories of part files there;
    ``nested`` takes those further below as well. The directories are listed once
    and every log file is read once, by the scan of its layer, which is handed the logs
    of that layer and tests its rule alone; files of unknown layers are not opened. From the command
    traces, markers and error lines are written to the shared folder, as bounds and
    brackets both need them; they stay until :meth:`FaultReport.close`, and go at once if the run fails.

    ``on_duplicate``: ``union`` of all logs of one node and layer, or the ``last``
    one in the order of the directories; the others are then not opened, but for
    the command traces, as each directory has bounds of its own.
    """
    if on_duplicate not in ("union", "last"):
        raise ValueError(f"on_duplicate: {on_duplicate!r}")
    as_of = as_of or _now(spark)
    with Scratch(spark).collecting() as scratch:
        catalog = list_logs(spark, dirs, options.suffix_only, nested)
        marker = is_marker_log(F.col("file_name"))
        known = catalog.filter(F.col("layer").isin(*LAYERS))
        kept = views.latest_logs(known).select("path") if on_duplicate == "last" else None
        if kept is not None:
            known = known.join(kept, "path", "left_semi")
        # A row per log that is read; the driver has listed them.
        chosen: dict[str, list[tuple[str, bool]]] = {layer: [] for layer in LAYERS}
        for row in known.select("layer", "path", "in_parts").collect():
            chosen[row.layer].append((row.path, row.in_parts))
        traced = catalog.filter((F.col("layer") == IOSCLI) | marker).select("path", "in_parts").distinct()
        traces = [tuple(row) for row in traced.collect()]

        rules = error_rules(F.col("line"), options.strict)
        more = {"suffix_only": options.suffix_only}
        trace = scan_listed(spark, traces, [IOSCLI], which=marker, where=is_trace_line(command, options), **more)
        others = None
        for layer in LAYERS:
            if layer != IOSCLI:
                one = scan_listed(spark, chosen[layer], [layer], where=rules[layer], **more)
                others = one if others is None else others.unionByName(one)
        trace = pin(trace, compact=True)
        errors, bounds = assembled(trace, others, command, as_of, None, catalog, options, kept)
        if kept is not None:
            catalog = catalog.join(kept, "path", "left_semi")
    return FaultReport(errors, catalog, bounds, scratch)


def analyze_conf(spark: SparkSession, conf: str, **more) -> FaultReport:
    """Find the errors of all directories listed in a text file."""
    dirs = [row.source_dir for row in read_dir_list(spark, conf).collect()]
    return analyze_directories(spark, dirs, **more)
