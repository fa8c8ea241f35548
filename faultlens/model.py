"""Names shared by every module: layers, columns, options and limits."""

from __future__ import annotations

from dataclasses import dataclass

# The log layers whose lines are searched for errors.
IOSCLI = "ioscli_global.trace"
POOL = "pool.log"
VIOCMD = "vioCmd.log"
SYSLOG = "syslog.caa"
CFGLOG = "cfglog"
LAYERS = (POOL, IOSCLI, VIOCMD, SYSLOG, CFGLOG)
TIMED_LAYERS = (POOL, VIOCMD, SYSLOG)

# The command whose markers are looked up, and the part of a
# file name that tells the log carrying these markers.
DEFAULT_COMMAND = "pv"
MARKER_LOG = "ioscli"

# Where a line stands inside its log: part file, split, line number in the task.
POSITION = ("part", "block_start", "row_id")

# Columns of a table of log lines.
LINE_COLUMNS = ("source_dir", "path", "file_name", "node", "layer", *POSITION, "line")

# Columns of a table of error lines.
ERROR_COLUMNS = ("source_dir", "node", "layer", "path", *POSITION, "event_ts", "line")

# Lines per chunk when bracket state is tracked: 2 ** CHUNK_BITS at most.
CHUNK_BITS = 16


@dataclass(frozen=True)
class Options:
    """Departures from the compatible rules, all off by default.

    strict: an error is any ``rc`` with a non-zero integer.
    all_months: line stamps may use any short or long English month name.
    fix_noon: command stamps keep 12:mm:ss as noon instead of midnight.
    infer_year: year-less stamps take their year from the command bounds.
    suffix_only: the layer is the file name without its last part only.
    """

    strict: bool = False
    all_months: bool = False
    fix_noon: bool = False
    infer_year: bool = False
    suffix_only: bool = False
