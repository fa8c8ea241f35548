"""The same queries in the SQL of a second engine, to check results against."""

from __future__ import annotations

# Fixed values, written out here on purpose: a wrong constant in the library must not be wrong on
# both sides.
_START, _END = "TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '2024-01-20 00:00:00'"
_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
_MONTHS = "Jan|Feb|March|April|May|June|July|Aug|Sep|Oct|Nov|Dec"

_EVENT_LINES = """
rendered AS (
  SELECT *, 'node' || (user_id % 4 + 1) AS node, event_type = 'error' AS failed,
    CASE event_id % 5 WHEN 0 THEN 'pool.log' WHEN 1 THEN 'ioscli_global.trace'
      WHEN 2 THEN 'vioCmd.log' WHEN 3 THEN 'syslog.caa' ELSE 'cfglog' END AS layer
  FROM events),
log_lines AS (
  SELECT node AS source_dir, layer || '.' || node AS path, node, layer, event_id AS row_id,
    CASE layer
      WHEN 'pool.log' THEN 'p:' || CAST(floor(epoch(ts)) AS BIGINT) || ': op rc='
        || CASE WHEN failed THEN '1' ELSE '0' END || ' done'
      WHEN 'ioscli_global.trace' THEN CASE event_type
        WHEN 'signup' THEN 'Command pv  Started at >>>>>> ' || strftime(ts, '%b  %d %Y, %a, %H:%M:%S')
        WHEN 'purchase' THEN 'Command pv Ended at >>>>>> ' || strftime(ts, '%b  %d %Y, %a, %H:%M:%S')
        ELSE 'call rc = ' || CASE WHEN failed THEN 10 + event_id % 89 ELSE 0 END END
      WHEN 'vioCmd.log' THEN strftime(ts, '%b %-d %Y, %H:%M:%S') || ' vio rc '
        || CASE WHEN failed THEN 10 + event_id % 89 ELSE 0 END
      WHEN 'syslog.caa' THEN strftime(ts, '%b %-d %H:%M:%S') || ' host '
        || CASE WHEN failed THEN 'caa:err' ELSE 'caa:info' END || ' x'
      ELSE 'cfg ' || CASE WHEN failed THEN 'Error' ELSE 'ok' END END AS line
  FROM rendered)"""

# The command of a run: its end is marked late, and on the last node never; one
# node has no errors in its configuration log.
_RUN_LINES = _EVENT_LINES.replace(
    "WHEN 'purchase' THEN",
    "WHEN CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' AND node <> 'node4' THEN 'purchase' END THEN",
).replace(
    "event_type = 'error' AS failed",
    "event_type = 'error' AND NOT (event_id % 5 = 4 AND user_id % 4 = 2) AS failed",
)

_ORDER_LINES = """
moments AS (
  SELECT *, o_orderdate + to_seconds(o_orderkey % 86400) AS moment FROM orders),
log_lines AS (
  SELECT 'node' || (o_custkey % 4 + 1) AS node, 'vioCmd.log' AS layer, o_orderkey AS row_id,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(moment, '%b %-d %Y, %H:%M:%S')
      ELSE strftime(moment, '%B %-d %Y, %H:%M:%S') END || ' vio rc 11' AS line
  FROM moments)"""

_DATED = rf"({_MONTHS})\s+(\d{{1,2}})\s+(\d{{4}}),\s+(\d{{2}}):(\d{{2}}):(\d{{2}})"
_YEARLESS = rf"({_MONTHS})\s+(\d{{1,2}})\s+(\d{{2}}):(\d{{2}}):(\d{{2}})"
_COMMAND = r"^ (\w+)  +(\d+) +(\d+), \w+, +(\d+):(\d+):(\d+)"


def _clock(year: str, month: str, day: str, hour: str, minute: str, second: str) -> str:
    number = [f"TRY_CAST({text} AS BIGINT)" for text in (year, day, hour, minute, second)]
    name = f"CASE WHEN {month} <> '' THEN lower(left({month}, 3)) END"
    months = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
    return (
        f"(make_timestamp({number[0]}, list_position({months}, {name}), 1, 0, 0, 0.0)"
        f" + to_days(CAST({number[1]} - 1 AS INTEGER)) + to_hours({number[2]})"
        f" + to_minutes({number[3]}) + to_seconds({number[4]}))"
    )


def _group(text: str, pattern: str, number: int) -> str:
    return f"regexp_extract({text}, '{pattern}', {number})"


_DATED_TS = _clock(
    *(_group("line", _DATED, n) for n in (3, 1, 2, 4, 5, 6)),
)
_YEARLESS_TS = _clock("'1970'", *(_group("line", _YEARLESS, n) for n in (1, 2, 3, 4, 5)))
_EPOCH_TS = (
    "(TIMESTAMP '1970-01-01' + to_seconds(TRY_CAST("
    r"regexp_extract(line, ':(\d{10}):', 1) AS BIGINT)))"
)


def _command_ts(verb: str) -> str:
    def last(text: str, token: str) -> str:
        return f"string_split(regexp_replace({text}, '({token})+$', ''), '{token}')[-1]"

    tail = last(last("line", verb), ">>>>>>")
    fields = [_group(tail, _COMMAND, n) for n in (3, 1, 2, 4, 5, 6)]
    fields[3] = f"CASE {fields[3]} WHEN '12' THEN '0' ELSE {fields[3]} END"
    return _clock(*fields)


_STARTS = "contains(line, 'Command pv  Started at ')"
_ENDS = "contains(line, 'Command pv Ended at ')"


def _in_window(stamp: str, start: str, end: str) -> str:
    return f"({stamp} = {start} OR {stamp} = {end} OR ({stamp} > {start} AND {stamp} < {end}))"


def _projected(stamp: str) -> str:
    return (
        f"(make_timestamp(1970, month({stamp}), 1, 0, 0, 0.0)"
        f" + to_days(CAST(day({stamp}) - 1 AS INTEGER)) + to_hours(hour({stamp}))"
        f" + to_minutes(minute({stamp})) + to_seconds(second({stamp})))"
    )


def _text(stamp: str) -> str:
    return f"strftime({stamp}, '%Y-%m-%d %H:%M:%S')"


# Parsing is guarded by the layer and the marker: the engine may reorder filters.
_BOUNDS = f"""
bounds AS (
  SELECT source_dir, node, 'pv' AS command,
    coalesce(arg_min(CASE WHEN {_STARTS} THEN {_command_ts("Started at")} END, row_id)
      FILTER (WHERE {_STARTS}), {_AS_OF}) AS start_ts,
    coalesce(arg_min(CASE WHEN {_ENDS} THEN {_command_ts("Ended at")} END, row_id)
      FILTER (WHERE {_ENDS}), {_AS_OF}) AS end_ts
  FROM log_lines WHERE contains(path, 'ioscli') GROUP BY source_dir, node)"""

_WIDE_BOUNDS = f"""
bounds AS (
  SELECT DISTINCT source_dir, {_START} AS start_ts, {_END} AS end_ts FROM log_lines)"""

_INSIDE = f"""
marked AS (
  SELECT *, CASE WHEN {_STARTS} THEN true WHEN {_ENDS} THEN false END AS turned_on
  FROM log_lines WHERE layer = 'ioscli_global.trace'),
tracked AS (
  SELECT *, last_value(turned_on IGNORE NULLS) OVER (PARTITION BY path ORDER BY row_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened
  FROM marked),
inside AS (SELECT * FROM tracked WHERE turned_on IS NULL AND opened)"""

_RULES = {
    "ioscli_global.trace": r"regexp_matches(line, 'rc\s+=\s+[^0]\d+')",
    "pool.log": r"regexp_matches(line, 'rc=[^0]\s+')",
    "vioCmd.log": r"regexp_matches(line, 'rc\s+[^0]\d+')",
    "syslog.caa": "contains(line, 'caa:err')",
    "cfglog": "contains(line, 'Error')",
}


def _rule_errors(layer: str) -> str:
    return f"(layer = '{layer}' AND {_RULES[layer]})"


_ERRORS = f"""{_INSIDE},
stamped AS (
  SELECT log_lines.*, start_ts, end_ts, CASE layer WHEN 'pool.log' THEN {_EPOCH_TS}
      WHEN 'vioCmd.log' THEN {_DATED_TS} WHEN 'syslog.caa' THEN {_YEARLESS_TS} END AS event_ts
  FROM log_lines LEFT JOIN bounds USING (source_dir)),
errors AS (
  SELECT source_dir, path, node, layer, row_id, CAST(NULL AS TIMESTAMP) AS event_ts, line
  FROM inside WHERE {_RULES["ioscli_global.trace"]}
  UNION ALL
  SELECT source_dir, path, node, layer, row_id, event_ts, line FROM stamped
  WHERE {_rule_errors("cfglog")}
    OR ({_rule_errors("pool.log")} AND {_in_window("event_ts", "start_ts", "end_ts")})
    OR ({_rule_errors("vioCmd.log")} AND {_in_window("event_ts", "start_ts", "end_ts")})
    OR ({_rule_errors("syslog.caa")}
      AND {_in_window("event_ts", _projected("start_ts"), _projected("end_ts"))}))"""

_ON_EVENTS = f"WITH {_EVENT_LINES}"
_ON_ORDERS = f"WITH {_ORDER_LINES}"
_ON_ERRORS = f"WITH {_EVENT_LINES}, {_WIDE_BOUNDS}, {_ERRORS}"
_ON_RUN = f"WITH {_RUN_LINES}, {_BOUNDS}, {_ERRORS}"

_ZERO_FILLED = """
matrix AS (
  SELECT node, layer, count(errors.row_id) AS errors
  FROM (SELECT DISTINCT node, layer FROM log_lines) LEFT JOIN errors USING (node, layer)
  GROUP BY node, layer)"""
_MATRIX = """
matrix AS (SELECT node, layer, count(*) AS errors FROM errors GROUP BY node, layer)"""
_REPORT = """
SELECT 'vertical' AS view, upper(node) AS heading, layer AS key, errors,
  layer || '-->' || errors AS report_line FROM matrix
UNION ALL
SELECT 'horizontal', layer, node, errors, node || '-->' || errors FROM matrix"""

_NAMES = """
WITH names AS (
  SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'pool.log.' || node
    WHEN 1 THEN 'a.' || node || '.' WHEN 2 THEN 'x.' || node || '0.' || node
    WHEN 3 THEN 'x.' || node || '.log.' || node || '..' WHEN 4 THEN 'cfg' || node
    ELSE 'syslog.caa.' || node END AS file_name
  FROM (SELECT event_id, 'node' || (user_id % 12 + 1) AS node FROM events)),
nodes AS (
  SELECT *, string_split(regexp_replace(file_name, '\\.+$', ''), '.')[-1] AS node FROM names)"""

_ROWS = "node, layer, row_id, line"


def _rule_query(layer: str) -> str:
    return f"{_ON_EVENTS} SELECT {_ROWS} FROM log_lines WHERE {_rule_errors(layer)}"


def _window_query(layer: str, stamp: str, start: str = _START, end: str = _END) -> str:
    return (
        f"{_ON_EVENTS}, stamped AS (SELECT *, {stamp} AS event_ts FROM log_lines"
        f" WHERE layer = '{layer}') SELECT node, layer, row_id, {_text('event_ts')} AS event_ts,"
        f" line FROM stamped WHERE {_in_window('event_ts', start, end)}"
    )


def _stamp_query(lines: str, stamp: str, where: str = "true") -> str:
    return (
        f"{lines} SELECT node, layer, row_id, {_text(stamp)} AS event_ts, line"
        f" FROM log_lines WHERE {where}"
    )


def _error_query(where: str = "true") -> str:
    return (
        f"{_ON_ERRORS} SELECT node, layer, row_id, {_text('event_ts')} AS event_ts, line"
        f" FROM errors WHERE {where}"
    )


def _layer_query(layer: str) -> str:
    return _error_query(f"layer = '{layer}'")


_NUMBERED = (
    f"{_ON_RUN} SELECT node, layer, row_number() OVER (PARTITION BY node, layer ORDER BY row_id)"
    " AS nth, line FROM errors"
)

# Directories of three runs, listed from the last to the first, the first without the
# last node. Of the traces in a directory, that of its last node tells the bounds.
_RUNS_LINES = _RUN_LINES.replace("log_lines AS (", "all_lines AS (") + """,
log_lines AS (
  SELECT * REPLACE ('run' || (row_id % 3 + 1) AS source_dir, 'run' || (row_id % 3 + 1) || '/' || path AS path)
  FROM all_lines WHERE row_id % 3 > 0 OR node <> 'node4')"""
_RUNS_BOUNDS = _BOUNDS.replace("bounds AS (", "trace_bounds AS (") + """,
bounds AS (
  SELECT source_dir, arg_max(start_ts, node) AS start_ts, arg_max(end_ts, node) AS end_ts
  FROM trace_bounds GROUP BY source_dir)"""

ORACLES: dict[str, str] = {
    "scan_log_lines": (
        f"{_ON_EVENTS} SELECT node, layer, row_number() OVER (PARTITION BY path ORDER BY row_id)"
        " AS line_number, line FROM log_lines"
    ),
    "log_catalog": (
        f"{_ON_EVENTS} SELECT path AS file_name, node, layer, CAST(CASE WHEN path = 'cfglog.node1'"
        " THEN 0 ELSE sum(strlen(line) + 1) END AS BIGINT) AS size FROM log_lines GROUP BY path, node, layer"
    ),
    "read_dir_list": f"{_ON_EVENTS} SELECT DISTINCT source_dir FROM log_lines",
    "derive_node": f"{_NAMES} SELECT event_id, file_name, node FROM nodes",
    "derive_layer": (
        f"{_NAMES} SELECT event_id, file_name,"
        " regexp_replace(file_name, '\\.' || node, '', 'g') AS layer FROM nodes"
    ),
    "command_start_lines": f"{_ON_EVENTS} SELECT {_ROWS} FROM log_lines WHERE {_STARTS}",
    "command_end_lines": f"{_ON_EVENTS} SELECT {_ROWS} FROM log_lines WHERE {_ENDS}",
    "ioscli_rc_errors": _rule_query("ioscli_global.trace"),
    "pool_rc_errors": _rule_query("pool.log"),
    "viocmd_rc_errors": _rule_query("vioCmd.log"),
    "syslog_caa_errors": _rule_query("syslog.caa"),
    "cfglog_errors": _rule_query("cfglog"),
    "first_regex_match": (
        f"{_ON_ORDERS} SELECT row_id, nullif({_group('line', _DATED, 0)}, '') AS found FROM log_lines"
    ),
    "pool_in_window": _window_query("pool.log", _EPOCH_TS),
    "viocmd_in_window": _window_query("vioCmd.log", _DATED_TS),
    "syslog_in_window": _window_query(
        "syslog.caa", _YEARLESS_TS, _projected(_START), _projected(_END)
    ),
    "inclusive_window": f"""
        WITH spans AS (
          SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day,
            CASE WHEN user_id % 2 = 0 THEN {_START} ELSE {_END} END AS start_ts,
            CASE WHEN user_id % 2 = 0 THEN {_END} ELSE {_START} END AS end_ts
          FROM events)
        SELECT event_id, {_text("day")} AS day FROM spans
        WHERE {_in_window("day", "start_ts", "end_ts")}""",
    "parse_command_ts": _stamp_query(
        _ON_EVENTS,
        f"CASE WHEN {_STARTS} THEN {_command_ts('Started at')}"
        f" WHEN {_ENDS} THEN {_command_ts('Ended at')} END",
        "layer = 'ioscli_global.trace'",
    ),
    "parse_epoch_ts": _stamp_query(_ON_EVENTS, _EPOCH_TS, "layer = 'pool.log'"),
    "parse_dated_ts": _stamp_query(_ON_ORDERS, _DATED_TS),
    "parse_yearless_ts": _stamp_query(
        f"WITH {_ORDER_LINES}, undated AS (SELECT * REPLACE (regexp_replace(line,"
        r" ' \d{4},', '') AS line) FROM log_lines)",
        _YEARLESS_TS,
    ).replace("FROM log_lines WHERE", "FROM undated WHERE"),
    "project_yearless": f"""
        WITH moments AS (
          SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS moment FROM orders)
        SELECT o_orderkey, {_text(_projected("moment"))} AS projected FROM moments""",
    "command_bounds": (
        f"WITH {_RUN_LINES}, {_BOUNDS} SELECT source_dir, node, command,"
        f" {_text('start_ts')} AS start_ts, {_text('end_ts')} AS end_ts FROM bounds"
    ),
    "lines_with_bounds": (
        f"WITH {_RUN_LINES}, {_BOUNDS} SELECT log_lines.node, layer, row_id,"
        f" {_text('start_ts')} AS start_ts, {_text('end_ts')} AS end_ts, line"
        " FROM log_lines LEFT JOIN bounds USING (source_dir)"
    ),
    "within_command": f"WITH {_EVENT_LINES}, {_INSIDE} SELECT {_ROWS} FROM inside",
    "analyze_ioscli": _layer_query("ioscli_global.trace"),
    "analyze_pool": _layer_query("pool.log"),
    "analyze_viocmd": _layer_query("vioCmd.log"),
    "analyze_syslog": _layer_query("syslog.caa"),
    "analyze_cfglog": _layer_query("cfglog"),
    "dispatch_errors": _error_query(),
    "dispatch_errors_in_run": (
        f"{_ON_RUN} SELECT node, layer, row_id, {_text('event_ts')} AS event_ts, line FROM errors"
    ),
    "errors_for_node": _error_query("node = 'node1'"),
    "errors_for_layer": _error_query("layer = 'pool.log'"),
    "errors_by_node": f"{_ON_RUN}, {_ZERO_FILLED} SELECT layer, errors FROM matrix WHERE node = 'node4'",
    "errors_by_layer": f"{_ON_RUN}, {_ZERO_FILLED} SELECT node, errors FROM matrix WHERE layer = 'syslog.caa'",
    "error_matrix": f"{_ON_ERRORS}, {_MATRIX} SELECT node, layer, errors FROM matrix",
    "error_matrix_zero_filled": f"{_ON_RUN}, {_ZERO_FILLED} SELECT node, layer, errors FROM matrix",
    "count_report": f"{_ON_RUN}, {_ZERO_FILLED} {_REPORT}",
    "count_report_written": (
        f"{_ON_RUN}, {_ZERO_FILLED}, report AS ({_REPORT}) SELECT view, heading, report_line FROM report"
    ),
    "error_details_written": _NUMBERED,
    "error_details": (
        f"{_ON_ERRORS} SELECT upper(node) AS heading, node, layer, row_id,"
        f" {_text('event_ts')} AS event_ts, line FROM errors"
    ),
    "ioscli_error_lines": (
        f"{_ON_ERRORS} SELECT node, row_id, line FROM errors WHERE layer = 'ioscli_global.trace'"
    ),
    "latest_file_per_pair": (
        f"{_ON_EVENTS}, run_lines AS (SELECT * REPLACE ('run' || (row_id % 3 + 1) || '/' || path"
        " AS path) FROM log_lines), latest AS (SELECT node, layer, max(path) AS path"
        " FROM run_lines GROUP BY node, layer) SELECT node, layer, row_id, path, line"
        " FROM run_lines SEMI JOIN latest USING (node, layer, path) WHERE "
        + " OR ".join(map(_rule_errors, _RULES))
    ),
    "last_wins_files": (
        f"WITH {_RUNS_LINES}, {_RUNS_BOUNDS}, {_ERRORS}, latest AS (SELECT node, layer,"
        " min(source_dir) AS source_dir FROM log_lines GROUP BY node, layer)"
        " SELECT node, layer, source_dir AS run, line FROM errors SEMI JOIN latest"
        " USING (node, layer, source_dir)"
    ),
    "full_run": f"{_ON_RUN}, {_ZERO_FILLED} {_REPORT}",
    "full_run_table": f"{_ON_RUN}, {_ZERO_FILLED} {_REPORT}",
    "full_run_details": _NUMBERED,
    "full_run_persisted": (
        f"{_ON_RUN} SELECT node, layer, line, count(*) OVER (PARTITION BY node, layer) AS of_pair FROM errors"
    ),
}
