"""Predicates on one log line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens.model import CFGLOG, IOSCLI, POOL, SYSLOG, VIOCMD

# What marks an error line, per layer.
IOSCLI_ERROR = r"rc\s+=\s+[^0]\d+"
POOL_ERROR = r"rc=[^0]\s+"
VIOCMD_ERROR = r"rc\s+[^0]\d+"
SYSLOG_ERROR = "caa:err"
CFGLOG_ERROR = "Error"

# Any non-zero integer return code (option ``strict``).
STRICT_ERROR = r"\brc\s*=?\s*-?0*[1-9]"


def first_match(line: Column, pattern: str) -> Column:
    """The first text matching ``pattern``, NULL if there is none."""
    return F.nullif(F.regexp_extract(line, pattern, 0), F.lit(""))


def is_command_start(line: Column, command: str) -> Column:
    return line.contains(f"Command {command}  Started at ")


def is_command_end(line: Column, command: str) -> Column:
    return line.contains(f"Command {command} Ended at ")


def command_marker(line: Column, command: str) -> Column:
    """True on a start marker, false on an end marker, NULL on other lines."""
    return F.when(is_command_start(line, command), True).when(
        is_command_end(line, command), False
    )


def _return_code(line: Column, literal: str, pattern: str) -> Column:
    # The byte search is cheap and spares most lines the regular expression.
    return line.contains(literal) & line.rlike(pattern)


def ioscli_error(line: Column, strict: bool = False) -> Column:
    return _return_code(line, "rc", STRICT_ERROR if strict else IOSCLI_ERROR)


def pool_error(line: Column, strict: bool = False) -> Column:
    if strict:
        return _return_code(line, "rc", STRICT_ERROR)
    return _return_code(line, "rc=", POOL_ERROR)


def viocmd_error(line: Column, strict: bool = False) -> Column:
    return _return_code(line, "rc", STRICT_ERROR if strict else VIOCMD_ERROR)


def syslog_error(line: Column) -> Column:
    return line.contains(SYSLOG_ERROR)


def cfglog_error(line: Column) -> Column:
    return line.contains(CFGLOG_ERROR)


def error_rules(line: Column, strict: bool = False) -> dict[str, Column]:
    """The error rule of every layer."""
    return {
        POOL: pool_error(line, strict),
        IOSCLI: ioscli_error(line, strict),
        VIOCMD: viocmd_error(line, strict),
        SYSLOG: syslog_error(line),
        CFGLOG: cfglog_error(line),
    }


def by_layer(layer: Column, choices: dict[str, Column]) -> Column:
    """The choice made for the line's layer, NULL for layers without one."""
    chosen = None
    for name, value in choices.items():
        own = layer == name
        chosen = F.when(own, value) if chosen is None else chosen.when(own, value)
    return F.lit(None) if chosen is None else chosen


def in_window(stamp: Column, start: Column, end: Column) -> Column:
    """Inclusive window; if ``start`` is after ``end`` only the two ends match."""
    return (stamp == start) | (stamp == end) | ((stamp > start) & (stamp < end))
