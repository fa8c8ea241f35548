"""Node and layer from a log's file name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_part(text: Column, token: str) -> Column:
    """The text after the last ``token``; tokens at the very end do not count."""
    trimmed = F.regexp_replace(text, f"({re.escape(token)})+$", "")
    return F.substring_index(trimmed, token, -1)


def node_of(file_name: Column) -> Column:
    """The last dot-separated part, or the whole name if there is no dot."""
    return last_part(file_name, ".")


def layer_of(file_name: Column, suffix_only: bool = False) -> Column:
    """The name without ``.<node>``: every occurrence, or only the one at the end."""
    suffix = F.concat(F.lit("."), node_of(file_name))
    if suffix_only:
        trimmed = F.regexp_replace(file_name, r"\.+$", "")
        kept = F.length(trimmed) - F.length(suffix)
        return F.when(F.endswith(trimmed, suffix), F.left(trimmed, kept)).otherwise(trimmed)
    return F.replace(file_name, suffix, F.lit(""))
