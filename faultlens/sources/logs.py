"""Log files: directory lists, listings and line scans."""

from __future__ import annotations

import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.functions.names import layer_of, node_of
from faultlens.model import LINE_COLUMNS

# A log is a file, or a directory of part files as distributed writers leave
# them; such a directory may be named ``column=log``. Groups: source, log, part.
LOG_PATH = r"(?s)^(.*)/(?:[^/=]*=(?=[^/]*/part-))?((?!part-)[^/]+)(?:/(part-[^/]*))?$"
PART_FILE = r"/part-[^/]*$"
PART_NUMBER = r"^part-(?:[a-z]-)?(\d+)"

# Directories listed at the same time.
LISTERS = 16
# How a file status spells itself.
_STATUS = re.compile(r"\{path=(.*?); isDirectory=(true|false);(?: length=(\d+);)?", re.S)
_GLOB = re.compile(r"([\\{}\[\]*?])")
CATALOG_SCHEMA = pa.schema(
    [("file_path", pa.string()), ("in_parts", pa.bool_()), ("size", pa.int64()), ("dir_index", pa.int32())]
)


def read_dir_list(spark: SparkSession, conf: str | list[str]) -> DataFrame:
    """Log directories from a text file with one path per line."""
    return spark.read.text(conf).select(F.col("value").alias("source_dir")).filter("source_dir != ''")


def part_key(part: Column) -> Column:
    """The name of a part file with its number in front, so that text order is line order.

    Writers pad numbers to five digits; beyond that ``part-100000`` would sort
    before ``part-99999``. Numbers are compared by their count of digits, then by digits.
    """
    number = F.ltrim(F.regexp_extract(part, PART_NUMBER, 1), F.lit("0"))
    return F.concat_ws(" ", F.lpad(F.length(number).cast("string"), 3, "0"), number, part)


def _decoded(file_path: Column) -> Column:
    """A path that file metadata spells: blanks and the like as %xx, but "+" is left alone."""
    return F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))


def _log_parts(path: Column, suffix_only: bool) -> dict[str, Column]:
    """What a file's path says about its log."""
    name = F.regexp_extract(path, LOG_PATH, 2)
    part = F.regexp_extract(path, LOG_PATH, 3)
    return {
        "source_dir": F.regexp_extract(path, LOG_PATH, 1),
        "path": F.regexp_replace(path, PART_FILE, ""),
        "file_name": name,
        "node": node_of(name),
        "layer": layer_of(name, suffix_only),
        "part": F.when(part != "", part_key(part)).otherwise(""),
    }


def _children(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """Path, whether it is a directory, and size of what stands in a directory, hidden names left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = jvm.org.apache.hadoop.fs.Path(path)
    # All statuses in one answer, however many there are.
    statuses = own.getFileSystem(conf).listStatusIterator(own)
    listed = jvm.org.apache.hadoop.util.functional.RemoteIterators.toList(statuses)
    found = []
    for child, directory, size in _STATUS.findall(listed.toString()):
        name = child.rpartition("/")[2]
        if not name.startswith(".") and (not name.startswith("_") or "=" in name):
            found.append((child, directory == "true", int(size or 0)))
    return found


def qualified(spark: SparkSession, path: str) -> str:
    """A path as file metadata spells it, decoded."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(conf).makeQualified(own).toString()


def list_logs(
    spark: SparkSession, dirs: Iterable[str], suffix_only: bool = False, nested: bool = False
) -> DataFrame:
    """One row per log with its names, size, directory and whether it is in parts.

    Logs are files directly in the directories, or directories of part files there: two
    levels are listed and nothing below them. ``nested`` goes all the way down; a
    directory below another listed one is then listed once, and its logs are its own.
    ``dir_index`` is the place of the listed directory. Sizes come with the listing, so no log is opened.
    The driver holds a row per log, several directories being listed at a time.
    """
    places: dict[str, int] = {}
    for place, path in enumerate(dirs):
        places.setdefault(qualified(spark, path), place)
    rows: list[tuple[str, bool, int, int]] = []
    with ThreadPoolExecutor(LISTERS) as listers:
        # Directories to list: path, place of the listed one, and whether logs stand in it.
        ahead = [(path, place, True) for path, place in places.items()]
        while ahead:
            listings = list(listers.map(lambda one: _children(spark, one[0]), ahead))
            following = []
            for (path, place, holds_logs), children in zip(ahead, listings, strict=True):
                parts = [size for child, directory, size in children if not directory and _is_part(child)]
                if parts and (nested or not holds_logs):
                    rows.append((f"{path}/part-", True, sum(parts), place))
                if not (holds_logs or nested):
                    continue
                for child, directory, size in children:
                    if directory and not (nested and child in places):
                        following.append((child, place, nested))
                    elif not directory and not _is_part(child):
                        rows.append((child, False, size, place))
            ahead = following
    columns = zip(*sorted(set(rows)), strict=True) if rows else [()] * len(CATALOG_SCHEMA)
    # A table in the plan: choosing among the logs runs no job.
    logs = spark.createDataFrame(pa.table(list(map(pa.array, columns, CATALOG_SCHEMA.types)), schema=CATALOG_SCHEMA))
    parts = _log_parts(F.col("file_path"), suffix_only)
    names = [value.alias(name) for name, value in parts.items() if name != "part"]
    return logs.select(*names, "size", "dir_index", "in_parts")


def _is_part(path: str) -> bool:
    return path.rpartition("/")[2].startswith("part-")


def log_catalog(
    spark: SparkSession, dirs: Iterable[str], suffix_only: bool = False, nested: bool = False
) -> DataFrame:
    """One row per log, empty ones included, with node, layer and size, by :func:`list_logs`."""
    found = list_logs(spark, dirs, suffix_only, nested)
    return found.select("source_dir", "path", "file_name", "node", "layer", "size")


def _literal(path: str) -> str:
    """A path that stands for itself where patterns are allowed."""
    return _GLOB.sub(r"\\\1", path)


def open_logs(spark: SparkSession, dirs: Iterable[str]) -> DataFrame:
    """The lines of all files below the directories, listed once, not yet read."""
    return spark.read.option("recursiveFileLookup", "true").text(list(dirs))


def scan_listed(
    spark: SparkSession, logs: Iterable[tuple[str, bool]], layers: Iterable[str] | None = None, **more
) -> DataFrame:
    """Lines of the logs ``(path, in_parts)``, as :func:`scan_log_lines` gives them.

    The reader is handed these logs and no others, so that how many there are to choose
    from is no condition in the plan.
    """
    whole, in_parts = [], []
    for path, parts in logs:
        (in_parts if parts else whole).append(_literal(path))
    scans = []
    if whole:
        scans.append(spark.read.option("recursiveFileLookup", "true").text(whole))
    if in_parts:
        found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
        scans.append(found.text(in_parts))
    if not scans:
        kinds = ["string"] * 6 + ["bigint", "bigint", "string"]
        schema = ", ".join(f"{name} {kind}" for name, kind in zip(LINE_COLUMNS, kinds, strict=True))
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [scan_log_lines(scan, layers, **more) for scan in scans])


def scan_log_lines(
    logs: DataFrame,
    layers: Iterable[str] | None = None,
    where: Column | None = None,
    which: Column | None = None,
    suffix_only: bool = False,
) -> DataFrame:
    """Lines of opened logs with node, layer and position.

    ``layers`` and ``which`` (a condition on ``file_name``) select logs; files of
    other logs are not read. ``where`` is a condition on ``line``. It is tested
    first: the conditions on names hold for whole files and cost time per line.

    The position is the part file, the start of the split and a number rising
    within the task that reads it.
    """
    parts = _log_parts(_decoded(F.col("_metadata.file_path")), suffix_only)
    lines = logs.withColumnRenamed("value", "line")
    if where is not None:
        lines = lines.filter(where)
    lines = lines.withColumns(parts)
    if layers is not None and which is not None:
        lines = lines.filter(F.col("layer").isin(*layers) | which)
    elif layers is not None:
        lines = lines.filter(F.col("layer").isin(*layers))
    elif which is not None:
        lines = lines.filter(which)
    position = {
        "block_start": F.col("_metadata.file_block_start"),
        "row_id": F.monotonically_increasing_id(),
    }
    return lines.withColumns(position).select(*LINE_COLUMNS)


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_number``, the place of each line in its log, from 1.

    Lines are numbered within their split and on top of the lines of the splits
    before it, so a log of any length is many groups; the numbers do not depend on
    how files were split. Of the splits there is a row each, counted where they are read.
    """
    split = ["path", "part", "block_start"]
    counts = lines.groupBy(*split).agg(F.count("*").alias("_lines"))
    earlier = Window.partitionBy("path").orderBy("part", "block_start")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*split, F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*split).orderBy("row_id")
    numbered = lines.withColumn("_nth", F.row_number().over(inside)).join(counts, split)
    return numbered.withColumn("line_number", F.col("_nth") + F.col("_before")).select(*lines.columns, "line_number")
