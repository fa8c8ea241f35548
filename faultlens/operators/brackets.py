"""Lines between the start and end markers of a command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions.rules import command_marker
from faultlens.model import CHUNK_BITS, DEFAULT_COMMAND

# Chunks of a group, and bytes of a log whose blocks are one: 2 ** bits each.
GROUP_BITS, WIDE_BITS = 10, 37
# What a chunk is told by, level by level: the log, its parts and wide pieces of them,
# blocks and groups of chunks, chunks.
LEVELS = (("path",), ("part", "_wide"), ("block_start", "_group"), ("_chunk",))


def _state_before(rows: DataFrame, levels: tuple[tuple[str, ...], ...]) -> DataFrame:
    """Add ``_on``, the last known ``_last`` before each row of the innermost level, in the order of the levels.

    A tree of states: rows look back among their siblings, and where these know nothing
    take the state their parent starts with. A group is the children of one parent, so no
    task sees all chunks of a log; parents are one row each, aggregated before they move.
    """
    outer = [name for level in levels[:-1] for name in level]
    inner = list(levels[-1])
    before = Window.partitionBy(*outer).orderBy(*inner).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_on", F.last("_last", ignorenulls=True).over(before))
    if len(levels) == 2:
        return rows
    place = F.when(F.col("_last").isNotNull(), F.struct(*inner))
    parents = rows.groupBy(*outer).agg(F.max_by("_last", place).alias("_last"))
    parents = _state_before(parents, levels[:-1]).select(*outer, F.col("_on").alias("_above"))
    return rows.join(parents, outer).withColumn("_on", F.coalesce("_on", "_above")).drop("_above")


def within_command(
    lines: DataFrame,
    command: str = DEFAULT_COMMAND,
    where: Column | None = None,
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """Lines that stand inside a command bracket of their own log.

    A start marker opens the bracket and an end marker closes it; markers
    themselves are not returned, and an unclosed bracket lasts to the end of the
    log. ``where`` drops other lines before anything is shuffled.

    A log of any length is cut into chunks of at most ``2 ** chunk_bits`` lines,
    so no task sees more than a few chunks. The state each chunk starts with
    comes from a tree over one row per chunk and is put in front of the chunk as a line without
    number. ``row_id`` must be the same each time ``lines`` is evaluated: pin
    lines that were scanned from files.
    """
    marked = lines.withColumns(
        {
            "_on": command_marker(F.col("line"), command),
            "_chunk": F.shiftright("row_id", chunk_bits),
        }
    )
    if where is not None:
        marked = marked.filter(where | F.col("_on").isNotNull())

    chunk = ["path", "part", "block_start", "_chunk"]
    last_marker = F.max_by("_on", F.when(F.col("_on").isNotNull(), F.col("row_id")))
    chunks = marked.groupBy(*chunk).agg(last_marker.alias("_last")).withColumns(
        {"_wide": F.shiftright("block_start", WIDE_BITS), "_group": F.shiftright("_chunk", GROUP_BITS)}
    )
    carried = (
        _state_before(chunks, LEVELS)
        .filter("_on")
        .select(*chunk, "_on", F.lit(None).cast("bigint").alias("row_id"))
    )

    so_far = (
        Window.partitionBy(*chunk)
        .orderBy("row_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marked.unionByName(carried, allowMissingColumns=True)
        .withColumn("_open", F.last("_on", ignorenulls=True).over(so_far))
        .filter(F.col("_open") & F.col("_on").isNull())
        .select(*lines.columns)
    )
