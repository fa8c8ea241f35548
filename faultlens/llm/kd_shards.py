"""Shards of near equal bytes by a k-d tree over document metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from faultlens.llm.common import text_of
from faultlens.runtime import pin

SHARDS = 24
ROW_BYTES = 8
# Bins of a histogram, per node and round; what a node may miss its median by,
# as a share of a leaf's bytes; rows numbered in one group when slots are dealt.
BINS = 1024
TOLERANCE = 1e-3
SLOT_ROWS = 1 << 15
# Coordinates are whole numbers below 2 ** COORD_BITS.
COORD_BITS = 40
# Bits of a tie that tell equal rows apart.
ROW_BITS = 16
DIMENSIONS = ("by_size", "by_language", "by_source", "by_id")


def _hashed(value: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - COORD_BITS)


@dataclass(frozen=True)
class Node:
    """A part of the tree that holds ``leaves`` shards from ``first`` on."""

    first: int
    leaves: int


def _coordinates(docs: DataFrame) -> DataFrame:
    """Size, checksum and metadata coordinates of every row; texts go no further."""
    text = text_of()
    size = (F.octet_length(text) + ROW_BYTES).cast("bigint")
    known = set(docs.columns)
    column = lambda name: F.col(name) if name in known else F.lit(None)
    rows = docs.select(
        "doc_id",
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        # Sizes spread over many powers of two: their logarithm, at full width.
        (F.log2(size.cast("double")) / 48 * (1 << COORD_BITS)).cast("bigint").alias("by_size"),
        _hashed(column("lang")).alias("by_language"),
        _hashed(column("source")).alias("by_source"),
        _hashed(F.struct(F.col("doc_id"), F.lit("id"))).alias("by_id"),
    )
    # Ties in a dimension are told apart by this: rows by what they hold, and rows
    # that are equal by their number, which is written with them.
    of_row = F.shiftleft(F.shiftright(_hashed(F.struct("doc_id", "text_crc32", "size")), ROW_BITS), ROW_BITS)
    number = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << ROW_BITS) - 1)
    return rows.withColumn("tie", of_row.bitwiseOR(number))


def _spans(rows: DataFrame) -> dict[int, dict]:
    """Bytes and the extent of each dimension, per node; at most ``SHARDS`` rows."""
    ends = [f(d).alias(f"{name}_{d}") for d in DIMENSIONS for f, name in ((F.min, "lo"), (F.max, "hi"))]
    found = rows.groupBy("first").agg(F.sum("size").alias("bytes"), *ends).collect()
    return {row["first"]: row.asDict() for row in found}


def _chosen(cases: dict[int, object], default) -> Column:
    """A value per node as one expression; there are at most ``SHARDS`` nodes."""
    if not cases:
        return F.lit(default)
    pairs = [x for first, value in cases.items() for x in (F.lit(first), F.lit(value))]
    return F.coalesce(F.create_map(*pairs)[F.col("first")], F.lit(default))


def _medians(rows: DataFrame, column: str, wanted: dict[int, float], ends: dict[int, tuple[int, int]],
             slack: float) -> dict[int, tuple[int, int, float, float]]:
    """Per node, an interval of values, the bytes below it and in it, round ``wanted`` bytes.

    Rounds of histograms narrow the interval that holds the weighted quantile. A
    round sends at most ``SHARDS * BINS`` sums to the driver, and takes a
    factor of ``BINS`` off the interval. Gives ``(low, high, bytes below low, bytes between)``:
    the quantile lies in ``[low, high)``, one value, or bytes within the slack.
    """
    state = {n: (ends[n][0], ends[n][1] + 1, 0.0, 0.0) for n in wanted}
    live = set(wanted)
    while live:
        low = _chosen({n: state[n][0] for n in live}, 0)
        high = _chosen({n: state[n][1] for n in live}, 0)
        width = _chosen({n: max(1, -(-(state[n][1] - state[n][0]) // BINS)) for n in live}, 1)
        inside = rows.filter(F.col("first").isin(*live)).filter((F.col(column) >= low) & (F.col(column) < high))
        sums = inside.groupBy("first", F.floor((F.col(column) - low) / width).alias("bin"))
        by_node: dict[int, list] = {}
        for row in sums.agg(F.sum("size").alias("bytes")).collect():
            by_node.setdefault(row["first"], []).append((row["bin"], row["bytes"]))
        for n in list(live):
            low_n, high_n, below, _ = state[n]
            step = max(1, -(-(high_n - low_n) // BINS))
            bins = sorted(by_node.get(n, []))
            hit, weight = (bins[-1] if bins else (0, 0))
            for at, size in bins:
                if below + size >= wanted[n]:
                    hit, weight = at, size
                    break
                below += size
            else:
                below -= weight
            state[n] = (low_n + hit * step, min(high_n, low_n + (hit + 1) * step), below, weight)
            if step == 1 or weight <= slack or not bins:
                live.discard(n)
    return state


def _split(rows: DataFrame, nodes: list[Node], slack: float) -> tuple[DataFrame, list[Node]]:
    """One level of the tree: every node with several leaves is cut in two."""
    spans = _spans(rows)
    cut = [n for n in nodes if n.leaves > 1]
    widest: dict[int, str] = {}
    wanted: dict[int, float] = {}
    for n in cut:
        span = spans.get(n.first)
        extent = lambda d: span[f"hi_{d}"] - span[f"lo_{d}"]  # noqa: B023, E731
        widest[n.first] = max(DIMENSIONS, key=extent) if span else DIMENSIONS[0]
        wanted[n.first] = (span["bytes"] if span else 0) * (n.leaves // 2) / n.leaves
    along = F.lit(0).cast("bigint")
    for dimension in DIMENSIONS:
        own = [first for first, name in widest.items() if name == dimension]
        if own:
            along = F.when(F.col("first").isin(*own), F.col(dimension)).otherwise(along)
    rows = rows.withColumn("along", along)
    ends = {n: (spans[n][f"lo_{widest[n]}"], spans[n][f"hi_{widest[n]}"]) for n in wanted if n in spans}
    first = _medians(rows, "along", {n: wanted[n] for n in ends}, ends, slack)

    # Rows in the interval of the median, often one tied value, are cut by the tie.
    low = _chosen({n: v[0] for n, v in first.items()}, 0)
    high = _chosen({n: v[1] for n, v in first.items()}, 0)
    tied = rows.filter((F.col("along") >= low) & (F.col("along") < high))
    rest = {n: max(0.0, wanted[n] - v[2]) for n, v in first.items()}
    whole = {n: (0, (1 << COORD_BITS) - 1) for n in first}
    second = _medians(tied, "tie", rest, whole, slack)
    # The row on the edge goes to the side that it leaves nearer to its share.
    edge = _chosen({n: v[1] if rest[n] - v[2] >= v[3] / 2 else v[0] for n, v in second.items()}, 0)

    left = (F.col("along") < low) | ((F.col("along") < high) & (F.col("tie") < edge))
    halves = _chosen({n.first: n.leaves // 2 for n in cut}, 0)
    moved = F.when(left, F.col("first")).otherwise(F.col("first") + halves).cast("int")
    after = [x for n in nodes for x in (
        [n] if n.leaves == 1 else [Node(n.first, n.leaves // 2), Node(n.first + n.leaves // 2, n.leaves - n.leaves // 2)]
    )]
    return rows.withColumn("first", moved).drop("along"), after


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal bytes.

    Columns: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law
    (``bytes``), shard, slot (from 0 without gaps in each shard), grown_shard
    (null: the law is not ``key``). Null text has no bytes. Dimensions are the
    logarithm of the size, language, source and doc_id; the latter three
    are spread by a hash, and a table without lang or source has them constant.
    Rows with nulls lie where the null hashes to. Repeated rows are rows of
    their own, told apart by their number, so a table of equal rows is dealt evenly too;
    rows with equal texts may lie in several shards, as the law is about bytes. An empty table gives an empty result.

    Only metadata is kept from the texts, written once. A node is cut at the
    weighted quantile of its widest dimension that leaves its halves with
    bytes in proportion to their leaves. Quantiles come from histograms with
    a bounded number of bins, so no node is ever sorted or held by one task,
    and a value that many rows tie in is cut by a hash.
    """
    nodes = [Node(0, shards)]
    rows = _coordinates(docs).withColumn("first", F.lit(0))
    rows = pin(rows)
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    slack = TOLERANCE * (total.bytes or 0) / shards
    while any(n.leaves > 1 for n in nodes) and total.n:
        rows, nodes = _split(rows, nodes, slack)
        rows = pin(rows)

    # Slots: a number in a group of bounded size, on top of the groups before it.
    groups = max(1, -(-total.n // (SLOT_ROWS * shards)))
    rows = rows.select("doc_id", "size", "text_crc32", F.col("first").alias("shard"),
                       F.pmod("tie", F.lit(groups)).alias("part"), "tie")
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("tie", "doc_id", "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("nth")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
