"""Exact deduplication: two passes with a Bloom filter, then a shuffle of likely copies only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import SPACE, text_of
from faultlens.runtime import pin

# Cells of the filter per row, cells a hash sets, and the bounds of its size in
# bits (2 ** 26 bits are 8 MB). More rows than fit are done in several ranges of
# the hash, each with a filter of its own.
CELLS_PER_ROW = 16
PROBES = 3
MIN_BITS, MAX_BITS = 16, 26
CHUNK_BITS = 13


def normalised(text: Column) -> Column:
    """Text without white space."""
    for blank in SPACE:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def _cells(bits: int) -> list[Column]:
    """The cells of a hash, each from hashing the hash and the number of the probe."""
    return [F.xxhash64("h", F.lit(n)).bitwiseAND((1 << bits) - 1) for n in range(PROBES)]


def _repeated_cells(rows: DataFrame, bits: int) -> np.ndarray:
    """The filter: a byte array with a bit for each cell that two rows or more have set.

    Counts are partial before the shuffle. What reaches the driver is the bit
    array, in chunks, and at most ``2 ** MAX_BITS`` bits whatever the input.
    """
    cells = rows.select(F.explode(F.array_distinct(F.array(*_cells(bits)))).alias("cell"))
    twice = cells.groupBy("cell").count().filter("count > 1")
    chunk = F.shiftright("cell", CHUNK_BITS).alias("chunk")
    low = F.col("cell").bitwiseAND((1 << CHUNK_BITS) - 1).cast("int").alias("low")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 1 << CHUNK_BITS
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            chunks, lows = (np.asarray(batch.column(n)) for n in range(2))
            for one in np.unique(chunks):
                bitmap = maps.setdefault(int(one), np.zeros(width, bool))
                bitmap[lows[chunks == one]] = True
        for one, bitmap in maps.items():
            yield pa.record_batch(
                [pa.array([one], pa.int64()), pa.array([np.packbits(bitmap).tobytes()], pa.binary())],
                names=["chunk", "bits"],
            )

    chunks = twice.select(chunk, low).repartition("chunk")
    found = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << CHUNK_BITS) // 8
    for row in chunks.mapInArrow(packed, "chunk bigint, bits binary").collect():
        part = slice(row.chunk * size, (row.chunk + 1) * size)
        found[part] |= np.frombuffer(row.bits, np.uint8)
    return found


def _with_mark(rows: DataFrame, bits: int) -> DataFrame:
    """Add ``maybe``: whether all cells of the row's hash have been set at least twice."""
    filter_of = rows.sparkSession.sparkContext.broadcast(_repeated_cells(rows, bits))
    schema = f"{', '.join(f'{name} {kind}' for name, kind in rows.dtypes)}, maybe boolean"
    width = len(rows.columns)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = filter_of.value
        for batch in batches:
            maybe = np.ones(batch.num_rows, bool)
            for n in range(width, batch.num_columns):
                cell = np.asarray(batch.column(n))
                maybe &= (found[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            kept = [batch.column(n) for n in range(width)]
            yield pa.record_batch(
                [*kept, pa.array(maybe)], names=[*batch.schema.names[:width], "maybe"]
            )

    probes = [cell.alias(f"cell_{n}") for n, cell in enumerate(_cells(bits))]
    return rows.select("*", *probes).mapInArrow(marked, schema)


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of documents whose texts are equal without white space.

    Columns: doc_id, keep_id (of the row with the most code points, then the
    smallest doc_id), group_size, kept, text_sha256. Null text is empty text;
    empty texts are a group like any other. Rows that repeat a doc_id are rows of
    their own; with equal text and length each of them is kept. A null doc_id
    comes last among ties. Other columns of ``docs`` are not looked at; an empty
    table gives an empty result.

    Pass one reads the texts, keeps a digest of each row and counts hashed cells.
    Pass two sends on only the rows whose cells all were set twice: copies, and
    under two in a thousand others. All other rows are single and are not
    shuffled. The copies are aggregated map-side per digest and joined back, so a
    group holding a third of all rows is split by Spark's skew join.
    """
    text = text_of()
    rows = docs.select(
        "doc_id",
        F.length(text).alias("n_points"),
        F.sha2(normalised(text), 256).alias("text_sha256"),
    )
    rows = pin(rows.withColumn("h", F.xxhash64("text_sha256")))
    need = max(1, rows.count() * CELLS_PER_ROW)
    bits = min(MAX_BITS, max(MIN_BITS, (need - 1).bit_length()))
    ranges = -(-need // (1 << MAX_BITS))
    marked = None
    for n in range(ranges):
        part = rows if ranges == 1 else rows.filter(F.pmod("h", F.lit(ranges)) == n)
        one = _with_mark(part, bits)
        marked = one if marked is None else marked.union(one)
    marked = pin(marked.drop("h"))

    single = marked.filter("not maybe").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    maybe = marked.filter("maybe")
    # Most code points, then the smallest doc_id; a null doc_id is passed over.
    order = F.struct("n_points", F.col("doc_id").isNotNull(), -F.col("doc_id"))
    # Written first: Spark splits a large group's rows only between plain exchanges.
    best = pin(
        maybe.groupBy("text_sha256").agg(
            F.max_by(F.struct("doc_id", "n_points"), order).alias("best"),
            F.count("*").alias("group_size"),
        )
    )
    grouped = maybe.join(best, "text_sha256").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (
            F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
            & (F.col("n_points") == F.col("best.n_points"))
        ).alias("kept"),
        "text_sha256",
    )
    return single.unionByName(grouped)
