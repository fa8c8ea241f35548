"""Pieces that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of the contracts, space and the code points 9 to 13.
SPACE = " \t\n\x0b\x0c\r"


def text_of(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """A table of the given directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checksum(df: DataFrame) -> tuple[int, int]:
    """Rows and a sum over their hashes, to tell whether two sets of rows agree."""
    row = df.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("x"),
    ).first()
    return row.n, row.x
