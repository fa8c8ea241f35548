"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import SPACE, text_of
from faultlens.runtime import computed_once, pin

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_POINTS = 20
MIN_DOCS = 3
BATCHES = 4
FAN_IN = 2


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A to Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


@dataclass
class LineRuns:
    """Runs of ``(h1, h2, n_docs, keeper)`` sorted by hash, in levels.

    Batches must come in falling order of doc_id. A key's first entry, in the
    first batch that has it, names the largest doc_id as its keeper; entries of
    later batches only add to the count. ``fan_in`` runs of a level are merged
    into one of the next level, so a key is rewritten a logarithmic number of times.
    """

    fan_in: int = FAN_IN
    levels: list[list[DataFrame]] = field(default_factory=list)

    def _runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``(doc_id, h1, h2)``, one row per line."""
        batch = lines.groupBy("h1", "h2").agg(
            F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")
        )
        runs = self._runs()
        if runs:
            batch = pin(batch)
            known = reduce(DataFrame.union, [run.select("h1", "h2") for run in runs])
            fresh = batch.hint("merge").join(known, ["h1", "h2"], "left_anti")
            seen = batch.hint("merge").join(known, ["h1", "h2"], "left_semi")
            seen = seen.withColumn("keeper", F.lit(None).cast("bigint"))
            batch = fresh.unionByName(seen)
        self._put(batch, 0)

    def _put(self, rows: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(pin(rows.sortWithinPartitions("h1", "h2")))
        if len(self.levels[level]) >= self.fan_in:
            merged = _summed(self.levels[level])
            self.levels[level] = []
            self._put(merged, level + 1)

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """Keys found in at least ``min_docs`` documents, with their keepers."""
        return _summed(self._runs()).filter(F.col("n_docs") >= min_docs)


def _summed(runs: list[DataFrame]) -> DataFrame:
    both = reduce(DataFrame.unionByName, runs)
    return both.groupBy("h1", "h2").agg(
        F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper")
    )


def _long_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, h1, h2)`` of lines whose key is long enough to be dropped."""
    known = docs.filter("doc_id is not null")
    lines = known.select("doc_id", F.posexplode(F.split(text_of(), "\n")).alias("pos", "line"))
    # Trimming only shortens, so short lines need no key.
    lines = lines.filter(F.length("line") >= MIN_POINTS)
    keys = computed_once(lines, "key", line_key(F.col("line")))
    return keys.filter(F.length("key") >= MIN_POINTS).select(
        "doc_id",
        "pos",
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(1), "key").alias("h2"),
    )


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Drop lines that at least three documents share, except in the largest doc_id.

    Adds ``n_lines``, ``n_dropped`` and ``kept_text`` to the columns of ``docs``
    (columns of these names are replaced). Null text is one empty line. Rows with
    the same doc_id count as one document; rows without doc_id count for nothing and
    lose nothing. Keys are compared by 128 bits of
    hash. An empty table gives an empty result.

    The documents' line hashes are cut into batches of falling doc_id, added one
    after the other to :class:`LineRuns`. Counts are partial before each shuffle and
    the join of lines with frequent keys is one Spark can split, so a line found
    in most documents is no single group. Texts move once, in the join with the
    numbers of their dropped lines.
    """
    lines = pin(_long_lines(docs))
    shares = [n / batches for n in range(1, batches)]
    cuts = lines.agg(F.percentile_approx("doc_id", shares)).first()[0] if shares else None
    edges = sorted(set(cuts or ()), reverse=True)
    runs = LineRuns()
    upper = None
    for edge in [*edges, None]:
        part = lines
        if upper is not None:
            part = part.filter(F.col("doc_id") <= upper)
        if edge is not None:
            part = part.filter(F.col("doc_id") > edge)
        runs.add(part)
        upper = edge

    # Written first: Spark splits a large key's rows only between plain exchanges.
    frequent = pin(runs.frequent())
    doomed = lines.join(frequent, ["h1", "h2"]).filter("doc_id <> keeper")
    dropped = doomed.groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set("pos").alias("_dropped")
    )
    base = docs.drop("n_lines", "n_dropped", "kept_text", "_dropped", "_id", "_lines")
    joined = base.join(dropped, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    joined = computed_once(joined, "_lines", F.split(text_of(), "\n"))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.transform(F.array_except(every, "_dropped"), lambda n: F.get("_lines", n))
    return joined.withColumns(
        {
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dropped": F.coalesce(F.array_size("_dropped"), F.lit(0)).cast("bigint"),
            "kept_text": F.when(F.col("_dropped").isNull(), text_of()).otherwise(
                F.array_join(kept, "\n")
            ),
        }
    ).drop("_dropped", "_lines")
