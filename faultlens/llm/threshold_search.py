"""Exact top-k inner products from sorted lists, read in order without random access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.runtime import pin

K = 5
EVERY = 50
SCALE = 256
# Candidates that share sorted lists, and queries that are answered together.
BLOCK, QUERIES = 8192, 512
# Shares of the lists that are read before the bounds are looked at again.
DEPTHS = (1 / 64, 1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 1)
# Contenders, as a share of a block, that are settled instead of read on for.
FEW = 1 / 32
# Whole numbers up to here are exact in single and in double precision.
SINGLE, DOUBLE = 2.0**24, 2.0**53


def _usable() -> Column:
    good = (
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    return F.coalesce(good, F.lit(False))


def _whole(values: list[float], scale: float) -> np.ndarray:
    """``floor(scale * x)``; products beyond double precision stop at its end."""
    with np.errstate(over="ignore"):
        found = np.floor(np.array(values, np.float64) * scale)
    limit = np.finfo(np.float64).max
    return np.clip(found, -limit, limit)


def _whole_vectors(table: DataFrame, scale: float) -> DataFrame:
    """``(vec_id, width, vector)`` of usable rows, the components as doubles."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [_whole(one.as_py(), scale) for one in batch.column(1)]
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array([len(x) for x in vectors], pa.int32()),
                 pa.array([x.astype("<f8").tobytes() for x in vectors], pa.binary())],
                names=["vec_id", "width", "vector"],
            )

    rows = table.filter(_usable()).select("vec_id", "embedding")
    return rows.mapInArrow(packed, "vec_id bigint, width int, vector binary")


class SortedLists:
    """A list of a block's rows per dimension, by value, read from either end.

    Queries take a list from the top where their weight is positive and from the bottom where it
    is negative. After some depth, a row's unread values lie between the list's
    far end and the last value read: with these in their place the weighted
    sums are bounds of the row's score.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.order, axis=0)
        self.read_top = np.zeros(x.shape, bool)
        self.read_low = np.zeros(x.shape, bool)
        self.depth = 0

    def best(self, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """The most any row could score, by the heads of the lists."""
        return up @ self.values[-1] + down @ self.values[0]

    def read(self, depth: int) -> None:
        """Go on in every list, from both ends, to this many rows."""
        rows = len(self.x)
        columns = np.arange(self.x.shape[1])
        self.read_top[self.order[rows - depth : rows - self.depth], columns] = True
        self.read_low[self.order[self.depth : depth], columns] = True
        self.depth = depth

    def bounds(self, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of every query's score with every row."""
        low, high = self.values[0], self.values[-1]
        last_top, last_low = self.values[len(self.x) - self.depth], self.values[self.depth - 1]
        x, top, bottom = self.x, self.read_top, self.read_low
        lower = up @ np.where(top, x, low).T + down @ np.where(bottom, x, high).T
        upper = up @ np.where(top, x, last_top).T + down @ np.where(bottom, x, last_low).T
        return lower, upper


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers of any size."""
    return np.array([[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q], object).reshape(len(q), len(x))


def top_of_block(
    q: np.ndarray, q_rows: np.ndarray, floors: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """Of every query, the places and scores of the rows of a block among its ``k`` best.

    ``floors`` are scores known to be reached by ``k`` rows. Of ``q_rows`` and
    ``rows``, equal numbers are the same row, which is not its own candidate. Rows that cannot
    reach the k-th best lower bound, or the floor, are given up; the rest are scored.
    """
    reach = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1]
    if not reach < DOUBLE:
        contenders = np.ones((len(q), len(x)), bool)
        scores = _exact(q, x)
    else:
        kind = np.float32 if reach < SINGLE else np.float64
        contenders = _contenders(q.astype(kind), q_rows, floors, x.astype(kind), rows, k)
        scores = None
    contenders &= q_rows[:, None] != rows[None, :]
    for n in np.flatnonzero(contenders.any(axis=1)):
        places = np.flatnonzero(contenders[n])
        own = (x[places] @ q[n]).astype(np.int64) if scores is None else scores[n][places]
        order = sorted(range(len(places)), key=lambda m: (-own[m], ids[places[m]], rows[places[m]])) if scores is not None else (
            np.lexsort((rows[places], ids[places], -own))
        )
        kept = order[:k]
        yield int(n), places[kept], [int(own[m]) for m in kept]


def _contenders(
    q: np.ndarray, q_rows: np.ndarray, floors: np.ndarray, x: np.ndarray, rows: np.ndarray, k: int
) -> np.ndarray:
    """Which rows may still be among each query's best when reading stops."""
    lists = SortedLists(x)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    found = np.zeros((len(q), len(x)), bool)
    # Queries whose floor no row here can reach read nothing.
    live = np.flatnonzero(lists.best(up, down) >= floors)
    for share in DEPTHS:
        if not len(live):
            break
        lists.read(max(1, min(len(x), int(np.ceil(share * len(x))))))
        lower, upper = lists.bounds(up[live], down[live])
        # The query's own row says nothing about the others.
        own = q_rows[live][:, None] == rows[None, :]
        lower[own] = -np.inf
        upper[own] = -np.inf
        reached = floors[live]
        if len(x) >= k:
            reached = np.maximum(reached, np.partition(lower, len(x) - k, axis=1)[:, len(x) - k])
        possible = upper >= reached[:, None]
        done = possible.sum(axis=1) <= max(k, FEW * len(x))
        if share == DEPTHS[-1]:
            done[:] = True
        found[live[done]] = possible[done]
        live = live[~done]
    return found


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = [np.frombuffer(one.as_py(), "<f8") for one in table.column("vector")]
    ids, rows = (table.column(name).to_numpy() for name in ("vec_id", "row"))
    return np.stack(vectors), ids, rows


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a block of bounded size, and the number of blocks of each width."""
    counts = rows.groupBy("width").agg(F.count("*").alias("n"))
    counts = pin(counts.select("width", F.ceil(F.col("n") / size).alias(f"{name}s")))
    dealt = rows.join(counts, "width")
    return dealt.withColumn(name, F.pmod(F.xxhash64("row"), F.col(f"{name}s"))).drop(f"{name}s"), counts


def _met(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """``(query, query_id, vec_id, row, score)``: the best of each block of candidates for each query.

    Both sides have ``(width, block, group)``: a block of candidates and a group of queries meet in one call,
    whose size is bounded whatever the tables hold.
    """

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            q, q_ids, q_rows = _matrix(left)
            x, ids, rows = _matrix(right)
            floors = left.column("floor").to_numpy(zero_copy_only=False)
            for n, places, scores in top_of_block(q, q_rows, floors, x, ids, rows, k):
                for place, score in zip(places, scores, strict=True):
                    limited = max(-(2**63), min(2**63 - 1, score))
                    out.append((q_rows[n], q_ids[n], ids[place], rows[place], limited, float(score)))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = [pa.int64()] * 5 + [pa.float64()]
        names = ["query", "query_id", "vec_id", "row", "score", "near"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    key = ["width", "block", "group"]
    pairs = queries.groupBy(*key).cogroup(candidates.groupBy(*key))
    return pairs.applyInArrow(met, "query bigint, query_id bigint, vec_id bigint, row bigint, score bigint, near double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("near"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_inner_products(
    table: DataFrame, every: int = EVERY, k: int = K, scale: float = SCALE, block: int = BLOCK, group: int = QUERIES
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows for each query, by inner product.

    Components count as ``floor(scale * x)``. Queries are the rows whose vec_id ``every`` divides, and
    candidates all rows but the query's own; equal scores go to the smaller vec_id.
    Vectors that are null or empty, or hold null or non-finite components, take no part, nor do rows
    without vec_id; vectors of different lengths do not meet. Rows that share a vec_id are
    rows of their own, as queries and as candidates. Scores are exact; beyond 64 bits
    they stop at the end of the range. Other columns are not read; an empty table
    gives an empty result.

    Candidates are dealt into blocks, with a sorted list per dimension each, and
    queries into groups. Every group first meets one block, whose k-th score is a floor for
    the query. Then it meets all blocks: lists are read in order until the rows that
    cannot reach the floor, or the k-th best lower bound, are left out, and the scores of the
    others are settled. A block sends at most ``k`` rows a query.
    """
    rows = _whole_vectors(table, scale).withColumn("row", F.monotonically_increasing_id())
    rows = pin(rows)
    candidates, blocks = _blocks(rows, block, "block")
    queries, groups = _blocks(rows.filter(F.col("vec_id") % every == 0), group, "group")
    queries, candidates = pin(queries), pin(candidates)
    sizes = pin(blocks.join(groups, "width"))

    # Each group and one block: the groups of a block are spread by their number.
    first = queries.join(sizes, "width").withColumn("block", F.col("group") % F.col("blocks"))
    first = first.withColumn("floor", F.lit(float("-inf"))).drop("blocks", "groups")
    met = candidates.join(sizes, "width").filter("block < groups")
    own = F.sequence(F.col("block"), F.col("groups") - 1, F.col("blocks"))
    met = met.withColumn("group", F.explode(own)).drop("blocks", "groups")
    seen = _ranked(_met(first, met, k), k)
    floors = pin(seen.filter(F.col("rank") == k).select("query", F.col("near").alias("floor")))

    known = queries.join(floors, F.col("row") == F.col("query"), "left").drop("query")
    known = known.withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).join(sizes, "width")
    known = known.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    spread = candidates.join(sizes, "width")
    spread = spread.withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)))
    found = _ranked(_met(known.drop("blocks", "groups"), spread.drop("blocks", "groups"), k), k)
    return found.select("query_id", "rank", "vec_id", "score")
