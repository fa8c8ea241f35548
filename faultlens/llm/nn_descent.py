"""Embedding near-duplicates by NN-descent over a neighbour graph, with an audit of its recall."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.components import connected_components
from faultlens.runtime import pin

THRESHOLD = 0.95
# Neighbours a list starts with; orders of the vectors the first graph comes from.
NEIGHBOURS = 8
ORDERS = 6
# Rounds of refinement that find no link before a search ends, and the seed of the orders.
ROUNDS = 2
SEED = 0
# Searches, each with new orders and lists twice as long, before all vectors are compared.
TRIES = 4
# Vectors with links, and as many without, whose links the audit counts; bytes of either.
AUDIT = 1024
AUDIT_BYTES = 4 << 20
# Rows of a component, or of all, compared with each other in one step.
BLOCK = 1024
# Rows a task of the search collects before it gives them out.
GIVEN = 1 << 16
# Inner products of unit vectors in single precision are good to this.
SLACK = 1e-4


def _usable() -> Column:
    good = (
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    return F.coalesce(good, F.lit(False))


def _unit_vectors(table: DataFrame) -> DataFrame:
    """``(vec_id, vector)`` of usable rows: components in double precision as bytes."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = []
            for one in batch.column(1):
                x = np.array(one.as_py(), "<f8")
                # Scaled first, so that squares neither overflow nor vanish.
                x /= np.abs(x).max()
                vectors.append((x / np.sqrt((x * x).sum())).tobytes())
            yield pa.record_batch([batch.column(0), pa.array(vectors, pa.binary())], names=["vec_id", "vector"])

    rows = table.filter(_usable()).select("vec_id", "embedding")
    return rows.mapInArrow(packed, "vec_id bigint, vector binary")


def _in_single(points: DataFrame) -> DataFrame:
    """The same vectors in single precision, half the bytes for lists to carry."""

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.frombuffer(x, "<f8").astype("<f4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(blobs, pa.binary())], names=["vec_id", "vector"])

    return points.mapInArrow(cast, "vec_id bigint, vector binary")


def _labelled(vectors: DataFrame, parts: DataFrame) -> DataFrame:
    """``(vec_id, part, vector)``: vectors and their components, of themselves without links."""
    named = vectors.join(parts.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    return named.select("vec_id", F.coalesce("component", "vec_id").alias("part"), "vector")


def _orders(labelled: DataFrame, rows: int, seed: int) -> DataFrame:
    """Every vector in ``ORDERS`` orders, each by the signs of random projections.

    Vectors at a small angle mostly share all signs, and stand near each other.
    There are as many signs as make a group of equal ones small on average.
    """
    bits = int(np.clip(np.ceil(np.log2(max(2, rows))), 4, 40))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            by_width: dict[int, list[int]] = {}
            blobs = batch.column(2).to_pylist()
            for n, blob in enumerate(blobs):
                by_width.setdefault(len(blob) // 4, []).append(n)
            ids, parts = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for width, places in by_width.items():
                if width not in planes:
                    planes[width] = np.random.default_rng([seed, width]).normal(size=(ORDERS * bits, width)).astype("<f4")
                x = np.stack([np.frombuffer(blobs[n], "<f4") for n in places])
                above = (x @ planes[width].T > 0).reshape(len(places), ORDERS, bits)
                keys = above @ powers
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(ids[places], ORDERS)),
                        pa.array(np.repeat(parts[places], ORDERS)),
                        pa.array(np.tile(np.arange(ORDERS, dtype=np.int32), len(places))),
                        pa.array(np.full(len(places) * ORDERS, width, np.int32)),
                        pa.array(keys.ravel()),
                    ],
                    names=["vec_id", "part", "nth", "width", "key"],
                )

    return labelled.mapInArrow(signed, "vec_id bigint, part bigint, nth int, width int, key bigint")


def _first_links(orders: DataFrame, each: int) -> DataFrame:
    """Pairs of a vector with the one before it, and with the last of each of the ``each`` runs before.

    A run is of vectors of one component that follow each other in an order, so a
    component of any size hides nothing. The orders are range-partitioned, so a
    group of equal keys is spread over tasks.
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.empty((0, 4), np.int64)
        for batch in batches:
            fresh = np.stack([np.asarray(batch.column(n)).astype(np.int64) for n in range(4)], axis=1)
            if not len(fresh):
                continue
            rows = np.concatenate([tail, fresh])
            run = np.concatenate([[0], np.cumsum((rows[1:, 1:] != rows[:-1, 1:]).any(axis=1))])
            ends = np.concatenate([np.flatnonzero(run[1:] != run[:-1]), [len(rows) - 1]])
            new = np.arange(len(tail), len(rows))
            before = new[(new > 0) & (run[new] == run[new - 1])]
            found = [np.stack([rows[before, 0], rows[before - 1, 0]], axis=1)]
            for step in range(1, each + 1):
                own = new[run[new] >= step]
                last = ends[run[own] - step]
                # Of one order and width.
                same = (rows[own, 2:] == rows[last, 2:]).all(axis=1)
                found.append(np.stack([rows[own[same], 0], rows[last[same], 0]], axis=1))
            pairs = np.concatenate(found)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            tail = rows[ends[-each - 1 :]]

    # Ties in the key are told apart by a hash, not by the ids.
    place = ["nth", "width", "key", F.xxhash64("vec_id", "nth")]
    dealt = orders.repartitionByRange(*place).sortWithinPartitions(*place).select("vec_id", "part", "nth", "width")
    return dealt.mapInArrow(linked, "a bigint, b bigint").filter("a <> b").distinct()


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _lists(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``(center, members)``: of each center, itself and its members with their components and vectors."""
    own = labelled.select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b"))
    joined = pairs.select("a", "b").union(own).join(labelled.withColumnRenamed("vec_id", "b"), "b")
    return joined.groupBy(F.col("a").alias("center")).agg(
        F.collect_list(F.struct("b", "part", "vector")).alias("members")
    )


def _local_joins(lists: DataFrame, each: int) -> DataFrame:
    """Pairs of members of one list, neighbours of neighbours: ``(a, b, part, own, cosine)``.

    A list proposes to every member its ``each`` nearest in the list of its own component,
    and of others, the nearest of each. Lists are bounded by the caller.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "part", "own", "cosine"]
        for batch in batches:
            out, size = [], 0
            for members in batch.column(0):
                rows = members.as_py()
                ids = np.array([row["b"] for row in rows], np.int64)
                if len(ids) < 2:
                    continue
                parts = np.array([row["part"] for row in rows], np.int64)
                x = np.stack([np.frombuffer(row["vector"], "<f4") for row in rows])
                cosine = x @ x.T
                np.fill_diagonal(cosine, -2)
                same = parts[:, None] == parts[None, :]
                foreign = np.where(same, np.float32(-2), cosine)
                kinds, sizes = np.unique(parts, return_counts=True)
                for kind in kinds[sizes > 1]:
                    # Of a component, only the member nearest to a row takes a place.
                    places = np.flatnonzero(parts == kind)
                    best = places[foreign[:, places].argmax(axis=1)]
                    value = foreign[np.arange(len(ids)), best]
                    foreign[:, places] = -2
                    foreign[np.arange(len(ids)), best] = value
                for own, near in ((False, foreign), (True, np.where(same, cosine, np.float32(-2)))):
                    if own and len(kinds) == len(ids):
                        continue
                    top = np.argsort(-near, axis=1, kind="stable")[:, :each]
                    value = np.take_along_axis(near, top, 1).ravel()
                    a, top, seen = np.repeat(ids, top.shape[1]), top.ravel(), value > -2
                    out.append((a[seen], ids[top[seen]], parts[top[seen]], np.full(seen.sum(), own), value[seen]))
                    size += len(a)
                if size >= GIVEN:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)

    return lists.select("members").mapInArrow(joined, "a bigint, b bigint, part bigint, own boolean, cosine float")


def _first(pairs: DataFrame, each: int, *order: Column) -> DataFrame:
    """The first ``each`` rows of every vector, within its component and outside it."""
    place = F.row_number().over(Window.partitionBy("a", "own").orderBy(*order))
    return pairs.withColumn("nth", place).filter(F.col("nth") <= each).drop("nth")


def _nearest(pairs: DataFrame, each: int) -> DataFrame:
    """The ``each`` nearest neighbours of every vector in its component, and in others the nearest of each."""
    slot = F.when(F.col("own"), F.col("b")).otherwise(F.col("part"))
    best = pairs.groupBy("a", "own", slot.alias("slot")).agg(F.max(F.struct("cosine", "b")).alias("x"))
    return _first(best.select("a", "own", "x.b", "x.cosine"), each, F.desc("cosine"), F.asc("b"))


def _candidates(graph: DataFrame, each: int) -> DataFrame:
    """Lists for the next local joins: neighbours, and as many of those they are neighbours of."""
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "own")
    back = _first(back, each, F.xxhash64("a", "b"))
    return graph.select("a", "b").union(back.select("a", "b")).distinct()


def _within(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a < b`` whose cosine in double precision reaches the threshold."""
    near = pairs.filter(F.col("cosine") >= threshold - SLACK)
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = near.join(vectors.select(F.col("vec_id").alias("a"), F.col("vector").alias("x")), "a")
    both = both.join(vectors.select(F.col("vec_id").alias("b"), F.col("vector").alias("y")), "b")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs_of = zip(batch.column(2), batch.column(3), strict=True)
            dots = [np.frombuffer(x.as_py(), "<f8") @ np.frombuffer(y.as_py(), "<f8") for x, y in pairs_of]
            own = pa.array(np.array(dots) >= threshold)
            yield pa.record_batch([batch.column(0).filter(own), batch.column(1).filter(own)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(kept, "a bigint, b bigint")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few pairs as connect what the pairs ``(a, b)`` connect: each id with its least."""
    ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    least = np.arange(len(ids))
    while True:
        low = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    own = least != np.arange(len(ids))
    return ids[own], ids[least[own]]


def _audit(named: DataFrame, rows: int, seed: int, threshold: float) -> tuple[int, int]:
    """Links of a bounded draw of vectors, by comparison with all, and how many of them lie between components.

    Drawn by hash are ``rows`` of the vectors with links, where a search has most to
    miss, and as many of those without.
    """
    order = F.xxhash64("vec_id", F.lit(seed))
    drawn: dict[int, list] = {}
    for linked in (True, False):
        for row in named.filter(F.col("linked") == linked).orderBy(order).limit(rows).collect():
            drawn.setdefault(len(row.vector) // 8, []).append(row)
    queries = {
        width: (
            np.array([row.vec_id for row in some]),
            np.array([row.part for row in some]),
            np.stack([np.frombuffer(row.vector, "<f8") for row in some]),
        )
        for width, some in drawn.items()
    }
    shared = named.sparkSession.sparkContext.broadcast(queries)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(2).to_pylist()
            by_width: dict[int, list[int]] = {}
            for n, blob in enumerate(blobs):
                by_width.setdefault(len(blob) // 8, []).append(n)
            ids, parts = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            links = missed = 0
            for width, places in by_width.items():
                for low in range(0, len(places) if width in shared.value else 0, BLOCK):
                    of, part, y = shared.value[width]
                    some = places[low : low + BLOCK]
                    near = np.stack([np.frombuffer(blobs[n], "<f8") for n in some]) @ y.T >= threshold
                    near &= ids[some][:, None] != of[None, :]
                    links += int(near.sum())
                    missed += int((near & (parts[some][:, None] != part[None, :])).sum())
            yield pa.record_batch([pa.array([links]), pa.array([missed])], names=["links", "missed"])

    found = named.select("vec_id", "part", "vector").mapInArrow(compared, "links bigint, missed bigint")
    total = found.agg(F.sum("links").alias("links"), F.sum("missed").alias("missed")).first()
    shared.destroy()
    return total.links or 0, total.missed or 0


def _links_between(named: DataFrame, rows: int, threshold: float) -> DataFrame:
    """Pairs of components ``(a, b)`` that vectors of theirs link, by comparing all vectors.

    For tables the search has failed on. Each pair of blocks of at most about ``BLOCK``
    rows is one group; of its links between components it gives as few as connect
    them. The cost is the square of the vectors.
    """
    blocks = -(-rows // BLOCK)
    placed = named.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    groups = spread.groupBy(
        F.length("vector").alias("width"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    ).agg(F.collect_list(F.struct("part", "own", "vector")).alias("rows"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, members in zip(*batch.columns, strict=True):
                members = members.as_py()
                parts = np.array([row["part"] for row in members], np.int64)
                own = np.array([row["own"] for row in members])
                x = np.stack([np.frombuffer(row["vector"], "<f8") for row in members])
                p, q = own == lo.as_py(), own == hi.as_py()
                near = (x[p] @ x[q].T >= threshold) & (parts[p][:, None] != parts[q][None, :])
                i, j = np.nonzero(near)
                if len(i):
                    a, b = _forest(parts[p][i], parts[q][j])
                    yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return groups.select("lo", "hi", "rows").mapInArrow(compared, "a bigint, b bigint").distinct()


def _components(points: DataFrame, threshold: float) -> DataFrame:
    """``(id, component)`` of the vectors with links, by NN-descent."""
    spark = points.sparkSession
    size = points.agg(F.count("*").alias("rows"), F.max(F.length("vector")).alias("bytes")).first()
    drawn = min(AUDIT, AUDIT_BYTES // max(1, size.bytes or 1))
    light = pin(_in_single(points))
    parts = spark.createDataFrame([], "id long, component long")
    labelled = pin(_labelled(light, parts))
    links: list[DataFrame] = []
    graph = None
    for nth in range(TRIES):
        each = NEIGHBOURS << nth
        pairs = _both_ways(_first_links(_orders(labelled, size.rows, SEED + nth), 2))
        if graph is not None:
            pairs = pairs.union(_candidates(graph, each)).distinct()
        quiet = 0
        while quiet <= ROUNDS:
            graph = pin(_nearest(_local_joins(_lists(pairs, labelled), each), each))
            new = pin(_within(graph.filter(~F.col("own")), points, threshold))
            if new.isEmpty():
                quiet += 1
            else:
                # Linked neighbours join the component, and others take their places in the list.
                links.append(new)
                parts = pin(connected_components(reduce(DataFrame.union, links)))
                labelled = pin(_labelled(light, parts))
            pairs = _candidates(graph, each)
        linked = parts.select(F.col("id").alias("vec_id"), F.lit(True).alias("linked"))
        named = _labelled(points, parts).join(linked, "vec_id", "left")
        named = pin(named.withColumn("linked", F.coalesce("linked", F.lit(False))))
        _, missed = _audit(named, drawn, SEED + nth, threshold)
        if not missed:
            return parts
    between = pin(_links_between(named, size.rows, threshold))
    return parts if between.isEmpty() else pin(connected_components(reduce(DataFrame.union, [*links, between])))


def _link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """Links of every vector within its component: ``(vec_id, n)``, weights of copies included.

    The list of a vector that has more near neighbours than it holds is enlarged to
    its whole component, in blocks of at most about ``BLOCK`` rows: each pair of
    blocks is one group, so a component of any size is many groups of bounded
    size, and what comes out is one count per row and block.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    sizes = pin(sizes.select("component", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    placed = members.join(sizes, "component").withColumn(
        "own", F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("bigint")).cast("int")
    )
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # A row meets block n from the lower side, from the upper one, or both in its own block.
    spread = placed.withColumn("other", F.explode(every))
    groups = spread.groupBy("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    groups = groups.agg(F.collect_list(F.struct("vec_id", "weight", "own", "vector")).alias("rows"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_ids, out_n = [], []
            for lo, hi, rows in zip(*batch.columns, strict=True):
                rows = rows.as_py()
                ids = np.array([row["vec_id"] for row in rows], np.int64)
                weights = np.array([row["weight"] for row in rows], np.int64)
                upper = np.array([row["own"] for row in rows]) == hi.as_py()
                x = np.stack([np.frombuffer(row["vector"], "<f8") for row in rows])
                if lo.as_py() == hi.as_py():
                    near = x @ x.T >= threshold
                    np.fill_diagonal(near, False)
                    out_ids.append(ids)
                    out_n.append(near @ weights)
                else:
                    near = x[~upper] @ x[upper].T >= threshold
                    out_ids += [ids[~upper], ids[upper]]
                    out_n += [near @ weights[upper], near.T @ weights[~upper]]
            yield pa.record_batch(
                [pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(out_n).astype(np.int64))], names=["vec_id", "n"]
            )

    found = groups.select("lo", "hi", "rows").mapInArrow(counted, "vec_id bigint, n bigint")
    return found.groupBy("vec_id").agg(F.sum("n").alias("n"))


def embedding_groups(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of a table of embeddings.

    Rows link at a cosine, in double precision, of at least ``threshold``. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, as do
    vectors of different lengths with each other. Rows that share a vec_id are rows
    of their own with equal results only if their vectors are equal; a row without vec_id
    links with nothing and has null results but for ``n_links``. Other columns are not
    looked at; an empty table gives an empty result.

    Equal vectors are one class with a weight. A first neighbour graph comes from orders by
    random projections. Rounds of NN-descent then join the neighbours of neighbours:
    each vector's list, bounded, is a group whose members propose each other. Pairs
    that reach the threshold are verified in double precision, and their components
    joined. A list has places for the nearest of the vector's own component and for
    the nearest of each other one, so a list full of links is enlarged by the whole
    component and its places go to vectors further off; rounds go on while any link
    between components is found, and ``ROUNDS`` more. An audit compares a bounded draw of
    vectors with all: if a link of theirs lies between two components, the search goes
    on with new orders and lists twice as long. After ``TRIES`` of these all vectors are compared
    in blocks, so a search that fails costs time and no links. An audit without a
    miss is an estimate: of tables larger than the draw, links may be lost. Links are counted
    within components, in blocks.
    """
    vectors = pin(_unit_vectors(table))
    classes = vectors.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    # Classes have numbers of their own: different vectors may share a vec_id.
    classes = pin(classes.withColumn("key", F.monotonically_increasing_id()))
    parts = _components(classes.select(F.col("key").alias("vec_id"), "vector"), threshold)
    members = parts.join(classes, F.col("id") == F.col("key"))
    members = pin(members.select("component", F.col("id").alias("vec_id"), "rep", "weight", "vector"))
    least = pin(members.groupBy("component").agg(F.min("rep").alias("least")))
    counts = pin(_link_counts(members, threshold))
    found = members.select("vec_id", "component").join(counts, "vec_id").join(least, "component")
    named = pin(
        classes.join(found, F.col("key") == F.col("vec_id"), "left").select(
            "vector",
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("least", "rep").alias("component_id"),
        )
    )
    linked = vectors.join(named, "vector").select("vec_id", "n_links", "component_id")
    # Rows without a usable vector stand alone.
    alone = table.filter(~_usable()).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
