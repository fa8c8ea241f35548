"""Merkle manifest of a table: each parent's children spread into slot columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.runtime import pin

FANOUT = 2
# Columns a leaf is made of, in this order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# Rows whose unsigned crc32 of the decimal doc_id this divides are tampered with.
TAMPER_EVERY = 7
# Bits of a row's place inside its task, as Spark numbers rows.
PLACE_BITS = 33
# The tree over the trees.
TOP = ""

_PATH = "array<struct<before: string, after: string>>"


def leaf_digest(values: list[Column]) -> Column:
    """Digest of some values: each its UTF-8 byte count, a colon and itself, or ``-`` for null."""
    spelled = []
    for value in values:
        text = value.cast("string")
        spelled.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*spelled), 256)


def with_positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, from 0 without gaps in each ``tree`` by ``order``, and the tree's row count ``n``.

    Rows are dealt out in ranges of tree and order, so a tree with most of the
    rows is many tasks. The tasks' counts, a row per task and tree, tell where each starts.
    """
    keys = ["tree", *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = pin(dealt.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", PLACE_BITS).alias("_task")
    counts = placed.groupBy("tree", task).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("tree").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumns(
        {
            "_start": F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first"),
            "n": F.sum("_rows").over(Window.partitionBy("tree")),
        }
    )
    numbered = placed.withColumn("_task", F.shiftright("_at", PLACE_BITS))
    numbered = numbered.join(pin(starts.select("tree", "_task", "_start", "n")), ["tree", "_task"])
    return numbered.withColumn("pos", F.col("_start") + F.col("_at")).drop("_task", "_at", "_start")


def _slots(fanout: int) -> list[str]:
    return [f"slot_{n}" for n in range(fanout)]


def climb(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """All levels above ``(tree, pos, n, digest)``, lowest first.

    A level has a row per parent, ``(tree, pos, n, digest, slot_0, ...)``: conditional
    aggregates put each child into the column of its slot, and the digest is that of the columns
    one after the other. ``n`` is the tree's number of nodes on the level; trees
    that are down to one node go no higher. Levels are written to the shared folder and
    shrink by the fanout, so all of them are little more than the leaves.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = []
    while most > 1:
        pos, slot = F.col("pos"), F.col("pos") % fanout
        spread = [F.max(F.when(slot == n, F.col("digest"))).alias(name) for n, name in enumerate(_slots(fanout))]
        parents = (
            nodes.filter("n > 1")
            .groupBy("tree", F.floor(pos / fanout).alias("pos"))
            .agg(F.max(F.ceil(F.col("n") / fanout)).alias("n"), *spread)
        )
        nodes = pin(parents.withColumn("digest", F.sha2(F.concat_ws("", *_slots(fanout)), 256)))
        levels.append(nodes)
        most = -(-most // fanout)
    return levels


def descend(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Add ``path`` to ``nodes``: the siblings on the way up, lowest first.

    An entry is the digests before and after the own slot among the parent's columns. From the top
    level down each row joins its parent's row, taking the parent's path with the columns but its
    own in front; a tree's last node takes its path from ``tops`` (tree, path), and its
    other columns come along.
    """
    carried = [name for name in tops.columns if name not in ("tree", "path")]

    def with_path(rows: DataFrame, parents: DataFrame | None) -> DataFrame:
        last = rows.filter("n = 1").join(tops, "tree")
        if parents is None:
            return last
        up = parents.select("tree", F.col("pos").alias("_up"), *_slots(fanout), F.col("path").alias("_path"), *carried)
        slot = F.col("pos") % fanout
        # Levels carry slot columns of their own, for their children.
        below = rows.filter("n > 1").select("*", F.floor(F.col("pos") / fanout).alias("_up"))
        own = [name for name in rows.columns if name in _slots(fanout)]
        below = below.withColumnsRenamed({name: f"_own_{name}" for name in own})
        before = F.concat_ws("", *(F.when(slot > n, F.col(name)) for n, name in enumerate(_slots(fanout))))
        after = F.concat_ws("", *(F.when(slot < n, F.col(name)) for n, name in enumerate(_slots(fanout))))
        step = F.struct(before.alias("before"), after.alias("after"))
        joined = below.join(up, ["tree", "_up"]).withColumn("path", F.concat(F.array(step), F.col("_path")))
        joined = joined.drop(*_slots(fanout)).withColumnsRenamed({f"_own_{name}": name for name in own})
        return joined.select(*rows.columns, "path", *carried).unionByName(last)

    parents = None
    for level in reversed(levels):
        parents = pin(with_path(level.drop("digest"), parents))
    return with_path(nodes, parents)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def merkle_manifest(docs: DataFrame, fanout: int = FANOUT, tamper_every: int = TAMPER_EVERY) -> DataFrame:
    """Every row's leaf, the roots above it, its proof, and what the proof gives.

    ``(doc_id, leaf, subroot, root, path, tampered, folded_root, verified)``. Leaves
    of one lang ascend by doc_id in a tree whose last node is the lang's subroot; subroots by lang, null
    first, are the leaves of the top tree. ``path`` has the siblings up to the root.
    ``folded_root`` is recomputed from the path and the leaf, or the leaf the row has
    with one more n_chars where ``tamper_every`` divides the unsigned crc32 of its
    doc_id; ``verified`` tells whether it is the root.

    Any column may be null: null doc_ids come first and are not tampered with, null
    n_chars stay null when tampered with. Rows that share a doc_id are leaves of their own, in
    the order of their digests. A row alone in its lang is the subroot, and a lang alone the
    root. Other columns are not read; an empty table gives an empty result.

    Texts are read once. Positions come from ranges of lang and doc_id, never from one
    task per lang, and each level is an aggregate of the one below.
    """
    values = [F.col(name) for name in LEAF_COLUMNS]
    more = [F.col(name) + 1 if name == "n_chars" else F.col(name) for name in LEAF_COLUMNS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper_every == 0
    leaves = docs.select(
        "doc_id",
        # Null sorts before any lang.
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree"),
        leaf_digest(values).alias("digest"),
        F.when(chosen, leaf_digest(more)).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = pin(with_positions(pin(leaves), ["doc_id", "digest", "row"]).drop("row"))
    nodes = leaves.select("tree", "pos", "n", "digest")
    levels = climb(nodes, fanout)
    last = reduce(DataFrame.unionByName, [x.filter("n = 1").select("tree", "digest") for x in [nodes, *levels]])

    subroots = last.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest")
    subroots = pin(with_positions(subroots, ["name"]))
    top_levels = climb(subroots.select("tree", "pos", "n", "digest"), fanout)
    roots = [x.filter("n = 1").select("tree", F.col("digest").alias("root")) for x in [subroots, *top_levels]]
    # One row, or none for an empty table.
    start = reduce(DataFrame.unionByName, roots).withColumn("path", F.array().cast(_PATH))
    tops = descend(subroots, top_levels, start, fanout)
    tops = pin(tops.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path"))

    found = descend(leaves, levels, tops.select("tree", "path"), fanout)
    found = found.join(tops.select("tree", "subroot", "root"), "tree")
    found = found.withColumn("folded_root", folded(F.coalesce("tampered", "digest"), F.col("path")))
    return found.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "path",
        F.col("tampered").isNotNull().alias("tampered"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def siblings(path: Column) -> Column:
    """A path's sibling digests one after the other, from the bottom, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")
