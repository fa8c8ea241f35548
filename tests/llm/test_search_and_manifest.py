"""Top-k search and the Merkle manifest against plain loops."""

import math
import random
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from faultlens.llm import threshold_search
from faultlens.llm.merkle_pivot import merkle_manifest, siblings
from faultlens.llm.oracles import LLM_ORACLES
from faultlens.llm.queries import op11_topk, op13_merkle
from faultlens.llm.threshold_search import top_inner_products
from pyspark.sql import functions as F

VECTORS = "vec_id bigint, embedding array<float>, rank int"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def best(rows, every, k):
    """The contract on ``(vec_id, embedding)`` rows, by loops over whole numbers."""
    usable = []
    for n, (vec_id, vector) in enumerate(rows):
        if vec_id is not None and vector and all(x is not None and math.isfinite(x) for x in vector):
            usable.append((n, vec_id, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for n, query_id, q in usable:
        if query_id % every == 0:
            scored = [(-sum(a * b for a, b in zip(q, x)), vec_id) for m, vec_id, x in usable if m != n and len(x) == len(q)]
            out += [(query_id, rank + 1, vec_id, -score) for rank, (score, vec_id) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def _found(spark, rows, **more):
    table = spark.createDataFrame([(n, x, 7) for n, x in rows], VECTORS)
    return sorted(tuple(row) for row in top_inner_products(table, **more).collect())


def _vectors(many, width, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(many, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("block, group", [(8192, 512), (40, 3)])
def test_search_equals_loops(spark, block, group):
    rows = [(n, x.tolist()) for n, x in enumerate(_vectors(300, 8, 0))]
    assert _found(spark, rows, every=20, block=block, group=group) == best(rows, 20, 5)


def test_ties_copies_and_fewer_rows_than_asked(spark):
    same = [(n, [0.5, -0.25]) for n in range(60)] + [(n, [0.5, -0.5]) for n in range(60, 70)]
    assert _found(spark, same, every=50, block=16, group=1) == best(same, 50, 5)
    few = [(0, [1.0, 2.0]), (1, [1.0, -2.0]), (50, [3.0, 1.0])]
    assert _found(spark, few) == best(few, 50, 5)
    # Rows with one vec_id are rows of their own.
    repeated = [(50, [1.0]), (50, [2.0]), (3, [1.5])]
    assert _found(spark, repeated) == best(repeated, 50, 5)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 1.0]), (50, None), (100, [float("nan"), 1.0]), (150, [None, 1.0]), (None, [1.0, 1.0]),
            (200, []), (1, [float("inf"), 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [-1.0, 2.5])]
    assert _found(spark, rows) == best(rows, 50, 5)
    assert _found(spark, []) == []


def test_large_components_are_exact(spark):
    rows = [(0, [1e12, 3.0, -1e9]), (50, [1e12, 1.0, 1e9]), (1, [1e10, 2.0, 7.0]), (2, [1e10, 2.0, 6.5]), (3, [-1.0, 0.0, 0.0])]
    exact = best(rows, 50, 5)
    assert _found(spark, rows) == sorted((q, r, v, max(-(2**63), min(2**63 - 1, s))) for q, r, v, s in exact)


def test_reading_stops_early_and_keeps_every_contender():
    x = np.round(_vectors(4000, 6, 3) * 256).astype(np.float64)
    x[:50] = x[0] * 3
    lists = threshold_search.SortedLists(x)
    q = x[:40]
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    for depth in (10, 500, 4000):
        lists.read(depth)
        lower, upper = lists.bounds(up, down)
        true = q @ x.T
        assert (lower <= true).all() and (true <= upper).all()
    assert (lower == upper).all()
    rows = np.arange(len(x))
    found = threshold_search._contenders(q, rows[:40], np.full(40, -np.inf), x, rows, 5)
    assert found.sum() < 0.1 * found.size
    floors = np.full(40, 1e9)
    assert not threshold_search._contenders(q, rows[:40], floors, x, rows, 5).any()


def _digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def manifest(rows, fanout=2):
    """The contract on rows (doc_id, text, lang, source, n_chars), by loops."""

    def leaf(doc_id, text, lang, source, n_chars):
        values = [None if x is None else str(x) for x in (doc_id, source, lang, n_chars, text)]
        return _digest(*("-" if x is None else f"{len(x.encode())}:{x}" for x in values))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            now = levels[-1]
            levels.append([_digest(*now[n : n + fanout]) for n in range(0, len(now), fanout)])
        return levels

    def path(levels, at):
        for level in levels[:-1]:
            first = at - at % fanout
            yield level[first:at], level[at + 1 : first + fanout]
            at //= fanout

    langs = sorted({row[2] for row in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((row for row in rows if row[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = own, climb([leaf(*row) for row in own])
    top = climb([trees[lang][1][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        own, levels = trees[lang]
        for n, row in enumerate(own):
            steps = [*path(levels, n), *path(top, place)]
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            more = None if row[4] is None else row[4] + 1
            node = leaf(*row[:4], more) if changed else leaf(*row)
            for before, after in steps:
                node = _digest(*before, node, *after)
            proof = _digest(*(x for before, after in steps for x in [*before, *after]))
            out.append((row[0], leaf(*row), levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def _manifest(spark, rows, fanout=2):
    docs = spark.createDataFrame([(*row, "x") for row in rows], f"{DOCS}, path string")
    found = merkle_manifest(docs, fanout).withColumn("proof", F.sha2(siblings(F.col("path")), 256))
    found = found.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified")
    return sorted((tuple(row) for row in found.collect()), key=repr)


def _docs(many, langs, seed):
    rng = random.Random(seed)
    return [(n, "é" * rng.randint(0, 5), rng.choice(langs), rng.choice(["s", None]), rng.choice([None, 3, 12])) for n in range(many)]


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_equals_loops(spark, fanout):
    rows = _docs(37, ["de", "en", None, "é", "z"], 4) + [(100, None, "lone", None, None)]
    found = _manifest(spark, rows, fanout)
    assert found == manifest(rows, fanout)
    assert not all(row[-1] for row in found) and any(row[-1] for row in found)


def test_manifest_of_few_and_of_repeated_rows(spark):
    for rows in ([(1, "a", "en", "s", 1)], [(7, "a", None, "s", 1), (8, "b", None, "s", 1)], []):
        assert _manifest(spark, rows) == manifest(rows)
    # An own lang for every row, a lang that is empty text, equal doc_ids, rows without doc_id.
    rows = [(n, "t", f"l{n}", "s", n) for n in range(6)] + [(1, "u", "", "s", 2), (1, "u", "", "s", 2), (1, "w", "", None, 2)]
    rows += [(None, "x", "", "s", 1), (None, "y", "", "s", 1), (None, "y" * 100_000, "", "s", 1)]
    assert _manifest(spark, rows) == manifest(rows)


@pytest.mark.parametrize("query, name, table", [(op11_topk, "op11_topk", "embeddings"), (op13_merkle, "op13_merkle", "documents")])
def test_queries_equal_sql(spark, query, name, table):
    folder = "/root/testdata/sf0.001"
    found = query(spark, folder)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    expected = connection.execute(f"SELECT {', '.join(found.columns)} FROM ({LLM_ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(expected)
