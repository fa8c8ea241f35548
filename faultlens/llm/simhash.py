"""SimHash near-duplicates by an inverted index of fingerprint bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import text_of
from faultlens.llm.components import connected_components
from faultlens.runtime import pin

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
POSITIONS = 8
# Two fingerprints that differ in MAX_BITS bits agree in so many bytes at least.
MIN_MATCHES = POSITIONS - MAX_BITS
# Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: str, words_each: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text, as a signed number; 0 without words."""
    # On bytes, lower() and split() know ASCII letters and white space alone.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words_each, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in spans]
    votes = np.zeros(64, np.int64)
    for low in range(0, len(hashes), BLOCK):
        block = np.array(hashes[low : low + BLOCK], ">u8")
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes))
    return int(bits.view(">i8")[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(text.as_py()) for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(printed, f"doc_id {id_type}, fp bigint")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(0xFF)


def _postings(positions: list[tuple[int, ...]]) -> Column:
    """Index entries of a fingerprint: which positions, and the bytes there."""
    entries = []
    for n, chosen in enumerate(positions):
        mask = sum(0xFF << (8 * p) for p in chosen)
        mask -= 1 << 64 if mask >> 63 else 0
        entries.append(F.struct(F.lit(n).alias("entry"), F.col("fp").bitwiseAND(mask).alias("bytes")))
    return F.explode(F.array(*entries))


def _screens() -> list[tuple[int, ...]]:
    """Sets of 4 positions such that any 6 of the 8 positions hold one of them whole."""
    pairs = [(0, 1), (2, 3), (4, 5), (6, 7)]
    return [a + b for a, b in combinations(pairs, 2)]


def matches(a: Column, b: Column) -> Column:
    """In how many positions two fingerprints have the same byte."""
    shared = [F.when(_byte(a, p) == _byte(b, p), 1).otherwise(0) for p in range(POSITIONS)]
    total = shared[0]
    for one in shared[1:]:
        total = total + one
    return total


def _links(classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of documents for fingerprints that differ in at most two bits.

    A pair at two bits shares the bytes of at least six of the eight positions. An
    index entry of one byte would list a 256th of all fingerprints, and its pairs
    grow with the square of the corpus, so entries are conjunctions of positional
    bytes. Six entries of four bytes screen: any six positions hold one of these
    sets, so a fingerprint that is alone in all six has no partner. The rest go to the
    28 entries of six bytes, where exactly the pairs with the guaranteed six
    matches meet. Such an entry leaves 16 bits open, hence has at most 65,536
    fingerprints whatever the input, each with at most 136 partners. Its pairs
    are tallied by positional bytes, and those that reach six are verified by bits.
    """
    screen = classes.select("fp", _postings(_screens()).alias("post")).select("fp", "post.*")
    shared = screen.groupBy("entry", "bytes").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    shared = pin(shared.filter("lo <> hi").select("entry", "bytes"))
    active = screen.join(shared, ["entry", "bytes"], "left_semi").select("fp").distinct()
    active = classes.join(active, "fp")

    entries = list(combinations(range(POSITIONS), MIN_MATCHES))
    posts = active.select("fp", "rep", _postings(entries).alias("post")).select("fp", "rep", "post.*")
    groups = posts.groupBy("entry", "bytes").agg(F.collect_list(F.struct("fp", "rep")).alias("same"))
    ones = groups.filter(F.size("same") > 1).select("same", F.explode("same").alias("one"))
    near = F.filter(
        "same",
        lambda x: (x["fp"] > F.col("one.fp"))
        & (matches(x["fp"], F.col("one.fp")) >= MIN_MATCHES)
        & (F.bit_count(x["fp"].bitwiseXOR(F.col("one.fp"))) <= MAX_BITS),
    )
    return ones.select(F.col("one.rep").alias("a"), F.explode(near).alias("x")).select(
        "a", F.col("x.rep").alias("b")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row.

    ``component_id`` is the smallest doc_id reachable by links of at most two
    bits, the row's own included. Null, empty and blank texts have fingerprint zero
    and link like any other. Repeated rows give repeated results; a row without
    doc_id lends its fingerprint but no id, and gets the id of the others, null
    if there are none. An empty table gives an empty result.

    Documents of one fingerprint are one class with its smallest doc_id, found by
    partial aggregates, before anything is paired; classes are joined back by
    a join Spark can split.
    """
    rows = pin(with_fingerprints(docs))
    classes = pin(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = connected_components(_links(classes))
    named = pin(
        classes.join(parts, F.col("rep") == F.col("id"), "left").select(
            "fp", F.coalesce("component", "rep").alias("component_id")
        )
    )
    return rows.join(named, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
