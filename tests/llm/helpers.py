"""Plain-Python versions of what the operators compute, and rows that make them stumble."""

import hashlib
import re

import xxhash
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE = re.compile(r"[\x20\x09-\x0D]")


def documents(spark, texts, ids=None):
    """Documents with the given texts; every odd one has null lang and source."""
    ids = range(len(texts)) if ids is None else ids
    rows = [
        (i, text, "en" if n % 2 == 0 else None, "s0" if n % 2 == 0 else None, len(text or ""))
        for n, (i, text) in enumerate(zip(ids, texts, strict=True))
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def awkward(spark):
    """Nulls, empty and blank texts, a very long one, repeated rows, a null id, clashing names."""
    texts = [None, "", " \t\n", "one", "one", "word " * 40_000, "x" * 50_000, "a b c d", "a b c d", "é ñ 日本 z", "lost id"]
    ids = [0, 1, 2, 3, 3, 5, 6, 7, 8, 9, None]
    docs = documents(spark, texts, ids)
    clash = ("spans", "score", "predicted", "n_lines", "kept_text", "ids", "fp", "h", "shard", "tie", "first", "_text", "_id")
    return docs.withColumns({name: F.lit("clash") for name in clash})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(ids, linked):
    """Smallest id reachable, for every id."""
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(gram, 42) for gram in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
