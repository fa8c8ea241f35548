"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import text_of
from faultlens.runtime import pin

# The bounded sample of labelled rows that everything is learned from.
MAX_LABELLED = 8000
# Features of the classifier, each of them a voter of the label model.
FEATURES = 2000
MIN_SUPPORT = 3
# Pattern voters fire on words that start with so many letters.
PREFIXES = (4, 5)
ROUNDS = 100
# What is thought of the annotation before anything is seen, and the rows this thought weighs.
LABEL_ACCURACY, LABEL_WEIGHT = 0.95, 2.0
# Lower end of a feature's log odds ratio, in standard errors.
STANDARD_ERRORS = 2.5
# Least hashes of a text's word triples, and the share of equal ones (an estimate of the
# Jaccard similarity) from which a text is a near copy of an example.
SKETCH = 64
ALIKE = 0.8
FOLDS = 5
HELD_OUT = 0

_WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> set[str]:
    """The words of a text in lower case, and the starts of its longer words as ``abcd*``."""
    words = set(_WORD.findall(text.lower()))
    found = set(words)
    for size in PREFIXES:
        found.update({f"{word[:size]}*" for word in words if len(word) > size})
    return found


_MIXERS = np.random.default_rng(1).integers(1 << 63, size=SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch_of(text: str) -> np.ndarray:
    """Least hashes of the word triples of a text, ``SKETCH`` of them."""
    words = text.lower().split()
    triples = {" ".join(words[n : n + 3]) for n in range(max(1, len(words) - 2))}
    hashes = np.array([xxhash.xxh64_intdigest(triple) for triple in triples], np.uint64)
    return np.array([((hashes ^ mixer) * mixer >> np.uint64(32)).min() for mixer in _MIXERS], np.uint32)


def _examples(sketches: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Places of the rows that are no near copy of an earlier example with the same label."""
    chosen = []
    for label in np.unique(toxic):
        places = np.flatnonzero(toxic == label)
        kept, n = np.empty((len(places), SKETCH), np.uint32), 0
        for place in places:
            if not ((kept[:n] == sketches[place]).sum(axis=1) >= ALIKE * SKETCH).any():
                kept[n] = sketches[place]
                n += 1
                chosen.append(place)
    return np.array(chosen, int)


@dataclass(frozen=True)
class Toxicity:
    """A linear classifier over features; its size is bounded by ``FEATURES``."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        hits = self.weights.keys() & features_of(text)
        # Sorted, so that sums do not depend on the order of a set.
        total = self.bias + sum(self.weights[hit] for hit in sorted(hits))
        return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))


def fold_of(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``(text, toxic)`` of some ``most`` labelled rows outside the held-out fold.

    Rows are chosen by a hash of doc_id. Of texts with equal labels whose sketches agree in
    a share of ``ALIKE``, as those of near copies do, one is an example; texts that share
    a passage, or differ in label, all are. Rows without doc_id or label are no
    examples, and an id with labels of both kinds is none. Of rows that repeat a doc_id
    one is looked at, that with the least hash of its text, so ids bound the sample.
    """
    known = labels.filter("doc_id is not null and toxic is not null")
    known = known.filter(fold_of() != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_hi"))
    known = known.filter("toxic = _hi").drop("_hi")
    share = min(1.0, most / max(1, known.count()))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    # At most about ``most`` rows of two numbers: the sample's bound is the broadcast's.
    known = known.filter(picked).select("doc_id", "toxic")
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [sketch_of(text.as_py()).tobytes() for text in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["key", "toxic", "sketch"])

    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    found = found.groupBy("doc_id").agg(one, F.min("toxic").cast("int").alias("toxic"))
    rows = found.select("text", "toxic").distinct()
    rows = pin(rows.select(F.xxhash64("text").alias("key"), "toxic", "text"))
    # Sketches are as many as the sample's rows, and the examples the same in any order of arrival.
    met = sorted(rows.mapInArrow(sketched, "key bigint, toxic int, sketch binary").collect())
    if not met:
        return rows.select("text", "toxic")
    sketches = np.stack([np.frombuffer(row.sketch, np.uint32) for row in met])
    chosen = _examples(sketches, np.array([row.toxic for row in met]))
    kept = [(met[n].key, met[n].toxic) for n in chosen]
    kept = docs.sparkSession.createDataFrame(kept, "key bigint, toxic int")
    return rows.join(F.broadcast(kept), ["key", "toxic"]).select("text", "toxic")


def _feature_counts(sample: DataFrame) -> DataFrame:
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                found = sorted(features_of(text.as_py()))
                marks = pa.array([toxic.as_py()] * len(found), pa.int32())
                yield pa.record_batch([pa.array(found, pa.string()), marks], names=["feature", "toxic"])

    rows = sample.select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = rows.mapInArrow(listed, "feature string, toxic int")
    return rows.groupBy("feature").agg(
        F.sum("toxic").alias("pos"), (F.count("*") - F.sum("toxic")).alias("neg")
    )


def _choose(sample: DataFrame, features: int) -> list[str]:
    """Features of toxic texts, by the lower end of their log odds ratio."""
    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    if not totals.n or not totals.pos or totals.pos == totals.n:
        return []
    pos, neg = float(totals.pos), float(totals.n - totals.pos)
    a, b = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(a / (pos - F.col("pos") + 0.5)) - F.log(b / (neg - F.col("neg") + 0.5))
    spread = F.sqrt(1 / a + 1 / (pos - F.col("pos") + 0.5) + 1 / b + 1 / (neg - F.col("neg") + 0.5))
    ranked = _feature_counts(sample).filter(F.col("pos") >= MIN_SUPPORT)
    ranked = ranked.withColumn("worth", odds - STANDARD_ERRORS * spread).filter("worth > 0")
    top = ranked.orderBy(F.desc("worth"), "feature").limit(features)
    return [row.feature for row in top.select("feature").collect()]


def _votes(sample: DataFrame, chosen: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sample as a matrix of fired features, and its labels; both are bounded."""
    index = {feature: n for n, feature in enumerate(chosen)}

    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted(index[f] for f in index.keys() & features_of(t.as_py())) for t in batch.column(0)]
            yield pa.record_batch([pa.array(hits, pa.list_(pa.int32())), batch.column(1)], names=["hits", "toxic"])

    rows = sample.select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = rows.mapInArrow(fired, "hits array<int>, toxic int")
    # Sorted, so that sums of the fit do not depend on the order of arrival.
    found = sorted((tuple(row.hits), row.toxic) for row in rows.collect())
    votes = np.zeros((len(found), len(chosen)), np.float32)
    for n, (hits, _) in enumerate(found):
        votes[n, list(hits)] = 1
    return votes, np.array([toxic for _, toxic in found], float)


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior toxicity of the rows of a vote matrix.

    A class prior and each voter's rates of firing on toxic and on other texts, by
    expectation maximisation. A voter that fires votes toxic, one that is silent
    votes clean, each as far as its rates tell the classes apart. The annotation is
    one more voter whose rates are estimated like all others; what is thought of it
    beforehand (``LABEL_ACCURACY``) counts as ``LABEL_WEIGHT`` rows, and the first
    round starts from it, which says what the hidden class means. Voters are not
    independent: the correlation of two voters' residuals given the class is estimated
    in each round, and a voter's evidence is divided by the number of voters it
    stands for, the sum of its correlations beyond twice their error.
    """
    total = len(labels)
    marked = (labels > 0).astype(float)
    posterior = np.where(marked > 0, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
    together = votes.T @ votes
    for _ in range(rounds):
        other = 1 - posterior
        toxic, clean = posterior.sum(), other.sum()
        fired, fired_other = posterior @ votes, other @ votes
        on_toxic, on_other = (fired + 0.1) / (toxic + 1), (fired_other + 0.1) / (clean + 1)
        # Products of residuals from the products of votes, without a matrix of residuals.
        crossed = np.outer(fired, on_toxic) + np.outer(fired_other, on_other)
        means = np.outer(on_toxic, on_toxic) * (posterior @ posterior) + np.outer(on_other, on_other) * (other @ other)
        mixed = np.outer(on_toxic, on_other) * (posterior @ other)
        products = (together - crossed - crossed.T + means + mixed + mixed.T) / total
        scale = np.sqrt(np.maximum(np.diag(products), 0)) + 1e-9
        related = np.abs(products / np.outer(scale, scale))
        stands_for = np.maximum(1, np.where(related > 2 / np.sqrt(total), related, 0).sum(axis=1))
        heard = np.log(on_toxic / on_other) / stands_for
        silent = np.log((1 - on_toxic) / (1 - on_other)) / stands_for
        odds = np.log((toxic + 0.5) / (clean + 0.5)) + silent.sum() + votes @ (heard - silent)
        hit = (posterior @ marked + LABEL_WEIGHT * LABEL_ACCURACY) / (toxic + LABEL_WEIGHT)
        slip = (other @ marked + LABEL_WEIGHT * (1 - LABEL_ACCURACY)) / (clean + LABEL_WEIGHT)
        odds += np.where(marked > 0, np.log(hit / slip), np.log((1 - hit) / (1 - slip)))
        after = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        moved = np.abs(after - posterior).max()
        posterior = after
        if moved < 1e-4:
            break
    return posterior


def linear_classifier(x: np.ndarray, target: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels with a squared penalty, by accelerated gradients."""
    n, width = x.shape
    weights, bias = np.zeros(width), float(np.log((target.sum() + 0.5) / (n - target.sum() + 0.5)))
    # The largest curvature: of the weights with the penalty, and the bias beside them.
    v = np.ones(width)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * (np.linalg.norm(x @ v) ** 2 + n) + penalty)
    ahead, ahead_bias, t = weights, bias, 1.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead + ahead_bias, -50, 50)))
        new = ahead - step * (x.T @ (p - target) + penalty * ahead)
        new_bias = ahead_bias - step * (p - target).sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = (t - 1) / t_next
        ahead, ahead_bias = new + momentum * (new - weights), new_bias + momentum * (new_bias - bias)
        weights, bias, t = new, new_bias, t_next
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Toxicity:
    """Learn a classifier from a bounded sample of labelled rows of the training folds.

    Without labelled rows of both kinds every text scores alike, at the share of
    toxic rows, or 0 if there are none.
    """
    sample = pin(labelled_sample(docs, labels, most))
    chosen = _choose(sample, FEATURES)
    if not chosen:
        row = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
        share = ((row.pos or 0) + 0.01) / (row.n + 1.0)
        return Toxicity({}, float(np.log(share / (1.01 - share))))
    votes, marks = _votes(sample, chosen)
    votes = votes.astype(float)
    weights, bias = linear_classifier(votes, label_model(votes, marks))
    return Toxicity({f: float(w) for f, w in zip(chosen, weights, strict=True)}, bias)


def score_documents(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from a score of 0.5 on).

    Only the text is looked at; null text is empty text, and rows that are repeated score
    alike. Columns of these names are replaced; an empty table gives an empty result.
    The model is broadcast: at most ``FEATURES`` features.
    """
    rows = docs.drop("score", "predicted", "_text").withColumn("_text", text_of())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = rows.drop("_text").schema.add("score", "double").add("predicted", "integer")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value
        for batch in batches:
            scores = np.array([one.score(text.as_py()) for text in batch.column(batch.num_columns - 1)], float)
            kept = batch.columns[:-1] + [pa.array(scores), pa.array((scores >= 0.5).astype("i4"))]
            yield pa.record_batch(kept, names=[*batch.schema.names[:-1], "score", "predicted"])

    return rows.mapInArrow(scored, schema)
