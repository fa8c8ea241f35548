"""Personal data by patterns and a skip-chain conditional random field."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import text_of

# The kinds, in the order that breaks ties.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits fails where the run's first digit does.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAYBE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s0-9@]*[0-9@]\S*")
_DIGITS = re.compile(r"[0-9]+")

# The bounded sample the field is trained on, and tokens taken from a document of it.
TRAIN_DOCS = 2000
TRAIN_TOKENS = 200
HASHED = 4096
# Messages have converged when none moves further than this. Tables are bounded, so they
# do; a field on which they did not would end after so many rounds.
SETTLED, MOST_ROUNDS = 1e-3, 1000
# A similar pair's weight when nothing is known about it, and its bounds.
SKIP_PRIOR, SKIP_LIMITS = 4.0, (2.0, 6.0)
NEAR = 40


def _luhn(digits: str) -> bool:
    total = 0
    for n, digit in enumerate(map(int, reversed(digits))):
        total += digit if n % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(bare := part.lstrip("0")) <= 3 and int(bare or "0") <= 255 for part in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the patterns' matches, sorted."""
    found = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (match := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    if _DIGITS.search(text):
        for match in _IP.finditer(text):
            if _octets(match[0].split(".")):
                found.append((match.start(), 1, match.end()))
        for match in _CARD.finditer(text):
            if match.end() - match.start() >= 12:
                digits = match[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((match.start(), 2, match.end()))
        if "+" in text:
            for match in _PHONE.finditer(text):
                if 9 <= sum(map(len, _DIGITS.findall(match[0]))) <= 15:
                    found.append((match.start(), 3, match.end()))
    return sorted(found)


@dataclass(frozen=True)
class Token:
    """A node of the field: a base span, whose label is known, or a token of its own."""

    start: int
    end: int
    label: int
    known: bool


def tokens_of(text: str, base: list[tuple[int, int, int]]) -> list[Token]:
    """Base spans, and between them the tokens with a digit or an at sign."""
    nodes = [Token(start, end, kind + 1, True) for start, kind, end in base]
    taken = iter(sorted((start, end) for start, _, end in base))
    span = next(taken, None)
    for match in _TOKEN.finditer(text):
        start, end = match.span()
        # Punctuation at the ends is not part of a token.
        while start < end and text[start] in "([{<\"'":
            start += 1
        while start < end and text[end - 1] in ".,;:!?)]}>\"'":
            end -= 1
        while span and span[1] <= start:
            span = next(taken, None)
        if start < end and not (span and span[0] < end) and _MAYBE.search(text, start, end):
            nodes.append(Token(start, end, 0, False))
    return sorted(nodes, key=lambda node: (node.start, node.label))


def unary_features(token: str) -> list[int]:
    """Hashed features of a token's form."""
    digits = "".join(_DIGITS.findall(token))
    parts = token.split(".")
    at = token.rpartition("@")
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda run: f"9{min(len(run[0]), 5)}", token))
    seen = [
        "bias",
        f"shape {shape}",
        f"digits {min(len(digits), 20)}",
        f"dots {min(len(parts), 6)} at {min(token.count('@'), 2)}",
        f"email {bool(at[0]) and bool(_DOMAIN.fullmatch(at[2]))}",
        f"octets {len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and _octets(parts)}",
        f"luhn {12 <= len(digits) <= 19 and len(digits) == len(re.sub('[ -]', '', token)) and _luhn(digits)}",
        f"plus {token[0] == '+'} {9 <= len(digits) <= 15}",
    ]
    return [zlib.crc32(one.encode()) % HASHED for one in seen]


def similar_key(token: str) -> str:
    """What distant tokens are compared by; empty for tokens like no other.

    Numbers are alike by their last nine digits however they are written, names with
    digits by what stands before an at sign.
    """
    if "@" in token:
        return f"name {token.partition('@')[0].lower()}"
    if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", token):
        return f"address {token}"
    digits = "".join(_DIGITS.findall(token))
    if len(digits) >= 7:
        return f"number {digits[-9:]}"
    return f"name {token.lower()}" if len(token) >= 5 and len(digits) < len(token) else ""


def skip_edges(keys: list[str]) -> list[tuple[int, int]]:
    """Each token with the next one like it."""
    last: dict[str, int] = {}
    edges = []
    for n, key in enumerate(keys):
        if key:
            if key in last:
                edges.append((last[key], n))
            last[key] = n
    return edges


def shared_nodes(keys: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """Edges that tie all like tokens to one node of their own, numbered after the tokens.

    What is known of one of them reaches every other in two steps, however many and
    however far apart they are.
    """
    times = Counter(key for key in keys if key)
    nodes = {key: len(keys) + n for n, key in enumerate(key for key in times if times[key] > 1)}
    return len(nodes), [(n, nodes[key]) for n, key in enumerate(keys) if key in nodes]


@dataclass(frozen=True)
class Field:
    """Weights of the field; their size is fixed."""

    unary: np.ndarray
    chain: np.ndarray
    skip: float

    def posteriors(self, text: str, nodes: list[Token]) -> np.ndarray:
        """Label probabilities of the nodes by loopy sum-product messages."""
        surfaces = [text[node.start : node.end] for node in nodes]
        local = np.array([self.unary[unary_features(s)].sum(axis=0) for s in surfaces])
        for n, node in enumerate(nodes):
            if node.known:
                local[n] = np.where(np.arange(len(LABELS)) == node.label, 0.0, -30.0)
        local -= local.max(axis=1, keepdims=True)
        chain = [(n, n + 1) for n in range(len(nodes) - 1)]
        if not chain:
            return _normalised(local)
        hubs, skips = shared_nodes([similar_key(s) for s in surfaces])
        local = np.concatenate([local, np.zeros((hubs, len(LABELS)))])
        ends = np.array(chain + skips)
        gaps = [int(nodes[b].start - nodes[a].end > NEAR) for a, b in chain]
        alike = self.skip * np.eye(len(LABELS))
        tables = np.concatenate([self.chain[gaps], np.repeat(alike[None], len(skips), axis=0)])
        # Both directions of every edge; the reverse of one is len(ends) further on.
        source = np.concatenate([ends[:, 0], ends[:, 1]])
        target = np.concatenate([ends[:, 1], ends[:, 0]])
        both = np.concatenate([tables, tables.transpose(0, 2, 1)])
        messages = np.zeros((len(source), len(LABELS)))
        back = np.roll(np.arange(len(source)), len(ends))
        for _ in range(MOST_ROUNDS):
            belief = _received(local, target, messages)
            sent = (belief[source] - messages[back])[:, :, None] + both
            top = sent.max(axis=1, keepdims=True)
            new = np.log(np.exp(sent - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - messages).max()
            messages = (new + messages) / 2
            if moved < SETTLED:
                break
        return _normalised(_received(local, target, messages)[: len(nodes)])

    def spans(self, text: str) -> list[tuple[int, int, int, bool]]:
        """``(start, kind, end, base)`` of all spans, base ones and those the field adds."""
        base = base_spans(text)
        found = [(start, kind, end, True) for start, kind, end in base]
        if not _MAYBE.search(text):
            return found
        nodes = tokens_of(text, base)
        if any(not node.known for node in nodes):
            for node, p in zip(nodes, self.posteriors(text, nodes), strict=True):
                label = int(p.argmax())
                if not node.known and label and p[label] >= 0.5:
                    found.append((node.start, label - 1, node.end, False))
        return sorted(found)


def _received(local: np.ndarray, target: np.ndarray, messages: np.ndarray) -> np.ndarray:
    sums = [np.bincount(target, messages[:, n], len(local)) for n in range(local.shape[1])]
    return local + np.stack(sums, axis=1)


def _normalised(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _fit_unary(examples: Counter) -> np.ndarray:
    """Multinomial logistic regression over distinct examples and how often each occurs."""
    weights = np.zeros((HASHED, len(LABELS)))
    if not examples:
        weights[unary_features("0")[0], 0] = 4.0
        return weights
    rows = sorted(examples)
    index = np.array([features for features, _ in rows])
    labels = np.eye(len(LABELS))[[label for _, label in rows]]
    counts = np.array([examples[row] for row in rows], float)[:, None]
    counts /= counts.sum()
    moments = np.zeros_like(weights)
    for _ in range(300):
        p = _normalised(weights[index].sum(axis=1))
        gradient = np.zeros_like(weights)
        np.add.at(gradient, index.ravel(), np.repeat(counts * (p - labels), index.shape[1], axis=0))
        gradient += 1e-5 * weights
        moments += gradient**2
        weights -= 0.5 * gradient / (np.sqrt(moments) + 1e-8)
    return weights


def _examples_of(text: str) -> Iterator[tuple[str, list[int], int, int]]:
    """``(kind, features, label, next label)`` of the tokens of a text that training counts.

    Of a text with more than ``TRAIN_TOKENS`` tokens, so many are drawn from all over it,
    by chance that depends on the text alone.
    """
    nodes = tokens_of(text, base_spans(text))
    surfaces = [text[node.start : node.end] for node in nodes]
    draw = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    drawn = range(len(nodes))
    if len(nodes) > TRAIN_TOKENS:
        drawn = sorted(draw.choice(len(nodes), TRAIN_TOKENS, replace=False).tolist())
    following = dict(skip_edges([similar_key(s) for s in surfaces]))
    for n in drawn:
        yield "token", unary_features(surfaces[n]), nodes[n].label, -1
        if n + 1 < len(nodes):
            far = nodes[n + 1].start - nodes[n].end > NEAR
            yield "far" if far else "near", [], nodes[n].label, nodes[n + 1].label
        if n in following:
            yield "alike", [], nodes[n].label, nodes[following[n]].label


def training_sample(docs: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """``text`` of about ``most`` different documents, chosen by a hash of doc_id and text.

    Rows without doc_id are documents like others, told apart by their texts, and of
    repeated rows there is one, so nulls and copies do not enlarge the sample.
    """
    some = docs.select(F.xxhash64("doc_id", text_of()).alias("h"), text_of().alias("text"))
    some = some.filter(F.col("text").rlike("[0-9@]"))
    rows = some.agg(F.approx_count_distinct("h", 0.02).alias("n")).first().n
    share = min(1.0, most / max(1, rows))
    return some.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["h"]).select("text")


def fit(docs: DataFrame, most: int = TRAIN_DOCS) -> Field:
    """Train the field on a bounded sample of documents; base spans are the labels.

    About ``most`` documents are chosen, and of each at most ``TRAIN_TOKENS`` tokens
    count. Spark counts equal examples, so the driver gets the distinct ones of a
    bounded number. Chain potentials are log ratios of label pairs to their chance, near
    and far. The weight of similar tokens is the log odds that two of them agree when
    one is an entity.
    """
    schema = pa.schema([("kind", pa.string()), ("features", pa.list_(pa.int32())), ("a", pa.int32()), ("b", pa.int32())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                rows = list(_examples_of(text.as_py()))
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    counted = training_sample(docs, most).mapInArrow(listed, "kind string, features array<int>, a int, b int")
    counted = counted.groupBy("kind", "features", "a", "b").count()
    examples: Counter = Counter()
    pairs = np.ones((2, len(LABELS), len(LABELS)))
    agree = disagree = 0
    for kind, features, a, b, times in counted.collect():
        if kind == "token":
            examples[tuple(features), a] += times
        elif kind == "alike":
            agree += times * (a == b and a > 0)
            disagree += times * (a != b)
        else:
            pairs[int(kind == "far"), a, b] += times
    joint = pairs / pairs.sum(axis=(1, 2), keepdims=True)
    chance = joint.sum(axis=2, keepdims=True) * joint.sum(axis=1, keepdims=True)
    odds = SKIP_PRIOR if not agree + disagree else np.log((agree + 1) / (disagree + 1))
    return Field(_fit_unary(examples), np.clip(np.log(joint / chance), -1, 1), float(np.clip(odds, *SKIP_LIMITS)))


SPAN_TYPE = "array<struct<start:int,kind:int,end:int,base:boolean>>"


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with ``spans``, sorted by start, kind and end.

    A span has start and end in code points, the kind as a place in ``KINDS``, and
    whether the patterns found it. Null text is empty text and has none. Each
    document is one field of its own, with two edges per token at most, and messages go
    on until they settle, in a long text as in a short one; nothing is shuffled. Repeated rows and nulls in other columns
    do not matter; a column ``spans`` is replaced; an empty table gives an empty result.
    """
    rows = docs.drop("spans", "_text").withColumn("_text", text_of())
    shared = docs.sparkSession.sparkContext.broadcast(field)
    schema = rows.drop("_text").schema.add("spans", _span_type())

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        names = ("start", "kind", "end", "base")
        for batch in batches:
            spans = [
                [dict(zip(names, span, strict=True)) for span in own.spans(text.as_py())]
                for text in batch.column(batch.num_columns - 1)
            ]
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(spans, kind)], names=[*batch.schema.names[:-1], "spans"]
            )

    return rows.mapInArrow(marked, schema)


def _span_type():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(SPAN_TYPE)


def spans_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*(F.lit(kind) for kind in KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` of :func:`find_personal_data` with spans in ``text`` replaced by ``[KIND]``.

    Overlapping spans become one, named after the first. Texts without spans, null
    ones included, stay as they are. ``spans`` is dropped.
    """
    marks = F.array(*(F.lit(f"[{kind.upper()}]") for kind in KINDS))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        between = F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        grown = F.concat(state["out"], between, F.get(marks, span["kind"]))
        return F.struct(
            F.when(fresh, grown).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    folded = F.aggregate(
        "spans", start, step,
        lambda state: F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, F.length("text"))),
    )
    return docs.withColumn("text", F.when(F.size("spans") > 0, folded).otherwise(F.col("text"))).drop("spans")
