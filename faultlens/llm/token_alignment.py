"""Alignment of two tokenizers' tokens by their spans, and how often their ids meet."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultlens.llm.common import text_of
from faultlens.runtime import pin

# Fixed value: how a piece vocabulary writes a blank.
BLANK = "▁"
# Bytes of text worked on at once, a longer text being one slice of its own.
SLICE_BYTES = 1 << 20
# Chunks that go to the libraries as one text.
BATCH = 512
# Chunks kept between slices, at most twice that many, and the longest of them.
CACHE_ENTRIES, CACHE_POINTS = 250_000, 48
# An id in the low bits, the bytes of its token in the high ones.
ID_BITS = 32
ID_MASK = (1 << ID_BITS) - 1
_CHUNK = re.compile(r" +[^ ]*")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + n): byte for n, byte in enumerate(others)}


class SpanTokenizers:
    """Both tokenizers, giving every token's id and the bytes it covers."""

    def __init__(self, byte_level: str, pieces: str):
        # Tasks are the parallel ones: threads of the library would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        added = set(vocabulary) - set(self.a.get_vocab(with_added_tokens=False))
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, n in vocabulary.items():
            self.a_bytes[n] = token.encode() if token in added else bytes(map(letters.__getitem__, token))
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        model = self.b
        self.b_bytes = []
        joining = False
        for n in range(model.vocab_size()):
            piece = model.id_to_piece(n)
            if model.is_byte(n):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(n) or model.is_unknown(n):
                self.b_bytes.append(b"")
            else:
                joining |= BLANK in piece.lstrip(BLANK)
                self.b_bytes.append(piece.replace(BLANK, " ").encode())
        # Both cut before blanks that other characters follow, if the vocabularies
        # are of the common kinds; otherwise texts are encoded whole.
        kind = json.loads(self.a.to_str())
        cut = kind["pre_tokenizer"] or {}
        self.chunked = (
            not joining and not kind["normalizer"] and cut.get("type") == "ByteLevel"
            and cut.get("use_regex") is not False and not cut.get("add_prefix_space")
        )
        self.young: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}
        # Ids as text with what follows them: a comma inside a side of a group, else the side's end.
        self.written = [f"{n}{end}" for n in range(len(self.a_bytes)) for end in ",|"]
        self.first_b = len(self.written)
        self.written += [f"{n}{end}" for n in range(len(self.b_bytes)) for end in ",;"]

    def chunks(self, text: str) -> list[str]:
        """A blank and the text, cut before blanks; whole where a cut might not be one of both."""
        spaced = f" {text}"
        return _CHUNK.findall(spaced) if self.chunked and spaced[-1] != " " else [spaced]

    @staticmethod
    def _packed(spelled: list[bytes], counts: list[int], ids: list[int], ends: list[int], known: list[bytes]) -> list[bytes | None]:
        """Of each chunk, ids with the bytes of their tokens; none if the tokens are not its bytes."""
        places = np.cumsum([0, *counts])
        packed, sizes = np.array(ids, np.int64), np.diff(np.array(ends, np.int64), prepend=0)
        first = places[:-1][np.diff(places) > 0]
        sizes[first] = np.array(ends, np.int64)[first]
        blob = (sizes << ID_BITS | packed).tobytes()
        tokens = list(map(known.__getitem__, ids))
        lengths = np.cumsum([0, *map(len, tokens)])
        same = np.diff(lengths[places]) == list(map(len, spelled))
        if not same.all() or b"".join(tokens) != b"".join(spelled):
            pairs = zip(spelled, places[:-1].tolist(), places[1:].tolist(), strict=True)
            same = [b"".join(tokens[low:high]) == whole for whole, low, high in pairs]
        at = (places * 8).tolist()
        return [blob[low:high] if good else None for good, low, high in zip(same, at[:-1], at[1:], strict=True)]

    @staticmethod
    def _refined(ids: list[int], ends: list[int], shared: list[bool], known: list[bytes]) -> list[int]:
        """Coarse cuts where they tell a token's end; inside a character its own bytes do."""
        at = 0
        found = []
        for n, end, inside in zip(ids, ends, shared, strict=True):
            at = at + len(known[n]) if inside else end
            found.append(at)
        return found

    def _a_tokens(self, chunks: list[str], spelled: list[bytes]) -> list[bytes | None]:
        """Tokens by character offsets."""
        counts, ids, ends = [], [], []
        for chunk, whole, one in zip(chunks, spelled, self.a.encode_batch(chunks, add_special_tokens=False), strict=True):
            own, spans = one.ids, one.offsets
            cuts = [end for _, end in spans]
            if len(whole) != len(chunk):
                # The next token starts before this one ends: both are parts of a character.
                shared = [start < end for (start, _), end in zip(spans[1:], cuts, strict=False)] + [False]
                places = list(accumulate((len(c.encode("utf-8", "replace")) for c in chunk), initial=0))
                cuts = self._refined(own, [places[end] for end in cuts], shared, self.a_bytes)
            counts.append(len(own))
            ids += own
            ends += cuts
        return self._packed(spelled, counts, ids, ends, self.a_bytes)

    def _b_tokens(self, chunks: list[str], spelled: list[bytes]) -> list[bytes | None]:
        """Tokens by the spans of the library's proto, in bytes; it puts the first blank itself."""
        counts, ids, ends = [], [], []
        bare = [chunk[1:] for chunk in chunks]
        mapped = self.b.encode(bare, return_type="offset_mapping", return_bytes=True, num_threads=1)
        for chunk, whole, one in zip(chunks, spelled, mapped, strict=True):
            own, spans = one["ids"], one["offsets"]
            cuts = [end + 1 for _, end in spans]
            if len(whole) != len(chunk):
                # An empty span belongs to a character, or to the blank in front, that is not done.
                shared = [begin == end for begin, end in spans]
                cuts = self._refined(own, cuts, shared, self.b_bytes)
            counts.append(len(own))
            ids += own
            ends += cuts
        return self._packed(spelled, counts, ids, ends, self.b_bytes)

    def _together(self, chunks: list[str], spelled: list[bytes]) -> tuple[list[bytes], list[bytes]] | None:
        """Tokens of both for chunks that are encoded as one text; none unless all bytes are met.

        Both sides cut between chunks, wherever these come from.
        """
        text, whole = "".join(chunks), b"".join(spelled)
        bounds = np.cumsum(list(map(len, spelled)))
        one = self.a.encode(text, add_special_tokens=False)
        spans = np.fromiter(chain.from_iterable(one.offsets), np.int64).reshape(-1, 2)
        ends = spans[:, 1]
        shared = np.zeros(len(ends), bool)
        if len(whole) != len(text):
            points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
            places = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
            ends = np.concatenate([[0], places])[ends]
            # The next token starts before this one ends: both are parts of a character.
            shared[:-1] = spans[1:, 0] < spans[:-1, 1]
        a = self._cut(one.ids, ends, shared, self.a_bytes, whole, bounds)
        if a is None:
            return None
        one = self.b.encode(text[1:], return_type="offset_mapping", return_bytes=True)
        spans = np.fromiter(chain.from_iterable(one["offsets"]), np.int64).reshape(-1, 2)
        # An empty span belongs to a character, or to the blank in front, that is not done.
        b = self._cut(one["ids"], spans[:, 1] + 1, spans[:, 0] == spans[:, 1], self.b_bytes, whole, bounds)
        return None if b is None else (a, b)

    @staticmethod
    def _cut(
        ids: list[int], ends: np.ndarray, shared: np.ndarray, known: list[bytes], whole: bytes, bounds: np.ndarray
    ) -> list[bytes] | None:
        """Ids with the bytes of their tokens, cut at the chunks' bounds; none if bytes or bounds are missed."""
        tokens = list(map(known.__getitem__, ids))
        if b"".join(tokens) != whole:
            return None
        if shared.any():
            # Inside a character, a token's own bytes are counted from the last cut that is known.
            lengths = np.cumsum(list(map(len, tokens)))
            settled = np.maximum.accumulate(np.where(shared, -1, np.arange(len(ends))))
            base = np.where(settled >= 0, ends[settled] - lengths[settled], 0)
            ends = np.where(shared, base + lengths, ends)
        last = np.searchsorted(ends, bounds)
        sizes = np.diff(ends, prepend=0)
        if last[-1] >= len(ends) or not (ends[last] == bounds).all() or (sizes <= 0).any():
            return None
        blob = (sizes << ID_BITS | np.array(ids, np.int64)).tobytes()
        at = [0, *((last + 1) * 8).tolist()]
        return [blob[low:high] for low, high in zip(at[:-1], at[1:], strict=True)]

    def learn(self, chunks: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Tokens of both for each chunk, from the cache or the libraries; none if they miss its bytes."""
        known: dict[str, tuple[bytes, bytes] | None] = {}
        new = []
        for chunk in chunks:
            if chunk in self.young:
                known[chunk] = self.young[chunk]
            elif chunk in self.old:
                known[chunk] = self.young[chunk] = self.old[chunk]
            else:
                new.append(chunk)
        # A chunk that ends in a blank would go on in the next one.
        open_ = [chunk for chunk in new if chunk[-1] == " "]
        closed = [chunk for chunk in new if chunk[-1] != " "]
        for some in [[chunk] for chunk in open_] + [closed[n : n + BATCH] for n in range(0, len(closed), BATCH)]:
            spelled = [chunk.encode("utf-8", "replace") for chunk in some]
            sides = self._together(some, spelled)
            if sides is None:
                sides = self._a_tokens(some, spelled), self._b_tokens(some, spelled)
            for chunk, a, b in zip(some, *sides, strict=True):
                known[chunk] = None if a is None or b is None else (a, b)
        for chunk in new:
            if len(chunk) <= CACHE_POINTS:
                if len(self.young) >= CACHE_ENTRIES:
                    self.old, self.young = self.young, {}
                self.young[chunk] = known[chunk]
        return known


@lru_cache(maxsize=1)
def _tokenizers_at(byte_level: str, pieces: str) -> SpanTokenizers:
    return SpanTokenizers(byte_level, pieces)


@dataclass
class Aligned:
    """The tokens of some texts one after the other, with their ends in bytes from the first text on."""

    a: np.ndarray
    a_ends: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray
    n_b: np.ndarray

    @classmethod
    def of(cls, both: SpanTokenizers, texts: list[str]) -> Aligned:
        cut = [both.chunks(text) if text else [] for text in texts]
        known = both.learn({chunk for one in cut for chunk in one})
        sides: tuple[list[bytes], list[bytes]] = ([], [])
        for one in cut:
            found = [known[chunk] for chunk in one]
            pair = zip(*found, strict=True) if found and None not in found else ((), ())
            for side, tokens in zip(sides, pair, strict=True):
                side.append(b"".join(tokens))
        columns = []
        for side in sides:
            packed = np.frombuffer(b"".join(side), np.int64)
            columns += [packed & ID_MASK, np.cumsum(packed >> ID_BITS), np.array([len(x) // 8 for x in side], np.int64)]
        return cls(*columns)

    def _marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each byte offset, whether a token of A, and of B, ends there."""
        size = int(self.a_ends[-1]) + 1 if len(self.a_ends) else 1
        marks = np.zeros((2, size), bool)
        marks[0, self.a_ends] = True
        marks[1, self.b_ends] = True
        return marks[0], marks[1]

    def cuts(self) -> np.ndarray:
        """Where tokens of both end."""
        a, b = self._marks()
        return np.flatnonzero(a & b)

    def group_counts(self) -> np.ndarray:
        ends = np.concatenate([[0], self.a_ends])[np.cumsum(self.n_a)]
        return np.diff(np.searchsorted(self.cuts(), ends, side="right"), prepend=0)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Text number and key (id of A, id of B) of every pair of tokens that overlap.

        Two tokens overlap in one stretch between neighbouring ends of either
        side, and each such stretch lies in one token of each.
        """
        in_a, in_b = self._marks()
        ends = np.flatnonzero(in_a | in_b)
        # Tokens of a side that end before a place.
        a, b = (np.cumsum(marks)[ends] - marks[ends] for marks in (in_a, in_b))
        text = np.repeat(np.arange(len(self.n_a)), self.n_a)
        return text[a], self.a[a] << ID_BITS | self.b[b]

    def groups(self, both: SpanTokenizers) -> list[str]:
        """Ids of each text's groups as text: A's, a bar, B's; groups parted by semicolons."""
        cuts = self.cuts()
        in_a, in_b = self._marks()
        done = np.cumsum(in_a & in_b) - (in_a & in_b)
        of_a, of_b = done[self.a_ends], done[self.b_ends]
        # A group is written as its tokens of A, then those of B.
        before = np.searchsorted(of_b, np.arange(len(cuts) + 1))
        until = np.searchsorted(of_a, np.arange(len(cuts) + 1), side="right")
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        if len(cuts):
            codes[np.arange(len(self.a)) + before[of_a]] = self.a * 2 + (cuts[of_a] == self.a_ends)
            codes[np.arange(len(self.b)) + until[of_b]] = both.first_b + self.b * 2 + (cuts[of_b] == self.b_ends)
        ends = np.cumsum(self.n_a + self.n_b)
        written = both.written.__getitem__
        return [
            "".join(map(written, codes[low:high].tolist()))[:-1]
            for low, high in zip([0, *ends[:-1]], ends, strict=True)
        ] if len(ends) else []


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Rows of a batch of (id, text) in slices of bounded bytes."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64))
    low = 0
    while low < batch.num_rows:
        start = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, start + SLICE_BYTES, side="right")))
        part = batch.slice(low, high - low)
        yield part.column(0), part.column(1).to_pylist()
        low = high


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    return docs.select("doc_id", text_of().alias("text")), docs.schema["doc_id"].dataType.simpleString()


def align_documents(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Tokens of both vocabularies with their spans, and their groups, for every whole text.

    ``(doc_id, a_ids, a_ends, b_ids, b_ends, groups)``; ends are byte offsets in
    a blank and the text. Null, empty and unmatched texts as in
    :func:`score_alignments` have empty lists and groups. Rows are independent.
    """
    rows, id_type = _texts(docs)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers_at(byte_level, pieces)
        for batch in batches:
            for ids, texts in _slices(batch):
                found = Aligned.of(both, texts)
                columns = [ids]
                for tokens, ends, counts in ((found.a, found.a_ends, found.n_a), (found.b, found.b_ends, found.n_b)):
                    places = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    base = np.concatenate([[0], ends])[places[:-1]]
                    own = ends - np.repeat(base, counts)
                    columns += [pa.ListArray.from_arrays(pa.array(places), pa.array(x)) for x in (tokens, own)]
                columns.append(pa.array(found.groups(both), pa.string()))
                yield pa.record_batch(columns, names=["doc_id", "a_ids", "a_ends", "b_ids", "b_ends", "groups"])

    lists = ", ".join(f"{name} array<bigint>" for name in ("a_ids", "a_ends", "b_ids", "b_ends"))
    return rows.mapInArrow(aligned, f"doc_id {id_type}, {lists}, groups string")


SLICE_FIELDS = (
    "slice bigint, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups array<string>, keys array<bigint>, key_docs array<bigint>, "
    "entry_slot binary, entry_links binary, entry_ends binary"
)


def _linked_slices(docs: DataFrame, byte_level: str, pieces: str, written: Callable[[str], str]) -> DataFrame:
    """One row per slice of texts: results of each text, the slice's distinct pairs of ids
    with the texts that hold them, and each text's pairs as places among these."""
    rows, id_type = _texts(docs)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers_at(byte_level, pieces)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, texts in _slices(batch):
                found = Aligned.of(both, texts)
                text, pairs = found.links()
                keys, slots = np.unique(pairs, return_inverse=True)
                # Distinct pairs of each text, with how many links each is.
                entries = np.sort(text * max(1, len(keys)) + slots)
                first = np.flatnonzero(np.diff(entries, prepend=-1))
                counts = np.diff(first, append=len(entries))
                of_text, slot = np.divmod(entries[first], max(1, len(keys)))
                ends = np.searchsorted(of_text, np.arange(len(texts)), side="right")
                values = {
                    "slice": number,
                    "n_a": found.n_a,
                    "n_b": found.n_b,
                    "n_groups": found.group_counts(),
                    "n_links": np.bincount(text, minlength=len(texts)),
                    "groups": [written(one) for one in found.groups(both)],
                    "keys": keys,
                    "key_docs": np.bincount(slot, minlength=len(keys)),
                    "entry_slot": slot.astype("<i4").tobytes(),
                    "entry_links": counts.astype("<i4").tobytes(),
                    "entry_ends": ends.astype("<i8").tobytes(),
                }
                columns = [pa.array([ids.to_pylist()], pa.list_(ids.type))]
                for name, value in values.items():
                    kind = None
                    if isinstance(value, np.ndarray):
                        kind, value = pa.list_(pa.int64()), value.astype(np.int64)
                    elif isinstance(value, list):
                        kind = pa.list_(pa.string())
                    columns.append(pa.array([value], kind))
                yield pa.record_batch(columns, names=["doc_ids", *values])
                number += 1

    return rows.mapInArrow(linked, f"doc_ids array<{id_type}>, {SLICE_FIELDS}")


def pair_counts(slices: DataFrame) -> DataFrame:
    """``(key, n, best)``: texts that hold a pair of ids, and whether no pair of its A id has more.

    Slices have counted their own texts, so a pair met everywhere is a row per slice.
    The best of each A id are at most as many rows as A has ids.
    """
    held = slices.select(F.explode(F.arrays_zip("keys", "key_docs")).alias("x")).select("x.keys", "x.key_docs")
    counts = pin(held.groupBy(F.col("keys").alias("key")).agg(F.sum("key_docs").alias("n")))
    counts = counts.withColumn("a", F.shiftright("key", ID_BITS))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def score_alignments(
    docs: DataFrame, byte_level: str, pieces: str, written: Callable[[str], str] = str
) -> DataFrame:
    """Counts of each document's aligned tokens, and of how common its pairs of ids are.

    ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)``: tokens of
    the byte-level vocabulary A in a blank and the text, tokens of the piece vocabulary B,
    groups between the byte offsets where tokens of both end, pairs of tokens that overlap,
    how many of these are the most common pair of their A id, ties included,
    and the sum of the pairs' counts. A pair's count is the number of rows that
    hold it. ``written`` is applied to the text of the groups before it leaves the task.

    A text that is null or empty, or whose tokens of either side do not spell a
    blank and the text, has no tokens, zeros and empty groups. Special tokens' strings are
    plain text. Repeated rows count as often as they stand there, null doc_ids like
    others; other columns are not read; an empty table gives an empty result. Very
    long texts are slices of their own.

    Coarse cuts are the tokenizers' character offsets and the begin and end of
    sentencepiece's immutable proto, which the installed library gives as its offset
    mapping only; inside a character, where offsets of several tokens are the same, the
    decoded bytes of the tokens cut. Both sides cut before a blank that follows other
    characters, so stretches between blanks are encoded once while they are cached.

    Documents leave the first pass as slices of some megabytes of text with
    the slice's distinct pairs. Those are counted over the corpus, joined with the counts,
    and go back to their slice, which is a group of bounded size.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    slices = pin(_linked_slices(docs, byte_level, pieces, written))
    asked = slices.select(F.col("slice").alias("of"), F.posexplode("keys").alias("slot", "key"))
    answers = asked.join(pair_counts(slices), "key").select("of", "slot", "n", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def scored(slices: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("slot")
        n = answers.column("n").to_numpy()
        best = answers.column("best").to_numpy(zero_copy_only=False)
        tables = []
        for row in range(slices.num_rows):
            value = lambda name, row=row: slices.column(name)[row]
            slot = np.frombuffer(value("entry_slot").as_py(), "<i4")
            links = np.frombuffer(value("entry_links").as_py(), "<i4").astype(np.int64)
            ends = np.frombuffer(value("entry_ends").as_py(), "<i8")
            sums = []
            for weight in (np.where(best[slot], links, 0), n[slot] * links):
                total = np.concatenate([[0], np.cumsum(weight)])
                sums.append(pa.array(np.diff(total[np.concatenate([[0], ends])]).astype(np.int64)))
            own = [value(name).values for name in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
            tables.append(pa.table([*own, *sums, value("groups").values], names=names))
        return pa.concat_tables(tables)

    counts = ", ".join(f"{name} bigint" for name in names[1:-1])
    joined = slices.drop("keys", "key_docs").groupBy("slice").cogroup(answers.groupBy("of"))
    return joined.applyInArrow(scored, f"doc_id {id_type}, {counts}, groups string")


def sha256_of_groups(groups: str) -> str:
    """The digest of a text's groups; nothing for none."""
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""
