"""Packing of tokenized documents into sequences by reciprocal-capacity classes."""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from faultlens.llm.common import text_of

CAPACITY = 2048
END_ID = 1
# A piece of at most this share of the capacity goes to its class as it is;
# longer ones are cut at a class's upper end, so that bins of the class are full.
WHOLE_SHARE = 16
# Words kept, at most twice that many, and the longest of them in characters.
CACHE_ENTRIES, CACHE_POINTS = 60_000, 64
# Fixed value: how byte-level vocabularies of this kind cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_FIELDS = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
# Pieces sent on at once.
FLUSH = 2000
# White space other than a single blank between words.
_ODD_SPACE = re.compile(r" (?=\s)| $")
_SPECIAL = "<|endoftext|>"


class CachedTokenizer:
    """Ids of texts as little-endian 32-bit bytes, each distinct word looked up once.

    A byte-level vocabulary never joins what stands before a blank followed by
    other than white space with what comes after it, so texts are cut there and
    only words not met before are encoded. Texts with other white space after a blank
    or with the special token go to the library whole. A full
    cache becomes the older generation, from which words met again are taken over.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.merge = _fast_encoder(self.library)

    def _encode(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_word(self, word: str) -> bytes:
        ids = self.merge(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        for text in texts:
            if _SPECIAL in text or "\0" in text or _ODD_SPACE.search(text):
                yield self._encode(text)
                continue
            words, older = self.words, self.older
            # "a b" is cut into "a" and " b".
            cut = text.replace(" ", "\0 ").split("\0")
            met = set(cut).difference(words)
            for word in met:
                words[word] = older.get(word) or self._encode_word(word)
            yield b"".join(map(words.__getitem__, cut))
            for word in met:
                if len(word) > CACHE_POINTS:
                    del words[word]
            if len(words) > CACHE_ENTRIES:
                # A text with very many words is not worth keeping.
                self.older, self.words = words if len(words) <= 2 * CACHE_ENTRIES else {}, {}


def _fast_encoder(library: Tokenizer) -> Callable[[str], list[int]]:
    """The same vocabulary in the faster of two libraries, checked against the first.

    Its tokens are spelled in letters that stand for bytes; ids rise with the
    order of merges.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in plain]
    spelled = {chr(byte): byte for byte in plain} | {chr(256 + n): byte for n, byte in enumerate(others)}
    tokens = library.get_vocab(with_added_tokens=False)
    ranks = {bytes(map(spelled.__getitem__, token)): n for token, n in tokens.items()}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = [token.decode("utf-8", "ignore") + " x1, it's" for token in sorted(ranks)[::50]]
    expected = [one.ids for one in library.encode_batch(some, add_special_tokens=False)]
    if [fast.encode_ordinary(text) for text in some] != expected:
        raise ValueError("the vocabulary is not a byte-level one with ids in the order of merges")
    return fast.encode_ordinary


@lru_cache(maxsize=4)
def tokenizer_at(path: str) -> CachedTokenizer:
    """The tokenizer of a worker process."""
    return CachedTokenizer(path)


def cut_lengths(tokens: int, capacity: int = CAPACITY, whole_share: int = WHOLE_SHARE) -> list[int]:
    """Lengths a document of so many tokens is cut into.

    Full sequences first. Of the rest, as long as it is more than a
    ``whole_share``-th of the capacity, the largest length of the form
    capacity / k that fits; what then remains is one piece.
    """
    lengths = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest * whole_share > capacity:
        k = -(-capacity // rest)
        lengths.append(capacity // k)
        rest -= capacity // k
    return lengths + [rest] * (rest > 0)


class HarmonicBins:
    """Open bins of one worker: one per class k, which is full with k pieces.

    Class k holds lengths over capacity / (k + 1) and up to capacity / k.
    """

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity = capacity
        self.next_sequence = first_sequence
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def _closed(self, bin_: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for piece in bin_:
            yield (*piece, self.next_sequence, offset)
            offset += piece[2]
        self.next_sequence += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        """Take a piece ``(doc_id, start, length, ...)``; give the pieces of a bin now full."""
        k = self.capacity // piece[2]
        self.open[k].append(piece)
        if len(self.open[k]) == k:
            yield from self._closed(self.open.pop(k))

    def rest(self) -> Iterator[tuple]:
        """The bins left open, put together, largest first, where several fit in a sequence."""
        groups: list[list[tuple]] = []
        free: list[int] = []
        bins = sorted(self.open.values(), key=lambda bin_: -sum(p[2] for p in bin_))
        self.open = defaultdict(list)
        for bin_ in bins:
            size = sum(piece[2] for piece in bin_)
            at = next((n for n, room in enumerate(free) if room >= size), None)
            if at is None:
                groups.append([])
                free.append(self.capacity)
                at = len(free) - 1
            groups[at] += bin_
            free[at] -= size
        for group in groups:
            yield from self._closed(group)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut documents into pieces and pack these into sequences of ``capacity`` ids.

    One row per piece: doc_id, start, length, ids (unsigned 32-bit, little-endian),
    doc_tokens, sequence_id, offset. A document's ids are those of the tokenizer file with ``END_ID`` after
    them; null or empty text is that one id. Rows are packed as they come, repeated
    rows and null doc_ids as well; other columns are not read; an empty table
    gives an empty result.

    Each task packs the rows it reads, without a shuffle. It holds one open bin per
    class, less than a sequence each, and bins left open at the end, at most
    one per class, are put together, so its padding is a few sequences however
    many rows it has. Sequence ids count up from the task's own range; as tasks
    read fixed splits, a task that is run again gives the same rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer_at(tokenizer)
        end = struct.pack("<I", END_ID)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 40)
        names = ["doc_id", *(field.split()[0] for field in PIECE_FIELDS.split(", "))]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(column) for column in zip(*rows, strict=True)]
            types = [docs_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]
            return pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
            )

        docs_type = pa.int64()
        for batch in batches:
            docs_type = batch.column(0).type
            full: list[tuple] = []
            ids = batch.column(0).to_pylist()
            texts = (text.as_py() for text in batch.column(1))
            for doc_id, encoded in zip(ids, encoder.encode(texts), strict=True):
                encoded += end
                tokens, start = len(encoded) // 4, 0
                for length in cut_lengths(tokens, capacity):
                    own = encoded[4 * start : 4 * (start + length)]
                    full += bins.add((doc_id, start, length, own, tokens))
                    start += length
                if len(full) > FLUSH:
                    yield table(full)
                    full = []
            if full:
                yield table(full)
        if left := list(bins.rest()):
            yield table(left)

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(packed, f"doc_id {id_type}, {PIECE_FIELDS}")
