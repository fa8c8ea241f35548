"""SentencePiece encoding of merge-type vocabularies by an agenda of symbol pairs."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from faultlens.llm.common import text_of

# Fixed value: how the vocabulary writes a blank.
BLANK = "▁"
CACHE_ENTRIES = 400_000
# Texts that are cut into words at once.
SLICE = 800
# Stretches up to this length go through the agenda many at a time.
SHORT = 32
# Runs that hardly any piece of the vocabulary straddles.
_RUN = re.compile(r"[^\W\d_]+|[\W\d_]+")
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class AgendaEncoder:
    """Encodes as the library does: the best adjacent pair is merged, again and again.

    The vocabulary must have no normalization rules and put a blank in front of a
    text. Merges never leave a stretch of blanks and what follows it up to the
    next blank, as no piece has a blank after something else; words are
    therefore encoded one by one, and each distinct word once while it is cached.
    """

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.library
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes_: dict[int, int] = {}
        inner = False
        straddling = []
        for n in range(model.vocab_size()):
            piece = model.id_to_piece(n)
            if model.is_byte(n):
                self.bytes_[int(piece[3:5], 16)] = n
            elif not (model.is_control(n) or model.is_unknown(n)):
                self.scores[piece] = (model.get_score(n), n)
                bare = piece.lstrip(BLANK)
                inner |= BLANK in bare
                if len(_RUN.findall(bare)) > 1:
                    straddling.append(re.escape(bare))
        if inner or len(self.bytes_) != 256:
            raise ValueError("the vocabulary joins words, or lacks byte pieces")
        # Merges stay within runs unless a word holds one of these pieces.
        self.straddling = re.compile("|".join(straddling)) if straddling else None
        self._index_pairs()
        self.runs: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.differing = 0

    def _index_pairs(self) -> None:
        """Pairs of pieces that join to a piece: sorted keys, places by score, and the piece."""
        self.ints = list(range(self.library.vocab_size()))
        self.unknown = len(self.ints)
        best = {score: n for n, score in enumerate(sorted({-s for s, _ in self.scores.values()}))}
        pairs = []
        for piece, (score, n) in self.scores.items():
            for cut in range(1, len(piece)):
                left, right = self.scores.get(piece[:cut]), self.scores.get(piece[cut:])
                if left and right:
                    pairs.append((left[1] * (self.unknown + 1) + right[1], best[-score], n))
        keys, places, joined = np.array(sorted(pairs), np.int64).reshape(-1, 3).T
        # An entry past the end stands for pairs that join to nothing.
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.places = np.append(places, len(best) + 1)
        self.joined = np.append(joined, -1)
        self.letters = {piece: n for piece, (_, n) in self.scores.items() if len(piece) == 1}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * (self.unknown + 1) + right
        found = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[found] == wanted, found, len(self.keys) - 1)

    def _agendas(self, texts: list[str]) -> list[tuple[int, ...]]:
        """Ids of many stretches of text.

        Stretches of one length are the rows of a matrix of symbols, with their agenda, the
        scores of adjacent pairs, beside it. Each step takes every row's best pair, the
        leftmost of equals, and joins it; a row whose agenda is empty is done.
        """
        done: list[tuple[int, ...]] = [()] * len(texts)
        by_length: dict[int, list[int]] = {}
        for n, text in enumerate(texts):
            if len(text) > SHORT:
                done[n] = self._agenda(text)
            else:
                by_length.setdefault(len(text), []).append(n)
        none = len(self.keys) - 1
        for length, rows in by_length.items():
            places = np.array(rows)
            letters = [[self.letters.get(c, self.unknown) for c in texts[n]] for n in rows]
            symbols = np.array(letters, np.int64).reshape(len(rows), length)
            starts = np.tile(np.arange(length), (len(rows), 1))
            agenda = self._pairs(symbols[:, :-1], symbols[:, 1:]) if length else symbols
            while len(places):
                scores = self.places[agenda]
                at = scores.argmin(axis=1) if agenda.shape[1] else np.zeros(len(places), int)
                n = np.arange(len(places))
                ended = agenda[n, at] == none if agenda.shape[1] else np.ones(len(places), bool)
                for place, ids, own in zip(places[ended], symbols[ended].tolist(), starts[ended].tolist(), strict=True):
                    done[place] = self._ids(texts[place], ids, own)
                live = ~ended
                places, symbols, starts, agenda, at = (x[live] for x in (places, symbols, starts, agenda, at))
                if not len(places):
                    break
                n = np.arange(len(places))
                symbols[n, at] = self.joined[agenda[n, at]]
                width = symbols.shape[1] - 1
                kept = np.arange(width + 1) != at[:, None] + 1
                symbols, starts = (x[kept].reshape(len(places), width) for x in (symbols, starts))
                agenda = agenda[np.arange(width) != at[:, None]].reshape(len(places), width - 1)
                # The joined symbol has new pairs with its neighbours.
                for left in (at - 1, at):
                    inside = (left >= 0) & (left < width - 1)
                    m, k = n[inside], left[inside]
                    agenda[m, k] = self._pairs(symbols[m, k], symbols[m, k + 1])
        return done

    def _ids(self, text: str, symbols: list[int], starts: list[int]) -> tuple[int, ...]:
        if self.unknown not in symbols:
            # Shared integers, as the cache holds very many of them.
            return tuple(map(self.ints.__getitem__, symbols))
        found: list[int] = []
        for n, start in zip(symbols, starts, strict=True):
            found += [n] if n != self.unknown else [self.bytes_[byte] for byte in text[start].encode()]
        return tuple(found)

    def _agenda(self, text: str) -> tuple[int, ...]:
        """Ids of one long stretch: a heap of pairs by score, the leftmost first."""
        scores = self.scores
        symbols: list[str] = list(text)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        agenda: list[tuple[float, int, int, str]] = []

        def propose(left: int) -> None:
            right = after[left]
            if right < len(symbols):
                joined = symbols[left] + symbols[right]
                if joined in scores:
                    heapq.heappush(agenda, (-scores[joined][0], left, right, joined))

        for left in range(len(symbols) - 1):
            propose(left)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            # Stale if either symbol has been merged meanwhile.
            if not symbols[left] or after[left] != right or symbols[left] + symbols[right] != joined:
                continue
            symbols[left], symbols[right] = joined, ""
            after[left] = after[right]
            if after[right] < len(symbols):
                before[after[right]] = left
            if before[left] >= 0:
                propose(before[left])
            propose(left)
        ids: list[int] = []
        at = 0
        while at < len(symbols):
            known = scores.get(symbols[at])
            if known:
                ids.append(known[1])
            else:
                ids += [self.bytes_[byte] for byte in symbols[at].encode()]
            at = after[at]
        return tuple(ids)

    def _parts(self, word: str) -> list[str]:
        """A word as stretches that are encoded one by one."""
        if self.straddling and self.straddling.search(word):
            return [word]
        bare = word.lstrip(BLANK)
        parts = _RUN.findall(bare) or [""]
        parts[0] = word[: len(word) - len(bare)] + parts[0]
        return parts

    def _learn(self, words: set[str]) -> None:
        """Encode words not met before, and check each against the library.

        Should the two ever differ, the library's ids are taken and counted in
        ``differing``.
        """
        met = words.difference(self.words)
        kept = {word: self.older[word] for word in met.intersection(self.older)}
        self.words.update(kept)
        new = list(met.difference(kept))
        # The library puts one blank in front itself, but not in front of nothing.
        expected = self.library.encode([word[1:] for word in new], num_threads=1) if new else []
        # Most words are one blank and letters, which is one stretch.
        parts = [[word] if word[1:].isalpha() else self._parts(word) for word in new]
        runs = self.runs
        missing = list({run for one in parts for run in one}.difference(runs))
        found = dict(zip(missing, self._agendas(missing), strict=True))
        for word, one, right in zip(new, parts, expected, strict=True):
            if len(one) == 1:
                own = list(found[word] if word in found else runs[word])
            else:
                runs.update((run, found[run]) for run in one if run not in runs)
                own = list(chain.from_iterable(map(runs.__getitem__, one)))
            right = right or [self.scores[BLANK][1]]
            if own != right:
                self.differing += 1
                own = right
            self.words[word] = array("i", own).tobytes()

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without begin and end, as 32-bit integers of this machine."""
        if len(self.words) > CACHE_ENTRIES:
            # Words met again are taken over from the older generation.
            self.older, self.words = self.words, {}
            self.runs.clear()
        cut = []
        for text in texts:
            if not text:
                cut.append([])
            elif "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
                cut.append(_WORD.findall(BLANK + text.replace(" ", BLANK)))
            else:
                cut.append((BLANK + text.replace(" ", f" {BLANK}")).split(" "))
        self._learn(set(chain.from_iterable(cut)))
        words = self.words
        return [b"".join(map(words.__getitem__, one)) for one in cut]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, without begin and end."""
        return [np.frombuffer(one, np.int32).tolist() for one in self.encode_packed(texts)]


@lru_cache(maxsize=4)
def encoder_at(path: str) -> AgendaEncoder:
    """The encoder of a worker process."""
    return AgendaEncoder(path)


def _encoded(batches: Iterator[pa.RecordBatch], encoder: AgendaEncoder) -> Iterator[pa.RecordBatch]:
    """Batches of ids and decoded text; an error if the agenda has differed from the library."""
    for batch in batches:
        # Slices bound what is in memory as words and ids.
        for low in range(0, batch.num_rows, SLICE):
            part = batch.slice(low, SLICE)
            packed = encoder.encode_packed(part.column(1).to_pylist())
            if encoder.differing:
                raise ValueError(f"the agenda and the library differ on {encoder.differing} words")
            decoded = [encoder.library.decode(np.frombuffer(one, np.int32).tolist()) for one in packed]
            ends = np.cumsum([0] + [len(one) // 4 for one in packed]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends), values)
            columns = [part.column(0), ids, pa.array(decoded, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "ids", "decoded"])


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: the ids of every whole text and the text they decode to.

    Null text is empty text, which has no ids. Rows are independent: repeated rows
    and null doc_ids are encoded like any other; other columns are not read; an empty
    table gives an empty result. Nothing is shuffled; texts are encoded in Arrow
    batches, and every distinct word of a batch that is not cached is encoded by the agenda
    and checked against the library; the query fails if they differ. Decoding is the library's.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, encoder_at(model))

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(encoded, f"doc_id {id_type}, ids array<int>, decoded string")
