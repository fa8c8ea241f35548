"""Alignment of two tokenizers against the libraries on whole texts."""

import random
from collections import Counter, defaultdict
from functools import lru_cache
from hashlib import sha256

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from faultlens.llm.queries import op12_alignment
from faultlens.llm.token_alignment import align_documents, score_alignments, sha256_of_groups
from faultlens.llm import token_alignment

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@lru_cache
def _libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain}
    letters |= {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}
    spelled = {n: bytes(letters[c] for c in token) for token, n in a.get_vocab(with_added_tokens=False).items()}
    return a, spelled, SentencePieceProcessor(model_file=FILES[1])


def _piece(model, n):
    piece = model.id_to_piece(n)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(n) else piece.replace("▁", " ").encode()


def brute(texts):
    """Groups and links of each text, worked out from whole encodings, and the counts over all."""
    a_library, a_spelled, b_library = _libraries()
    groups, links = [], []
    for text in texts:
        whole = f" {text}".encode()
        a = a_library.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_library.encode(text) if text else []
        sides = [[(n, a_spelled[n]) for n in a], [(n, _piece(b_library, n)) for n in b]]
        if not text or any(b"".join(x for _, x in side) != whole for side in sides):
            sides = [[], []]
        spans = []
        for side in sides:
            at, own = 0, []
            for n, token in side:
                own.append((at, at + len(token), n))
                at += len(token)
            spans.append(own)
        written, held = [], [[], []]
        for cut in sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]}):
            held = [[str(n) for low, high, n in own if high <= cut] for own in spans]
            spans_left = [[x for x in own if x[1] > cut] for own in spans]
            written.append("|".join(",".join(side) for side in held))
            spans, before = spans_left, spans
            links_of = [(p[2], q[2]) for p in before[0] if p[1] <= cut for q in before[1] if q[1] <= cut
                        and max(p[0], q[0]) < min(p[1], q[1])]
            links.append((len(groups), links_of))
        groups.append(";".join(written))
    per_text = defaultdict(list)
    for n, found in links:
        per_text[n] += found
    counts = Counter(pair for n in range(len(texts)) for pair in set(per_text[n]))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    rows = []
    for n, one in enumerate(groups):
        own = per_text[n]
        sides = [side for group in one.split(";") for side in group.split("|")] if one else []
        n_a, n_b = (sum(len(side.split(",")) for side in sides[k::2]) for k in range(2))
        best = sum(counts[pair] == most[pair[0]] for pair in own)
        digest = sha256(one.encode()).hexdigest() if one else ""
        rows.append((n_a, n_b, len(sides) // 2, len(own), best, sum(counts[pair] for pair in own), digest))
    return rows


def _random_texts(many, seed):
    rng = random.Random(seed)
    letters = [*"ab e  \n\t .,'sT12é中😀㌳ 　▁", "  ", "<|endoftext|>", "<s>", "<0x41>", " the", "ﬁ", "\r\n"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 24))) for _ in range(many)]


def _scored(spark, rows, schema="doc_id bigint, text string"):
    docs = spark.createDataFrame(rows, schema)
    found = score_alignments(docs, *FILES, written=sha256_of_groups).collect()
    return sorted(tuple(row) for row in found)


def test_texts_of_all_kinds_equal_whole_encodings(spark):
    texts = [*_random_texts(300, 1), "", " ", "  ", "a ", " a", "the cat sat " * 3, "▁", "naïve façade"]
    expected = sorted((n, *row) for n, row in enumerate(brute(texts)))
    assert _scored(spark, list(enumerate(texts))) == expected


def test_slices_and_a_full_cache_change_nothing(spark, monkeypatch):
    texts = _random_texts(200, 2)
    whole = [token_alignment.SpanTokenizers(*FILES), token_alignment.SpanTokenizers(*FILES)]
    monkeypatch.setattr(token_alignment, "CACHE_ENTRIES", 7)
    together = token_alignment.Aligned.of(whole[0], texts)
    for n, text in enumerate(texts):
        alone = token_alignment.Aligned.of(whole[1], [text])
        assert alone.groups(whole[1])[0] == together.groups(whole[0])[n]
    assert len(whole[1].young) <= 7 and len(whole[1].old) <= 7


def test_nulls_repeated_rows_and_other_columns(spark):
    rows = [(1, "the cat", "x", 5), (1, "the cat", "x", 6), (None, "the cat", None, 7), (2, None, "y", None), (3, "", "z", 1)]
    schema = "doc_id bigint, text string, groups string, n_a bigint"
    found = spark.createDataFrame(rows, schema)
    found = score_alignments(found, *FILES).collect()
    got = sorted(((row.doc_id is None, row.doc_id, row.n_a, row.n_links, row.count_sum, row.groups) for row in found), key=repr)
    once = brute(["the cat"] * 3)[0]
    assert [x[2:5] for x in got if x[1] in (1, None)] == [(once[0], once[3], once[5])] * 3
    assert all(x[2:] == (0, 0, 0, "") for x in got if x[1] in (2, 3))
    assert score_alignments(found_empty(spark), *FILES).collect() == []


def found_empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def test_a_very_long_text(spark):
    text = "a word, and 12 é中 " * 40_000 + "end"
    rows = _scored(spark, [(1, text), (2, "a word")])
    both = token_alignment.SpanTokenizers(*FILES)
    a, _, b = _libraries()
    assert rows[0][1] == len(a.encode(f" {text}", add_special_tokens=False).ids)
    assert rows[0][2] == len(b.encode(text))
    assert both.chunked and rows[0][3] <= min(rows[0][1:3])


def test_spans_cover_the_text(spark):
    docs = spark.createDataFrame([(1, "né 中 x"), (2, None)], "doc_id bigint, text string")
    found = {row.doc_id: row for row in align_documents(docs, *FILES).collect()}
    size = len(" né 中 x".encode())
    assert found[1].a_ends[-1] == found[1].b_ends[-1] == size
    assert len(found[1].a_ends) == len(found[1].a_ids) and found[2].b_ends == []
    shared = set(found[1].a_ends) & set(found[1].b_ends)
    assert len(found[1].groups.split(";")) == len(shared)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_the_query_equals_brute_force(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted((row.doc_id, *one) for row, one in zip(docs, brute([row.text or "" for row in docs])))
    assert sorted(tuple(row) for row in op12_alignment(spark, folder).collect()) == expected
