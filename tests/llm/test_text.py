import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from helpers import awkward, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultlens.llm import piece_agenda, skip_chain, weak_toxicity
from faultlens.llm import harmonic_packing
from faultlens.llm.harmonic_packing import cut_lengths, pack_documents, tokenizer_at
from faultlens.llm.host_suffixes import blocks_of, extract_main_text, host_of
from faultlens.llm.kd_shards import shard_documents
from faultlens.llm.piece_agenda import encode_and_decode, encoder_at
from faultlens.llm.weak_toxicity import fit, label_model, labelled_sample, linear_classifier, score_documents

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


def test_base_spans():
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@@..--+1122 30( )4é_") for _ in range(rng.randrange(40)))
        assert skip_chain.base_spans(text) == base(text)
    card = "4111 1111 1111 1111"
    text = f"x {card} y a.b@c.d.ef 10.0.0.256 10.0.0.1 +1 (988) 555-2485"
    assert [(k, text[s:e]) for s, k, e in skip_chain.base_spans(text)] == [
        (2, card), (0, "a.b@c.d.ef"), (1, "10.0.0.1"), (3, "+1 (988) 555-2485")
    ]
    # linear in long runs
    assert skip_chain.base_spans("a" * 200_000 + "1" * 200_000 + "+1" * 50_000 + "@" * 1000) == []


PII = [
    "mail bosbt.42@mail8.example.com later bosbt.42 wrote from 42.144.35.254",
    "call +1 (988) 555-2485 or 19885552485 or 5551112 plain words",
    "4111111111111111 then 4111111111111111 4012888888881881 and 1234",
    "nothing here at all", "version 1.2 of 2024", None, "",
] * 30


def test_skip_chain_adds_only_what_resembles(spark):
    docs = documents(spark, PII)
    field = skip_chain.fit(docs)
    rows = skip_chain.find_personal_data(docs, field).collect()
    assert len(rows) == len(PII)
    added = {}
    for row in rows:
        text = row.text or ""
        assert [(s.start, s.kind, s.end) for s in row.spans if s.base] == base(text)
        for s in row.spans:
            if not s.base:
                added.setdefault(row.text, set()).add((skip_chain.KINDS[s.kind], text[s.start : s.end]))
    # the cards side by side are too long for the pattern, but the first is the same as an earlier one
    assert ("card", "4111111111111111") in added[PII[2]]
    assert PII[3] not in added and PII[4] not in added


def test_messages_agree_with_enumeration():
    """On a field without loops the messages give the exact posteriors."""
    rng = np.random.default_rng(8)
    field = skip_chain.Field(rng.normal(size=(skip_chain.HASHED, 5)), rng.normal(size=(2, 5, 5)), 2.0)
    text = "a1 " + "w " * 30 + "22 b3"
    nodes = skip_chain.tokens_of(text, [])
    local = np.array([field.unary[skip_chain.unary_features(text[n.start : n.end])].sum(axis=0) for n in nodes])
    score = (local[0][:, None, None] + local[1][None, :, None] + local[2][None, None, :]
             + field.chain[1][:, :, None] + field.chain[0][None])
    p = np.exp(score - score.max())
    p /= p.sum()
    wanted = np.array([p.sum(axis=(1, 2)), p.sum(axis=(0, 2)), p.sum(axis=(0, 1))])
    assert np.allclose(field.posteriors(text, nodes), wanted, atol=0.02)


def test_personal_data_awkward(spark):
    docs = awkward(spark)
    field = skip_chain.fit(docs)
    found = skip_chain.find_personal_data(docs, field)
    assert found.count() == docs.count()
    assert found.filter(F.size("spans") > 0).count() == 0
    assert skip_chain.find_personal_data(docs.limit(0), field).count() == 0
    hidden = skip_chain.masked(found).select("text").collect()
    assert sorted(str(r.text) for r in hidden) == sorted(str(r.text) for r in docs.collect())


def test_masks(spark):
    texts = ["x a@b.cd y 10.0.0.1", "é +1 988 555 24 85 12", "none"]
    docs = documents(spark, texts)
    hidden = {r.doc_id: r.text for r in skip_chain.masked(skip_chain.find_personal_data(docs, skip_chain.fit(docs))).collect()}
    assert hidden == {0: "x [EMAIL] y [IP]", 1: "é [PHONE]", 2: "none"}


def shards_of(docs, n=24):
    return shard_documents(docs, n).collect()


def test_shards(spark):
    rng = random.Random(9)
    texts = ["é" * rng.randrange(400) for _ in range(1500)] + ["same text"] * 700
    rows = shards_of(documents(spark, texts))
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    sizes = [0] * 24
    slots = [[] for _ in range(24)]
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 8
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert (r.law, r.grown_shard) == ("bytes", None)
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    mean = sum(sizes) / 24
    assert max(sizes) - min(sizes) <= 2 * (808 + 0.02 * mean)


def test_shards_of_equal_rows(spark):
    rows = [(None, "same", "en", "s", 4)] * 600 + [(5, "same text", "en", "s", 9)] * 900 + [(n, "x" * (n % 90), "en", "s", 1) for n in range(600)]
    found = shards_of(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    sizes = [0] * 24
    for row in found:
        sizes[row.shard] += row["size"]
    assert len(found) == len(rows) and max(sizes) - min(sizes) <= 2 * 98


def test_shards_awkward(spark):
    docs = awkward(spark)
    rows = shards_of(docs)
    assert len(rows) == docs.count() and all(0 <= r.shard < 24 for r in rows)
    assert shards_of(docs.limit(0)) == []
    assert len(shards_of(docs.select("doc_id", "text"), 5)) == docs.count()


ODD = ["", " ", "  a", "a  b ", "▁x ▁▁y", "\n\n", "a\tb", "日本 語x 12345 $$", "<s> </s> <0x0A>", "é́ ñ", "a" * 4000,
       "😀 x😀", "  " * 40 + "q", "a<|endoftext|>b c", " \n \n foo", "it's we'll", "x\x00y", "m². 2²."]


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab e th ▁\n\t.,1 2é日 ' _½ ") for _ in range(rng.randrange(40))) for _ in range(n)]


def test_agenda_equals_the_library():
    texts = ODD + random_texts(10, 3000)
    encoder = encoder_at(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert encoder.encode(texts) == library.encode(texts)
    assert encoder.differing == 0


def test_encode_and_decode(spark):
    docs = awkward(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = encode_and_decode(docs, PIECES).collect()
    wanted = [(r.doc_id, library.encode(r.text or "")) for r in docs.collect()]
    assert sorted(((r.doc_id, list(r.ids)) for r in rows), key=str) == sorted(wanted, key=str)
    assert all(r.decoded == library.decode(list(r.ids)) for r in rows)
    assert encode_and_decode(docs.limit(0), PIECES).count() == 0


def test_a_wrong_agenda_is_an_error(monkeypatch):
    encoder = piece_agenda.AgendaEncoder(PIECES)
    batch = pa.record_batch([pa.array([1]), pa.array(["some words"])], names=["doc_id", "text"])
    assert next(piece_agenda._encoded(iter([batch]), encoder)).num_rows == 1
    monkeypatch.setattr(encoder, "_agendas", lambda words: [(0,) for _ in words])
    other = pa.record_batch([pa.array([2]), pa.array(["other text"])], names=["doc_id", "text"])
    with pytest.raises(ValueError, match="differ"):
        list(piece_agenda._encoded(iter([other]), encoder))


def test_cached_tokenizer_equals_the_library():
    texts = ODD + random_texts(11, 3000)
    library = Tokenizer.from_file(BYTES)
    wanted = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(tokenizer_at(BYTES).encode(texts)) == wanted


def test_cached_words_are_bounded(monkeypatch):
    monkeypatch.setattr(harmonic_packing, "CACHE_ENTRIES", 100)
    encoder = harmonic_packing.CachedTokenizer(BYTES)
    texts = random_texts(12, 300) + [" ".join(map(str, range(50_000))), "a b " + "c" * 1000, "a b"]
    wanted = [encoder._encode(text) for text in texts]
    assert list(encoder.encode(texts)) == wanted
    assert len(encoder.words) <= 100 and len(encoder.older) <= 200
    assert max(map(len, [*encoder.words, *encoder.older])) <= harmonic_packing.CACHE_POINTS


def test_cuts():
    for tokens in (*range(1, 6200), 100_000):
        lengths = cut_lengths(tokens)
        assert sum(lengths) == tokens and all(0 < n <= 2048 for n in lengths)


def check_packed(rows, docs):
    library = Tokenizer.from_file(BYTES)
    sequences, pieces = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    for doc_id, text in docs.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[doc_id])
        assert b"".join(p[1] for p in own) == np.array(ids, "<u4").tobytes()
        assert {p[2] for p in own} == {len(ids)}
    return sequences


def test_packing(spark):
    rng = random.Random(12)
    texts = ["word " * rng.randrange(1500) for _ in range(900)] + [None, ""]
    rows = pack_documents(documents(spark, texts).coalesce(1), BYTES).collect()
    sequences = check_packed(rows, dict(enumerate(texts)))
    assert sum(r.length for r in rows) >= 0.97 * 2048 * len(sequences)


def test_packing_awkward(spark):
    docs = awkward(spark)
    rows = pack_documents(docs, BYTES).collect()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in (None, 3)}
    check_packed(rows, texts)
    assert sum(r.start == 0 for r in rows) == docs.count()
    assert pack_documents(docs.limit(0), BYTES).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header>Site</header><nav><ul><li><a href="/x">Menu</a></ul></nav><!-- ad -->
<div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>{body}
<section class="comments"><article>first!</article></section><form>mail <input></form>
<footer>&copy; host</footer></body></html>"""
ARTICLE = "<article><header><h1>Ti&amp;tle</h1></header><p><b>One  two\n three<br><p>fo<i>u</i>r&nbsp;&lt;5<aside>no</aside></article>"


def test_blocks():
    main = [text for zone, text in blocks_of(PAGE.format(body=ARTICLE)) if zone == 0]
    assert main == ["Ti&tle", "One two three", "four <5"]
    assert [z for z, _ in blocks_of("plain <b>text</b><script>never closed")] == [1]
    assert blocks_of("") == [] and blocks_of("<p") == [(1, "<p")]
    assert host_of("https://u:p@Www.A.example:80/x?y") == "www.a.example" and host_of(None) == ""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {name: F.lit("clash") for name in ("text", "host", "blocks", "row", "content")}
    )


def test_boilerplate_of_a_host(spark):
    """Pages without markup: what is unlike other pages of the host stays."""
    chrome = "home about contact terms privacy imprint press jobs"
    foot = "all rights reserved by the owners of this site since then"
    own = {n: " ".join(f"w{n}x{i}" for i in range(40)) for n in range(6)}
    rows = [(n, "http://a.example/p", f"<div>{chrome}</div><div>{own[n]}</div><div>{foot}</div>") for n in range(6)]
    rows += [(10, "http://b.example/p", f"<div>{chrome}</div>"), (11, "http://a.example/q", PAGE.format(body=ARTICLE))]
    rows += [(12, None, None), (13, "http://c.example", ""), (5, "http://a.example/p", rows[5][2])]
    found = sorted((r.page_id, r.text) for r in extract_main_text(pages(spark, rows)).collect())
    wanted = [(n, own[n]) for n in range(6)] + [(5, own[5]), (10, chrome), (11, "Ti&tle\nOne two three\nfour <5"), (12, ""), (13, "")]
    assert found == sorted(wanted)
    assert extract_main_text(pages(spark, rows).limit(0)).count() == 0


def toxic_corpus(seed):
    rng = random.Random(seed)
    plain = [f"word{n}" for n in range(300)]
    texts, labels = [], []
    for n in range(600):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        toxic = n % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scumbag"]) + rng.choice(["", "s", "ish"]))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_toxicity(spark):
    texts, labels = toxic_corpus(13)
    docs = documents(spark, texts)
    marked = spark.createDataFrame([(n, 1, y) for n, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    model = fit(docs, marked)
    rows = score_documents(docs, model).collect()
    held_out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == labels[r.doc_id] for r in held_out) >= 0.98 * len(held_out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    # Labels of the held-out fold change nothing.
    flipped = [(n, 1, 1 - y if zlib.crc32(str(n).encode()) % 5 == 0 else y) for n, y in enumerate(labels)]
    again = fit(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert again == model


def test_examples_that_share_a_passage(spark):
    """Only near copies with the same label are one example."""
    passage = " ".join(f"shared{n}" for n in range(60))
    own = [" ".join(f"w{n}x{i}" for i in range(40)) for n in range(60)]
    texts = [f"{text} {passage}" for text in own] + [f"{' '.join(f'c{i}' for i in range(200))} end{n}" for n in range(6)]
    ids = [n for n in range(400) if zlib.crc32(str(n).encode()) % 5][: len(texts)]
    labels = [n % 5 == 0 for n in range(60)] + [True, False, False, False, True, False]
    marked = spark.createDataFrame([(i, 1, int(y)) for i, y in zip(ids, labels)], "doc_id long, quality int, toxic int")
    found = labelled_sample(documents(spark, texts, ids), marked).collect()
    assert {r.text for r in found} >= set(texts[:60])
    assert sorted(r.toxic for r in found if r.text.startswith("c0 ")) == [0, 1]


def test_known_labels_reach_all_like_tokens():
    """One known token settles the label of all that are like it, near or far."""
    number = "4111111111111111"
    for copies, against in ((2, 0.05), (60, 0.05), (2000, 0.0)):
        weights = np.zeros((skip_chain.HASHED, 5))
        weights[skip_chain.unary_features("x")[0], 0] = against
        field = skip_chain.Field(weights, np.zeros((2, 5, 5)), 4.0)
        text = f"{number} " + "word " * 50 + f"x{number}y " * copies
        base = skip_chain.base_spans(text)[:1]
        nodes = skip_chain.tokens_of(text, base)
        found = field.posteriors(text, nodes)
        unknown = np.array([not node.known for node in nodes])
        assert unknown.sum() == copies and len(found) == len(nodes)
        assert len({tuple(np.round(p, 2)) for p in found[unknown]}) == 1
        assert (found[unknown].argmax(axis=1) == 3).all()


def test_messages_with_shared_nodes_equal_enumeration():
    rng = np.random.default_rng(17)
    field = skip_chain.Field(rng.normal(size=(skip_chain.HASHED, 5)), np.zeros((2, 5, 5)), 3.0)
    text = "a1111111 b22222222 c1111111 d1111111"
    nodes = skip_chain.tokens_of(text, [])
    local = np.array([field.unary[skip_chain.unary_features(text[n.start : n.end])].sum(axis=0) for n in nodes])
    keys = [skip_chain.similar_key(text[n.start : n.end]) for n in nodes]
    assert skip_chain.shared_nodes(keys) == (1, [(0, 4), (2, 4), (3, 4)])
    wanted = np.zeros((4, 5))
    for labels in np.ndindex(5, 5, 5, 5):
        for hub in range(5):
            tie = 3.0 * sum(labels[n] == hub for n in (0, 2, 3))
            p = np.exp(tie + sum(local[n, label] for n, label in enumerate(labels)))
            for n, label in enumerate(labels):
                wanted[n, label] += p
    wanted /= wanted.sum(axis=1, keepdims=True)
    assert np.allclose(field.posteriors(text, nodes), wanted, atol=0.01)


def test_training_sample_is_bounded(spark):
    """Neither rows without doc_id nor copies enlarge it, and long texts count from all over."""
    rows = [(None, f"call {n} at +4930{n:07d}") for n in range(1000)] + [(7, "same 1")] * 1000
    rows += [(n, f"text {n}") for n in range(10, 1000)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert 5 <= skip_chain.training_sample(docs, 30).count() <= 80
    assert skip_chain.training_sample(docs, 10_000).count() == 1000 + 1 + 990
    text = " ".join(f"{n}a" for n in range(5000))
    tokens = [row for row in skip_chain._examples_of(text) if row[0] == "token"]
    assert len(tokens) == skip_chain.TRAIN_TOKENS and len({str(row[1]) for row in tokens}) > 2
    assert list(skip_chain._examples_of("")) == []


def test_label_model_overrules_a_wrong_label():
    rng = np.random.default_rng(14)
    truth = rng.random(800) < 0.3
    votes = np.where(truth[:, None], rng.random((800, 12)) < 0.5, rng.random((800, 12)) < 0.01).astype(float)
    votes = np.concatenate([votes, votes[:, :1].repeat(8, axis=1)], axis=1)  # copies of one voter
    labels = np.where(rng.random(800) < 0.05, ~truth, truth).astype(float)
    posterior = label_model(votes, labels)
    assert ((posterior > 0.5) == truth).mean() > (labels == truth).mean()
    weights, bias = linear_classifier(votes, posterior)
    assert (((votes @ weights + bias) > 0) == truth).mean() > 0.97


def test_the_annotation_is_estimated(monkeypatch):
    """Rates of the annotation come from the votes, not from what is thought of it."""
    rng = np.random.default_rng(15)
    truth = rng.random(4000) < 0.3
    votes = np.where(truth[:, None], rng.random((4000, 15)) < 0.5, rng.random((4000, 15)) < 0.02).astype(float)
    labels = np.where(rng.random(4000) < 0.2, ~truth, truth).astype(float)
    found = label_model(votes, labels)
    assert ((found > 0.5) == truth).mean() > 0.98 > (labels == truth).mean()
    for thought in (0.7, 0.99):
        monkeypatch.setattr(weak_toxicity, "LABEL_ACCURACY", thought)
        assert np.abs(label_model(votes, labels) - found).mean() < 0.01
    # A row no lexicon voter fires on is clean, whatever a bad annotation says.
    assert found[votes.sum(axis=1) == 0].max() < 0.5


def test_scores_by_hand(spark):
    """Choice of features, label model and classifier worked out again in plain Python."""
    texts, labels = toxic_corpus(16)
    docs = documents(spark, texts)
    marked = spark.createDataFrame([(n, 1, y) for n, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    own = [n for n in range(len(texts)) if zlib.crc32(str(n).encode()) % 5]
    listed = [weak_toxicity.features_of(texts[n]) for n in own]
    y = np.array([labels[n] for n in own], float)
    pos, neg = y.sum(), len(y) - y.sum()
    worth = {}
    for feature in set().union(*listed):
        here = np.array([feature in some for some in listed])
        a, b = y[here].sum(), (1 - y[here]).sum()
        cells = (a + 0.5, pos - a + 0.5, b + 0.5, neg - b + 0.5)
        odds = np.log(cells[0] * cells[3] / cells[1] / cells[2])
        if a >= 3 and odds > 2.5 * sum(1 / cell for cell in cells) ** 0.5:
            worth[feature] = odds
    votes = np.array([[float(feature in some) for feature in sorted(worth)] for some in listed])
    posterior = np.where(y > 0, 0.95, 0.05)
    for _ in range(100):
        p, q = posterior[:, None], 1 - posterior[:, None]
        t, c = ((p * votes).sum(0) + 0.1) / (p.sum() + 1), ((q * votes).sum(0) + 0.1) / (q.sum() + 1)
        residual = votes - p * t - q * c
        size = np.sqrt((residual**2).mean(0)) + 1e-9
        related = np.abs(residual.T @ residual / len(y) / np.outer(size, size))
        share = np.maximum(1, (related * (related > 2 / len(y) ** 0.5)).sum(1))
        evidence = votes * np.log(t / c) + (1 - votes) * np.log((1 - t) / (1 - c))
        hit, slip = ((w @ y + 2 * k) / (w.sum() + 2) for w, k in ((posterior, 0.95), (1 - posterior, 0.05)))
        told = np.where(y > 0, np.log(hit / slip), np.log((1 - hit) / (1 - slip)))
        odds = np.log((p.sum() + 0.5) / (q.sum() + 0.5)) + (evidence / share).sum(1) + told
        before, posterior = posterior, 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(posterior - before).max() < 1e-4:
            break
    model = fit(docs, marked)
    assert model.weights.keys() == worth.keys()
    # The classifier stands where its penalised loss has no slope.
    w = np.array([model.weights[feature] for feature in sorted(worth)])
    slope = 1 / (1 + np.exp(-(votes @ w + model.bias))) - posterior
    assert np.abs(votes.T @ slope + w).max() < 0.05 and abs(slope.sum()) < 0.05
    for row in score_documents(docs, model).collect():
        hits = [model.weights[f] for f in worth if f in weak_toxicity.features_of(texts[row.doc_id])]
        assert abs(row.score - 1 / (1 + np.exp(-model.bias - sum(hits)))) < 1e-9


def test_repeated_ids_do_not_grow_the_sample(spark):
    ids = [1] * 300 + [n for n in range(2, 60) if zlib.crc32(str(n).encode()) % 5]
    texts = [f"some text of its own number {n} w{n}x w{n}y w{n}z" for n in range(len(ids))]
    marked = spark.createDataFrame([(n, 1, n % 2) for n in range(60)], "doc_id long, quality int, toxic int")
    found = labelled_sample(documents(spark, texts, ids), marked).collect()
    assert len(found) <= len(set(ids)) and len({r.text for r in found} & set(texts[:300])) <= 1


@pytest.mark.parametrize("marks", [[], [(3, 1, 0)], [(3, None, None), (None, 1, 1)]])
def test_toxicity_awkward(spark, marks):
    docs = awkward(spark)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = score_documents(docs, fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in rows)
    assert score_documents(docs.limit(0), fit(docs.limit(0), labels)).count() == 0
