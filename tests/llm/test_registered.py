"""The registered queries and the pipeline on the smallest tables."""

import hashlib
import re
import zlib

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from helpers import components, fingerprint, sha
from pyspark.sql import functions as F
from test_dedup import lines_without, near
from test_text import base, check_packed
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from faultlens.llm import skip_chain
from faultlens.llm.oracles import LLM_ORACLES
from faultlens.llm.queries import LLM_QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    return {row.doc_id: row.text for row in rows}


def run(spark, name):
    return driver.queries()[name](spark, SF_DIR).collect()


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in LLM_QUERIES) == list(range(1, 14))
    assert set(driver.queries()) >= {*LLM_QUERIES, "pipeline"}
    assert set(LLM_ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", LLM_ORACLES)
def test_query_equals_sql(spark, name):
    tables = duckdb.connect()
    for table in ("documents", "embeddings"):
        tables.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    found = driver.queries()[name](spark, SF_DIR)
    wanted = tables.execute(LLM_ORACLES[name])
    columns = [column[0] for column in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    rows = [tuple(str(v) for v in row) for row in found.select(*columns).collect()]
    assert sorted(rows) == sorted(tuple(str(v) for v in row) for row in wanted.fetchall())


def test_personal_data(spark, docs):
    kinds = skip_chain.KINDS
    for row in run(spark, "op1_pii"):
        spans = base(docs[row.doc_id])
        text = [f"{kinds[k]}:{s}:{e}" for s, k, e in spans]
        assert [row[f"n_{kind}"] for kind in kinds] == [sum(k == n for _, k, _ in spans) for n in range(4)]
        assert row.base_sha256 == sha(",".join(text))
        assert set(text) <= set(row.spans.split(","))


def test_shards(spark, docs):
    rows = run(spark, "op2_sharding")
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for row in rows:
        data = docs[row.doc_id].encode()
        assert (row["size"], row.text_crc32, row.law) == (len(data) + 8, zlib.crc32(data), "bytes")
        assert 0 <= row.shard < 24 and row.grown_shard is None
    sizes = [sum(row["size"] for row in rows if row.shard == n) for n in range(24)]
    assert max(sizes) - min(sizes) <= max(row["size"] for row in rows)


def test_simhash(spark, docs):
    rows = sorted((tuple(r) for r in run(spark, "op3_simhash")), key=str)
    assert rows == near(list(docs.items()))


def test_html(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for row in run(spark, "op6_html"):
        article = re.search(r"<article>(.*)</article>", pages[row.page_id].html, re.S)[1]
        words = re.sub("<[^>]*>", " ", article).replace("&amp;", "&").replace("&quot;", '"').split()
        assert row.text.split() == words
        assert (row.n_chars, row.url) == (len(row.text), pages[row.page_id].url)


def test_sentencepiece(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = run(spark, "op8_sentencepiece")
    assert len(rows) == len(docs)
    for row in rows:
        ids = library.encode(docs[row.doc_id])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert row.decoded_sha256 == sha(library.decode(ids))


def test_packing(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for row in run(spark, "op9_packing"):
        if row.doc_id not in ids:
            ids[row.doc_id] = library.encode(docs[row.doc_id], add_special_tokens=False).ids + [1]
        own = ids[row.doc_id][row.start : row.start + row.length]
        data = b"".join(n.to_bytes(4, "little") for n in own)
        assert (row.ids_crc32, row.doc_tokens, len(own)) == (zlib.crc32(data), len(ids[row.doc_id]), row.length)
    assert set(ids) == set(docs)


def test_toxicity(spark, docs):
    rows = run(spark, "op10_toxicity")
    assert {r.doc_id for r in rows} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def plain_mask(text, spans):
    out, at = [], 0
    for span in spans:
        if span[0] >= at:
            out += [text[at : span[0]], f"[{skip_chain.KINDS[span[1]].upper()}]"]
        at = max(at, span[2])
    return "".join(out) + text[at:]


def test_pipeline_stages(spark, docs):
    """Each stage on its own input, against a plain version."""
    columns = spark.read.parquet(f"{SF_DIR}/documents.parquet").columns
    now = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        field = skip_chain.fit(now) if name == "pii" else None
        now = stage(spark, now, SF_DIR)
        if name != "packing":
            assert now.columns == columns
            now = spark.createDataFrame(now.collect(), now.schema)
            after = {r.doc_id: r.text for r in now.collect()}
            assert all(r.n_chars == len(r.text) for r in now.collect())
        if name == "toxicity":
            assert {i: before[i] for i in after} == after
            assert len(before) - len(after) <= len(before) * 0.2
            # What goes are labelled as toxic, or unlabelled.
            clean = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("toxic = 0").collect()}
            assert len((set(before) - set(after)) & clean) <= 2 and toxic
        elif name == "line_dedup":
            assert after == {i: text for i, _, _, text in lines_without(list(before.items()))}
        elif name == "simhash_near_dedup":
            kept = {i for i, _, component in near(list(before.items())) if i == component}
            assert after == {i: before[i] for i in kept}
        elif name == "pii":
            assert after == {i: plain_mask(t, field.spans(t)) for i, t in before.items()}
        else:
            check_packed(now.collect(), before)


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert {"doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "ids_crc32"} == set(rows.columns)
    assert rows.filter(F.crc32("ids") != F.col("ids_crc32")).count() == 0
    assert rows.count() > 0


def test_helpers_agree():
    assert fingerprint(" \n") == 0 and components([1, 2], [(1, 2)]) == {1: 1, 2: 1}
    assert sha("") == hashlib.sha256(b"").hexdigest()
