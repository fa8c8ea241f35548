"""The corpus pipeline: documents filtered, deduplicated, masked and packed.

``STAGES`` lists the stages in order. Each takes the session, the documents its
predecessor kept and the table directory, and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import skip_chain, weak_toxicity
from faultlens.llm.common import table
from faultlens.llm.harmonic_packing import pack_documents
from faultlens.llm.line_runs import dedup_lines
from faultlens.llm.simhash import near_duplicates
from faultlens.runtime import pin

TOKENIZER = "byte_bpe_50k.json"


def _with_text(docs: DataFrame, text) -> DataFrame:
    """Documents with another text, and its length where there is a column for it."""
    docs = docs.withColumn("text", text)
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity classifier does not reject; it learns from ``labels``."""
    model = weak_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = weak_toxicity.score_documents(docs, model)
    return scored.filter("predicted = 0").select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines three or more of them share, but for the last holder's.

    Documents left without any line stay, with empty text.
    """
    kept = dedup_lines(docs)
    return _with_text(kept, F.col("kept_text")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Rows without doc_id stay, and so do rows that repeat the doc_id that is kept.
    """
    gone = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    found = skip_chain.find_personal_data(docs, skip_chain.fit(docs))
    hidden = skip_chain.masked(found)
    return _with_text(hidden, F.col("text")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents cut into pieces and packed into sequences of token ids."""
    pieces = pack_documents(docs, public_tokenizers.path(TOKENIZER))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack),
]

# A classifier and a random field are beyond SQL; tests hold the rows of run()
# against the stages worked out in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
