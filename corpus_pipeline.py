"""A corpus pipeline: language ID, near-dedup, decontamination, source mixing, token-id output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs; a stage's folder is removed once the next one stands. All but the last return the columns of documents.

Defined results for every stage: an empty table gives an empty one; null texts count as empty; very long texts are worked on whole;
repeated rows are worked on one by one unless a stage says otherwise; further columns of any name are carried through, up to the last
stage. Ties are settled by doc_id and text, so reruns agree.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontam, langid, mixing, simhash, tokens
from gridloom.llm.common import read_table, shared_dir
from gridloom.llm.queries import vocabulary
from gridloom.session import remove

#: Documents whose language is found with less posterior probability are rejected, as are those without letters.
MIN_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is identified; null, empty and letterless texts go. Rows without doc_id or lang are judged,
    but not learned from; without any such row nothing is learned and all go."""
    model = langid.train(docs, vocabulary("byte_bpe_50k.json"))
    found = langid.identify(docs, model, docs.columns).where(langid.accepted(MIN_LANGUAGE_SCORE))
    return found.select(*[F.col("text") if c == "text" else F.col(f"`keep_{c}`").alias(c) for c in docs.columns])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, the one of the smallest doc_id; of its repeated rows, the first by text and the
    other columns. Rows without a doc_id stay."""
    return simhash.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages; documents without words stay. An empty benchmark drops none."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes of each source (null is one) its target of words: documents may be repeated, cut or left out, those without words are."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids, and returns what the files hold of each document, null doc_ids first."""
    return tokens.read(spark, tokens.write(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mix_sources", mixing_stage),
    ("token_output", token_stage),
]

#: SQL cannot express the language model's training or the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's rows are written and read again."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
