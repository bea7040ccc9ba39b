"""The corpus pipeline: toxic documents go, near duplicates and repeated passages go, sources are mixed, texts become ids.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and returns a DataFrame; the driver writes it
as Parquet and gives what it reads back to the next. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, common, mixing, ngram_jaccard, suffix_dedup, toxicity
from quarry.llm.queries import held_out
from quarry.session import ship_package, table

#: Documents of this toxicity or more go.
TOXIC = 0.7

#: CRFs, encodings and checksums have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is below TOXIC. The chain learns from labelled documents of the stage's own input."""
    ship_package(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    return toxicity.below(docs, model, TOXIC)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that five-word shingles link at a similarity of 0.8 or more: the one with the smallest id, null last."""
    ship_package(spark)
    return ngram_jaccard.one_of_group(docs, n=5, num=80, den=100)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they stand first, by doc_id and position, and go elsewhere."""
    ship_package(spark)
    return suffix_dedup.without_later(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources by weights 1, 2, 3 takes them, to the nearest whole."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids: a row for each row of the mix."""
    ship_package(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, chars=4_000_000)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read back before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialise(docs, f"stage-{name}")
    return docs
