"""A corpus pipeline of five stages, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns documents with the
columns of ``documents``; the last returns the token files' index.  A stage
begins with executors' heaps emptied of what the one before left.

Null and empty texts score as clean, are one group of near copies (one stays),
are never hit and have no words, so the mix leaves them out unless their
source is repeated as a whole.  Rows with one id and equal texts are one
document from the second stage on.  Other columns are kept whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathframe.llm import decontaminate, mixing, simhash_dedup, token_output, toxicity
from pathframe.llm.common import give_back, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.5."""
    give_back(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    give_back(spark)
    return simhash_dedup.drop_near_copies(docs, words=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    give_back(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3 by turns, at most three epochs of each."""
    give_back(spark)
    return mixing.mixed_documents(docs, max_epochs=3.0)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and their index as read back."""
    import public_tokenizers

    give_back(spark)
    files = token_output.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, by_words=True)
    return token_output.read_documents(files)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix),
    ("token_output", write_tokens),
]

#: The fingerprint, mixing order and tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
