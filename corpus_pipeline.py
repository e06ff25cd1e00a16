"""A training-data pipeline of five stages; each filters or rewrites the documents that the one before kept.

toxicity: documents that score 0.7 or more go; null and empty texts stay. near_duplicates: of each component the document of the
smallest doc_id stays, one row of it; rows without words stay. decontamination: documents that hold a benchmark item go.
secrets: spans are replaced by a mark, n_chars follows. bpe: the columns stay, and n_tokens, ids (packed, little-endian unsigned
32-bit) and the hashes of the ids and of the decoded text follow. Rows with a null doc_id go through all stages. Extra columns
stay, but for those named as the last stage's own four. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from verdant.llm import bpe, decontam, jaccard, secrets, toxicity
from verdant.llm.common import cut, small_batches, table
from verdant.llm.queries import tokenizer_file, toxic_model

#: Rows of an Arrow batch: the stages share their executors' memory, and what one took outside the heap stays.
BATCH = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH)
    return toxicity.clean(docs, *toxic_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH)
    return jaccard.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


@F.pandas_udf(StringType())
def redacted(text):
    return text.map(secrets.redact, na_action="ignore")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH)
    return docs.withColumn("text", redacted("text")).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH)
    return bpe.encoded(docs, tokenizer_file())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("secrets", redact_secrets), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
