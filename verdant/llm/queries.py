"""The queries of this folder's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html, jaccard, langid, licenses, merkle, neural, rules, secrets, toxicity, trie, warc
from .common import bucket, small_batches, table


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def subword_file() -> tuple[str, str]:
    """File of the language model's subwords, and the pattern that cuts texts for it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    models = langid.learn(docs.where(bucket(4) != 2).select("doc_id", "text", "lang"))
    out = langid.predict(docs, models)
    return out.select("doc_id", (bucket(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.link(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets.digests(table(spark, sf_dir, "documents"))


def toxic_model(spark: SparkSession, sf_dir: str) -> tuple:
    """Terms and model of the labelled rows of the whole documents table."""
    seen = bucket(3) != 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.fit(table(spark, sf_dir, "documents").where(seen), labels.where(seen))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = toxicity.score(table(spark, sf_dir, "documents"), *toxic_model(spark, sf_dir))
    return out.select("doc_id", (bucket(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html.main_text(table(spark, sf_dir, "pages"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = neural.score(docs, bucket(7) != 2, *subword_file())
    return out.select("doc_id", (bucket(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    folder = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = merkle.manifest(merkle.documents(table(spark, sf_dir, "documents"), bucket(7) == 0))
    return d.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return trie.nodes(trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_ngram_jaccard_join, op3_quality_rules, op4_secret_scans, op5_toxicity, op6_license_scans, op7_bpe, op8_decontamination, op9_html_extraction, op10_lm_scoring, op11_warc, op12_merkle_manifest, op13_conversation_trie)}
ORACLES: dict[str, str] = {"op11_warc": warc.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_conversation_trie": trie.ORACLE}
