"""The registered ``opN_`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import (bpe, conversation_repair, decontam, embedding_dedup, html_extract, langid, merkle, passage_dedup, pii, secret_scan,
                           sharding, simhash, url_filter)
from corpuslab.llm.common import bounded_batches, read


def vocabulary_path() -> str:
    """The word-level BPE file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every whole text (see ``pii``): a null text has none; repeated rows repeat."""
    return pii.pii_table(read(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids' and decoded text's digests of every whole text (see ``bpe``); a null text is empty."""
    bounded_batches(spark)
    return bpe.encode(read(spark, sf_dir, "documents"), vocabulary_path(), keep_ids=False, keep_text=False)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or trees' verdict of every url (see ``url_filter``); null urls are judged by their features."""
    return url_filter.url_verdicts(read(spark, sf_dir, "pages"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine link groups of all vectors (see ``embedding_dedup``); null, zero or non-finite vectors stand alone."""
    bounded_batches(spark)
    return embedding_dedup.near_groups(read(spark, sf_dir, "embeddings"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the rows that are not held out (see ``langid``); ``und`` without letters."""
    bounded_batches(spark)
    docs = read(spark, sf_dir, "documents")
    dictionaries = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, dictionaries).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and group of every document (see ``simhash``); null and empty texts have fingerprint zero."""
    bounded_batches(spark)
    return simhash.simhash_groups(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets found in every whole text (see ``secret_scan``), one row each; null texts have none."""
    bounded_batches(spark)
    return secret_scan.findings(read(spark, sf_dir, "documents")).where("is_secret").drop("is_secret")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without bytes of repeated 400-byte strings (see ``passage_dedup``); null texts are empty."""
    bounded_batches(spark)
    return passage_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item it holds (see ``decontam``); null texts and items match nothing."""
    bounded_batches(spark)
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page (see ``html_extract``); null and empty pages have an empty one."""
    bounded_batches(spark)
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and the shard after one more is added, of every document (see ``sharding``)."""
    return sharding.shard_table(read(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every damaged conversation (see ``conversation_repair``)."""
    bounded_batches(spark)
    conversations = read(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damage(conversations), conversations)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and tampering check of every document (see ``merkle``)."""
    return merkle.audit(read(spark, sf_dir, "documents")).drop("source", "path")


QUERIES = {f.__name__: f for f in (op1_pii, op2_bpe, op3_url_filter, op4_embedding_dedup, op5_language, op6_simhash, op7_secrets, op8_passages,
                                   op9_decontamination, op10_main_text, op11_sharding, op12_conversations, op13_merkle)}

ORACLES: dict[str, str] = {"op13_merkle": merkle.manifest_sql()}
