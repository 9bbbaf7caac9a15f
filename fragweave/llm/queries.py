"""The registered queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragweave.llm import bpe, divergence, flatgraph, langid, lm, oracles, packing, quality, simhash, styletree, toolcalls
from fragweave.llm.common import fold
from fragweave.session import table


def held_out(folds: int, fold_held: int):
    """Whether the id's fold is the one held out; a null id's isn't."""
    return F.coalesce(fold("doc_id", folds) == fold_held, F.lit(False)).alias("held_out")


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and divergence verdict of every document."""
    found = divergence.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select("doc_id", held_out(3, 1), "score", "predicted")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return styletree.extract(table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every document, learnt outside the held-out tenth."""
    return lm.likelihoods(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of every vector at a cosine of 0.95."""
    return flatgraph.near_groups(table(spark, sf_dir, "embeddings"))


def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation: calls, results and what refers to what, and plain messages as they are."""
    found = toolcalls.link(toolcalls.read_events(table(spark, sf_dir, "conversations")))
    # every column has a value: level is -2 where there is none, valid true where there is nothing to check
    found = found.withColumn("errors", F.array_join("errors", "; "))
    return found.na.fill({"call_id": "", "level": -2, "valid": True})


def op7_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the ids and of the decoded text of every document under the word vocabulary."""
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 1024."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", held_out(5, 0), "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-copy group of every document."""
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


QUERIES = {
    "op1_distribution_divergence": op1_distribution_divergence,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_html_extraction": op3_html_extraction,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_tool_call_linking": op6_tool_call_linking,
    "op7_bpe_encoding": op7_bpe_encoding,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {"op1_distribution_divergence": oracles.op1(), "op6_tool_call_linking": oracles.op6()}
