"""Registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from safesight.llm import bpe, decontaminate, jaccard_join, language_model, merkle, nn_descent, quotes, secrets, site_style, suffix_dedup, toxicity, url_rules, whitening
from safesight.llm.common import remainder, table


#: Fixed values of the query contracts.
TOXIC_FOLDS, TOXIC_HELD_OUT, TOXIC_FROM = 4, 2, 0.3


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.digests(table(spark, sf_dir, "documents"))


def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, with what it replies to, its thread and depth."""
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.QUERY_RULES, url_rules.QUERY_GLOBS).select("page_id", "host", "path", "rule", "verdict")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return nn_descent.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return site_style.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded text."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Trained on the labelled rows of docs that are not held out."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", TOXIC_FOLDS) != TOXIC_HELD_OUT).select("doc_id", "toxic")
    return toxicity.fit(docs, labels)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (remainder("doc_id", TOXIC_FOLDS) == TOXIC_HELD_OUT).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document, learned from nine tenths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 10) == 0).alias("held_out"))
    return language_model.score(docs, "held_out")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that are left without strings of 50 bytes from documents with smaller ids."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), least=50)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and its check of every document."""
    made = merkle.manifest(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first four components, whitened."""
    return whitening.components_of(table(spark, sf_dir, "embeddings"), k=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to a function of (spark, sf_dir)."""
    return {f.__name__: f for f in (op1_secret_scan, op2_quotation_links, op3_url_filter, op4_nearest, op5_main_text, op6_decontaminate, op7_bpe, op8_toxicity, op9_jaccard_join, op10_language_model, op11_suffix_dedup, op12_merkle_manifest, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL with the same rows."""
    return {"op2_quotation_links": quotes.ORACLE_SQL, "op3_url_filter": url_rules.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL}
