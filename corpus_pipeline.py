"""A cleaned and encoded corpus, stage by stage; each stage's rows are written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from safesight.llm import bpe, decontaminate, jaccard_join, secrets, toxicity
from safesight.llm.common import by_ids, cut, discard, table, table_path, written
from safesight.llm.queries import TOXIC_FROM, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity vote rejects go."""
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity_model(spark, docs, sf_dir))
    return by_ids(docs, cut(scored.where(F.col("score") >= TOXIC_FROM).select("doc_id").distinct()), "doc_id", "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 80 % of their five-word shingles the document with the smallest id stays (the least text, if rows share it; all rows without an id stay)."""
    found = jaccard_join.join(docs.select("doc_id", "text"), n=5, percent=80)
    kept = by_ids(docs, cut(found.where("component_id <> doc_id").select("doc_id").distinct()), "doc_id", "left_anti")
    repeated = docs.groupBy("doc_id").count().where("count > 1")
    if repeated.where("doc_id is not null").isEmpty():
        return kept
    least = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first()))
    return kept.withColumn("_place", least).where("_place = 1 or doc_id is null").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    found = decontaminate.find_leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return by_ids(docs, cut(found.select("doc_id").distinct()), "doc_id", "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text decoded from them."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", encode),
]

#: Votes, approximate windows and models can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; a stage's table goes when the next one is written."""
    docs, done = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = table_path(spark)
        docs = written(stage(spark, docs, sf_dir), path)
        if done:
            discard(spark, done)
        done = path
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The pipeline as a query."""
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """None of it."""
    return {}
