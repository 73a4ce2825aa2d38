"""Five stages over documents: language ID, line dedup, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.llm import langid, line_dedup, near_dup, packing, secrets
from larkspar.llm.common import free_name, shared_folder

#: A document goes when its language is undetermined or less likely than this.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = langid.identify(docs, langid.fit(docs), pred, score)
    return found.where((F.col(pred) != langid.UND) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents lose the lines they share with earlier ones; those of which nothing is left go."""
    lines, removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    out = line_dedup.dedup_lines(docs, counts=(lines, removed))
    left = F.trim(F.col("text"), F.lit(line_dedup.WHITE)) != ""
    return out.where((F.col(removed) == 0) | left).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that with the smallest doc_id."""
    return near_dup.without_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets become a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packing_report(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("secret_scan", secret_scan), ("best_fit_packing", pack)]

#: Alignment, sketches and packing are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
