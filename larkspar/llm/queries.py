"""The thin queries over the test tables, one for each operator, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, module: str, function: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from importlib import import_module

        return getattr(import_module(f".{module}", __package__), function)(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    return run


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    out = {
        "op1_license_scan": _over("documents", "licenses", "license_report"),
        "op2_embedding_near_dedup": _over("embeddings", "embed_dedup", "similar_vectors"),
        "op3_minhash_near_dedup": _over("documents", "near_dup", "near_duplicate_report"),
        "op4_best_fit_packing": _over("documents", "packing", "packing_report"),
        "op5_line_dedup": _over("documents", "line_dedup", "line_report"),
        "op6_suffix_array_dedup": _over("documents", "suffix_dedup", "remove_repeats"),
        "op7_sentencepiece_nbest": _over("documents", "pieces", "piece_report"),
        "op8_language_id": _over("documents", "langid", "language_report"),
        "op9_secret_scan": _over("documents", "secrets", "secret_report"),
        "op10_nearest_neighbours": _over("embeddings", "ann", "nearest_report"),
        "pipeline": _pipeline,
    }
    return out


def oracle_sql() -> dict[str, str]:
    """The forms of the operators that SQL can state."""
    return oracles.oracle_sql()
