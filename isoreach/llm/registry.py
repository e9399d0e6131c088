"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from isoreach.llm import oracle, url_filter
from isoreach.shipping import ship

#: Query name, module and function; each function takes the documents table, or
#: those that ``TABLES`` names, and returns the full result.
QUERIES = {
    "op1_substring_dedup": ("substring_dedup", "remove_repeated_windows"),
    "op2_rendezvous_sharding": ("sharding", "shard_documents"),
    "op3_line_quality": ("quality", "score_documents"),
    "op4_pii_boosting": ("pii", "report"),
    "op5_language_id": ("language", "identify"),
    "op6_packed_ids": ("token_rows", "pack_report"),
    "op7_decontamination": ("decontamination", "contaminated"),
    "op8_tier_packing": ("tier_packing", "pack_pieces"),
    "op9_suffix_dedup": ("suffix_dedup", "remove_repeated_bytes"),
    "op10_near_dedup": ("near_dedup", "near_duplicates"),
    "op11_url_filter": ("url_filter", "report"),
    "op12_periodic_runs": ("runs", "report"),
    "op13_embedding_whitening": ("whitening", "report"),
}

TABLES = {"decontamination": ("documents", "benchmark"), "url_filter": ("pages",), "whitening": ("embeddings",)}


def _query(module: str, function: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        operator = getattr(import_module(f"isoreach.llm.{module}"), function)
        return operator(*[spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES.get(module, ("documents",))])

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The operators, each over its whole table with production parameters."""
    return {name: _query(*where) for name, where in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL expresses the operator."""
    return oracle.SQL | {"op11_url_filter": url_filter.verdict_sql()}
