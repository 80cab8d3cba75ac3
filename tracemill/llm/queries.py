"""The queries of this subpackage, one per operator over its whole table, and the SQL that a second engine can run."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name: module under tracemill.llm whose query(spark, sf_dir) gives the result; its SQL, if any, is ORACLE_SQL there.
MODULES = {
    "op4_forest_secrets": "secrets_query",
    "op1_warc_index": "warc_query",
    "op8_ipf_mixing": "mixing_query",
    "op6_tput_topk": "topk_search_query",
    "op7_winnowing": "fingerprints_query",
    "op9_licence_scan": "licences_query",
    "op10_maxent_lm": "maxent_lm_query",
    "op2_minhash_neardup": "near_dup_query",
    "op3_crf_quality": "line_quality_query",
    "op5_bfd_packing": "packing_query",
}


def _query(module: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: importlib.import_module(f"tracemill.llm.{module}").query(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"tracemill.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
