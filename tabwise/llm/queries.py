"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabwise.llm import (
    collocations,
    conversations,
    decontaminate,
    fingerprints,
    licenses,
    near_dedup,
    packing,
    quality,
    sharding,
    token_files,
    top_k,
    url_filter,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_minhash_near_dedup": near_dedup.op2_minhash_near_dedup,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_minimax_sharding": sharding.op4_minimax_sharding,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_token_files": token_files.op6_token_files,
        "op7_warc": warc.op7_warc,
        "op8_fingerprints": fingerprints.op8_fingerprints,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_quality": quality.op10_quality,
        "op11_top_k": top_k.op11_top_k,
        "op12_conversation_repair": conversations.op12_conversation_repair,
        "op13_collocations": collocations.op13_collocations,
    }


def all_oracles() -> dict[str, str]:
    return {
        "op2_minhash_near_dedup": near_dedup.OP2_SQL,
        "op3_license_scan": licenses.OP3_SQL,
        "op7_warc": warc.OP7_SQL,
        "op9_url_filter": url_filter.OP9_SQL,
        "op11_top_k": top_k.op11_top_k,
        "op11_top_k": top_k.OP11_SQL,
        "op13_collocations": collocations.OP13_SQL,
    }
