"""Queries of this subpackage by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from dirgauge.llm import chat_format, embedding_dedup, line_dedup, minhash, mixing, packing, quality, simhash, token_counts, url_filter


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_quality": quality.op1_quality,
        "op2_simhash": simhash.op2_simhash,
        "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
        "op4_minhash": minhash.op4_minhash,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_source_mix": mixing.op7_source_mix,
        "op8_chat_format": chat_format.op8_chat_format,
        "op9_packing": packing.op9_packing,
        "op10_url_filter": url_filter.op10_url_filter,
    }


def oracle_sql() -> dict:
    return {
        "op3_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op4_minhash": minhash.ORACLE_SQL,
        "op5_line_dedup": line_dedup.ORACLE_SQL,
        "op8_chat_format": chat_format.ORACLE_SQL,
        "op10_url_filter": url_filter.ORACLE_SQL,
    }
