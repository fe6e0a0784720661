"""The corpus operators' registered queries, and DuckDB SQL where it can express them."""

from __future__ import annotations

from . import decontaminate, html, mixing, secrets, sharding, simhash, token_files, tokens, toxicity, winnowing

QUERIES = {
    "op1_balanced_shards": sharding.query,
    "op2_source_mix": mixing.query,
    "op3_simhash_duplicates": simhash.query,
    "op4_token_counts": tokens.query,
    "op5_benchmark_decontamination": decontaminate.query,
    "op6_secret_scan": secrets.query,
    "op7_token_files": token_files.query,
    "op8_html_text": html.query,
    "op9_toxicity": toxicity.query,
    "op10_winnowing": winnowing.query,
}

ORACLE_SQL = {
    "op2_source_mix": mixing.SQL,
    "op5_benchmark_decontamination": decontaminate.SQL,
    "op6_secret_scan": secrets.SQL,
}
