"""The queries of the numbered operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from importlib import import_module

#: Query name and its module in this subpackage.
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_html_text": "html_extract",
    "op3_mix_sources": "mixing",
    "op4_secret_scan": "secret_scan",
    "op5_hash_tree_shards": "sharding",
    "op6_benchmark_decontamination": "decontaminate",
    "op7_warc": "warc",
    "op8_license_scan": "license_scan",
    "op9_exact_dedup": "exact_dedup",
    "op10_ngram_jaccard_join": "jaccard_join",
    "op11_hard_negatives": "hard_negatives",
    "op12_url_filter": "url_filter",
    "op13_fill_in_middle": "fill_in_middle",
}


def queries() -> dict:
    return {name: getattr(import_module(f"quern.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in MODULES.items():
        if sql := getattr(import_module(f"quern.llm.{module}"), "SQL", None):
            out[name] = sql
    return out
