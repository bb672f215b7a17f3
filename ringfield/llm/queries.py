"""The queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import importlib

QUERIES = {
    "op1_scoring": "scoring",
    "op2_sharding": "sharding",
    "op3_mixing": "mixing",
    "op4_chat": "chat",
    "op5_quality": "quality",
    "op6_neardup": "neardup",
    "op7_linededup": "linededup",
    "op8_suffixdedup": "suffixdedup",
    "op9_neighbours": "neighbours",
    "op10_packing": "packing",
    "op11_trie": "trie",
    "op12_manifest": "manifest",
    "op13_simhash": "simhash",
}


def queries() -> dict:
    found = {k: getattr(importlib.import_module(f"ringfield.llm.{m}"), k) for k, m in QUERIES.items()}
    found["pipeline"] = importlib.import_module("corpus_pipeline").run
    return found


def oracle_sql() -> dict[str, str]:
    return {}
