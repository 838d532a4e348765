"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

#: module, query, name of the SQL in that module (or None)
_TABLE = [
    ("op1_suffix", "op1_suffix_dedup", None),
    ("op2_bpe", "op2_bpe_digest", None),
    ("op3_langid", "op3_language_id", None),
    ("op4_packing", "op4_best_fit_packing", None),
    ("op5_tokencount", "op5_separator_scan", None),
    ("op6_quality", "op6_quality_rules", "SQL"),
    ("op7_jaccard", "op7_ngram_jaccard", None),
    ("op8_lines", "op8_line_dedup", "SQL"),
    ("op9_lattice", "op9_lattice_neardup", None),
    ("op10_chat", "op10_chat_rotation", "SQL"),
    ("op11_audit", "op11_filter_audit", "SQL"),
    ("op12_search", "op12_ranked_search", "SQL"),
    ("op13_tiktoken", "op13_tiktoken_digest", None),
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{mod}"), name) for mod, name, _ in _TABLE}


def oracle_sql() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{mod}"), sql) for mod, name, sql in _TABLE if sql}
