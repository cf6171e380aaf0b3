"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query and the module that has it as a function of that name; ORACLE_SQL there maps names to SQL.
WHERE = {
    "op1_langid": "langid",
    "op2_ngram_jaccard": "ngram_join",
    "op3_embedding_dedup": "embedding_dedup",
    "op4_quality": "kneser_ney",
    "op5_chat": "chat_tree",
    "op6_licenses": "licenses",
    "op7_mixing": "mixing",
    "op8_html": "html_text",
    "op9_sentencepiece": "sentencepieces",
    "op10_media": "media",
    "op11_line_dedup": "line_dedup",
    "op12_turn_repair": "turn_repair",
    "op13_hard_negatives": "hard_negatives",
}


def _modules():
    return {name: importlib.import_module(f"kinfold.llm.{module}") for name, module in WHERE.items()}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _modules().items()}


def oracle_sql() -> dict:
    return {name: module.ORACLE_SQL[name] for name, module in _modules().items() if name in getattr(module, "ORACLE_SQL", {})}
