"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query name: (module, function, name of its SQL or None)
_TABLE = {
    "op9_quality_rules": ("quality", "op9_quality_rules", "OP9_SQL"),
    "op10_decontaminate": ("decontaminate", "op10_decontaminate", "OP10_SQL"),
    "op7_sentencepiece": ("pieces", "op7_sentencepiece", None),
    "op6_simhash": ("simhash", "op6_simhash", None),
    "op4_warc": ("warc", "op4_warc", "OP4_SQL"),
    "op3_line_dedup": ("line_dedup", "op3_line_dedup", None),
    "op1_surrogates": ("surrogates", "op1_surrogates", None),
    "op8_main_text": ("wrappers", "op8_main_text", None),
    "op2_substrings": ("substrings", "op2_substrings", None),
    "op5_minimax_shards": ("sharding", "op5_minimax_shards", None),
    "op11_yinyang_codes": ("yinyang", "op11_yinyang_codes", "OP11_SQL"),
    "op12_filter_audit": ("filter_audit", "op12_filter_audit", "OP12_SQL"),
    "op13_language_id": ("language_id", "op13_language_id", None),
}


def _load(module: str, name: str):
    return getattr(import_module(f"{__package__}.{module}"), name)


def queries() -> dict:
    return {key: _load(module, function) for key, (module, function, _) in _TABLE.items()}


def oracle_sql() -> dict:
    return {key: _load(module, sql) for key, (module, _, sql) in _TABLE.items() if sql}
