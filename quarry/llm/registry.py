"""The queries of the corpus operators and their DuckDB SQL where there is one."""

from __future__ import annotations

from quarry.llm import op1_language, op2_simhash, op3_suffixes, op4_substrings, op5_lines, op6_topk, op7_pii, op8_mixing, op9_quality, op10_sentencepiece

QUERIES = {
    "op1_language": op1_language.query,
    "op2_simhash": op2_simhash.query,
    "op3_suffixes": op3_suffixes.query,
    "op4_substrings": op4_substrings.query,
    "op5_lines": op5_lines.query,
    "op6_topk": op6_topk.query,
    "op7_pii": op7_pii.query,
    "op8_mixing": op8_mixing.query,
    "op9_quality": op9_quality.query,
    "op10_sentencepiece": op10_sentencepiece.query,
    "pages_language": op1_language.pages,
    "mixing_targets": op8_mixing.targets,
}

ORACLE_SQL: dict[str, str] = {
    "op4_substrings": op4_substrings.SQL,
    "op6_topk": op6_topk.SQL,
    "op9_quality": op9_quality.SQL,
    "mixing_targets": op8_mixing.SQL,
}
