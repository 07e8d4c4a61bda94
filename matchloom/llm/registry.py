"""Queries of this subpackage, with SQL where SQL can express the operator on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from matchloom.llm import (
    op1_quality,
    op2_licenses,
    op3_classifier,
    op4_rollups,
    op5_mixing,
    op6_bpe,
    op7_pii,
    op8_jaccard,
    op9_ann,
    op10_urls,
    op11_spelling,
    op12_alignment,
    op13_toxicity,
    pipeline,
)

_MODULES = {
    "op1_quality_rules": op1_quality,
    "op2_licenses": op2_licenses,
    "op3_quality_classifier": op3_classifier,
    "op4_token_counts": op4_rollups,
    "op5_mixing": op5_mixing,
    "op6_byte_bpe": op6_bpe,
    "op7_pii": op7_pii,
    "op8_ngram_jaccard": op8_jaccard,
    "op9_nearest_codes": op9_ann,
    "op10_url_filters": op10_urls,
    "op11_spelling_variants": op11_spelling,
    "op12_token_alignment": op12_alignment,
    "op13_toxicity": op13_toxicity,
}


def queries() -> dict[str, Callable]:
    return {name: m.query for name, m in _MODULES.items()} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}
    return own | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
