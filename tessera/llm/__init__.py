"""Operators for training corpora and their registered queries; nothing else in the library imports this subpackage."""

from __future__ import annotations

from tessera.llm.alignment import op12_token_alignment
from tessera.llm.byte_bpe import op11_byte_bpe
from tessera.llm.fingerprints import op10_document_fingerprints
from tessera.llm.html_text import op5_html_extraction
from tessera.llm.language_id import op4_language_id
from tessera.llm.mixing import op8_source_mixing
from tessera.llm.nearest import op6_exact_topk, op6_sql
from tessera.llm.packing import op3_packing
from tessera.llm.pii import op2_pii
from tessera.llm.resampling import op13_importance_resampling, op13_sql
from tessera.llm.secrets import op9_secret_scans
from tessera.llm.simhash import op7_simhash_near_dedup
from tessera.llm.token_counts import op1_token_counts


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_pii, op3_packing, op4_language_id, op5_html_extraction, op6_exact_topk, op7_simhash_near_dedup, op8_source_mixing, op9_secret_scans, op10_document_fingerprints, op11_byte_bpe, op12_token_alignment, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_topk": op6_sql(), "op13_importance_resampling": op13_sql()}
