"""Queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

import corpus_pipeline
from rostrum.llm import (
    bpe, filter_audit, language_id, language_model, near_duplicates, packing, pii, sentence_pieces, spelling_variants, toxicity, urls, vectors,
)

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_language_id": language_id.op2_language_id,
    "op3_pii_pseudonyms": pii.op3_pii_pseudonyms,
    "op4_lm_scores": language_model.op4_lm_scores,
    "op5_exact_top_k": vectors.op5_exact_top_k,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_near_duplicates": near_duplicates.op7_near_duplicates,
    "op8_nearest_neighbours": vectors.op8_nearest_neighbours,
    "op9_url_filter": urls.op9_url_filter,
    "op10_bpe_round_trip": bpe.op10_bpe_round_trip,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_sentence_pieces": sentence_pieces.op13_sentence_pieces,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op5_exact_top_k": vectors.ORACLE_EXACT, "op9_url_filter": urls.ORACLE, "op11_filter_audit": filter_audit.ORACLE}
