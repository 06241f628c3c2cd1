"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import alignment, embedding_dedup, language_id, lexical, licenses, lm_scoring, main_text, mixing, nearest, packing, sharding, simhash_dedup, toxicity


QUERIES = {
    "op1_simhash_near_dedup": simhash_dedup.op1_simhash_near_dedup,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_language_id": language_id.op4_language_id,
    "op5_sharding": sharding.op5_sharding,
    "op6_embedding_near_dedup": embedding_dedup.op6_embedding_near_dedup,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_nearest_neighbours": nearest.op8_nearest_neighbours,
    "op9_mixing": mixing.op9_mixing,
    "op10_packing": packing.op10_packing,
    "op11_main_text": main_text.op11_main_text,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
}

ORACLES = {"op7_license_scan": licenses.SQL, "op12_lexical_search": lexical.SQL}
