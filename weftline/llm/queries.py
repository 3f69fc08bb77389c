"""The subpackage's queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from weftline.llm import chat, hilbert, merkle, minhash, packing, privacy, quality, repeats, simhash, target, tokens, whitening

QUERIES = {
    "op1_suffix_array_dedup": repeats.op1_suffix_array_dedup,
    "op2_personal_data": privacy.op2_personal_data,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_nearest_neighbours": hilbert.op4_nearest_neighbours,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_document_fingerprints": merkle.op6_document_fingerprints,
    "op7_minhash_near_dedup": minhash.op7_minhash_near_dedup,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_packing": packing.op9_packing,
    "op10_bpe_round_trip": tokens.op10_bpe_round_trip,
    "op11_importance_resampling": target.op11_importance_resampling,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_simhash_near_dedup": simhash.op13_simhash_near_dedup,
}
SQL = {
    "op6_document_fingerprints": merkle.OP6_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op11_importance_resampling": target.OP11_SQL,
}
