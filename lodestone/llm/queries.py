"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import conversations, linededup, lm, media, packing, phrases, pieces, secrets, simhash, tokencount, toxicity, urlrules, variants

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_lm_scoring": lm.op7_lm_scoring,
    "op8_media_copies": media.op8_media_copies,
    "op9_token_counts": tokencount.op9_token_counts,
    "op10_document_fingerprints": phrases.op10_document_fingerprints,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_url_filters": urlrules.op13_url_filters,
}
ORACLE_SQL = {
    "op6_line_dedup": linededup.OP6_SQL,
    "op11_conversation_repair": conversations.OP11_SQL,
    "op12_spelling_variants": variants.OP12_SQL,
}
