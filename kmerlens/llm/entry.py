"""Queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from . import ann, chat, fingerprint, jaccard, kdcodes, langid, lmscore, mixing, packing, passages, toxicity, warc

QUERIES = {
    "op1_cross_entropy_difference": lmscore.op1_cross_entropy_difference,
    "op9_repeated_passages": passages.op9_repeated_passages,
    "op7_weighted_fingerprints": fingerprint.op7_weighted_fingerprints,
    "op8_toxicity_cnn": toxicity.op8_toxicity_cnn,
    "op2_language_mixture": langid.op2_language_mixture,
    "op10_anisotropic_search": ann.op10_anisotropic_search,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_warc_transactions": warc.op6_warc_transactions,
    "op11_chat_format": chat.op11_chat_format,
    "op12_vector_codes": kdcodes.op12_vector_codes,
}

ORACLE_SQL = {
    "op3_jaccard_join": jaccard.OP3_SQL,
    "op6_warc_transactions": warc.OP6_SQL,
    "op11_chat_format": chat.OP11_SQL,
    "op12_vector_codes": kdcodes.OP12_SQL,
}
