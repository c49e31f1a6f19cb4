"""Queries of the corpus operators and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from tillroll.llm import attention, bpe, chat, collocations, hamming, hnsw, jaccard, language, lines, mixing, quality, toxicity, whitening

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_embedding_dedup": hnsw.op2_embedding_dedup,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality": quality.op5_quality,
    "op6_lm_scoring": attention.op6_lm_scoring,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_exact_top_k": hamming.op9_exact_top_k,
    "op10_ngram_jaccard_join": jaccard.op10_ngram_jaccard_join,
    "op11_phrase_collocations": collocations.op11_phrase_collocations,
    "op12_language_id": language.op12_language_id,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLE = {
    "op3_mix_sources": mixing.ORACLE,
    "op8_chat_formatting": chat.ORACLE,
    "op9_exact_top_k": hamming.ORACLE,
    "op11_phrase_collocations": collocations.ORACLE,
}
