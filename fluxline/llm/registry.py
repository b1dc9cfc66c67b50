"""Queries of the training-data operators and, where SQL can express one, the SQL that it must equal."""

from __future__ import annotations

from . import align, chat, decontam, fingerprint, langid, line_dedup, lm, mixing, repair, sentencepiece, shingle_join, topk, toxicity


def queries() -> dict:
    fs = [chat.op1_chat_formatting, toxicity.op2_toxicity, shingle_join.op3_ngram_jaccard_join, langid.op4_language_id, lm.op5_lm_scoring, sentencepiece.op6_sentencepiece, line_dedup.op7_line_dedup, mixing.op8_mixing_sources, fingerprint.op9_document_fingerprints, topk.op10_exact_topk, repair.op11_conversation_repair, align.op12_tokenizer_alignment, decontam.op13_benchmark_decontamination]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict:
    return {"op1_chat_formatting": chat.SQL, "op3_ngram_jaccard_join": shingle_join.SQL, "op10_exact_topk": topk.SQL, "op11_conversation_repair": repair.SQL, "op13_benchmark_decontamination": decontam.SQL}
