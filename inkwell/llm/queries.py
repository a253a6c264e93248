"""Registry of this package's queries and their SQL."""

from __future__ import annotations

from inkwell.llm import bpe, chat, ctw, exact_dedup, language, ngram_join, packing, quality, vector_graph, warc

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_language_id": language.op3_language_id,
    "op4_curve_packing": packing.op4_curve_packing,
    "op5_vector_graph": vector_graph.op5_vector_graph,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_ngram_jaccard": ngram_join.op7_ngram_jaccard,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_ctw_scoring": ctw.op9_ctw_scoring,
    "op10_warc": warc.op10_warc,
}

SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op8_chat_formatting": chat.SQL,
    "op10_warc": warc.SQL,
}
