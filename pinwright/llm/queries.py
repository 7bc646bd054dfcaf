"""The numbered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from pinwright.llm import (alignment, attention, chat, counts, decontaminate, divergence, lines, passages,
                           pieces, quality, records, simhash, urls)

QUERIES = {
    "op1_sentencepiece_round_trip": pieces.op1_sentencepiece_round_trip,
    "op2_url_filter": urls.op2_url_filter,
    "op3_chat_format": chat.op3_chat_format,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_token_records": records.op5_token_records,
    "op6_simhash_components": simhash.op6_simhash_components,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_token_counts": counts.op9_token_counts,
    "op10_near_duplicate_passages": passages.op10_near_duplicate_passages,
    "op11_quality_classifier": attention.op11_quality_classifier,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
}

ORACLES: dict[str, str] = {
    "op3_chat_format": chat.OP3_SQL,
    "op4_benchmark_decontamination": decontaminate.OP4_SQL,
    "op8_line_dedup": lines.OP8_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
}
