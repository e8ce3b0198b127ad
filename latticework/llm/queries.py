"""Queries of the subpackage and their SQL."""

from . import chat_format, embedding_dedup, line_dedup, minhash, packing, quality, sentencepiece_codec, substring_dedup, token_counts, token_shards

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op4_token_shards": token_shards.op4_token_shards,
    "op6_sentencepiece": sentencepiece_codec.op6_sentencepiece,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_embedding_near_dedup": embedding_dedup.op8_embedding_near_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op9_minhash_near_dedup": minhash.op9_minhash_near_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLE_SQL = {
    "op1_chat_format": chat_format.SQL,
    "op8_embedding_near_dedup": embedding_dedup.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op9_minhash_near_dedup": minhash.SQL,
    "op10_line_dedup": line_dedup.SQL,
}
