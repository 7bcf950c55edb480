"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import codes, decontaminate, embeddings, jaccard, language, mixing, quality, secrets, shard, spelling, substrings, tokens, toxicity

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_sharding": shard.op2_sharding,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_secrets": secrets.op4_secrets,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality": quality.op6_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_ids": tokens.op8_token_ids,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_embedding_near_dedup": embeddings.op10_embedding_near_dedup,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_language": language.op13_language,
}
ORACLE_SQL = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op3_substring_dedup": substrings.OP3_SQL,
    "op9_ngram_jaccard": jaccard.OP9_SQL,
    "op10_embedding_near_dedup": embeddings.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_vector_codes": codes.OP12_SQL,
}
