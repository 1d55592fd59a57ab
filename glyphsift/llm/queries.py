"""The queries of the training-data operators, each over its whole table, and the SQL of those that SQL can express."""

from . import chat_format, embedding_dedup, language_id, line_dedup, minhash_dedup, mixing, packing, quality_rules, sharding, toxicity

QUERIES = {
    "op1_embedding_near_dedup": embedding_dedup.query,
    "op2_mix_sources": mixing.query,
    "op3_chat_format": chat_format.query,
    "op4_quality_rules": quality_rules.query,
    "op5_best_fit_packing": packing.query,
    "op6_language_id": language_id.query,
    "op7_line_dedup": line_dedup.query,
    "op8_toxicity": toxicity.query,
    "op9_sharding": sharding.query,
    "op10_minhash_near_dedup": minhash_dedup.query,
}
#: What SQL can check of the operators whose results it can't express.
CHECKS = {
    "mixing_quotas": (mixing.quotas_query, mixing.QUOTAS_ORACLE),
    "chat_words": (chat_format.words_query, chat_format.WORDS_ORACLE),
    "packing_pieces": (packing.pieces_query, packing.PIECES_ORACLE),
    "language_bytes": (language_id.bytes_query, language_id.BYTES_ORACLE),
    "toxicity_words": (toxicity.words_query, toxicity.WORDS_ORACLE),
    "sharding_homes": (sharding.homes_query, sharding.HOMES_ORACLE),
    "exact_copies_grouped": (minhash_dedup.copies_query, minhash_dedup.COPIES_ORACLE),
}
QUERIES |= {name: run for name, (run, _) in CHECKS.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in CHECKS.items()} | {
    "op1_embedding_near_dedup": embedding_dedup.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
}
