"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

from . import ann, bpe, divergence, exact_search, language, mixing, near_duplicates, periodic, privacy, repeats, sharding, token_files, warc

QUERIES = {
    "op1_warc_archives": warc.query,
    "op2_language_id": language.query,
    "op3_shuffle_shards": sharding.query,
    "op4_mix_sources": mixing.query,
    "op5_byte_bpe": bpe.query,
    "op6_disclosure": privacy.query,
    "op7_collision_counting": ann.query,
    "op8_near_duplicates": near_duplicates.query,
    "op9_token_files": token_files.query,
    "op10_exact_top_k": exact_search.query,
    "op11_divergence_audit": divergence.query,
    "op12_repeated_passages": repeats.query,
    "op13_periodic_runs": periodic.query,
}

ORACLE_SQL = {
    "op10_exact_top_k": exact_search.ORACLE_SQL,
    "op11_divergence_audit": divergence.ORACLE_SQL,
    "op1_warc_archives": warc.ORACLE_SQL,
    "op4_mix_sources": mixing.ORACLE_SQL,
}
