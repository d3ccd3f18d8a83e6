"""Registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from . import curriculum, line_dedup, lm_scoring, merkle, minhash_dedup, order_minhash, piece_codec, simhash_dedup, spelling, substring_dedup, topk_search, toxicity, warc

QUERIES = {
    "op1_topk_search": topk_search.op1_topk_search,
    "op2_warc": warc.op2_warc,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_curriculum_mix": curriculum.op5_curriculum_mix,
    "op6_minhash_dedup": minhash_dedup.op6_minhash_dedup,
    "op7_order_minhash": order_minhash.op7_order_minhash,
    "op8_sentencepiece": piece_codec.op8_sentencepiece,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_covering_simhash": simhash_dedup.op11_covering_simhash,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES = {
    "op1_topk_search": topk_search.ORACLE,
    "op5_curriculum_mix": curriculum.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
