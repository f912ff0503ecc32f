"""The corpus queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from gridloom.llm import codes, collocations, exact_dedup, fingerprints, minhash, mixing, packing, quality, sharding, substring_dedup, suffix_dedup, tokens, toxicity


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_token_counts": tokens.op2_token_counts,
        "op3_minhash": minhash.op3_minhash,
        "op4_sharding": sharding.op4_sharding,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_fingerprints": fingerprints.op9_fingerprints,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_quality": quality.op11_quality,
        "op12_vector_codes": codes.op12_vector_codes,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact_dedup.SQL, "op12_vector_codes": codes.SQL, "op13_collocations": collocations.SQL}
