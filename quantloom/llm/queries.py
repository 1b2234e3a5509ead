"""The registered queries of this subpackage and the SQL that states them, where SQL can."""

from __future__ import annotations

from quantloom.llm import bpe_chunks, clusters, decontam, exact_dedup, lm_scoring, minhash, mixing, pii, quality, resampling, secrets, token_counts, token_output

QUERIES = {
    "op1_pseudo_likelihood": lm_scoring.op1_pseudo_likelihood,
    "op2_token_output": token_output.op2_token_output,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_personal_data": pii.op4_personal_data,
    "op5_near_dedup": minhash.op5_near_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_quality": quality.op9_quality,
    "op10_secrets": secrets.op10_secrets,
    "op11_resampling": resampling.op11_resampling,
    "op12_centroids": clusters.op12_centroids,
    "op13_chunk_bpe": bpe_chunks.op13_chunk_bpe,
}
ORACLES = {
    "op3_source_mix": mixing.OP3_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op12_centroids": clusters.OP12_SQL,
}
