"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, fingerprint, line_dedup, lm_score, mixing, simhash, token_counts, token_files, topk, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_mixing": mixing.query,
    "op3_simhash": simhash.query,
    "op4_toxicity": toxicity.query,
    "op5_topk": topk.query,
    "op6_fingerprint": fingerprint.query,
    "op7_token_files": token_files.query,
    "op8_bpe": bpe.query,
    "op9_token_counts": token_counts.query,
    "op10_lm_score": lm_score.query,
}
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op5_topk": topk.ORACLE,
}
