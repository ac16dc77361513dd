"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, exact_dedup, lm_score, ngram_join, pii, quality, sharding, token_counts

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_quality": quality.op3_quality,
    "op4_chat": chat.op4_chat,
    "op5_bpe": bpe.op5_bpe,
    "op6_sharding": sharding.op6_sharding,
    "op7_pii": pii.op7_pii,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_lm_score": lm_score.op9_lm_score,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}
SQL = {"op1_decontaminate": decontaminate.SQL, "op8_exact_dedup": exact_dedup.SQL, "op10_ngram_join": ngram_join.SQL}
