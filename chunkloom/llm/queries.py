"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat_format, decontamination, fingerprints, line_dedup, lm_scoring, simhash_dedup, token_counts, token_files, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_token_counts": token_counts.query,
    "op3_decontamination": decontamination.query,
    "op4_simhash_dedup": simhash_dedup.query,
    "op5_line_dedup": line_dedup.query,
    "op6_lm_scoring": lm_scoring.query,
    "op7_token_files": token_files.query,
    "op8_byte_bpe": bpe.query,
    "op9_chat_format": chat_format.query,
    "op10_fingerprints": fingerprints.query,
}

SQL = {"op3_decontamination": decontamination.SQL, "op5_line_dedup": line_dedup.SQL, "op9_chat_format": chat_format.SQL}
