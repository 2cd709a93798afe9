"""The corpus queries by name, with SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, html_text, lm_score, mixing, near_dup, quality, secrets, simhash, suffix_dedup, token_alignment, toxicity, url_rules, vector_codes

QUERIES = {
    "op1_near_dup": near_dup.op1_near_dup,
    "op2_url_rules": url_rules.op2_url_rules,
    "op3_quality": quality.op3_quality,
    "op4_lm_score": lm_score.op4_lm_score,
    "op5_html_text": html_text.op5_html_text,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_secrets": secrets.op8_secrets,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_leaks": decontaminate.op10_leaks,
    "op11_simhash": simhash.op11_simhash,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLE_SQL = {"op2_url_rules": url_rules.ORACLE_SQL, "op13_vector_codes": vector_codes.ORACLE_SQL}
