"""Names of this package's queries and their SQL."""

from __future__ import annotations

from . import html_text, language, packing, piece_bpe, quality, radix_dedup, sharding, simhash, token_counts, wavelet

QUERIES = {
    "op1_virtual_slots": sharding.op1_virtual_slots,
    "op2_linear_grouping": packing.op2_linear_grouping,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_radix_dedup": radix_dedup.op5_radix_dedup,
    "op6_wavelet_matrix": wavelet.op6_wavelet_matrix,
    "op7_simhash": simhash.op7_simhash,
    "op8_site_templates": html_text.op8_site_templates,
    "op9_language_id": language.op9_language_id,
    "op10_piece_bpe": piece_bpe.op10_piece_bpe,
}

ORACLES = {"op5_radix_dedup": radix_dedup.ORACLE}
