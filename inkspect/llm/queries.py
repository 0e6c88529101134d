"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import collocations, exact_dedup, filter_audit, langid, line_dedup, media, minhash, packing, quality, simhash, substring_dedup, suffix_dedup, tokenise


def queries():
    return {
        "op1_packing": packing.op1_packing,
        "op2_bpe": tokenise.op2_bpe,
        "op3_language_id": langid.op3_language_id,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_simhash": simhash.op5_simhash,
        "op6_quality": quality.op6_quality,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_media": media.op10_media,
        "op11_minhash": minhash.op11_minhash,
        "op12_collocations": collocations.op12_collocations,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql():
    return {"op7_line_dedup": line_dedup.SQL, "op8_exact_dedup": exact_dedup.SQL, "op12_collocations": collocations.SQL, "op13_filter_audit": filter_audit.SQL}
