"""Queries of this subpackage by name, and SQL for those that SQL expresses."""

from addrforge.llm import bpe, embedding_dedup, html_text, language_id, license_scan, minhash_dedup, nearest, packing, suffix_dedup, toxicity


def queries():
    return {
        "op1_nearest_neighbours": nearest.op1_nearest_neighbours,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
        "op4_bpe": bpe.op4_bpe,
        "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
        "op6_language_id": language_id.op6_language_id,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_html_extraction": html_text.op9_html_extraction,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
    }


def oracle_sql():
    return {"op1_nearest_neighbours": nearest.ORACLE, "op5_embedding_dedup": embedding_dedup.ORACLE, "op8_suffix_dedup": suffix_dedup.ORACLE}
