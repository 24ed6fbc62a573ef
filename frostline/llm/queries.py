"""Queries of the corpus operators for the driver's registry, with SQL where SQL can express them."""

from __future__ import annotations

from frostline.llm import alignment, exact_topk, language_model, mixing, near_dedup, packing, preferences, quality, resampling, site_pages, surrogates, token_files, toxicity


def queries() -> dict:
    return {
        "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
        "op2_deleted_interpolation": language_model.op2_deleted_interpolation,
        "op3_source_mix": mixing.op3_source_mix,
        "op4_exact_topk": exact_topk.op4_exact_topk,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_token_files": token_files.op6_token_files,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_preference_formatting": preferences.op8_preference_formatting,
        "op9_pii_surrogates": surrogates.op9_pii_surrogates,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_site_style_tree": site_pages.op11_site_style_tree,
        "op12_importance_resampling": resampling.op12_importance_resampling,
        "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_topk": exact_topk.OP4_SQL}
