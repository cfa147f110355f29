"""The training-data queries and their SQL, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import contamination, embedding_links, host_quality, id_files, language_id, line_chunks, line_hash, packing, reply_trees, simhash_vp, suffix_dedup, target_draw, whitening
from tidemark.plans.session import ready


def queries() -> dict:
    made = {
        "op1_reply_trees": reply_trees.op1_reply_trees,
        "op2_host_quality": host_quality.op2_host_quality,
        "op3_simple8b_files": id_files.op3_simple8b_files,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_containment": contamination.op6_containment,
        "op7_simhash_vp": simhash_vp.op7_simhash_vp,
        "op8_language_id": language_id.op8_language_id,
        "op9_line_hash": line_hash.op9_line_hash,
        "op10_line_chunks": line_chunks.op10_line_chunks,
        "op11_nn_descent": embedding_links.op11_nn_descent,
        "op12_qd_whitening": whitening.op12_qd_whitening,
        "op13_importance_draw": target_draw.op13_importance_draw,
        "pipeline": corpus_pipeline.run,
    }
    return {name: ready(query) for name, query in made.items()}


def oracle_sql() -> dict:
    return {
        "op1_reply_trees": reply_trees.ORACLE,
        "op2_host_quality": host_quality.ORACLE,
        "op6_containment": contamination.ORACLE,
        "op9_line_hash": line_hash.ORACLE,
    }
