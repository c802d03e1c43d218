"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from visitframe.llm import ann, chat, divergence, embedding_dedup, kneser_ney, license_scan, line_dedup, lm_scoring, mixing, packing, prefix_free, simhash, vector_codes

QUERIES = {f.__name__: f for f in (
    mixing.op1_pareto_mix,
    simhash.op2_simhash_components,
    ann.op3_prefix_forest_neighbours,
    chat.op4_chat_views,
    embedding_dedup.op5_graph_near_duplicates,
    line_dedup.op6_site_line_dedup,
    kneser_ney.op7_kneser_ney_quality,
    license_scan.op8_license_scan,
    packing.op9_best_fit_packing,
    prefix_free.op10_repeated_passages,
    divergence.op11_source_divergences,
    vector_codes.op12_walsh_vector_codes,
    lm_scoring.op13_elias_fano_scores,
)}
SQL: dict[str, str] = {"op4_chat_views": chat.OP4_SQL, "op6_site_line_dedup": line_dedup.OP6_SQL,
                       "op11_source_divergences": divergence.OP11_SQL, "op12_walsh_vector_codes": vector_codes.OP12_SQL}
