"""The operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from papyra.llm import exact_dedup, knn_join, language_id, packing, piece_bpe, quality, secrets_scan, simhash, token_files, url_filter

QUERIES = {
    "op1_knn_join": knn_join.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_quality": quality.op3,
    "op4_language_id": language_id.op4,
    "op5_piece_bpe": piece_bpe.op5,
    "op6_url_filter": url_filter.op6,
    "op7_exact_dedup": exact_dedup.op7,
    "op8_simhash": simhash.op8,
    "op9_secret_scan": secrets_scan.op9,
    "op10_token_files": token_files.op10,
}
ORACLE_SQL = {
    "op1_knn_join": knn_join.OP1_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
}
