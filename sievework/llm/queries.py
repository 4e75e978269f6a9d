"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from sievework.llm import chat_format, filter_audit, image_copies, jaccard_join, language_id, mixing, piece_lattice, quality_rank, suffix_dedup, token_alignment, token_files, vector_graph, warc_store

QUERIES = {
    "op1_image_copies": image_copies.op1_image_copies,
    "op2_mixing": mixing.op2_mixing,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_language_id": language_id.op5_language_id,
    "op6_vector_graph": vector_graph.op6_vector_graph,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_piece_lattice": piece_lattice.op8_piece_lattice,
    "op9_token_files": token_files.op9_token_files,
    "op10_warc_store": warc_store.op10_warc_store,
    "op11_quality_rank": quality_rank.op11_quality_rank,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op4_chat_format": chat_format.OP4_SQL,
    "op6_vector_graph": vector_graph.OP6_SQL,
    "op10_warc_store": warc_store.OP10_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
