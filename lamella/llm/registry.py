"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import backoff_lm, language_id, line_dedup, merkle, minhash, mixing, nearest, passage_dedup, piece_lattice, simhash, toxicity, turn_repair, webp

QUERIES = {
    "op1_nearest": nearest.query,
    "op2_line_dedup": line_dedup.query,
    "op3_toxicity": toxicity.query,
    "op4_language_id": language_id.query,
    "op5_webp": webp.query,
    "op6_simhash": simhash.query,
    "op7_passage_dedup": passage_dedup.query,
    "op8_mixing": mixing.query,
    "op9_piece_lattice": piece_lattice.query,
    "op10_backoff_lm": backoff_lm.query,
    "op11_minhash": minhash.query,
    "op12_turn_repair": turn_repair.query,
    "op13_merkle": merkle.query,
}
ORACLES = {"op2_line_dedup": line_dedup.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL, "op13_merkle": merkle.ORACLE_SQL}
