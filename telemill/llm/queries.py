"""Queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from . import automaton_dedup, hard_negatives, line_dedup, minmax, repetition, suffix_dedup
from .bpe import op7_byte_bpe
from .fingerprints import op5_weighted_sampling
from .packing import op1_harmonic_packing
from .periodic_runs import op12_periodic_runs
from .pii import op8_skip_chain_pii
from .toxicity import op2_noisy_channel_toxicity
from .weak_labels import op10_weak_label_quality

QUERIES = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_noisy_channel_toxicity": op2_noisy_channel_toxicity,
    "op3_suffix_array_dedup": suffix_dedup.op3_suffix_array_dedup,
    "op4_suffix_automaton_dedup": automaton_dedup.op4_suffix_automaton_dedup,
    "op5_weighted_sampling": op5_weighted_sampling,
    "op6_suffix_repetition": repetition.op6_suffix_repetition,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_skip_chain_pii": op8_skip_chain_pii,
    "op9_minmax_near_dedup": minmax.op9_minmax_near_dedup,
    "op10_weak_label_quality": op10_weak_label_quality,
    "op11_anchor_tree_negatives": hard_negatives.op11_anchor_tree_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_bloom_line_dedup": line_dedup.op13_bloom_line_dedup,
}

ORACLE: dict[str, str] = {
    "op3_suffix_array_dedup": suffix_dedup.ORACLE_SQL,
    "op4_suffix_automaton_dedup": automaton_dedup.ORACLE_SQL,
    "op6_suffix_repetition": repetition.ORACLE_SQL,
    "op9_minmax_near_dedup": minmax.ORACLE_SQL,
    "op11_anchor_tree_negatives": hard_negatives.op11_anchor_tree_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op11_anchor_tree_negatives": hard_negatives.ORACLE_SQL,
    "op13_bloom_line_dedup": line_dedup.ORACLE_SQL,
}
