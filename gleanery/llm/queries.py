"""Queries and oracle SQL of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from .ann import op9_anisotropic_search
from .bpe import op2_bpe_round_trip
from .chat import OP1_SQL, op1_preference_chat
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .html_text import op8_ratio_extraction
from .jaccard_join import OP6_SQL, op6_shingle_join
from .mixing import OP10_SQL, op10_source_mix, op10_source_mix_shards
from .quality import op4_factorisation_quality
from .sharding import op7_external_shuffle
from .toxicity import op3_subsequence_toxicity

QUERIES = {
    "op1_preference_chat": op1_preference_chat,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_subsequence_toxicity": op3_subsequence_toxicity,
    "op4_factorisation_quality": op4_factorisation_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_shingle_join": op6_shingle_join,
    "op7_external_shuffle": op7_external_shuffle,
    "op8_ratio_extraction": op8_ratio_extraction,
    "op9_anisotropic_search": op9_anisotropic_search,
    "op10_source_mix": op10_source_mix,
    "op10_source_mix_shards": op10_source_mix_shards,
}

ORACLES = {
    "op1_preference_chat": OP1_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op6_shingle_join": OP6_SQL,
    "op10_source_mix": OP10_SQL,
}
