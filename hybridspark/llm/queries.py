"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import op3_hash_prefix_forest
from .bpe import op7_byte_level_bpe
from .importance import OP11_SQL, op11_importance_resampling
from .langid import op9_rank_order_language_id
from .merkle import OP13_SQL, op13_merkle_manifest
from .minhash import op1_minhash_fingerprints
from .mixing import OP5_SQL, op5_systematic_mixing
from .secrets import op8_secret_ownership
from .sharding import op2_minimax_sharding
from .simhash import op6_simhash_near_dedup
from .substrings import OP4_SQL, op4_suffix_automaton_dedup
from .urls import OP12_SQL, op12_blocked_bloom_url_filter
from .warc import OP10_SQL, op10_warc_round_trip

QUERIES = {f.__name__: f for f in (op1_minhash_fingerprints, op2_minimax_sharding, op3_hash_prefix_forest, op4_suffix_automaton_dedup, op5_systematic_mixing, op6_simhash_near_dedup, op7_byte_level_bpe, op8_secret_ownership, op9_rank_order_language_id, op10_warc_round_trip, op11_importance_resampling, op12_blocked_bloom_url_filter, op13_merkle_manifest)}

ORACLE_SQL: dict[str, str] = {"op4_suffix_automaton_dedup": OP4_SQL, "op5_systematic_mixing": OP5_SQL, "op10_warc_round_trip": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op12_blocked_bloom_url_filter": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
