"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from newswake.llm import merkle
from newswake.llm.contamination import op8_spaced_seeds
from newswake.llm.conversations import op11_scalar_repair
from newswake.llm.language import op10_fused_language, pages_language
from newswake.llm.mixing import op1_soft_mixture
from newswake.llm.packing import op4_bit_packing
from newswake.llm.quality import op2_divergence_rules
from newswake.llm.secrets import op7_markov_secrets
from newswake.llm.sharding import op5_stratified_shards
from newswake.llm.trie import op3_elias_fano_bigrams
from newswake.llm.substrings import op6_block_anchors
from newswake.llm.simhash import op9_covering_simhash
from newswake.llm.wrappers import op13_wrapper_induction

QUERIES = {f.__name__: f for f in (
    op1_soft_mixture, op2_divergence_rules, op3_elias_fano_bigrams, op4_bit_packing, op5_stratified_shards, op6_block_anchors, op7_markov_secrets, op8_spaced_seeds,
    op9_covering_simhash, op10_fused_language, op11_scalar_repair, merkle.op12_sibling_shift,
    op13_wrapper_induction, pages_language)}

SQL: dict[str, str] = {"op12_sibling_shift": merkle.SQL}
