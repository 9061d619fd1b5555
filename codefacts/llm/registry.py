"""The operators' queries and, where SQL can express them, their SQL."""

from codefacts.llm import align, ann, htmltext, idfiles, jaccard, langid, packing, pieces, ranked, repeats, sharding, topk, toxicity

QUERIES = {
    "op1_hierarchical_language_id": langid.op1_hierarchical_language_id,
    "op2_trie_pieces": pieces.op2_trie_pieces,
    "op3_ivf_pq_neighbours": ann.op3_ivf_pq_neighbours,
    "op4_hash_tree_sharding": sharding.op4_hash_tree_sharding,
    "op5_least_squares_packing": packing.op5_least_squares_packing,
    "op6_norm_sorted_products": topk.op6_norm_sorted_products,
    "op7_set_relation_jaccard": jaccard.op7_set_relation_jaccard,
    "op8_string_kernel_toxicity": toxicity.op8_string_kernel_toxicity,
    "op9_consensus_path_text": htmltext.op9_consensus_path_text,
    "op10_sparse_suffix_repeats": repeats.op10_sparse_suffix_repeats,
    "op11_hashed_pair_alignment": align.op11_hashed_pair_alignment,
    "op12_elias_fano_id_files": idfiles.op12_elias_fano_id_files,
    "op13_hybrid_ranked_search": ranked.op13_hybrid_ranked_search,
}
ORACLE_SQL = {
    "op4_hash_tree_sharding": sharding.oracle(sharding.balanced_tree(8), sharding.grow(sharding.balanced_tree(8))),
    "op6_norm_sorted_products": topk.ORACLE,
    "op7_set_relation_jaccard": jaccard.ORACLE,
    "op13_hybrid_ranked_search": ranked.ORACLE,
}
