"""Registered queries of the subpackage, and their reference SQL where SQL can express them."""

from webtext.llm import alignment, chat_format, chunk_dedup, exact_dedup, language_id, nbest_pieces, nearest, packing, pivots, prefix_trie, simhash, suffix_dedup, url_filter

QUERIES = {f.__name__: f for f in (
    url_filter.op1_url_filters,
    exact_dedup.op2_exact_dedup,
    language_id.op3_language_id,
    chat_format.op4_chat_formatting,
    chunk_dedup.op5_substring_dedup,
    nbest_pieces.op6_sentencepiece,
    simhash.op7_simhash_near_dedup,
    nearest.op8_approximate_nearest_neighbours,
    suffix_dedup.op9_suffix_array_dedup,
    packing.op10_packing,
    prefix_trie.op11_conversation_prefix_trie,
    alignment.op12_cross_tokenizer_alignment,
    pivots.op13_embedding_near_dedup,
)}

ORACLES = {
    "op1_url_filters": url_filter.ORACLE_SQL,
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op4_chat_formatting": chat_format.ORACLE_SQL,
    "op11_conversation_prefix_trie": prefix_trie.ORACLE_SQL,
}
