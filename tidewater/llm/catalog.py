"""The queries of the training-data operators, and the SQL they are held against."""

from tidewater.llm import (
    bpe_trie,
    chat_format,
    decontaminate,
    fill_in_middle,
    hamming_index,
    language_id,
    phrase_mining,
    quality_ratio,
    sharding,
    simhash_golay,
    suffix_dedup,
    token_rollup,
    url_filter,
)

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_token_rollup": token_rollup.op2_token_rollup,
    "op3_url_trees": url_filter.op3_url_trees,
    "op4_rendezvous_shards": sharding.op4_rendezvous_shards,
    "op5_quality_ratio": quality_ratio.op5_quality_ratio,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_bpe_trie": bpe_trie.op8_bpe_trie,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_simhash_golay": simhash_golay.op10_simhash_golay,
    "op11_phrase_mining": phrase_mining.op11_phrase_mining,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_hamming_index": hamming_index.op13_hamming_index,
}
ORACLES = {
    "op2_token_rollup": token_rollup.OP2_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op11_phrase_mining": phrase_mining.OP11_SQL,
    "op12_fill_in_middle": fill_in_middle.OP12_SQL,
}
