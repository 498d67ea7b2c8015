"""One query per operator, over the whole table it is meant for."""

from __future__ import annotations

from . import bpe_codec, html_extraction, hyperminhash, language_id, line_dedup, packing, prefix_trie, quality_rules, suffix_dedup, token_count, warc, whitening, winnowing

QUERIES = {
    "op1_warc_revisits": warc.query,
    "op2_quality_rules": quality_rules.query,
    "op3_pack_sequences": packing.query,
    "op4_bpe_codec": bpe_codec.query,
    "op5_winnowing": winnowing.query,
    "op6_near_duplicates": hyperminhash.query,
    "op7_token_counts": token_count.query,
    "op8_repeated_passages": suffix_dedup.query,
    "op9_language_id": language_id.query,
    "op10_line_dedup": line_dedup.query,
    "op11_whitening": whitening.query,
    "op12_html_extraction": html_extraction.query,
    "op13_prefix_trie": prefix_trie.query,
}

ORACLE: dict[str, str] = {
    "op1_warc_revisits": warc.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op12_html_extraction": html_extraction.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
