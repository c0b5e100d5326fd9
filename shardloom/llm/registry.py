"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import codes, exact_dedup, flac, line_dedup, mixing, near_dedup, packing, pieces, pii, prefix_trie, quality, substring_dedup, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_quality_fm": quality.query,
    "op3_source_mixing": mixing.query,
    "op4_warc_zip": warc.query,
    "op5_suffix_array": substring_dedup.query,
    "op6_near_dedup": near_dedup.query,
    "op7_sentencepiece": pieces.query,
    "op8_line_dedup": line_dedup.query,
    "op9_pii_crf": pii.query,
    "op10_flac": flac.query,
    "op11_partial_distance": codes.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_sum_of_squares": packing.query,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_warc_zip": warc.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_partial_distance": codes.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
