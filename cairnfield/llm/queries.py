"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, hash_tree, language_id, licenses, near_dups, packing, spelling, suffix_tree, url_rules, vector_codes, warc, weighted_sampling

QUERIES = {
    "op1_warc_salvage": warc.query,
    "op2_url_association_rules": url_rules.query,
    "op3_suffix_tree_scores": suffix_tree.query,
    "op4_dp_packing": packing.query,
    "op5_weighted_sampling": weighted_sampling.query,
    "op6_positional_index": decontaminate.query,
    "op7_order_minhash": near_dups.query,
    "op8_hash_tree_sharding": hash_tree.query,
    "op9_language_codes": language_id.query,
    "op10_license_dice": licenses.query,
    "op11_spelling_variants": spelling.query,
    "op12_vector_codes": vector_codes.query,
    "op13_bpe_automaton": bpe.query,
}

ORACLES: dict[str, str] = {
    "op6_positional_index": decontaminate.ORACLE,
    "op11_spelling_variants": spelling.query,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}
