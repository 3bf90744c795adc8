"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import fingerprints, lexicon, lines, neardup, packing, pii, quality, sharding, store, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_minhash_near_dedup": neardup.op3_minhash_near_dedup,
    "op4_content_store": store.op4_content_store,
    "op5_packing": packing.op5_packing,
    "op6_bpe_transducer": lexicon.op6_bpe_transducer,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pii_pseudonyms": pii.op9_pii_pseudonyms,
    "op10_quality_rules": quality.op10_quality_rules,
}

#: The others can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = {"op7_line_dedup": lines.SQL, "op10_quality_rules": quality.SQL}
