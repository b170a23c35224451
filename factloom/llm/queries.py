"""The queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from . import decontamination, language, licenses, mixing, neardup, negatives, pii, quality, runs, sharding, simhash, suffixes, toxicity

QUERIES = {
    "op1_bayes_language": language.query,
    "op2_recurrent_toxicity": toxicity.query,
    "op3_license_scan": licenses.query,
    "op4_permutation_sharding": sharding.query,
    "op5_pii_spans": pii.query,
    "op6_suffix_dedup": suffixes.query,
    "op7_bagminhash_neardup": neardup.query,
    "op8_spaced_seed_decontamination": decontamination.query,
    "op9_flow_mixing": mixing.query,
    "op10_line_quality": quality.query,
    "op11_word_runs": runs.query,
    "op12_vertical_negatives": negatives.query,
    "op13_simhash_tiles": simhash.query,
}

ORACLES = {
    "op1_bayes_language": language.oracle(),
    "op3_license_scan": licenses.oracle(),
    "op4_permutation_sharding": sharding.oracle(),
    "op5_pii_spans": pii.oracle(),
    "op7_bagminhash_neardup": neardup.ORACLE,
    "op8_spaced_seed_decontamination": decontamination.oracle(),
    "op9_flow_mixing": mixing.ORACLE,
    "op10_line_quality": quality.ORACLE,
    "op11_word_runs": runs.ORACLE,
    "op12_vertical_negatives": negatives.ORACLE,
}
