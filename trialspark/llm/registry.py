"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from trialspark.llm import bpe, centroids, divergence, exact, fingerprint, licenses, minhash, mixing, pii, quality, substrings, tokenfile, toxicity

QUERIES = {
    "op1_repetition_quality": quality.query,
    "op2_difference_cover_dedup": substrings.query,
    "op5_circulant_minhash": minhash.query,
    "op3_scaled_sketches": fingerprint.query,
    "op8_golden_ratio_mix": mixing.query,
    "op10_license_rules": licenses.query,
    "op4_bootstrapped_pii": pii.query,
    "op6_bpe_words": bpe.query,
    "op7_token_files": tokenfile.query,
    "op9_folded_lexicon_toxicity": toxicity.query,
    "op11_streaming_exact_dedup": exact.query,
    "op12_divergence_cube": divergence.query,
    "op13_bit_plane_centroids": centroids.query,
}
ORACLE: dict[str, str] = {
    "op10_license_rules": licenses.SQL,
    "op11_streaming_exact_dedup": exact.SQL,
    "op12_divergence_cube": divergence.SQL,
    "op13_bit_plane_centroids": centroids.SQL,
}
