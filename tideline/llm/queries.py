"""The registered queries of this subpackage, one for each operator, and their SQL."""

from . import bitplanes, fill_middle, fingerprints, html_text, line_dedup, merkle, mixing, ngram_join, packing, quality, secrets, topk, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_warc_round_trip": warc.op2,
    "op3_ngram_jaccard": ngram_join.op3,
    "op4_token_bitplanes": bitplanes.op4,
    "op5_exact_top_k": topk.op5,
    "op6_main_text": html_text.op6,
    "op7_secret_scans": secrets.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_source_mixing": mixing.op9,
    "op10_quality_rules": quality.op10,
    "op11_fill_middle": fill_middle.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_fingerprints": fingerprints.op13,
}

ORACLES = {
    "op2_warc_round_trip": warc.ORACLE_SQL,
    "op5_exact_top_k": topk.ORACLE_SQL,
    "op7_secret_scans": secrets.ORACLE_SQL,
    "op9_source_mixing": mixing.ORACLE_SQL,
    "op10_quality_rules": quality.ORACLE_SQL,
    "op11_fill_middle": fill_middle.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
}
