"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from quillbin.llm import centroids, imatch, lexical, line_rules, mixing, packing, quality, secret_scan, simhash, suffix_dedup, token_files, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1,
    "op2_mixing": mixing.op2,
    "op3_token_files": token_files.op3,
    "op4_warc": warc.op4,
    "op5_imatch": imatch.op5,
    "op6_toxicity": toxicity.op6,
    "op7_suffix_dedup": suffix_dedup.op7,
    "op8_line_rules": line_rules.op8,
    "op9_packing": packing.op9,
    "op10_quality": quality.op10,
    "op11_secret_scan": secret_scan.op11,
    "op12_lexical_search": lexical.op12,
    "op13_centroids": centroids.op13,
}

ORACLES: dict[str, str] = {"op4_warc": warc.OP4_SQL, "op8_line_rules": line_rules.OP8_SQL, "op12_lexical_search": lexical.OP12_SQL, "op13_centroids": centroids.OP13_SQL}
