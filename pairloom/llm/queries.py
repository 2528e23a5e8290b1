"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pairloom.llm import exact_dedup, hnsw, mixing, packing, quality, simhash, token_files, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_simhash": simhash.op2_simhash,
    "op3_warc": warc.op3_warc,
    "op4_token_files": token_files.op4_token_files,
    "op5_packing": packing.op5_packing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": quality.op7_quality,
    "op8_hnsw": hnsw.op8_hnsw,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES = {
    "op3_warc": warc.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
}
