"""The corpus operators as queries, with their SQL twins where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tallycast.llm import (
    chat,
    decontaminate,
    neighbours,
    packing,
    pages,
    prefixes,
    secrets,
    sharding,
    simhash,
    spelling,
    substrings,
    toxicity,
    wavelet,
)

_QUERIES = {
    "op1_sampled_splitters": (sharding.op1, None),
    "op2_benchmark_decontamination": (decontaminate.op2, decontaminate.OP2_SQL),
    "op3_substring_dedup": (substrings.op3, None),
    "op4_sum_of_squares_packing": (packing.op4, None),
    "op5_chat_formatting": (chat.op5, None),
    "op6_nearest_neighbours": (neighbours.op6, None),
    "op7_page_differencing": (pages.op7, None),
    "op8_toxicity": (toxicity.op8, None),
    "op9_simhash_near_duplicates": (simhash.op9, None),
    "op10_secret_scans": (secrets.op10, secrets.OP10_SQL),
    "op11_wavelet_matrix": (wavelet.op11, None),
    "op12_spelling_variants": (spelling.op12, None),
    "op13_conversation_trie": (prefixes.op13, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}


def queries():
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
