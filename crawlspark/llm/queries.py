"""The registered queries of the corpus operators."""

from __future__ import annotations

from . import (
    chat,
    chat_repair,
    decontaminate,
    lsh_forest,
    merge_replay,
    packing,
    pii,
    pivot_search,
    repeats,
    spelling,
    token_files,
    toxicity,
    warc,
)

QUERIES = {
    "op1_pivot_search": pivot_search.query,
    "op2_toxicity": toxicity.query,
    "op3_decontaminate": decontaminate.query,
    "op4_warc": warc.query,
    "op5_lsh_forest": lsh_forest.query,
    "op6_repeats": repeats.query,
    "op7_token_files": token_files.query,
    "op8_pii": pii.query,
    "op9_chat": chat.query,
    "op10_packing": packing.query,
    "op11_merge_replay": merge_replay.query,
    "op12_spelling": spelling.query,
    "op13_chat_repair": chat_repair.query,
}
