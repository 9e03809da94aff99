"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import chat, chat_repair, lsh_forest, pivot_search, spelling, warc

ORACLES: dict[str, str] = {
    "op1_pivot_search": pivot_search.ORACLE,
    "op4_warc": warc.ORACLE,
    "op5_lsh_forest": lsh_forest.ORACLE,
    "op9_chat": chat.ORACLE,
    "op12_spelling": spelling.ORACLE,
    "op13_chat_repair": chat_repair.ORACLE,
}
