"""Registered queries of this subpackage: one per operator, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

MODULES = ["mixing", "ngram_join", "warc", "html_blocks", "packing", "host_quality", "chat_format", "pii", "url_filter", "binary_dedup", "piece_codec", "whitening", "periodic_runs"]


def load() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"seqloom.llm.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
