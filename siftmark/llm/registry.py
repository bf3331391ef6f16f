"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("chat_formatting", "decontamination", "html_extraction", "license_scans", "line_dedup", "ngram_join", "packing", "periodic_runs", "quality_rules", "ranked_search", "secret_scans", "toxicity", "url_filters")


def collect(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__package__}.{name}"), what)
    return found
