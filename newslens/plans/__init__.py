"""Named queries (one per operator of the inventory) and their DuckDB oracles."""

from __future__ import annotations

import importlib

from newslens.plans.registry import ORACLES, QUERIES

_MODULES = ("text_q", "nlp_q", "clean_q", "extract_q", "labels_q", "graph_q", "model_q", "stream_q")


def _load():
    for m in _MODULES:
        importlib.import_module(f"newslens.plans.{m}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
