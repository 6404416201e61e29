"""Registered queries by family."""

from __future__ import annotations

import importlib

FAMILIES = ("catalog_queries", "group_queries", "score_queries", "evaluation_queries", "stream_queries", "media_queries")


def load():
    """The registry with every family imported."""
    registry = importlib.import_module(".registry", __name__)
    for family in FAMILIES:
        importlib.import_module(f".{family}", __name__)
    return registry
