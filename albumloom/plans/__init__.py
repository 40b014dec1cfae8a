"""Named queries over the given tables."""

from __future__ import annotations

import importlib

MODULES = ["photo_core", "texts", "places", "curate", "albums", "reports", "documents", "streams"]


def load_all():
    """Import every query module once and return the registry."""
    for m in MODULES:
        importlib.import_module(f"albumloom.plans.{m}")
    from albumloom.plans.registry import ENTRIES

    return ENTRIES
