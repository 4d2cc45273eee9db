"""Query catalogue over the driver tables."""

from __future__ import annotations

import importlib

MODULES = ["technical", "evaluation", "research", "screening", "portfolio", "filings", "footnotes", "streams", "landing", "landed"]


def load_all():
    from .registry import QUERIES
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return QUERIES
