"""Query catalogue: named plans over the test tables and their SQL."""

from __future__ import annotations

import importlib

_MODULES = ("records", "stores", "dealt", "baskets", "markets", "role_time", "quality_store", "extraction", "more")


def all_catalogues():
    """The catalogues of the core, one for each module of this package."""
    return [importlib.import_module(f"adloom.plans.{m}").catalogue for m in _MODULES]
