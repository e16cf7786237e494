"""All registered queries (importing the plan modules registers them)."""

from __future__ import annotations

import importlib

from .registry import REGISTRY, Query

_MODULES = ["scans", "reports", "listings", "scalars", "changes", "quality", "events", "streams", "effects", "named"]


def all_queries() -> dict[str, Query]:
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")
    return REGISTRY
