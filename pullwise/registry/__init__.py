"""All registered queries."""

from __future__ import annotations

import importlib

from pullwise.registry.base import REGISTRY, Query

MODULES = ("scoring", "techniques", "extraction", "interop", "reports", "ingestion", "files", "records", "portal", "details")


def all_queries() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"pullwise.registry.{m}")
    return dict(REGISTRY)
